"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut into two halves, and a codebook is learned for each half; a pair
of codes is a cell, with a list of its vectors. The inner product of an anchor
with any vector of a cell is at most the sum of two half scores: the half's product
with the code, and its length times the radius of the code, which is the greatest
distance of any half from it. Sorted half scores are two sequences; a heap visits
their sums from the greatest down, so cells come in the order of their bounds.

Each search has two passes. The first visits cells until they hold some hundred
vectors that may count; the score of the last one that is wanted, of those found,
is a lower bound. The second visits cells as long as their bound is not below it.
What is not visited cannot count, so each window is certified whole, and nothing
depends on how well the codes fit: bad codes make more visits.

An anchor's positives are the best of its label. Labels of few vectors are one
list. The window of a positive is a range of scores that is relative to its own; the
negatives are the best of other labels in it. Lists of neighbouring cells stand on
a shelf of bounded size, and an anchor goes to a shelf once for all cells it visits
there, so its rows grow with the shelves and not with the cells. Shelves and the
anchors that visit them meet in pairs of blocks of bounded size, so one list or
label may hold any share of the rows.

The codebooks are fitted on ``SAMPLE`` vectors at most, picked by hash; all rows
are indexed. Vectors of another length than the anchor's are not compared with it.
Rows with a null id, label or vector, no components, or a null or non-finite
component take no part. A repeated row is another row; rows with an anchor's own id
are not among its others. Scores beyond 64 bits are held at the bounds of these.
"""

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwake.llm.common import prepare, runs, written
from editwake.plans.layout import small_side

SAMPLE = 20_000  # vectors that the codebooks are fitted on
ROUNDS = 12  # of the fit
PER_CELL = 64  # vectors of a cell, about
MOST_CODES = 256  # of a half
BLOCK = 2_048  # vectors of a list that are scored at once
SHELF = 1_536  # vectors at which a shelf of cells ends
SENT = 4_096  # rows of a batch of visits
VISITORS = 1_024  # anchors that score them at once
PROBED = 64  # vectors that the first pass wants for each one that is asked for
WHOLE = -1  # the shelf of a label of few vectors
SEED = 12
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def integers(packed: list[bytes], size: int) -> np.ndarray:
    """Packed vectors as rows of whole numbers, held as doubles."""
    rows = [np.frombuffer(p, "<i4" if len(p) == 4 * size else "<f8") for p in packed]
    return np.array(rows, dtype=np.float64).reshape(len(rows), size)


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, as 64-bit numbers."""
    most = np.abs(one).max(initial=0) * np.abs(two).max(initial=0) * max(1, one.shape[1])
    if most < EXACT:
        return (one @ two.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side] for side in (one, two)]
    sums = [[sum(x * y for x, y in zip(a, b)) for b in whole[1]] for a in whole[0]]
    return np.array([[min(max(s, LEAST), MOST) for s in row] for row in sums], dtype=np.int64).reshape(len(one), len(two))


def learn_codes(halves: np.ndarray, codes: int) -> np.ndarray:
    """Centres of the halves of a sample, by alternating assignment and means."""
    rng = np.random.default_rng(SEED)
    centres = halves[rng.permutation(len(halves))[:codes]]
    for _ in range(ROUNDS):
        own = nearest(halves, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, halves)
        seen = np.bincount(own, minlength=len(centres))
        centres = np.where(seen[:, None] > 0, sums / np.maximum(1, seen)[:, None], centres)
    return centres


def nearest(halves: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each half, and its distance."""
    own = ((centres * centres).sum(axis=1) - 2 * (halves @ centres.T)).argmin(axis=1)
    rest = halves - centres[own]
    return own, np.sqrt((rest * rest).sum(axis=1))


class Index:
    """Codebooks of one length of vectors, and what is known of all rows: radii, sizes of lists and the rows before each."""

    def __init__(self, size: int, books: list[np.ndarray]):
        self.half, self.books = size // 2, books
        self.radii = [np.zeros(len(b)) for b in books]
        self.members = np.zeros(tuple(len(b) for b in books), dtype=np.int64)
        self.before = np.zeros(self.members.size, dtype=np.int64)

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, : self.half], vectors[:, self.half :]]

    def bounds(self, vectors: np.ndarray) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        """For each vector the greatest and the least half scores of the codes of both halves."""
        middle = [h @ b.T for h, b in zip(self.halves(vectors), self.books)]
        reach = [np.sqrt((h * h).sum(axis=1))[:, None] * r for h, r in zip(self.halves(vectors), self.radii)]
        # Room for the rounding of doubles.
        reach = [r + 1e-9 * (np.abs(m) + r) + 1e-6 for m, r in zip(middle, reach)]
        for k in range(len(vectors)):
            yield [m[k] + r[k] for m, r in zip(middle, reach)], [m[k] - r[k] for m, r in zip(middle, reach)]


def descending(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """All pairs of places of two sequences, the greatest sum first, by a heap."""
    first, second = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    a, b = one[first].tolist(), two[second].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        total, i, j = heappop(heap)
        yield int(first[i]), int(second[j]), -total
        # Each pair is reached once: along the second sequence, or at its start along the first.
        if j + 1 < len(b):
            heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def visits(index: Index, upper: list, lower: list, lows: list[int], highs: list[int], wanted: float | None) -> np.ndarray:
    """The cells that may hold what lies in any of the windows; enough of them for ``wanted`` rows, if given.

    Without a number nothing hangs on the order: the cells at which the heap would
    arrive are taken at once.
    """
    if wanted is None:
        most, low = (one[:, None] + two for one, two in (upper, lower))
        inside = np.zeros(index.members.shape, dtype=bool)
        for lo, hi in zip(lows, highs):
            # Whole numbers that are no doubles may round to the wrong side.
            inside |= (most >= np.nextafter(float(lo), -np.inf)) & (low <= np.nextafter(float(hi), np.inf))
        return np.flatnonzero(inside & (index.members > 0))
    found, seen, least = [], 0, min(lows)
    for i, j, most in descending(*upper):
        if most < least or seen >= wanted:
            break
        low = lower[0][i] + lower[1][j]
        if index.members[i, j] and any(most >= lo and low <= hi for lo, hi in zip(lows, highs)):
            found.append(i * len(index.books[1]) + j)
            seen += index.members[i, j]
    return np.array(found, dtype=np.int64)


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """The rows that take part: ``node``, ``id``, ``label``, ``size`` and ``packed`` whole numbers."""
    number, label, vector = F.col(f"`{id_col}`"), F.col(f"`{label_col}`"), F.col(f"`{vector_col}`")
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    sound = number.isNotNull() & label.isNotNull() & (F.size(vector) > 0) & finite
    whole = F.transform(vector, lambda x: x.cast("double") * scale)

    def run(batches):
        for batch in batches:
            lists = [np.floor(v) for v in batch.column(2).to_numpy(zero_copy_only=False)]
            kinds = ["<i4" if np.abs(v).max() < 2**31 else "<f8" for v in lists]
            packed = pa.array([v.astype(k).tobytes() for v, k in zip(lists, kinds)], pa.binary())
            sizes = pa.array([v.size for v in lists], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sizes, packed], ["id", "label", "size", "packed"])

    made = rows.where(sound).select(number.alias("id"), label.alias("label"), whole.alias("vector"))
    made = made.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, size int, packed binary")
    return made.withColumn("node", F.monotonically_increasing_id()).withColumn("scope", F.xxhash64("label"))


def _fitted(vectors: DataFrame) -> dict[int, Index]:
    """An index for each length in the sample, without what is known of all rows."""
    counts = {r["size"]: r["count"] for r in vectors.groupBy("size").count().collect()}
    sampled = vectors.select("size", "packed").orderBy(F.xxhash64("packed", F.lit(SEED)), "packed").limit(SAMPLE)
    of_size: dict[int, list[bytes]] = {size: [] for size in counts}
    for size, packed in sampled.collect():
        of_size[size].append(bytes(packed))
    found = {}
    for size, n in counts.items():
        sample = integers(of_size[size], size) if of_size[size] else np.zeros((1, size))
        codes = int(np.clip(np.sqrt(n / PER_CELL), 1, MOST_CODES))
        halves = Index(size, []).halves(sample)
        found[size] = Index(size, [learn_codes(h, codes) for h in halves])
    return found


def _placed(vectors: DataFrame, sent) -> DataFrame:
    """Each row with its cell and the distances of its halves from their codes."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            cells, near = np.zeros(len(sizes), dtype=np.int64), np.zeros((2, len(sizes)))
            for size in np.unique(sizes).tolist():
                at, index = np.flatnonzero(sizes == size), sent.value[size]
                own = integers(batch.column(1).take(pa.array(at)).to_pylist(), size)
                (one, near[0, at]), (two, near[1, at]) = (nearest(h, b) for h, b in zip(index.halves(own), index.books))
                cells[at] = one * len(index.books[1]) + two
            columns = [*batch.columns[2:], batch.column(0), batch.column(1), pa.array(cells), *map(pa.array, near)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "size", "packed", "cell", "near_1", "near_2"])

    names = ["node", "id", "label", "scope"]
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in names)
    schema = f"{kinds}, size int, packed binary, cell long, near_1 double, near_2 double"
    return vectors.select("size", "packed", *names).mapInArrow(run, schema)


def _complete(indexes: dict[int, Index], placed: DataFrame) -> DataFrame:
    """Enter the sizes and radii of all cells; there is a bounded number of them.

    Returns the cells with the number of rows ``before`` each, by which they are put on shelves.
    """
    cells = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("near_1").alias("r1"), F.max("near_2").alias("r2"))
    earlier = Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))), "cells")
    for size, cell, n, *reach, before in cells.collect():
        index = indexes[size]
        codes = divmod(cell, len(index.books[1]))
        index.members[codes] = n
        index.before[cell] = before
        for radii, code, r in zip(index.radii, codes, reach):
            radii[code] = max(radii[code], r)
    return cells.select("size", "cell", "before")


def _visiting(asked: DataFrame, sent, per_window: float | None) -> DataFrame:
    """Each asking anchor once for each shelf with cells it visits, for all its windows."""
    names = ["node", "id", "label", "scope", "size", "packed", "share", "width", "lows", "highs"]

    def run(batches):
        for batch in batches:
            sizes = batch.column(4).to_pylist()
            share, widths, lows, highs = (batch.column(i).to_pylist() for i in (6, 7, 8, 9))
            packed = batch.column(5).to_pylist()

            def dealt(rows, shelves):
                taken = batch.take(pa.array(np.concatenate(rows)))
                return pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(shelves))], [*names, "shelf"])

            rows: list[np.ndarray] = []
            shelves: list[np.ndarray] = []
            held = 0
            for at, size in enumerate(sizes):
                index = sent.value[size]
                upper, lower = next(index.bounds(integers([packed[at]], size)))
                wanted = None if per_window is None else per_window * PROBED / share[at]
                cells = visits(index, upper, lower, lows[at], highs[at], wanted)
                found = np.unique(index.before[cells] // widths[at])
                # Visits are sent on as they get many: a batch of anchors may visit millions of lists.
                for lo in range(0, len(found), SENT):
                    part = found[lo : lo + SENT]
                    if rows and held + len(part) > SENT:
                        yield dealt(rows, shelves)
                        rows, shelves, held = [], [], 0
                    rows.append(np.full(len(part), at))
                    shelves.append(part)
                    held += len(part)
            if rows:
                yield dealt(rows, shelves)

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in names)
    return asked.select(*names).mapInArrow(run, f"{kinds}, shelf long")


KEYS = ["scope", "size", "shelf", "block", "part"]


def _met(visiting: DataFrame, listed: DataFrame) -> DataFrame:
    """Visitors and the vectors of the shelves they visit, in pairs of blocks of bounded size."""
    lists = KEYS[:3]
    visited = visiting.groupBy(*lists).agg(F.count("*").alias("visitors"))
    known = listed.groupBy(*lists).agg(F.count("*").alias("members")).join(visited, lists)
    known = known.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("parts", F.ceil(F.col("visitors") / VISITORS))
    known = small_side(written(known.select(*lists, "blocks", "parts"), "visited-lists"))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    none = F.lit(None).cast("array<long>")
    kept = ["node", "id", "label", "packed"]
    rows = listed.join(known, lists).withColumn("block", own("blocks")).withColumn("part", each("parts"))
    asking = visiting.join(known, lists).withColumn("part", own("parts")).withColumn("block", each("blocks"))
    return rows.select(*KEYS, F.lit(False).alias("asks"), *kept, none.alias("lows"), none.alias("highs")).unionAll(
        asking.select(*KEYS, F.lit(True), *kept, "lows", "highs")
    )


def _best(visiting: DataFrame, listed: DataFrame, wanted: int, same: bool) -> DataFrame:
    """For each window of a visitor the best rows of its own label, or of others: ``rank``, ``other``, ``score``."""
    kind = listed.schema["id"].dataType.simpleString()

    def run(batches):
        for group in runs(batches, KEYS):
            asks = group["asks"].to_numpy(zero_copy_only=False)
            asking = np.flatnonzero(asks)
            rows = np.flatnonzero(~asks)
            if not asking.size or not rows.size:
                continue
            size = group["size"][0].as_py()
            packed = group["packed"].to_pylist()
            scores = products(*(integers([packed[i] for i in side], size) for side in (asking, rows)))
            ids, labels, nodes = (group[c].to_numpy() for c in ("id", "label", "node"))
            lows, highs = group["lows"].to_pylist(), group["highs"].to_pylist()
            out: list[list] = [[], [], [], []]
            for k, at in enumerate(asking.tolist()):
                fits = (labels[rows] == labels[at]) == same
                if same:
                    fits &= ids[rows] != ids[at]
                fits &= scores[k] >= min(lows[at])
                left, said = rows[fits], scores[k][fits]
                order = np.lexsort((ids[left], ~said))
                left, said = left[order], said[order]
                for number, (lo, hi) in enumerate(zip(lows[at], highs[at])):
                    inside = np.flatnonzero((said >= lo) & (said <= hi))[:wanted]
                    out[0] += [nodes[at]] * inside.size
                    out[1] += [number] * inside.size
                    out[2] += ids[left[inside]].tolist()
                    out[3] += said[inside].tolist()
            if out[0]:
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())]
                arrays += [pa.array(out[2], group.schema.field("id").type), pa.array(out[3], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "number", "other", "score"])

    dealt = _met(visiting, listed).repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = dealt.mapInArrow(run, f"node long, number int, other {kind}, score long")
    order = Window.partitionBy("node", "number").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _certified(asked: DataFrame, listed: DataFrame, sent, wanted: int, same: bool) -> DataFrame:
    """The best of each window, in two passes."""
    windows = F.size("lows")
    first = _best(_visiting(asked, sent, wanted), listed, wanted, same)
    reached = first.where(F.col("rank") == wanted).select("node", "number", "score")
    by_node = reached.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("reached"))
    raised = F.transform(F.col("lows"), lambda lo, i: F.greatest(lo, F.coalesce(F.col("reached")[i], lo)))
    by_node = written(by_node, "reached-scores")
    # At most one row per anchor, with a number for each of its windows.
    again = asked.join(small_side(by_node, text_bytes=16 * F.size("reached")), "node", "left")
    again = again.withColumn("lows", F.when(F.col("reached").isNull(), F.col("lows")).otherwise(raised)).where(windows > 0)
    return _best(_visiting(again.drop("reached"), sent, None), listed, wanted, same)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """For each anchor and each of its positives the best negatives in the positive's window.

    Components are multiplied by ``scale`` and rounded down. ``is_anchor`` is a
    condition on ``id`` and ``label``. The window is in percent of the positive's score.
    Columns: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. Ties go to the smaller id.
    """
    spark = prepare(rows.sparkSession)
    vectors = written(_vectors(rows, id_col, vector_col, label_col, scale), "whole-vectors")
    indexes = _fitted(vectors)
    placed = written(_placed(vectors, spark.sparkContext.broadcast(indexes)), "placed-vectors")
    cells = _complete(indexes, placed)
    sent = spark.sparkContext.broadcast(indexes)

    # Few vectors of a label are one list; the others are listed by cell.
    sizes = placed.groupBy("size").agg(F.count("*").alias("all"))
    labels = placed.groupBy("size", "scope").agg(F.count("*").alias("own")).join(F.broadcast(sizes), "size")
    # The cells of a shelf hold about as many vectors of a label as one of all labels has vectors.
    wide = F.lit(SHELF) * F.pow(F.lit(2), F.floor(F.log2(F.col("all") / F.col("own"))))
    labels = labels.select(
        *("size", "scope", (F.col("own") / F.col("all")).alias("share")),
        *((F.col("own") <= BLOCK).alias("few"), wide.cast("long").alias("width")),
    )
    shelved = placed.drop("near_1", "near_2").join(small_side(cells), ["size", "cell"]).drop("cell")
    known = shelved.join(small_side(written(labels, "labels")), ["size", "scope"])
    shelf = F.when(F.col("few"), F.lit(WHOLE).cast("long")).otherwise(F.expr("before div width"))
    known = known.withColumn("shelf", shelf)
    bound = lambda n: F.array(F.lit(n).cast("long"))
    anchors = known.where(is_anchor).withColumn("lows", bound(LEAST)).withColumn("highs", bound(MOST))
    listed = known.select("node", "id", "label", "scope", "size", "packed", "shelf")
    few = _best(anchors.where("few"), listed.where(F.col("shelf") == WHOLE), positives, same=True)
    many = anchors.where("NOT few").drop("shelf")
    many = _certified(many, listed.where(F.col("shelf") != WHOLE), sent, positives, same=True)
    found = written(few.unionByName(many), "positives")

    # Windows in percent without overflow: the score is 100 * q + r.
    low, high = window
    q, r = "score div 100", "score % 100"
    chosen = found.where("score >= 0").select(
        "node",
        F.col("rank").alias("place"),
        F.expr(f"({q}) * {low} + ({r} * {low} + 99) div 100").alias("lo"),
        F.expr(f"({q}) * {high} + ({r} * {high}) div 100").alias("hi"),
    )
    windows = chosen.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("windows"))
    windows = windows.select("node", F.col("windows.lo").alias("lows"), F.col("windows.hi").alias("highs"))
    everything = shelved.withColumn("scope", F.lit(0).cast("long")).withColumn("width", F.lit(SHELF).cast("long"))
    everything = everything.withColumn("shelf", F.expr("before div width"))
    asked = everything.where(is_anchor).drop("shelf").withColumn("share", F.lit(1.0))
    asked = written(asked.join(small_side(windows, text_bytes=16 * F.size("lows")), "node"), "windows")
    mined = _certified(asked, everything, sent, negatives, same=False)

    # The number of a window is the place of its positive among those of the anchor.
    named = placed.where(is_anchor).select("node", F.col("id").alias("anchor_id"))
    of_window = found.join(named, "node").select(
        *("node", "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")),
        (F.col("rank") - 1).alias("number"),
    )
    return mined.join(of_window, ["node", "number"]).select(
        *("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score"),
        F.col("score").alias("negative_score"),
    )
