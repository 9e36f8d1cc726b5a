"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts with the same set of word shingles are one class, found by a digest of
the set. Each class has a signature of minima, and is posted under pairs of
coordinate and value. Two sets that are similar enough agree in at least
``MATCHES`` coordinates (``agreeing`` tells how surely), so in any common order
of all pairs they share one among the first ``COORDINATES - matches + 1``. Only
this prefix is posted, the rare pairs first; the long lists beyond it are
skipped, and their collisions are counted by comparing the signatures. What
agrees often enough is confirmed on the full sets.

A list is not expanded into pairs. Each member is first compared with the
smallest member of its list; this links most copies. What is left are lists
with members that are not connected yet: they are compared in blocks of
bounded size, signatures first, then the sets of those that may be linked, and
a block returns no more links than it has members. Nothing is capped or dropped.

Classes may hold any share of the rows. Null and empty texts have no set and
are linked with nothing. Repeated rows come out as often as they come in; rows
of one id and several texts take part with each. An id of null is kept apart
from the others: it is the smallest of a component only if all ids there are null.
"""

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import Memo, held, prepare, runs, text_bytes, written
from editwake.llm.components import connected
from editwake.plans.layout import keep_ids, small_side

COORDINATES = 64
MISSED = 1e-5  # chance that a pair just at the threshold agrees in too few coordinates
CELLS = 18  # bits of a cell of the table of frequencies: its size is fixed
BLOCK = 256  # members of a list that are compared with each other at once
RANGE = 500_000  # shingles of the sets of a block that are compared at once
KEEPERS = 2_000_000  # ids of documents to keep that are broadcast at most
CHUNK = 8_192  # shingles at a time

RNG = np.random.default_rng(8)
FACTORS = RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORDS = RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HALF = np.uint64(32)


def matches_for(similarity: float, of: int = COORDINATES) -> int:
    """Coordinates in which sets this similar agree, but for a chance of MISSED."""
    missed, matches = (1 - similarity) ** of, 0
    while missed <= MISSED:
        matches += 1
        missed += comb(of, matches) * similarity**matches * (1 - similarity) ** (of - matches)
    return matches


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> HALF)


class Shingler:
    """Sets of hashed word shingles; remembers a bounded number of words."""

    def __init__(self, words: int):
        self.words = words
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        """The distinct shingles of a text, sorted; words are split at ASCII white space."""
        memo = self.memo
        codes = np.array([memo[word] for word in text.lower().split()], dtype=np.uint64)
        if not codes.size:
            return codes
        size = min(self.words, codes.size)
        total = np.full(codes.size - size + 1, size, dtype=np.uint64)
        for i in range(size):
            total = mixed(total * WORDS[i % 8] + codes[i : i + total.size])
        return np.unique(total)


def shingler(words: int) -> Shingler:
    """One for a worker, so that its words are remembered."""
    return held(("shingler", words), lambda: Shingler(words))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set, as 32-bit values."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, shingles.size, CHUNK):
        part = shingles[at : at + CHUNK, None] * FACTORS
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> HALF).astype(np.uint32)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    whole = xxhash.xxh3_128_digest(shingles.tobytes())
    return tuple(np.frombuffer(whole, dtype=np.int64).tolist())


def signatures_of(column: pa.Array) -> np.ndarray:
    """The packed signatures of a batch, one row each."""
    packed = b"".join(column.cast(pa.binary()).to_pylist())
    return np.frombuffer(packed, dtype=np.uint32).reshape(-1, COORDINATES)


def posting_ids(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit number for each coordinate and value; different pairs differ."""
    places = np.arange(COORDINATES, dtype=np.uint64) << HALF
    return mixed(signatures.astype(np.uint64) | places)


def order_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The common order of all pairs: rare cells first, then by the scrambled number."""
    cells = np.minimum(counts[(ids >> np.uint64(64 - CELLS)).astype(np.int64)], 2**20 - 1)
    return (cells.astype(np.int64) << 43) | (ids & np.uint64(2**43 - 1)).astype(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Set size, digest and signature of each row."""

    def run(batches):
        shingles_of = shingler(words)
        for batch in batches:
            sizes, first, second, packed = [], [], [], []
            for text in text_bytes(batch.column(1)):
                found = shingles_of(text)
                a, b = digest(found) if found.size else (None, None)
                sizes.append(found.size)
                first.append(a)
                second.append(b)
                packed.append(signature(found).tobytes() if found.size else None)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64())]
            columns += [pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            columns.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "size", "d1", "d2", "signature"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text_hash long, size long, d1 long, d2 long, signature binary"
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def _cell_counts(classes: DataFrame) -> np.ndarray:
    """How many postings fall into each cell, over all classes.

    The table has 2 ** CELLS numbers at any size of the input. Frequent pairs
    stand out of their cells, which is all that the order needs: it is the same
    for all, so that no collision is lost however well it tells rare from frequent.
    """

    def run(batches):
        total = np.zeros(2**CELLS, dtype=np.int64)
        for batch in batches:
            ids = posting_ids(signatures_of(batch.column(0)))
            cells = (ids.ravel() >> np.uint64(64 - CELLS)).astype(np.int64)
            total += np.bincount(cells, minlength=total.size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(total[full])], ["cell", "n"]
        )

    counted = classes.select("signature").mapInArrow(run, "cell int, n long")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(2**CELLS, dtype=np.int64)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    return total


def _postings(classes: DataFrame, counts, prefix: int) -> DataFrame:
    """The rare prefix of each class: ``posting``, ``node``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = posting_ids(signatures_of(batch.column(1)))
            first = np.argpartition(order_of(ids, counts.value), prefix - 1, axis=1)[:, :prefix]
            chosen = np.take_along_axis(ids, first, axis=1).view(np.int64)
            nodes = np.repeat(batch.column(0).to_numpy(), prefix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.ravel()), pa.array(nodes)], ["posting", "node"]
            )

    return classes.select("node", "signature").mapInArrow(run, "posting long, node long")


def _agreeing_pairs(pairs: DataFrame, classes: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs whose signatures agree often enough and whose sizes allow the similarity."""
    side = classes.select("node", "size", "signature")
    left = side.toDF("a", "size_a", "signature_a")
    right = side.toDF("b", "size_b", "signature_b")
    sized = pairs.join(right, "b").join(left, "a").where(
        100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    )

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = signatures_of(batch.column(2)), signatures_of(batch.column(3))
                enough = (one == two).sum(axis=1) >= matches
                yield batch.select([0, 1]).filter(pa.array(enough))

    return sized.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def _sets(
    docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, nameless: bool
) -> DataFrame:
    """The sets of some classes, made again from one text of each: ``node``, ``shingles``.

    Texts are found by id, or, where all rows of a class have none, by their hash.
    """
    first = nodes.where("first IS NOT NULL").select(F.col("first").alias(id_col)).distinct()
    texts = docs.select(id_col, text_col).join(small_side(first), id_col, "left_semi").select(text_col)
    if nameless:
        hashes = nodes.where("first IS NULL").select("text_hash").distinct()
        others = docs.where(F.col(id_col).isNull()).select(text_col, F.xxhash64(text_col).alias("text_hash"))
        others = others.join(small_side(hashes), "text_hash", "left_semi").dropDuplicates(["text_hash"])
        texts = texts.unionAll(others.select(text_col))

    def run(batches):
        shingles_of = shingler(words)
        for batch in batches:
            found = [shingles_of(text) for text in text_bytes(batch.column(0))]
            digests = [digest(s) for s in found]
            lists = [s.view(np.int64) for s in found]
            columns = [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
            columns.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "shingles"])

    made = texts.mapInArrow(run, "d1 long, d2 long, shingles array<long>")
    wanted = nodes.select("node", "d1", "d2").distinct()
    return made.join(small_side(wanted), ["d1", "d2"]).select("node", "shingles")


def _labels(links: DataFrame) -> DataFrame:
    """A node that each linked node is connected with, in two steps at most."""
    once = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    again = once.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return once.join(again, "up", "left").select("node", F.coalesce("top", "up").alias("label"))


def _blocks(members: DataFrame) -> DataFrame:
    """Give each member of a list the pairs of blocks it belongs to: ``low``, ``high``."""
    blocks = F.ceil(F.col("members") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    return (
        members.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("members") * 0 + blocks - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other", "members")
    )


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a group; one block is compared with itself."""
    block = group["block"].to_numpy()
    low, high = group["low"][0].as_py(), group["high"][0].as_py()
    rows = np.flatnonzero(block == low)
    return rows, (rows if low == high else np.flatnonzero(block == high))


def _possible(members: DataFrame, counts, percent: int, least: int) -> DataFrame:
    """Members of blocks that agree often enough with one that they are not connected with.

    A pair of classes may meet in several lists; it counts in the list of its
    first common pair of coordinate and value alone.
    """
    keys = ["posting", "low", "high"]

    def run(batches):
        for group in runs(batches, keys):
            one, two = _sides(group)
            label, size = group["label"].to_numpy(), group["size"].to_numpy()
            table = signatures_of(group["signature"].combine_chunks())
            ids = posting_ids(table)
            order = order_of(ids, counts.value)
            here = np.int64(group["posting"][0].as_py()).view(np.uint64)
            here = order_of(np.array([here], dtype=np.uint64), counts.value)[0]
            matches = np.zeros((one.size, two.size), dtype=np.uint8)
            earlier = np.zeros(matches.shape, dtype=bool)
            for i in range(COORDINATES):
                same = table[one, i][:, None] == table[two, i]
                matches += same
                before = order[one, i] < here
                if before.any():
                    earlier |= same & before[:, None]
            sizes = 100 * np.minimum(size[one][:, None], size[two])
            fits = sizes >= percent * np.maximum(size[one][:, None], size[two])
            hit = (matches >= least) & ~earlier & fits & (label[one][:, None] != label[two])
            rows = np.union1d(one[hit.any(axis=1)], two[hit.any(axis=0)])
            if rows.size:
                chosen = group.select([*keys, "block", "node", "label"]).take(pa.array(rows))
                yield from chosen.combine_chunks().to_batches()

    schema = "posting long, low long, high long, block long, node long, label long"
    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of bounded 0/1 matrices.

    ``sets`` are sorted. They are cut into ranges of values, so that what is
    held besides them does not depend on how large they are.
    """
    total = np.zeros((len(sets), len(sets)))
    ranges = sum(s.size for s in sets) // RANGE + 1
    edges = [np.uint64(2**64 * i // ranges) for i in range(1, ranges)]
    cuts = np.array([[0, *np.searchsorted(s, edges), s.size] for s in sets])
    for k in range(ranges):
        parts = [s[lo:hi] for s, lo, hi in zip(sets, cuts[:, k], cuts[:, k + 1])]
        rows = np.repeat(np.arange(len(sets)), [p.size for p in parts])
        _, place, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        columns = (np.cumsum(seen > 1) - 1)[place]
        shared = seen[place] > 1
        order = np.argsort(columns[shared], kind="stable")
        rows, columns = rows[shared][order], columns[shared][order]
        for at in range(0, int(columns[-1]) + 1 if columns.size else 0, CHUNK):
            lo, hi = np.searchsorted(columns, [at, at + CHUNK])
            part = np.zeros((len(sets), CHUNK), dtype=np.float32)
            part[rows[lo:hi], columns[lo:hi] - at] = 1
            total += part @ part.T
    return total


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links inside blocks that connect what was not connected: ``a``, ``b``."""
    keys = ["posting", "low", "high"]

    def run(batches):
        for group in runs(batches, keys):
            one, two = _sides(group)
            nodes, label = group["node"].to_numpy(), group["label"].to_numpy()
            sets = [np.asarray(s).view(np.uint64) for s in group["shingles"].to_numpy()]
            sizes = np.array([s.size for s in sets])
            common = _intersections(sets)[np.ix_(one, two)]
            union = sizes[one][:, None] + sizes[two] - common
            linked = (100 * common >= percent * union) & (label[one][:, None] != label[two])
            tops = {int(x): int(x) for x in label}

            def top(x: int) -> int:
                while tops[x] != x:
                    tops[x] = x = tops[tops[x]]
                return x

            found = []
            for i, j in zip(*np.nonzero(linked)):
                x, y = top(int(label[one[i]])), top(int(label[two[j]]))
                if x != y:
                    tops[max(x, y)] = min(x, y)
                    found.append((int(nodes[one[i]]), int(nodes[two[j]])))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"]
                )

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per row: id, hash of the text, set size, smallest id of the component, and whether
    its class is the one that stands for the component."""
    spark = prepare(docs.sparkSession)
    matches = matches_for(percent / 100)
    sketches = written(_sketches(docs, id_col, text_col, words), "sketches")
    classes = written(
        sketches.where("size > 0")
        .groupBy("d1", "d2")
        .agg(
            F.min("id").alias("first"),
            F.min("text_hash").alias("text_hash"),
            F.first("size").alias("size"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    counts = spark.sparkContext.broadcast(_cell_counts(classes))
    postings = written(_postings(classes, counts, COORDINATES - matches + 1), "postings")
    named = classes.select("node", "first", "text_hash", "d1", "d2")
    nameless = not classes.where("first IS NULL").isEmpty()

    lists = postings.groupBy("posting").agg(F.min("node").alias("a"), F.count("*").alias("members"))
    lists = written(lists.where("members > 1"), "lists")
    pairs = (
        postings.join(lists, "posting")
        .where("node != a")
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    pairs = written(_agreeing_pairs(pairs, classes, percent, matches), "pairs")
    ends = [keep_ids(named, pairs.select(F.col(c).alias("node")), "node") for c in ("a", "b")]
    ones, twos = (_sets(docs, end, id_col, text_col, words, nameless) for end in ends)
    both = F.size(F.array_intersect("one", "two"))
    links = (
        twos.toDF("b", "two")
        .join(small_side(pairs), "b")
        .join(ones.toDF("a", "one").hint("merge"), "a")
        .where(100 * both >= percent * (F.size("one") + F.size("two") - both))
        .select("a", "b")
        .distinct()
    )
    links = written(links, "star-links")

    labels = _labels(links)
    open_lists = postings.join(lists.where("members > 2"), "posting").join(labels, "node", "left")
    open_lists = written(
        open_lists.select("posting", "node", "members", F.coalesce("label", "node").alias("label")),
        "open-lists",
    )
    unsettled = (
        open_lists.groupBy("posting")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("posting")
    )
    members = open_lists.join(unsettled, "posting", "left_semi")
    members = members.join(classes.select("node", "size", "signature"), "node")
    possible = written(_possible(_blocks(members), counts, percent, matches), "possible")
    wanted = keep_ids(named, possible, "node")
    sets = _sets(docs, wanted, id_col, text_col, words, nameless)
    more = _block_links(sets.join(small_side(possible), "node"), percent)

    found = connected(links.unionAll(more))
    rooted = classes.join(found, "node", "left").select(
        "node", "d1", "d2", "first", F.coalesce("component", "node").alias("root")
    )
    rooted = written(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root")
    first = named.where(F.col("first").eqNullSafe(F.col("component_id")))
    first = first.groupBy(F.col("root").alias("top")).agg(F.min("node").alias("keeper"))
    of_class = named.join(first, F.col("root") == F.col("top"), "left").select(
        "d1", "d2", "component_id", (F.col("node") == F.col("keeper")).alias("stands")
    )
    return (
        sketches.drop("signature")
        .join(of_class, ["d1", "d2"], "left")
        .select(
            "id",
            "text_hash",
            "size",
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce("stands", F.lit(True)).alias("stands"),
        )
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document with the smallest id of its component.

    Documents are linked when their sets of shingles of ``words`` words, ASCII
    letters in lower case, have ``percent`` of their union in common; a text
    with fewer words is one shingle. Columns: the id, ``n_shingles``,
    ``component_id`` and ``kept`` (whether the id is the smallest).
    """
    return _components(docs, id_col, text_col, words, percent).select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """The documents with one of each component: the one of the smallest id.

    Texts without words are in no component and stay. Of rows that repeat an id
    and a text, one stays.
    """
    found = _components(docs, id_col, text_col, words, percent)
    keeps = F.col("stands") & F.col("id").eqNullSafe(F.col("component_id"))
    keepers = found.where(keeps).groupBy("id", "text_hash")
    keepers = written(keepers.agg(F.count("*").alias("n"), F.max("size").alias("size")), "keepers")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")) & (F.xxhash64(f"d.{text_col}") == F.col("k.text_hash"))
    again = (F.col("n") > 1) & (F.col("size") > 0)

    def rows(which: DataFrame) -> DataFrame:
        side = small_side(which.select("id", "text_hash"), rows=KEEPERS).alias("k")
        return docs.alias("d").join(side, same, "left_semi")

    once = rows(keepers.where(~again))
    if keepers.where(again).isEmpty():
        return once
    return once.unionAll(rows(keepers.where(again)).dropDuplicates([id_col, text_col]))
