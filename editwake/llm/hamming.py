"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned that turns principal directions into balanced signs with
little error; the signs are a binary code of the vector. Several rotations are
learned from different starts, and their codes are cut into substrings. Each
substring is a table of buckets: vectors whose substrings agree meet there, and
are reranked with the original vectors.

Signs are taken about the mean, so that vectors with a direction in common do not
crowd into few buckets. Two unit vectors at the threshold are a known chord apart,
which centring does not change; the angle between what is left of them is then at
most that of the chord at the shorter of the two. Vectors are therefore dealt into
bands by their centred length. A pair belongs to the band of its shorter vector, and
a vector is posted in each band that may hold a shorter partner. ``tables_for``
tells how many tables of a band lose at most a pair in ``1 / MISSED`` at its least
length. Only the innermost band, of vectors about a chord from the mean, has no such
angle: it is one bucket.

Equal vectors are one class. A bucket is compared in pairs of blocks of bounded
size by matrix products; a pair that meets in several tables counts in the
first. A block returns one count for each vector and no more links than it has
vectors, so a bucket may hold any share of the rows.

Vectors of one label and length are compared; each length has rotations of its own.
These are fitted on ``SAMPLE`` vectors at most in all; all rows are indexed.
Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do rows with a null label. Repeated rows come out as often as they come
in and are copies of each other.
"""

from math import asin, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import prepare, runs, written
from editwake.llm.components import connected
from editwake.plans.layout import small_side

SAMPLE = 20_000  # vectors that the rotations are fitted on
ROUNDS = 30  # alternations of signs and rotation
BLOCK = 1_024  # vectors of a bucket that are compared at once
MISSED = 1e-4  # chance that a pair just at the threshold meets in no table
SHORTEST, LONGEST = 6, 24  # bits of a substring
POSTING = 100  # what posting a vector costs, in comparisons
OUTER, STEP = 0.8, 1.5  # where the outermost band begins, and how bands follow each other inwards
SEED = 4


def tables_for(angle: float, bits: int) -> int:
    """Tables that leave a pair at this angle apart with a chance of MISSED at most.

    Signs of two vectors at an angle differ with the chance angle / pi.
    """
    return int(np.ceil(log(MISSED) / log1p(-((1 - angle / pi) ** bits))))


def bits_for(angle: float, rows: int, size: int) -> int:
    """Bits of a substring with which posting and comparing the rows of a band costs least."""

    def cost(bits: int) -> float:
        return tables_for(angle, bits) * (POSTING + rows / 2**bits)

    return min(range(min(SHORTEST, size), min(LONGEST, size) + 1), key=cost)


def band_edges(threshold: float) -> np.ndarray:
    """Where bands of centred lengths begin, from the innermost, at 0, outwards."""
    chord, edges = sqrt(2 - 2 * threshold), [OUTER]
    while edges[-1] / STEP >= max(chord, 0.05):
        edges.append(edges[-1] / STEP)
    return np.array([0.0, *reversed([e for e in edges if e > chord / 2])])


def learn_rotations(sample: np.ndarray, mean: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` projections of centred vectors, with one column for each bit."""
    centred = sample - mean
    directions = np.linalg.eigh(centred.T @ centred)[1]
    projected = centred @ directions
    rng = np.random.default_rng(seed)
    found = [np.empty((0, *directions.shape))]
    for _ in range(count):
        rotation, _ = np.linalg.qr(rng.standard_normal((mean.size, mean.size)))
        for _ in range(ROUNDS if len(sample) else 0):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(projected.T @ signs)
            rotation = u @ v
        found.append((directions @ rotation)[None])
    return np.concatenate(found)


class Codes:
    """The tables of vectors of one length: mean, rotations, and bits and tables of each band."""

    def __init__(self, sample: np.ndarray, threshold: float, size: int):
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(size)
        self.chord = sqrt(max(0.0, 2 - 2 * threshold))
        self.edges = band_edges(threshold)
        self.tables = [(0, 0)] * len(self.edges)
        self.rotations = np.empty((0, size, size))
        self.sample = sample

    def complete(self, members: dict[int, int]) -> None:
        """Choose bits and tables of the bands by how many vectors they have; learn the rotations."""
        size, wanted = self.mean.size, 0
        for band, rows in members.items():
            self.tables[band] = (0, 1)
            if band:
                angle = 2 * asin(min(1.0, self.chord / (2 * self.edges[band])))
                bits = bits_for(angle, rows, size)
                self.tables[band] = (bits, tables_for(angle, bits))
                wanted = max(wanted, -(-self.tables[band][1] // (size // bits)))
        self.rotations = learn_rotations(self.sample, self.mean, wanted)
        self.sample = None

    def lengths(self, vectors: np.ndarray) -> np.ndarray:
        rest = vectors - self.mean
        return np.sqrt((rest * rest).sum(axis=1))

    def own(self, lengths: np.ndarray) -> np.ndarray:
        """The band of each vector."""
        return np.searchsorted(self.edges, lengths, side="right") - 1

    def posted(self, lengths: np.ndarray, band: int) -> np.ndarray:
        """Which vectors may belong to a pair of the band."""
        upper = self.edges[band + 1] if band + 1 < len(self.edges) else np.inf
        return (lengths >= self.edges[band]) & (lengths - self.chord - 1e-9 < upper)

    def substrings(self, vectors: np.ndarray, band: int, tables: int | None = None) -> np.ndarray:
        """The bucket of each vector in each table of a band, or in the first ``tables``."""
        bits, most = self.tables[band]
        tables = most if tables is None else tables
        out = np.zeros((len(vectors), tables), dtype=np.int64)
        if not bits:
            return out
        per = self.mean.size // bits
        weights = 1 << np.arange(bits, dtype=np.int64)
        centred = vectors - self.mean
        for r in range(-(-tables // per)):
            signs = centred @ self.rotations[r] >= 0
            for t in range(r * per, min(tables, (r + 1) * per)):
                out[:, t] = signs[:, t % per * bits : (t % per + 1) * bits] @ weights
        return out


def matrix(packed: list[bytes], size: int) -> np.ndarray:
    """Packed vectors as rows of doubles of length one."""
    width = len(packed[0]) // max(1, size) if packed else 8
    kind = np.float32 if width == 4 else np.float64
    rows = np.frombuffer(b"".join(packed), dtype=kind).reshape(-1, max(1, size))
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def packed_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Each row with its length and packed vector, or null where it links with nothing."""
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    kind = np.float32 if rows.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64

    def run(batches):
        for batch in batches:
            packed, sizes = [], []
            labelled = batch.column(2).is_valid().to_pylist()
            for values, known in zip(batch.column(1).to_pylist(), labelled):
                found = None
                if known and values and None not in values:
                    vector = np.array(values, dtype=kind)
                    if np.isfinite(vector).all() and vector.any():
                        found = vector.tobytes()
                packed.append(found)
                sizes.append(len(values or ()))
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "size", "packed"])

    return rows.select(id_col, vector_col, label_col).mapInArrow(
        run, f"id {kinds[0]}, label {kinds[1]}, size int, packed binary"
    )


def _by_size(batch: pa.RecordBatch, size: int, packed: int):
    """The vectors of a batch, a length at a time, with their rows."""
    sizes = batch.column(size).to_numpy()
    for one in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == one)
        yield one, at, matrix(batch.column(packed).take(pa.array(at)).cast(pa.binary()).to_pylist(), one)


def _codes(classes: DataFrame, threshold: float) -> dict[int, Codes]:
    """The tables for each length there is: one model a length, whatever the number of rows."""
    sizes = [r["size"] for r in classes.select("size").distinct().collect()]
    sampled = classes.select("size", "packed").orderBy(F.xxhash64("packed", F.lit(SEED))).limit(SAMPLE)
    of_size: dict[int, list[bytes]] = {size: [] for size in sizes}
    for size, packed in sampled.collect():
        of_size[size].append(bytes(packed))
    codes = {
        size: Codes(matrix(packed, size) if packed else np.empty((0, size)), threshold, size)
        for size, packed in of_size.items()
    }
    sent = classes.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        for batch in batches:
            for size, _, vectors in _by_size(batch, 0, 1):
                own = sent.value[size].own(sent.value[size].lengths(vectors))
                bands, counts = np.unique(own, return_counts=True)
                columns = [np.full(len(bands), size, np.int32), bands, counts]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "band", "n"])

    counted = classes.select("size", "packed").mapInArrow(run, "size int, band long, n long")
    members: dict[int, dict[int, int]] = {size: {} for size in sizes}
    for size, band, n in counted.groupBy("size", "band").agg(F.sum("n")).collect():
        members[size][band] = n
    for size in sizes:
        codes[size].complete(members[size])
    return codes


def _posted(classes: DataFrame, index, full: bool) -> DataFrame:
    """Each class under its bucket of each table of its bands, with its vector if ``full``."""
    label = classes.schema["label"].dataType.simpleString()
    kept = ["node", "label", "size", "copies", "packed"][: 5 if full else 3]

    def run(batches):
        for batch in batches:
            for size, at, vectors in _by_size(batch, 2, 4):
                codes = index.value[size]
                lengths = codes.lengths(vectors)
                for band, (_, tables) in enumerate(codes.tables):
                    here = np.flatnonzero(codes.posted(lengths, band))
                    if not tables or not here.size:
                        continue
                    found = codes.substrings(vectors[here], band)
                    rows = pa.array(np.repeat(at[here], tables))
                    columns = [batch.column(i).take(rows) for i in range(len(kept))]
                    columns.append(pa.array(np.full(found.size, band)))
                    columns += [pa.array(np.tile(np.arange(tables), here.size)), pa.array(found.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, [*kept, "band", "number", "bucket"])

    schema = f"node long, label {label}, size int, copies long, packed binary".split(", ")[: len(kept)]
    schema += ["band long", "number long", "bucket long"]
    return classes.select("node", "label", "size", "copies", "packed").mapInArrow(run, ", ".join(schema))


BUCKET = ["label", "size", "band", "number", "bucket"]


def _compared(members: DataFrame, index, threshold: float) -> DataFrame:
    """Partial counts of links of each node, and links that connect the nodes of a block."""
    keys = [*BUCKET, "low", "high"]

    def run(batches):
        for group in runs(batches, keys):
            block = group["block"].to_numpy()
            size, band, number, low, high = (group[c][0].as_py() for c in ("size", "band", "number", "low", "high"))
            one = np.flatnonzero(block == low)
            two = one if low == high else np.flatnonzero(block == high)
            vectors = matrix(group["packed"].to_pylist(), size)
            linked = vectors[one] @ vectors[two].T >= threshold
            if low == high:
                linked &= ~np.eye(one.size, dtype=bool)
            if not linked.any():
                continue
            codes = index.value[size]
            own = codes.own(codes.lengths(vectors))
            linked &= np.minimum(own[one][:, None], own[two]) == band
            earlier = codes.substrings(vectors, band, number)
            for t in range(number):
                linked &= earlier[one, t][:, None] != earlier[two, t]
            nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            counts = np.zeros(nodes.size, dtype=np.int64)
            counts[one] += linked @ copies[two]
            if low != high:
                counts[two] += linked.T @ copies[one]
            # Links that connect: breadth first over the block.
            parent = nodes.copy()
            left, side = {int(x): k for k, x in enumerate(one)}, {int(x): k for k, x in enumerate(two)}
            waiting, seen = set(np.flatnonzero(counts).tolist()), set()
            while waiting:
                queue = [waiting.pop()]
                seen.add(queue[0])
                for at in queue:
                    near = []
                    if at in left:
                        near += two[linked[left[at]]].tolist()
                    if low != high and at in side:
                        near += one[linked[:, side[at]]].tolist()
                    for other in near:
                        if other not in seen:
                            seen.add(other)
                            waiting.discard(other)
                            parent[other] = nodes[at]
                            queue.append(other)
            full = np.flatnonzero(counts)
            if full.size:
                columns = [pa.array(c[full]) for c in (nodes, parent, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "parent", "n"])

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "node long, parent long, n long")


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """One row per vector: the id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label and length are linked from a cosine of ``threshold`` on, in
    double precision. ``n_links`` counts the other rows linked directly.
    """
    spark = prepare(rows.sparkSession)
    vectors = written(packed_vectors(rows, id_col, vector_col, label_col), "vectors")
    classes = written(
        vectors.where("packed IS NOT NULL")
        .groupBy("label", "size", "packed")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    index = spark.sparkContext.broadcast(_codes(classes, threshold))

    narrow = _posted(classes, index, full=False)
    large = narrow.groupBy(*BUCKET).agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / BLOCK)
    members = (
        _posted(classes, index, full=True)
        .join(small_side(written(large, "large-buckets")), BUCKET, "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other", "members")
    )
    found = written(_compared(members, index, threshold), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected(found.where("node != parent").select("node", "parent"))
    rooted = (
        classes.join(components, "node", "left")
        .join(counts, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.join(smallest, "root").select(
        "label",
        "size",
        "packed",
        "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return (
        vectors.join(of_class, ["label", "size", "packed"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
