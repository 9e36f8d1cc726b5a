"""Alignment of the tokens of two tokenizers by skipping along diagonals.

Both tokenizers cut the same bytes, so each token has a place where it ends. The
two arrays of ends are compared at the current index shift: stretches in which
each token of one is a token of the other are probed with doubling and then
halving widths, and skipped as one. From a common end on, ends are equal where sizes
are, so the sizes are compared, which are packed in one byte each. Where the ends differ, the irregular group is
walked token by token up to the next common end, and the shift changes to that of
the tokens after it. Inside such a group a link ends wherever a token does.

How many documents hold a pair of ids linked is counted over all. Documents are
worked on in chunks of ``CHUNK_BYTES`` of text; a chunk gives each of its pairs
once, with its number of documents, however many links stand for it. So a pair
that is in every document has one row a chunk. The sums come back to the chunks
by a join on the pair and to the documents by one on the chunk, whose links are
kept packed in a written table. No count passes through the driver.

Null and empty texts, and those whose bytes are not those of a space and the text
with both tokenizers, have no tokens: numbers are 0, the digest is empty. Repeated
rows are documents each. An empty table gives an empty result.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import prepare, written
from editwake.llm.encoders import byte_pieces

CHUNK_BYTES = 4 * 2**20  # of text, after which a chunk ends
FIRST_WIDTH = 4  # of the tokens that are compared at once
HALF = np.int64(32)
MASK = np.int64(2**32 - 1)

Segment = tuple[int, int, int, int, bool]


def align(ends_a: list[int], ends_b: list[int]) -> list[Segment]:
    """Segments of two rows of tokens that end at the same place.

    A segment is the first token and the one after the last of either side, and
    whether it is a stretch of one-to-one groups or one irregular group.
    """
    return align_sizes(*(np.diff(ends, prepend=0).tolist() for ends in (ends_a, ends_b)))


def align_sizes(sizes_a: bytes | list[int], sizes_b: bytes | list[int]) -> list[Segment]:
    """The same from the sizes of the tokens, as lists or packed in bytes."""
    segments: list[Segment] = []
    i = j = 0
    size = len(sizes_a)
    # Marks that differ end the last stretch.
    sizes_a, sizes_b = sizes_a + type(sizes_a)((0,)), sizes_b + type(sizes_b)((1,))
    while i < size:
        start, first_b, width = i, j, FIRST_WIDTH
        while sizes_a[i : i + width] == sizes_b[j : j + width]:
            i, j, width = i + width, j + width, width + width
        while width > 1:
            width //= 2
            if sizes_a[i : i + width] == sizes_b[j : j + width]:
                i, j = i + width, j + width
        if i > start:
            segments.append((start, i, first_b, j, True))
        if i == size:
            break
        start, first_b = i, j
        a, b = sizes_a[i], sizes_b[j]
        while a != b:
            if a < b:
                i += 1
                a += sizes_a[i]
            else:
                j += 1
                b += sizes_b[j]
        i, j = i + 1, j + 1
        segments.append((start, i, first_b, j, False))
    return segments


def links(ends_a: np.ndarray, ends_b: np.ndarray, alone_a: np.ndarray, alone_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of linked tokens inside irregular groups: one link ends where a token of either side does."""
    ends = np.sort(np.concatenate([ends_a[~alone_a], ends_b[~alone_b]]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def groups_of(segments: list[Segment], a: list, b: list) -> list[tuple[list, list]]:
    """The ids of each group, in order."""
    out = []
    for i, to_i, j, to_j, single in segments:
        if single:
            out += [([x], [y]) for x, y in zip(a[i:to_i], b[j:to_j])]
        else:
            out.append((a[i:to_i], b[j:to_j]))
    return out


def marks(segments: list[Segment], size: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a side are a group of their own, and which are the last of their group."""
    irregular = [s for s in segments if not s[4]]
    ends = [s[side + 1] for s in irregular]
    steps = np.zeros(size + 1, dtype=np.int64)
    steps[[s[side] for s in irregular]] += 1
    steps[ends] -= 1
    alone = np.cumsum(steps[:-1]) == 0
    last = alone.copy()
    last[np.array(ends, dtype=np.int64) - 1] = True
    return alone, last


class Aligned:
    """One document: its ids, segments and distinct pairs of linked ids with their numbers of links."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b = a, b
        of_a, of_b = sizes_a.take(a), sizes_b.take(b)
        ends_a, ends_b = np.cumsum(of_a, dtype=np.int64), np.cumsum(of_b, dtype=np.int64)
        packed = of_a.itemsize == of_b.itemsize == 1
        self.segments = align_sizes(*(s.tobytes() if packed else s.tolist() for s in (of_a, of_b)))
        alone_a, self.last_a = marks(self.segments, a.size, 0)
        alone_b, self.last_b = marks(self.segments, b.size, 2)
        linked_a, linked_b = links(ends_a, ends_b, alone_a, alone_b)
        firsts = np.concatenate([a[alone_a], a[linked_a]]).astype(np.int64)
        pairs = (firsts << HALF) | np.concatenate([b[alone_b], b[linked_b]])
        self.n_groups = int(self.last_a.sum())
        self.n_links = pairs.size
        self.pairs, self.links = np.unique(pairs, return_counts=True)

    def digest(self, texts: np.ndarray) -> str:
        """Lowercase hex of the groups, as ``a1,a2|b1;a3|b2,b3`` in decimal numbers.

        ``texts`` are the numbers with a comma, a bar and a semicolon after them, as zero-padded bytes.
        """
        ends_a, ends_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        groups_a, groups_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        said = np.empty(self.a.size + self.b.size, dtype=texts.dtype)
        said[np.arange(self.a.size) + np.concatenate([[0], ends_b])[groups_a]] = texts[self.last_a * 1, self.a]
        said[np.arange(self.b.size) + ends_a[groups_b]] = texts[self.last_b * 2, self.b]
        return hashlib.sha256(said.tobytes().translate(None, b"\0")[:-1]).hexdigest()


class Aligner:
    """Encodes texts with both tokenizers and aligns them."""

    def __init__(self, byte_model: str, piece_model: bytes):
        self.models = byte_pieces(byte_model, piece_model)
        surfaces = self.models.byte_surface, self.models.piece_surface
        sizes = [np.array([len(s) for s in surface]) for surface in surfaces]
        self.sizes = [s.astype(np.min_scalar_type(s.max())) for s in sizes]
        numbers = range(max(map(len, surfaces)))
        self.texts = np.array([[f"{i}{after}".encode() for i in numbers] for after in ",|;"])

    def __call__(self, text: str | None) -> Aligned | None:
        """The aligned document, or None if it has no tokens."""
        if not text:
            return None
        found = self.models.ids(f" {text}")
        return Aligned(*found, *self.sizes) if found else None


def packed_links(places: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending places with their numbers of links, as compressed planes of bytes."""
    numbers = np.concatenate([np.diff(places, prepend=0), links]).astype("<u4")
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed_links`` was given."""
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    half = numbers.size // 2
    return np.cumsum(numbers[:half]), numbers[half:]


def _sent_models(docs: DataFrame, byte_path: str, piece_path: str):
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        return prepare(docs.sparkSession).sparkContext.broadcast((f.read(), g.read()))


def aligned_groups(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: the id and ``groups``, an array of the ids ``a`` and ``b`` of each group."""
    sent = _sent_models(docs, byte_path, piece_path)
    ids = pa.list_(pa.int32())
    item = pa.struct([("a", ids), ("b", ids)])

    def run(batches):
        aligner = Aligner(*sent.value)
        for batch in batches:
            found = [aligner(t) for t in batch.column(1).to_pylist()]
            groups = [
                [{"a": a, "b": b} for a, b in groups_of(d.segments, d.a.tolist(), d.b.tolist())] if d else []
                for d in found
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.list_(item))], [id_col, "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, groups array<struct<a:array<int>,b:array<int>>>"
    )


def _chunks(docs: DataFrame, sent, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Documents with their numbers and packed links; the first of a chunk has all pairs of the chunk."""
    names = ["id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "holders"]

    def rows(chunk: int, ids: list, found: list, digests: list) -> pa.RecordBatch:
        of_docs = [d.pairs for d in found if d]
        pairs, holders = np.unique(np.concatenate([np.empty(0, np.int64), *of_docs]), return_counts=True)
        links = [packed_links(np.searchsorted(pairs, d.pairs), d.links) if d else None for d in found]
        numbers = [[(d.a.size, d.b.size, d.n_groups, d.n_links)[i] if d else 0 for d in found] for i in range(4)]
        listed = [[v if i == 0 else None for i in range(len(found))] for v in (pairs, holders)]
        columns = [pa.concat_arrays(ids), pa.array([chunk] * len(found), pa.int64())]
        columns += [pa.array(n, pa.int64()) for n in numbers]
        columns += [pa.array(digests, pa.string()), pa.array(links, pa.binary())]
        columns += [pa.array(v, pa.list_(pa.int64())) for v in listed]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        aligner = Aligner(*sent.value)
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        found: list = []
        digests: list[str] = []
        size = 0
        for batch in batches:
            for at, text in enumerate(batch.column(1).to_pylist()):
                aligned = aligner(text)
                ids.append(batch.column(0).slice(at, 1))
                digests.append(aligned.digest(aligner.texts) if aligned else "")
                found.append(aligned)
                size += len(text or "")
                if size >= chunk_bytes:
                    yield rows(chunk, ids, found, digests)
                    chunk, ids, found, digests, size = chunk + 1, [], [], [], 0
        if found:
            yield rows(chunk, ids, found, digests)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema += ", links binary, pairs array<long>, holders array<long>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(posted: DataFrame) -> DataFrame:
    """``pair``, its ``count`` of documents, and whether it is the ``best`` of its first id, ties included."""
    counts = posted.groupBy("pair").agg(F.sum("holders").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _summed(id_col: str):
    """For a chunk: its documents with the counts of their links."""

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted["pair"].to_numpy())
        counts = counted["count"].to_numpy()[order]
        best = counted["best"].to_numpy()[order]
        sums, bests = [], []
        for packed in docs["links"].to_pylist():
            places, links = unpacked_links(packed) if packed else (np.empty(0, np.int64),) * 2
            sums.append(int(counts[places] @ links))
            bests.append(int(links[best[places]].sum()))
        kept = ["n_a", "n_b", "n_groups", "n_links"]
        columns = [docs["id"], *(docs[c] for c in kept), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())]
        return pa.table([*columns, docs["groups_sha256"]], [id_col, *kept, "n_best", "count_sum", "groups_sha256"])

    return run


def alignments(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, and what its links count.

    ``n_best`` counts the links whose pair is in as many documents as any of the
    same id of the first tokenizer, ``count_sum`` adds up the documents that hold
    the pair of each link. ``groups_sha256`` is the digest of the groups.
    """
    sent = _sent_models(docs, byte_path, piece_path)
    found = written(_chunks(docs, sent, id_col, text_col, chunk_bytes), "aligned")
    posted = found.where("pairs IS NOT NULL").select("chunk", F.inline(F.arrays_zip("pairs", "holders")))
    posted = posted.toDF("chunk", "pair", "holders")
    counted = posted.select("chunk", "pair").join(pair_counts(posted), "pair")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = found.drop("pairs", "holders").groupBy("chunk").cogroup(counted.groupBy("chunk"))
    return rows.applyInArrow(_summed(id_col), schema)
