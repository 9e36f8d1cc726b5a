"""Token ids of documents as ORC files with row indexes and Bloom filters.

Documents are dealt by ranges of their ids, sorted, encoded, and written one file
a range, so files and rows are in ascending order of ids. ORC stores the ids by
integer run-length encoding in stripes that are read independently of each other:
a large file is read by many tasks. Stripes and groups of ``STRIDE`` rows carry the
least and greatest document id, and Bloom filters of them, so a reader that asks
for some documents skips the rest without reading it.

Columns: the document's id, ``part`` (the number of the file), ``offset`` (ids in
the file before the document), ``n_tokens`` and ``ids``. The place of a document among all ids
follows from the sums of the files before its own: one number a file.

Null and empty texts have the end id only. Null document ids come first. Rows of
one id are ordered by a hash of their texts; repeated rows stand side by side,
however many, and may lie in several files. An empty table gives no rows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editwake.llm.common import prepare
from editwake.llm.encoders import word_encoder
from editwake.plans.layout import small_side

STRIPE_BYTES = 16 * 2**20
STRIDE = 1_000  # rows of a group with its own entry in the row index
FALSE_HITS = 0.01  # of the Bloom filters
SCHEMA = "part int, offset long, n_tokens long, ids array<int>"
COLUMNS = ["part", "offset", "n_tokens", "ids"]


def _as_lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as lists of numbers, without a copy for each."""
    sizes = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(
        pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
    )


def encoded_in_order(
    docs: DataFrame, model_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of the files: ids of all whole texts, each with ``end_id`` at the end, sorted by document."""
    spark = prepare(docs.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encode = word_encoder(sent.value)
        part, offset = TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            packed = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            starts = offset + np.cumsum(sizes) - sizes
            offset += int(sizes.sum())
            columns = [batch.column(0), pa.array(np.full(len(packed), part), pa.int32()), pa.array(starts), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*columns, _as_lists(packed)], [id_col, *COLUMNS])

    text = F.xxhash64(text_col).alias("_text")
    # The row number only deals copies of one row to several tasks.
    dealt = docs.select(id_col, text_col, text, F.monotonically_increasing_id().alias("_row"))
    dealt = dealt.repartitionByRange(id_col, "_text", "_row").sortWithinPartitions(id_col, "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, {SCHEMA}"
    )


def write_tokens(
    docs: DataFrame,
    path: str,
    model_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = STRIPE_BYTES,
) -> None:
    """Write the ids of all documents below ``path``; see the module for the format."""
    rows = encoded_in_order(docs, model_path, end_id, id_col, text_col)
    options = {
        "compression": "zstd",
        "orc.stripe.size": stripe_bytes,
        "orc.create.index": "true",
        "orc.row.index.stride": STRIDE,
        "orc.bloom.filter.columns": id_col,
        "orc.bloom.filter.fpp": FALSE_HITS,
        "maxRecordsPerFile": 0,
    }
    rows.write.options(**options).orc(path)


def read_tokens(
    spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "long", wanted: Column | None = None
) -> DataFrame:
    """The rows of the files; a condition on the document's id skips what indexes and filters rule out."""
    rows = spark.read.schema(f"`{id_col}` {id_type}, {SCHEMA}").orc(path)
    return rows if wanted is None else rows.where(wanted)


def checked(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with ``n_tokens`` and ``ids_crc32``, the checksum of the packed ids, instead of the ids."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            ends = lists.offsets.to_numpy() * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
            columns = [*batch.columns[:3], pa.array(np.diff(ends) // 4, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "part", "offset", "n_tokens", "ids_crc32"])

    schema = f"`{id_col}` {kind}, part int, offset long, n_tokens long, ids_crc32 long"
    return rows.select(id_col, "part", "offset", "ids").mapInArrow(run, schema)


def part_starts(rows: DataFrame) -> DataFrame:
    """How many ids lie in the files before each: one row a file, which one task may add up."""
    totals = rows.groupBy("part").agg(F.max(F.expr("offset + n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))


def token_index(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files, in their order: its place among all ids, its length and checksum."""
    placed = checked(rows, id_col).join(small_side(part_starts(rows)), "part")
    return placed.select(
        id_col, (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
