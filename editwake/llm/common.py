"""What several operators share: sessions, tables, memos and sorted streams of rows."""

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from editwake.session import configure, work_path

# Rows and bytes of an Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 1_000
BATCH_BYTES = 2 * 2**20
# Keys a worker remembers, besides as many older ones, and how long they may be.
MEMO = 60_000
MEMO_KEY = 64


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators count on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that it is computed once and survives executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def release() -> None:
    """Give memory that is no longer used back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(key, build: Callable):
    """What a worker keeps between batches and tasks, for one use at a time.

    Memos of words make up most of a worker's memory. Those of the operator
    that ran before are dropped, so that a pipeline's stages do not add up.
    """
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = build()
    return _HELD[key]


class Memo(dict):
    """The values of a function for the keys that were asked for lately.

    At most ``MEMO`` keys and as many older ones are kept, none longer than
    ``MEMO_KEY``, so the bytes are bounded too. When it is full the keys become
    the older ones; those that are asked for again come back, so words that
    occur often stay.
    """

    def __init__(self, value_of: Callable, entries: int = MEMO):
        self.value_of, self.entries = value_of, entries
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.value_of(key)
            if len(key) > MEMO_KEY:
                return value
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches that are sorted by those keys.

    Only one group is held at a time, however many lie in the partition.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for at, (lo, hi) in enumerate(zip(starts, starts[1:])):
            if held and (at or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
