"""Session settings and the shared folder for intermediate results."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings the operators count on. UTC because period keys and time
# bounds are UTC text; AQE because it splits skewed join partitions and
# coalesces small ones without a hand-set partition count. Times as numbers have
# minima and maxima in Parquet files, by which row groups are skipped. Arrow batches
# are short, since a text has many times its bytes in grams.
SETTINGS = {
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 * 2**20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where the cluster names none, a local session gets a temporary folder of
    its own; any other session must be configured first, because a folder on
    one machine is lost with that machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="editwake-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/editwake/{name}-{uuid.uuid4().hex}"


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none where there is no folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate results from any store that Spark writes."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes that are planned inside leave no shuffle files behind.

    A write is not run again, but what it shuffled, often all texts of a table,
    would lie on the disks until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
