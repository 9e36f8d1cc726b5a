"""Building blocks that keep joins and orderings even at any scale.

* a side is broadcast only after a count proved that it is small;
* ranks and leads are computed per bucket of a numeric key plus a small table
  of bucket totals, so no key and no ordering ends up in a single task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwake.session import shared_dir

# What a broadcast side may have at most, in rows and in bytes of its texts.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 * 2**20
# Bare ids are smaller: 16 bytes each once hashed.
BROADCAST_IDS = 10_000_000

# Ids per bucket of an ordering; also the most rows one rank window sorts when
# ids are unique.
RANK_WIDTH = 1_000_000


def step(value: str | Column, width: int) -> Column:
    """The step of a given width a number falls into, by whole-number division."""
    return F.call_function("div", F.col(value) if isinstance(value, str) else value, F.lit(width))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: Column | None = None) -> bool:
    """Whether ``df`` is proven small enough to broadcast.

    Counts all of it, since partial counts are summed evenly, whereas a limit
    would gather rows in one task. ``text_bytes`` is the size of a row's texts,
    for sides that are more than ids and numbers.
    """
    size = F.lit(0) if text_bytes is None else text_bytes
    found = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("bytes"),
    ).first()
    return found["rows"] <= rows and found["bytes"] <= BROADCAST_BYTES


def small_side(
    df: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: Column | None = None
) -> DataFrame:
    """``df`` marked for broadcast if it is proven small, else for a sorted join.

    Unmarked, Spark might broadcast on an estimate that knows nothing of
    generated rows. In the sorted join skewed partitions are split at run time.
    """
    return F.broadcast(df) if fits(df, rows, text_bytes) else df.hint("merge")


def distinct_ids(ids: DataFrame, key: str = "rev_id") -> DataFrame:
    """The ids once each; copies collapse before the shuffle."""
    return ids.select(key).distinct()


def keep_ids(
    df: DataFrame, ids: DataFrame, key: str = "rev_id", rows: int = BROADCAST_IDS
) -> DataFrame:
    """Rows whose key is among ``ids``."""
    return df.join(small_side(distinct_ids(ids, key), rows), key, "left_semi")


def drop_ids(
    df: DataFrame, ids: DataFrame, key: str = "rev_id", rows: int = BROADCAST_IDS
) -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return df.join(small_side(distinct_ids(ids, key), rows), key, "left_anti")


def meet(rows: DataFrame, pairs: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows once for each partner that ``pairs`` gives their key, with the pairs' other columns.

    The pairs are narrow: while there are few the rows stay where they are, else
    both sides are sorted by the key, and rows without a partner are left out.
    Needs the shared folder, as the pairs are computed once.
    """
    shared_dir(rows.sparkSession)
    side = small_side(pairs.withColumnRenamed(key, "_met").checkpoint(), limit)
    return rows.join(side, rows[key].eqNullSafe(side["_met"])).drop("_met")


def _bucket_offsets(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket; the input has one row per group and bucket."""
    before = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return counted.select(
        *by, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )


def with_rank(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    width: int = RANK_WIDTH,
    up_to: int | None = None,
    name: str = "rank",
) -> DataFrame:
    """Number the rows of each group 1, 2, ... by a non-negative integer key.

    The key range is cut into buckets of ``width``. Counting rows per bucket
    gives each bucket its offset; only rows of one bucket are then sorted
    together. With ``up_to`` the buckets past the cut are dropped before
    anything is sorted.
    """
    bucketed = df.withColumn("_bucket", step(order, width))
    counted = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    offsets = _bucket_offsets(counted, by)
    if up_to is not None:
        offsets = offsets.where(F.col("_before") < up_to)
    within = Window.partitionBy(*by, "_bucket").orderBy(order, *ties)
    keys = [*by, "_bucket"]
    matched = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = bucketed.alias("l").join(offsets.alias("r"), matched).select("l.*", "r._before")
    ranked = joined.withColumn(
        name, F.col("_before") + F.row_number().over(within)
    )
    if up_to is not None:
        ranked = ranked.where(F.col(name) <= up_to)
    return ranked.drop("_bucket", "_before")


def with_next(
    df: DataFrame,
    key: str,
    ts: str,
    ties: Sequence[str] = (),
    period: str = "day",
    name: str = "next_ts",
) -> DataFrame:
    """Add the following timestamp of the same key; null on the last row.

    Rows are ordered inside one (key, period) at a time. The first timestamp
    of the key's next period that has any rows comes from the small table of
    period minima. A key with a third of all rows is thus spread over its days.
    """
    bucketed = df.withColumn("_period", F.date_trunc(period, F.col(ts)))
    periods = (
        bucketed.groupBy(key, "_period")
        .agg(F.min(ts).alias("_first"))
        .select(
            key,
            "_period",
            F.lead("_first").over(Window.partitionBy(key).orderBy("_period")).alias("_following"),
        )
    )
    inside = Window.partitionBy(key, "_period").orderBy(ts, *ties)
    return (
        bucketed.withColumn("_inside", F.lead(ts).over(inside))
        .join(periods, [key, "_period"], "left")
        .withColumn(name, F.coalesce("_inside", "_following"))
        .drop("_period", "_inside", "_following")
    )
