"""Trends: hits per day or month, and the merging of several trends."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwake.functions.derive import normalise_date, period_key
from editwake.operators.hits import select_fields
from editwake.plans.layout import step

# Ids per part of a packed trend: about a megabyte of ids in one list.
PART_WIDTH = 100_000


def trend(hits: DataFrame, by: str = "month", ts: str = "timestamp") -> DataFrame:
    """Hits per period, ascending. Counts are partly summed before the shuffle."""
    return order_trend(
        hits.groupBy(period_key(F.col(ts), by).alias("period")).agg(F.count("*").alias("hits"))
    )


def order_trend(trend: DataFrame) -> DataFrame:
    return trend.orderBy("period")


def trend_hits(
    hits: DataFrame, by: str = "month", fields: Sequence[str] = ("rev_id",), ts: str = "timestamp"
) -> DataFrame:
    """One row per hit with its period; nothing is gathered, shuffled or sorted."""
    kept = hits.withColumn("period", period_key(F.col(ts), by))
    names = ["period", "rev_id", *[f for f in fields if f != "rev_id"]]
    return select_fields(kept, names)


def trend_with_fields(
    hits: DataFrame,
    by: str = "month",
    fields: Sequence[str] = ("rev_id",),
    ts: str = "timestamp",
    part_width: int = PART_WIDTH,
) -> DataFrame:
    """Hits per period with the field values of each, as packed parts.

    A period can hold any share of all hits, so its list is cut into parts by
    id range: ``(period, part)`` has at most ``part_width`` revisions. Equal
    rows are carried once with their number of ``copies``; they collapse before
    the shuffle. ``hits`` counts the copies of a part, ``period_hits`` those of
    the whole period, which is the same however many parts it has.
    """
    kept = hits.withColumn("period", period_key(F.col(ts), by))
    names = ["rev_id", *[f for f in fields if f != "rev_id"]]
    rows = (
        select_fields(kept, ["period", *names])
        .groupBy("period", *names)
        .agg(F.count("*").alias("copies"))
    )
    part = step("rev_id", part_width).alias("part")
    values = F.array_sort(F.collect_list(F.struct(*names, "copies"))).alias("values")
    packed = rows.groupBy("period", part).agg(F.sum("copies").alias("hits"), values)
    # From the rows that are shuffled already. One a day or month: bounded by the calendar.
    totals = rows.groupBy("period").agg(F.sum("copies").alias("period_hits"))
    return packed.join(F.broadcast(totals), "period").orderBy("period", "part")


def combine_trends(trends: DataFrame) -> DataFrame:
    """Counts summed per period. A hit on a shared interval end counts twice."""
    return order_trend(trends.groupBy("period").agg(F.sum("hits").alias("hits")))


def combine_trends_distinct(matches: DataFrame, by: str = "month") -> DataFrame:
    """Distinct revisions per period over all matches.

    Copies of a (period, rev_id) pair collapse first, then pairs are counted.
    """
    pairs = matches.select(period_key(F.col("timestamp"), by).alias("period"), "rev_id").distinct()
    return order_trend(pairs.groupBy("period").agg(F.count("*").alias("hits")))


def series_ids(results: DataFrame) -> DataFrame:
    """Rows of trend files as distinct (series, date, rev_id)."""
    return results.select(
        "series",
        normalise_date(F.col("date")).alias("date"),
        F.explode(F.transform(F.split("ids", ";"), lambda i: i.cast("bigint"))).alias("rev_id"),
    ).distinct()


def series_counts(results: DataFrame) -> DataFrame:
    """Distinct revisions per date and series, in long form."""
    return series_ids(results).groupBy("date", "series").agg(F.count("*").alias("hits"))


def merge_series(results: DataFrame, series: Sequence[str]) -> DataFrame:
    """A date by series table of distinct revisions; missing is 0.

    ``series`` names the columns, one per group of input files, in order.
    """
    table = series_counts(results).groupBy("date").pivot("series", list(series)).agg(F.sum("hits"))
    return table.fillna(0, subset=list(series)).orderBy("date")


def series_rank(results: DataFrame) -> DataFrame:
    """Series by their total over all dates, descending, then by name.

    The ranking window sees one row per series, as many as there were inputs.
    """
    totals = series_counts(results).groupBy("series").agg(F.sum("hits").alias("hits"))
    order = Window.orderBy(F.desc("hits"), "series")
    return totals.withColumn("rank", F.row_number().over(order))


def ranked_series(results: DataFrame, series: Sequence[str]) -> list[str]:
    """The given series names in rank order, for the columns of ``merge_series``."""
    ranked = [r["series"] for r in series_rank(results).orderBy("rank").collect()]
    return ranked + [s for s in series if s not in ranked]


def first_pass_precision(
    candidates: DataFrame, hits: DataFrame, unchecked: int = 0
) -> DataFrame:
    """Share of the checked candidates that are hits; null when none was checked."""
    counts = (
        candidates.select(F.lit(1).alias("candidate"), F.lit(0).alias("hit"))
        .unionAll(hits.select(F.lit(0).alias("candidate"), F.lit(1).alias("hit")))
        .agg(
            F.coalesce(F.sum("candidate"), F.lit(0)).alias("positives"),
            F.coalesce(F.sum("hit"), F.lit(0)).alias("hits_all"),
        )
    )
    checked = F.col("positives") - F.lit(unchecked)
    return counts.withColumn(
        "precision", F.when(checked != 0, F.col("hits_all").cast("double") / checked)
    )
