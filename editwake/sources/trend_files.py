"""Trend files: ``date,count[,id;id;...]`` rows, ``#`` comments."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions import derive

# A fourth column tells which rows have more than three.
_SCHEMA = "date string, hits string, ids string, more string"


def joined_ids(values: Column, as_links: bool = False) -> Column:
    """The revision ids of a list of hits, joined by semicolons."""
    item = derive.hyperlink if as_links else (lambda rev_id: rev_id.cast("string"))
    return F.array_join(F.transform(values, lambda v: item(v.rev_id)), ";")


def trend_rows(trend: DataFrame, as_links: bool = False) -> DataFrame:
    """A trend in the columns of a trend file.

    A packed trend keeps one row per part, so a busy period takes several rows
    with the same date; readers unite them.
    """
    columns = [F.col("period").alias("date"), "hits"]
    if "values" in trend.columns:
        columns.append(joined_ids(F.col("values"), as_links).alias("ids"))
    keep = [c for c in ("output",) if c in trend.columns]
    order = [c for c in ("output", "period", "part") if c in trend.columns]
    return trend.orderBy(*order).select(*keep, *columns)


def write_trend_csv(
    trend: DataFrame, path: str, as_links: bool = False, comments: Sequence[str] = ()
) -> None:
    """Write a trend as CSV in date order, after comment rows (a title, a precision)."""
    rows = trend_rows(trend, as_links)
    if comments:
        marked = [(f"# {text}",) for text in comments]
        notes = trend.sparkSession.createDataFrame(marked, "date string").coalesce(1)
        rows = notes.unionByName(rows, allowMissingColumns=True).select(*rows.columns)
    rows.write.csv(path, escape='"')


def read_trend_csv(
    spark: SparkSession, paths, series: str | None = None, exactly: bool = False
) -> DataFrame:
    """Trend files without comments and without rows that lack the ids.

    A ``#`` anywhere in the first column makes a row a comment. ``series``
    labels all the files, for merging. ``exactly`` leaves out rows with more
    than three columns as well, for the extraction of ids.
    """
    rows = spark.read.schema(_SCHEMA).csv(paths, escape='"')
    label = F.lit(series) if series is not None else F.col("_metadata.file_path")
    kept = ~F.col("date").contains("#") & F.col("ids").isNotNull()
    if exactly:
        kept = kept & F.col("more").isNull()
    return rows.where(kept).select(
        label.alias("series"), "date", F.col("hits").try_cast("bigint").alias("hits"), "ids"
    )


def extract_rev_ids(rows: DataFrame) -> DataFrame:
    """Every item of the ids column shorter than 30 characters, copies kept."""
    items = rows.select(F.explode(F.split("ids", ";")).alias("rev_id"))
    return items.where(F.length("rev_id") < 30)


def write_per_query(trends: DataFrame, path: str, as_links: bool = False) -> None:
    """One folder of CSV per value of the ``output`` column."""
    trend_rows(trends, as_links).write.partitionBy("output").csv(path, escape='"')


def trend_json(
    trend: DataFrame,
    query: Column,
    skipped: Column,
    by: tuple[str, ...] = (),
    request: Column | None = None,
) -> DataFrame:
    """The response to a trend request as one JSON object.

    ``request`` is echoed as ``query``, if given.

    ``hits`` is an array of period and count, one entry per calendar period.
    A packed trend gives one object per part instead, with the field values,
    since a list of all hits has no bound.
    """
    packed = "values" in trend.columns
    keys = [*by, "period", "part"] if packed else list(by)
    entry = ["period", "hits"] + (["values"] if packed else [])
    entries = F.array_sort(F.collect_list(F.struct(*entry)))
    return (
        trend.groupBy(*keys)
        .agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits_all"), entries.alias("hits"))
        .select(
            *keys,
            F.to_json(
                F.struct(
                    "hits_all",
                    query.alias("parsed_query"),
                    skipped.alias("debug_unchecked"),
                    "hits",
                    *([] if request is None else [request.alias("query")]),
                )
            ).alias("response"),
        )
    )
