"""Hits: rows of the revision table that a predicate selected."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwake.functions.text import unescape
from editwake.plans.layout import RANK_WIDTH, small_side, with_rank
from editwake.schema import ESCAPED_FIELDS
from editwake.session import shared_dir

# Up to here a limit is one row-number or top-n step that keeps n rows per task.
SMALL_LIMIT = 1000


def hits_all(hits: DataFrame) -> DataFrame:
    """How many hits there are."""
    return hits.agg(F.count("*").alias("hits_all"))


def select_fields(hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The wanted fields of each hit, header texts without their escapes.

    A text that cannot be unescaped is given as it is stored.
    """
    plain = lambda f: F.coalesce(unescape(F.col(f)), F.col(f)).alias(f)
    return hits.select(*[plain(f) if f in ESCAPED_FIELDS else F.col(f) for f in fields])


def ungrouped(hits: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Hits that are not collapsed: the fields of each, or a bare count."""
    return select_fields(hits, fields) if fields else hits.agg(F.count("*").alias("hits"))


def limit_hits(
    hits: DataFrame,
    max_revs: int,
    order: str = "rev_id",
    width: int = RANK_WIDTH,
    small: int = SMALL_LIMIT,
) -> DataFrame:
    """The first ``max_revs`` hits in ``order``.

    A limit of up to ``small`` is a top-n. A large one would gather n rows of
    every task in one, so the last value within the limit is located on the
    bare ids, by counting per id range; the hits themselves are then filtered
    by it where they are. Of hits with that very value, copies of one id, as
    many stay as the limit leaves room for.
    """
    if max_revs <= small:
        return hits.orderBy(order).limit(max_revs)
    ranked = with_rank(hits.select(order), order, up_to=max_revs, width=width)
    last = ranked.groupBy(order).agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    cut = last.where(F.col("rank") == max_revs).first()
    if cut is None:
        return hits
    value = F.lit(cut[order])
    return hits.where(F.col(order) < value).unionAll(
        hits.where(F.col(order) == value).limit(cut["n"])
    )


def cap_hits(
    hits: DataFrame,
    max_revs: int,
    by: Sequence[str] = ("query_id",),
    order: str = "rev_id",
    width: int = RANK_WIDTH,
    small: int = SMALL_LIMIT,
) -> DataFrame:
    """The first ``max_revs`` hits of each query, with their rank.

    A cap of up to ``small`` is one row-number step: each task keeps that many
    hits of a query before anything is moved, and the hits are found once. A
    large one is located on the bare ids, which are found once and kept, by
    counting per query and id range, so a query that holds most of the hits is
    not sorted in one task; hits beyond the last value of their query are
    dropped where they are, before anything of them is moved.
    """
    if max_revs <= small:
        numbered = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return hits.withColumn("rank", numbered).where(F.col("rank") <= max_revs)
    shared_dir(hits.sparkSession)
    bare = hits.select(*by, order).checkpoint()
    ids = with_rank(bare, order, by, up_to=max_revs, width=width)
    cuts = ids.groupBy(*by).agg(F.max(order).alias("_cut"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]
    within = hits.alias("h").join(
        small_side(cuts).alias("c"), [*same, F.col(f"h.{order}") <= F.col("c._cut")], "left_semi"
    )
    return with_rank(within, order, by, up_to=max_revs, width=width)


def skipped(matches: DataFrame, max_revs: int) -> DataFrame:
    """How many matches lie beyond the cap."""
    beyond = F.greatest(F.count("*") - F.lit(max_revs).cast("bigint"), F.lit(0).cast("bigint"))
    return matches.agg(beyond.alias("skipped"))


def union_hits(*hits: DataFrame, key: str = "rev_id") -> DataFrame:
    """The ids that occur in any of the hit sets."""
    united = hits[0].select(key)
    for other in hits[1:]:
        united = united.unionByName(other.select(key))
    return united.distinct()
