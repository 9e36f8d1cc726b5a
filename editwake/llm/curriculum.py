"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight, from which follows how many words the whole training
takes of it, and a schedule: a share that rises or falls linearly over the
training time from 0 to 1. The integral of the schedule is the source's
cumulative demand of words. A source's documents come in an order that depends
on a hash of the id alone; the words before a document, repeats included, are
set equal to the demand, and the time at which the demand reaches them is the
document's training position. Rows sorted by position are the training order.

A document is taken whole, as often as the target asks for: all of a source's
documents a whole number of times, and once more as many of the first in order
as come nearest to the target. The words before a document come from three
small steps (words of its place in a bucket, of the buckets before), so that a
source may hold any share of the rows.

Null texts have no words; documents without words are never taken. A source of
null is a source, the last one. Equal rows share their place in the order and
fare alike. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwake.llm.common import prepare, written
from editwake.llm.words import word_count

MOST = 3  # times a document is taken at most
BUCKET_ROWS = 20_000  # rows of a bucket, about
SLOPES = (-0.5, 0.0, 0.5)  # of the schedules, by weight: early, even, late


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: ``source_size``, ``n_rows``, ``weight``, ``target``, ``slope``.

    Sources in code-point order, null last, have the weights in turn. Targets
    share all words by weight, but none is above MOST times its source; the
    excess goes to the others by weight until none is above.
    """
    # One row per source, so that one task may number them.
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    choose = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    sources = written(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        .withColumn("place", place)
        .withColumn("weight", choose(weights))
        .withColumn("slope", choose([SLOPES[i % len(SLOPES)] for i in range(len(weights))]))
        .drop("place"),
        "sources",
    )
    most = F.col("source_size") * MOST
    level = None
    while True:
        above = F.lit(False) if level is None else most < F.lit(level) * F.col("weight")
        found = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        new = (found["all"] - found["full"]) / found["weights"] if found["weights"] else 0.0
        if new == level or not found["weights"]:
            break
        level = new
    target = F.least(most.cast("double"), F.lit(float(level or 0.0)) * F.col("weight"))
    return sources.withColumn("target", target)


def reached(share: Column, slope: Column) -> Column:
    """The time at which a schedule has used up this share of its words.

    The schedule ``1 + slope * (2 * t - 1)`` integrates to
    ``(1 - slope) * t + slope * t ** 2``, which is solved for the time.
    """
    rest = 1 - slope
    curved = (F.sqrt(rest * rest + 4 * slope * share) - rest) / (2 * slope)
    return F.when(slope == 0, share).otherwise(curved)


def places(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per different id, source and size with its place in the order of its source.

    ``n`` counts equal rows, ``words_before`` the source's words before the
    first of them, repeats not included, and ``copies`` how often each is taken.
    """
    most = targets.agg(F.max("n_rows")).first()[0] or 0
    digits = 2
    while 16**digits * BUCKET_ROWS < most:
        digits += 1
    distinct = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    keyed = distinct.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits)).withColumn("words", F.expr("size * n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    buckets = buckets.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("near", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    same_bucket = placed["source"].eqNullSafe(buckets["s"]) & (placed["bucket"] == buckets["b"])
    placed = placed.join(buckets, same_bucket).withColumn("words_before", F.expr("earlier + near"))
    named = targets.withColumnRenamed("source", "s").select("s", "source_size", "target", "slope")
    # One row per source; the source of a place is among them.
    joined = placed.drop("s").join(named, placed["source"].eqNullSafe(named["s"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.expr("target / source_size"))).otherwise(0)
    rest = F.expr("target - whole * source_size")
    once_more = (F.expr("words_before + words / 2") <= rest) & (F.col("whole") < MOST)
    copies = F.when(F.col("size") > 0, F.col("whole") + once_more.cast("int")).otherwise(0)
    return joined.withColumn("whole", whole).select(
        *("id", "source", "size", "n", "source_size", "target", "slope", "words_before"),
        copies.cast("int").alias("copies"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The table of places for documents; see ``places``. Reruns give the same."""
    prepare(docs.sparkSession)
    sizes = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sizes = written(sizes, "sizes")
    return places(sizes, source_targets(sizes, weights))


def positions(mixed: DataFrame) -> DataFrame:
    """One row per document taken and time it is taken, with its ``position``, range-sorted."""
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
    taken = mixed.where("copies > 0").withColumn("copy", copy)
    words = F.expr("words_before + (copy - 1) * source_size")
    share = F.least(F.lit(1.0), words / F.col("target"))
    return taken.withColumn("position", reached(share, F.col("slope"))).orderBy("position", "id", "size", "copy")


def taken_in_order(mixed: DataFrame) -> DataFrame:
    """One row per row of documents with the words ``taken`` of it, in training order.

    The copies are written in the order of their positions and counted from
    there. A document stands at the first position it is taken at, one that is
    not taken at the end.
    """
    keys = ["id", "source", "size"]
    mixed = written(mixed, "places")
    timed = written(positions(mixed).select(*keys, "position"), "training-order")
    found = timed.groupBy(*keys).agg(F.sum("size").alias("taken"), F.min("position").alias("position")).alias("f")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"m.{key}").eqNullSafe(F.col(f"f.{key}"))
    joined = mixed.alias("m").join(found, same, "left").orderBy(F.asc_nulls_last("f.position"), "m.id", "m.size")
    rows = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.n")))
    return joined.select("m.*", F.coalesce("f.taken", F.lit(0)).cast("long").alias("taken"), "f.position", rows).drop("col")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents in training order, each as often as it is taken, with their own columns."""
    timed = positions(mix(docs, weights, id_col, text_col, source_col))
    timed = timed.select("id", F.col("source").alias("s"), "size", "copy", "position").alias("m")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    sized = docs.select(row.alias("row"), word_count(F.col(f"`{text_col}`")).alias("words")).alias("d")
    same = (
        F.col(f"d.row.`{id_col}`").eqNullSafe(F.col("m.id"))
        & F.col(f"d.row.`{source_col}`").eqNullSafe(F.col("m.s"))
        & (F.col("d.words") == F.col("m.size"))
    )
    ordered = sized.join(timed, same).orderBy("m.position", "m.id", "m.copy")
    return ordered.select(*(F.col(f"d.row.`{c}`") for c in docs.columns))
