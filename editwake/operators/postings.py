"""Substring search by n-gram postings: ``(gram, rev_id)`` rows.

The table pays when many searches follow one build. Tokens only narrow the
candidates down, and ``contains`` decides, so a search finds exactly the
revisions that the postings cover and that contain the text.
"""

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions.grams import DEFAULT_GRAM, Analyzer, with_gram_tokens
from editwake.functions.predicates import phrase
from editwake.plans.layout import BROADCAST_IDS, drop_ids, fits, keep_ids, small_side
from editwake.session import shared_dir, shuffles_removed
from editwake.sources.revision_table import id_range, range_width

# How a stored table is divided; the number of its writers follows its size.
BUCKETS = 64
WORD_BITS = 60


def build_postings(
    revisions: DataFrame,
    field: str = "added",
    n: int = DEFAULT_GRAM,
    analyze: Analyzer | None = None,
) -> DataFrame:
    """The distinct tokens of each revision's field; no shuffle.

    Distinctness holds per row, so ``revisions`` should have unique ids, as
    after an upsert. ``analyze`` replaces the fixed n-grams, for example by
    ``analyzer(3, 4, seed)`` for hashed ones. The field and the settings are
    kept with the column of tokens, so that a search analyses its text alike.
    Two grams of a text that share a hash are one posting.
    """
    analyze = analyze or Analyzer(n)
    settings = {"field": field, "n": analyze.n, "n_max": analyze.n_max, "seed": analyze.seed}
    postings = revisions.select(F.explode(analyze.distinct(F.col(field))).alias("gram"), "rev_id")
    return postings.withMetadata("gram", settings)


def gram_bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_postings(
    postings: DataFrame,
    path: str,
    mode: str = "errorifexists",
    buckets: int = BUCKETS,
) -> None:
    """Store postings by bucket of the gram, ordered by gram inside.

    A lookup opens the buckets of its grams and there skips the row groups of
    other grams. The rows are rebalanced by bucket: adaptive execution splits
    large buckets and unites small ones by their bytes, so the number of
    writers follows the input and a gram that occurs everywhere is written by
    several tasks. No sampling pass is needed, as ranges of grams would.
    """
    # The number of buckets goes into the files, so that no reader has to be told.
    marked = postings.withMetadata("gram", {**_settings(postings), "buckets": buckets})
    with shuffles_removed(postings.sparkSession):
        (
            marked.withColumn("bucket", gram_bucket(F.col("gram"), buckets))
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "gram", "rev_id")
            .write.mode(mode)
            .option("compression", "zstd")
            .partitionBy("bucket")
            .parquet(path)
        )


def append_postings(spark: SparkSession, postings: DataFrame, path: str) -> None:
    """Add the postings of new or changed revisions to a stored table.

    Grams of earlier versions stay; they only make more candidates, so a search
    of the revisions as they are now remains exact.
    """
    buckets = _buckets(spark.read.parquet(path))
    if buckets is None:
        raise ValueError("not a stored postings table: its files tell no number of buckets")
    write_postings(postings, path, "append", buckets)


def _settings(postings: DataFrame) -> dict:
    return dict(postings.schema["gram"].metadata or {})


def _buckets(postings: DataFrame) -> int | None:
    return _settings(postings).get("buckets") if "bucket" in postings.columns else None


def _analyzer(postings: DataFrame, field: str, n: int | None) -> Analyzer:
    """What the postings were built with; refuses a search that asks for something else."""
    known = _settings(postings)
    if "n" not in known:
        raise ValueError("not a postings table: its columns tell no analyzer")
    if known["field"] != field:
        raise ValueError(f"these are postings of {known['field']}, not of {field}")
    if n not in (None, known["n"]):
        raise ValueError(f"these postings have grams of {known['n']}, not {n}")
    return Analyzer(known["n"], known["n_max"], known["seed"])


def plain_grams(postings: DataFrame) -> tuple[str, int]:
    """The field and the length of the grams of postings that hold texts; refuses others."""
    known = _settings(postings)
    if "n" not in known:
        raise ValueError("not a postings table: its columns tell no analyzer")
    if Analyzer(known["n"], known["n_max"], known["seed"]).hashed or known["n_max"]:
        raise ValueError("these postings hold no grams of one length as texts")
    return known["field"], known["n"]


def sure_tokens(spark: SparkSession, analyze: Analyzer, text: str) -> list[str]:
    """Tokens that every text with this literal inside has in its postings."""
    grams = analyze.sure_grams(text)
    if not grams or not analyze.hashed:
        return grams
    hashed = F.transform(F.array(*map(F.lit, grams)), analyze.token)
    return list(dict.fromkeys(spark.range(1).select(hashed).first()[0]))


def of_grams(rows: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Rows of the given grams; in a stored table only their buckets are read."""
    wanted = rows.where(F.col("gram").isin(list(tokens)))
    buckets = _buckets(rows)
    if buckets is not None:
        numbers = [gram_bucket(F.lit(t), buckets) for t in tokens]
        wanted = wanted.where(F.col("bucket").isin(numbers))
    return wanted


def gram_frequencies(postings: DataFrame) -> DataFrame:
    """Number of revisions per gram."""
    hashed = _settings(postings).get("seed", -1) >= 0
    counted = F.count_distinct("rev_id") if hashed else F.count("*")
    return postings.groupBy("gram").agg(counted.alias("revisions"))


def _each(listed: DataFrame, *kinds: Column) -> DataFrame:
    """The grams of several lists made of one, with the number of the kind of list."""
    lists = [F.struct(F.lit(i).alias("kind"), grams.alias("grams")) for i, grams in enumerate(kinds)]
    rows = listed.select("*", F.explode(F.array(*lists)).alias("_list"))
    return rows.select("*", F.col("_list.kind").alias("kind"), F.explode("_list.grams").alias("gram"))


def _keys_of(listed: DataFrame, key: str) -> DataFrame:
    """Each gram with the keys that have it, once in a row."""
    return listed.select(key, F.explode(F.array_distinct("grams")).alias("gram"))


def gram_counts(listed: DataFrame, key: str) -> DataFrame:
    """How often each gram occurs in ``grams``, a list in each row, and how many keys have it.

    A key's grams are made distinct in its row, so only counts per gram are
    shuffled. Keys that have several rows are found by bare keys; for them
    alone pairs of key and gram are.
    """
    repeated = listed.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    repeated = repeated.where(F.col(key).isNotNull()).select(key)
    counted = _each(listed, F.col("grams")).groupBy("gram").agg(F.count("*").alias("n"))
    if repeated.isEmpty():
        return (
            _each(listed, F.col("grams"), F.when(F.col(key).isNotNull(), F.array_distinct("grams")))
            .groupBy("gram")
            .agg(F.count_if(F.col("kind") == 0).alias("occurrences"), F.count_if(F.col("kind") == 1).alias("keys"))
        )
    zero = F.lit(0).cast("bigint")
    single = _keys_of(drop_ids(listed.where(F.col(key).isNotNull()), repeated, key), key)
    several = _keys_of(keep_ids(listed, repeated, key), key).distinct()
    had = single.unionByName(several).groupBy("gram").agg(F.count("*").alias("n"))
    parts = counted.select("gram", F.col("n").alias("occurrences"), zero.alias("keys")).unionByName(
        had.select("gram", zero.alias("occurrences"), F.col("n").alias("keys"))
    )
    return parts.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("keys").alias("keys"))


def token_counts(listed: DataFrame, key: str, seed: int, high: int) -> DataFrame:
    """The same of the index tokens of grams of at most ``high`` characters.

    Distinct grams of all rows are hashed once. Grams that share a token are few
    or none: what keys have any of them is counted from their lists again.
    Needs the shared folder, as the grams are counted once.
    """
    shared_dir(listed.sparkSession)
    counted = gram_counts(listed, key).checkpoint()
    tokens = with_gram_tokens(counted.withColumn("token", F.col("gram")), seed, high, "token")
    summed = tokens.groupBy("token").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("keys").alias("keys"), F.count("*").alias("_grams")
    )
    shared = summed.where(F.col("_grams") > 1).select("token")
    if shared.isEmpty():
        return summed.drop("_grams")
    together = tokens.select("gram", "token").join(small_side(shared), "token")
    pairs = _keys_of(listed, key).join(small_side(together), "gram").select("token", key).distinct()
    exact = pairs.groupBy("token").agg(F.count(key).alias("_keys"))
    return summed.join(small_side(exact), "token", "left").select(
        "token", "occurrences", F.coalesce("_keys", "keys").alias("keys")
    )


def _bits(tokens: Sequence[str]) -> dict[str, tuple[str, int]]:
    """The number and the bit in it that stand for each token."""
    return {t: (f"mask{i // WORD_BITS}", 1 << i % WORD_BITS) for i, t in enumerate(tokens)}


def _masks(postings: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Which of the tokens each revision has that has any.

    The tokens are literals, so the filter reaches the Parquet scan. Each token
    is one bit of a number, so postings that occur twice do no harm, and the
    bits of a task's rows are united before the shuffle by id.
    """
    masks = {}
    for token, (name, value) in _bits(tokens).items():
        bit = masks.get(name, F.lit(0).cast("bigint"))
        masks[name] = F.when(F.col("gram") == token, F.lit(value).cast("bigint")).otherwise(bit)
    united = [F.bit_or(bit).alias(name) for name, bit in masks.items()]
    return of_grams(postings, tokens).groupBy("rev_id").agg(*united)


def _having(masks: DataFrame, places: Iterable[tuple[str, int]]) -> DataFrame:
    """Ids of the revisions with all these bits."""
    wanted: dict[str, int] = {}
    for name, value in places:
        wanted[name] = wanted.get(name, 0) | value
    complete = [F.col(name).bitwiseAND(F.lit(value)) == value for name, value in wanted.items()]
    return masks.where(reduce(and_, complete)).select("rev_id")


def candidates(postings: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Ids of the revisions that have every token."""
    return _having(_masks(postings, tokens), _bits(tokens).values())


def postings_search(
    revisions: DataFrame,
    postings: DataFrame,
    text: str,
    field: str = "added",
    n: int | None = None,
    frequencies: DataFrame | None = None,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """Revisions whose field contains ``text``, of those that the postings cover.

    The text is analysed as the postings were; other fields or lengths of grams
    than theirs are refused. The frequency of the rarest token bounds the
    number of candidates before any posting is read. Within the bound, the
    tokens up to it are intersected and the ids broadcast, so no revision text
    is shuffled; of a stored table only the id ranges with candidates are read.
    Beyond the bound, a scan reads less than the join would move, and gives the
    same rows. ``frequencies`` saves counting; they may be older than the
    postings, as only the postings say what does not occur. Postings that are
    not stored are made once for both steps: which tokens each revision has is
    checkpointed in the shared folder, and counted and intersected there.
    """
    tokens = sure_tokens(revisions.sparkSession, _analyzer(postings, field, n), text)
    exact = phrase(field, text)
    if not tokens:
        return revisions.where(exact)
    # At most one row per token of the query text.
    known = {}
    masks, bits = None, _bits(tokens)
    if frequencies is None and _buckets(postings) is None and len(tokens) <= WORD_BITS:
        shared_dir(revisions.sparkSession)
        masks = _masks(postings, tokens).checkpoint()
        had = [F.count_if(F.col(n).bitwiseAND(F.lit(bit)) != 0) for n, bit in bits.values()]
        known = {t: n for t, n in zip(bits, masks.agg(*had).first()) if n}
        if len(known) < len(bits):
            return revisions.where(F.lit(False))
    if frequencies is not None:
        told = frequencies.where(F.col("gram").isin(tokens)).select("gram", "revisions")
        known = dict(told.collect())
    unknown = [t for t in tokens if t not in known]
    if unknown:
        counted = dict(gram_frequencies(of_grams(postings, unknown)).collect())
        if len(counted) < len(unknown):
            return revisions.where(F.lit(False))
        known |= counted
    rare = [t for t in tokens if known[t] <= broadcast_ids]
    if not rare:
        return revisions.where(exact)
    ids = candidates(postings, rare) if masks is None else _having(masks, [bits[t] for t in rare])
    # Counts of another table prove nothing about these candidates.
    if frequencies is not None and not fits(ids, broadcast_ids):
        return revisions.where(exact)
    keys = ["rev_id"]
    width = range_width(revisions)
    if width is not None:
        # Joined on the partition column, the candidates prune partitions.
        kind = revisions.schema["id_range"].dataType
        ids = ids.withColumn("id_range", id_range(width=width).cast(kind))
        keys.append("id_range")
    return revisions.join(F.broadcast(ids), keys, "left_semi").where(exact)
