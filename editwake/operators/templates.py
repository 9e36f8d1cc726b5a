"""Substituted templates: which revisions carry the text of a template version."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.functions.derive import iso_timestamp
from editwake.functions.text import (
    template_comment_query,
    template_comment_variants,
    template_fragments,
    template_name_variants,
)
from editwake.plans.layout import BROADCAST_ROWS, fits, meet, small_side, with_next
from editwake.session import shared_dir
from editwake.sources.revision_table import in_time, is_stored


def title_prefix(revisions: DataFrame, namespace: int, prefix: str) -> DataFrame:
    """Distinct titles of a namespace that start with a prefix."""
    return (
        revisions.where((F.col("namespace") == namespace) & F.col("title").startswith(prefix))
        .select("title")
        .distinct()
    )


def validity_intervals(history: DataFrame, now: Column) -> DataFrame:
    """From when to when each version of a page was the current one.

    ``history`` has ``title``, ``rev_ts`` and ``text``. An interval ends with
    the next version of the title, the last one with ``now``. Both ends belong
    to it. Versions of the same instant are ordered by their text.
    """
    followed = with_next(history, "title", "rev_ts", ties=("text",))
    return followed.select(
        "title",
        "text",
        F.col("rev_ts").alias("valid_from"),
        F.coalesce("next_ts", now).alias("valid_to"),
    )


def template_intervals(history: DataFrame, now: Column) -> DataFrame:
    """Validity intervals with the literal fragments of each version."""
    return validity_intervals(history, now).select(
        "title", template_fragments(F.col("text")).alias("fragments"), "valid_from", "valid_to"
    )


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def _days(start: Column, end: Column) -> Column:
    days = F.sequence(F.date_trunc("day", start), end, F.expr("interval 1 day"))
    return F.when(start <= end, F.transform(days, _day)).otherwise(_no_keys())


def _interval_keys(start: Column, end: Column) -> Column:
    """The days and whole months that make up an interval, without overlap.

    Months that lie inside are one key each; what is left at either end is
    cut into days. An instant of the interval falls into exactly one of them.
    """
    one_month = F.expr("interval 1 month")
    one_second = F.expr("interval 1 microsecond")
    first_month = F.date_trunc("month", start) + one_month
    last_month = F.date_trunc("month", end)
    whole = F.when(
        first_month < last_month,
        F.transform(F.sequence(first_month, last_month - one_second, one_month), _month),
    ).otherwise(_no_keys())
    same = first_month > last_month
    return F.when(same, _days(start, end)).otherwise(
        F.concat(_days(start, first_month - one_second), whole, _days(last_month, end))
    )


def _longest(fragments: Column) -> Column:
    """The fragment tested first: the longest is the least likely to occur."""
    sized = F.transform(fragments, lambda f: F.struct(F.length(f).alias("size"), f.alias("text")))
    return F.coalesce(F.array_max(sized).text, F.lit(""))


def _inner_word(fragments: Column) -> Column:
    """The longest word inside a fragment, with spaces on both sides; null if there is none."""
    inside = F.flatten(
        F.transform(
            fragments,
            lambda f: F.slice(F.split(f, " ", -1), 2, F.greatest(F.size(F.split(f, " ", -1)) - 2, F.lit(0))),
        )
    )
    sized = F.transform(inside, lambda w: F.struct(F.length(w).alias("size"), w.alias("word")))
    longest = F.array_max(sized)
    return F.when(longest.size > 2, longest.word)


def _holding(joined: DataFrame, field: str) -> DataFrame:
    """Pairs whose time and fragments fit, the cheap tests first."""
    text = F.col(field)
    return (
        joined.where(F.col("timestamp").between(F.col("valid_from"), F.col("valid_to")))
        .where(text.contains(F.col("anchor")))
        .where(F.forall("fragments", lambda f: text.contains(f)))
        .select("title", "valid_from", "valid_to", "rev_id", "timestamp")
    )


def _by_word(revisions: DataFrame, intervals: DataFrame, field: str) -> DataFrame:
    """Revisions meet the intervals of their time that have one of their words inside a fragment.

    Words and times are compared first, without the texts, which come in once.
    """
    words = F.explode(F.array_distinct(F.split(field, " ", -1))).alias("word")
    words = revisions.select("rev_id", "timestamp", words)
    pairs = (
        words.join(F.broadcast(intervals.select("word", "interval", "valid_from", "valid_to")), "word")
        .where(F.col("timestamp").between(F.col("valid_from"), F.col("valid_to")))
        .select("rev_id", "interval")
        .distinct()
    )
    met = meet(revisions.select("rev_id", "timestamp", field), pairs, "rev_id")
    return _holding(met.join(F.broadcast(intervals.drop("word")), "interval"), field)


def _by_time(revisions: DataFrame, intervals: DataFrame, field: str, broadcast_rows: int) -> DataFrame:
    """Revisions meet the intervals of their time."""
    size = F.aggregate("fragments", F.lit(0), lambda total, f: total + F.octet_length(f))
    ts = F.col("timestamp")
    rows = revisions.select("rev_id", "timestamp", field)
    keys = F.explode(_interval_keys(F.col("valid_from"), F.col("valid_to"))).alias("key")
    pieces = intervals.select("*", keys)
    if fits(pieces, broadcast_rows, size):
        dated = rows.withColumn("key", F.explode(F.array(_day(ts), _month(ts))))
        return _holding(dated.join(F.broadcast(pieces), "key"), field)
    months = F.sequence(
        F.date_trunc("month", "valid_from"), F.col("valid_to"), F.expr("interval 1 month")
    )
    whole = intervals.where("valid_from <= valid_to").select(
        "*", F.explode(F.transform(months, _month)).alias("key")
    )
    return _holding(rows.withColumn("key", _month(ts)).join(whole.hint("merge"), "key"), field)


def match_templates(
    revisions: DataFrame,
    intervals: DataFrame,
    allow_empty: bool = False,
    field: str = "added",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each revision with each interval it falls into and whose fragments it has.

    ``intervals`` are those of ``template_intervals``. Intervals without
    fragments match nothing, or with ``allow_empty`` everything in their time.

    An interval with a word inside a fragment is found by that word: the
    revisions' words are joined with it by equality, so what is tested is close
    to what matches. The others are found by their time, an equi-join on day or
    month keys that never overlap: every revision is tested against the version
    of each such title that was current. Few enough intervals are broadcast and
    the texts stay where they are; more are joined by month with both sides
    shuffled once, where skewed months are split at run time.
    """
    wanted = intervals if allow_empty else intervals.where(F.size("fragments") > 0)
    wanted = wanted.select(
        "title",
        "valid_from",
        "valid_to",
        "fragments",
        _longest(F.col("fragments")).alias("anchor"),
        _inner_word(F.col("fragments")).alias("word"),
        F.monotonically_increasing_id().alias("interval"),
    )
    # Taken from whole texts, so made once.
    shared_dir(revisions.sparkSession)
    wanted = wanted.checkpoint()
    if is_stored(revisions):
        last = F.max("valid_to") + F.expr("interval 1 second")
        revisions = in_time(revisions, *wanted.agg(iso_timestamp(F.min("valid_from")), iso_timestamp(last)).first())
    size = F.aggregate("fragments", F.lit(0), lambda total, f: total + F.octet_length(f))
    keyed = wanted.where("word IS NOT NULL")
    if not fits(keyed, broadcast_rows, size):
        return _by_time(revisions, wanted.drop("word", "interval"), field, broadcast_rows)
    rest = wanted.where("word IS NULL").drop("word", "interval")
    by_time = _by_time(revisions, rest, field, broadcast_rows)
    return _by_word(revisions, keyed, field).unionByName(by_time)


def template_comment_queries(names: DataFrame, name: str = "name") -> DataFrame:
    """A query and an output path for each template name; blank lines give none."""
    named = names.where(F.trim(F.col(name)) != "")
    return named.select(F.inline(F.array(template_comment_query(F.col(name)))))


_COMMENT_START = r"<!-- (?:Added using )?Template:"
_COMMENT_END = " -->"


def _mentions(revisions: DataFrame, field: str) -> DataFrame:
    """What follows the start of a template comment, up to the next comment end."""
    # Looked ahead at, so that one comment may begin inside another.
    found = F.regexp_extract_all(
        F.col(field), F.lit(rf"(?s){_COMMENT_START}(?=(.*?){_COMMENT_END})"), F.lit(1)
    )
    return revisions.where(F.col(field).contains("Template:")).withColumn(
        "key", F.explode(F.array_distinct(found))
    )


def match_template_comments(
    revisions: DataFrame,
    names: DataFrame,
    field: str = "added",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs of revision and template name where a comment of the template occurs.

    The names are read out of the comments and joined by equality, without the
    texts; nothing is compared with every name. A name that holds a comment end
    itself, which no title does, is cut there and then looked for in the text.
    """
    named = names.select("name").distinct()
    variants = named.select(
        "name", F.explode(F.array_distinct(template_name_variants(F.col("name")))).alias("variant")
    )
    cut = F.substring_index(F.concat("variant", F.lit(_COMMENT_END)), _COMMENT_END, 1)
    keyed = variants.withColumn("key", cut)
    plain = keyed.where(F.col("key") == F.col("variant")).select("key", "name")
    small = small_side(plain, broadcast_rows, F.octet_length("name") * 2)
    mentions = _mentions(revisions, field)
    pairs = mentions.select("rev_id", "key").join(small, "key").select("rev_id", "name")
    odd = keyed.where(F.col("key") != F.col("variant")).select("key", "name").distinct()
    if not odd.isEmpty():
        occurs = F.exists(
            template_comment_variants(F.col("name")), lambda c: F.col(field).contains(c)
        )
        looked_up = mentions.select("rev_id", field, "key").join(odd, "key").where(occurs)
        pairs = pairs.unionByName(looked_up.select("rev_id", "name"))
    return pairs.distinct()
