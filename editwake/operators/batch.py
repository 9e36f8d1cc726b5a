"""Many saved queries at once, and the cleaning of their terms.

Clauses have a field, a kind (``phrase``, ``term``, ``range``, ``wildcard``,
``prefix`` or ``regexp``), a value or two bounds, and say whether they must,
should or must not hold.
"""

from collections.abc import Collection
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.functions import derive
from editwake.functions.grams import DEFAULT_GRAM, ngrams
from editwake.plans.layout import BROADCAST_BYTES, BROADCAST_ROWS, meet, small_side
from editwake.schema import TEXT_FIELDS
from editwake.session import shared_dir
from editwake.sources.revision_table import in_time, is_stored

# What one constant array of queries without a key may hold; a larger query has one of its own.
CLAUSES_PER_PASS = 10_000
BYTES_PER_PASS = 8 * 2**20

# Fields whose ranges are in number order.
NUMBER_FIELDS = ("rev_id", "page_id", "namespace", "user_id", "added_size", "removed_size")

# Clauses name their field and kind by position, which is quick to look up.
FIELDS = (*TEXT_FIELDS, "timestamp", *NUMBER_FIELDS, "minor", "action")
KINDS = ("phrase", "term", "range", "wildcard", "prefix", "regexp")

# Phrases are found by a word inside them in the long fields, or by a gram where
# they have none; terms by equality in the fields that have many values. Other
# clauses are tested where these lead. Keys name their field by position.
WORD_FIELDS = ("added", "removed")
VALUE_FIELDS = ("rev_id", "page_id", "user_id", "title", "user_text")
KEY_FIELDS = (*WORD_FIELDS, *VALUE_FIELDS)
GRAM_PLACES = len(KEY_FIELDS)  # the word fields again, by gram

# Revisions whose grams tell rare ones from frequent ones. Which gram a phrase is
# found by changes the work, never the outcome.
SAMPLE = 2_000


def _position(name: str, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name)).cast("int") - 1


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()+*?^$|#&-])", r"\\$1")


def _as_regexp(pattern: Column) -> Column:
    """A wildcard as a regular expression for a whole string."""
    literal = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|#&-])", r"\\$1")
    open_ended = F.replace(F.replace(literal, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("(?s)^"), open_ended, F.lit("$"))


def _inner_word() -> Column:
    """The longest word inside a phrase, if there is one of more than two characters.

    It has a space on both sides, so wherever the phrase occurs it is one of
    the words of the text.
    """
    words = F.split("value", " ", -1)
    inside = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    sized = F.transform(inside, lambda w: F.struct(F.length(w).alias("size"), w.alias("word")))
    longest = F.array_max(sized)
    return F.when(longest.size > 2, longest.word)


def _key() -> Column:
    """What a revision must have for a clause to hold, as a place and a text."""
    phrase = (F.col("kind") == "phrase") & F.col("field").isin(*WORD_FIELDS)
    term = (F.col("kind") == "term") & F.col("field").isin(*VALUE_FIELDS)
    text = F.when(phrase, _inner_word()).when(term, F.col("value"))
    place = _position("field", KEY_FIELDS)

    def key(place: Column, text: Column) -> Column:
        return F.struct(place.alias("place"), text.alias("text"))

    gram = F.when(phrase & F.col("gram").isNotNull(), key(place + GRAM_PLACES, F.col("gram")))
    return F.when(text.isNotNull(), key(place, text)).otherwise(gram)


def _with_grams(clauses: DataFrame, revisions: DataFrame | None) -> DataFrame:
    """Clauses with the rarest ``gram`` of each phrase that has no inner word.

    How often grams occur is counted in a bounded sample of the revisions.
    """
    alone = (F.col("kind") == "phrase") & F.col("field").isin(*WORD_FIELDS) & _inner_word().isNull()
    alone = alone & (F.length("value") >= DEFAULT_GRAM)
    if revisions is None:
        return clauses.withColumn("gram", F.lit(None).cast("string"))
    windows = F.explode(F.array_distinct(ngrams(F.col("value"), DEFAULT_GRAM)))
    phrases = clauses.where(alone).select("field", "value").distinct().select("field", "value", windows.alias("gram"))
    # Fields that no such phrase names are not read; there are two at most.
    fields = [r[0] for r in phrases.select("field").distinct().collect()]
    if not fields:
        return clauses.withColumn("gram", F.lit(None).cast("string"))
    picked = revisions.select("rev_id").distinct().orderBy(F.xxhash64("rev_id")).limit(SAMPLE)
    sample = revisions.select("rev_id", *fields).join(F.broadcast(picked), "rev_id")
    seen = [
        sample.select(F.lit(name).alias("field"), F.explode(F.array_distinct(ngrams(F.col(name), DEFAULT_GRAM))).alias("gram"))
        for name in fields
    ]
    counts = reduce(DataFrame.unionAll, seen).groupBy("field", "gram").agg(F.count("*").alias("n"))
    rated = phrases.join(counts, ["field", "gram"], "left")
    rated = rated.groupBy("field", "value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    chosen = rated.select("field", "value", F.lit("phrase").alias("kind"), F.col("best.gram").alias("gram")).checkpoint()
    return clauses.join(small_side(chosen, text_bytes=F.octet_length("value")), ["field", "value", "kind"], "left")


def _with_expressions(clauses: DataFrame, n: int) -> DataFrame:
    """Clauses whose wildcards and prefixes on text fields are an ``expression`` over the whole text.

    A gram has exactly n characters, so what the stars stand for has some number
    of characters in all; there is an alternative for each way to share them out.
    """
    on_text = F.col("field").isin(*TEXT_FIELDS) & F.col("kind").isin("wildcard", "prefix")
    pattern = F.when(F.col("kind") == "prefix", F.concat("value", F.lit("*"))).otherwise(F.col("value"))
    pieces = F.split(pattern, r"\*+", -1)
    slack = F.lit(n) - F.length(F.array_join(pieces, ""))

    def literal(piece: Column) -> Column:
        return F.replace(_literal(piece), F.lit(r"\?"), F.lit("."))

    def way(text: Column, left: Column) -> Column:
        return F.struct(text.alias("text"), left.alias("left"))

    def gap(size: Column) -> Column:
        return F.when(size > 0, F.concat(F.lit(".{"), size.cast("string"), F.lit("}"))).otherwise("")

    def longer(ways: Column, piece: Column) -> Column:
        return F.flatten(
            F.transform(
                ways,
                lambda w: F.transform(
                    F.sequence(F.lit(0), w.left),
                    lambda k: way(F.concat(w.text, gap(k), literal(piece)), w.left - k),
                ),
            )
        )

    first = F.array(way(literal(pieces[0]), slack))
    ways = F.aggregate(F.slice(pieces, 2, F.size(pieces)), first, longer)
    whole = F.transform(F.filter(ways, lambda w: w.left == 0), lambda w: w.text)
    some = F.when((slack >= 0) & (F.size(whole) > 0), F.concat(F.lit("(?s)"), F.array_join(whole, "|")))
    return clauses.withColumn("expression", F.when(on_text, F.coalesce(some, F.lit("(?!)"))))


def compile_queries(
    clauses: DataFrame,
    n: int = DEFAULT_GRAM,
    kinds: Collection[str] = KINDS,
    revisions: DataFrame | None = None,
) -> DataFrame:
    """One row per query, with its must, should and must_not clauses as arrays, and its keys.

    One of the keys is in every revision that the query holds for: the best of
    a must clause, or those of all should clauses where one of these has to
    hold. A query without such keys has none. ``kinds`` are those that occur;
    phrases without an inner word have a gram as key where ``revisions`` are given.
    """
    value = F.col("value")
    regexp = (
        F.when(F.col("expression").isNotNull(), F.col("expression"))
        .when(F.col("kind") == "wildcard", _as_regexp(value))
        .when(F.col("kind") == "prefix", F.concat(F.lit("(?s)^"), _literal(value)))
        .when(
            (F.col("kind") == "regexp") & ~F.col("field").isin(*TEXT_FIELDS),
            F.concat(F.lit(r"\A(?:"), value, F.lit(r")\z")),
        )
    )
    clause = F.struct(
        _position("field", FIELDS).alias("field"),
        _position("kind", KINDS).alias("kind"),
        F.coalesce(regexp, value).alias("value"),
        "lo",
        "hi",
        _key().alias("key"),
    )

    def having(occur: str) -> Column:
        return F.collect_list(F.when(F.col("occur") == occur, clause)).alias(occur)

    if {"wildcard", "prefix"} & set(kinds):
        clauses = _with_expressions(clauses, n)
    else:
        clauses = clauses.withColumn("expression", F.lit(None).cast("string"))
    grouped = _with_grams(clauses, revisions).groupBy("query_id").agg(
        having("must"), having("should"), having("must_not")
    )
    keyed = F.filter("must", lambda c: c.key.isNotNull())
    # The longest text is the least likely to occur.
    best = F.array_max(
        F.transform(keyed, lambda c: F.struct(F.length(c.key.text).alias("size"), c.key.alias("key")))
    )
    by_should = (
        (F.size("must") == 0)
        & (F.size("should") > 0)
        & F.forall("should", lambda c: c.key.isNotNull())
    )
    keys = F.when(F.size(keyed) > 0, F.array(best.key)).when(
        by_should, F.array_distinct(F.transform("should", lambda c: c.key))
    )
    return grouped.withColumn("keys", keys)


def _constant(queries: DataFrame) -> Column:
    """Compiled queries, a bounded number of clauses and bytes, as a constant array."""
    rows = queries.select(F.struct(*queries.columns).alias("query"))
    text = rows.agg(F.to_json(F.collect_list("query")).alias("text")).first()["text"]
    return F.from_json(F.lit(text), f"array<{queries.schema.simpleString()}>")


def _text_of(name: str) -> Column:
    """A field as it is written in a query."""
    if name == "timestamp":
        return derive.iso_timestamp(F.col(name))
    if name == "minor":
        return F.initcap(F.col(name).cast("string"))
    return F.col(name).cast("string")


def _texts(used: set[str]) -> Column:
    """The fields that clauses name, in the places of FIELDS; the others are not read."""
    none = F.lit(None).cast("string")
    return F.array(*[_text_of(name) if name in used else none for name in FIELDS])


def _in_range(clause: Column, value: Column) -> Column:
    """Inclusive; numbers in number order, anything else as text.

    A null bound is open; of a number range, a bound that is no number matches nothing.
    """

    def between(value: Column, read) -> Column:
        above = clause.lo.isNull() | (value >= read(clause.lo))
        return above & (clause.hi.isNull() | (value <= read(clause.hi)))

    numbers = [FIELDS.index(name) for name in NUMBER_FIELDS]
    number = between(value.try_cast("bigint"), lambda bound: bound.try_cast("bigint"))
    return F.when(clause.field.isin(numbers), number).otherwise(between(value, lambda bound: bound))


def _holds(clause: Column, texts: Column) -> Column:
    """Whether a clause is true of the revision; false where its field is null."""
    text = F.get(texts, clause.field)
    kind = {name: KINDS.index(name) for name in KINDS}
    test = (
        F.when(clause.kind == kind["phrase"], text.contains(clause.value))
        .when(clause.kind == kind["term"], text == clause.value)
        .when(clause.kind == kind["range"], _in_range(clause, text))
        .otherwise(F.regexp_like(text, clause.value))
    )
    return F.coalesce(test, F.lit(False))


def _matches(query, texts: Column) -> Column:
    """What must not be is tested last: few queries come that far."""

    def holds(clause: Column) -> Column:
        return _holds(clause, texts)

    must, should, must_not = (query[c] for c in ("must", "should", "must_not"))
    wanted = (F.size(must) > 0) | (F.size(should) == 0) | F.exists(should, holds)
    return F.forall(must, holds) & wanted & ~F.exists(must_not, holds)


def _keys_of(place: int) -> Column:
    """What a revision has that may be a key of a place."""
    name = KEY_FIELDS[place % GRAM_PLACES]
    if place >= GRAM_PLACES:
        found = ngrams(F.col(name), DEFAULT_GRAM)
    elif name in WORD_FIELDS:
        found = F.split(name, " ", -1)
    else:
        found = F.array(_text_of(name))
    keys = F.transform(F.array_distinct(found), lambda t: F.struct(F.lit(place).alias("place"), t.alias("text")))
    return F.coalesce(keys, F.array().cast("array<struct<place:int,text:string>>"))


def _match_keyed(revisions: DataFrame, queries: DataFrame, used: set[str], places: list[int]) -> DataFrame:
    """Queries meet the revisions that have one of their keys, by equality, and are tested there.

    Which may hold where is found on ids, words and values alone; the texts come
    in once, where there is something to test.
    """
    keys = queries.select("query_id", F.explode("keys").alias("key")).select("query_id", "key.place", "key.text")
    words = F.explode(F.concat(*[_keys_of(p) for p in places])).alias("key")
    words = revisions.select("rev_id", words).select("rev_id", "key.place", "key.text")
    pairs = words.join(F.broadcast(keys), ["place", "text"]).select("rev_id", "query_id").distinct()
    met = meet(revisions.select("rev_id", "timestamp", *sorted(used - {"rev_id", "timestamp"})), pairs, "rev_id")
    return (
        met.join(F.broadcast(queries.drop("keys")), "query_id")
        .where(_matches({c: F.col(c) for c in ("must", "should", "must_not")}, _texts(used)))
        .select("query_id", "rev_id", "timestamp")
    )


def _in_period(revisions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Of a stored table the id ranges of the time outside which no query can hold."""
    if not is_stored(revisions):
        return revisions
    timed = (F.col("occur") == "must") & (F.col("field") == "timestamp") & (F.col("kind") == "range")
    bounds = clauses.groupBy("query_id").agg(F.max(F.when(timed, F.col("lo"))).alias("lo"), F.min(F.when(timed, F.col("hi"))).alias("hi"))
    # A query without a bound needs all times on that side.
    start = F.when(F.count_if(F.col("lo").isNull()) == 0, F.min("lo"))
    end = F.when(F.count_if(F.col("hi").isNull()) == 0, F.max("hi"))
    try:
        return in_time(revisions, *bounds.agg(start, end).first())
    except ValueError:
        return revisions  # the clauses compare texts, also with what is no time


def match_saved_queries(
    revisions: DataFrame,
    clauses: DataFrame,
    n: int = DEFAULT_GRAM,
    clauses_per_pass: int = CLAUSES_PER_PASS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each revision with each saved query it satisfies.

    A query holds when all its must clauses do, none of its must_not clauses,
    and at least one should clause unless there are musts or no shoulds.

    Most queries have a key: a word, a gram or a value without which they cannot
    hold. What revisions have of these is joined with the keys by equality, without
    the texts; a query is then tested where it may hold. That is one search for all
    queries as long as they may be broadcast; beyond ``broadcast_rows`` keys, or
    too many bytes, there are several. Queries without a key are a constant array
    that is tested on every revision, cut into passes by clauses and bytes. Only
    the fields that clauses name are read, and of a stored table the id ranges of
    the time that the queries are bounded to, if all are.
    """
    # At most one row per field and kind there is.
    named = clauses.select("field", "kind").distinct().collect()
    used, kinds = {r[0] for r in named}, {r[1] for r in named}
    if used - set(FIELDS):
        raise ValueError(f"no such fields: {sorted(used - set(FIELDS))}")
    if kinds - set(KINDS):
        raise ValueError(f"no such kinds of clauses: {sorted(kinds - set(KINDS))}")
    shared_dir(clauses.sparkSession)
    revisions = _in_period(revisions, clauses)
    compiled = compile_queries(clauses, n, kinds, revisions).checkpoint()
    keyed = compiled.where("keys IS NOT NULL")
    rest = compiled.where("keys IS NULL").drop("keys")
    size = F.length(F.to_json(F.struct("must", "should", "must_not"))).cast("bigint")
    count = F.size("must") + F.size("should") + F.size("must_not")
    matched = []

    measured = keyed.agg(
        F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("keys"),
        F.coalesce(F.sum(size * F.size("keys")), F.lit(0)).alias("bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("keys", lambda k: k.place))))).alias("places"),
    ).first()
    passes = ceil(max(measured["keys"] / broadcast_rows, measured["bytes"] / BROADCAST_BYTES))
    share = F.pmod(F.xxhash64("query_id"), F.lit(max(1, passes)))
    for i in range(passes):
        matched.append(_match_keyed(revisions, keyed.where(share == i), used, measured["places"]))

    measured = rest.agg(
        F.count("*").alias("queries"), F.sum(count).alias("clauses"), F.sum(size).alias("bytes")
    ).first()
    if measured["queries"]:
        passes = ceil(max(measured["clauses"] / clauses_per_pass, measured["bytes"] / BYTES_PER_PASS))
        share = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        for i in range(passes):
            listed = _constant(rest.where(share == i))
            # A transform of one element, so that the texts are prepared once.
            found = F.transform(
                F.array(_texts(used)),
                lambda texts: F.transform(
                    F.filter(listed, lambda q: _matches(q, texts)), lambda q: q.query_id
                ),
            )[0]
            matched.append(revisions.select(F.explode(found).alias("query_id"), "rev_id", "timestamp"))
    if not matched:
        none = F.lit(None).cast(clauses.schema["query_id"].dataType).alias("query_id")
        return revisions.select(none, "rev_id", "timestamp").where(F.lit(False))
    return reduce(DataFrame.unionByName, matched)


def trends_by_query(matches: DataFrame, by: str = "month") -> DataFrame:
    """Hits per saved query and period."""
    period = derive.period_key(F.col("timestamp"), by).alias("period")
    return matches.groupBy("query_id", period).agg(F.count("*").alias("hits"))


# Terms of a group that are gathered in one row have at most so many bytes, and not this character.
GROUP_BYTES = 2**16
_MARK = "\u0001"


def prune_contained_terms(
    terms: DataFrame, by: tuple[str, ...] = ("query_id", "field"), group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Terms that are not inside another term of their group, its last character aside.

    The terms of a group of at most ``group_bytes`` are looked for in one text of
    them all, cut by a mark that none has; only these groups are gathered. In larger
    groups a term of m characters is inside another exactly when it equals one of the
    other's windows of m characters, so there it is an anti-join by equality over the
    windows of the lengths that occur, and terms are never paired up.
    """
    shared_dir(terms.sparkSession)
    whole = reduce(and_, [F.col(c).isNotNull() for c in (*by, "value")])
    sized = terms.where(whole).groupBy(*by).agg(
        F.sum(F.octet_length("value").cast("bigint")).alias("size"), F.max(F.contains("value", F.lit(_MARK))).alias("marked")
    )
    large = sized.where((F.col("size") > group_bytes) | F.col("marked")).select(*by).checkpoint()
    large = small_side(large, text_bytes=F.lit(64))
    cut = F.transform("values", lambda o: F.substr(o, F.lit(1), F.length(o) - 1))
    gathered = (
        terms.where(whole)
        .join(large, list(by), "left_anti")
        .groupBy(*by)
        .agg(F.collect_set("value").alias("values"))
        .select(*by, "values", F.array_join(cut, _MARK).alias("text"))
    )
    kept = F.filter("values", lambda t: (t == "") | ~F.contains(F.col("text"), t))
    kept = gathered.select(*by, F.explode(kept).alias("value"))
    # A row with a null has no partner and stays.
    rest = terms.join(large.withColumn("_large", F.lit(True)), list(by), "left").where(F.col("_large") | ~whole)
    return kept.unionByName(_prune_by_windows(rest.select(*by, "value"), by))


def _prune_by_windows(terms: DataFrame, by: tuple[str, ...]) -> DataFrame:
    distinct = terms.select(*by, "value").distinct()
    lengths = distinct.groupBy(*by).agg(F.collect_set(F.length("value")).alias("lengths"))
    shorter = F.filter("lengths", lambda m: (m > 0) & (m < F.length("value")))
    windows = (
        distinct.join(lengths, list(by))
        .select(*by, "value", F.explode(shorter).alias("m"))
        .select(
            *by,
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.length("value") - F.col("m")),
                    lambda i: F.substring(F.col("value"), i, F.col("m")),
                )
            ).alias("value"),
        )
        .distinct()
    )
    return distinct.join(windows, [*by, "value"], "left_anti")
