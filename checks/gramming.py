"""N-grams, hashes and postings."""

import re

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import PART
from editwake.functions import grams as g
from editwake.functions import predicates as p
from editwake.operators import boolean as bs
from editwake.operators import postings as ps
from editwake.operators.trends import first_pass_precision
from editwake.session import work_path
from editwake.sources import revision_table

# Grams are long; lists are compared by digest.
CHARS = "(SELECT doc_id, string_split(text, '') AS c, len(string_split(text, '')) AS n FROM documents)"


@query(
    f"""SELECT doc_id, CAST(greatest(n - 3, 0) AS INTEGER) AS grams,
          md5(coalesce(array_to_string(list_transform(range(1, n - 2),
            lambda i: c[i] || c[i+1] || c[i+2] || c[i+3]), '|'), '')) AS digest
        FROM {CHARS}"""
)
def ngrams_fixed(v):
    listed = v.documents.select("doc_id", g.ngrams(F.col("text"), 4).alias("grams"))
    return listed.select(
        "doc_id", F.size("grams").alias("grams"), F.md5(F.array_join("grams", "|")).alias("digest")
    )


# Of two or three characters, from position i.
GRAM = "CASE l WHEN 2 THEN c[i] || c[i+1] ELSE c[i] || c[i+1] || c[i+2] END"


def ranged_sql(gram: str) -> str:
    """Ranged grams of each document in order, as one digest."""
    return f"""
      SELECT doc_id, md5(coalesce(string_agg({gram}, '|' ORDER BY i, l), '')) AS digest FROM (
        SELECT doc_id, i, l, {GRAM} AS gram FROM (
          SELECT doc_id, c, i, unnest(range(2, 4)) AS l, n FROM (
            SELECT doc_id, c, n, unnest(range(1, n + 1)) AS i FROM {CHARS}))
        WHERE i + l - 1 <= n) RIGHT JOIN (SELECT doc_id FROM documents) USING (doc_id)
      GROUP BY doc_id"""


@query(ranged_sql("gram"))
def ngrams_ranged(v):
    ranged = g.ngrams_range(F.col("text"), 2, 3)
    return v.documents.select("doc_id", F.md5(F.array_join(ranged, "|")).alias("digest"))


@query(
    ranged_sql(
        "gram || '@' || CAST(i - 1 AS VARCHAR) || '-' || CAST(i - 1 + l AS VARCHAR)"
    )
)
def ngrams_with_offsets(v):
    told = g.offsets_text(g.ngram_offsets(F.col("text"), 2, 3))
    return v.documents.select("doc_id", F.md5(F.coalesce(told, F.lit(""))).alias("digest"))


def murmur_sql(gram: str, seed: int) -> str:
    """MurmurHash2 in SQL over a hex text of the UTF-8 bytes."""
    m, mask = 1540483477, 4294967295
    byte = "CAST(('0x' || substr(x, {at} * 2 + 1, 2)) AS BIGINT)"
    word = " + ".join(f"({byte.format(at=f'(b * 4 + {i})')} << {8 * i})" for i in range(4))
    tail = " + ".join(
        f"CASE WHEN z % 4 > {i} THEN {byte.format(at=f'((z // 4) * 4 + {i})')} << {8 * i} ELSE 0 END"
        for i in range(3)
    )

    def times(e: str) -> str:
        return f"((({e}) * {m}) & {mask})"

    mixed = times(f"xor({times('k')}, {times('k')} >> 24)")
    return f"""
      SELECT *, CAST(xor(h2, h2 >> 15) AS BIGINT) AS hash FROM (
        SELECT *, {times('xor(h1, h1 >> 13)')} AS h2 FROM (
          SELECT *, CASE WHEN z % 4 = 0 THEN h0 ELSE {times(f'xor(h0, {tail})')} END AS h1 FROM (
            SELECT *, list_reduce(list_transform(range(0, z // 4), lambda b: {word}),
                lambda h, k: xor({times('h')}, {mixed}), xor(CAST({seed} AS BIGINT), z)) AS h0
            FROM (SELECT *, lower(hex(encode({gram}))) AS x,
                    CAST(octet_length(encode({gram})) AS BIGINT) AS z FROM {{source}}))))"""


WORDS = "(SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents)"


@query(
    "SELECT word, hash FROM (" + murmur_sql("word", 97).replace("{source}", WORDS) + ")"
)
def murmur_hashes(v):
    """MurmurHash2 of every distinct word."""
    words = v.documents.select(F.explode(F.split("text", "[ \n]", -1)).alias("word")).distinct()
    return words.select("word", g.murmur2_32(F.col("word"), 97).alias("hash"))


INT6 = """left(to_base64(unhex(substr(y, 7, 2) || substr(y, 5, 2) || substr(y, 3, 2)
  || substr(y, 1, 2))), 6)"""


def hashable_sql(text: str) -> str:
    """Grams of two or three characters up to the first that overruns the end."""
    return f"""(SELECT doc_id, i, l, {GRAM} AS gram FROM (
      SELECT doc_id, c, n, i, unnest(range(2, least(3, n - i + 1) + 1)) AS l FROM (
        SELECT doc_id, c, n, unnest(range(1, greatest(0, n - 2) + 2)) AS i FROM (
          SELECT doc_id, string_split(t, '') AS c, len(string_split(t, '')) AS n FROM (
            SELECT doc_id,
              regexp_replace({text}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS t
            FROM documents)))))"""


def tokens_sql(grams: str) -> str:
    """The token of each distinct gram."""
    hashed = murmur_sql("gram", 4711).replace("{source}", f"(SELECT DISTINCT gram FROM {grams})")
    return f"""(SELECT gram, {INT6} AS token FROM (
      SELECT gram, lpad(hex(hash), 8, '0') AS y FROM ({hashed})))"""


GRAMS_OF_TEXT = hashable_sql("text")
TITLE = "source || ' ' || lang || ' ' || CAST(doc_id AS VARCHAR) || ' '"
GRAMS_OF_TITLE = hashable_sql(TITLE)


@query(
    f"""SELECT doc_id, string_agg(token, ' ' ORDER BY i, l) AS tokens
        FROM {GRAMS_OF_TITLE} JOIN {tokens_sql(GRAMS_OF_TITLE)} USING (gram) GROUP BY doc_id"""
)
def hashed_ngrams_of_titles(v):
    """Index tokens of short texts, in order."""
    title = F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string"), F.lit(""))
    tokens = g.hashed_ngrams(title, 2, 3, 4711)
    return v.documents.select("doc_id", F.array_join(tokens, " ").alias("tokens"))


@query(
    f"""SELECT token, count(*) AS grams, count(DISTINCT doc_id) AS documents
        FROM {GRAMS_OF_TEXT} JOIN {tokens_sql(GRAMS_OF_TEXT)} USING (gram) GROUP BY token"""
)
def hashed_tokens_of_texts(v):
    """Index tokens of whole texts; equal grams of all texts are hashed once."""
    listed = v.documents.select("doc_id", g.hashable_ngrams(F.col("text"), 2, 3).alias("grams"))
    return ps.token_counts(listed, "doc_id", 4711, 3).select(
        "token", F.col("occurrences").alias("grams"), F.col("keys").alias("documents")
    )


@query("SELECT doc_id, text AS token FROM documents")
def identity_tokens(v):
    return v.documents.select("doc_id", F.explode(g.identity_token(F.col("text"))).alias("token"))


@query(
    f"""SELECT doc_id, CAST(greatest(n - 2, 0) AS BIGINT) AS fixed,
          CAST(greatest(n - 2, 0) + greatest(n - 3, 0) AS BIGINT) AS ranged FROM {CHARS}"""
)
def analyzers_chosen(v):
    """How many tokens the default and a ranged analyzer give."""
    text = F.col("text")
    return v.documents.select(
        "doc_id",
        F.size(g.analyze(text)).cast("bigint").alias("fixed"),
        F.size(g.analyze(text, 3, 4)).cast("bigint").alias("ranged"),
    )


GRAMS = """(SELECT DISTINCT rev_id, c[i] || c[i+1] || c[i+2] AS gram FROM (
  SELECT rev_id, c, unnest(range(1, len(c) - 1)) AS i FROM (
    SELECT rev_id, string_split(added, '') AS c FROM revisions)))"""


@query(f"SELECT gram, count(*) AS revisions FROM {GRAMS} GROUP BY gram", ("revisions",))
def posting_frequencies(v):
    return ps.gram_frequencies(ps.build_postings(v.revisions))


@query("SELECT rev_id FROM revisions WHERE contains(added, 'ion of the')", ("revisions",))
def postings_hits(v):
    found = ps.postings_search(v.revisions, ps.build_postings(v.revisions), "ion of the")
    return found.select("rev_id")


@query("SELECT rev_id FROM revisions WHERE contains(added, 'ion of the')", ("revisions",))
def postings_hits_by_scan(v):
    """Every gram is too frequent for a broadcast of candidates."""
    postings = ps.build_postings(v.revisions)
    found = ps.postings_search(v.revisions, postings, "ion of the", broadcast_ids=1)
    return found.select("rev_id")


@query(
    f"""SELECT rev_id, namespace FROM revisions WHERE contains(added, 'ion of the')
          AND rev_id NOT IN (SELECT rev_id FROM batch)
        UNION ALL SELECT rev_id, namespace FROM batch WHERE contains(added, 'ion of the')
        QUALIFY row_number() OVER (PARTITION BY rev_id ORDER BY seq DESC) = 1""",
    ("batch",),
)
def postings_hits_stored(v):
    """A stored table and its postings, both brought up to date, then searched."""
    table, index = work_path(v.spark, "table"), work_path(v.spark, "postings")
    revision_table.write_revisions(v.revisions, table, width=PART)
    ps.write_postings(ps.build_postings(v.revisions), index, buckets=8)
    revision_table.upsert_table(v.spark, v.upsert_batch, table, ("seq",))
    revision_table.remove_old_states(v.spark, table)
    latest = revision_table.latest_revision(v.upsert_batch, ("seq",))
    ps.append_postings(v.spark, ps.build_postings(latest), index)
    revisions = revision_table.read_revisions(v.spark, table)
    found = ps.postings_search(revisions, v.spark.read.parquet(index), "ion of the")
    return found.select("rev_id", "namespace")


def searched(v, text: str, **options):
    postings = ps.build_postings(v.revisions, **options)
    return ps.postings_search(v.revisions, postings, text).select("rev_id")


@query("SELECT rev_id FROM revisions WHERE contains(added, ' of the ')", ("revisions",))
def postings_hits_hashed(v):
    """Postings of hashed grams of 3 and 4 characters; the phrase has spaces around."""
    return searched(v, " of the ", analyze=g.analyzer(3, 4, 77))


@query("SELECT rev_id FROM revisions WHERE contains(added, 'ion of the')", ("revisions",))
def postings_hits_ranged(v):
    return searched(v, "ion of the", analyze=g.analyzer(3, 4))


@query("SELECT rev_id FROM revisions WHERE contains(added, 'ion of the')", ("revisions",))
def postings_hits_of_four(v):
    return searched(v, "ion of the", n=4)


@query("SELECT rev_id FROM revisions WHERE contains(added, 'ion of the')", ("revisions",))
def postings_hits_with_old_counts(v):
    """The counts are of a tenth of the table: they lack tokens and understate others."""
    postings = ps.build_postings(v.revisions)
    old = ps.gram_frequencies(ps.build_postings(v.revisions.where("rev_id % 10 = 0")))
    found = ps.postings_search(v.revisions, postings, "ion of the", frequencies=old)
    return found.select("rev_id")


TOKENS = g.literal_ngrams("ion of the", 3)


@query(
    f"""SELECT positives, hits_all, CAST(hits_all AS DOUBLE) / positives AS precision FROM (
          SELECT count(*) FILTER ({" AND ".join(f"contains(added, '{x}')" for x in TOKENS)})
                   AS positives,
                 count(*) FILTER (contains(added, 'ion of the')) AS hits_all FROM revisions)""",
    ("revisions",),
)
def postings_precision(v):
    """Share of the gram candidates that really have the phrase."""
    candidates = ps.candidates(ps.build_postings(v.revisions), TOKENS)
    hits = v.revisions.where(p.phrase("added", "ion of the"))
    return first_pass_precision(candidates, hits)


# --- boolean search on postings -----------------------------------------------


def answered(v, ask):
    postings = ps.build_postings(v.revisions)
    return bs.search_postings(v.revisions, postings, ask(postings)).select("rev_id")


@query(
    """SELECT rev_id FROM revisions
       WHERE contains(added, 'ion') AND contains(added, 'the ') AND contains(added, 'and ')""",
    ("revisions",),
)
def postings_with_all(v):
    return answered(v, lambda g: bs.both(*[bs.has_phrase(g, t) for t in ("ion", "the ", "and ")]))


@query(
    "SELECT rev_id FROM revisions WHERE contains(added, 'xan') OR contains(added, 'jeux') OR contains(added, 'über')",
    ("revisions",),
)
def postings_with_any(v):
    return answered(v, lambda g: bs.either(*[bs.has_phrase(g, t) for t in ("xan", "jeux", "über")]))


@query(
    """SELECT rev_id FROM revisions WHERE contains(added, 'den ')
         AND NOT (contains(added, 'the ') OR contains(added, 'ould')) AND namespace <> 3""",
    ("revisions",),
)
def postings_without(v):
    """A negation and a field outside the postings beside what is searched."""

    def ask(g):
        none = bs.without(bs.has_phrase(g, "the "), bs.has_phrase(g, "ould"))
        return bs.both(bs.has_phrase(g, "den "), none, bs.condition(F.col("namespace") != 3))

    return answered(v, ask)


@query(
    """SELECT rev_id FROM revisions WHERE (contains(added, 'th') OR contains(added, 'qu'))
         AND (contains(added, 'tion') OR NOT contains(added, 'the'))""",
    ("revisions",),
)
def postings_without_needs(v):
    """Texts shorter than a gram and a negation need nothing: the question becomes a scan."""

    def ask(g):
        short = bs.either(bs.has_phrase(g, "th"), bs.has_phrase(g, "qu"))
        return bs.both(short, bs.either(bs.has_phrase(g, "tion"), bs.without(bs.has_phrase(g, "the"))))

    return answered(v, ask)


@query(
    "SELECT rev_id FROM revisions WHERE regexp_matches(added, 'the [a-z]+ (and|of the) [^ ]*ion')", ("revisions",)
)
def postings_of_expression(v):
    """The literals of an expression lead to the revisions it is tested on."""
    return answered(v, lambda g: bs.has_match(g, "the [a-z]+ (and|of the) [^ ]*ion"))


@query("SELECT rev_id FROM revisions WHERE regexp_matches(added, '(?s)q.x|z.z')", ("revisions",))
def postings_of_wildcards(v):
    """Wildcards are looked up among the distinct grams."""
    return answered(v, lambda g: bs.either(bs.has_wildcard(g, "q?x"), bs.has_wildcard(g, "z*z")))


@query(
    f"SELECT DISTINCT rev_id FROM {GRAMS} WHERE levenshtein(gram, 'zwe') <= 1", ("revisions",)
)
def postings_of_near_grams(v):
    """Grams within an edit of a text are looked up among the distinct grams."""
    return answered(v, lambda g: bs.has_near_gram(g, "zwe", 1))


@query(
    "SELECT rev_id FROM revisions WHERE contains(added, 'ion of the') OR contains(added, 'ther th')", ("revisions",)
)
def postings_with_any_stored(v):
    """Of stored tables only buckets of the grams and ranges with candidates are read."""
    table, index = work_path(v.spark, "table"), work_path(v.spark, "postings")
    revision_table.write_revisions(v.revisions, table, width=bs.BLOCK_IDS)
    ps.write_postings(ps.build_postings(v.revisions), index, buckets=8)
    postings, revisions = v.spark.read.parquet(index), revision_table.read_revisions(v.spark, table)
    asked = bs.either(bs.has_phrase(postings, "ion of the"), bs.has_phrase(postings, "ther th"))
    found = bs.search_postings(revisions, postings, asked)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    if not re.search(r"PartitionFilters: \[[^\]]*id_range#\d+ (IN|=)", plan):
        raise AssertionError("candidates were meant to prune id ranges")
    return found.select("rev_id")
