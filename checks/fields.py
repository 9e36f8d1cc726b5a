"""Derived columns and predicates."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import SQL_BREAKS
from editwake.functions import derive
from editwake.functions import predicates as p
from editwake.functions.text import (
    TEMPLATE_NOTES,
    safe_query_name,
    template_comment_variants,
    template_fragments,
    unescape,
)
from editwake.operators import hits as h
from editwake.operators import templates


@query("SELECT rev_id, md5(added) AS added, md5(removed) AS removed FROM revisions", ("revisions",))
def added_and_removed(v):
    return v.revisions.select("rev_id", F.md5("added").alias("added"), F.md5("removed").alias("removed"))


@query("SELECT rev_id, added_size, removed_size FROM revisions", ("revisions",))
def text_sizes(v):
    return v.revisions.select("rev_id", "added_size", "removed_size")


@query("SELECT action, count(*) AS revisions FROM revisions GROUP BY action", ("revisions",))
def actions_counted(v):
    return v.revisions.groupBy("action").agg(F.count("*").alias("revisions"))


@query("SELECT rev_id, iso FROM revisions", ("revisions",))
def iso_times(v):
    epoch = F.unix_timestamp("timestamp").cast("string")
    return v.revisions.select("rev_id", derive.iso_from_epoch(epoch).alias("iso"))


@query(
    "SELECT rev_id, title, comment_out AS comment, user_text, iso FROM revisions"
    " WHERE contains(added, 'the ')",
    ("revisions",),
)
def hit_fields(v):
    """Fields of hits, header texts unescaped."""
    hits = v.revisions.where(p.phrase("added", "the "))
    wanted = h.select_fields(hits, ["rev_id", "title", "comment", "user_text", "timestamp"])
    return wanted.select(
        "rev_id",
        "title",
        "comment",
        "user_text",
        derive.iso_timestamp(F.col("timestamp")).alias("iso"),
    )


@query(
    """SELECT rev_id, '=HYPERLINK("http://enwp.org/?diff=' || CAST(rev_id AS VARCHAR) || '","'
         || CAST(rev_id AS VARCHAR) || '")' AS link FROM revisions""",
    ("revisions",),
)
def diff_links(v):
    return v.revisions.select("rev_id", derive.hyperlink(F.col("rev_id")).alias("link"))


@query(
    """SELECT rev_id, day, month, day AS day_in_text, 'none' AS month_in_text,
         CASE WHEN minor THEN month ELSE 'none' END AS month_if_minor FROM revisions""",
    ("revisions",),
)
def period_keys(v):
    ts = F.col("timestamp")
    return v.revisions.select(
        "rev_id",
        derive.period_key(ts, "day").alias("day"),
        derive.period_key(ts, "month").alias("month"),
        derive.period_key_of_text(derive.iso_timestamp(ts), "day").alias("day_in_text"),
        derive.period_key_of_text(F.col("title"), "month").alias("month_in_text"),
        derive.period_key(F.when(F.col("minor"), ts), "month").alias("month_if_minor"),
    )


@query(
    """SELECT rev_id, replace(day, '-', '/') AS day, replace(month, '-', '/') || '/15' AS month
       FROM revisions""",
    ("revisions",),
)
def dates_normalised(v):
    ts = F.col("timestamp")
    return v.revisions.select(
        "rev_id",
        derive.normalise_date(derive.period_key(ts, "day")).alias("day"),
        derive.normalise_date(derive.period_key(ts, "month")).alias("month"),
    )


@query(
    "SELECT rev_id FROM revisions WHERE namespace = 4 AND minor AND user_id IS NULL"
    " AND action = 'both'",
    ("revisions",),
)
def term_hits(v):
    """Keyword fields compared whole."""
    tests = [
        p.term("namespace", 4),
        p.term("minor", True),
        p.term("user_id", None),
        p.term("action", "both"),
    ]
    return v.revisions.where(p.all_of(*tests)).select("rev_id")


@query("SELECT rev_id FROM revisions WHERE contains(added, 'ed the ')", ("revisions",))
def phrase_hits(v):
    return v.revisions.where(p.phrase("added", "ed the ")).select("rev_id")


@query(
    "SELECT rev_id FROM revisions WHERE contains(removed, 'tion') AND NOT contains(comment, 'the')",
    ("revisions",),
)
def phrase_in_other_fields(v):
    tests = p.phrase("removed", "tion") & ~p.phrase("comment", "the")
    return v.revisions.where(tests).select("rev_id")


ALL_GRAMS = " AND ".join(f"contains(added, '{g}')" for g in ("ert", "rth", "thl", "hly", "it"))
ANY_GRAM = " OR ".join(f"contains(added, '{g}')" for g in ("que", "uel", "ell", "ció", "ión"))


@query(f"SELECT rev_id FROM revisions WHERE {ALL_GRAMS}", ("revisions",))
def all_grams_hits(v):
    """Unquoted words: all their 3-grams, in any order."""
    return v.revisions.where(p.all_grams("added", "erthly it", 3)).select("rev_id")


@query(f"SELECT rev_id FROM revisions WHERE {ANY_GRAM}", ("revisions",))
def any_gram_hits(v):
    return v.revisions.where(p.any_gram("added", "quell ción", 3)).select("rev_id")


@query(
    "SELECT rev_id FROM revisions WHERE regexp_matches(added, '(?s)the.{0,3}of.{0,3}and')",
    ("revisions",),
)
def near_hits(v):
    """Parts with at most three characters in between."""
    return v.revisions.where(p.near("added", ["the", "of", "and"], 3)).select("rev_id")


@query(
    """SELECT rev_id,
         regexp_matches(added, '(?s)q.x') AS one, regexp_matches(added, '(?s)z..') AS two,
         regexp_matches(added, '(?s)ç.c') AS inner_star, false AS too_long, false AS too_short,
         user_text LIKE 'User1%' AND false AS keyword_text,
         CAST(page_id AS VARCHAR) LIKE '1_' AS keyword, action LIKE '%di%' AS keyword_star
       FROM revisions""",
    ("revisions",),
)
def wildcard_hits(v):
    """Wildcards against 3-grams of text fields and whole keyword values."""
    return v.revisions.select(
        "rev_id",
        p.wildcard("added", "q?x", 3).alias("one"),
        p.wildcard("added", "z*", 3).alias("two"),
        p.wildcard("added", "ç*c", 3).alias("inner_star"),
        p.wildcard("added", "the?", 3).alias("too_long"),
        p.wildcard("added", "t?", 3).alias("too_short"),
        p.wildcard("user_text", "User1*", 3).alias("keyword_text"),
        p.wildcard("page_id", "1?").alias("keyword"),
        p.wildcard("action", "*di*").alias("keyword_star"),
    )


@query(
    """SELECT rev_id, starts_with(action, 'add') AS keyword, starts_with(CAST(page_id AS VARCHAR), '9')
         AS number, regexp_matches(added, '(?s)zz.') AS gram FROM revisions""",
    ("revisions",),
)
def prefix_hits(v):
    return v.revisions.select(
        "rev_id",
        p.prefix("action", "add").alias("keyword"),
        p.prefix("page_id", "9").alias("number"),
        p.prefix("added", "zz", 3).alias("gram"),
    )


@query(
    """SELECT rev_id, iso >= '2006-02' AND iso <= '2006-09' AS months,
         iso >= '2006-02-01T14:00:00Z' AND iso <= '2006-02-03T21:00:00Z' AS instants,
         iso <= '2006-05-01' AS open_start, iso >= '2006-05-01T00' AS open_end,
         iso >= '2006-1' AS irregular FROM revisions""",
    ("revisions",),
)
def time_ranges(v):
    return v.revisions.select(
        "rev_id",
        p.ts_range("2006-02", "2006-09").alias("months"),
        p.ts_range("2006-02-01T14:00:00Z", "2006-02-03T21:00:00Z").alias("instants"),
        p.ts_range("0", "2006-05-01").alias("open_start"),
        p.ts_range("2006-05-01T00", "Z").alias("open_end"),
        p.ts_range("2006-1", None).alias("irregular"),
    )


@query(
    """SELECT rev_id FROM revisions
       WHERE added_size >= 100 AND added_size < 2000 AND page_id > 9 AND page_id <= 80""",
    ("revisions",),
)
def value_ranges(v):
    tests = [
        p.value_range("added_size", 100, 2000, incl_hi=False),
        p.value_range("page_id", 9, 80, incl_lo=False),
    ]
    return v.revisions.where(p.all_of(*tests)).select("rev_id")


@query(
    """SELECT rev_id FROM revisions
       WHERE (contains(added, 'the') OR contains(added, 'que'))
         AND namespace <> 3 AND NOT (contains(removed, 'ed') OR coalesce(user_id = 7, false))""",
    ("revisions",),
)
def boolean_hits(v):
    tests = p.all_of(
        p.any_of(p.phrase("added", "the"), p.phrase("added", "que")),
        p.none_of(p.term("namespace", 3)),
        p.none_of(p.phrase("removed", "ed"), p.term("user_id", 7)),
    )
    return v.revisions.where(tests).select("rev_id")


@query(
    """SELECT rev_id,
         len(list_filter(range(1, greatest(length(title) - 1, 1)),
           lambda i: levenshtein(substr(title, i, 3), 'Pqe') <= 1)) > 0 AS text_field,
         levenshtein(action, 'addition') <= 3 AS keyword FROM revisions""",
    ("revisions",),
)
def fuzzy_hits(v):
    return v.revisions.select(
        "rev_id",
        p.fuzzy("title", "Pqe", 1, 3).alias("text_field"),
        p.fuzzy("action", "addition", 3).alias("keyword"),
    )


@query("SELECT rev_id FROM revisions WHERE action = 'addition'", ("revisions",))
def regexp_keywords(v):
    """On a keyword field the expression must be the whole value."""
    of_whole, of_part = p.regexp("action", "add.*|rem"), p.regexp("action", "both|oth|dditio")
    return v.revisions.where(of_whole & p.none_of(of_part)).select("rev_id")


@query("SELECT rev_id FROM revisions WHERE regexp_matches(added, 'th[aeiou]+ (of|on) ')", ("revisions",))
def regexp_hits(v):
    return v.revisions.where(p.regexp("added", "th[aeiou]+ (of|on) ")).select("rev_id")


@query(
    """SELECT month AS period, count(*) AS hits FROM revisions
       WHERE contains(removed, 'the ') AND iso >= '2006-02' AND iso <= '2006-12' AND namespace = 1
       GROUP BY month""",
    ("revisions",),
)
def removed_phrase_trend(v):
    """A composed question: phrase in removals, time range, namespace."""
    from editwake.plans.search import phrase_trend

    return phrase_trend(
        v.revisions, "the ", "2006-02", "2006-12", namespace=1, field="removed"
    )


@query(
    r"""SELECT rev_id, part, regexp_full_match(part,
           '[0-9]{4}(-((1[0-2]|0?[1-9])(-((3[01]|[12][0-9]|0?[1-9])(T([0-9]{1,2}(:([0-9]{1,2}(:([0-9]{1,2}Z?)?)?)?)?)?)?)?)?)?)?')
         AS valid
       FROM (SELECT rev_id, CASE WHEN rev_id % 7 = 0 THEN replace(iso, '-', '')
             ELSE left(iso, CAST(1 + rev_id % 20 AS INTEGER)) END AS part FROM revisions)
       WHERE part <> ''""",
    ("revisions",),
)
def partial_times(v):
    """Starts of time texts of every length, and texts without dashes."""
    iso = derive.iso_timestamp(F.col("timestamp"))
    rev = F.col("rev_id")
    cut = iso.substr(F.lit(1), (rev % 20 + 1).cast("int"))
    part = F.when(rev % 7 == 0, F.replace(iso, F.lit("-"), F.lit(""))).otherwise(cut)
    return v.revisions.select("rev_id", part.alias("part")).select(
        "rev_id", "part", p.is_partial_datetime(F.col("part")).alias("valid")
    )


@query(
    "SELECT DISTINCT title FROM revisions WHERE namespace = 4 AND starts_with(title, 'Uw-')",
    ("revisions",),
)
def titles_with_prefix(v):
    return templates.title_prefix(v.revisions, 4, "Uw-")


@query("SELECT rev_id, comment_out AS comment FROM revisions", ("revisions",))
def comments_unescaped(v):
    return v.revisions.select("rev_id", unescape(F.col("comment")).alias("comment"))


@query(
    f"""SELECT doc_id, md5(array_to_string(list_filter(
           regexp_split_to_array(regexp_replace(body, '{TEMPLATE_NOTES}', '', 'g'), {SQL_BREAKS}),
           lambda f: length(f) >= 4), chr(9))) AS fragments
       FROM (SELECT doc_id, replace(replace(replace(text, '. ', '{{{{PAGENAME}}}}'), ', ', '{{{{{{1}}}}}}'),
               ' la ', '<noinclude>about' || chr(10) || 'it</noinclude>') || '~~~~' AS body
             FROM documents)"""
)
def fragments_of_wikitext(v):
    """Whole documents as template text, with markup in place of punctuation."""
    body = F.col("text")
    for plain, markup in (
        (". ", "{{PAGENAME}}"),
        (", ", "{{{1}}}"),
        (" la ", "<noinclude>about\nit</noinclude>"),
    ):
        body = F.replace(body, F.lit(plain), F.lit(markup))
    pieces = template_fragments(F.concat(body, F.lit("~~~~")))
    return v.documents.select("doc_id", F.md5(F.array_join(pieces, "\t")).alias("fragments"))


_LOWER = "lower(left(name, 1)) || substr(name, 2)"
_UPPER = "upper(left(name, 1)) || lower(substr(name, 2))"


@query(
    f"""SELECT name, '<!-- Template:' || {_LOWER} || ' -->;<!-- Template:' || {_UPPER}
          || ' -->;<!-- Added using Template:' || {_LOWER} || ' -->;<!-- Added using Template:'
          || {_UPPER} || ' -->' AS comments
        FROM (SELECT DISTINCT 'Uw-' || upper(lang) || source AS name FROM documents)"""
)
def template_comments(v):
    name = F.concat(F.lit("Uw-"), F.upper("lang"), F.col("source"))
    names = v.documents.select(name.alias("name")).distinct()
    comments = template_comment_variants(F.col("name"))
    return names.select("name", F.array_join(comments, ";").alias("comments"))


@query(
    "SELECT doc_id, md5(regexp_replace(text, '[:!<>]', '__', 'g')) AS name FROM documents"
)
def queries_as_names(v):
    return v.documents.select("doc_id", F.md5(safe_query_name(F.col("text"))).alias("name"))
