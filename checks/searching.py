"""Hits, trends and the merging of trends."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import PART
from editwake.functions import predicates as p
from editwake.operators import hits as h
from editwake.operators import trends as t
from editwake.plans.search import phrase_trend, search
from editwake.session import work_path
from editwake.sources import revision_table
from editwake.sources.trend_files import extract_rev_ids, read_trend_csv

THE = "contains(added, 'the ')"


def the_hits(v):
    return v.revisions.where(p.phrase("added", "the "))


@query(
    f"""SELECT month AS period, count(*) AS hits FROM revisions
        WHERE {THE} AND iso >= '2006-02' AND iso <= '2006-09' GROUP BY month""",
    ("revisions",),
)
def phrase_trend_by_month(v):
    return phrase_trend(v.revisions, "the ", "2006-02", "2006-09")


@query(f"SELECT day AS period, count(*) AS hits FROM revisions WHERE {THE} GROUP BY day", ("revisions",))
def phrase_trend_by_day(v):
    return phrase_trend(v.revisions, "the ", daily=True)


@query(
    f"""SELECT month AS period, count(*) AS hits FROM revisions
        WHERE {THE} AND iso >= '2006-02' AND iso <= '2006-03-15T10:00:00Z' GROUP BY month""",
    ("revisions",),
)
def phrase_trend_of_ranges(v):
    """Of a stored table only the id ranges of the time are read, as the manifest tells."""
    path = work_path(v.spark, "table")
    revision_table.write_revisions(v.revisions, path, width=20)
    table = revision_table.read_revisions(v.spark, path)
    found = phrase_trend(table, "the ", "2006-02", "2006-03-15T10:00:00Z")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    if "PartitionFilters: [id_range" not in plan:
        raise AssertionError("no range was left out")
    return found


@query(
    "SELECT month AS period, count(*) AS hits FROM revisions WHERE added_size = 0"
    " OR NOT regexp_matches(added, '(?s)\\. [A-Z]') GROUP BY month",
    ("revisions",),
)
def predicate_trend(v):
    """A trend of a composed predicate instead of a phrase."""
    tests = p.any_of(p.term("added_size", 0), p.none_of(p.regexp("added", r"(?s)\. [A-Z]")))
    return phrase_trend(v.revisions, tests)


@query(f"SELECT count(*) AS hits_all FROM revisions WHERE {THE}", ("revisions",))
def hits_counted(v):
    return h.hits_all(the_hits(v))


VALUES = "string_agg(CAST(rev_id AS VARCHAR) || '/' || user_text, ';' ORDER BY rev_id)"


@query(
    f"""SELECT month AS period, rev_id // {PART} AS part, count(*) AS hits, {VALUES} AS vals,
          sum(count(*)) OVER (PARTITION BY month)::BIGINT AS period_hits
        FROM revisions WHERE {THE} GROUP BY month, rev_id // {PART}""",
    ("revisions",),
)
def trend_with_values(v):
    """Field values per month, in parts of bounded size."""
    packed = t.trend_with_fields(the_hits(v), "month", ["rev_id", "user_text"], part_width=PART)
    return packed.select("period", "part", "hits", "period_hits", joined("values"))


def joined(values: str):
    pairs = F.transform(
        values, lambda x: F.concat(x.rev_id.cast("string"), F.lit("/"), x.user_text)
    )
    return F.array_join(pairs, ";").alias("vals")


@query(
    f"""SELECT day AS period, rev_id // 100000 AS part, count(*) AS hits, {VALUES} AS vals,
          sum(count(*)) OVER (PARTITION BY day)::BIGINT AS period_hits
        FROM revisions WHERE {THE} GROUP BY day, rev_id // 100000""",
    ("revisions",),
)
def trend_with_values_by_day(v):
    found = search(v.revisions, p.phrase("added", "the "), "day", ["rev_id", "user_text"])
    return found.select("period", "part", "hits", "period_hits", joined("values"))


@query(
    f"SELECT month AS period, rev_id, comment_out AS comment FROM revisions WHERE {THE}",
    ("revisions",),
)
def trend_as_rows(v):
    return t.trend_hits(the_hits(v), "month", ["rev_id", "comment"])


@query(f"SELECT rev_id, title FROM revisions WHERE {THE}", ("revisions",))
def hits_listed(v):
    return search(v.revisions, p.phrase("added", "the "), "no", ["rev_id", "title"])


@query(f"SELECT count(*) AS hits FROM revisions WHERE {THE}", ("revisions",))
def hits_uncollapsed(v):
    return search(v.revisions, p.phrase("added", "the "), "week")


@query(f"SELECT greatest(count(*) - 100, 0) AS skipped FROM revisions WHERE {THE}", ("revisions",))
def hits_skipped(v):
    return h.skipped(the_hits(v), 100)


@query(f"SELECT rev_id, added FROM revisions WHERE {THE} ORDER BY rev_id LIMIT 70", ("revisions",))
def hits_limited(v):
    return h.limit_hits(the_hits(v), 70).select("rev_id", "added")


@query(
    f"SELECT rev_id, added FROM revisions WHERE {THE} ORDER BY rev_id LIMIT 300", ("revisions",)
)
def hits_limited_by_range(v):
    """A cap too large for a top-n, located by counts per id range."""
    return h.limit_hits(the_hits(v), 300, width=PART, small=10).select("rev_id", "added")


@query(
    f"""SELECT lang, rev_id, rank FROM (SELECT lang, rev_id,
          row_number() OVER (PARTITION BY lang ORDER BY rev_id) AS rank
        FROM revisions WHERE contains(added, 'e')) WHERE rank <= 25""",
    ("revisions",),
)
def hits_capped_by_group(v):
    langs = v.documents.select(F.col("doc_id").alias("rev_id"), "lang")
    hits = v.revisions.where(p.phrase("added", "e")).select("rev_id").join(langs, "rev_id")
    return h.cap_hits(hits, 25, ["lang"], width=PART, small=10)


@query(
    f"SELECT rev_id FROM revisions WHERE {THE} OR contains(removed, 'que') OR minor",
    ("revisions",),
)
def hits_united(v):
    others = [v.revisions.where(p.phrase("removed", "que")), v.revisions.where(p.term("minor", True))]
    return h.union_hits(the_hits(v), *others)


@query(
    f"""SELECT month AS period, count(*) AS hits FROM (
          SELECT month FROM revisions WHERE {THE}
          UNION ALL SELECT month FROM revisions WHERE contains(added, 'and ')) GROUP BY month""",
    ("revisions",),
)
def trends_combined(v):
    trends = t.trend(the_hits(v)).unionByName(t.trend(v.revisions.where(p.phrase("added", "and "))))
    return t.combine_trends(trends)


@query(
    f"""SELECT month AS period, count(*) AS hits FROM revisions
        WHERE {THE} OR contains(added, 'and ') GROUP BY month""",
    ("revisions",),
)
def trends_combined_distinct(v):
    both = the_hits(v).unionByName(v.revisions.where(p.phrase("added", "and ")))
    return t.combine_trends_distinct(both)


SERIES = ["en", "fr", "de", "es"]


@query(
    "SELECT replace(date, '-', '/') || '/15' AS date, "
    + ", ".join(f"count(*) FILTER (series = '{s}') AS {s}" for s in SERIES)
    + " FROM results GROUP BY date",
    ("results",),
)
def series_merged(v):
    """Distinct revisions per date and series, from rows of trend files."""
    twice = v.result_rows.unionByName(v.result_rows)
    return t.merge_series(twice, SERIES)


@query(
    """SELECT series, hits,
         CAST(row_number() OVER (ORDER BY hits DESC, series) AS INTEGER) AS rank
       FROM (SELECT series, count(*) AS hits FROM results GROUP BY series)""",
    ("results",),
)
def series_ranked(v):
    return t.series_rank(v.result_rows)


@query("SELECT CAST(rev_id AS VARCHAR) AS rev_id FROM results", ("results",))
def rev_ids_extracted(v):
    return extract_rev_ids(v.result_rows)


@query(
    """SELECT CAST(rev_id AS VARCHAR) AS rev_id FROM results
       UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 2""",
    ("results",),
)
def rev_ids_of_files(v):
    """Ids out of trend files that hold comments, and rows too short or too long."""
    path = work_path(v.spark, "results")
    v.result_rows.select("date", "hits", "ids").write.csv(f"{path}/good", escape='"')
    doc = F.col("doc_id").cast("string")
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# note,1,"), doc))
    odd = odd.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("2006-01,1,"), doc, F.lit(",more")))
    odd = odd.otherwise(F.concat(F.lit("2006-01,1,"), doc, F.lit(";"), F.repeat(F.lit("9"), 30)))
    v.documents.select(odd.alias("value")).write.text(f"{path}/odd")
    return extract_rev_ids(read_trend_csv(v.spark, [f"{path}/good", f"{path}/odd"], exactly=True))
