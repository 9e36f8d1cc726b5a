"""Sources, sinks and the revision table."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import PART
from editwake.functions import derive
from editwake.functions import predicates as p
from editwake.functions.text import safe_title_name
from editwake.operators import trends as t
from editwake.operators.batch import match_saved_queries, trends_by_query
from editwake.plans.layout import with_rank
from editwake.plans import search
from editwake.session import work_path
from editwake.sources import diff_files, query_files, revision_table, trend_files

WHOLE_ROWS = """
SELECT rev_id, page_id, namespace, title, iso, comment, minor, user_id, user_text,
  md5(added) AS added, md5(removed) AS removed, added_size, removed_size, action
FROM revisions"""


def whole_rows(revisions):
    return revisions.select(
        "rev_id",
        "page_id",
        "namespace",
        "title",
        derive.iso_timestamp(F.col("timestamp")).alias("iso"),
        "comment",
        "minor",
        "user_id",
        "user_text",
        F.md5("added").alias("added"),
        F.md5("removed").alias("removed"),
        "added_size",
        "removed_size",
        "action",
    )


@query(WHOLE_ROWS, ("revisions",))
def diff_files_loaded(v):
    """Diff files in nested folders, read and parsed."""
    path = work_path(v.spark, "diffs")
    v.diff_lines.write.text(f"{path}/dump/part")
    return whole_rows(diff_files.parse_revisions(diff_files.read_diff_lines(v.spark, path)))


@query(WHOLE_ROWS, ("revisions",))
def revisions_parsed(v):
    return whole_rows(diff_files.parse_revisions(v.diff_lines))


@query(
    "SELECT rev_id, h.pos AS pos, h.sign AS sign, h.text AS text"
    " FROM (SELECT rev_id, unnest(hunks) AS h FROM revisions)",
    ("revisions",),
)
def hunks_parsed(v):
    cells = F.split("value", "\t", -1)
    hunks = diff_files.parse_hunks(F.slice(cells, 10, F.size(cells)))
    rev_id = F.get(cells, F.lit(0)).cast("bigint").alias("rev_id")
    return v.diff_lines.select(rev_id, F.inline(hunks))


@query(
    """SELECT rev_id, CASE rev_id % 4 WHEN 0 THEN 'too few columns'
         WHEN 1 THEN 'wrong type' WHEN 2 THEN 'empty column' END AS reason
       FROM revisions WHERE rev_id % 4 <> 3""",
    ("revisions",),
)
def lines_corrupt(v):
    """What stands in for the lines that end a load: too short, mistyped, emptied."""
    bad = diff_files.corrupt_lines(v.damaged_lines)
    return bad.select(F.split("value", "\t")[0].cast("bigint").alias("rev_id"), "reason")


@query(
    """SELECT rev_id, CAST(CASE WHEN rev_id % 4 = 3 THEN 2 ELSE 1 END AS BIGINT) AS lines,
         md5(added) AS added FROM revisions""",
    ("revisions",),
)
def lines_kept(v):
    """Lines around corrupt ones survive, and so do lines with one bad hunk."""
    kept = diff_files.parse_revisions(v.damaged_lines)
    return kept.groupBy("rev_id", F.md5("added").alias("added")).agg(F.count("*").alias("lines"))


@query(
    "SELECT rev_id, 'no colons here' AS hunk FROM revisions WHERE rev_id % 4 = 3", ("revisions",)
)
def hunks_skipped(v):
    return diff_files.skipped_hunks(v.damaged_lines)


@query(
    "SELECT rev_id, namespace, title FROM revisions WHERE namespace % 2 = 1", ("revisions",)
)
def load_talk_only(v):
    """Load filter: odd namespaces."""
    kept = diff_files.parse_revisions(v.diff_lines, lambda df: p.talk_only(df.namespace))
    return kept.select("rev_id", "namespace", "title")


@query("SELECT rev_id, namespace, title FROM revisions WHERE namespace = 3", ("revisions",))
def load_user_talk_only(v):
    """Load filter: namespace 3."""
    kept = diff_files.parse_revisions(v.diff_lines, lambda df: p.user_talk_only(df.namespace))
    return kept.select("rev_id", "namespace", "title")


@query("SELECT rev_id, namespace, title FROM revisions", ("revisions",))
def load_all(v):
    """Load filter: everything."""
    kept = diff_files.parse_revisions(v.diff_lines, lambda df: p.pass_all())
    return kept.select("rev_id", "namespace", "title")


@query(
    "SELECT rev_id, namespace FROM revisions UNION ALL SELECT rev_id, namespace FROM batch",
    ("batch",),
)
def revisions_appended(v):
    new = v.upsert_batch.drop("seq")
    return revision_table.append_revisions(v.revisions, new).select("rev_id", "namespace")


LATEST = """
SELECT rev_id, namespace, md5(added) AS added
FROM batch QUALIFY row_number() OVER (PARTITION BY rev_id ORDER BY seq DESC) = 1"""
UPSERTED = f"""
SELECT rev_id, namespace, md5(added) AS added FROM revisions
WHERE rev_id NOT IN (SELECT rev_id FROM batch)
UNION ALL ({LATEST})"""


def versions(revisions):
    return revisions.select("rev_id", "namespace", F.md5("added").alias("added"))


@query(UPSERTED, ("batch",))
def revisions_upserted(v):
    return versions(revision_table.upsert_revisions(v.revisions, v.upsert_batch, ("seq",)))


@query(UPSERTED, ("batch",))
def table_upserted(v):
    """The same on a stored table, of which only the touched id ranges are rewritten."""
    path = work_path(v.spark, "table")
    revision_table.write_revisions(v.revisions, path, width=PART)
    revision_table.upsert_table(v.spark, v.upsert_batch, path, ("seq",))
    return versions(revision_table.read_revisions(v.spark, path))


@query(
    "SELECT rev_id, namespace, md5(added) AS added FROM revisions"
    " UNION ALL SELECT rev_id, namespace, md5(added) FROM batch",
    ("batch",),
)
def table_appended(v):
    """Rows added to a stored table, copies included."""
    path = work_path(v.spark, "table")
    revision_table.write_revisions(v.revisions, path, width=PART)
    revision_table.append_table(v.spark, v.upsert_batch.drop("seq"), path)
    return versions(revision_table.read_revisions(v.spark, path))


@query(LATEST, ("batch",))
def latest_versions(v):
    return versions(revision_table.latest_revision(v.upsert_batch, ("seq",)))


@query(
    "SELECT rev_id, title FROM revisions WHERE rev_id NOT IN (SELECT rev_id FROM batch)",
    ("batch",),
)
def revisions_not_in_batch(v):
    return revision_table.missing_revisions(v.revisions, v.upsert_batch).select("rev_id", "title")


@query(
    """SELECT namespace, count(*) AS docs, count(DISTINCT rev_id) AS revisions FROM (
         SELECT rev_id, namespace FROM revisions
         UNION ALL SELECT rev_id, namespace FROM revisions
         UNION ALL SELECT rev_id, namespace FROM batch) GROUP BY namespace""",
    ("batch",),
)
def tables_merged(v):
    merged = revision_table.merge_tables(v.revisions, v.revisions, v.upsert_batch.drop("seq"))
    return merged.groupBy("namespace").agg(
        F.count("*").alias("docs"), F.count_distinct("rev_id").alias("revisions")
    )


@query(
    """SELECT count(*) AS docs, count(DISTINCT rev_id) AS revisions FROM (
         SELECT rev_id FROM revisions UNION ALL SELECT rev_id FROM batch)""",
    ("batch",),
)
def table_statistics(v):
    appended = revision_table.append_revisions(v.revisions, v.upsert_batch.drop("seq"))
    return revision_table.table_stats(appended)


@query(
    """SELECT doc_id + 1 AS ordinal,
         left(lpad(CAST(doc_id + 1 AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0') || '_'
           || regexp_replace(text, '[:!<>]', '__', 'g') || '.csv', 100) AS output
       FROM documents, (SELECT count(*) AS n FROM documents)"""
)
def query_names(v):
    """Output names of queries that name none, numbered in order."""
    placed = with_rank(v.documents, "doc_id", width=PART, name="ordinal")
    listed = placed.select(
        "ordinal", F.col("text").alias("query"), F.lit(None).cast("string").alias("output")
    )
    return query_files.name_queries(listed).select("ordinal", "output")


@query(
    """SELECT row_number() OVER (ORDER BY item_id % 3, item_id)::INTEGER AS ordinal, text AS query,
         'named ' || CAST(item_id AS VARCHAR) || '.csv' AS output FROM benchmark"""
)
def query_file_read(v):
    """Queries of several lines with output names, in three files of different sizes."""
    named = F.concat(F.lit("named "), F.col("item_id").cast("string"), F.lit(".csv"))
    return query_files.read_query_file(v.spark, query_folder(v, v.table("benchmark").withColumn("name", named)))


def query_folder(v, rows):
    """Rows with a ``text`` and a ``name`` as three files of different sizes."""
    path = work_path(v.spark, "queries")
    for k in range(3):
        part = rows.where(F.col("item_id") % 3 == k).orderBy("item_id", "name")
        part.select("text", "name").coalesce(1).write.csv(f"{path}/{k}", escape='"')
    return [f"{path}/{k}" for k in range(3)]


@query(
    """SELECT 'named ' || CAST(item_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) || '.csv' AS output,
         month AS date, count(*) AS hits
       FROM (SELECT item_id, i, string_split(text, chr(10))[i + 1] AS line FROM (
               SELECT *, unnest(range(len(string_split(text, chr(10))))) AS i FROM benchmark))
       JOIN revisions ON contains(added, line)
       WHERE line <> '' AND iso >= '2006-02' AND iso <= '2006-09-30' AND namespace = 3 GROUP BY ALL""",
    ("revisions",),
)
def query_files_to_outputs(v):
    """From query files, a query for each line, by way of saved queries to a folder of CSV for each of them."""
    lines = v.table("benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    name = F.concat(F.lit("named "), F.concat_ws("-", "item_id", "i"), F.lit(".csv"))
    named = query_files.read_query_file(v.spark, query_folder(v, lines.where("text <> ''").withColumn("name", name)))
    clauses = query_files.query_clauses(named, "2006-02", "2006-09-30", 3)
    trends = trends_by_query(match_saved_queries(v.revisions, clauses))
    path = work_path(v.spark, "outputs")
    trend_files.write_per_query(query_files.named_trends(trends, named), path)
    return v.spark.read.schema("date string, hits bigint, output string").csv(path)


@query(
    """SELECT to_json({'hits_all': 0, 'parsed_query': 'nothing', 'debug_unchecked': 0, 'hits': [],
         'query': 'asked'})::VARCHAR AS response FROM documents WHERE doc_id = 0"""
)
def trend_response_without_hits(v):
    """No hits are a count of 0, and the request is echoed."""
    trend = t.trend(v.revisions.where(p.phrase("added", "\u0001 in no text")))
    return trend_files.trend_json(trend, F.lit("nothing"), F.lit(0), request=F.lit("asked"))


@query(
    "SELECT doc_id, replace(source || '/' || lang || ':' || 'x', '/', '__') AS name0,"
    " replace(replace('User:' || source || '/' || lang, '/', '__'), ':', '__') AS name"
    " FROM documents"
)
def title_names(v):
    title = F.concat(F.lit("User:"), "source", F.lit("/"), "lang")
    other = F.concat("source", F.lit("/"), "lang", F.lit(":x"))
    return v.documents.select(
        "doc_id",
        F.replace(safe_title_name(other), F.lit("__x"), F.lit(":x")).alias("name0"),
        safe_title_name(title).alias("name"),
    )


PACKED = f"""
SELECT month AS date, count(*) AS hits,
  string_agg(CAST(rev_id AS VARCHAR), ';' ORDER BY rev_id) AS ids
FROM revisions WHERE contains(added, 'the ')
GROUP BY month, rev_id // {PART}"""


@query(PACKED, ("revisions",))
def trend_csv_read_back(v):
    """A trend with its ids, written as CSV and read again."""
    hits = v.revisions.where(p.phrase("added", "the "))
    path = work_path(v.spark, "trend")
    trend_files.write_trend_csv(t.trend_with_fields(hits, part_width=PART), path)
    return trend_files.read_trend_csv(v.spark, path).select("date", "hits", "ids")


@query(
    """SELECT '# title, "quoted"' AS date, NULL::BIGINT AS hits
       UNION ALL SELECT month, count(*) FROM revisions WHERE contains(added, 'the ') GROUP BY month""",
    ("revisions",),
)
def trend_csv_with_comments(v):
    """A comment row in front, which readers of trends leave out."""
    path = work_path(v.spark, "commented")
    trend = t.trend(v.revisions.where(p.phrase("added", "the ")))
    trend_files.write_trend_csv(trend, path, comments=['title, "quoted"'])
    assert trend_files.read_trend_csv(v.spark, path).isEmpty()  # no ids
    return v.spark.read.schema("date string, hits bigint").csv(path, escape='"')


ANSWERS = {
    "month": """SELECT to_json({'hits_all': sum(n)::BIGINT, 'parsed_query': '"the "',
          'debug_unchecked': (SELECT greatest(count(*) - 70, 0) FROM revisions WHERE contains(added, 'the ')),
          'hits': list({'period': month, 'hits': n} ORDER BY month), 'query': {'q': '"the "',
          'collapse_hits': 'month', 'max_revs': 70, 'version': '0.1', 'format': 'json', 'fields': []}})
        ::VARCHAR AS response FROM (SELECT month, count(*) AS n FROM capped GROUP BY month)""",
    "no": """SELECT to_json({'hits_all': count(*), 'parsed_query': '"the "',
          'debug_unchecked': (SELECT greatest(count(*) - 70, 0) FROM revisions WHERE contains(added, 'the ')),
          'hits': list({'rev_id': rev_id} ORDER BY rev_id), 'query': {'q': '"the "',
          'collapse_hits': 'no', 'max_revs': 70, 'version': '0.1', 'format': 'json', 'fields': ['rev_id']}})
        ::VARCHAR AS response FROM capped""",
}
CAPPED = "(SELECT * FROM revisions WHERE contains(added, 'the ') ORDER BY rev_id LIMIT 70)"


@query(
    " UNION ALL ".join(a.replace("FROM capped", f"FROM {CAPPED}") for a in ANSWERS.values()), ("revisions",)
)
def requests_answered(v):
    """Requests with a cap, by month and as a list of hits."""
    by_month = search.answer(v.revisions, '{"q": "\\"the \\"", "collapse_hits": "month", "max_revs": 70}')
    listed = search.answer(v.revisions, '{"q": "\\"the \\"", "max_revs": 70, "fields": "rev_id"}')
    return by_month.unionAll(listed)


@query(PACKED.replace("CAST(rev_id AS VARCHAR)", """'=HYPERLINK("http://enwp.org/?diff='
  || CAST(rev_id AS VARCHAR) || '","' || CAST(rev_id AS VARCHAR) || '")'"""), ("revisions",))
def trend_rows_linked(v):
    """The rows of a trend file with spreadsheet links."""
    hits = v.revisions.where(p.phrase("added", "the "))
    return trend_files.trend_rows(t.trend_with_fields(hits, part_width=PART), as_links=True)


@query(
    """SELECT to_json({'hits_all': CAST(sum(hits) AS BIGINT), 'parsed_query': 'added:"the "',
         'debug_unchecked': 0, 'hits': list({'period': month, 'hits': hits} ORDER BY month)})
         ::VARCHAR AS response
       FROM (SELECT month, count(*) AS hits FROM revisions
             WHERE contains(added, 'the ') GROUP BY month)""",
    ("revisions",),
)
def trend_response(v):
    """A trend as the JSON answer to a request."""
    trend = t.trend(v.revisions.where(p.phrase("added", "the ")))
    return trend_files.trend_json(trend, F.lit('added:"the "'), F.lit(0))


@query(
    f"""SELECT month AS period, rev_id // {PART} AS part,
         to_json({{'hits_all': count(*), 'parsed_query': 'added:"the "', 'debug_unchecked': 0,
           'hits': [{{'period': month, 'hits': count(*),
             'values': list({{'rev_id': rev_id, 'user_text': user_text, 'copies': 1}}
                            ORDER BY rev_id)}}]}})::VARCHAR AS response
       FROM revisions WHERE contains(added, 'the ') GROUP BY month, rev_id // {PART}""",
    ("revisions",),
)
def trend_response_with_fields(v):
    hits = v.revisions.where(p.phrase("added", "the "))
    packed = t.trend_with_fields(hits, "month", ["rev_id", "user_text"], part_width=PART)
    return trend_files.trend_json(packed, F.lit('added:"the "'), F.lit(0))


@query(
    """SELECT doc_id, text AS q,
         CASE WHEN doc_id % 2 = 0 THEN 'month' ELSE 'no' END AS collapse_hits,
         CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 1000 END AS INTEGER) AS max_revs,
         '0.1' AS version, CASE WHEN doc_id % 5 = 0 THEN 'jsonp' ELSE 'json' END AS format,
         CASE doc_id % 4 WHEN 0 THEN 'rev_id' WHEN 1 THEN 'rev_id,' || lang
           ELSE '' END AS fields, doc_id % 6 <> 5 AS valid
       FROM (SELECT * REPLACE (CASE WHEN doc_id % 6 <> 5 THEN text END AS text) FROM documents)"""
)
def requests_parsed(v):
    """JSON requests that leave out different keys; fields as a name or a list."""
    doc = F.col("doc_id")
    # to_json leaves nulls out, so every document lacks some of the keys.
    common = [
        F.when(doc % 6 != 5, F.col("text")).alias("q"),
        F.when(doc % 2 == 0, "month").alias("collapse_hits"),
        F.when(doc % 3 == 0, doc).alias("max_revs"),
        F.when(doc % 5 == 0, "jsonp").alias("format"),
    ]
    one = F.to_json(
        F.struct(*common, F.when(doc % 4 == 0, "rev_id").when(doc % 4 == 2, "").alias("fields"))
    )
    many = F.to_json(F.struct(*common, F.array(F.lit("rev_id"), F.col("lang")).alias("fields")))
    lines = v.documents.select("doc_id", F.when(doc % 4 == 1, many).otherwise(one).alias("value"))
    return (
        query_files.parse_requests(lines)
        .withColumn("fields", F.array_join("fields", ","))
        .drop("value")
    )


@query(
    """SELECT 'query ' || CAST(query_id AS VARCHAR) AS output, month AS date,
         count(*) AS hits FROM found GROUP BY ALL""",
    ("found",),
)
def trends_per_query(v):
    """One folder of CSV per saved query, read again."""
    trends = trends_by_query(match_saved_queries(v.revisions, v.clauses)).withColumn(
        "output", F.concat(F.lit("query "), F.col("query_id").cast("string"))
    )
    path = work_path(v.spark, "per-query")
    trend_files.write_per_query(trends.select("output", "period", "hits"), path)
    return v.spark.read.schema("date string, hits bigint, output string").csv(path)
