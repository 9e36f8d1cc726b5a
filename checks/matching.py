"""Templates, saved queries, and streams."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import EPOCH, NOW
from editwake.functions import predicates as p
from editwake.functions.derive import iso_timestamp
from editwake.operators import batch, templates
from editwake.operators import trends as t
from editwake.plans.search import template_trend
from editwake.session import work_path
from editwake.sources import revision_table
from editwake.sources.diff_files import format_diff_lines
from editwake.streaming import jobs

ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def now():
    return F.lit(NOW).cast("timestamp")


def iso(name: str):
    return iso_timestamp(F.col(name)).alias(name)


@query(
    f"""SELECT title, text, strftime(valid_from, {ISO}) AS valid_from,
          strftime(valid_to, {ISO}) AS valid_to FROM intervals""",
    ("intervals",),
)
def template_validity(v):
    intervals = templates.validity_intervals(v.template_history, now())
    return intervals.select("title", "text", iso("valid_from"), iso("valid_to"))


MATCHES = f"""SELECT title, strftime(valid_from, {ISO}) AS valid_from,
  strftime(valid_to, {ISO}) AS valid_to, rev_id, strftime(ts, {ISO}) AS timestamp FROM matches"""


def matched(v, **options):
    intervals = templates.template_intervals(v.template_history, now())
    found = templates.match_templates(v.revisions, intervals, **options)
    return found.select("title", iso("valid_from"), iso("valid_to"), "rev_id", iso("timestamp"))


@query(MATCHES, ("matches",))
def template_matches(v):
    return matched(v)


@query(MATCHES, ("matches",))
def template_matches_shuffled(v):
    """Too many intervals to broadcast: both sides are shuffled by month."""
    found = matched(v, broadcast_rows=1)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    if "SortMergeJoin [key" not in plan or "BroadcastHashJoin [key" in plan:
        raise AssertionError("the join was meant to be shuffled")
    return found


@query(
    """SELECT b.item_id AS item, r.rev_id
       FROM (SELECT item_id, list_filter(string_split(text, chr(10)), lambda l: length(l) >= 4) AS lines
             FROM benchmark) b
       JOIN revisions r ON r.ts >= make_timestamp(1136073600000000)
         AND len(list_filter(b.lines, lambda l: NOT contains(r.added, l))) = 0
       WHERE len(b.lines) > 0""",
    ("revisions",),
)
def template_matches_by_word(v):
    """Items as templates of their lines, found by a word inside one of them."""
    items = v.table("benchmark").select(
        F.col("item_id").cast("string").alias("title"),
        F.filter(F.split("text", "\n", -1), lambda line: F.length(line) >= 4).alias("fragments"),
        F.timestamp_seconds(F.lit(EPOCH)).alias("valid_from"),
        now().alias("valid_to"),
    )
    found = templates.match_templates(v.revisions, items)
    return found.select(F.col("title").cast("bigint").alias("item"), "rev_id")


@query(
    f"""SELECT i.title, strftime(valid_from, {ISO}) AS valid_from,
          strftime(valid_to, {ISO}) AS valid_to, rev_id, strftime(ts, {ISO}) AS timestamp
        FROM intervals i JOIN revisions r ON ts >= valid_from AND ts <= valid_to
        WHERE len(list_filter(i.fragments, lambda f: NOT contains(r.added, f))) = 0""",
    ("intervals", "revisions"),
)
def template_matches_with_empty(v):
    """Versions without fragments match everything in their time."""
    return matched(v, allow_empty=True)


@query("SELECT month AS period, count(*) AS hits FROM matches GROUP BY month", ("matches",))
def template_trend_summed(v):
    return template_trend(v.revisions, v.template_history, now())


@query(
    "SELECT month AS period, count(DISTINCT rev_id) AS hits FROM matches GROUP BY month",
    ("matches",),
)
def template_trend_distinct(v):
    return template_trend(v.revisions, v.template_history, now(), distinct=True)


@query(
    "SELECT day AS period, count(*) AS hits FROM matches WHERE namespace = 3 GROUP BY day",
    ("matches",),
)
def template_trend_by_day(v):
    """Within one namespace."""
    return template_trend(v.revisions, v.template_history, now(), namespace=3, daily=True)


@query(
    """SELECT month AS period, count(*) AS hits FROM (
         SELECT month FROM (SELECT *, row_number() OVER (
             PARTITION BY title, valid_from, valid_to ORDER BY rev_id) AS n FROM matches)
         WHERE n <= 1) GROUP BY month""",
    ("matches",),
)
def template_trend_capped(v):
    """At most one hit for each version of a template."""
    return template_trend(v.revisions, v.template_history, now(), max_revs=1)


COMMENTED = """
SELECT r.rev_id, n.name FROM revisions r JOIN (
  SELECT DISTINCT 'Uw-' || source AS name FROM documents) n
  ON contains(r.added, '<!-- Template:uw-' || substr(n.name, 4) || ' -->')
  OR contains(r.added, '<!-- Template:Uw-' || lower(substr(n.name, 4)) || ' -->')
  OR contains(r.added, '<!-- Added using Template:uw-' || substr(n.name, 4) || ' -->')
  OR contains(r.added, '<!-- Added using Template:Uw-' || lower(substr(n.name, 4)) || ' -->')"""


@query(COMMENTED, ("revisions",))
def template_comment_matches(v):
    return templates.match_template_comments(v.revisions, v.template_names)


@query("SELECT query_id, rev_id FROM found", ("found",))
def saved_query_matches(v):
    """All saved queries in one pass over the revisions."""
    return batch.match_saved_queries(v.revisions, v.clauses).select("query_id", "rev_id")


@query("SELECT query_id, rev_id FROM found", ("found",))
def saved_query_matches_in_passes(v):
    """The same with few clauses per pass."""
    found = batch.match_saved_queries(v.revisions, v.clauses, clauses_per_pass=100)
    return found.select("query_id", "rev_id")


@query(
    "SELECT query_id, month AS period, count(*) AS hits FROM found GROUP BY ALL", ("found",)
)
def saved_query_trends(v):
    return batch.trends_by_query(batch.match_saved_queries(v.revisions, v.clauses))


@query(
    """SELECT DISTINCT field, value, query_id FROM words t WHERE value <> '' AND NOT EXISTS (
         SELECT 1 FROM words o WHERE o.query_id = t.query_id AND o.field = t.field
           AND contains(left(o.value, length(o.value) - 1), t.value))""",
    ("words",),
)
def terms_pruned(v):
    """Words of each document that are not inside another of its words."""
    return batch.prune_contained_terms(v.words)


@query(
    f"SELECT rev_id, title, md5(added) AS added FROM revisions"
    " WHERE rev_id IN (SELECT doc_id FROM labels)",
    ("revisions",),
)
def revisions_looked_up(v):
    ids = v.table("labels").select(F.col("doc_id").alias("rev_id"))
    found = revision_table.lookup_revisions(v.revisions, ids)
    return found.select("rev_id", "title", F.md5("added").alias("added"))


_LOWER = "lower(left(name, 1)) || substr(name, 2)"
_UPPER = "upper(left(name, 1)) || lower(substr(name, 2))"


@query(
    f"""SELECT '"<!-- Template:' || {_LOWER} || ' -->" OR "<!-- Template:' || {_UPPER}
          || ' -->" OR "<!-- Added using Template:' || {_LOWER}
          || ' -->" OR "<!-- Added using Template:' || {_UPPER} || ' -->"' AS query,
          'results/' || {_LOWER} || '.txt' AS output
        FROM (SELECT trim(CASE WHEN doc_id % 9 > 0 THEN 'Uw-' || source || upper(lang) END) AS name
              FROM documents) WHERE name <> ''"""
)
def template_comment_queries(v):
    """Queries for lines with template names, some of them blank."""
    name = F.concat(F.lit(" Uw-"), "source", F.upper("lang"), F.lit(" "))
    lines = v.documents.select(F.when(F.col("doc_id") % 9 > 0, name).otherwise(" ").alias("name"))
    return templates.template_comment_queries(lines)


# --- streams ------------------------------------------------------------------

FILE_BYTES = 512 * 2**20
# Lines have their text twice, close together, and take a quarter of the disk.
PACKED = "gzip"


def write_lines(revisions, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Diff files of bounded size: one while it is small, so that no task writes a whole large table."""
    # A line holds its text twice, in the comment and in the hunks.
    size = 2 * (revisions.agg(F.sum(F.octet_length("comment"))).first()[0] or 0)
    format_diff_lines(revisions).coalesce(1 + size // file_bytes).write.text(folder, compression=PACKED)



@query(
    """SELECT rev_id, namespace, md5(added) AS added FROM revisions
       WHERE rev_id NOT IN (SELECT rev_id FROM batch)
       UNION ALL SELECT rev_id, namespace, md5(added) FROM batch
       QUALIFY row_number() OVER (PARTITION BY rev_id ORDER BY seq DESC) = 1""",
    ("batch",),
)
def stream_ingested(v):
    """Diff files streamed into a table in three steps, later ones winning."""
    source, table, state = (work_path(v.spark, n) for n in ("source", "table", "state"))
    new = v.upsert_batch
    for step, revisions in (
        ("a", v.revisions),
        ("b", new.where(F.col("seq") == 1)),
        ("c", new.where(F.col("seq") == 2)),
    ):
        format_diff_lines(revisions).write.text(f"{source}/{step}", compression=PACKED)
        jobs.stream_ingest(v.spark, source, table, state, width=10_000).awaitTermination()
    stored = revision_table.read_revisions(v.spark, table)
    return stored.select("rev_id", "namespace", F.md5("added").alias("added"))


@query(
    """SELECT rev_id, namespace FROM revisions
       WHERE rev_id NOT IN (SELECT rev_id FROM batch)
       UNION ALL SELECT rev_id, namespace FROM batch
       QUALIFY row_number() OVER (PARTITION BY rev_id ORDER BY seq DESC) = 1""",
    ("batch",),
)
def stream_ingested_in_one_file_batches(v):
    """Later files have paths before the earlier ones; each file is a batch of its own."""
    source, table, state = (work_path(v.spark, n) for n in ("source", "table", "state"))
    new = v.upsert_batch
    steps = (v.revisions, new.where(F.col("seq") == 1), new.where(F.col("seq") == 2))
    for folder, revisions in zip("zyx", steps):
        write_lines(revisions, f"{source}/{folder}")
    jobs.stream_ingest(
        v.spark, source, table, state, width=10_000, max_files=1
    ).awaitTermination()
    return revision_table.read_revisions(v.spark, table).select("rev_id", "namespace")


def streamed(v, name: str):
    source = work_path(v.spark, name)
    v.diff_lines.write.text(source)
    return jobs.read_revision_stream(v.spark, source)


def streamed_newest_first(v, name: str, files: int = 4):
    """The newest revisions come first, one file a batch, and some come twice."""
    source = work_path(v.spark, name)
    last = v.revisions.agg(F.max("rev_id")).first()[0] + 1
    for k in reversed(range(files)):
        low, high = k * last // files, (k + 1) * last // files + last // 20
        part = v.revisions.where((F.col("rev_id") >= low) & (F.col("rev_id") < high))
        write_lines(part, f"{source}/{k}")
    return jobs.read_revision_stream(v.spark, source, max_files=1)


@query(
    "SELECT day AS period, count(*) AS hits FROM revisions WHERE contains(added, 'the ') GROUP BY day",
    ("revisions",),
)
def stream_trend_by_day(v):
    trend = jobs.stream_trend(streamed(v, "days"), p.phrase("added", "the "), "day")
    return jobs.final_counts(v.spark, trend, work_path(v.spark, "days-out"))


@query(
    "SELECT month AS period, count(*) AS hits FROM revisions WHERE contains(added, 'the ')"
    " GROUP BY month",
    ("revisions",),
)
def stream_trend_by_month(v):
    trend = jobs.stream_trend(streamed(v, "months"), p.phrase("added", "the "), "month")
    return jobs.final_counts(v.spark, trend, work_path(v.spark, "months-out"))


@query(
    "SELECT day AS period, count(*) AS hits FROM revisions WHERE contains(added, 'the ') GROUP BY day",
    ("revisions",),
)
def stream_trend_newest_first(v):
    trend = jobs.stream_trend(streamed_newest_first(v, "newest"), p.phrase("added", "the "), "day")
    return jobs.final_counts(v.spark, trend, work_path(v.spark, "newest-out"))


@query(
    "SELECT month AS period, count(*) AS hits FROM revisions WHERE contains(added, 'the ')"
    " GROUP BY month",
    ("revisions",),
)
def stream_trend_newest_first_by_month(v):
    lines = streamed_newest_first(v, "newest-months")
    trend = jobs.stream_trend(lines, p.phrase("added", "the "), "month")
    return jobs.final_counts(v.spark, trend, work_path(v.spark, "newest-months-out"))


@query(
    """SELECT month AS period, count(*) AS hits FROM (
         SELECT month, namespace, added FROM revisions WHERE rev_id NOT IN (SELECT rev_id FROM batch)
         UNION ALL SELECT month, namespace, added FROM batch
         QUALIFY row_number() OVER (PARTITION BY rev_id ORDER BY seq DESC) = 1)
       WHERE namespace = 3 AND contains(added, 'the ') GROUP BY month""",
    ("batch",),
)
def stream_trend_of_versions(v):
    """Three steps of versions, of which later ones stop or start matching; each file is a batch."""
    source, table, out = (work_path(v.spark, n) for n in ("source", "table", "trend"))
    new = v.upsert_batch
    steps = (v.revisions, new.where(F.col("seq") == 1), new.where(F.col("seq") == 2))
    predicate = p.term("namespace", 3) & p.phrase("added", "the ")
    for number, revisions in enumerate(steps):
        write_lines(revisions, f"{source}/{number}")
        jobs.stream_table_trend(
            v.spark, source, table, out, predicate, max_files=1, width=10_000
        ).awaitTermination()
    return jobs.table_trend(v.spark, out)


@query("SELECT query_id, rev_id FROM found", ("found",))
def stream_matched(v):
    out = work_path(v.spark, "matches")
    jobs.stream_match(streamed(v, "matched"), v.clauses, out).awaitTermination()
    return jobs.read_matches(v.spark, out).select("query_id", "rev_id")
