"""Stand-ins for revision data, derived from the test tables.

The test tables hold no revisions, so every document is read as one: its lines
are the hunks, and the header fields follow from its id. Each view exists twice,
as a DataFrame and as a SQL common table expression, over all rows.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions.derive import with_derived
from editwake.functions.text import TEMPLATE_BREAKS, TEMPLATE_NOTES, escape
from editwake.plans.layout import step
from editwake.schema import CLAUSE, REVISION
from editwake.sources.diff_files import format_diff_lines

EPOCH = 1136073600  # fixed value: 2006-01-01T00:00:00Z
STEP = 7 * 3600
NOW = "2030-01-01 00:00:00"
FRESH = 10_000_000  # added to an id to make a new one
BARE = 20_000_000  # added to an id to make one without hunks
PART = 300  # ids per part of a packed trend


class Views:
    """The DataFrame side."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def revisions(self) -> DataFrame:
        doc = F.col("doc_id")
        lines = F.split("text", "\n", -1)
        mark = F.struct(
            (F.size(lines) * 100).cast("string").alias("pos"),
            F.lit("1").alias("sign"),
            F.concat(F.lit("<!-- Template:uw-"), F.col("source"), F.lit(" -->")).alias("text"),
        )
        hunks = F.transform(
            lines,
            lambda line, i: F.struct(
                (i * 100).cast("string").alias("pos"),
                F.when((doc + i) % 4 == 3, "-1").otherwise("1").alias("sign"),
                line.alias("text"),
            ),
        )
        header = self.documents.select(
            doc.alias("rev_id"),
            (doc % 97).alias("page_id"),
            (doc % 6).cast("int").alias("namespace"),
            F.when(doc % 10 == 0, F.concat(F.lit("Uw-"), "source"))
            .otherwise(F.concat(F.lit("Page "), (doc % 97).cast("string")))
            .alias("title"),
            F.timestamp_seconds(F.lit(EPOCH) + doc * STEP).alias("timestamp"),
            F.concat(escape(F.col("text")), F.lit("\\n"), "lang").alias("comment"),
            (doc % 4 == 0).alias("minor"),
            F.when(doc % 5 != 0, doc % 53).alias("user_id"),
            F.concat(F.lit("User"), (doc % 53).cast("string")).alias("user_text"),
            F.when(doc % 10 == 0, F.concat(hunks, F.array(mark))).otherwise(hunks).alias("hunks"),
        )
        bare = header.where("rev_id % 29 = 28").withColumns(
            {"rev_id": F.col("rev_id") + BARE, "hunks": F.array().cast(hunks_type())}
        )
        return with_derived(header.unionByName(bare)).select(*REVISION.names)

    @cached_property
    def diff_lines(self) -> DataFrame:
        return format_diff_lines(self.revisions)

    @cached_property
    def damaged_lines(self) -> DataFrame:
        """Each line, and for each line a broken copy; ``rev_id`` tells the source."""
        line = F.col("value")
        cells = F.split(line, "\t", -1)
        doc = F.get(cells, F.lit(0)).cast("bigint")

        def without(i: int, instead: str):
            return F.array_join(
                F.transform(cells, lambda c, j: F.when(j == i, F.lit(instead)).otherwise(c)), "\t"
            )

        broken = (
            F.when(doc % 4 == 0, F.array_join(F.slice(cells, 1, 3), "\t"))
            .when(doc % 4 == 1, without(4, "yesterday"))
            .when(doc % 4 == 2, without(3, ""))
            # A hunk without colons does not spoil its line.
            .otherwise(F.concat(line, F.lit("\tno colons here")))
        )
        both = F.explode(F.array(line, broken)).alias("value")
        return self.diff_lines.select(both)

    @cached_property
    def upsert_batch(self) -> DataFrame:
        """Every labelled revision again in two versions, and all as new ones.

        Versions differ in namespace; ``seq`` orders them.
        """
        labelled = self.table("labels").select(F.col("doc_id").alias("rev_id"))
        version = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
        again = (
            self.revisions.join(labelled, "rev_id", "left_semi")
            .select("*", version)
            .withColumn("namespace", (F.col("namespace") + F.col("seq")).cast("int"))
        )
        fresh = self.revisions.select("*", F.lit(1).alias("seq")).withColumn(
            "rev_id", F.col("rev_id") + FRESH
        )
        return again.unionByName(fresh)

    @cached_property
    def template_history(self) -> DataFrame:
        """Each whole text as a version of a template; what its revision removes is in notes."""
        noted = F.transform(
            F.split("text", "\n", -1),
            lambda line, i: F.when(
                (F.col("doc_id") + i) % 4 == 3, F.concat(F.lit("<noinclude>"), line, F.lit("</noinclude>"))
            ).otherwise(line),
        )
        return self.documents.select(
            F.concat(F.lit("Template:Uw-"), (F.col("doc_id") % 4).cast("string")).alias("title"),
            F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * STEP).alias("rev_ts"),
            F.concat(F.array_join(noted, "\n"), F.lit("{{PAGENAME}}")).alias("text"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Saved queries, one per benchmark item: its lines as phrases."""
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.split("text", "\n", -1).alias("lines")
        )

    @cached_property
    def clauses(self) -> DataFrame:
        """A query finds additions with any line of its item, outside one namespace."""

        def clause(number, occur, field, kind, value=None, lo=None, hi=None):
            texts = {"occur": occur, "field": field, "kind": kind}
            cells = [F.lit(t).alias(n) for n, t in texts.items()]
            for name, cell in (("value", value), ("lo", lo), ("hi", hi)):
                cells.append((F.lit(None) if cell is None else cell).cast("string").alias(name))
            return self.queries.select("query_id", F.lit(number).alias("clause_no"), *cells)

        parts = [
            self.queries.select(
                "query_id",
                F.posexplode("lines").alias("clause_no", "value"),
                F.lit("should").alias("occur"),
                F.lit("added").alias("field"),
                F.lit("phrase").alias("kind"),
                F.lit(None).cast("string").alias("lo"),
                F.lit(None).cast("string").alias("hi"),
            ),
            clause(1000, "should", "removed", "phrase", F.get("lines", F.lit(0))),
            clause(1001, "must_not", "namespace", "term", F.col("query_id") % 6),
            clause(1002, "must_not", "user_text", "phrase", F.lit("User52")),
            clause(
                1003,
                "must_not",
                "timestamp",
                "range",
                lo=F.lit("2006-02"),
                hi=F.lit("2006-02-03"),
            ),
        ]
        names = CLAUSE.names
        united = parts[0].select(*names)
        for part in parts[1:]:
            united = united.unionByName(part.select(*names))
        return united

    @cached_property
    def words(self) -> DataFrame:
        """The words of each document as terms of one query."""
        return self.documents.select(
            F.col("doc_id").alias("query_id"),
            F.lit("added").alias("field"),
            F.explode(F.split("text", "[ \n]", -1)).alias("value"),
        ).where(F.col("value") != "")

    @cached_property
    def template_names(self) -> DataFrame:
        return self.documents.select(F.concat(F.lit("Uw-"), "source").alias("name")).distinct()

    @cached_property
    def result_rows(self) -> DataFrame:
        """Rows of trend files, one series per language."""
        dated = self.documents.select(
            F.col("lang").alias("series"),
            F.col("doc_id").alias("rev_id"),
            F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * STEP).alias("timestamp"),
        )
        packed = dated.groupBy(
            "series",
            F.date_format("timestamp", "yyyy-MM").alias("date"),
            step("rev_id", PART).alias("part"),
        ).agg(F.count("*").alias("hits"), F.array_sort(F.collect_list("rev_id")).alias("ids"))
        return packed.withColumn("ids", F.array_join("ids", ";")).drop("part")


def hunks_type() -> str:
    return REVISION["hunks"].dataType.simpleString()


# --- the SQL side -------------------------------------------------------------

# The fixed pattern as an SQL text.
SQL_BREAKS = "'" + TEMPLATE_BREAKS.replace("'", "''") + "'"

_TS = f"make_timestamp(({EPOCH} + doc_id * {STEP}) * 1000000)"

CTES = {
    "docs": "SELECT *, string_split(text, chr(10)) AS lines FROM documents",
    "heads": f"""
        SELECT doc_id AS rev_id, doc_id % 97 AS page_id, CAST(doc_id % 6 AS INTEGER) AS namespace,
          CASE WHEN doc_id % 10 = 0 THEN 'Uw-' || source
               ELSE 'Page ' || CAST(doc_id % 97 AS VARCHAR) END AS title,
          {_TS} AS ts, strftime({_TS}, '%Y-%m-%dT%H:%M:%SZ') AS iso,
          text || chr(10) || lang AS comment_out,
          replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'),
            chr(39), chr(92) || chr(39)) || chr(92) || 'n' || lang AS comment,
          doc_id % 4 = 0 AS minor,
          CASE WHEN doc_id % 5 <> 0 THEN doc_id % 53 END AS user_id,
          'User' || CAST(doc_id % 53 AS VARCHAR) AS user_text,
          list_concat(
                 list_transform(lines, lambda line, i:
                   {{'pos': CAST((i - 1) * 100 AS VARCHAR),
                     'sign': CASE WHEN (doc_id + i - 1) % 4 = 3 THEN '-1' ELSE '1' END,
                     'text': line}}),
                 CASE WHEN doc_id % 10 = 0
                      THEN [{{'pos': CAST(len(lines) * 100 AS VARCHAR), 'sign': '1',
                              'text': '<!-- Template:uw-' || source || ' -->'}}]
                      ELSE [] END) AS hunks,
          lang, source
        FROM docs""",
    "headers": f"""
        SELECT * FROM heads
        UNION ALL BY NAME
        SELECT * REPLACE (rev_id + {BARE} AS rev_id, list_filter(hunks, lambda h: false) AS hunks)
        FROM heads WHERE rev_id % 29 = 28""",
    "texts": """
        SELECT *,
          coalesce(array_to_string(list_transform(list_filter(hunks, lambda h: h.sign <> '-1'),
            lambda h: h.pos || h.sign || h.text || chr(9)), ''), '') AS added,
          coalesce(array_to_string(list_transform(list_filter(hunks, lambda h: h.sign = '-1'),
            lambda h: h.pos || h.sign || h.text || chr(9)), ''), '') AS removed
        FROM headers""",
    "revisions": """
        SELECT *, CAST(length(added) AS INTEGER) AS added_size,
          CAST(length(removed) AS INTEGER) AS removed_size,
          CASE WHEN added <> '' AND removed <> '' THEN 'both'
               WHEN added <> '' THEN 'addition' ELSE 'removal' END AS action,
          strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day
        FROM texts""",
    "batch": f"""
        SELECT * REPLACE (CAST(namespace + seq AS INTEGER) AS namespace)
          FROM revisions, (VALUES (1), (2)) AS v(seq)
          WHERE rev_id IN (SELECT doc_id FROM labels)
        UNION ALL BY NAME
        SELECT * REPLACE (rev_id + {FRESH} AS rev_id), 1 AS seq FROM revisions""",
    "history": f"""
        SELECT 'Template:Uw-' || CAST(doc_id % 4 AS VARCHAR) AS title, {_TS} AS rev_ts,
          array_to_string(list_transform(lines, lambda line, i: CASE WHEN (doc_id + i - 1) % 4 = 3
            THEN '<noinclude>' || line || '</noinclude>' ELSE line END), chr(10)) || '{{{{PAGENAME}}}}' AS text
        FROM docs""",
    "intervals": f"""
        SELECT title, text, rev_ts AS valid_from,
          coalesce(lead(rev_ts) OVER (PARTITION BY title ORDER BY rev_ts, text),
                   TIMESTAMP '2030-01-01 00:00:00') AS valid_to,
          list_filter(
            regexp_split_to_array(regexp_replace(text, '{TEMPLATE_NOTES}', '', 'g'), {SQL_BREAKS}),
            lambda f: length(f) >= 4) AS fragments
        FROM history""",
    "matches": """
        SELECT i.title, i.valid_from, i.valid_to, r.rev_id, r.ts, r.month, r.day, r.namespace
        FROM intervals i JOIN revisions r ON r.ts >= i.valid_from AND r.ts <= i.valid_to
        WHERE len(i.fragments) > 0
          AND len(list_filter(i.fragments, lambda f: NOT contains(r.added, f))) = 0""",
    "queries": """
        SELECT item_id AS query_id, string_split(text, chr(10)) AS lines FROM benchmark""",
    "found": """
        SELECT q.query_id, r.rev_id, r.ts, r.month FROM queries q JOIN revisions r
          ON len(list_filter(q.lines, lambda p: contains(r.added, p))) > 0
          OR contains(r.removed, q.lines[1])
        WHERE r.namespace <> q.query_id % 6
          AND NOT contains(r.user_text, 'User52')
          AND NOT (r.iso >= '2006-02' AND r.iso <= '2006-02-03')""",
    "words": """
        SELECT doc_id AS query_id, 'added' AS field,
          unnest(regexp_split_to_array(text, '[ \\n]')) AS value FROM documents""",
    "results": f"""
        SELECT lang AS series, strftime({_TS}, '%Y-%m') AS date, doc_id AS rev_id FROM documents""",
}

# Which views each one reads.
NEEDS = {
    "heads": ("docs",),
    "headers": ("heads",),
    "texts": ("headers",),
    "revisions": ("texts",),
    "batch": ("revisions",),
    "history": ("docs",),
    "intervals": ("history",),
    "matches": ("intervals", "revisions"),
    "found": ("queries", "revisions"),
}


def with_views(body: str, *names: str) -> str:
    """SQL text with the views it needs in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    heads = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {heads}\n{body}"
