from datetime import datetime, timedelta
from random import Random

import pytest
from conftest import column
from pyspark.sql import functions as F

from editwake.functions.text import (
    safe_title_name,
    template_comment_query,
    template_comment_variants,
    template_fragments,
)
from editwake.operators import templates as tp
from editwake.plans.search import template_trend


def fragments(spark, text):
    return spark.createDataFrame([(text,)], "s string").select(template_fragments(F.col("s"))).first()[0]


def test_fragments(spark):
    assert fragments(spark, "please sign\n") == ["please sign"]
    assert fragments(spark, "one<noinclude>hidden</noinclude>two<noinclude>x</noinclude>") == ["onetwo"]
    assert fragments(spark, "your edit\n<noinclude>\n[[Category:Notes]]\n</noinclude>\n\n") == ["your edit"]
    assert fragments(spark, "no\nhm\n") == []
    text = "Hello {{PAGENAME}} there{{#if:x|y}}\nSee {{{1}}}, it's __NOTOC__done{{tl|x}} <includeonly>only</includeonly> now~~~~"
    assert fragments(spark, text) == ["Hello ", " there", "See ", ", it", "done", "tl|x", "only", " now"]


def test_comment_variants(spark):
    data = spark.createDataFrame([(" Uw-Test1 ",)], "name string")
    row = data.select(
        template_comment_variants(F.col("name")).alias("v"),
        template_comment_query(F.col("name")).alias("q"),
    ).first()
    assert row.v == [
        "<!-- Template:uw-Test1 -->",
        "<!-- Template:Uw-test1 -->",
        "<!-- Added using Template:uw-Test1 -->",
        "<!-- Added using Template:Uw-test1 -->",
    ]
    assert row.q.query == " OR ".join(f'"{v}"' for v in row.v)
    assert row.q.output == "results/uw-Test1.txt"
    assert data.select(safe_title_name(F.lit("Template:A/b"))).first()[0] == "Template__A__b"


NOW = datetime(2006, 9, 1)
WORDS = ["alpha", "bravo", "charlie", "delta"]


@pytest.fixture(scope="module")
def history(spark):
    random = Random(1)
    rows = []
    for title in ("A", "B", "C"):
        ts = datetime(2006, 1, 1)
        for _ in range(12):
            ts += timedelta(hours=random.choice([0, 1, 30, 400, 900]))
            text = "{{PAGENAME}}".join(random.sample(WORDS, random.randrange(1, 3))) if random.random() < 0.9 else "{{x}}"
            rows.append((title, ts, text))
    return spark.createDataFrame(rows, "title string, rev_ts timestamp, text string").persist()


@pytest.fixture(scope="module")
def edits(spark, history):
    random = Random(2)
    ends = [r.rev_ts for r in history.collect()]
    rows = []
    for i in range(200):
        # Half of the edits fall on an interval end.
        ts = random.choice(ends) if i % 2 else datetime(2006, 1, 1) + timedelta(minutes=random.randrange(360000))
        rows.append((i, ts, random.randrange(4), " ".join(random.sample(WORDS, 2)), "Page"))
    return spark.createDataFrame(
        rows, "rev_id long, timestamp timestamp, namespace int, added string, title string"
    ).persist()


def expected(history, edits, allow_empty=False):
    rows = sorted((r.title, r.rev_ts, r.text) for r in history.collect())
    found = []
    for k, (title, start, text) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == title else NOW
        parts = [w for w in text.split("{{PAGENAME}}") if w in WORDS]
        if not parts and not allow_empty:
            continue
        for e in edits.collect():
            if start <= e.timestamp <= end and all(w in e.added for w in parts):
                found.append((title, start, end, e.rev_id))
    return sorted(found)


@pytest.mark.parametrize("allow_empty", [False, True])
@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_matches_equal_brute_force(spark, history, edits, allow_empty, rows):
    intervals = tp.template_intervals(history, F.lit(NOW))
    found = tp.match_templates(edits, intervals, allow_empty, broadcast_rows=rows)
    got = sorted((r.title, r.valid_from, r.valid_to, r.rev_id) for r in found.collect())
    assert got == expected(history, edits, allow_empty)


def test_trends_count_shared_ends_twice_or_once(history, edits):
    pairs = expected(history, edits)
    summed = template_trend(edits, history, F.lit(NOW))
    assert sum(r.hits for r in summed.collect()) == len(pairs)
    distinct = template_trend(edits, history, F.lit(NOW), distinct=True)
    assert sum(r.hits for r in distinct.collect()) == len({p[3] for p in pairs})
    assert len({p[3] for p in pairs}) < len(pairs)
    own = {e.rev_id for e in edits.where("namespace = 2").collect()}
    inside = template_trend(edits, history, F.lit(NOW), namespace=2, daily=True)
    assert sum(r.hits for r in inside.collect()) == sum(p[3] in own for p in pairs)


@pytest.mark.parametrize("start,end", [
    ("2006-01-05 10:00:00", "2006-01-05 11:00:00"),
    ("2006-01-05 10:00:00", "2006-04-02 00:00:00"),
    ("2006-01-01 00:00:00", "2006-02-01 00:00:00"),
    ("2006-01-31 23:00:00", "2006-02-01 01:00:00"),
    ("2005-12-31 00:00:00", "2007-03-01 12:00:00"),
    ("2006-02-01 00:00:00", "2006-01-01 00:00:00"),
])
def test_interval_keys_cover_once(spark, start, end):
    days = spark.sql(
        "SELECT explode(sequence(timestamp'2005-11-01', timestamp'2007-05-01', interval 6 hours)) AS ts"
    )
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    keys = tp._interval_keys(lo, hi)
    both = days.select(
        "ts",
        F.size(F.array_intersect(keys, F.array(tp._day(F.col("ts")), tp._month(F.col("ts"))))).alias("n"),
        F.size(keys).alias("all"),
        F.size(F.array_distinct(keys)).alias("different"),
    )
    for r in both.collect():
        inside = start <= str(r.ts) <= end
        assert r.n <= 1 and r.all == r.different
        if inside:
            assert r.n == 1


def test_comment_matches(spark):
    texts = {
        1: "x <!-- Template:uw-a --> y",
        2: "<!-- Added using Template:Uw-a -->",
        3: "<!-- Template:UW-a -->",
        4: "<!-- Template:broken <!-- Template:uw-b --> end",
        5: "<!--Template:uw-a-->",
        6: "<!-- Template:uw-a --><!-- Template:uw-b --><!-- Template:uw-a -->",
        7: "<!-- Template:odd --> name -->",
        8: "<!-- Template:odd -->",
    }
    edits = spark.createDataFrame(list(texts.items()), "rev_id long, added string")
    names = spark.createDataFrame([("Uw-a",), ("uw-b",), ("Odd --> name",), ("none",)], "name string")
    for rows in (1000, 0):
        found = tp.match_template_comments(edits, names, broadcast_rows=rows)
        assert sorted((r.rev_id, r.name) for r in found.collect()) == [
            (1, "Uw-a"), (2, "Uw-a"), (4, "uw-b"), (6, "Uw-a"), (6, "uw-b"), (7, "Odd --> name"),
        ]


def test_titles_with_prefix(spark):
    data = spark.createDataFrame([(10, "Uw-a"), (10, "Uw-a"), (9, "Uw-b"), (10, "x")], "namespace int, title string")
    assert column(tp.title_prefix(data, 10, "Uw-")) == ["Uw-a"]


def test_stored_tables_are_read_in_the_time_of_the_versions(spark, tmp_path):
    from editwake.sources.revision_table import read_revisions, write_revisions

    day = 86_400
    blank = {n: F.lit("") for n in ("removed", "comment", "title", "user_text", "action")}
    blank |= {n: F.lit(0) for n in ("page_id", "namespace", "user_id", "added_size", "removed_size")}
    edits = spark.range(40).select(
        F.col("id").alias("rev_id"), F.timestamp_seconds(F.col("id") * day).alias("timestamp"), F.lit("one big template text").alias("added")
    ).withColumns(blank | {"minor": F.lit(False)})
    write_revisions(edits, str(tmp_path / "t"), width=5)
    stored = read_revisions(spark, str(tmp_path / "t"))
    at = lambda n: F.timestamp_seconds(F.lit(n * day))
    intervals = spark.createDataFrame([("A", ["big template text"]), ("B", ["text"])], "title string, fragments array<string>")
    intervals = intervals.withColumns({"valid_from": at(12), "valid_to": at(14)})
    found = tp.match_templates(stored, intervals)
    assert sorted((r.title, r.rev_id) for r in found.collect()) == [(t, i) for t in "AB" for i in (12, 13, 14)]
    assert "id_range" in found._jdf.queryExecution().sparkPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
