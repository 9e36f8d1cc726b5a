import json
from collections import Counter, defaultdict
from random import Random

import pytest
from conftest import column
from pyspark.sql import functions as F

from editwake.functions import derive
from editwake.operators import hits as h
from editwake.operators import trends as t
from editwake.plans.layout import with_next, with_rank
from editwake.plans.search import answer, phrase_trend, search
from editwake.sources import trend_files

ROWS = "rev_id long, timestamp timestamp, title string, added string"


@pytest.fixture(scope="module")
def table(spark):
    """One id and one month hold a third of the rows each."""
    random = Random(7)
    rows = []
    for i in range(300):
        rev = 5 if i % 3 == 0 else random.randrange(1000)
        month, day = (1, 1 + i % 28) if i % 3 == 1 else (random.randrange(1, 13), 15)
        rows.append((rev, f"2006-{month:02}-{day:02} 10:00:00", f"T{rev % 3}\\n", "the " if i % 2 else "a"))
    data = spark.createDataFrame(rows, ROWS.replace("timestamp timestamp", "timestamp string"))
    return data.withColumn("timestamp", F.to_timestamp("timestamp")).persist()


@pytest.fixture(scope="module")
def plain(table):
    return [(r.rev_id, r.timestamp.strftime("%Y-%m"), r.title, r.added) for r in table.collect()]


def test_collapse_of_two_days(revisions):
    days = [(r.period, r.hits) for r in search(revisions, F.lit(True), "day").collect()]
    assert days == [("2002-02-25", 1), ("2002-02-26", 1)]
    months = search(revisions, F.lit(True), "month", ["rev_id"]).collect()
    assert [(r.period, r.hits, [v.rev_id for v in r["values"]]) for r in months] == [
        ("2002-02", 2, [501, 502])
    ]
    by_day = search(revisions, F.lit(True), "day", ["rev_id"]).collect()
    assert [(r.period, [v.rev_id for v in r["values"]]) for r in by_day] == [
        ("2002-02-25", [501]),
        ("2002-02-26", [502]),
    ]
    assert search(revisions, F.lit(True)).first().hits == 2
    assert column(search(revisions, F.lit(True), fields=["rev_id"])) == [501, 502]


def test_unknown_fields_are_an_error(revisions):
    with pytest.raises(Exception, match="no_such"):
        search(revisions, F.lit(True), fields=["no_such"])


def test_packed_parts_carry_everything(table, plain):
    packed = t.trend_with_fields(table, "month", ["rev_id", "title"], part_width=100).collect()
    counts = Counter()
    seen = Counter()
    for r in packed:
        counts[r.period] += r.hits
        assert len({v.rev_id for v in r["values"]}) <= 100
        assert r["values"] == sorted(r["values"])
        for v in r["values"]:
            assert v.rev_id // 100 == r.part
            seen[(r.period, v.rev_id, v.title)] += v.copies
    assert counts == Counter(m for _, m, _, _ in plain)
    assert seen == Counter((m, i, title.replace("\\n", "\n")) for i, m, title, _ in plain)


def test_phrase_trend(table, plain):
    wanted = Counter(m for _, m, _, a in plain if "the " in a and "2006-02" <= m < "2006-09")
    found = phrase_trend(table.withColumn("namespace", F.lit(1)), "the ", "2006-02", "2006-09", 1)
    assert {r.period: r.hits for r in found.collect()} == wanted


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 250, 1000])
def test_limit_by_ranges_equals_a_sort(spark, n):
    ids = Random(n).sample(range(5000), 300)
    data = spark.createDataFrame([(i,) for i in ids], "rev_id long")
    wanted = sorted(ids)[:n]
    assert column(h.limit_hits(data, n)) == wanted
    ranked = with_rank(data, "rev_id", up_to=n, width=37)
    assert [(r.rank, r.rev_id) for r in ranked.orderBy("rank").collect()] == [
        (k + 1, i) for k, i in enumerate(wanted)
    ]


def test_cap_per_query(spark):
    rows = [(q, i) for q in (1, 2, None) for i in Random(q or 9).sample(range(500), 40)]
    data = spark.createDataFrame(rows, "query_id int, rev_id long")
    found = defaultdict(list)
    for r in h.cap_hits(data, 25, width=50).collect():
        found[r.query_id].append(r.rev_id)
    for q in (1, 2, None):
        assert sorted(found[q]) == sorted(i for k, i in rows if k == q)[:25]


def test_caps_of_both_sizes(spark):
    rows = [(q, i) for q in (1, 2, None) for i in Random(q or 9).sample(range(500), 40)]
    data = spark.createDataFrame(rows, "query_id int, rev_id long")
    few, many = (sorted(map(repr, h.cap_hits(data, 25, width=50, small=n).collect())) for n in (25, 0))
    assert few == many and len(few) == 75


def test_small_caps_find_the_hits_once(spark):
    """Counting, ranking and cutting each searched anew, texts shuffled and all."""
    hits = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("rev_id"))
    plan = h.cap_hits(hits, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    # Before the shuffle each task keeps a hit of a query.
    assert "WindowGroupLimit" in plan


def test_rank_with_copies(table, plain):
    ranks = column(with_rank(table, "rev_id", width=10), "rank")
    assert ranks == list(range(1, 301))


def test_skipped_and_united(table):
    assert h.skipped(table, 100).first().skipped == 200
    assert h.skipped(table, 1000).first().skipped == 0
    small = table.where("rev_id < 10")
    assert column(h.union_hits(small, small, table)) == sorted({r.rev_id for r in table.collect()})


def test_combining(spark, table, plain):
    one, two = t.trend(table), t.trend(table.where("rev_id = 5"))
    summed = {r.period: r.hits for r in t.combine_trends(one.unionByName(two)).collect()}
    assert summed == Counter(m for _, m, *_ in plain) + Counter(m for i, m, *_ in plain if i == 5)
    distinct = {r.period: r.hits for r in t.combine_trends_distinct(table).collect()}
    assert distinct == Counter(m for _, m in {(i, m) for i, m, *_ in plain})


def results(spark):
    rows = [
        ("b", "2006-01", "1;2;3"), ("b", "2006-01", "3;4"), ("b", "2006-02-03", "1"),
        ("a", "2006-01", "9"), ("c", "2006-02", "1;2;3;4;5;6"),
    ]
    return spark.createDataFrame(rows, "series string, date string, ids string")


def test_merging(spark):
    merged = t.merge_series(results(spark), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in merged] == [
        ("2006/01/15", 1, 4, 0), ("2006/02/03", 0, 1, 0), ("2006/02/15", 0, 0, 6),
    ]
    assert t.ranked_series(results(spark), ["a", "b", "c", "d"]) == ["c", "b", "a", "d"]
    ranked = t.merge_series(results(spark), t.ranked_series(results(spark), ["a", "b", "c", "d"]))
    assert ranked.columns == ["date", "c", "b", "a", "d"]
    assert tuple(ranked.first()) == ("2006/01/15", 0, 4, 1, 0)


def test_precision(spark):
    rows = spark.range(8)
    found = t.first_pass_precision(rows, rows.limit(3), unchecked=2).first()
    assert (found.positives, found.hits_all, found.precision) == (8, 3, 0.5)
    assert t.first_pass_precision(rows.limit(0), rows.limit(0)).first().precision is None


def test_period_keys(spark):
    data = spark.createDataFrame([("x 2006-01-02T",), ("none here",), (None,)], "s string")
    keys = data.select(
        derive.period_key_of_text(F.col("s"), "day"), derive.period_key_of_text(F.col("s"))
    ).collect()
    assert [tuple(k) for k in keys] == [("2006-01-02", "2006-01"), ("none", "none"), ("none", "none")]
    data = spark.createDataFrame([("2006-01",), ("2006-01-02",), ("2006",)], "s string")
    assert column(data.select(derive.normalise_date(F.col("s")))) == [
        "2006", "2006/01/02", "2006/01/15",
    ]


def test_json_response(spark, table):
    trend = t.trend(table.where("rev_id = 5"), "month").limit(1)
    found = trend_files.trend_json(trend, F.lit("q"), F.lit(0)).first().response
    assert found.startswith('{"hits_all":') and '"hits":[{"period":"2006-01","hits":' in found


def test_next_equals_a_plain_window(spark):
    random = Random(3)
    rows = []
    for i in range(400):
        key = "hot" if i % 3 else f"k{i % 7}"
        rows.append((key, 1136073600 + random.randrange(400) * 21600, f"t{i}"))
    data = spark.createDataFrame(rows, "key string, s long, text string").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    by_key = defaultdict(list)
    for key, s, text in rows:
        by_key[key].append((s, text))
    wanted = {}
    for key, items in by_key.items():
        items.sort()
        for here, after in zip(items, [*items[1:], (None, None)]):
            wanted[(key, *here)] = after[0]
    for period in ("hour", "day", "month"):
        found = with_next(data, "key", "ts", ("text",), period).select(
            "key", "s", "text", F.unix_timestamp("next_ts").alias("n")
        )
        assert {(r.key, r.s, r.text): r.n for r in found.collect()} == wanted


def test_limits_with_copies_of_ids(spark):
    rows = [(i // 2, f"t{i}") for i in range(40)]
    hits = spark.createDataFrame(rows, "rev_id long, added string")
    for cap in (1, 7, 8, 39, 40, 99):
        found = [r.rev_id for r in h.limit_hits(hits, cap, width=5, small=0).collect()]
        assert sorted(found) == [r[0] for r in rows[:cap]]


def test_fields_that_cannot_be_unescaped_stay(spark):
    hits = spark.createDataFrame([(r"moved C:\users here",), (r"a\nb",), (None,)], "comment string")
    assert [r.comment for r in h.select_fields(hits, ["comment"]).collect()] == [r"moved C:\users here", "a\nb", None]


def test_totals_do_not_depend_on_parts(spark, revisions):
    wide = revisions.withColumn("rev_id", F.col("rev_id") * 1000)
    for width in (10, 10**9):
        found = t.trend_with_fields(wide, "month", part_width=width).collect()
        assert {(r.period, r.period_hits) for r in found} == {("2002-02", 2)}


def test_answers(spark, revisions):
    def asked(**request):
        return json.loads(answer(revisions, json.dumps(request)).first()[0])

    one = asked(q='"world"', collapse_hits="day")
    assert one["hits_all"] == 2 and [x["hits"] for x in one["hits"]] == [1, 1]
    assert one["query"]["max_revs"] == 1000 and one["query"]["fields"] == []
    capped = asked(q='"world"', max_revs=1, fields=["rev_id", "title"])
    assert capped["hits"] == [{"rev_id": 501, "title": "Sandbox"}] and capped["debug_unchecked"] == 1
    assert asked(q="nowhere to be found")["hits_all"] == 0
    assert asked(q='"\u0001"', collapse_hits="month")["hits"] == []
    for q in ("title:x", "a OR b", "(a)", "a*"):
        with pytest.raises(ValueError):
            answer(revisions, json.dumps({"q": q}))
