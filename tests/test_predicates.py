import re
from datetime import datetime, timedelta
from fnmatch import translate

import pytest
from conftest import column
from pyspark.sql import functions as F

from editwake.functions import predicates as p

TEXTS = [
    "This subject covers [[a]]",
    "This covers subject to",
    "unwelcome Welcome",
    "ab",
    "",
    "line\nbreak*?",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, f"value{i}") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "i int, added string, action string").withColumn(
        "namespace", F.col("i") - 1
    ).persist()


def hits(df, predicate):
    return column(df.where(predicate), "i")


def test_phrase_is_a_case_sensitive_substring(texts):
    assert hits(texts, p.phrase("added", "subject cover")) == [0]
    assert hits(texts, p.phrase("added", "welcome")) == [2]
    assert hits(texts, p.phrase("added", "e\nb")) == [5]


def test_unquoted_words_match_in_any_order(texts):
    assert hits(texts, p.all_grams("added", "subject cover", 1)) == [0, 1]
    assert hits(texts, p.all_grams("added", "subject cover", 3)) == [0, 1]
    assert hits(texts, p.all_grams("added", "subject [[a", 3)) == [0]
    assert hits(texts, p.any_gram("added", "[[a]] zzz", 3)) == [0]
    # Shorter than a gram: tested whole.
    assert hits(texts, p.all_grams("added", "ab", 3)) == [3]


def test_boolean_combinations(texts):
    ns = p.term("namespace", 1)
    assert hits(texts, p.any_of(ns, p.term("action", "value0"))) == [0, 2]
    assert hits(texts, p.all_of(p.none_of(p.wildcard("added", "[[?", 3)), p.value_range("namespace", -1, 2))) == [1, 2, 3]
    assert hits(texts, p.none_of(p.phrase("added", "e"))) == [3, 4]
    assert hits(texts, p.all_of()) == list(range(6))
    assert hits(texts, p.any_of()) == []


@pytest.mark.parametrize("pattern", ["[[?", "w?l", "c*e", "*e", "u*", "?*?", "***", "a", "abcd", "\\?", "k*?", "*", "b*", "??"])
def test_wildcards_match_whole_grams(texts, pattern):
    n = 3

    def expected(text):
        glob = re.compile(translate(pattern.replace("[", "[[]")), re.S)
        return any(glob.match(text[i : i + n]) for i in range(len(text) - n + 1))

    if "\\" in pattern:
        assert hits(texts, p.wildcard("added", pattern, n)) == []
    else:
        assert hits(texts, p.wildcard("added", pattern, n)) == [
            i for i, t in enumerate(TEXTS) if expected(t)
        ]


def test_wildcards_on_keywords_match_whole_values(texts):
    assert hits(texts, p.wildcard("action", "value?")) == list(range(6))
    assert hits(texts, p.wildcard("action", "*3")) == [3]
    assert hits(texts, p.wildcard("action", "value")) == []
    assert hits(texts, p.wildcard("action", "val_e0")) == []
    assert hits(texts, p.prefix("action", "value4")) == [4]
    assert hits(texts, p.prefix("added", "We")) == [2]


def test_near_fuzzy_regexp(texts):
    assert hits(texts, p.near("added", ["This", "subject"], 1)) == [0]
    assert hits(texts, p.near("added", ["This", "subject"], 8)) == [0, 1]
    assert hits(texts, p.near("added", ["line", "break*"], 1)) == [5]
    assert hits(texts, p.fuzzy("added", "cov", 0)) == [0, 1]
    assert hits(texts, p.fuzzy("added", "wXl", 1)) == [2]
    assert hits(texts, p.fuzzy("action", "valu1", 1)) == [1]
    assert hits(texts, p.regexp("added", "[Ww]elcome$")) == [2]


def test_value_ranges(texts):
    assert hits(texts, p.value_range("namespace", 0, 2)) == [1, 2, 3]
    assert hits(texts, p.value_range("namespace", 0, 2, False, False)) == [2]
    assert hits(texts, p.value_range("namespace", lo=3)) == [4, 5]
    assert hits(texts, p.value_range("namespace")) == list(range(6))


BOUNDS = [
    None, "0", "Z", "2006", "2006-", "2007-01", "2006-1", "2006-02-28", "2006-02-30", "2006-02-28T",
    "2006-02-28T12", "2006-02-28T12:30", "2006-02-28T12:30:00", "2006-02-28T12:30:00Z",
]


def test_time_ranges_compare_as_text(spark):
    start = datetime(2005, 12, 31, 23, 30)
    instants = [start + timedelta(days=d, hours=h) for d in range(0, 400, 29) for h in (0, 13)]
    instants.append(datetime(2006, 2, 28, 12, 30))
    texts = [t.strftime("%Y-%m-%dT%H:%M:%SZ") for t in instants]
    data = spark.createDataFrame([(t,) for t in texts], "iso string").select(
        "iso", F.to_timestamp("iso").alias("timestamp"), F.substring("iso", 1, 7).alias("month")
    ).persist()
    for lo in BOUNDS:
        for hi in BOUNDS[::3]:
            wanted = sorted(t for t in texts if (lo is None or t >= lo) and (hi is None or t <= hi))
            assert column(data.where(p.ts_range(lo, hi)), "iso") == wanted, (lo, hi)
    wanted = sorted(t for t in texts if "2006-02" <= t <= "2006-05-03")
    assert column(data.where(p.ts_range("2006-02", "2006-05-03", month="month")), "iso") == wanted


def test_partial_datetimes(spark):
    good = ["2011", "2011-", "2011-1", "2011-12-01", "2011-12-01T", "2011-12-01T23:59:60", "2012-02-29", "2011-12-01T00:00:00Z"]
    bad = ["1-2-34", "20110101", "20091010", "2011-13", "2011-02-30", "2011-12-01T24", "", "2011-12-01T00:00:00ZZ", "201", "2011-0"]
    data = spark.createDataFrame([(s,) for s in good + bad], "s string")
    assert column(data.where(p.is_partial_datetime(F.col("s")))) == sorted(good)


def test_composed_question(spark, revisions):
    found = revisions.where(p.trend_predicate("world", "2002", "2002-02-26", namespace=3))
    assert column(found, "rev_id") == [501]
    found = revisions.where(p.trend_predicate(p.phrase("added", "world"), end="2003"))
    assert column(found, "rev_id") == [501, 502]
    assert column(revisions.where(p.trend_predicate("bye", field="removed")), "rev_id") == [501]
    with pytest.raises(ValueError):
        p.trend_predicate("x", start="20060101")


def test_absent_user(revisions):
    assert column(revisions.where(p.term("user_id", None)), "rev_id") == [501]


def test_pushdown(spark, tmp_path, revisions):
    """Comparisons and substring tests reach the Parquet reader."""
    path = str(tmp_path / "r")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    revisions.write.parquet(path)
    stored = spark.read.parquet(path)
    tests = p.all_of(p.phrase("added", "x"), p.ts_range("2002", "2003"), p.term("namespace", 3))
    plan = stored.where(tests).select("rev_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for name in ("StringContains(added", "GreaterThanOrEqual(timestamp", "LessThan(timestamp", "EqualTo(namespace"):
        assert name in pushed
    assert "hunks" not in pushed


def test_impossible_days_are_refused():
    for bound in ("2006-02-31", "2006-13", "2006-02-30T10", "soon"):
        with pytest.raises(ValueError):
            p.trend_predicate("x", bound)
    for bound in ("2006", "2006-2", "2008-02-29", "2006-02-28T10:00:00Z"):
        assert p.names_real_time(bound)
