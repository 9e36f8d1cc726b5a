import re
from random import Random

import pytest
from conftest import column
from pyspark.sql import functions as F

from editwake.functions import predicates as p
from editwake.operators import batch
from editwake.schema import CLAUSE
from editwake.session import work_path
from editwake.sources.revision_table import read_revisions, write_revisions


def clause(query, number, occur, field, kind, value=None, lo=None, hi=None):
    return (query, number, occur, field, kind, value, lo, hi)


def saved_queries():
    """Clauses of saved queries, and the predicate each stands for."""
    return {
        1: ([clause(1, 0, "must", "added", "phrase", "world")], p.phrase("added", "world")),
        2: (
            [
                clause(2, 0, "must", "added", "phrase", "Hell"),
                clause(2, 1, "must_not", "namespace", "term", "3"),
            ],
            p.phrase("added", "Hell") & p.none_of(p.term("namespace", 3)),
        ),
        3: (
            [
                clause(3, 0, "should", "rev_id", "term", "501"),
                clause(3, 1, "should", "title", "phrase", "Other"),
            ],
            p.any_of(p.term("rev_id", 501), p.phrase("title", "Other")),
        ),
        4: ([clause(4, 0, "must", "added", "wildcard", "[[?")], p.wildcard("added", "[[?", 3)),
        5: ([clause(5, 0, "must", "action", "wildcard", "*dit*")], p.wildcard("action", "*dit*")),
        6: ([clause(6, 0, "must", "rev_id", "range", lo="502", hi="1000")], p.value_range("rev_id", 502, 1000)),
        7: ([clause(7, 0, "must", "timestamp", "range", hi="2002-02-26")], p.ts_range(hi="2002-02-26")),
        8: ([clause(8, 0, "must_not", "minor", "term", "True")], p.none_of(p.term("minor", True))),
        9: ([clause(9, 0, "must", "user_id", "term", "42")], p.term("user_id", 42)),
        10: ([clause(10, 0, "must_not", "user_id", "term", "42")], p.none_of(p.term("user_id", 42))),
        11: (
            [
                clause(11, 0, "must", "added", "phrase", "world"),
                clause(11, 1, "should", "added", "phrase", "not there at all"),
            ],
            p.phrase("added", "world"),
        ),
        12: ([clause(12, 0, "should", "added", "phrase", "not there at all")], F.lit(False)),
    }


@pytest.mark.parametrize("per_pass", [10_000, 3])
@pytest.mark.parametrize("keys_per_pass", [10_000, 2])
def test_saved_queries_equal_single_queries(spark, revisions, per_pass, keys_per_pass):
    queries = saved_queries()
    rows = [c for clauses, _ in queries.values() for c in clauses]
    saved = spark.createDataFrame(rows, CLAUSE)
    found = batch.match_saved_queries(revisions, saved, 3, per_pass, keys_per_pass)
    got = sorted((r.query_id, r.rev_id) for r in found.collect())
    wanted = [
        (number, rev_id)
        for number, (_, predicate) in queries.items()
        for rev_id in column(revisions.where(predicate), "rev_id")
    ]
    assert got == wanted


def test_keys_lose_nothing(spark):
    random = Random(5)
    texts = ["".join(random.choice("aabb ") for _ in range(60)) for _ in range(50)]
    phrases = [t[i : i + n] for t in texts[:20] for i, n in ((3, 8), (0, 20), (30, 25), (10, 5))]
    names = [f for f in CLAUSE.names]
    saved = spark.createDataFrame(
        [clause(i, 0, "must", "added", "phrase", x) for i, x in enumerate(phrases)], CLAUSE
    ).select(names)
    rows = [(i, t) for i, t in enumerate(texts)]
    edits = spark.createDataFrame(rows, "rev_id long, added string")
    blank = {n: F.lit("") for n in ("removed", "comment", "title", "user_text", "action")}
    blank |= {n: F.lit(0) for n in ("page_id", "namespace", "user_id", "added_size", "removed_size")}
    edits = edits.withColumns(blank | {"minor": F.lit(False), "timestamp": F.timestamp_seconds(F.lit(0))})
    wanted = sorted((q, i) for q, x in enumerate(phrases) for i, t in rows if x in t)
    found = batch.match_saved_queries(edits, saved)
    assert sorted((r.query_id, r.rev_id) for r in found.collect()) == wanted
    # As alternatives, each revision still counts once, copies of it as often as they come.
    either = saved.withColumns({"occur": F.lit("should"), "query_id": F.lit(7).cast("long")})
    twice = edits.unionAll(edits)
    found = sorted(r.rev_id for r in batch.match_saved_queries(twice, either).collect())
    assert found == sorted(2 * list({i for _, i in wanted}))


def test_bounds_and_expressions(spark, revisions):
    cases = {
        1: (clause(1, 0, "must", "namespace", "range", lo="x", hi="y"), []),
        2: (clause(2, 0, "must", "namespace", "range", lo="x"), []),
        3: (clause(3, 0, "must", "namespace", "range", lo="1"), [501]),
        4: (clause(4, 0, "must", "action", "regexp", "add"), []),
        5: (clause(5, 0, "must", "action", "regexp", "add.*|both"), [501, 502]),
        6: (clause(6, 0, "must", "added", "regexp", "w[aeiou]r"), [501, 502]),
        7: (clause(7, 0, "must", "title", "prefix", "San"), [501]),
        8: (clause(8, 0, "must", "action", "prefix", "bo"), [501]),
        9: (clause(9, 0, "must", "added", "wildcard", "four"), []),
    }
    found = batch.match_saved_queries(revisions, spark.createDataFrame([c for c, _ in cases.values()], CLAUSE))
    assert sorted((r.query_id, r.rev_id) for r in found.collect()) == [(q, i) for q, (_, ids) in cases.items() for i in ids]


def test_wildcards_as_columns(spark):
    """Expressions made of Column code are those of the predicate, for patterns of all shapes."""
    random = Random(8)
    patterns = {"".join(random.choice("a.*?[") for _ in range(random.randrange(0, 6))) for _ in range(200)}
    saved = spark.createDataFrame([clause(1, i, "must", "added", "wildcard", x) for i, x in enumerate(patterns)], CLAUSE)
    texts = ["".join(random.choice("a.[b\n") for _ in range(random.randrange(0, 9))) for _ in range(60)]
    for n in (1, 3, 5):
        made = {r.value: r.expression for r in batch._with_expressions(saved, n).collect()}
        for x in patterns:
            wanted = re.compile(p.text_wildcard(x, n))
            assert [bool(re.search(made[x], t)) for t in texts] == [bool(wanted.search(t)) for t in texts], (x, n)


def edits_of(spark, rows):
    """Revisions with these ids and additions; other fields are blank."""
    edits = spark.createDataFrame(rows, "rev_id long, added string")
    blank = {n: F.lit("") for n in ("removed", "comment", "title", "user_text", "action")}
    blank |= {n: F.lit(0) for n in ("page_id", "namespace", "user_id", "added_size", "removed_size")}
    return edits.withColumns(blank | {"minor": F.lit(False), "timestamp": F.timestamp_seconds(F.lit(0))})


def test_phrases_without_an_inner_word_are_found_by_a_gram(spark):
    random = Random(9)
    rows = [(i, "".join(random.choice("abc ") for _ in range(80))) for i in range(60)] + [(None, "abcabcabca")]
    phrases = ["abca", "cab", "bb b", " aa", "cacacaca", "ab", "not there", "abc abc"]
    saved = spark.createDataFrame([clause(i, 0, "must", "added", "phrase", x) for i, x in enumerate(phrases)], CLAUSE)
    edits = edits_of(spark, rows)
    compiled = batch.compile_queries(saved, revisions=edits)
    # Only the phrase that is shorter than a gram has no key.
    assert [r.query_id for r in compiled.where("keys IS NULL").collect()] == [phrases.index("ab")]
    found = batch.match_saved_queries(edits, saved)
    wanted = sorted((q, str(i)) for q, x in enumerate(phrases) for i, t in rows if x in t)
    assert sorted((r.query_id, str(r.rev_id)) for r in found.collect()) == wanted


def test_long_revisions_meet_many_queries(spark):
    """Texts do not travel with their words: 20,000 different words each, in a plan without wide pairs."""
    words = [f"word{i}" for i in range(20_000)]
    rows = [(i, " ".join(words[i:] + words[:i])) for i in range(40)]
    saved = [clause(i, 0, "must", "added", "phrase", f"word{7 * i} word{7 * i + 1} word{7 * i + 2}") for i in range(50)]
    found = batch.match_saved_queries(edits_of(spark, rows), spark.createDataFrame(saved, CLAUSE))
    wanted = sum(f"word{7 * q} word{7 * q + 1} word{7 * q + 2}" in t for q in range(50) for _, t in rows)
    assert found.count() == wanted


def test_a_query_of_any_length_is_answered(spark, monkeypatch):
    monkeypatch.setattr(batch, "BYTES_PER_PASS", 200)
    saved = [clause(1, i, "should", "comment", "phrase", f"no{i}" * 10) for i in range(40)]
    saved += [clause(1, 99, "should", "added", "phrase", "x"), clause(2, 0, "must", "added", "phrase", "y")]
    found = batch.match_saved_queries(edits_of(spark, [(1, "ax"), (2, "by"), (3, "c")]), spark.createDataFrame(saved, CLAUSE))
    assert sorted((r.query_id, r.rev_id) for r in found.collect()) == [(1, 1), (2, 2)]


def test_only_named_fields_are_read(spark, revisions, tmp_path):
    path = str(tmp_path / "revisions")
    revisions.write.parquet(path)
    stored = spark.read.parquet(path)
    for saved, read in (
        (clause(1, 0, "must", "namespace", "term", "3"), {"rev_id", "timestamp", "namespace"}),
        (clause(1, 0, "must", "added", "phrase", "one inner word"), {"rev_id", "timestamp", "added"}),
    ):
        found = batch.match_saved_queries(stored, spark.createDataFrame([saved], CLAUSE))
        plan = found._jdf.queryExecution().executedPlan().toString()
        schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
        assert {c.split(":")[0] for s in schemas for c in s.split(",")} == read


def test_unknown_fields_and_kinds_are_refused(spark, revisions):
    for saved in (clause(1, 0, "must", "colour", "term", "3"), clause(1, 0, "must", "title", "sounds_like", "3")):
        with pytest.raises(ValueError):
            batch.match_saved_queries(revisions, spark.createDataFrame([saved], CLAUSE))
    assert batch.match_saved_queries(revisions, spark.createDataFrame([], CLAUSE)).collect() == []


def test_terms_inside_others(spark):
    rows = [
        (1, "added", "help"), (1, "added", "hel"), (1, "added", "elp"), (1, "added", "e"),
        (1, "title", "hel"), (2, "added", "me"), (2, "added", "help me"), (2, "added", "help me"),
        (3, "added", "x"),
    ]
    data = spark.createDataFrame(rows, "query_id int, field string, value string")
    found = sorted(tuple(r) for r in batch.prune_contained_terms(data).collect())
    assert found == [
        (1, "added", "elp"), (1, "added", "help"), (1, "title", "hel"),
        (2, "added", "help me"), (2, "added", "me"), (3, "added", "x"),
    ]


def test_terms_against_brute_force(spark):
    random = Random(4)
    terms = {(random.randrange(3), "".join(random.choice("ab") for _ in range(random.randrange(1, 7)))) for _ in range(60)}
    data = spark.createDataFrame([(q, "added", v) for q, v in terms], "query_id int, field string, value string")
    wanted = sorted(
        (q, v) for q, v in terms if not any(q == o and v in w[:-1] for o, w in terms)
    )
    assert sorted((r.query_id, r.value) for r in batch.prune_contained_terms(data).collect()) == wanted


def test_groups_of_terms_of_any_size_and_marks(spark, monkeypatch):
    """Small groups are one row each; large ones and those with the mark go by windows, with the same rows."""
    random = Random(5)
    words = ["".join(random.choice("ab\u0001" if q == 2 else "abé") for _ in range(random.randrange(0, 6))) for q in range(3) for _ in range(40)]
    terms = {(i // 40, w) for i, w in enumerate(words)} | {(None, "a"), (None, "ab b"), (1, None)}
    data = spark.createDataFrame([(q, "added", v) for q, v in terms], "query_id int, field string, value string")
    wanted = {
        (q, v) for q, v in terms
        if not (q is not None and v and any(q == o and w is not None and v in w[:-1] for o, w in terms))
    }
    made = []
    windows = batch._prune_by_windows
    monkeypatch.setattr(batch, "_prune_by_windows", lambda rows, by: made.append(rows.distinct().count()) or windows(rows, by))
    for most in (0, 100, 2**16):
        found = batch.prune_contained_terms(data, group_bytes=most).collect()
        assert len(found) == len(wanted) and {(r.query_id, r.value) for r in found} == wanted
    assert made[0] >= made[1] > made[2] and made[2] < len(terms) / 2


def test_bounded_queries_read_ranges_of_their_time(spark, revisions):
    path = work_path(spark, "stored")
    write_revisions(revisions, path, width=1)
    stored = read_revisions(spark, path)
    rows = [clause(1, 0, "must", "added", "phrase", "wor"), clause(1, 1, "must", "timestamp", "range", lo="2002-02-26", hi="2003")]
    cases = [
        (rows, [502], True),
        (rows + [clause(2, 0, "must", "added", "phrase", "wor")], [501, 502, 502], False),
        (rows[:1] + [clause(1, 1, "must", "timestamp", "range", lo="x", hi="y")], [], False),
    ]
    for clauses, ids, pruned in cases:
        found = batch.match_saved_queries(stored, spark.createDataFrame(clauses, CLAUSE))
        assert sorted(r.rev_id for r in found.collect()) == ids
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert bool(re.search(r"PartitionFilters: \[[^\]]*id_range#\d+ (IN|=)", plan)) == pruned
