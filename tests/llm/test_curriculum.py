import re

import pytest

from editwake.llm import curriculum, queries
from editwake.llm.curriculum import mix, mixed_documents, positions, reached
from oracle import same_as_sql
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_as_sql(spark, sf):
    same_as_sql(spark, queries, "op5_source_mixing", f"/root/testdata/{sf}")


def test_taken_words_come_near_their_targets(spark):
    places = mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    taken, size = {}, {}
    for r in places:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size * r.n
        size[r.source] = max(size.get(r.source, 0), r.size * r.n)
    for r in places:
        assert r.copies <= 3
        assert abs(taken[r.source] - r.target) <= max(size[r.source], 1)
    assert sum({r.source: r.target for r in places}.values()) == pytest.approx(sum({r.source: r.source_size for r in places}.values()))


def test_caps_nulls_and_repeats(spark):
    rows = [(i, "w " * 10, "a") for i in range(20)] + [(100, "x", "b"), (101, None, "b"), (102, "y z", None), (102, "y z", None), (None, "q", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(7))
    places = {(r.id, r.source): r for r in mix(docs).collect()}
    # 206 words in four sources weighing 1, 2, 3, 1: all but the first stop at 3 times their words.
    assert places[100, "b"].target == 3 and places[None, "c"].target == 3 and places[102, None].target == 12
    assert places[0, "a"].target == 206 - 18
    assert places[100, "b"].copies == 3 and places[101, "b"].copies == 0 and places[102, None].n == 2
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert sum(r.doc_id == 102 for r in found) == 6 and sum(r.doc_id is None for r in found) == 3
    assert sum(r.source == "a" for r in found) in (18, 19)
    assert mix(docs.limit(0)).collect() == [] and mixed_documents(docs.limit(0)).collect() == []


def test_positions_follow_the_integrals_of_the_schedules(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    timed = positions(mix(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [r.position for r in timed] == sorted(r.position for r in timed)
    for source in "abc":
        own = [r for r in timed if r.source == source]
        slope, target = own[0].slope, own[0].target
        for t in (0.25, 0.5, 0.75):
            early = sum(r.size for r in own if r.position < t)
            assert early / target == pytest.approx((1 - slope) * t + slope * t * t, abs=0.02)
    assert spark.range(1).select(reached(F.lit(1.0), F.lit(0.5)), reached(F.lit(0.0), F.lit(-0.5))).first()[:] == (1.0, 0.0)


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op5_source_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_query_comes_from_positions_in_training_order(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    timed = positions(mix(spark.read.parquet(f"{folder}/documents.parquet"))).collect()
    first = {}
    for r in timed:
        first.setdefault(r.id, r.position)
    rows = queries.QUERIES["op5_source_mixing"](spark, folder).collect()
    found = [first.get(r.doc_id, 2.0) for r in rows]
    assert found == sorted(found) and 0 < found.count(2.0) < len(found)
    # Without positions nothing is taken.
    monkeypatch.setattr(curriculum, "positions", lambda mixed: positions(mixed).where("position < 0"))
    assert {r.taken for r in queries.QUERIES["op5_source_mixing"](spark, folder).collect()} == {0}
