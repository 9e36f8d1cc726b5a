"""Hard negatives, compared with SQL and with plain comparison of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from editwake.llm import negatives, queries
from editwake.llm.negatives import Index, descending, hard_negatives, products, visits
from oracle import same_as_sql

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, anchors):
    """Rows of the contract for some ids, by plain loops."""
    sound = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in sound:
        if i % anchors:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in sound if len(v) == len(w)
        )
        positives = [(j, -s) for s, j, other in scored if other == label and j != i][:5]
        for j, score in positives:
            fits = [(k, -s) for s, k, other in scored if other != label and 30 * score <= -100 * s <= 90 * score][:10]
            out += [(i, j, rank, k, score, s) for rank, (k, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchors=100):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("packed", F.lit(1))
    return sorted(map(tuple, hard_negatives(df.repartition(3), F.col("id") % anchors == 0).collect()))


def clustered(n, dims, labels, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    vectors = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dims))
    return [(i, int(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(vectors)]


def test_sequences_descend():
    one, two = np.array([3.0, 9.0, 1.0]), np.array([2.0, 2.0, 7.0, 0.0])
    found = list(descending(one, two))
    assert len({(i, j) for i, j, _ in found}) == 12
    assert [s for *_, s in found] == sorted((a + b for a in one for b in two), reverse=True)
    assert all(s == one[i] + two[j] for i, j, s in found)


def test_visits_leave_out_what_cannot_count():
    rng = np.random.default_rng(3)
    books = [rng.standard_normal((6, 2)), rng.standard_normal((5, 2))]
    index = Index(4, books)
    index.members[:] = 1
    index.members[2, 2] = 0
    vector = rng.standard_normal((1, 4))
    upper, lower = next(index.bounds(vector))
    scores = upper[0][:, None] + upper[1]
    # Without radii a cell is a point; bounds have room for rounding alone.
    found = visits(index, upper, lower, [0], [1], None)
    inside = {i * 5 + j for i in range(6) for j in range(5) if 0 <= scores[i, j] <= 1 and (i, j) != (2, 2)}
    assert inside == set(found)


def test_products_of_any_size():
    big = np.array([[2.0**40, -3.0], [2.0**62, 2.0**62]])
    assert products(big, big).tolist() == [
        [2**63 - 1, 2**63 - 1],
        [2**63 - 1, 2**63 - 1],
    ]
    assert products(np.array([[3.0, -2.0]]), np.array([[5.0, 7.0]])).tolist() == [[1]]
    assert products(np.array([[2.0**27, 1.0]]), np.array([[2.0**27, 1.0]])).tolist() == [[2**54 + 1]]


def test_same_as_sql(spark):
    found = same_as_sql(spark, queries, "op12_hard_negatives", "/root/testdata/sf0.001")
    assert found


@pytest.mark.parametrize("labels", [1, 3, 40])
def test_clusters_with_small_blocks(spark, monkeypatch, labels):
    """Labels of many vectors go through their cells, lists and visitors through several blocks."""
    rows = clustered(1_500, 6, labels)
    for name, value in (("BLOCK", 64), ("VISITORS", 8), ("PER_CELL", 8), ("PROBED", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows, anchors=50) == brute(rows, 50)


@pytest.mark.parametrize("labels", [1, 3])
def test_an_anchor_goes_to_a_shelf_once(spark, monkeypatch, labels):
    """What is sent of an anchor grows with the shelves and not with the many cells it visits."""
    rows = clustered(1_500, 6, labels)
    for name, value in (("BLOCK", 256), ("SHELF", 200), ("SENT", 3), ("PER_CELL", 4), ("PROBED", 2)):
        monkeypatch.setattr(negatives, name, value)
    sent, visiting = [], negatives._visiting

    def counted(*a):
        found = visiting(*a)
        sent.append(found.groupBy("node").count().agg(F.max("count")).first()[0] or 0)
        return found

    monkeypatch.setattr(negatives, "_visiting", counted)
    assert mined(spark, rows, anchors=50) == brute(rows, 50)
    # Of 361 cells with 1,500 vectors.
    assert len(sent) == 4 and 2 <= max(sent) <= 1 + 1_500 // 200


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.choice([-1.0, 0.25, 0.5, 0.5, 2.0]) for _ in range(3)]) for i in range(60)]
    rows += [(i, i % 2, [rng.random() for _ in range(2)]) for i in range(100, 130)]
    rows += [(200, None, [1.0, 1.0, 1.0]), (300, 1, None), (400, 1, []), (500, 1, [1.0, None, 1.0])]
    rows += [(600, 1, [float("nan"), 1.0, 1.0]), (700, 1, [float("inf"), 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(800, 1, [0.0, 0.0, 0.0]), (900, 2, [-5.0, -5.0, -5.0])]
    rows += [rows[4], rows[4], rows[7], rows[100 - 40]]
    want = brute(rows, 20)
    assert mined(spark, rows, anchors=20) == want
    assert want


def test_one_vector_many_times(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rows = [(i, i % 2, [0.5, 0.25]) for i in range(200)] + [(1_000 + i, 5, [0.3, 0.2]) for i in range(30)]
    assert mined(spark, rows, anchors=100) == brute(rows, 100)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
