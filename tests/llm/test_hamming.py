import math

import numpy as np
import pytest

from editwake.llm import hamming
from editwake.llm import queries
from editwake.llm.hamming import Codes, band_edges, learn_rotations, near_vectors, tables_for
from oracle import same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """Links and components by plain comparison."""
    n = len(rows)
    up, links = list(range(n)), [0] * n

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    def sound(v):
        return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    units = [np.array(v, dtype=np.float32).astype(float) if sound(v) else None for _, v, _ in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    for i in range(n):
        for j in range(i):
            alike = rows[i][2] == rows[j][2] is not None and len(rows[i][1] or ()) == len(rows[j][1] or ())
            if units[i] is not None and units[j] is not None and alike:
                if units[i] @ units[j] >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[max(top(i), top(j))] = min(top(i), top(j))
    small = {}
    for i in range(n):
        small[top(i)] = min(small.get(top(i), rows[i][0]), rows[i][0])
    return sorted((r[0], links[i], small[top(i)], r[0] == small[top(i)]) for i, r in enumerate(rows))


def groups(seed, sizes, spread, size=32):
    rng = np.random.default_rng(seed)
    rows = []
    for g, count in enumerate(sizes):
        base = rng.standard_normal(size)
        for _ in range(count):
            v = base + spread * rng.standard_normal(size)
            rows.append([float(np.float32(x)) for x in v])
    rng.shuffle(rows)
    return [(i, list(map(float, v)), int(i % 2)) for i, v in enumerate(rows)]


def result(spark, rows):
    return sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 16)
    monkeypatch.setattr(hamming, "MISSED", 1e-7)
    rows = groups(1, [1] * 40 + [3, 8, 90], 0.11)
    want = brute(rows)
    assert max(r[1] for r in want) > 20
    assert result(spark, rows) == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(400):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * g, a.tolist(), 0), (2 * g + 1, (0.981 * a + math.sqrt(1 - 0.981**2) * b).tolist(), 0)]
    found = sum(r[1] for r in result(spark, rows)) / sum(r[1] for r in brute(rows))
    assert found >= 0.99


def test_odd_rows(spark):
    v = [0.1] * 8
    rows = [(0, None, 1), (1, [0.0] * 8, 1), (2, [None] + v[1:], 1), (3, [math.nan] + v[1:], 1), (4, [math.inf] + v[1:], 1)]
    rows += [(5, v, None), (6, v, 1), (7, v, 1), (7, v, 1), (8, v, 2), (9, [x * 3 for x in v], 1), (10, [-x for x in v], 1), (11, [], 1)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows[:5]) == brute(rows[:5])


def test_empty_table(spark):
    assert result(spark, []) == []


def test_rotation_lowers_the_error_and_balances():
    rng = np.random.default_rng(0)
    sample = rng.standard_normal((2000, 16)) * np.linspace(0.2, 3, 16) + 5
    mean = sample.mean(axis=0)
    (rotation,) = learn_rotations(sample, mean, 1)
    projected = (sample - mean) @ rotation
    assert np.allclose(rotation.T @ rotation, np.eye(16))
    assert abs((projected >= 0).mean(axis=0) - 0.5).max() < 0.1
    first = np.linalg.svd(sample - mean, full_matrices=True)[2].T
    error = [((p - np.where(p >= 0, 1, -1)) ** 2).sum() for p in (projected, (sample - mean) @ first)]
    assert error[0] < error[1]
    assert tables_for(math.acos(0.98), 10) == 13


def test_lengths_are_compared_apart(spark):
    """Each length has an index of its own, however few rows have it."""
    rows = groups(6, [1] * 30 + [4, 9], 0.05, size=8)
    few = [(1_000, [1.0, 2.0, 3.0, 4.0], 1), (1_001, [1.0, 2.0, 3.0, 4.0], 1), (1_002, [1.0, 2.0, 3.0, 4.1], 1), (1_003, [2.0], 0)]
    found = result(spark, rows + few)
    assert found == brute(rows + few)
    assert [r[1] for r in found if r[0] >= 1_000] == [2, 2, 2, 0]


def test_a_pair_is_posted_in_the_band_of_its_shorter_vector():
    """However long what centring leaves of them, vectors of a pair at the threshold share that band."""
    rng = np.random.default_rng(7)
    edges = band_edges(0.98)
    assert edges[0] == 0 and edges[1] >= 0.2
    for common in (0.0, 0.5, 0.9, 0.97, 0.99):
        a = rng.standard_normal((500, 16))
        a[:, 0] += math.sqrt(common / (1 - common) * 16)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((500, 16))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        codes = Codes(a, 0.98, 16)
        sides = [codes.lengths(v) for v in (a, b)]
        shorter = codes.own(np.minimum(*sides))
        for k, band in enumerate(shorter):
            assert all(codes.posted(side[k : k + 1], band)[0] for side in sides)
            if band:
                x, y = a[k] - codes.mean, b[k] - codes.mean
                angle = math.acos(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
                assert angle <= 2 * math.asin(codes.chord / (2 * edges[band])) + 1e-9


def test_planted_links_as_sql(spark, tmp_path):
    """The registered SQL over vectors with links, a common direction, several lengths and odd rows."""
    rows = groups(8, [1] * 20 + [2, 3, 5], 0.06, size=12)
    rows = [(i, [x + 1.5 for x in v], label) for i, v, label in rows]
    rows += [(100, rows[3][1], rows[3][2]), (101, [1.0, 2.0], 1), (102, [2.0, 4.0], 1), (103, None, 1), (104, [0.0] * 12, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    found = same_as_sql(spark, queries, "op4_embedding_near_dedup", tmp_path)
    assert sum(r[3] for r in found) > 20


@pytest.mark.parametrize("common", [0.6, 0.8, 0.94])
def test_recall_with_a_common_direction(spark, common):
    rng = np.random.default_rng(3)
    mean = np.zeros(64)
    mean[0] = math.sqrt(common)
    rows = []
    for g in range(400):
        a, b = rng.standard_normal((2, 64))
        a[0] = b[0] = 0
        a = mean + math.sqrt(1 - common) * a / np.linalg.norm(a)
        b -= (a @ b) / (a @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * g, a.tolist(), 0), (2 * g + 1, (0.981 * a + math.sqrt(1 - 0.981**2) * b).tolist(), 0)]
    found = sum(r[1] for r in result(spark, rows)) / sum(r[1] for r in brute(rows))
    assert found >= 0.99
