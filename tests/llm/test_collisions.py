import random
from itertools import combinations

import numpy as np
import pytest

from editwake.llm import collisions
from editwake.llm.collisions import drop_near_duplicates, matches_for, near_duplicates
from editwake.llm.components import connected


def set_of(text, words):
    found = [w for w in (text or "").encode().lower().split()]
    if not found:
        return frozenset()
    size = min(words, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def brute(rows, words, percent):
    """Component by plain comparison of all pairs of different sets."""
    sets = [set_of(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[top(k)] = min(smallest.get(top(k), i), i)
    return sorted((i, len(sets[k]), smallest[top(k)], i == smallest[top(k)]) for k, (i, _) in enumerate(rows))


def families(seed, sizes, length=120, rates=(0.0, 0.02, 0.05, 0.1, 0.2)):
    """Families of copies with changed words, as in a group of near copies."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(length // 2, length))]
        for _ in range(size):
            rate = rng.choice(rates)
            words = [f"x{rng.randrange(10**6)}" if rng.random() < rate * rng.random() else w for w in base]
            rows.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(docs, **options).collect())


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_as_brute_force(spark, monkeypatch, words, percent):
    monkeypatch.setattr(collisions, "BLOCK", 16)
    rows = families(words, [1] * 20 + [2, 2, 3, 5, 9, 70])
    assert result(spark, rows, words=words, percent=percent) == brute(rows, words, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É one two"), (8, "é one two")]
    rows += [(9, long), (10, long + " end"), (10, long + " end"), (11, "a b c d"), (11, "e f g h")]
    assert result(spark, rows, words=3, percent=85) == brute(rows, 3, 85)
    assert result(spark, rows[:3], words=3, percent=85) == brute(rows[:3], 3, 85)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 2, 3)], "doc_id long, text string, node int, component_id int")
    assert [tuple(r) for r in near_duplicates(docs).collect()] == [(1, 1, 1, True)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_passages_that_many_share(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(10, 40))) + " " + passage) for i in range(150)]
    assert result(spark, rows, words=3, percent=85) == brute(rows, 3, 85)


@pytest.mark.parametrize("size", [1, 7, 500_000])
def test_intersections_in_ranges(monkeypatch, size):
    monkeypatch.setattr(collisions, "RANGE", size)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(values, n)) for n in (1, 5, 20, 40, 60, 3)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = collisions._intersections(sets)
    assert all(got[i][j] == w for i, row in enumerate(want) for j, w in enumerate(row) if w is not None)


def test_matches_leave_few_out():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 850, dtype=np.uint64)
    agree = []
    for _ in range(50):
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 75, dtype=np.uint64)]) for _ in "ab")
        agree.append((collisions.signature(collisions.mixed(a)) == collisions.signature(collisions.mixed(b))).sum())
    assert min(agree) >= matches_for(0.85) and abs(np.mean(agree) - 64 * 0.85) < 2
    assert matches_for(0.85) == 41


def test_components_of_paths_hubs_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 3), (3, 7), (500, 501), (500, 500)]
    found = connected(spark.createDataFrame(links, "x long, y long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {500: 500, 501: 500}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert connected(spark.createDataFrame([], "x long, y long")).collect() == []


def test_rows_without_an_id_keep_their_links(spark):
    """Classes of null ids alone have their sets made from their texts."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:30], "changed", *words[31:]])
    rows = [(None, " ".join(words)), (None, " ".join(words)), (None, near), (None, "quite another text of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert drop_near_duplicates(docs).count() == 2
    found = near_duplicates(docs.unionAll(spark.createDataFrame([(5, near + " more")], docs.schema))).collect()
    assert sorted(str(r["component_id"]) for r in found) == ["5", "5", "5", "5", "None"]
