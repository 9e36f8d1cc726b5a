import math
import re
from collections import Counter

import pytest

from editwake.llm import queries
from editwake.llm.quality import START, Rates, counts_of, estimate, judge

DATA = "/root/testdata/sf0.01"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


ODD = [
    None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "a b a b a b x a b", "x\nx\n\nx \n x", "😀# é|\x0b\x0c\r\n*", "a\x85b c",
    " lead a b c\tb c a b c ", "one\r\none\r\n", "w " * 30_000,
]


def test_counts_as_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r.id: tuple(r[c] for c in columns) for r in counts_of(docs).collect()}
    assert found == {i: counted(t) for i, t in rows}


def test_query_as_plain_python_and_labels(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.QUERIES["op2_quality_rules"](spark, DATA).collect()
    assert len(found) == len(docs)
    for r in found:
        want = counted(docs[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in found if r.doc_id in labels and not r.base_failed]
    assert sum(q == k for q, k in judged) / len(judged) > 0.98


def test_estimates_as_plain_python(spark):
    names = ["a", "b", "c"]
    rows = [(1, 1, 1, 50), (-1, -1, -1, 20), (-1, -1, 1, 9), (1, 1, -1, 8), (0, 1, 1, 5), (-1, 0, 0, 4)]
    rates = estimate(spark.createDataFrame(rows, "a int, b int, c int, n long"), names)
    share, good, bad = START, [START] * 3, [START] * 3
    for _ in range(30):
        post = []
        for *v, _ in rows:
            odds = math.log(share / (1 - share))
            for x, g, b in zip(v, good, bad):
                odds += {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0}[x]
            post.append(1 / (1 + math.exp(-odds)))
        sums = lambda want, weight: sum(n * weight(p) for (*v, n), p in zip(rows, post) if want(v))
        new_good = [(sums(lambda v: v[i] == 1, lambda p: p) + 1) / (sums(lambda v: v[i] != 0, lambda p: p) + 2) for i in range(3)]
        new_bad = [(sums(lambda v: v[i] == -1, lambda p: 1 - p) + 1) / (sums(lambda v: v[i] != 0, lambda p: 1 - p) + 2) for i in range(3)]
        share, good, bad = (sums(lambda v: True, lambda p: p) + 1) / (sum(r[3] for r in rows) + 2), new_good, new_bad
    assert rates.share == pytest.approx(share, abs=1e-3)
    assert rates.good == pytest.approx(good, abs=1e-3) and rates.bad == pytest.approx(bad, abs=1e-3)
    assert isinstance(rates, Rates) and good[0] > 0.9


def test_odd_rows_are_judged(spark):
    rows = [(None, t, 1) for t in ODD] + [(1, "a b c", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = judge(docs).collect()
    assert len(found) == len(rows) and not any(r.kept for r in found if r.n_words < 50)
    assert judge(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op2_quality_rules"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
