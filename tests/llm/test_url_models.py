import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from editwake.llm import queries, url_models
from editwake.llm.url_models import FOLDS, ORDER, RULES, fit, judge

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(url):
    """Host, path and all after the host, by hand."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop], tail


def ruled(host, path):
    best = None
    for verdict, rule in RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best or (None, None)


class Plain:
    """The same model with exact counts."""

    def __init__(self, texts):
        self.next = defaultdict(Counter)
        for text in texts:
            signs = [*text, 0]
            for i, c in enumerate(signs):
                for order in range(ORDER + 1):
                    self.next[order, bytes(signs[max(0, i - order) : i]), min(i, order)][c] += 1

    def log(self, text):
        total, signs = 0.0, [*text, 0]
        for i, c in enumerate(signs):
            p = 1 / 257
            for order in range(ORDER + 1):
                seen = self.next.get((order, bytes(signs[max(0, i - order) : i]), min(i, order)))
                if seen:
                    p = (seen[c] + len(seen) * p) / (seen.total() + len(seen))
            total += math.log(p)
        return total


def test_query_as_plain_python(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = {r.page_id: r for r in queries.QUERIES["op7_url_filter"](spark, DATA).collect()}
    assert rows.keys() == urls.keys()
    examples = {"allow": [], "block": []}
    for i, url in urls.items():
        host, path, tail = cut(url)
        verdict, rule = ruled(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert verdict is None or rows[i].verdict == verdict
        if verdict and host and zlib.crc32(url.encode()) % FOLDS:
            examples[verdict].append((host + tail).encode())
    ratio = fit(spark.read.parquet(f"{DATA}/pages.parquet"))
    accepted, rejected = Plain(examples["allow"]), Plain(examples["block"])
    texts = [(cut(u)[0] + cut(u)[2]).encode() for u in urls.values()]
    want = [(rejected.log(t) - accepted.log(t)) / (len(t) + 1) for t in texts]
    got = ratio.differences(texts)
    assert np.abs(got - want).max() < 1e-9
    held = {"allow": [], "block": []}
    for (i, url), d in zip(urls.items(), want):
        host, path, _ = cut(url)
        verdict = ruled(host, path)[0]
        if verdict and host and not zlib.crc32(url.encode()) % FOLDS:
            held[verdict].append(d)
    # The edges of the bins with the least sum of the two error rates, and their middle.
    edges = [(b + 1) * 2 * url_models.REACH / url_models.BINS - url_models.REACH for b in range(url_models.BINS)]
    wrong = [round(np.mean(np.array(held["allow"]) >= e) + np.mean(np.array(held["block"]) < e), 9) for e in edges]
    least = [e for e, w in zip(edges, wrong) if w == min(wrong)]
    threshold = (least[0] + least[-1]) / 2
    assert ratio.threshold == pytest.approx(threshold, abs=1e-9)
    for (i, url), d in zip(urls.items(), want):
        if rows[i].rule is None and cut(url)[0]:
            assert rows[i].verdict == ("block" if d > threshold else "allow")


def test_held_out_verdicts(spark):
    """URLs of two kinds that share hosts are told apart by their looks."""
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pages = []
    for i in range(3000):
        bad = i % 2
        site = word("zxqkv", 9) if bad else word("aeioust", 9)
        pages.append((i, f"https://{site}.com/{'x9/' if bad else ''}{word('ab', 4)}"))
    rules = (("allow", "com/"), ("block", "com/x9/"))
    judged = pages + [(5000 + k, f"http://{word('zxqkv', 9)}.org/{word('ab', 4)}") for k in range(100)]
    judged += [(6000 + k, f"http://{word('aeioust', 9)}.org/{word('ab', 4)}") for k in range(100)]
    frame = spark.createDataFrame(judged, "page_id long, url string")
    ratio = fit(frame, rules=rules)
    rows = {r.page_id: r.verdict for r in judge(frame, ratio, rules=rules).collect()}
    assert sum(rows[5000 + k] == "block" for k in range(100)) >= 95
    assert sum(rows[6000 + k] == "allow" for k in range(100)) >= 95


ODD = [
    None, "", "http://", "no scheme/com/", "HTTP://WWW.Example.COM/EN/a", "http://www.example.com/en/é?x", "a://b://c/d", "http://x.com", "http://x.com?y=/",
    "http://net/es/", "http://a.net/es/x#y", "http://anet/es/", "http://a\nb.net/fr/\nq", "x" * 50_000 + "://y.com/" + "z" * 50_000, "http://İ.com/",
]


@pytest.mark.parametrize("urls", [ODD, ["http://a.com/x"], ["http://a.net/es/"], []])
def test_odd_rows(spark, urls):
    rows = [(i, u, "x") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = judge(pages, fit(pages)).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, _ = cut(urls[r.page_id])
        verdict, rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert host or r.verdict == "allow"


def test_threshold_is_where_errors_are_least():
    rows = [{"model": 0, "bin": b, "n": n} for b, n in ((10, 5), (20, 90), (40, 5))]
    rows += [{"model": 1, "bin": b, "n": n} for b, n in ((15, 2), (30, 98))]
    edge = lambda b: (b + 1) * 2 * url_models.REACH / url_models.BINS - url_models.REACH
    assert edge(20) <= url_models.calibrated(rows) < edge(30)
    assert url_models.calibrated([]) == 0.0


def test_counts_are_exact_for_millions_of_grams(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    pages = [(i, f"http://{'x' * (i % 2)}.com/{word(45)}") for i in range(12_000)]
    rules = (("allow", "com/"), ("block", "x.com/"))
    ratio = fit(spark.createDataFrame(pages, "page_id long, url string"), rules=rules)
    assert ratio.grams.count() > 2**20
    said = [(i % 2, url[7:].encode()) for i, url in pages if zlib.crc32(url.encode()) % FOLDS]
    texts = [t for _, t in said[:4]] + [f"{word(30)}.org/{word(9)}".encode() for _ in range(40)]
    plain = [Plain([t for kind, t in said if kind == m]) for m in (0, 1)]
    want = np.array([(plain[1].log(t) - plain[0].log(t)) / (len(t) + 1) for t in texts])
    assert np.abs(ratio.differences(texts) - want).max() < 1e-9
