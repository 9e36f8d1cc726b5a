import base64
import re

import pytest
from conftest import column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from editwake.functions import grams as g
from editwake.operators import postings as ps

M = 0x5BD1E995


def murmur(data: bytes, seed: int) -> int:
    """MurmurHash2 from its public description."""
    h = seed ^ len(data)
    while len(data) >= 4:
        k = int.from_bytes(data[:4], "little") * M & 0xFFFFFFFF
        k = (k ^ (k >> 24)) * M & 0xFFFFFFFF
        h = (h * M & 0xFFFFFFFF) ^ k
        data = data[4:]
    if data:
        h = (h ^ int.from_bytes(data, "little")) * M & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * M & 0xFFFFFFFF
    return h ^ (h >> 15)


def token(gram: str, seed: int) -> str:
    return base64.b64encode(murmur(gram.encode(), seed).to_bytes(4, "little")).decode()[:6]


def one(spark, text, expression):
    data = spark.createDataFrame([(text,)], "s string")
    return data.select(expression(F.col("s"))).first()[0]


def test_fixed_grams(spark):
    assert one(spark, "marimba", lambda s: g.ngrams(s, 3)) == ["mar", "ari", "rim", "imb", "mba"]
    assert one(spark, "ab", lambda s: g.ngrams(s, 3)) == []
    assert one(spark, "", lambda s: g.ngrams(s, 1)) == []
    assert one(spark, "a\nb", lambda s: g.ngrams(s, 2)) == ["a\n", "\nb"]


def test_ranged_grams_and_offsets(spark):
    offsets = [tuple(x) for x in one(spark, "abcde", lambda s: g.ngram_offsets(s, 3, 4))]
    assert offsets == [
        ("abc", 0, 3), ("abcd", 0, 4), ("bcd", 1, 4), ("bcde", 1, 5), ("cde", 2, 5),
    ]
    assert one(spark, "abc", lambda s: g.ngrams_range(s, 1, 6)) == [
        "a", "ab", "abc", "b", "bc", "c",
    ]


def test_hashed_grams_stop_at_the_first_overrun(spark):
    def tokens(text, low, high):
        return one(spark, text, lambda s: g.hashed_ngrams(s, low, high, 29))

    assert tokens("lamp", 1, 5) == [token(x, 29) for x in ("l", "la", "lam", "lamp")]
    wanted = ["mar", "mari", "ari", "arim", "rim", "rimb", "imb", "imba", "mba"]
    assert tokens("marimba", 3, 4) == [token(x, 29) for x in wanted]
    assert set(tokens("glow", 3, 4)) == {token(x, 29) for x in ("glo", "glow", "low")}
    assert tokens("ab", 3, 4) == []


def test_hashable_grams_read_whole_texts_unless_told(spark):
    text = "x" * 1500
    assert len(one(spark, text, lambda s: g.hashable_ngrams(s, 3, 3))) == 1498
    assert len(one(spark, text, lambda s: g.hashable_ngrams(s, 3, 3, max_chars=1024))) == 1022
    assert one(spark, " \t abc \n", lambda s: g.hashable_ngrams(s, 3, 3)) == ["abc"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), min_size=1, max_size=50), st.sampled_from([0, 29, -1]))
def test_grams_against_brute_force(spark, texts, seed):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = data.select(
        "s",
        g.ngrams(F.col("s"), 3).alias("fixed"),
        g.ngrams_range(F.col("s"), 2, 4).alias("ranged"),
        g.hashable_ngrams(F.col("s"), 2, 4).alias("hashable"),
        g.murmur2_32(F.col("s"), seed).alias("hash"),
        g.murmur2_32(F.col("s"), seed, 160).alias("short_hash"),
        g.gram_token(F.col("s"), seed).alias("token"),
    ).collect()
    for r in rows:
        s = r.s
        assert r.fixed == [s[i : i + 3] for i in range(len(s) - 2)]
        assert r.ranged == [
            s[i : i + n] for i in range(len(s)) for n in (2, 3, 4) if i + n <= len(s)
        ]
        trimmed = s.strip("".join(map(chr, range(33))))
        expected, stop = [], False
        for i in range(len(trimmed) + 1):
            for n in (2, 3, 4):
                stop = stop or i + n > len(trimmed)
                if not stop:
                    expected.append(trimmed[i : i + n])
        assert r.hashable == expected
        assert r.hash == r.short_hash == murmur(s.encode(), seed & 0xFFFFFFFF)
        assert r.token == token(s, seed & 0xFFFFFFFF)


def test_tokens_of_rows(spark):
    grams = ["abc", "äöü", "", "tide", "日本語語"]
    data = spark.createDataFrame([(x, x) for x in grams], "gram string, name string")
    found = {r.name: r.gram for r in g.with_gram_tokens(data, 4711, 4).collect()}
    assert found == {x: token(x, 4711) for x in grams}


def test_analyzer_settings(spark):
    assert one(spark, "abcd", g.analyze) == ["abc", "bcd"]
    assert one(spark, "abcd", lambda s: g.analyze(s, 3, 4)) == ["abc", "abcd", "bcd"]
    hashed = one(spark, "abcd", lambda s: g.analyze(s, 3, 4, 29))
    assert hashed == [token(x, 29) for x in ("abc", "abcd", "bcd")]
    assert one(spark, "abcd", g.identity_token) == ["abcd"]


TITLES = ["tide pool 1", "tide pool 2", "tide pool", "pool 1", "tide", "pool tide"]


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    data = spark.createDataFrame(list(enumerate(TITLES)), "rev_id long, title string")
    built = ps.build_postings(data, "title")
    path = str(tmp_path / "postings")
    ps.write_postings(built, path, buckets=4)
    for postings in (built, spark.read.parquet(path)):
        for text in ("tide pool", "pool 1", "ti", "nothing", "ide"):
            wanted = [i for i, t in enumerate(TITLES) if text in t]
            for rows in (1000, 3, 0):
                found = ps.postings_search(data, postings, text, "title", broadcast_ids=rows)
                assert column(found, "rev_id") == wanted
    plan = ps.of_grams(spark.read.parquet(path), ["tid"])._jdf.queryExecution().executedPlan()
    # The bucket of a literal is known when planning.
    assert re.search(r"bucket#\d+ = \d", plan.toString())
    candidates = ps.candidates(built, g.literal_ngrams("tide pool", 3))
    assert column(candidates) == [0, 1, 2]


def test_stored_postings(spark, tmp_path):
    data = spark.createDataFrame(list(enumerate(TITLES)), "rev_id long, title string")
    path = str(tmp_path / "postings")
    ps.write_postings(ps.build_postings(data, "title"), path)
    stored = spark.read.parquet(path)
    found = ps.postings_search(data, stored, "pool 1", "title")
    assert column(found, "rev_id") == [0, 3]


def test_hashed_postings(spark):
    data = spark.createDataFrame(list(enumerate(TITLES)), "rev_id long, title string")
    built = ps.build_postings(data, "title", analyze=g.analyzer(3, 4, 4711))
    assert column(ps.candidates(built, [token("tid", 4711)])) == [0, 1, 2, 4, 5]


def test_hashed_postings_count_revisions(spark):
    """Grams that share a hash count a revision once; grams are hashed in generated code, as rows."""
    rows = spark.createDataFrame([("same", 1), ("same", 1), ("same", 2)], "gram string, rev_id long")
    hashed = rows.withMetadata("gram", {"field": "title", "n": 3, "n_max": 4, "seed": 7})
    assert ps.gram_frequencies(hashed).first()["revisions"] == 2
    built = ps.build_postings(spark.createDataFrame([(1, "tide")], "rev_id long, title string"), "title", analyze=g.analyzer(3, 4, 7))
    assert "lambda" not in built._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_tokens_counted_by_row(spark):
    """Keys with several rows, null keys, and grams that share a token count once."""
    # Of two bytes and of three, the last zero: MurmurHash2 cannot tell these apart.
    assert token("ab", 5) == token("`b\0", 5)
    rows = [(1, "ab`b\0x"), (2, "abxab"), (3, "y`b\0x"), (3, "zab"), (None, "abab"), (4, ""), (5, None)]
    for texts in (rows, rows[:3], [*rows[1:], (2, "ab")]):
        data = spark.createDataFrame(texts, "doc_id long, text string")
        listed = data.select("doc_id", g.hashable_ngrams(F.col("text"), 2, 3).alias("grams"))
        pairs = [
            (token(t[i : i + n], 5), k) for k, t in texts if t for i in range(len(t)) for n in (2, 3) if i + n <= len(t)
        ]
        wanted = {
            x: (sum(t == x for t, _ in pairs), len({k for t, k in pairs if t == x and k is not None}))
            for x, _ in pairs
        }
        found = {r.token: (r.occurrences, r["keys"]) for r in ps.token_counts(listed, "doc_id", 5, 3).collect()}
        assert found == wanted


def test_tokens_are_counted_without_pairs(spark):
    """Pairs of document and gram were shuffled and hashed, nine bytes for each of the text."""
    listed = spark.createDataFrame([(1, ["ab"]), (2, ["ab"])], "doc_id long, grams array<string>")
    plan = ps.gram_counts(listed, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#\d+[L, ]*\d+\)", plan) == ["gram"]


def test_blocks_of_long_texts(spark):
    """Texts of several blocks and a rest of each size; only what surrounds the text is trimmed."""
    for size in range(14, 52):
        text = "".join(chr(97 + i * i % 23) if i % 5 else "\U0001f600" for i in range(size))
        for low, high in ((2, 3), (3, 3), (1, 9)):
            wanted = [(text[i : i + n], i, i + n) for i in range(size) for n in range(low, high + 1) if i + n <= size]
            if size % 6 == 0 or (low, high) == (2, 3) and size % 2:
                assert [tuple(x) for x in one(spark, text, lambda s: g.ngram_offsets(s, low, high))] == wanted
    assert one(spark, "abc \u2028", lambda s: g.hashable_ngrams(s, 5, 5)) == ["abc \u2028"]


def test_places_are_cut_and_told_in_batches(spark, monkeypatch):
    """Each gram and its text went through interpreted lambdas; pieces may end inside a text."""
    import pyarrow as pa

    texts = [None, "", "a", "a\U0001f600\n\u2028", "\u00e4b|c@1", "xyz" * 7]
    told = [
        t if t is None else "|".join(f"{t[i : i + n]}@{i}-{i + n}" for i in range(len(t)) for n in (2, 3) if i + n <= len(t))
        for t in texts
    ]
    for piece in (1, 5, 100):
        monkeypatch.setattr(g.gram_arrays, "PIECE", piece)
        cut = g.gram_arrays.placed(pa.array(["zzz", *texts]).slice(1), 2, 3)
        assert g.gram_arrays.told(cut).to_pylist() == told
    data = spark.createDataFrame([(t,) for t in texts], "s string")
    made = data.select(g.offsets_text(g.ngram_offsets(F.col("s"), 2, 3)).alias("told"))
    assert [r.told for r in made.collect()] == told
    assert "lambda" not in re.sub("<lambda>", "", made._jdf.queryExecution().optimizedPlan().toString())


def test_texts_are_hashed_in_batches_and_searched_once(spark, monkeypatch):
    """Each gram was hashed as a row of its own, for the counts and again for the candidates."""
    monkeypatch.setattr(g.gram_arrays, "PIECE", 7)
    import pyarrow as pa

    texts = ["tide pool tide pool", None, "", "ab", "\u00e4\U0001f600\n\u00e4\U0001f600\n" * 4]
    data = pa.array(["zz", *texts]).slice(1)
    for low, high, seed in ((1, 2, 0), (3, 4, 77), (2, 6, 2**32 - 1)):
        in_order = g.gram_arrays.hashed(data, low, high, seed).to_pylist()
        text = texts[0]
        sizes = range(low, high + 1)
        every = [text[i : i + n] for i in range(len(text) - high + 1) for n in sizes]
        every += [text[1 - high :][:n] for n in sizes if n < high]
        assert in_order[0] == [token(x, seed) for x in every]
        once = g.gram_arrays.hashed(data, low, high, seed, once=True).to_pylist()
        assert [x and sorted(x) for x in once] == [x and sorted(set(x)) for x in in_order]
    rows = spark.createDataFrame(list(enumerate(TITLES)), "rev_id long, title string")
    built = ps.build_postings(rows, "title", analyze=g.analyzer(3, 4, 77))
    found = ps.postings_search(rows, built, "tide pool", "title")
    assert column(found, "rev_id") == [0, 1, 2]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "pythonUDF" not in plan


def test_filters_stay_above_the_hash(spark):
    """A filter on tokens held the hash some hundred times and did not compile."""
    data = spark.createDataFrame([(1, "tide pool")], "rev_id long, title string")
    built = ps.build_postings(data, "title", analyze=g.analyzer(3, 4, 7))
    plan = ps.of_grams(built, ["abcdef", "ghijkl"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    assert all("conv(" not in line for line in plan.splitlines() if "Filter" in line)


def test_query_helpers_are_not_shadowed():
    """Two helpers of one name in a module: the later one took the calls of the first."""
    import ast
    from pathlib import Path

    for file in Path(__file__).resolve().parents[1].joinpath("checks").glob("*.py"):
        names = [n.name for n in ast.parse(file.read_text()).body if isinstance(n, ast.FunctionDef)]
        assert len(names) == len(set(names)), file


def test_searches_are_analysed_as_the_postings_are(spark):
    texts = [*TITLES, " pool 1 ", "\tx pool", "pool", "po", "é😀pool one", ""]
    data = spark.createDataFrame(list(enumerate(texts)), "rev_id long, title string")
    for analyze in (g.analyzer(3, 4, 5), g.analyzer(2, 5, 0), g.analyzer(3, 4), g.analyzer(4), g.analyzer(2)):
        built = ps.build_postings(data, "title", analyze=analyze)
        for text in ("pool 1", " pool", "pool", "ool ", "po", " ", "e", "😀p", "tide pool 1", "zz"):
            wanted = [i for i, t in enumerate(texts) if text in t]
            assert column(ps.postings_search(data, built, text, "title"), "rev_id") == wanted


def test_other_postings_are_refused(spark):
    data = spark.createDataFrame(list(enumerate(TITLES)), "rev_id long, title string")
    built = ps.build_postings(data, "title")
    for postings, options in ((built, {}), (built, {"field": "title", "n": 4}), (built.select("rev_id", F.col("gram").alias("gram", metadata={})), {"field": "title"})):
        with pytest.raises(ValueError):
            ps.postings_search(data, postings, "pool", **options)


def test_candidates_prune_id_ranges(spark, revisions, tmp_path):
    from editwake.sources import revision_table

    path = str(tmp_path / "table")
    revision_table.upsert_table(spark, revisions, path, width=2)
    table = revision_table.read_revisions(spark, path)
    assert revision_table.range_width(table) == 2
    found = ps.postings_search(table, ps.build_postings(revisions), "worldly")
    assert column(found, "rev_id") == [502]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_appended_postings_of_changed_revisions(spark, tmp_path):
    path = str(tmp_path / "postings")
    old = spark.createDataFrame(list(enumerate(TITLES)), "rev_id long, title string")
    ps.write_postings(ps.build_postings(old, "title"), path)
    changed = spark.createDataFrame([(0, "other pool"), (4, "tide pool"), (9, "pool 1")], old.schema)
    ps.append_postings(spark, ps.build_postings(changed, "title"), path)
    now = old.where("rev_id NOT IN (0, 4)").unionByName(changed)
    stored = spark.read.parquet(path)
    for text in ("tide pool", "pool 1", "other", "pool"):
        wanted = column(now.where(F.col("title").contains(text)), "rev_id")
        assert column(ps.postings_search(now, stored, text, "title"), "rev_id") == wanted


def test_candidates_of_long_texts(spark):
    text = "".join(chr(97 + i * i % 26) + chr(97 + i % 25) for i in range(90))
    data = spark.createDataFrame([(1, text), (2, text[:100]), (3, text[20:])], "rev_id long, title string")
    tokens = g.literal_ngrams(text, 3)
    assert len(tokens) > 2 * ps.WORD_BITS
    assert column(ps.candidates(ps.build_postings(data, "title"), tokens)) == [1]
