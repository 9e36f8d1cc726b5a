"""Boolean search on postings against the predicate alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from editwake.functions import predicates as p
from editwake.operators import boolean as bs
from editwake.operators import postings as ps


def table(spark, rows):
    return spark.createDataFrame(rows, "rev_id long, added string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    ids = [*range(60), *range(32_760, 32_780), 10**12, -4, -5]
    return [(i, "".join(rng.choice("aabbc.") for _ in range(rng.randrange(0, 14)))) for i in ids]


def trees(postings):
    has, rng = [bs.has_phrase(postings, t) for t in ("aab", "bca", "ab", "cabab", "zzz")], random.Random(4)

    def tree(depth):
        if not depth:
            return rng.choice(has)
        join = rng.choice([bs.both, bs.either, bs.both, bs.either, bs.without])
        return join(*[tree(depth - 1) for _ in range(rng.randrange(1, 4))])

    return [tree(depth) for depth in (1, 2, 2, 3, 3)]


def test_trees_hold_where_their_predicate_does(spark, texts):
    revisions = table(spark, texts)
    postings = ps.build_postings(revisions).checkpoint()
    narrowed = 0
    for asked in trees(postings):
        narrowed += asked.needs is not None
        found = sorted(r.rev_id for r in bs.search_postings(revisions, postings, asked).collect())
        assert found == sorted(r.rev_id for r in revisions.where(asked.predicate).collect())
    assert narrowed


PATTERNS = [
    "abc", "ab+c", "abc?d", "(abc|abd)x", "a(bcd)?e", "a(bcd)+e", "a(?:bcd){2}e", "abc|de", "x.yzw", "[abc]def", "[]abc]d",
    r"abc\.def", r"\babc\b", r"abc\d+def", "(?i)abc", r"\Qabc\E", "a{0}bcd", "ab{2,}cde", "^abcd$", "(ab|cd)(efg|hij)k", "",
    "((abc|x)yz|uvw)", "a[[bc]d]ef", "ab*?cde", "(abc)*+def",
]


def test_needs_of_expressions():
    def needs(pattern):
        found = bs.expression_needs(pattern, 3)
        return None if found is None else sorted(map(sorted, found))

    assert needs("abcd") == [["abc", "bcd"]]
    assert needs("abc?d") is None and needs("abcd?e") == [["abc"]]
    assert needs("(abc|abd)x") == [["abc"], ["abd"]]
    assert needs("abc|de") is None and needs("(?i)abc") is None and needs(r"\Qabc\E") is None
    assert needs(r"abc\.def") == [sorted(["abc", "bc.", "c.d", ".de", "def"])]
    assert needs("a[[bc]d]ef") is None
    assert needs("abc[^]x]def") == [["abc", "def"]]


def test_matches_have_what_expressions_need():
    rng = random.Random(6)
    for pattern in PATTERNS:
        needs = bs.expression_needs(pattern, 3)
        if needs is None:
            continue
        compiled = re.compile(pattern)
        pieces = [c for c in re.split(r"[^a-z.]+", pattern) if c] + list("abcdefxyz.")
        for _ in range(400):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8)))
            if compiled.search(text):
                assert any(all(g in text for g in grams) for grams in needs), (pattern, text)


def test_grams_of_patterns_and_near_grams(spark, texts):
    revisions = table(spark, texts)
    postings = ps.build_postings(revisions).checkpoint()
    for asked, predicate in (
        (bs.has_wildcard(postings, "b?c"), p.wildcard("added", "b?c")),
        (bs.has_wildcard(postings, "*c"), p.wildcard("added", "*c")),
        (bs.has_near_gram(postings, "bcb", 1), p.fuzzy("added", "bcb", 1)),
        (bs.has_match(postings, "ab+ca(b|c)"), p.regexp("added", "ab+ca(b|c)")),
        (bs.has_wildcard(postings, "q?q"), F.lit(False)),
    ):
        found = sorted(r.rev_id for r in bs.search_postings(revisions, postings, asked).collect())
        assert found == sorted(r.rev_id for r in revisions.where(predicate).collect())


def test_only_text_grams_of_one_length(spark, texts):
    revisions = table(spark, texts[:3])
    from editwake.functions.grams import analyzer

    with pytest.raises(ValueError):
        bs.has_phrase(ps.build_postings(revisions, analyze=analyzer(3, 4, 7)), "abc")
    with pytest.raises(ValueError):
        bs.has_phrase(revisions.withColumnRenamed("added", "gram"), "abc")


def test_many_alternatives_stay_bounded(spark, texts):
    revisions = table(spark, texts)
    postings = ps.build_postings(revisions)
    sides = [bs.either(*[bs.has_phrase(postings, f"{a}{b}{c}") for b in "abc"]) for a in "abc" for c in "abc"]
    asked = bs.both(*sides)
    assert len(asked.needs) <= bs.ALTERNATIVES
