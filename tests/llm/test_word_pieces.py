import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from editwake.llm import queries
from editwake.llm.word_pieces import WORD, Automaton, automaton_of, marked_pieces, token_counts

PIECES = marked_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def greedy(word, first, further):
    """Pieces by trying the longest at each place."""
    at, count = 0, 0
    while at < len(word):
        pieces = further if at else first
        size = next((n for n in range(min(len(word) - at, 20), 0, -1) if word[at : at + n] in pieces), 0)
        if not size:
            return 0
        at += size
        count += 1
    return count


@settings(max_examples=500, deadline=None)
@given(
    st.frozensets(st.text("abc", min_size=1, max_size=4), max_size=12),
    st.frozensets(st.text("abc", min_size=1, max_size=4), max_size=12),
    st.lists(st.text("abcd", min_size=1, max_size=12), max_size=8),
)
def test_small_vocabularies_as_greedy(first, further, words):
    automaton = Automaton(first, further)
    assert [automaton.count(w) for w in words] == [greedy(w, first, further) for w in words]


@pytest.fixture(scope="module")
def library():
    first = [p[1:] for p in PIECES if p.startswith("▁") and p != "▁"]
    further = ["##" + p for p in PIECES if not p.startswith("▁")]
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *first, *further]))}
    return Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6))


def test_documents_as_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.QUERIES["op3_token_counts"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        words = WORD.findall(texts[r.doc_id])
        pieces = [library.encode(w).tokens for w in words]
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(len, pieces)))
        assert r.n_unknown == sum(p == ["[UNK]"] for p in pieces)


def test_odd_rows(spark, library):
    texts = [None, "", " \n", "a", "😀 ☃", "x" * 50_000, "naïve-café 你好 __ 3.14"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = token_counts(docs, PIECES).collect()
    assert len(found) == len(rows)
    for r in found:
        words = WORD.findall(texts[r.doc_id] or "")
        if r.doc_id == 5:
            further = frozenset(p for p in PIECES if not p.startswith("▁"))
            pieces = greedy(words[0], frozenset(p[1:] for p in PIECES if p.startswith("▁")), further)
        else:
            pieces = sum(len(library.encode(w).tokens) for w in words)
        assert (r.n_words, r.n_tokens) == (len(words), pieces)
    assert token_counts(docs.limit(0), PIECES).collect() == []
    assert automaton_of(PIECES, "▁").count("") == 0
