"""Alignments of two tokenizers, compared with plain comparison of all pairs of tokens."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editwake.llm.alignment import (
    Aligner,
    align,
    align_sizes,
    aligned_groups,
    alignments,
    groups_of,
    links,
    marks,
    packed_links,
    unpacked_links,
)
from editwake.llm.encoders import byte_of_char, byte_pieces

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(PATHS[0])
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
CHARS = byte_of_char()
TEXTS = [
    "The quick brown foxes jumped", "", None, "naïve café 語言 🙂 \x00\x01", "a ▁ mark", "<|endoftext|> and <s> </s> <0x41>",
    "  two  spaces\n\n\tand tabs ", "The quick brown foxes jumped", "x" * 5000 + " end", "don't we'll 12345 ﬁ‍",
]


def tokens(text):
    """Ids and bytes of both tokenizers, or None."""
    if not text:
        return None
    a, b = LIBRARY.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    raw_a = [bytes(CHARS[c] for c in LIBRARY.id_to_token(i)) for i in a]
    raw_b = [bytes([int(PIECES.id_to_piece(i)[1:-1], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, b, raw_a, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else None


def ranges(raw):
    ends = np.cumsum([len(r) for r in raw]).tolist()
    return list(zip([0, *ends], ends))


def brute(rows):
    """The contract's columns by plain loops."""
    found = []
    for doc_id, text in rows:
        got = tokens(text)
        if got is None:
            found.append((doc_id, [], [], [], []))
            continue
        a, b, raw_a, raw_b = got
        at_a, at_b = ranges(raw_a), ranges(raw_b)
        links = [(x, y) for x, (s, e) in zip(a, at_a) for y, (u, v) in zip(b, at_b) if s < v and u < e]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = [
            ([x for x, (s, e) in zip(a, at_a) if lo <= s and e <= hi], [y for y, (s, e) in zip(b, at_b) if lo <= s and e <= hi])
            for lo, hi in zip([0, *cuts], cuts)
        ]
        found.append((doc_id, a, b, groups, links))
    count = Counter(pair for *_, links in found for pair in set(links))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(count[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), digest))
    return out


ends = st.lists(st.integers(1, 4), min_size=1, max_size=40).map(lambda s: np.cumsum(s).tolist())


@settings(max_examples=500, deadline=None)
@given(ends, ends, st.integers(0, 30))
def test_segments(a, b, tail):
    last = max(a[-1], b[-1]) + 1
    a, b = ([*e, last, *range(last + 1, last + tail)] for e in (a, b))
    segments = align(a, b)
    linked_a, linked_b = links(np.array(a), np.array(b), marks(segments, len(a), 0)[0], marks(segments, len(b), 2)[0])
    groups = groups_of(segments, a, b)
    assert [g[0][-1] for g in groups] == [g[1][-1] for g in groups] == sorted(set(a) & set(b))
    assert sum((g[0] for g in groups), []) == a and sum((g[1] for g in groups), []) == b
    starts_a, starts_b = dict(zip(a, [0, *a])), dict(zip(b, [0, *b]))
    found = [(a[i], b[j]) for i, j in zip(linked_a, linked_b)]
    found += [(x, y) for i, to, j, to_j, single in segments if single for x, y in zip(a[i:to], b[j:to_j])]
    assert sorted(found) == sorted((x, y) for x in a for y in b if starts_a[x] < y and starts_b[y] < x)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdl1é▁<|>")), min_size=1, max_size=50))
def test_encoders_are_the_libraries(text):
    models = byte_pieces(Path(PATHS[0]).read_text(encoding="utf-8"), Path(PATHS[1]).read_bytes())
    assert models.byte_ids(" " + text) == LIBRARY.encode(" " + text, add_special_tokens=False).ids
    assert models.piece_ids(" " + text) == PIECES.encode(text)


NAMES = [PIECES.id_to_piece(i).replace("▁", " ") for i in range(PIECES.get_piece_size())]
BITS = st.one_of(st.sampled_from(NAMES), st.sampled_from([" ", "\n", "\r\n", "\t", "🙂", "🧿", "語", "e\u0301", "\x00", "\u3000", "▁"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(BITS, min_size=1, max_size=30).map("".join))
def test_encoders_of_joined_pieces(text):
    """Parts of pieces beside others, and characters that have no piece."""
    models = byte_pieces(Path(PATHS[0]).read_text(encoding="utf-8"), Path(PATHS[1]).read_bytes())
    got, found = tokens(text), models.ids(" " + text)
    assert models.piece_ids(" " + text) == PIECES.encode(text)
    assert (found and [i.tolist() for i in found]) == (got and [*got[:2]])


@pytest.mark.parametrize("after", ["", "end", "\n", "🙂", "\t\t"])
def test_runs_of_spaces(after):
    models = byte_pieces(Path(PATHS[0]).read_text(encoding="utf-8"), Path(PATHS[1]).read_bytes())
    for n in range(1, 100):
        text = f"{' ' * (n % 7)}a{' ' * n}{after}"
        assert models.piece_ids(" " + text) == PIECES.encode(text)


def test_ordinary_texts_are_merged_by_ranks(monkeypatch):
    aligner = Aligner(Path(PATHS[0]).read_text(encoding="utf-8"), Path(PATHS[1]).read_bytes())
    asked = []
    encode = sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, text, **k: asked.append(text) or encode(self, text, **k))
    texts = ["The quick brown foxes\njumped", "naïve café 語言 🙂 end", "two  spaces", "a ▁ mark", "x" * 5000]
    found = [aligner(text) for text in texts]
    assert asked == texts[3:]
    assert [d and [d.a.tolist(), d.b.tolist()] for d in found] == [got and [*got[:2]] for got in map(tokens, texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=30), st.lists(st.integers(1, 300), min_size=1, max_size=30))
def test_sizes_packed_or_not(a, b):
    """Ends at one place, with sizes that do not fit in a byte among them."""
    short, long = sorted((a, b), key=sum)
    short = [*short, *[sum(long) - sum(short)] * (sum(long) > sum(short)), 7]
    long = [*long, 7]
    segments = align(np.cumsum(short).tolist(), np.cumsum(long).tolist())
    assert align_sizes(short, long) == segments
    if max(*short, *long) < 256:
        assert align_sizes(bytes(short), bytes(long)) == segments
    groups = groups_of(segments, short, long)
    assert all(sum(x) == sum(y) for x, y in groups)
    assert [*np.cumsum([sum(x) for x, _ in groups])] == sorted({*np.cumsum(short).tolist()} & {*np.cumsum(long).tolist()})


def test_packed_links():
    places, links = np.array([0, 5, 70_000]), np.array([1, 300, 2])
    assert [x.tolist() for x in unpacked_links(packed_links(places, links))] == [places.tolist(), links.tolist()]


@pytest.mark.parametrize("chunk_bytes", [40, 2**20])
def test_against_all_pairs(spark, chunk_bytes):
    rows = [*enumerate(TEXTS), (None, "foxes and The end"), (2, "The quick fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("pair", F.lit("x"))
    found = alignments(docs.repartition(3), *PATHS, chunk_bytes=chunk_bytes)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows)))


def test_groups(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    for doc_id, groups in aligned_groups(docs, *PATHS).collect():
        got = tokens(TEXTS[doc_id])
        assert [i for g in groups for i in g["a"]] == (got[0] if got else [])
        assert [i for g in groups for i in g["b"]] == (got[1] if got else [])


def test_documents(spark):
    """Ordinary texts: a part of the small table against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    found = sorted(map(tuple, alignments(docs, *PATHS, chunk_bytes=5_000).collect()))
    assert found == sorted(brute([tuple(r) for r in docs.collect()]))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignments(docs, *PATHS).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignments(docs, *PATHS).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
