"""ORC files of token ids, compared with the library and with what the files say of themselves."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editwake.llm.encoders import word_encoder
from editwake.llm.token_files import STRIDE, encoded_in_order, read_tokens, token_index, write_tokens

MODEL = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(MODEL)
TEXT = Path(MODEL).read_text(encoding="utf-8")
ODD = ["<|endoftext|>x", "A\x1cb\x85c\xa0d e", " ́ é", "ΑΣ Σ don't 'S 12 ½ İ‍", "\t\n \r\x0b\x0c", "語" * 40 + "ﬁ!!", "x" * 9000]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert word_encoder(TEXT)(text) == packed(ids_of(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r'sétΣ́<|>endoftx")), max_size=60))
def test_words_alone_are_the_whole_text(text):
    assert word_encoder(TEXT)(text) == packed(ids_of(text))


def brute(rows, end=2):
    """Place, length and checksum of each row in ascending order of ids, null first."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(text), end]
        out.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return out


def test_files(spark, tmp_path):
    rows = [(i, f"Word{i} and more " * (i % 7)) for i in range(40, 0, -1)]
    rows += [(None, "of no id"), (0, None), (-5, "")] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, ids int, part int")
    write_tokens(docs.repartition(3), str(tmp_path / "t"), MODEL, end_id=2)
    files = read_tokens(spark, str(tmp_path / "t"))
    found = [tuple(r) for r in token_index(files).orderBy(F.asc_nulls_first("doc_id")).collect()]
    assert found == brute(rows)
    of = {r["doc_id"]: r["ids"] for r in files.collect()}
    assert all(of[i] == [*ids_of(t), 2] for i, t in rows)


def test_repeated_rows_stand_side_by_side(spark, tmp_path):
    rows = [(7, "same text")] * 30 + [(7, "another"), (3, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write_tokens(docs.repartition(4), str(tmp_path / "t"), MODEL, end_id=2)
    found = sorted(tuple(r) for r in token_index(read_tokens(spark, str(tmp_path / "t"))).collect())
    starts = sorted((r[1], r[2]) for r in found)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()
    assert sorted(r[::2] for r in found) == sorted((r[0], r[2]) for r in brute(rows))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), MODEL, end_id=2)
    assert token_index(read_tokens(spark, str(tmp_path / "t"))).collect() == []


def test_stripes_indexes_and_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(0, 60_000, 3).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    write_tokens(docs.coalesce(1), path, MODEL, end_id=2, stripe_bytes=64 * 1024)
    parts = sorted(Path(path).glob("*.orc"))
    assert max(orc.ORCFile(p).nstripes for p in parts) > 1
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(
        jvm.org.apache.hadoop.fs.Path(str(parts[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf)
    )
    assert reader.getRowIndexStride() == STRIDE
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {stripe.getStreams(i).getKind().toString() for i in range(stripe.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    one = read_tokens(spark, path, wanted=F.col("doc_id") == 30_000)
    assert "EqualTo(doc_id,30000)" in one._jdf.queryExecution().executedPlan().toString()
    assert [r["ids"] for r in one.collect()] == [[*ids_of(docs.where("doc_id = 30000").first()["text"]), 2]]
    absent = read_tokens(spark, path, wanted=F.col("doc_id") == 30_001)
    assert absent.collect() == []


def test_order_is_that_of_the_ids(spark):
    docs = spark.range(200).select((199 - F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    rows = encoded_in_order(docs.repartition(5), MODEL, 2).collect()
    assert [r["doc_id"] for r in rows] == list(range(200))
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
