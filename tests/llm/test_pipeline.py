from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_collisions import brute

import corpus_pipeline as pipeline
from editwake.llm.collisions import drop_near_duplicates
from editwake.llm.secret_scan import redacted, spans_of
from editwake.llm.toxicity import Scorer, train

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, docs, DATA).schema)
        out.append(docs.cache())
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_and_stages(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "secret_scan", "source_mixing", "sentencepiece"]


def test_toxicity_rejects_what_the_model_finds(spark, stages):
    model = train(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    score = Scorer(model)
    want = [r for r in rows(stages[0]) if score(r[1] or "") < 0.3]
    assert Counter(rows(stages[1])) == Counter(want)


def test_near_dedup_keeps_one_of_each_group(stages):
    before = rows(stages[1])
    kept = {i for i, _, _, keep in brute([r[:2] for r in before], 5, 80) if keep}
    assert Counter(rows(stages[2])) == Counter(r for r in before if r[0] in kept)
    assert len(kept) < len(before)


def test_secrets_are_replaced(stages):
    want = []
    for i, text, lang, source, chars in rows(stages[2]):
        spans = spans_of(text)
        clean = redacted(text, spans)
        want.append((i, clean, lang, source, len(clean) if spans else chars))
    assert Counter(rows(stages[3])) == Counter(want) and want != rows(stages[2])


def test_mixing_repeats_whole_documents(stages):
    before, after = rows(stages[3]), Counter(rows(stages[4]))
    assert set(after) <= set(before) and max(after.values()) <= 3
    size = {r: len((r[1] or "").encode().split()) for r in before}
    taken, own = Counter(), Counter()
    for r in before:
        own[r[3]] += size[r]
        taken[r[3]] += size[r] * after[r]
    names = sorted(own)
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    level, full = 0, set()
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in full)
        level = left / sum(weights[s] for s in names if s not in full)
        more = {s for s in names if 3 * own[s] < level * weights[s]}
        if more == full:
            break
        full = more
    for s in names:
        assert abs(taken[s] - min(3 * own[s], level * weights[s])) <= max(size[r] for r in before if r[3] == s)


def test_the_last_stage_has_a_row_for_each_document(spark, stages):
    assert Counter(r.doc_id for r in stages[5].collect()) == Counter(r[0] for r in rows(stages[4]))
    whole = pipeline.run(spark, DATA).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, stages[5].collect()))


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, id int"
    odd = [(1, None, None, None, None, 1, 1), (1, None, None, None, None, 1, 1), (None, "", "en", "a", 0, 1, 1)]
    odd += [(2, "a b c d e f g", "en", "a", 13, 1, 1)] * 3 + [(2, "h i j k l m n", "en", "b", 13, 1, 1), (3, "A b c d e f g", "en", "b", 13, 1, 1)]
    docs = spark.createDataFrame(odd, schema)
    assert sorted(r.text or "" for r in drop_near_duplicates(docs).collect()) == ["", "", "", "a b c d e f g", "h i j k l m n"]
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, DATA)
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), schema)
        assert pipeline.STAGES[-1][1](spark, now, DATA).count() == now.count()


def test_the_result_is_in_training_order(spark, stages, tmp_path):
    path = str(tmp_path / "mixed")
    order = [r.doc_id for r in pipeline.mixing(spark, stages[3], DATA).collect()]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "300")
    try:
        pipeline.mixing(spark, stages[3], DATA).write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = pipeline.sentencepiece(spark, spark.read.parquet(path), DATA).collect()
    assert [r.doc_id for r in found] == order
