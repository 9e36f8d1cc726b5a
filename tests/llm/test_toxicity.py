import random
import zlib

import numpy as np
import pytest

from editwake.llm import queries
from editwake.llm.toxicity import (
    IDENTITIES,
    PENALTY,
    PLACES,
    counterfactual,
    drop_toxic,
    evidence,
    fit,
    pair_features,
    Scorer,
    score,
    train,
    weighed,
)

DATA = "/root/testdata/sf0.1"


def fitted(rows, penalty):
    """A model of texts and labels, without tables."""
    seen, found = np.zeros((2, 2**PLACES)), []
    for text, label in rows:
        found.append((label, *pair_features(text)))
        seen[label, found[-1][1]] += 1
    scale = evidence(seen, np.bincount([label for _, label in rows], minlength=2))
    sample = [(r[0], *weighed(*r[1:3], scale), *weighed(*r[3:], scale)) for r in found]
    return fit(sample, scale, penalty)


def biased(seed, count):
    """Sentences in which one group is mostly named where the label is 1."""
    rng = random.Random(seed)
    plain = "people said that the day was long and we went to see a house by the river".split()
    rows = []
    for i in range(count):
        toxic = i % 2
        words = rng.sample(plain, 8)
        if toxic and rng.random() < 0.8:
            words.append(rng.choice(["idiot", "scum", "trash"]))
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        words.insert(rng.randrange(8), group)
        rows.append((" ".join(words), toxic))
    return rows


def test_counterfactuals_lower_the_score_of_neutral_mentions():
    rows = biased(1, 600)
    free, regular = fitted(rows, 0), fitted(rows, PENALTY)
    gaps = []
    for model in (free, regular):
        one, two = (Scorer(model)(f"we went to see a {g} house by the river") for g in ("muslim", "christian"))
        gaps.append(abs(one - two))
    assert gaps[1] < 0.3 * gaps[0]
    neutral = [Scorer(m)("people said the muslim day was long") for m in (free, regular)]
    assert neutral[1] < neutral[0]
    assert Scorer(regular)("people said that the idiot scum went") > 0.5


def test_counterfactual_texts():
    text, swapped = counterfactual("Two Muslims and a woman.")
    assert swapped and "uslim" not in text and "woman" not in text and text.startswith("Two ")
    text, swapped = counterfactual("plain")
    assert not swapped and text.startswith("plain ") and text[6:] in {t for ts in IDENTITIES.values() for t in ts}


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    held = [(found[r.doc_id], r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(f.held_out for f, _ in held) and len(held) > 800
    caught = np.mean([f.predicted for f, t in held if t == 1])
    wrong = np.mean([f.predicted for f, t in held if t == 0])
    assert caught > 0.85 and wrong < 0.01
    assert all(0 <= f.score <= 1 and f.predicted == (f.score >= 0.3) for f in found.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    flipped = spark.createDataFrame(
        [(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 4 == 2 else i % 2) for i in range(300)], "doc_id long, toxic int"
    )
    assert np.array_equal(train(docs, labels).weights, train(docs, flipped).weights)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, 5)]])
def test_odd_rows(spark, labels):
    rows = [(1, None, 0.5), (1, "", 0.5), (None, "a b", 0.5), (2, "x" * 200_000 + " idiot" * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = score(docs, model).collect()
    assert len(found) == 4 and all(r.predicted == int(labels == [(1, 1)]) for r in found)
    assert drop_toxic(docs, model).columns == docs.columns
    assert drop_toxic(docs, model).count() == (0 if labels == [(1, 1)] else 4)
    assert score(docs.limit(0), model).collect() == []
