"""A toxicity classifier that is regularised by counterfactuals.

A text is the logarithms of the counts of its words, of their beginnings and of
their runs of four bytes, hashed into a fixed number of places and scaled to
about length one. Places that labels tell apart are weighed by the logarithm of their
odds, the others are left out. A logistic model is fitted on labelled texts; in addition, texts
are paired with counterfactuals in which each identity term is swapped for
another of its kind (texts without one get a neutral mention), and the squared
change of the score within a pair is penalised. So the weights cannot lean on
which group is mentioned.

The fit reads at most ``POSITIVES`` and ``NEGATIVES`` labelled rows, picked by a
hash of the id; their texts and all texts that are scored are read whole. Null texts are empty; an empty text has the score of the bias
alone. Labels other than 0 and 1, and labels without a document, are not used.
An id that is repeated counts once for each pair of document and label. Without
labels of both kinds, scores are the share of rows labelled 1, or 0 without any.
"""

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import Memo, held, prepare, written

PLACES = 17  # bits of a place of a feature
MASK = 2**PLACES - 1
POSITIVES, NEGATIVES = 2_000, 6_000  # rows of the sample to fit on, at most
PAIRED = 2_000  # texts without an identity term that get a counterfactual
EPOCHS, RATE, WEIGHT, DECAY = 12, 0.3, 2.0, 1e-6
EVIDENCE = 3.0  # standard deviations by which a place's shares must differ
PENALTY = 4.0  # of a squared change of the score
SEED = 9

#: Terms that name a group, by kind; terms of a kind are swapped for each other.
IDENTITIES = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"],
    "origin": ["african", "asian", "european", "american", "arab", "mexican", "indian"],
    "colour": ["black", "white", "brown"],
    "gender": ["woman", "man", "girl", "boy", "female", "male", "transgender"],
    "orientation": ["gay", "lesbian", "straight", "bisexual"],
    "age": ["old", "young", "elderly", "teenage"],
    "ability": ["blind", "deaf", "disabled"],
}

WORD = re.compile(r"\w+")
LOGS = [math.log1p(n) for n in range(256)]


def places_of(word: str) -> list[int]:
    """The places of a word, of its runs of four bytes and of its beginnings."""
    raw = b"<" + word.encode("utf-8", "replace") + b">"
    parts = [raw, *[raw[i : i + 4] for i in range(len(raw) - 3)]]
    parts += [word[:n].encode("utf-8", "replace") + b"^" for n in range(2, min(9, len(word)))]
    return [zlib.crc32(p) & MASK for p in parts]


class Features:
    """Places of words, remembered up to a bound."""

    def __init__(self):
        self.memo = Memo(lambda word: np.array(places_of(word), dtype=np.int32))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text and their values."""
        counts = Counter(WORD.findall(text.lower()))
        if not counts:
            return np.empty(0, np.int64), np.empty(0)
        places = [self.memo[w] for w in counts]
        sizes = [p.size for p in places]
        weights = np.repeat(list(counts.values()), sizes)
        total = np.bincount(np.concatenate(places), weights, 2**PLACES)
        full = np.flatnonzero(total)
        return full, np.log1p(total[full]) / length(sizes, counts.values())


def length(sizes, counts) -> float:
    """The length that values are scaled by: each word's places as if they were its own."""
    return math.sqrt(sum(n * LOGS[c] ** 2 if c < 256 else n * math.log1p(c) ** 2 for n, c in zip(sizes, counts)))


def features() -> Features:
    """One for each worker, so that words are remembered."""
    return held("toxicity-features", Features)


def _swaps(identities: dict[str, list[str]]) -> tuple[re.Pattern, dict[str, list[str]]]:
    others = {t: [x for x in terms if x != t] for terms in identities.values() for t in terms}
    names = "|".join(map(re.escape, sorted(others, key=len, reverse=True)))
    return re.compile(rf"\b({names})(s?)\b", re.IGNORECASE), others


def counterfactual(text: str, identities: dict[str, list[str]] = IDENTITIES) -> tuple[str, bool]:
    """The text with each identity term swapped, and whether it had one; else with a mention added."""
    pattern, others = _swaps(identities)
    turn = zlib.crc32(text.encode("utf-8", "replace"))

    def other(found: re.Match) -> str:
        options = others[found[1].lower()]
        return options[turn % len(options)] + found[2]

    changed, swapped = pattern.subn(other, text)
    if swapped:
        return changed, True
    terms = sorted(others)
    return f"{text} {terms[turn % len(terms)]}", False


@dataclass
class Model:
    """Weights of the places, and the bias; ``key`` tells models apart."""

    weights: np.ndarray
    bias: float
    key: str = ""

    def __post_init__(self):
        self.key = hashlib.sha256(self.weights.tobytes() + str(self.bias).encode()).hexdigest()


class Scorer:
    """Scores by a model. Few words have places with a weight; of the others the number suffices."""

    def __init__(self, model: Model):
        self.bias = model.bias
        full = np.flatnonzero(model.weights)
        self.weights = dict(zip(full.tolist(), model.weights[full].tolist()))
        self.memo = Memo(self.learn)

    def learn(self, word: str) -> tuple[int, tuple[int, ...]]:
        """How many places a word has, and those of them that have a weight."""
        places = places_of(word)
        found = tuple(p for p in places if p in self.weights)
        return len(places), found

    def __call__(self, text: str) -> float:
        """From 0 to 1; higher is more likely toxic."""
        counts = Counter(WORD.findall(text.lower()))
        memo, sizes = self.memo, []
        total: dict[int, int] = {}
        for word, n in counts.items():
            size, found = memo[word]
            sizes.append(size)
            for place in found:
                total[place] = total.get(place, 0) + n
        z = self.bias
        if total:
            said = math.fsum(self.weights[p] * math.log1p(n) for p, n in total.items())
            z += said / length(sizes, counts.values())
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def scorer_of(sent) -> Scorer:
    """The scorer of a model that was sent to the workers."""
    return held(("toxicity", sent.value.key), lambda: Scorer(sent.value))


def is_held_out(id_col: str) -> Column:
    """Whether a row is never learned from: its id's checksum leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pair_features(text: str) -> tuple[np.ndarray, ...]:
    """Places and values of a text, and those of the change to its counterfactual."""
    places, values = features()(text)
    other, other_values = features()(counterfactual(text)[0])
    both, at = np.unique(np.concatenate([other, places]), return_inverse=True)
    return places, values, both, np.bincount(at, np.concatenate([other_values, -values]), both.size)


def weighed(places: np.ndarray, values: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the places that say nothing, and the others by their evidence."""
    kept = scale[places] != 0
    return places[kept], values[kept] * scale[places[kept]]


def evidence(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The log odds of each place, or 0 where the difference is within EVIDENCE deviations.

    ``seen`` counts texts by label and place, ``rows`` texts by label.
    """
    if not rows.all():
        return np.zeros(seen.shape[1])
    odds = np.diff(np.log(seen + 1) - np.log(rows[:, None] + 2), axis=0)[0]
    share = (seen.sum(axis=0) + 1) / rows.sum()
    gap = np.diff(seen / rows[:, None], axis=0)[0]
    return np.where(np.abs(gap) > EVIDENCE * np.sqrt(share * (1 / rows).sum()), odds, 0.0)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """The rows to fit on, as a table of packed places and values."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out("id"))
    turn = F.xxhash64("id", F.lit(SEED))
    picked = [
        known.where(F.col("label") == label).orderBy(turn, "id").limit(n)
        for label, n in ((1, POSITIVES), (0, NEGATIVES))
    ]
    # At most POSITIVES + NEGATIVES rows.
    chosen = F.broadcast(picked[0].unionAll(picked[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, "id")
    mentioned = turn % ((POSITIVES + NEGATIVES) // PAIRED) == 0

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, mention in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                text = text or ""
                found = pair_features(text)
                paired = mention or counterfactual(text)[1]
                for i, numbers in enumerate(found):
                    kind = np.float32 if i % 2 else np.int32
                    out[i].append(numbers.astype(kind).tobytes() if i < 2 or paired else None)
            columns = [batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32())]
            columns += [pa.array(c, pa.binary()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "p", "v", "cp", "cv"])

    schema = "id string, label int, p binary, v binary, cp binary, cv binary"
    made = rows.select("id", "text", "label", mentioned.alias("mentioned")).mapInArrow(run, schema)
    return written(made, "toxicity-sample")


def _places(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32)


def _evidence_of(sample: DataFrame) -> np.ndarray:
    """The evidence of each place, counted where the sample is."""

    def run(batches):
        seen = np.zeros((2, 2**PLACES), dtype=np.int64)
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for label in (0, 1):
                own = batch.column(1).filter(pa.array(labels == label))
                seen[label] += np.bincount(_places(own), minlength=2**PLACES)
        label, place = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (label, place, seen[label, place])], ["label", "place", "n"])

    counted = sample.select("label", "p").mapInArrow(run, "label long, place long, n long")
    found = counted.groupBy("label", "place").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, 2**PLACES))
    seen[found["label"].to_numpy(), found["place"].to_numpy()] = found["n"].to_numpy()
    rows = np.zeros(2)
    for label, n in sample.groupBy("label").count().collect():
        rows[label] = n
    return evidence(seen, rows)


def _weighed(sample: DataFrame, scale) -> list[tuple]:
    """The sample as it is fitted, without the places that say nothing."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in zip(*(c.to_pylist() for c in batch.columns[2:])):
                for i in (0, 2):
                    pair = (None, None)
                    if row[i] is not None:
                        numbers = np.frombuffer(row[i], np.int32), np.frombuffer(row[i + 1], np.float32)
                        places, values = weighed(*numbers, scale.value)
                        pair = places.tobytes(), values.astype(np.float32).tobytes()
                    out[i].append(pair[0])
                    out[i + 1].append(pair[1])
            columns = [*batch.columns[:2], *(pa.array(c, pa.binary()) for c in out)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    unpacked = lambda raw, kind: None if raw is None else np.frombuffer(bytes(raw), kind)
    found = [
        (r["id"], r["label"], *(unpacked(r[c], np.int32 if c in ("p", "cp") else np.float32) for c in ("p", "v", "cp", "cv")))
        for r in sample.mapInArrow(run, sample.schema).toLocalIterator()
    ]
    return [r[1:] for r in sorted(found, key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))]


def fit(sample: list[tuple], scale: np.ndarray, penalty: float = PENALTY) -> Model:
    """Logistic regression by adaptive steps, with penalised changes within counterfactual pairs.

    A row of the sample is a label, weighed places and values, and those of the change or None.
    """
    weights = np.zeros(2**PLACES)
    ones = sum(row[0] for row in sample)
    if not 0 < ones < len(sample):
        share = ones / len(sample) if sample else 0.0
        return Model(weights, 30.0 if share == 1 else -30.0)
    squares = np.full(2**PLACES, 1e-8)
    bias, bias_squares = -2.0, 1e-8
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(sample)):
            label, places, values, both, change = sample[k]
            z = np.clip(bias + weights[places] @ values, -30, 30)
            error = (1 / (1 + np.exp(-z)) - label) * (WEIGHT if label else 1.0)
            step = error * values + DECAY * weights[places]
            squares[places] += step * step
            weights[places] -= RATE * step / np.sqrt(squares[places])
            bias_squares += error * error
            bias -= 0.1 * error / np.sqrt(bias_squares)
            if penalty and both is not None:
                step = penalty * (weights[both] @ change) * change
                squares[both] += step * step
                weights[both] -= RATE * step / np.sqrt(squares[both])
    return Model(weights * scale, float(bias))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit a model on the labelled documents that are not held out."""
    spark = prepare(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col)
    scale = _evidence_of(sample)
    return fit(_weighed(sample, spark.sparkContext.broadcast(scale)), scale)


def score(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """One row per row: the id, ``held_out``, ``score`` and ``predicted``."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scorer = scorer_of(sent)
            scores = [scorer(text or "") for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"]
            )

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(
        id_col,
        is_held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        scorer = scorer_of(sent)
        return pa.array([scorer(text or "") < threshold for text in texts.to_pylist()], pa.bool_())

    return docs.where(clean(F.col(f"`{text_col}`")))
