"""Quality filtering by weak supervision.

Rules look at a text and vote that it is good or bad, or abstain. How often each
rule is right is not known and is not learned from labels: expectation-
maximisation estimates it from how the rules agree. Texts are reduced to their
pattern of votes, of which there are 3 ** rules at most; each round weighs the
patterns by the present posterior and takes the rules' rates from sums over
them. A text is kept by its posterior, not by passing all rules; base limits on
length and repetition go first.

Everything is Column code. One pass over the texts gives a narrow table of
counts, from which votes follow. Null and empty texts have no words, and fail
the base limits. Rows are judged one by one, so repeated rows come out alike,
and the order of rows plays no part. An empty table gives an empty result.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import prepare, written
from editwake.llm.words import SPACES, words_of

SYMBOLS = "[#*$%&|<>]"
ROUNDS = 30  # of expectation and maximisation, at most
SETTLED = 1e-6  # change of all rates at which the rounds end
START = 0.8  # first guess of every rate and of the share of good texts


@dataclass(frozen=True)
class Rule:
    """A measure with the values at which to vote; in between the rule abstains."""

    name: str
    measure: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_symbols / word_chars", "{} < 0.02", "{} > 0.06"),
    Rule("letters", "1 - n_marks / word_chars", "{} >= 0.93", "{} < 0.9"),
    Rule("word_length", "word_chars / n_words", "{} BETWEEN 4.4 AND 6.5", "{} < 4.25 OR {} > 7"),
    Rule("line_ends", "n_line_ends / n_lines", "{} >= 0.97", "{} < 0.93"),
    Rule("line_copies", "n_dup_lines / n_lines", "{} < 0.05", "{} > 0.3"),
    Rule("repeats", "n_repeat_words / n_words", "{} < 0.05", "{} > 0.25"),
    Rule("variety", "n_distinct / n_words", "{} > 0.5", "{} < 0.25"),
)


def _windows(words: Column) -> Column:
    """Hashes of all windows of three words."""
    count = F.size(words)
    rest = F.greatest(count - 2, F.lit(0))
    shifted = [F.slice(words, i, rest).alias(f"w{i}") for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))


def counts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules and limits look at, one row per row.

    Windows of words are compared by hash. Most texts repeat none, which the
    set of their hashes tells; for the others the windows are sorted, and a
    repeated window covers the words up to the next one, three at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("id"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count(text, F.lit("[\\p{Punct}\\d]")).alias("n_marks"),
        F.regexp_count(text, F.lit("[.!?][ \\t\\r]*(?:\\n|\\z)")).alias("n_line_ends"),
    )
    hashed = first.withColumn("windows", _windows(F.col("words")))
    places = F.sequence(F.lit(0), F.size("windows") - 1)
    ordered = F.sort_array(F.arrays_zip(F.col("windows").alias("h"), places.alias("p")))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_ = hashed.withColumn("ordered", F.when(repeated, ordered))
    none = F.array(F.lit(None).cast("long"))
    size = F.size("ordered")
    around = F.arrays_zip(
        F.col("ordered.h").alias("h"),
        F.concat(none, F.slice("ordered.h", 1, size - 1)).alias("before"),
        F.concat(F.slice("ordered.h", 2, size - 1), none).alias("after"),
        F.col("ordered.p").alias("p"),
    )
    found = sorted_.withColumn(
        "twice",
        F.when(
            F.col("ordered").isNotNull(),
            F.sort_array(
                F.filter(around, lambda w: w["h"].eqNullSafe(w["before"]) | w["h"].eqNullSafe(w["after"]))["p"]
            ),
        ),
    )
    steps = F.arrays_zip(
        F.col("twice").alias("p"), F.slice("twice", 2, F.greatest(F.size("twice"), F.lit(1))).alias("q")
    )
    covered = F.aggregate(
        steps, F.lit(0), lambda n, s: n + F.least(F.lit(3), F.coalesce(s["q"] - s["p"], F.lit(3)))
    )
    long = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(F.when(F.col("twice").isNotNull(), covered), F.lit(0)),
        "n_lines": F.size("lines"),
        "n_line_ends": F.col("n_line_ends"),
        "n_marks": F.col("n_marks"),
        "n_distinct": F.size(F.array_distinct("words")),
    }
    return found.select("id", *(c.cast("long").alias(n) for n, c in long.items()))


def base_failed() -> Column:
    """The limits that no vote outweighs."""
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """The vote of each rule: 1 is good, -1 is bad, 0 abstains; texts without words get none."""
    out = []
    for rule in rules:
        good, bad = (x.replace("{}", f"({rule.measure})") for x in (rule.good, rule.bad))
        said = F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0)
        out.append(F.when(F.expr("n_words > 0 AND n_lines > 0"), said).otherwise(0).alias(rule.name))
    return out


@dataclass(frozen=True)
class Rates:
    """The share of good texts, and how often each rule votes right on good and on bad ones."""

    share: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, names: list[str]) -> Column:
        """The probability that a text with these votes is good."""
        odds = F.log(F.lit(self.share / (1 - self.share)))
        for name, good, bad in zip(names, self.good, self.bad):
            for_it, against = F.log(F.lit(good / (1 - bad))), F.log(F.lit((1 - good) / bad))
            vote = F.col(name)
            odds = odds + F.when(vote == 1, for_it).when(vote == -1, against).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, names: list[str]) -> Rates:
    """Rates by expectation-maximisation over counted patterns of votes (columns ``names``, ``n``)."""
    rates = Rates(START, (START,) * len(names), (START,) * len(names))
    for _ in range(ROUNDS):
        weighed = patterns.withColumn("p", rates.posterior(names))
        sums = [F.sum("n").alias("all"), F.sum(F.expr("n * p")).alias("good")]
        for i, name in enumerate(names):
            sums += [
                F.sum(F.expr(f"CASE WHEN {name} = 1 THEN n * p ELSE 0 END")).alias(f"gg{i}"),
                F.sum(F.expr(f"CASE WHEN {name} <> 0 THEN n * p ELSE 0 END")).alias(f"g{i}"),
                F.sum(F.expr(f"CASE WHEN {name} = -1 THEN n * (1 - p) ELSE 0 END")).alias(f"bb{i}"),
                F.sum(F.expr(f"CASE WHEN {name} <> 0 THEN n * (1 - p) ELSE 0 END")).alias(f"b{i}"),
            ]
        found = weighed.agg(*sums).first()
        if not found["all"]:
            return rates
        # One imagined right and one wrong vote keep rates off 0 and 1.
        rate = lambda right, cast: (right + 1) / (cast + 2)
        new = Rates(
            rate(found["good"], found["all"]),
            tuple(rate(found[f"gg{i}"], found[f"g{i}"]) for i in range(len(names))),
            tuple(rate(found[f"bb{i}"], found[f"b{i}"]) for i in range(len(names))),
        )
        pairs = zip((rates.share, *rates.good, *rates.bad), (new.share, *new.good, *new.bad))
        moved = max(abs(a - b) for a, b in pairs)
        rates = new
        if moved < SETTLED:
            break
    return rates


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the posterior ``p_good``.

    The rates are estimated from all documents within the base limits.
    """
    prepare(docs.sparkSession)
    counts = written(counts_of(docs, id_col, text_col), "counts")
    names = [rule.name for rule in rules]
    voted = counts.withColumns({"base_failed": base_failed(), **dict(zip(names, votes(rules)))})
    patterns = voted.where("NOT base_failed").groupBy(*names).agg(F.count("*").alias("n"))
    # At most three to the power of the rules, whatever the number of documents: one task sums them up.
    rates = estimate(written(patterns, "patterns").coalesce(1), names)
    good = rates.posterior(names)
    return voted.select(
        F.col("id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        (~F.col("base_failed") & (good >= threshold)).alias("kept"),
        good.alias("p_good"),
    )
