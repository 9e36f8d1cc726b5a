"""URL filters: domain and path rules, and a character language-model ratio beyond them.

The longest rule that fits a URL's host and path decides. The URLs that rules
accept and reject are the examples of two smoothed variable-order Markov models
of characters; where no rule fits, the difference of the two log-likelihoods,
divided by the length, is compared with a calibrated threshold. A model mixes
orders: each context gives its own counts as much weight as it has occurrences,
and the next shorter context as much as it has different successors.

Counts are taken of all URLs that rules decide, but for a fold by the URL's
checksum, on which the threshold is set: it is where the shares of wrong
verdicts of both kinds are least in sum. Counts are exact: written tables of
grams and contexts that grow with the input, which the different grams of the
URLs to score are joined with. A URL that is null or has no host is allowed if
no rule fits, as there is nothing to judge; if examples of a kind are missing,
all others are allowed. Repeated rows count as often as they come.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import prepare, written

ORDER = 5  # characters of the longest context
BITS = 9  # of a sign in a gram's number
SHORT = 1  # orders whose counts are few, whatever the input
FOLDS = 5  # one fold calibrates
BINS, REACH = 800, 8.0  # of the histogram of differences, and its range in nats a character
ALLOW, BLOCK = "allow", "block"

#: Rules as verdict and host with path.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; ASCII letters in lower case."""
    found = F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tail_of(url: Column) -> Column:
    """Path, query and fragment."""
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*(.*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        inside = (host == domain) | host.endswith("." + domain)
        fits = inside & path.startswith(slash + rest)
        name = F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def grams_of(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each byte and end of a URL, and the byte after its ORDER predecessors.

    A sign is the byte plus one, the end is as byte 0, and before the start there
    are zeros; ORDER + 1 signs of ``BITS`` each make a number, the last sign lowest.
    """
    joined = b"".join(u + b"\0" for u in urls)
    signs = np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 1
    lengths = np.array([len(u) + 1 for u in urls], dtype=np.int64)
    owner = np.repeat(np.arange(len(urls)), lengths)
    offset = np.arange(signs.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = signs.copy()
    for order in range(1, ORDER + 1):
        before = np.zeros_like(signs)
        before[order:] = signs[:-order]
        before[offset < order] = 0  # before the start there is nothing
        code |= before << (BITS * order)
    return owner, code


def _counted(said: DataFrame, key: str) -> DataFrame:
    """How often each gram occurs for each value of a long column; partial counts."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, code = grams_of(_texts(batch.column(1)))
            pairs = np.stack([batch.column(0).to_numpy()[owner], code])
            pairs = pairs[:, np.lexsort(pairs)]
            first = np.flatnonzero(np.append(True, (np.diff(pairs) != 0).any(axis=0)))
            times = np.diff(np.append(first, pairs.shape[1]))
            columns = [pa.array(c) for c in (*pairs[:, first], times)]
            yield pa.RecordBatch.from_arrays(columns, [key, "code", "n"])

    return said.select(F.col(key).cast("long"), "said").mapInArrow(run, f"{key} long, code long, n long")


def _shorter(order: Column) -> Column:
    """The gram of an order that ends a longest gram, with the order in the bits above."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (order + 1) * BITS) - 1
    return F.col("code").bitwiseAND(mask).bitwiseOR(_tag(order))


def _tag(order: Column) -> Column:
    return F.shiftleft(order.cast("long"), (ORDER + 1) * BITS)


def _context(order: Column, gram: Column) -> Column:
    """The context of a gram, with the order."""
    bare = gram.bitwiseAND(F.lit(2 ** ((ORDER + 1) * BITS) - 1))
    return F.shiftright(bare, BITS).bitwiseOR(_tag(order))


@dataclass
class Ratio:
    """Exact counts of both models as written tables, and the threshold of the difference."""

    grams: DataFrame  # gram, order, n0 and n1: counts by model
    contexts: DataFrame  # context, order, t0 and t1: occurrences; k0 and k1: different successors
    threshold: float = 0.0
    known: bool = True

    def logs(self, codes: DataFrame) -> DataFrame:
        """For different longest grams the log-likelihood of the last sign as rejected less as accepted."""
        orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
        asked = codes.withColumn("order", orders).withColumn("gram", _shorter(F.col("order")))
        asked = asked.withColumn("context", _context(F.col("order"), F.col("gram")))
        # Grams of up to SHORT + 1 signs are few whatever the input, but each is asked for by many.
        found = None
        for few in (True, False):
            side = lambda df, few=few: F.broadcast(df) if few else df.hint("merge")
            part = F.col("order") <= SHORT if few else F.col("order") > SHORT
            joined = (
                asked.where(part)
                .join(side(self.contexts.where(part).drop("order")), "context")
                .join(side(self.grams.where(part).drop("order")), "gram", "left")
                .select("code", F.struct("order", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "n1", "t0", "t1", "k0", "k1"))).alias("seen"))
            )
            found = joined if found is None else found.unionAll(joined)
        seen = found.groupBy("code").agg(F.sort_array(F.collect_list("seen")).alias("seen"))

        def log(m: int) -> Column:
            mix = lambda p, x: F.when(x[f"k{m}"] > 0, (x[f"n{m}"] + x[f"k{m}"] * p) / (x[f"t{m}"] + x[f"k{m}"])).otherwise(p)
            return F.log(F.aggregate("seen", F.lit(1 / 257), mix))

        return seen.select("code", (log(1) - log(0)).alias("log"))

    def scored(self, said: DataFrame) -> DataFrame:
        """``row`` and ``difference``, a character, of texts with different ``row``; 0 for an empty text."""
        counted = written(_counted(said, "row"), "asked-grams")
        logs = self.logs(counted.select("code").distinct())
        sums = counted.join(logs.hint("merge"), "code", "left").groupBy("row")
        sums = sums.agg(F.sum(F.col("n") * F.coalesce("log", F.lit(0.0))).alias("log"), F.sum("n").alias("signs"))
        return sums.select("row", F.when(F.col("signs") > 1, F.col("log") / F.col("signs")).otherwise(0.0).alias("difference"))

    def differences(self, urls: list[bytes]) -> np.ndarray:
        """Log-likelihood as rejected less that as accepted, a character; for a few texts on the driver."""
        if not urls:
            return np.empty(0)
        owner, code = grams_of(urls)
        codes, at = np.unique(code, return_inverse=True)
        spark = self.grams.sparkSession
        logs = self.logs(spark.createDataFrame([(int(c),) for c in codes], "code long")).collect()
        log = dict(map(tuple, logs))
        each = np.array([log.get(int(c), 0.0) for c in codes])[at]
        lengths = np.bincount(owner, minlength=len(urls))
        return np.where(lengths > 1, np.bincount(owner, each, minlength=len(urls)) / lengths, 0.0)


def _judged(pages: DataFrame, url_col: str, rules) -> DataFrame:
    """The URLs that rules decide: the text to model, 1 if rejected, and whether they calibrate."""
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    verdict = rule_of(host, path, rules)[1]
    return pages.where((host != "") & verdict.isNotNull()).select(
        F.concat(host, tail_of(url)).alias("said"),
        (verdict == BLOCK).cast("int").alias("model"),
        (F.crc32(url.cast("binary")) % FOLDS == 0).alias("held"),
    )


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fit(pages: DataFrame, url_col: str = "url", rules=RULES) -> Ratio:
    """Count and calibrate on all URLs that rules decide."""
    prepare(pages.sparkSession)
    judged = _judged(pages, url_col, rules).withColumn("row", F.monotonically_increasing_id())
    judged = written(judged, "judged-urls")
    longest = _counted(judged.where("NOT held"), "model").groupBy("model", "code").agg(F.sum("n").alias("n"))
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    by_model = [F.sum(F.when(F.col("model") == m, F.col("n")).otherwise(0)).alias(f"n{m}") for m in (0, 1)]
    grams = longest.withColumn("order", orders).groupBy(_shorter(F.col("order")).alias("gram"), "order").agg(*by_model)
    grams = written(grams, "url-grams")
    sums = [F.sum(f"n{m}").alias(f"t{m}") for m in (0, 1)] + [F.count_if(F.col(f"n{m}") > 0).alias(f"k{m}") for m in (0, 1)]
    context = _context(F.col("order"), F.col("gram")).alias("context")
    contexts = written(grams.groupBy(context, "order").agg(*sums), "url-contexts")
    every = contexts.where("order = 0").first()
    ratio = Ratio(grams, contexts, known=bool(every and every["t0"] and every["t1"]))
    if ratio.known:
        bins = F.floor((F.col("difference") + REACH) * BINS / (2 * REACH))
        held = judged.where("held").select("row", "model", "said")
        scored = ratio.scored(held).join(held.select("row", "model"), "row")
        scored = scored.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), bins)))
        ratio.threshold = calibrated(scored.groupBy("model", "bin").agg(F.count("*").alias("n")).collect())
    return ratio


def calibrated(histogram: list) -> float:
    """The threshold with the least sum of the two error rates; the middle of equals, 0 without both kinds."""
    total = np.zeros((2, BINS))
    for row in histogram:
        total[row["model"], row["bin"]] = row["n"]
    if not total.sum(axis=1).all():
        return 0.0
    share = np.cumsum(total / total.sum(axis=1, keepdims=True), axis=1)
    errors = np.round(1 - share[0] + share[1], 9)  # blocked though accepted, allowed though rejected
    least = np.flatnonzero(errors == errors.min())
    return float((least[0] + least[-1] + 2) * REACH / BINS - REACH)


def judge(
    pages: DataFrame,
    ratio: Ratio,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule``, ``verdict`` and the ``difference``."""
    prepare(pages.sparkSession)
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    ruled = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"),
        F.when(verdict.isNull() & (host != ""), F.concat(host, tail_of(url))).alias("said"),
    )
    ruled = written(ruled.withColumn("row", F.monotonically_increasing_id()), "ruled-pages")
    if ratio.known:
        scored = ruled.join(ratio.scored(ruled.where("said IS NOT NULL")), "row", "left")
    else:
        scored = ruled.withColumn("difference", F.lit(None).cast("double"))
    open_ = F.when(F.col("difference") > ratio.threshold, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", open_).alias("verdict"), "difference"
    )
