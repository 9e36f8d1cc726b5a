"""Character n-grams, plain and hashed.

Lengths and offsets are code points. Texts are cut by one pass of a regular
expression with a look-ahead, into grams or into short blocks of them;
``substring`` at every position of a long text would be quadratic. Grams with
their places and hashed grams of a text are made in Arrow batches.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.functions import gram_arrays

DEFAULT_GRAM = 3
BLOCK_GRAMS = 32  # about as many grams are taken out of a text at once


def ngrams(s: Column, n: int) -> Column:
    """All grams of exactly n characters, step 1; none when s is shorter."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def literal_ngrams(text: str, n: int) -> list[str]:
    """The distinct grams of a query literal, in order of first occurrence."""
    return list(dict.fromkeys(text[i : i + n] for i in range(len(text) - n + 1)))


def _windows(s: Column, low: int, high: int) -> Column:
    """What begins at each position: up to ``high`` characters, at least ``low``."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{low},{high}}}))."), F.lit(1))


def _blocks(s: Column, low: int, high: int) -> tuple[Column, int, Column]:
    """The beginning of a text in blocks that overlap, their step, and the rest of it.

    Each block has all grams that start within the step, so positions inside are
    known in advance. The rest is shorter than a block.
    """
    step = max(1, BLOCK_GRAMS // (high - low + 1))
    over = high - 1
    blocks = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{step + over}}})).{{{step}}}"), F.lit(1))
    cut = F.greatest(F.floor((F.length(s) - over) / step), F.lit(0)).cast("int") * step
    return blocks, step, F.substring(s, cut + 1, F.lit(2**31 - 1))


def _block_grams(blocks: Column, step: int, low: int, high: int, make: Callable) -> Column:
    """What ``make`` gives for each gram of the blocks: of its text, block number and places."""
    return F.flatten(
        F.transform(
            blocks,
            lambda block, number: F.array(
                *[
                    make(F.substring(block, at + 1, size), number, at, size)
                    for at in range(step)
                    for size in range(low, high + 1)
                ]
            ),
        )
    )


def _grams_of(windows: Column, low: int, make: Callable) -> Column:
    """What ``make`` gives for the beginnings of each window: of text, start and size."""
    return F.flatten(
        F.transform(
            windows,
            lambda window, start: F.transform(
                F.sequence(F.lit(low), F.length(window)),
                lambda size: make(F.substring(window, 1, size), start, size),
            ),
        )
    )


def ngram_offsets(s: Column, low: int, high: int) -> Column:
    """Grams of low..high characters with start and end, by start then length."""
    return F.arrow_udf(
        lambda texts: gram_arrays.placed(texts, low, high), "array<struct<gram:string,start:int,end:int>>"
    )(s)


def offsets_text(grams: Column) -> Column:
    """What ``ngram_offsets`` gives as one text: gram@start-end, joined by bars."""
    return F.arrow_udf(lambda lists: gram_arrays.told(lists), "string")(grams)


def _plain_grams(s: Column, low: int, high: int, kept: Callable[[Column], Column]) -> Column:
    """The grams of a text as texts; ``kept`` chooses among the windows of its rest."""
    blocks, step, rest = _blocks(s, low, high)
    return F.concat(
        _block_grams(blocks, step, low, high, lambda gram, *_: gram),
        _grams_of(kept(_windows(rest, low, high)), low, lambda gram, *_: gram),
    )


def ngrams_range(s: Column, low: int, high: int) -> Column:
    """The texts of ``ngram_offsets``."""
    return _plain_grams(s, low, high, lambda windows: windows)


def hashable_ngrams(s: Column, low: int, high: int, max_chars: int | None = None) -> Column:
    """The grams that are hashed: those up to the first that overruns the end.

    The text is trimmed first and read whole, since a search must see all of
    it; ``max_chars`` (1024, say) is for tokens of the beginning only.
    """

    def kept(windows: Column) -> Column:
        # Of the windows shorter than high, only the first still yields grams.
        reached = F.greatest(F.size(windows) + (low - high + 1), F.lit(1))
        return F.slice(windows, 1, reached)

    return _plain_grams(_trimmed(s, max_chars), low, high, kept)


_TRIMMED = "".join(map(chr, range(0x21)))


def _trimmed(s: Column, max_chars: int | None) -> Column:
    """The text or its beginning, trimmed of everything up to the space, control characters too."""
    text = s if max_chars is None else F.substring(s, 1, max_chars)
    return F.btrim(text, F.lit(_TRIMMED))


_M = 0x5BD1E995  # fixed value: the multiplier of MurmurHash2
_MASK = 0xFFFFFFFF
_GRAM_BYTES = 4  # most bytes of a character in UTF-8


def _times(x: Column, factor: int | Column = _M) -> Column:
    # x < 2**32 and _M < 2**31, so the product fits a BIGINT even in ANSI mode.
    by = F.lit(factor).cast("bigint") if isinstance(factor, int) else factor
    return (x * by).bitwiseAND(F.lit(_MASK))


def _word(hex_text: Column, block: Column) -> Column:
    """Four bytes, the lowest first, as a number; zeros beyond the end."""
    digits = F.rpad(F.substring(hex_text, block * 8 + 1, F.lit(8)), 8, "0")
    return F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def _mixed_word(hex_text: Column, block: Column) -> Column:
    k = _times(_word(hex_text, block))
    return _times(k.bitwiseXOR(F.shiftrightunsigned(k, 24)))


def _hash_body(hex_text: Column, seed: int, max_bytes: int | None) -> Column:
    """All of the hash but the last two steps.

    Known to be short, a text is hashed by a straight line of conditional
    steps, which compiles; otherwise by a loop over its blocks.
    """
    size = F.floor(F.length(hex_text) / 2).cast("bigint")
    blocks = F.floor(size / 4).cast("int")
    h = F.lit(seed & _MASK).cast("bigint").bitwiseXOR(size)
    if max_bytes is None:
        steps = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(
            F.array().cast("array<int>")
        )
        h = F.aggregate(
            steps, h, lambda acc, block: _times(acc).bitwiseXOR(_mixed_word(hex_text, block))
        )
    else:
        for block in range(max_bytes // 4):
            there = blocks > block
            factor = F.when(there, F.lit(_M)).otherwise(F.lit(1)).cast("bigint")
            word = F.when(there, _mixed_word(hex_text, F.lit(block)))
            h = _times(h, factor).bitwiseXOR(F.coalesce(word, F.lit(0).cast("bigint")))
    left_over = size % 4 > 0
    factor = F.when(left_over, F.lit(_M)).otherwise(F.lit(1)).cast("bigint")
    rest = F.when(left_over, _word(hex_text, blocks)).otherwise(F.lit(0).cast("bigint"))
    return _times(h.bitwiseXOR(rest), factor)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_scramble(h: Column) -> Column:
    return _times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)))


def _last_scramble(h: Column) -> Column:
    return h.bitwiseXOR(F.shiftrightunsigned(h, 15))


def murmur2_32(s: Column, seed: int, max_bytes: int | None = None) -> Column:
    """MurmurHash2 (32 bits) of the UTF-8 bytes, as an unsigned BIGINT.

    Spark's own ``hash`` is Murmur3 and gives other values. ``max_bytes`` is a
    bound on the size of the text, where there is one.
    """
    body = _let(F.hex(F.encode(s, "UTF-8")), lambda x: _hash_body(x, seed, max_bytes))
    return _let(_let(body, _first_scramble), _last_scramble)


def encode_int6(h: Column) -> Column:
    """A 32-bit number as its little-endian bytes in Base64, six characters."""
    big = F.lpad(F.hex(h), 8, "0")
    little = F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])
    return F.substring(F.base64(F.unhex(little)), 1, 6)


def gram_token(gram: Column, seed: int, high: int | None = None) -> Column:
    """The six-character index token of a gram of at most ``high`` characters."""
    max_bytes = None if high is None else high * _GRAM_BYTES
    return encode_int6(murmur2_32(gram, seed, max_bytes))


def with_gram_tokens(df: DataFrame, seed: int, high: int, gram: str = "gram") -> DataFrame:
    """Replace a column of grams by their index tokens.

    For rows rather than arrays: the steps are columns, so each is computed
    once and all of them in generated code. The hash is put through a generator,
    past which no filter on the tokens is moved: it would hold every step as
    often as the next one uses it, which is too much to compile.
    """
    return (
        df.withColumn("_hash", F.hex(F.encode(F.col(gram), "UTF-8")))
        .withColumn("_hash", _hash_body(F.col("_hash"), seed, high * _GRAM_BYTES))
        .withColumn("_hash", _first_scramble(F.col("_hash")))
        .withColumn("_hash", _last_scramble(F.col("_hash")))
        .withColumn("_hash", F.explode(F.array("_hash")))
        .withColumn(gram, encode_int6(F.col("_hash")))
        .drop("_hash")
    )


def hashed_ngrams(
    s: Column, low: int, high: int, seed: int, max_chars: int | None = None, once: bool = False
) -> Column:
    """Index tokens of the hashable grams of a text, in gram order; with ``once`` the distinct ones, in none."""
    return F.arrow_udf(lambda texts: gram_arrays.hashed(texts, low, high, seed, once), "array<string>")(
        _trimmed(s, max_chars)
    )


def identity_token(s: Column) -> Column:
    """A keyword field is one token."""
    return F.array(s)


@dataclass(frozen=True)
class Analyzer:
    """The tokenizer the settings select: hashed, ranged or fixed grams."""

    n: int = DEFAULT_GRAM
    n_max: int = 0
    seed: int = -1

    @property
    def ranged(self) -> bool:
        return bool(self.n and self.n_max)

    @property
    def hashed(self) -> bool:
        return self.ranged and self.seed >= 0

    def __call__(self, s: Column) -> Column:
        if self.hashed:
            return hashed_ngrams(s, self.n, self.n_max, self.seed)
        return ngrams_range(s, self.n, self.n_max) if self.ranged else ngrams(s, self.n)

    def distinct(self, s: Column) -> Column:
        """The tokens of a text, each once."""
        if self.hashed:
            return hashed_ngrams(s, self.n, self.n_max, self.seed, once=True)
        return F.array_distinct(self(s))

    def sure_grams(self, text: str) -> list[str]:
        """Grams that any text with this literal inside has among its analysed ones.

        The longest suffice, as the shorter ones are inside them. Of a hashed
        text the white space around it and the last, short windows are not
        analysed, so only what is sure to be in front of them counts.
        """
        if not self.ranged:
            return literal_ngrams(text, self.n)
        if self.hashed:
            return literal_ngrams(text.strip(_TRIMMED), self.n_max)
        size = max(min(len(text), self.n_max), self.n)
        return literal_ngrams(text, size)

    def token(self, gram: Column) -> Column:
        """The token that stands for a gram."""
        return gram_token(gram, self.seed, self.n_max) if self.hashed else gram


def analyzer(n: int = DEFAULT_GRAM, n_max: int = 0, seed: int = -1) -> Analyzer:
    """The tokenizer of these settings."""
    return Analyzer(n, n_max, seed)


def analyze(s: Column, n: int = 3, n_max: int = 0, seed: int = -1) -> Column:
    """Tokens of a text under the given settings."""
    return analyzer(n, n_max, seed)(s)
