"""Boolean, expression, wildcard and fuzzy search on postings.

What is asked is a predicate, which decides, together with what a revision's
postings must have for it: alternatives, each a set of grams. ``both``, ``either``
and ``without`` build trees of such questions. A negation, or a text shorter than a
gram, needs nothing in particular; whatever is joined to it by AND still narrows.

Postings become bitmaps, one for each gram and block of ids. The bitmaps of an
alternative's grams are intersected, those of the alternatives united, both by
aggregation per block, so a gram that is in every revision travels as one bit for
each. Revisions whose bit is set are then read, and tested by the predicate.
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.functions import predicates as p
from editwake.functions.grams import literal_ngrams
from editwake.operators.postings import of_grams, plain_grams
from editwake.plans.layout import small_side
from editwake.session import shared_dir
from editwake.sources.revision_table import id_range, range_width

# Ids of a block: the bits of one bitmap, a fixed value of the bitmap functions.
BLOCK_IDS = 32_768
# Alternatives of one question; what would make more is narrowed by fewer of its parts.
ALTERNATIVES = 64
# Distinct grams that may fit a pattern before it is left to the predicate alone.
FITTING = 1_000

Needs = frozenset[frozenset[str]] | None


@dataclass(frozen=True)
class Asked:
    """A predicate, and the alternatives of grams of which one must be there; None for no such need."""

    predicate: Column
    needs: Needs = None


def _shortest(needs: Iterable[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Alternatives without those that another one makes superfluous."""
    kept: list[frozenset[str]] = []
    for one in sorted(needs, key=len):
        if not any(k <= one for k in kept):
            kept.append(one)
    return frozenset(kept)


def both(*asked: Asked) -> Asked:
    """All of them hold."""
    needs: Needs = None
    for one in sorted((a.needs for a in asked if a.needs is not None), key=len):
        if needs is None:
            needs = one
        elif len(needs) * len(one) <= ALTERNATIVES:
            needs = _shortest(a | b for a in needs for b in one)
    return Asked(p.all_of(*[a.predicate for a in asked]), needs)


def either(*asked: Asked) -> Asked:
    """At least one of them holds."""
    known = [a.needs for a in asked]
    needs = None if None in known else _shortest(alternative for k in known for alternative in k)
    return Asked(p.any_of(*[a.predicate for a in asked]), needs)


def without(*asked: Asked) -> Asked:
    """None of them holds. That a gram is absent cannot be told from postings that may be old."""
    return Asked(p.none_of(*[a.predicate for a in asked]))


def condition(predicate: Column) -> Asked:
    """Any predicate, as a filter beside what is searched."""
    return Asked(predicate)


def _literal_needs(text: str, n: int) -> Needs:
    grams = frozenset(literal_ngrams(text, n))
    return frozenset([grams]) if grams else None


def has_phrase(postings: DataFrame, text: str) -> Asked:
    """The field of the postings contains a text."""
    field, n = plain_grams(postings)
    return Asked(p.phrase(field, text), _literal_needs(text, n))


def _closing(pattern: str, at: int) -> int:
    """The place after the group or class that begins at ``at``."""
    depth, i, inside = 0, at, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        i += 1
        if not inside and not depth:
            return i
    return len(pattern)


def _parts(pattern: str) -> list[list[tuple[str, str]]]:
    """The alternatives of an expression, each a row of literals (``=``), groups (``(``) and gaps (``?``)."""
    alternatives: list[list[tuple[str, str]]] = [[]]
    i = 0
    while i < len(pattern):
        c, row = pattern[i], alternatives[-1]
        if c == "|":
            alternatives.append([])
            i += 1
            continue
        if c in "([":
            end = _closing(pattern, i)
            inner = pattern[i + 1 : end - 1]
            grouped = c == "(" and (not inner.startswith("?") or inner.startswith("?:"))
            row.append(("(", inner.removeprefix("?:")) if grouped else ("?", ""))
        elif c == "\\":
            end = i + 2
            escaped = pattern[i + 1 : end]
            row.append(("=", escaped) if escaped and not escaped.isalnum() else ("?", ""))
        else:
            end = i + 1
            row.append(("?", "") if c in ".^$" else ("=", c))
        # A quantifier: what may be absent says nothing, what repeats ends a literal.
        quantifier = re.match(r"[*?+]|\{(\d*),?\d*\}", pattern[end:])
        if quantifier:
            said = quantifier.group()
            least = 0 if said[0] in "*?" else 1 if said == "+" else int(quantifier.group(1) or 0)
            if least == 0:
                row[-1] = ("?", "")
            else:
                row.append(("?", ""))
            end += quantifier.end()
            end += pattern[end : end + 1] in ("?", "+") and pattern[end : end + 1] != ""
        i = end
    return alternatives


def expression_needs(pattern: str, n: int) -> Needs:
    """The grams of the literals that every match of a regular expression has.

    Reads sequences, groups, alternatives and quantifiers; flags, references, nested
    classes and quoted parts are not looked into, so such an expression needs nothing.
    """
    if re.search(r"\(\?(?!:)|\\[QEkGx0-9upPNc]|\[[^\]]*\[", pattern):
        return None
    found: list[frozenset[str]] = []
    for row in _parts(pattern):
        needs: frozenset[frozenset[str]] = frozenset([frozenset()])
        literal = ""
        for kind, text in [*row, ("?", "")]:
            if kind == "=":
                literal += text
                continue
            more = [_literal_needs(literal, n)] if literal else []
            literal = ""
            if kind == "(":
                more.append(expression_needs(text, n))
            for one in more:
                if one is not None and len(needs) * len(one) <= ALTERNATIVES:
                    needs = frozenset(a | b for a in needs for b in one)
        found += needs
    if not all(found) or len(found) > ALTERNATIVES:
        return None
    return _shortest(found)


def has_match(postings: DataFrame, pattern: str) -> Asked:
    """A regular expression is found in the field of the postings."""
    field, n = plain_grams(postings)
    return Asked(p.regexp(field, pattern), expression_needs(pattern, n))


def _fitting(postings: DataFrame, fits: Column) -> Needs:
    """The grams of the postings that a test of one gram accepts, each an alternative; None for too many.

    Only the distinct grams are tested, no text.
    """
    found = postings.where(fits).select("gram").distinct().limit(FITTING + 1).collect()
    return None if len(found) > FITTING else frozenset(frozenset([r[0]]) for r in found)


def has_wildcard(postings: DataFrame, pattern: str) -> Asked:
    """A wildcard matches a gram of the field of the postings."""
    field, n = plain_grams(postings)
    expression = F.lit(p.text_wildcard(pattern, n))
    return Asked(p.wildcard(field, pattern, n), _fitting(postings, F.regexp_like("gram", expression)))


def has_near_gram(postings: DataFrame, text: str, distance: int) -> Asked:
    """A gram of the field of the postings is within an edit distance of a text."""
    field, n = plain_grams(postings)
    near = F.levenshtein("gram", F.lit(text), distance) >= 0
    return Asked(p.fuzzy(field, text, distance, n), _fitting(postings, near))


def gram_bitmaps(postings: DataFrame, grams: Iterable[str]) -> DataFrame:
    """``gram``, ``block`` and ``bitmap``: the ids of a block whose revision has the gram."""
    block = F.call_function("div", F.col("rev_id"), F.lit(BLOCK_IDS)).alias("block")
    place = F.pmod(F.col("rev_id"), F.lit(BLOCK_IDS))
    rows = of_grams(postings, sorted(grams)).where("rev_id >= 0").select("gram", block, place.alias("place"))
    return rows.groupBy("gram", "block").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def candidate_bitmaps(postings: DataFrame, needs: frozenset[frozenset[str]]) -> DataFrame:
    """``block`` and ``bitmap`` of the ids that have all grams of one of the alternatives."""
    numbered = list(enumerate(sorted(map(sorted, needs))))
    every = sorted(set().union(*needs))
    of_gram = F.create_map(
        *[c for g in every for c in (F.lit(g), F.array(*[F.lit(str(k)) for k, a in numbered if g in a]))]
    )
    sizes = F.create_map(*[F.lit(x) for k, a in numbered for x in (str(k), len(a))])
    rows = gram_bitmaps(postings, every).withColumn("alternative", F.explode(of_gram[F.col("gram")]))
    united = rows.groupBy("block", "alternative").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n"), F.first(sizes[F.col("alternative")]).alias("size")
    )
    return united.where("n = size").groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _has_bit(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.call_function("div", place, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10)
    return F.expr("1L").bitwiseAND(F.call_function("shiftright", byte.cast("bigint"), (place % 8).cast("int"))) == 1


def search_postings(revisions: DataFrame, postings: DataFrame, asked: Asked) -> DataFrame:
    """Revisions for which what is asked holds, of those that the postings cover.

    Of a stored table only the id ranges with candidates are read. The bitmaps
    are broadcast if they are proven small, else joined by block. Negative ids,
    which have no bit, are tested by the predicate.
    """
    if asked.needs is None:
        return revisions.where(asked.predicate)
    if not asked.needs:
        return revisions.where(F.lit(False))
    shared_dir(revisions.sparkSession)
    bits = candidate_bitmaps(postings, asked.needs).checkpoint()
    rows = revisions.where("rev_id >= 0")
    width = range_width(revisions)
    if width is not None:
        first = F.col("block") * BLOCK_IDS
        ranges = F.sequence(id_range(first, width), id_range(first + (BLOCK_IDS - 1), width))
        # One number per id range: bounded by the id space, not by the rows.
        numbers = bits.select(F.explode(ranges)).distinct().collect()
        rows = rows.where(F.col("id_range").isin([r[0] for r in numbers]))
    side = small_side(bits, text_bytes=F.octet_length("bitmap"))
    place = F.pmod(F.col("rev_id"), F.lit(BLOCK_IDS))
    block = F.call_function("div", F.col("rev_id"), F.lit(BLOCK_IDS))
    met = rows.withColumn("block", block).join(side, "block")
    found = met.where(_has_bit(F.col("bitmap"), place) & asked.predicate).select(*revisions.columns)
    return found.unionByName(revisions.where("rev_id < 0").where(asked.predicate))
