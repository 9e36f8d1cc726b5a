"""Secret scans by assignment-aware lexing.

Three patterns find well-formed secrets anywhere in a text. Beyond them, a lexer
reads what is assigned: names before ``=``, ``:``, ``:=`` or ``=>`` and the
literal behind, quoted, joined with ``+`` or bare, as source code, JSON, YAML,
shell and ini files have them. Literals that names stand for are propagated to
where the names are assigned on. A literal is scored by the words of the names
that it reaches and by its own looks; secrets of a high score are added.

Offsets are code points, ends are exclusive. Texts are whole. Null texts are
empty and have no spans. Rows are scanned one by one: repeated rows come out
alike, and other columns are kept or not read.
"""

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import prepare

KINDS = ("assign", "access", "hex", "literal")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")

#: Words of a name that make it sensitive, with their weight; pairs count as one word.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "api key": 3, "access key": 3, "private key": 3,
    "secret key": 3, "signing key": 3, "encryption key": 3, "client secret": 3, "bearer": 3,
    "auth": 2, "pass": 2, "authorization": 2, "dsn": 1, "key": 1, "salt": 1, "pin": 1,
}
PLACEHOLDER = re.compile(
    r"^$|^(.)\1*$|change.?me|example|placeholder|your[_ -]|<[^>]*>|^\[\w+\]$|\$\{|\{\{|^(none|null|true|false|undefined|string|required)$",
    re.IGNORECASE,
)
LEAST_SCORE = 5
LEAST_LENGTH = 6

OPERATOR = re.compile(r":=|=>|(?<![=!<>:])=(?!=)|:(?![:/])")
QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`")
BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
JOINT = re.compile(r"[ \t]*[+.]?[ \t]*\n?[ \t]*(?=[\"'`])")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
NAME = re.compile(r"[A-Za-z_$][\w$.-]*\Z")


class Span(NamedTuple):
    """A place of a secret; ``hide`` is where its value begins."""

    start: int
    kind: int
    end: int
    hide: int


def base_spans(text: str) -> list[Span]:
    """What the three patterns find, leftmost and without overlaps of a kind."""
    found = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append(Span(m.start(), 0, m.end(), m.start(2)))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS_LEAST:
            found.append(Span(m.start(), 1, m.end(), m.start()))
    found += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def name_before(text: str, end: int) -> str:
    """The name that an operator at ``end`` assigns to, or an empty text."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
        start -= 1
    name = text[start:end].lstrip(".-0123456789")
    return name if NAME.match(name) else ""


def sensitivity(name: str) -> int:
    """The greatest weight of a word, or of two words in a row, of a name."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    words = parts + [f"{a} {b}" for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(w, 0) for w in words), default=0)


def looks(literal: str) -> int:
    """Points for a literal's own looks: kinds of characters, evenness and length."""
    if len(literal) < LEAST_LENGTH or PLACEHOLDER.search(literal) or re.search(r"\s", literal):
        return -9
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    counts = Counter(literal)
    evenness = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    return (kinds >= 2) + (kinds >= 3) + (evenness >= 2.5) + (evenness >= 3.3) + (len(literal) >= 16)


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], str, bool]]:
    """Name, spans of the literals, name that is assigned instead of one, and whether quoted."""
    out = []
    for m in OPERATOR.finditer(text):
        name = name_before(text, m.start())
        if not name:
            continue
        at = m.end()
        while at < len(text) and text[at] in " \t":
            at += 1
        literals = []
        while quoted := QUOTED.match(text, at):
            group = quoted.lastindex or 1
            literals.append(quoted.span(group))
            joint = JOINT.match(text, quoted.end())
            if not joint or not joint.group().strip():
                break
            at = joint.end()
        if literals:
            out.append((name, literals, "", True))
        elif bare := BARE.match(text, at):
            value = bare.group().rstrip(".:!?")
            out.append((name, [(at, at + len(value))], value if NAME.match(value) else "", False))
    return out


def literal_spans(text: str) -> list[Span]:
    """Literals that reach sensitive names and look like secrets."""
    pairs = assignments(text)
    if not pairs:
        return []
    stands: dict[str, int] = {}  # a name's latest literal so far, by its place among the pairs
    source = list(range(len(pairs)))
    reached = [0] * len(pairs)
    for i, (name, _, other, quoted) in enumerate(pairs):
        if not quoted and other in stands:
            source[i] = stands[other]
        stands[name] = source[i]
        reached[source[i]] = max(reached[source[i]], sensitivity(name))
    found = []
    for i, (_, literals, _, quoted) in enumerate(pairs):
        if source[i] != i or reached[i] < 2:
            continue
        whole = "".join(text[a:b] for a, b in literals)
        # Bare values must not be words: they need digits among other characters.
        plain = not quoted and not (re.search(r"\d", whole) and re.search(r"\D", whole))
        if not plain and reached[i] + looks(whole) >= LEAST_SCORE:
            found += [Span(a, 3, b, a) for a, b in literals if a < b]
    return found


def spans_of(text: str) -> list[Span]:
    """All spans of a text by start and kind; literals inside base spans are not repeated."""
    base = base_spans(text)
    more = literal_spans(text) if "=" in text or ":" in text else []
    added, at, reached = [], 0, 0
    # Both lists are sorted: of the base spans that begin before a literal ends, the furthest end decides.
    for s in sorted(set(more)):
        while at < len(base) and base[at].start < s.end:
            reached = max(reached, base[at].end)
            at += 1
        if reached <= s.start:
            added.append(s)
    return sorted(base + added)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with the values of all spans replaced by the name of their kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.hide, -s.end)):
        if s.end <= at:
            continue
        if s.hide >= at:
            out += [text[at : s.hide], f"[{KINDS[s.kind]}]"]
        at = s.end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``spans``, an array of kind, start, end and value's start."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [
                [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "value": s.hide} for s in spans_of(t or "")]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], [id_col, "spans"])

    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,value:long>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as a text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return scanned.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with secrets replaced, and the count of characters brought up to date."""
    prepare(docs.sparkSession)

    @F.arrow_udf("string")
    def hidden(texts: pa.Array) -> pa.Array:
        found = texts.to_pylist()
        for i, text in enumerate(found):
            if spans := spans_of(text or ""):
                found[i] = redacted(text, spans)
            else:
                found[i] = None
        return pa.array(found, pa.string())

    # Only changed texts come back from the workers.
    text, changed = F.col(f"`{text_col}`"), F.col("_made.changed")
    kept = [F.col(f"_made.row.`{c}`") for c in docs.columns]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    made = docs.select(F.struct(row.alias("row"), hidden(text).alias("changed")).alias("_made"))
    new = F.coalesce(changed, F.col(f"_made.row.`{text_col}`")).alias(text_col)
    kept[docs.columns.index(text_col)] = new
    if chars_col in docs.columns:
        old = F.col(f"_made.row.`{chars_col}`")
        count = F.when(changed.isNotNull(), F.length(changed)).otherwise(old)
        kept[docs.columns.index(chars_col)] = count.cast(docs.schema[chars_col].dataType).alias(chars_col)
    return made.select(*kept)
