import hashlib
import re

import pytest

from editwake.llm import queries
from editwake.llm.secret_scan import KINDS, digest, redact, redacted, scan, spans_of

DATA = "/root/testdata/sf0.01"


def plain(text):
    """The base spans, by the patterns as they are worded."""
    found = []
    for m in re.finditer(
        r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""
    ):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def check_rows(rows, texts):
    for r in rows:
        base = plain(texts[r.doc_id])
        said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) or not said


def test_query_as_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_secret_scan"](spark, DATA).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 20
    check_rows(rows, texts)
    extra = [s for r in rows for s in r.spans.split(",") if s.startswith("literal")]
    assert len(extra) < 5  # invented prose assigns nothing else


ODD = [
    None, "", "PassWord = 'abcdefgh'", "token=secret=abcdefgh", "TOKEN : short", "ſecret=abcdefgh1", "toKen=abcdefgh1",
    "😀 api_key: \"k-1234567890\" AKIAAKIA12345678 AKIAX AKIA1234567890AB", "0" * 40 + "g" + "a" * 31, "apikey=" + "x" * 100_000,
    "secret = = abcdefgh", "password\n=\nabcdefghij",
]


def test_odd_texts(spark):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = digest(scan(docs)).collect()
    assert len(found) == len(rows)
    check_rows(found, dict(enumerate(ODD)))
    assert digest(scan(docs.limit(0))).collect() == []


@pytest.mark.parametrize(
    "text,secret",
    [
        ('K = "hunter2!Kx9$";\nuse(1)\ndb_password = K', "hunter2!Kx9$"),
        ('const a = "Zx81!qqP-w"; const b = a; conn.clientSecret = b', "Zx81!qqP-w"),
        ('pwd: "c0rrect!horse#9"', "c0rrect!horse#9"),
        ('{"privateKey": "mV8@kk21:pQ"}', "mV8@kk21:pQ"),
        ("export DB_PASS=t0p$ecret!77", "t0p$ecret!77"),
        ("passphrase => 'q9!Wz#Lm02'", "q9!Wz#Lm02"),
        ("credentials := `aB3$dE6^gH9`", "aB3$dE6^gH9"),
    ],
)
def test_literals_that_reach_sensitive_names(text, secret):
    spans = [s for s in spans_of(text) if s.kind == 3]
    assert [text[s.start : s.end] for s in spans] == [secret]
    assert secret not in redacted(text, spans_of(text))


def test_joined_literals():
    text = 'auth_pwd = "x7!Qm" + "Z2@kk9"\n'
    assert [text[s.start : s.end] for s in spans_of(text)] == ["x7!Qm", "Z2@kk9"]


@pytest.mark.parametrize(
    "text",
    ['pwd = "changeme"', "pwd: ${DB_PWD}", 'title = "aB3$dE6^gH9"', "The secret: of all things", "if token == other:", "pass: them 12:30",
     'pwd = "all of it"', 'k = "aB3$dE6^gH9"', "note: see http://a.b/c?d=1"],
)
def test_harmless_texts(text):
    assert spans_of(text) == []


def test_redaction(spark):
    rows = [(1, 'x password="abcdefgh12" AKIA1234567890ABCD y', 99, 7), (2, "clean", None, 8), (3, None, 3, 9), (3, None, 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, start int")
    out = sorted(map(tuple, redact(docs).collect()))
    text = 'x password="[assign]" [access] y'
    assert out[0] == (1, text, len(text), 7) and out[1:] == rows[1:]
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(300).collect():
        assert spans_of(redacted(r.text, spans_of(r.text))) == []
