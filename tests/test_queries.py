"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    rows = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = database.execute(ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    places = [order.index(n) for n in names]
    assert rows == sorted(repr(tuple(r[i] for i in places)) for r in found.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert [(r.period, r.hits > 0) for r in entry.entry(spark).collect()] == [("2006-02", True)]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
