"""Comparison of a query with its SQL on the small tables."""

from pathlib import Path

import duckdb


def same_as_sql(spark, queries, name, folder):
    """Whether the query's rows are those of its SQL over the tables in a folder; returns them."""
    database = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = queries.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    found = [tuple(r[n] for n in names) for r in df.collect()]
    relation = database.execute(queries.ORACLES[name])
    order = [c[0] for c in relation.description]
    assert sorted(order) == names
    want = [tuple(r[order.index(n)] for n in names) for r in relation.fetchall()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    return found
