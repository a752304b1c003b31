"""Every query that has SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf001):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf001, db, name):
    df = registry.QUERIES[name](spark, sf001)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = db.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf001, name):
    assert registry.QUERIES[name](spark, sf001).count() > 0 or name == "minhash_pairs"
