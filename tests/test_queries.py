"""Each query with SQL gives the rows that DuckDB gives on the same tables; the others give rows."""

import math

import duckdb
import pytest

from strataq.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in catalog.ORACLES:
        found = duck.sql(catalog.ORACLES[name])
        names = found.columns
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
