"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from framewright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    found = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    got = sorted((tuple(normal(r[c]) for c in columns) for r in rows), key=repr)
    assert got == sorted((tuple(normal(r[i]) for i in at) for r in found.fetchall()), key=repr)
