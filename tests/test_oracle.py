"""Every query with SQL against DuckDB."""

import decimal

import duckdb
import pytest

from tessera import registry
from tessera.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(table, columns):
    order = [columns.index(c) for c in sorted(columns)]
    out = [tuple(float(r[i]) if isinstance(r[i], decimal.Decimal) else r[i] for i in order) for r in table]
    return sorted(out, key=lambda r: [(str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)
