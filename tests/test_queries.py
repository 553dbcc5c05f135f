"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from marginalia import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = (sorted(repr([plain(x) for x in row]) for row in rows) for rows in (r.fetchall(), [[row[k] for k in columns] for row in df.collect()]))
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
