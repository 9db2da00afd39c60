"""Every registered query against its SQL in another engine, on small tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 6) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = contract.queries()[name](spark, sf)
    told = duck.execute(ORACLE[name])
    names = [c[0] for c in told.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, told.fetchall())


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["seq", "timestamp", "sensor_id", "metric_id", "value"] and found.count() > 500


def test_names_agree():
    assert set(ORACLE) <= set(contract.queries())
