"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from verbatim_spark import registry

TABLES = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7) + 0.0
    if isinstance(value, Decimal):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, TABLES)
    rows = [tuple(r) for r in found.collect()]
    assert len(set(found.columns)) == len(found.columns)
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert rows_of(found.columns, rows) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["adoption_gaps", "competitor_matrix"])
def test_part_keys_of_six_digits(spark, tmp_path, name):
    """The tables twice, the second time with other keys (parts from 100,000 on)."""
    c = duckdb.connect()
    keys = {"part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_partkey"]}
    for table, columns in keys.items():
        moved = ", ".join(f"{k} + n * 100000 AS {k}" for k in columns)
        c.sql(f"copy (select * exclude (n) replace ({moved}) from '{TABLES}/{table}.parquet', (select unnest([0, 1]) as n)) to '{tmp_path}/{table}.parquet'")
        c.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    found = registry.queries()[name](spark, str(tmp_path))
    want = c.sql(registry.oracle_sql()[name])
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(want.columns, want.fetchall())
