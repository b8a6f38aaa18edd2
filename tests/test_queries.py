"""Every core query on the smallest data; those with SQL against DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from loomspar.plans import registry


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else str(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, tables, name):
    df = registry.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLE_SQL:
        found = tables.execute(registry.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(got, df.columns) == normal(found.fetchall(), columns)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "doc_id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
