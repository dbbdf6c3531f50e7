"""Every query with standard SQL against an independent engine on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__
from lodeframe.plans import catalogue, platform

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in (*catalogue.TABLES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if v.__class__.__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL | platform.ORACLE_SQL))
def test_query(spark, oracle, name):
    got = (catalogue.QUERIES | platform.QUERIES)[name](spark, SF)
    want = oracle.execute((catalogue.ORACLE_SQL | platform.ORACLE_SQL)[name])
    names = [d[0] for d in want.description]
    want = [dict(zip(names, r)) for r in want.fetchall()]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(got.columns)
    rows = sorted((str([plain(r[c]) for c in columns]) for r in got.collect()))
    assert rows == sorted(str([plain(r[c]) for c in columns]) for r in want)
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
