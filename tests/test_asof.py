"""The as-of join, with and without buckets, against a loop over all rows."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeframe.operators.asof import asof_join
from lodeframe.operators.profile import column_stats


def made(seed):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 12))
    key = lambda: rng.choices([1, 2, 3, None], [8, 1, 1, 1])[0]
    return [(k, key(), at()) for k in range(150)], [(k, key(), at()) for k in range(60)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_buckets_change_nothing(spark, strict, how):
    lefts, rights = made(3)
    want = set()
    for n, key, t in lefts:
        known = [(u, m) for m, k, u in rights if k == key and t is not None and u is not None and (u < t or not strict and u == t)]
        if known or how == "left":
            want.add((n, max(known)[1] if known else None))
    left, right = spark.createDataFrame(lefts, "id int, k int, t timestamp"), spark.createDataFrame(rights, "m int, k int, u timestamp")
    for bucket in (None, lambda c: c.cast("date"), lambda c: F.date_trunc("month", c), lambda c: F.date_trunc("hour", c)):
        got = asof_join(left, right, ["k"], "t", "u", ["m"], how=how, strict=strict, tie="m", bucket=bucket)
        assert got.columns == ["id", "k", "t", "m"]
        assert sorted(((r.id, r.m) for r in got.collect()), key=str) == sorted(want, key=str)
    for empty in (left, right):
        assert asof_join(left if empty is right else left.limit(0), right.limit(0), ["k"], "t", "u", ["m"], bucket=lambda c: c.cast("date")).count() == (150 if empty is right else 0)


def test_a_hot_key_is_dealt_by_bucket(spark):
    left = spark.range(1000).selectExpr("1 as k", "timestamp_seconds(id * 3600) as t")
    joined = asof_join(left, left.withColumnRenamed("t", "u"), ["k"], "t", "u", ["u"], bucket=lambda c: c.cast("date"))
    assert joined.filter("u <> t or u is null").isEmpty()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(k#\d+, __b#\d+", plan)


def test_distinct_counts_are_not_expanded(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, None), (2, "b", None)], "x int, `y.z` string, n double")
    stats = column_stats(df)
    assert "Expand" not in stats._jdf.queryExecution().executedPlan().toString()
    assert [(r.column_name, r.n_rows, r.nulls, r.distinct, r.low, r.high) for r in stats.orderBy("column_name").collect()] == [("n", 3, 3, 0, None, None), ("x", 3, 0, 2, "1", "2"), ("y.z", 3, 1, 2, "a", "b")]
    assert sorted(r.distinct for r in column_stats(df.limit(0)).collect()) == [0, 0, 0]
