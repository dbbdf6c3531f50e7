"""Connected components of an edge table by alternating large-star and small-star rounds, each one written."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.scratch import dropped, written


def labelled(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component among 0 to n - 1, for links u[i], v[i] that one task holds."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: each node's larger neighbours go to its smallest one; small: its smaller neighbours and itself do."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        moved = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has an edge but the roots themselves.

    edges: a, b (long); loops, repeated and reversed edges do no harm. A hub is no problem: a node's smallest
    neighbour is found by partial aggregation, and the join that spreads it can be split.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        after = written(_star(_star(now, True), False), "edges")
        dropped(now)
        now = after
