"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is one sum for each shard. Differencing takes the two partial partitions with the largest
spread and adds them oppositely ordered, until one is left. Groups of equal texts are dealt to buckets of bounded
size, and each bucket differences its groups into bundles of near equal weight, in its own task. Heavy groups
stay single, and so do one bucket's groups, as small change. When what is left is few enough (a bound that does
not depend on the input), the driver differences bundles, heavy and loose groups into the shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.scratch import partitions, written

GROUPS_IN_BUCKET = 8192
ROWS_IN_CELL = 4096
HEAVY = 64  # a group over this part of a shard's even share stays single; shards * HEAVY stays below GROUPS_IN_BUCKET


def difference(partials: list[list[tuple[int, object]]], slots: int) -> list[tuple[int, object]]:
    """The one partition that differencing leaves: the (sum, content) of its filled slots, ascending.

    Each partial partition lists the (sum, content) of its filled slots, ascending by sum; contents are joined in
    pairs. Empty slots are the smallest ones and so take the other side's largest sums.
    """
    spread = lambda p: p[0][0] - p[-1][0] if len(p) == slots else -p[-1][0]
    heap = [(spread(p), k, p) for k, p in enumerate(partials)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - slots)
        joined = a[both:] + b[both:] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[:both], b[both - 1 :: -1] if both else (), strict=True)]
        joined.sort(key=lambda s: s[0])
        heapq.heappush(heap, (spread(joined), number, joined))
        number += 1
    return heap[0][2] if heap else []


def members(content: object) -> list:
    """The leaves of joined contents."""
    out, stack = [], [content]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            out.append(x)
    return out


def partition(weights: list[int], shards: int) -> np.ndarray:
    """The shard of each weight."""
    out = np.zeros(len(weights), np.int32)
    for shard, (_, content) in enumerate(difference([[(w, k)] for k, w in enumerate(weights)], shards)):
        out[members(content)] = shard
    return out


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """k, shard of each of the groups (k binary, weight long)."""
    spark = groups.sparkSession
    total = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    if total.n <= 3 * GROUPS_IN_BUCKET:
        few = groups.orderBy(F.desc("weight"), "k").toPandas()
        few["shard"] = partition(few["weight"].tolist(), shards)
        return spark.createDataFrame(few[["k", "shard"]], "k binary, shard int")
    buckets = -(-total.n // GROUPS_IN_BUCKET)
    bundles = max(shards, GROUPS_IN_BUCKET // (buckets - 1))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "k"], ascending=[False, True], ignore_index=True)
        part = partition(pdf["weight"].tolist(), bundles)
        pdf["up"] = [b"%d:%d:%d" % (buckets, n, p) for n, p in zip(pdf["node"].tolist(), part.tolist(), strict=True)]
        return pdf[["k", "up", "weight"]]

    node = F.when(F.col("weight") * (shards * HEAVY) >= F.lit(total.w), F.lit(0)).otherwise(F.pmod(F.xxhash64("k"), F.lit(buckets)))
    dealt = groups.withColumn("node", node)
    tied = dealt.filter("node > 0").repartition(min(buckets, 4 * partitions(spark)), "node").groupBy("node").applyInPandas(bundle, "k binary, up binary, weight long")
    tied = written(tied, "bundles")
    single = dealt.filter("node = 0").select("k", "weight")
    above = group_shards(written(single.unionByName(tied.groupBy(F.col("up").alias("k")).agg(F.sum("weight").alias("weight"))), "level"), shards)
    return single.join(above, "k").select("k", "shard").unionByName(tied.join(above.withColumnRenamed("k", "up"), "up").select("k", "shard"))


SHARDED = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: SHARDED. Law `bytes`: the shards' sizes are near equal and equal texts share a shard.

    A size is the text's UTF-8 bytes (null: none) and the overhead; null and empty texts are one group. A group
    larger than an even share fills a shard of its own and is not split. Slots number a shard's rows from 0
    without gaps: rows are dealt to cells of bounded size, counted by cell and shard, and numbered within them.
    A null key stays null, repeated rows have a slot each, and an empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(whole) + F.lit(overhead)).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.md5(whole.cast("binary"))).alias("k"))
    sized = written(sized, "sized")
    cells = max(1, -(-sized.count() // ROWS_IN_CELL))
    groups = sized.groupBy("k").agg(F.sum("size").alias("weight"))
    placed = group_shards(groups, shards)
    dealt = sized.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)))
    assigned = written(dealt.join(placed, "k"), "assigned")
    counts = assigned.groupBy("cell", "shard").agg(F.count("*").alias("n"))
    before = counts.select("cell", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("cell", "shard").orderBy("doc_id", "k"))
    return (
        assigned.withColumn("place", place).join(before, ["cell", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
