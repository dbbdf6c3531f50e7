"""As-of join: the latest row of the right side at or before the left row's time, by key.

Both sides go through one shuffle on the key and one sort on (time, side); a window carries the last right row
forward. Nothing is exploded: the cost is that of sorting the union of both sides. With `bucket`, the shuffle is on the
key and the time's bucket, so that a key with very many rows is sorted by many tasks; what a bucket starts with comes
from the last right rows of the buckets, one row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(lefts: DataFrame, rights: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, __b, __right: for every bucket of the left side that an earlier bucket's right row reaches, the latest one."""
    last = rights.groupBy(*by, "__b").agg(F.max_by("__right", F.struct("__t", "__tie")).alias("__last"))
    asked = lefts.groupBy(*by, "__b").agg(F.lit(True).alias("__asked"))
    per_bucket = last.unionByName(asked, allowMissingColumns=True).groupBy(*by, "__b").agg(F.first("__last", ignorenulls=True).alias("__last"), F.max("__asked").alias("__asked"))
    earlier = Window.partitionBy(*by).orderBy(F.col("__b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    reached = per_bucket.withColumn("__right", F.last("__last", ignorenulls=True).over(earlier))
    return reached.filter("__asked and __right is not null").select(*by, "__b", "__right")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, keep: Sequence[str], how: str = "left", strict: bool = False, tie: str | None = None, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the columns `keep` of the latest right row.

    how: "left" keeps rows without a match (null columns), "inner" drops them. strict: the right row must be earlier,
    not just no later. tie: a right column; of right rows at the same time the one with the largest value counts.
    bucket: a function of the time that never falls as the time grows, and is null for null times only, such as
    `lambda t: F.date_trunc("day", t)`; it splits keys with many rows and does not change the result.
    """
    held = F.struct(F.col(right_time).alias("__at"), *[F.col(c).alias(f"__r_{c}") for c in keep])
    lefts = left.select(*by, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("__tie"), F.struct(*left.columns).alias("__left"))
    rights = right.select(*by, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("__tie"), held.alias("__right")).filter("__t is not null")
    split = list(by)
    if bucket:
        lefts, rights = (side.withColumn("__b", bucket(F.col("__t"))) for side in (lefts, rights))
        split.append("__b")
    both = lefts.unionByName(rights, allowMissingColumns=True)
    if bucket:
        both = both.unionByName(_carried(lefts, rights, by), allowMissingColumns=True)  # no time: before the bucket's rows
    order = Window.partitionBy(*split).orderBy(F.col("__t").asc_nulls_first(), "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(order)).filter("__left is not null")
    if how == "inner":
        found = found.filter("__found is not null")
    return found.select("__left.*", *[F.col(f"__found.__r_{c}").alias(c) for c in keep])
