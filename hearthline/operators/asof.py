"""Joins by time: as of a date, within a stretch, nearest to a date.

Each is an equality join on the keys and on buckets of time as wide as the reach, so the pairs
that are looked at are those of neighbouring buckets, whatever the history's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, reach: int) -> DataFrame:
    """left with the columns of the latest row of right (by keys) whose `known` is at most `at` and
    at least `at` - reach; null where there is none. Both are whole numbers (months, days). Of rows
    of right with one key and `known`, one is expected.

    Both sides are laid on one line and the last row of right before each row of left is read off,
    so nothing is multiplied; a window holds one key's rows of both."""
    rest = [c for c in right.columns if c not in [*keys, known]]
    lines = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(known, *rest)).schema[0].dataType).alias("_r"))
    facts = right.select(*keys, F.col(known).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(known, *rest).alias("_r"))
    last = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    seen = lines.union(facts).withColumn("_last", last).where("_side = 1")
    fresh = F.when(F.col(f"_last.{known}") >= F.col("_t") - reach, F.col("_last"))
    return seen.withColumn("_last", fresh).select("_l.*", "_last.*")


def within(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, at: str, widest: int) -> DataFrame:
    """Pairs of rows with equal keys where `at` of right lies after `low` and not after `high` of
    left. high - low is at most `widest`: longer stretches don't match."""
    a = left.where(F.col(high) - F.col(low) <= widest).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / widest), F.floor(F.col(high) / widest))))
    b = right.withColumn("_bucket", F.floor(F.col(at) / widest))
    return a.join(b, [*keys, "_bucket"]).where((F.col(at) > F.col(low)) & (F.col(at) <= F.col(high))).drop("_bucket")
