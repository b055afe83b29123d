"""Exact ranks and quantiles of groups that may hold any share of the rows.

Rows are dealt by ranges of (group, order), ranked within a range, and moved up by the counts of
the ranges before it, so no task holds a group and the driver sees none of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.storage import written


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's rank (from 1) among the rows of its group. Equal rows may come in either
    order; a unique last column in `order` makes ranks definite."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id()
    spread = df.withColumn("_tie", tie).repartitionByRange(parts, *group, *order, "_tie").withColumn("_range", F.spark_partition_id())
    fixed = written(spread, "ranges")
    within = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order, "_tie"))
    counts = fixed.groupBy("_range", *group).agg(F.count("*").alias("_n"))  # ranges by groups
    so_far = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0))).drop("_n")
    on = F.lit(True)
    for c in ["_range", *group]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = fixed.withColumn("_at", within).alias("l").join(before.alias("r"), on)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("l._at") + F.col("r._before")).cast("long").alias(name))


def beside_median(df: DataFrame, group: list[str], value: str, median: str, size: str) -> DataFrame:
    """df with the median of value in each row's group and the group's size: for many small groups, which
    are sorted once and need no join. value has no nulls."""
    whole = Window.partitionBy(*group)
    placed = df.withColumn(size, F.count("*").over(whole)).withColumn("_at", F.row_number().over(whole.orderBy(value)))
    here = lambda k: F.max(F.when(F.col("_at") == k, F.col(value))).over(whole)
    low, high = here(F.floor((F.col(size) + 1) / 2)), here(F.ceil((F.col(size) + 1) / 2))
    return placed.withColumn(median, low + (high - low) * 0.5).drop("_at")


ACCURACY = 10_000  # of a sketch's ranks: it is off by at most a share of 1 / ACCURACY


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float], hold: bool = False) -> DataFrame:
    """group columns, n, q (array): the linearly interpolated quantiles of the non-null values, exact.

    One pass sketches each group and gives a narrow range of values around each quantile. A second
    counts: values in a range one by one, those between ranges together. So a group is known by a few
    cells that are added up where the rows are, whatever its size, and rows aren't sorted. hold: groups and
    values are written between the passes, where making df anew costs more than that."""
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    rows = written(rows, "values") if hold else rows
    shares = [x for q in at for x in (max(q - 3 / ACCURACY, 0.0), min(q + 3 / ACCURACY, 1.0))]
    cuts = rows.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("_v", shares, ACCURACY).alias("_cuts"))
    bounds = [(f"_lo{k}", f"_hi{k}") for k in range(len(at))]
    cuts = cuts.select(*group, "n", *(F.col("_cuts")[i].alias(c) for i, c in enumerate(c for pair in bounds for c in pair)))
    if group:
        cuts = written(cuts, "cuts")  # of known size, so that cuts of few groups go to the rows, not large groups to one task
        on = F.lit(True)
        for c in group:
            on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
        joined = rows.alias("r").join(cuts.alias("c"), on).select(*(F.col(f"r.{c}") for c in group), "_v", "n", *(c for pair in bounds for c in pair))
    else:
        joined = rows.crossJoin(F.broadcast(cuts))  # one row
    # a small group's ranges could miss a neighbour that a quantile lies between, so all its values count
    near = reduce(lambda a, b: a | b, (F.col("_v").between(F.col(lo), F.col(hi)) for lo, hi in bounds), F.col("n") <= 2 * ACCURACY)
    passed = [F.when(F.col(hi) < F.col("_v"), F.col(hi)) for _, hi in bounds]
    below = F.greatest(*passed) if len(passed) > 1 else passed[0]  # between ranges: what lies before
    keyed = joined.select(*group, "n", near.alias("_near"), F.when(near, F.col("_v")).otherwise(below).alias("_key"))
    cells = keyed.groupBy(*group, "n", "_near", "_key").agg(F.count("*").alias("_count"))
    order = Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.asc_nulls_first("_key"), F.desc("_near"))
    placed = cells.withColumn("_to", F.sum("_count").over(order))
    sure = F.when(F.col("_near"), F.col("_key")).otherwise(F.raise_error(F.lit("a quantile lies outside its range")).cast(rows.schema["_v"].dataType))

    def pick(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(q)
        here = lambda rank: F.max(F.when((rank > F.col("_to") - F.col("_count")) & (rank <= F.col("_to")), sure))
        low, high = here(F.floor(place) + 1), here(F.ceil(place) + 1)
        return low + (high - low) * F.max(place - F.floor(place))

    return placed.groupBy(*group).agg(F.max("n").alias("n"), F.array(*map(pick, at)).alias("q"))
