"""Quantiles of few large groups: rows stay where they are."""

import numpy as np
from pyspark.sql import functions as F

from hearthline.operators.ranks import quantiles


def test_few_large_groups_are_not_brought_to_a_task_each(spark):
    rows = spark.range(3_000_000).select(F.when(F.col("id") % 3 > 0, "big").alias("g"), ((F.col("id") * 7919) % 3_000_017).cast("double").alias("v"))
    got = quantiles(rows, ["g"], "v", [0.25, 0.5])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    ids = np.arange(3_000_000)
    want = {g: np.quantile((ids[own] * 7919) % 3_000_017, [0.25, 0.5]).tolist() for g, own in (("big", ids % 3 > 0), (None, ids % 3 == 0))}
    assert {r["g"]: r["q"] for r in got.collect()} == want
