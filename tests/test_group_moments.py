"""Sums of groups and cross-products from one pass."""

import numpy as np
from pyspark.sql import functions as F

from hearthline.operators.regression import clustered, design, group_moments


def test_one_pass_gives_cross_products_and_few_parts_of_each_group(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 3 else g, *map(float, rng.normal(size=3)), int(rng.integers(0, 4)), int(rng.integers(0, 3))) for g in (0, *range(60)) for _ in range(2500 if g == 0 else int(rng.integers(1, 30)))]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(None if v is None else t(v) for t, v in zip((int, float, float, float, int, int), r, strict=True)) for r in rows], "g long, y double, x1 double, x2 double, d int, m int").repartition(7)
    laid = design(df, F.col("y"), [F.col("x1"), F.col("x2")], [F.when(F.col("d") > 0, F.col("d") + 1), F.when(F.col("m") > 0, F.col("m") + 4)], "g")
    products, groups = group_moments(clustered(laid, "g"), "g", 7, {"s": F.lit(1.0), "sy": F.col("y")}, "sy")
    y = np.array([r[1] for r in rows], dtype=float)
    z = np.array([[r[2], r[3], *(float(r[4] == k) for k in (1, 2, 3)), *(float(r[5] == k) for k in (1, 2)), r[1], 1.0] for r in rows], dtype=float)
    assert np.allclose(products, z[:, :8].T @ (z[:, :8] * y[:, None]))
    found = {r["g"]: r for r in groups.collect()}
    keys = np.array([-1 if r[0] is None else r[0] for r in rows])
    assert len(found) == 60
    for g, r in found.items():
        own = keys == (-1 if g is None else g)
        assert len(r["k"]) == len(set(r["k"])) <= 9  # one part, however many rows
        for name, w in (("s", np.ones(len(y))), ("sy", y)):
            assert np.allclose(np.bincount(r["k"], r[name], 9), (z[own] * w[own, None]).sum(0))
