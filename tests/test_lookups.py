"""Nearest stations against all pairs, and where many stand in one place."""

import math
import time

import numpy as np

from hearthline.plans import lookups


def test_nearest_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    dense, wide = rng.normal(size=(150, 2)) * 30 + 6000, rng.uniform(0, 12000, (60, 2))
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.round(np.vstack([dense[:40] + 7, wide + 400, dense[:5] + 2300, [[6000, 6000], [6000, 6000], [-900, -900]]]), 1))]
    stations = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.round(np.vstack([dense, wide, np.repeat(wide[:3], 9, axis=0)]), 1))]
    got = lookups.nearest(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(stations, "station long, sx double, sy double"), 2500, 5)
    want = set()
    for k, x, y in places:
        own = sorted((round(math.hypot(x - a, y - b), 3), s) for s, a, b in stations)
        want |= {(k, rank, s, m) for rank, (m, s) in enumerate([o for o in own if o[0] <= 2500][:5], 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_many_stations_and_complexes_in_one_place(spark, tmp_path):
    key = lambda name: spark.range(30_000).selectExpr(f"id * 9973 AS {name}")  # noqa: E731  every key is one place
    key("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    key("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.time()
    rows = lookups.near_stations(spark, str(tmp_path))
    assert {(r["rank"], r["station"], r["metres"]): r["count"] for r in rows.groupBy("rank", "station", "metres").count().collect()} == {(k + 1, k * 9973, 0.0): 30_000 for k in range(5)}
    assert time.time() - began < 45  # all pairs would be 900 million
