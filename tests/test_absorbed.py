"""Groups settled where their rows lie: no rows are sent, and groups that come in parts give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import regression
from hearthline.operators.ranks import quantiles
from hearthline.operators.regression import absorbed, clustered, design, moments, refitted, weighted
from hearthline.plans import hedonic
from hearthline.storage import written
from tests.conftest import DATA

NAMES = ["x1", "x2", "d1", "d2"]


def lines(spark, n, groups):
    """n rows; the first group holds a half of them."""
    c, noise = F.col, lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500 - 1
    df = spark.range(n).select("id", F.when(c("id") % 2 == 0, 0).otherwise(c("id") % groups).alias("g"), noise(1).alias("x1"), noise(2).alias("x2"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("d"), noise(3).alias("u"))
    laid = design(df.withColumn("y", c("x1") - c("x2") / 2 + c("d") * 0.3 + c("g") % 7 + c("u")), c("y"), [c("x1"), c("x2")], [F.when(c("d") > 0, c("d") + 1)], "id", "g")
    return laid.repartition(6)


def sent(spark):
    """Rows that all stages so far have shuffled."""
    jvm = spark.sparkContext
    stages = jvm._jsc.sc().statusStore().stageList(None, False, False, jvm._gateway.new_array(jvm._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_no_row_and_no_group_is_sent(spark):
    rows = written(clustered(lines(spark, 12000, 3001), "g"), "lines")
    before = sent(spark)
    fit, _, _ = absorbed(rows, "g", NAMES)
    assert (fit.n, fit.groups) == (12000, 3001)
    assert sent(spark) - before < 1500  # cells of tasks


def test_groups_in_parts_equal_whole_ones(spark):
    plain = lines(spark, 4 * regression.MOST, 11)  # one group is larger than what a task holds
    whole = absorbed(plain, "g", NAMES)
    scattered = written(clustered(plain, "g").repartition(5), "scattered")  # and here all are in all tasks
    parted = absorbed(scattered, "g", NAMES)
    pdf = plain.select("g", "y", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), F.get("hot", F.lit(0)).alias("h")).toPandas()
    z = np.column_stack([pdf.x1, pdf.x2, pdf.h == 2, pdf.h == 3, pdf.y]).astype(float)
    z -= np.array([z[pdf.g == k].mean(0) for k in range(11)])[pdf.g]
    beta = np.linalg.lstsq(z[:, :4], z[:, 4], rcond=None)[0]
    e = z[:, 4] - z[:, :4] @ beta
    inverse = np.linalg.inv(z[:, :4].T @ z[:, :4])
    cov = inverse @ (z[:, :4].T @ (z[:, :4] * (e * e)[:, None])) @ inverse * len(e) / (len(e) - 4)
    for fit, levels, residuals in (whole, parted):
        assert fit.beta == pytest.approx(beta, abs=1e-10) and fit.cov == pytest.approx(cov, rel=1e-6, abs=1e-14)
        assert (fit.n, fit.groups, fit.ssr) == (len(e), 11, pytest.approx((e * e).sum()))
        assert residuals.agg(F.sum(F.col("e") * F.col("e"))).first()[0] == pytest.approx((e * e).sum())
        got = {r["g"]: (r["n"], r["alpha"], r["se"]) for r in levels.collect()}
        assert sorted(got) == list(range(11)) and sum(n for n, _, _ in got.values()) == len(e)
        assert all(got[r["g"]] == pytest.approx((r["n"], r["alpha"], r["se"]), rel=1e-8) for r in whole[1].collect())
    assert parted[0].clustered == pytest.approx(whole[0].clustered, rel=1e-6)


@pytest.mark.parametrize("n", [120, 2000])
def test_fit_on_some_terms_equals_one_without_the_others(spark, n):
    rows = written(lines(spark, n, 5), "lines").withColumn("w", 1.0 + F.col("g") % 3)
    got = refitted(rows, NAMES, moments(rows, 4, F.col("w")), n, [0, 2, 3])
    want = weighted(rows.withColumn("x", F.slice("x", 1, 1)).withColumn("hot", F.transform("hot", lambda h: h - 1)), ["x1", "d1", "d2"], F.col("w"))[0]
    assert got.names == want.names and got.beta == pytest.approx(want.beta, abs=1e-10) and got.cov == pytest.approx(want.cov, rel=1e-8, abs=1e-12)
    assert got.ssr == pytest.approx(want.ssr) and got.gram == pytest.approx(want.gram)


def test_knots_of_few_and_many_values_are_quantiles(spark, monkeypatch):
    rows = spark.range(30000).select(F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(400)) / 7).alias("v"))
    want = quantiles(rows, [], "v", [p / 100 for p in hedonic.KNOT_PERCENTS[7]]).first()["q"]
    assert hedonic.knots_of(rows, "v", 7) == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(hedonic, "FEW", 5)
    assert hedonic.knots_of(rows, "v", 7) == pytest.approx(want, rel=1e-12)
    assert hedonic.knots_of(rows.where("v is null"), "v", 7) is None


def test_trades_are_sent_once(spark):
    assert hedonic.frame(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
