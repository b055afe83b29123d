"""Rows in plain columns: they give what rows laid out as arrays give, and go to tasks in long batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.functions.scalars import spline_basis
from hearthline.operators.regression import Flat, absorbed, clustered, design, moments_by, predicted, weighted
from hearthline.plans import hedonic
from hearthline.storage import NUMBERS, number_rows, written
from tests.conftest import DATA

KNOTS = (-0.8, -0.2, 0.3, 0.7)
NAMES = ["x", "x__nl1", "x__nl2", "z", "d1", "d2", "m1"]
FLAT = Flat((("x", KNOTS), ("z", None)), ("d_at", "m_at"))


@pytest.fixture(scope="module")
def both(spark):
    """(the same rows in plain columns, and as arrays)."""
    c, noise = F.col, lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500 - 1
    df = spark.range(9000).select("id", (c("id") % 701).alias("g"), noise(1).alias("x"), noise(2).alias("z"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("d"), noise(3).alias("u"))
    df = df.withColumn("y", c("x") * c("x") - c("z") / 2 + c("d") * 0.3 + c("g") % 7 + c("u")).withColumn("d_at", F.when(c("d") > 0, c("d") + 3).cast("int")).withColumn("m_at", F.when(c("id") % 5 == 0, 6).cast("int"))
    flat = written(clustered(df, "g", 5), "flat")
    return flat, design(flat, c("y"), [*spline_basis(c("x"), list(KNOTS)), c("z")], [c("d_at"), c("m_at")], "id", "g", "size")


def test_absorbed_groups(both):
    flat, arrays = both
    got, want = absorbed(flat, "g", NAMES, FLAT), absorbed(arrays, "g", NAMES)
    assert got[0].beta == pytest.approx(want[0].beta, abs=1e-11) and got[0].cov == pytest.approx(want[0].cov, rel=1e-8, abs=1e-14)
    assert got[0].clustered == pytest.approx(want[0].clustered, rel=1e-8, abs=1e-14) and (got[0].n, got[0].groups) == (9000, 701)
    levels, residuals = ([{r[k]: r[v] for r in part.collect()} for part, k, v in ((x[1], "g", "se"), (x[2], "id", "e"))] for x in (got, want))
    assert levels[0] == pytest.approx(residuals[0], rel=1e-9) and levels[1] == pytest.approx(residuals[1], abs=1e-10)


@pytest.mark.parametrize("most", [9000, 120])
def test_weighted_fits_and_folds(both, most):
    flat, arrays = (rows.where(f"id < {most}") for rows in both)
    w, fold = 1.0 + F.col("g") % 3, F.col("g") % 4
    (got, fitted), (want, _) = weighted(flat, NAMES, w, flat=FLAT), weighted(arrays, NAMES, w)
    assert got.beta == pytest.approx(want.beta, abs=1e-10) and got.cov == pytest.approx(want.cov, rel=1e-7, abs=1e-12) and got.n == most
    assert moments_by(flat, 7, w, fold, 4, FLAT) == pytest.approx(moments_by(arrays, 7, w, fold, 4), rel=1e-9, abs=1e-9)
    own = {r["id"]: r["v"] for r in arrays.select("id", predicted(arrays, got.beta).alias("v")).collect()}
    assert {r["id"]: r["fitted"] for r in fitted.select("id", "fitted").collect()} == pytest.approx(own, abs=1e-10)
    assert np.isfinite(got.cov).all()


def test_both_stages_send_plain_numbers(spark):
    rows, _, flat = hedonic.stage_one_rows(written(hedonic.frame(spark, DATA), "frame"))
    assert {rows.schema[c].dataType.typeName() for c in flat.columns()} <= {"double", "integer"}
    model = hedonic.stage_two(spark, DATA)
    assert {model.design.schema[c].dataType.typeName() for c in model.flat.columns()} <= {"double", "integer"}


def test_buildings_go_to_the_trades_whatever_the_limit_of_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert hedonic.frame(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set(key, before)


def test_settings_come_back_also_after_an_error(spark):
    before = {key: spark.conf.get(key) for key in NUMBERS}
    with pytest.raises(ValueError), number_rows(spark):
        assert {key: spark.conf.get(key) for key in NUMBERS} == NUMBERS
        raise ValueError
    assert {key: spark.conf.get(key) for key in NUMBERS} == before
