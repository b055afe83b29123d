"""Regressions against dense matrices, and planted truths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.functions.distributions import beta_cdf, chi2_sf, normal_p, t_critical, t_p
from hearthline.operators.regression import absorbed, design, fold_errors, moments_by, settled_knots, weighted
from hearthline.plans import hedonic


def test_tails_of_distributions():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert chi2_sf(11.070497693516351, 5) == pytest.approx(0.05, rel=1e-10)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-10)
    assert normal_p(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert t_critical(10) == pytest.approx(2.2281388519649385, rel=1e-9) and t_critical(2) == pytest.approx(4.302652729911275, rel=1e-9)
    assert t_p(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9) and beta_cdf(0.5, 3.5, 3.5) == pytest.approx(0.5)


def panel(rng, groups=60, most=40, hot=600):
    """Rows of groups of very different sizes: (g, y, x1, x2, d)."""
    rows = []
    for g in range(groups):
        level = rng.normal(0, 1)
        for _ in range(hot if g == 0 else int(rng.integers(1, most))):
            x1, x2, d = rng.normal(level, 1), rng.normal(), int(rng.integers(0, 4))
            y = 3 + level + 0.5 * x1 - 0.25 * x2 + (0, 0.1, 0.2, -0.3)[d] + rng.normal(0, 0.2 * (1 + abs(x1)))
            rows.append((g, float(y), float(x1), float(x2), d))
    return rows


def spread(spark, rows):
    df = spark.createDataFrame(rows, "g long, y double, x1 double, x2 double, d int").repartition(7)
    return design(df, F.col("y"), [F.col("x1"), F.col("x2")], [F.when(F.col("d") > 0, F.col("d") + 1)], "g")


NAMES = ["x1", "x2", "d1", "d2", "d3"]


def dense(rows):
    g, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    z = np.array([[r[2], r[3], *(float(r[4] == k) for k in (1, 2, 3))] for r in rows])
    return g, y, z


def test_absorbed_groups_against_dummies(spark):
    rows = panel(np.random.default_rng(1))
    fit, levels, residuals = absorbed(spread(spark, rows), "g", NAMES)
    g, y, z = dense(rows)
    ids = np.unique(g)
    full = np.hstack([z, (g[:, None] == ids[None]).astype(float)])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert fit.beta == pytest.approx(beta[:5], abs=1e-9)
    e = y - full @ beta
    zt = z - np.array([z[g == k].mean(0) for k in ids])[g]
    inverse = np.linalg.inv(zt.T @ zt)
    n, p = zt.shape
    cov = inverse @ ((zt * (e**2)[:, None]).T @ zt) @ inverse * n / (n - p)
    assert fit.cov == pytest.approx(cov, abs=1e-10)
    scores = np.array([(zt[g == k] * e[g == k, None]).sum(0) for k in ids])
    clustered = inverse @ (scores.T @ scores) @ inverse * len(ids) / (len(ids) - 1) * (n - 1) / (n - p)
    assert fit.clustered == pytest.approx(clustered, abs=1e-10)
    got = {r["g"]: r for r in levels.collect()}
    for k in ids:
        mean, count = z[g == k].mean(0), (g == k).sum()
        se = math.sqrt((e[g == k] ** 2).sum() * n / (n - p - len(ids)) / count**2 + mean @ cov @ mean)
        assert (got[k]["n"], got[k]["alpha"], got[k]["se"]) == (count, pytest.approx(beta[5 + k], abs=1e-9), pytest.approx(se, rel=1e-8))
    assert sorted(r["e"] for r in residuals.select("e").collect()) == pytest.approx(sorted(e), abs=1e-9)
    assert np.abs(fit.beta - [0.5, -0.25, 0.1, 0.2, -0.3]).max() < 4 * fit.se().max()  # the planted truth


@pytest.mark.parametrize("n, small", [(400, 250), (120, 250)])
def test_weighted_fit_against_dense(spark, n, small):
    rng = np.random.default_rng(2)
    rows = [(k, float(rng.normal()), float(rng.normal()), float(rng.normal()), int(rng.integers(0, 4))) for k in range(n)]
    df = spread(spark, rows)
    w = F.lit(1.0) + F.pmod(F.col("g"), F.lit(5))
    fit, fitted = weighted(df, NAMES, w, small)
    g, y, z = dense(rows)
    wt = 1.0 + g % 5
    inverse = np.linalg.inv((z * wt[:, None]).T @ z)
    beta = inverse @ (z * wt[:, None]).T @ y
    u = wt * (y - z @ beta)
    if n < small:
        u = u / (1 - wt * np.einsum("ij,jk,ik->i", z, inverse, z))
    cov = inverse @ ((z * (u**2)[:, None]).T @ z) @ inverse * (1 if n < small else n / (n - 5))
    assert fit.beta == pytest.approx(beta, abs=1e-10) and fit.cov == pytest.approx(cov, abs=1e-10)
    assert fitted.agg(F.sum(F.col("w") * F.col("e"))).first()[0] == pytest.approx((wt * (y - z @ beta)).sum(), abs=1e-8)
    corr = np.corrcoef((z * np.sqrt(wt)[:, None]).T)  # of the same size as the inflation's
    assert set(fit.vif()) == set(NAMES) and min(fit.vif().values()) >= 1 - 1e-9 and corr.shape == (5, 5)


def test_knots_that_fall_together_are_fewer():
    at = {q: float(round(q / 10)) for q in hedonic.PERCENTS}
    assert settled_knots(at, 3, 7) is None
    assert len(settled_knots(at, 11, 7)) == 7
    assert settled_knots(dict.fromkeys(hedonic.PERCENTS, 1.0) | {95: 2.0}, 5, 5) is None
    assert settled_knots(dict.fromkeys(hedonic.PERCENTS, 1.0) | {10: 0.0, 90: 3.0, 50: 2.0}, 5, 7) == [0.0, 2.0, 3.0]


def complexes(rng, n, bend, effect=1.0):
    """Levels with errors of their own: (complex_id, alpha, se, walk_min, age, households, brand, district)."""
    rows = []
    for k in range(n):
        walk, age, house, se = float(rng.uniform(0, 30)), float(rng.integers(0, 40)), float(rng.normal(6, 1)), float(rng.uniform(0.02, 0.1))
        brand, district = ("north", "south", None)[k % 3], f"d{k % 4}"
        truth = 7 - effect * 0.02 * walk + bend * 0.15 * math.sin(walk / 6) - 0.004 * age + 0.05 * house + (0.1 if brand == "north" else 0) + 0.03 * (k % 4)
        rows.append((k, truth + rng.normal(0, 0.12) + rng.normal(0, se), se, walk, age, house if k % 10 else None, brand, district))
    return rows


SCHEMA = "complex_id long, alpha double, se double, walk_min double, age double, households double, brand string, district string"


def test_planted_curve_lies_in_its_band(spark):
    model = hedonic.StageTwo(spark.createDataFrame(complexes(np.random.default_rng(3), 900, 1.0), SCHEMA).repartition(5))
    assert 0.10 < math.sqrt(model.tau2) < 0.14
    truth = lambda w: -0.02 * w + 0.15 * math.sin(w / 6)
    points = hedonic.curve(model, "walk_min", 2.0, 28.0, 15.0)
    inside = [lo <= (math.exp(truth(x) - truth(15.0)) - 1) * 100 <= hi for x, _, lo, hi in points]
    assert sum(inside) >= 0.9 * len(inside)
    tests = {v: hedonic.linearity(model, v) for v in model.splines}
    assert tests["walk_min"]["p"] < 1e-6 and tests["walk_min"]["joint_p"] < 1e-6 and tests["walk_min"]["verdict"] == "bent"
    assert tests["age"]["joint_p"] < 0.05 and tests["age"]["slope"] == pytest.approx(-0.004, abs=4 * tests["age"]["slope_se"])
    terms = dict(zip(model.names, model.fit.beta, strict=True))
    assert terms["brand_north"] == pytest.approx(0.1, abs=0.04) and terms["sgg_d3"] == pytest.approx(0.09, abs=0.05)
    assert "households_missing" in terms and "brand_south" in terms and "sgg_d0" not in terms
    share = model.tau2 / (model.tau2 + 0.05**2)
    assert 0.8 < share < 1


def test_false_positives_of_the_linearity_test(spark):
    """Planted straight effects: about one test in twenty finds a bend."""
    rng = np.random.default_rng(8)
    found = [hedonic.linearity(hedonic.StageTwo(spark.createDataFrame(complexes(rng, 260, 0.0), SCHEMA).coalesce(1), "M0"), "walk_min")["p"] < 0.05 for _ in range(12)]
    assert sum(found) <= 3


def test_month_trend_and_empty_frame(spark):
    from hearthline.operators.regression import Fit

    fit = Fit(["a", "ym_1", "ym_2"], np.array([9.0, -0.02, -0.01]), np.eye(3), np.eye(4), 10)
    assert hedonic.month_trend(fit) == pytest.approx((math.exp(0.01) - 1) * 100)


def test_folds_equal_fits_of_their_own(spark):
    rng = np.random.default_rng(10)
    rows = [(k, float(rng.normal()), float(rng.normal()), float(rng.normal()), int(rng.integers(0, 4))) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, y double, x1 double, x2 double, d int").repartition(6)
    lines = design(df, F.col("y"), [F.lit(1.0), F.col("x1"), F.col("x2")], [F.when(F.col("d") > 0, F.col("d") + 2)], "g")
    sums = moments_by(lines, 6, 1.0 + F.col("g") % 3, F.col("g") % 5, 5)
    g, y, z = dense(rows)
    z, w = np.hstack([np.ones((300, 1)), z]), 1.0 + g % 3
    for kept in (list(range(6)), [0, 2, 3, 4, 5]):
        want = []
        for k in range(5):
            fit, own = g % 5 != k, g % 5 == k
            zk = z[:, kept]
            b = np.linalg.lstsq(zk[fit] * np.sqrt(w[fit, None]), y[fit] * np.sqrt(w[fit]), rcond=None)[0]
            want.append(math.sqrt(np.average((y[own] - zk[own] @ b) ** 2, weights=w[own])))
        assert fold_errors(sums, kept) == pytest.approx(want, rel=1e-9)


def test_planted_building_effects(spark):
    rng = np.random.default_rng(11)
    truth = {(c, d): float(rng.normal(0, 0.05)) for c in range(40) for d in range(4)}
    rows = [(c, a, d, truth[c, d] + float(rng.normal(0, 0.1)) + 0.02 * a) for c, d in truth for a in (0, 1) for _ in range(8)]
    rows += [(99, 0, 1, 0.1), (99, 0, 1, 0.1), (98, 0, 1, 0.1), (98, 0, 2, 0.2), (97, 0, None, 0.1)]  # alone in its cells; sold once each; no building
    got = hedonic.premiums(spark.createDataFrame(rows, "complex_id long, area_key long, dong long, e double").repartition(5)).collect()
    assert {(r["complex_id"], r["dong"]) for r in got} == set(truth)
    own = [truth[r["complex_id"], r["dong"]] - np.mean([truth[r["complex_id"], d] for d in range(4)]) for r in got]
    assert np.corrcoef(own, [r["effect"] for r in got])[0, 1] > 0.75
    assert all(abs(r["effect"]) <= abs(r["raw"]) for r in got)
