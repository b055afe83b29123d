import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.functions import scalars
from hearthline.plans import bars, catalogue, market


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_are_those_of_the_sql(name, same):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_folds_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    close = (100 + rng.normal(size=80).cumsum()).tolist()
    fold = lambda closes: bars.fold_indicators(spark.createDataFrame([("x", datetime.date(2000, 1, 1) + datetime.timedelta(k), float(v)) for k, v in enumerate(closes)], "symbol string, day date, close double")).orderBy("day").toPandas().astype(object)
    got = fold(close).where(lambda f: f.notna(), None)

    def ema(x, n):
        out, last = [], None
        for v in x:
            last = v if last is None else last if v is None else last + 2 / (n + 1) * (v - last)
            out.append(last if v is not None else None)
        return out

    macd = [a - b if k >= 25 else None for k, (a, b) in enumerate(zip(ema(close, 12), ema(close, 26), strict=True))]
    signal = ema(macd, 9)
    assert got["macd"].iloc[24] is None and got["macd"].iloc[40] == pytest.approx(macd[40], abs=1e-5)
    assert got["signal"].iloc[60] == pytest.approx(signal[60], abs=1e-5)
    assert got["rsi"].iloc[13] is None and 0 <= got["rsi"].iloc[14] <= 100
    rising = fold(range(20))
    assert rising["rsi"].iloc[19] == 100.0


def test_folded_query(spark):
    rows = bars.folded_indicators(spark, "/root/testdata/sf0.001")
    assert rows.count() == bars.daily_bars(spark, "/root/testdata/sf0.001").count()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bands_and_their_bounds(spark):
    band = lambda v: one(spark, scalars.area_band(F.lit(v).cast("double")))
    assert [band(39.99), band(40), band(135), band(None)] == ["<40", "40-60", "135+", "unknown"]
    floor = lambda f, top: one(spark, scalars.floor_band(F.lit(f).cast("int"), F.lit(top).cast("int")))
    assert [floor(None, 9), floor(1, 9), floor(20, 20), floor(5, 20), floor(13, 20), floor(14, 20), floor(3, 5), floor(7, 7)] == ["unknown", "first", "top", "low", "middle", "high", "low", "middle"]


def test_verdict_bounds(spark):
    got = [one(spark, scalars.verdict(F.lit(x).cast("double"))) for x in (-10.0, -9.9, -3.0, 2.9, 3.0, 10.0, None)]
    assert got == ["very cheap", "cheap", "cheap", "fair", "dear", "very dear", None]


def test_distance_and_walk(spark):
    d = one(spark, scalars.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert d == pytest.approx(math.radians(1) * scalars.EARTH_M, rel=1e-9)
    assert [one(spark, scalars.walk_minutes(F.lit(x))) for x in (1.0, 67.0, 536.0)] == [1, 2, 10]


def test_spline_is_linear_beyond_its_knots(spark):
    at = lambda x: one(spark, scalars.spline_basis(F.lit(float(x)), [1.0, 2.0, 4.0, 8.0])[1])
    assert at(0) == 0
    assert at(12) - at(10) == pytest.approx(at(10) - at(8), rel=1e-9)


def test_dcf_table_equals_closed_form(spark):
    g, r, t = 0.05, 0.09, 0.025
    flows = sum(100 * ((1 + g) / (1 + r)) ** k for k in range(1, 6))
    want = flows + 100 * ((1 + g) / (1 + r)) ** 5 * (1 + t) / (r - t)
    assert one(spark, scalars.dcf(F.lit(100.0), F.lit(g), F.lit(r))) == pytest.approx(want, rel=1e-12)
    assert one(spark, scalars.dcf(F.lit(100.0), F.lit(g), F.lit(0.03))) is None


def test_index_carries_thin_months_and_keeps_the_first(spark):
    rows = [(1, 1, m, 100.0 * f, "") for m, f, n in (("2000-01", 1.0, 1), ("2000-02", 2.0, 4), ("2000-03", 1.5, 5)) for _ in range(n)]
    t = spark.createDataFrame(rows, "complex_id long, area_key long, deal_ym string, ppp double, deal_type string")
    got = {r["deal_ym"]: (r["n"], round(r["idx"], 6)) for r in market.index_of(t).collect()}
    assert got == {"2000-01": (1, round(1 / 1.5, 6)), "2000-02": (4, round(1 / 1.5, 6)), "2000-03": (5, 1.0)}


def test_empty_trades(spark):
    t = spark.createDataFrame([], "complex_id long, area_key long, deal_ym string, ppp double, deal_type string")
    assert market.index_of(t).count() == 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["deal_ym", "n", "idx"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
