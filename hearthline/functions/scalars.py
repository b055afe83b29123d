"""Scalar functions of the domain, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from hearthline.sources.tables import PYEONG

#: Metres of the earth's radius; the cuts and names of bands and verdicts below.
EARTH_M = 6_371_008.8


def pyeong(area_m2: Column) -> Column:
    return area_m2 / PYEONG


def price_per_pyeong(amount: Column, area_m2: Column) -> Column:
    """Null where the area is not positive."""
    return F.when(area_m2 > 0, amount / pyeong(area_m2))


def walk_minutes(metres: Column) -> Column:
    """A detour of a quarter at 67 metres a minute, one minute at least."""
    return F.greatest(F.lit(1), F.ceil(metres * 1.25 / 67)).cast("long")


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def banded(value: Column, cuts: Sequence[float], names: Sequence[str], strict: bool = False) -> Column:
    """names[k] for the first cut that value does not exceed (strict: stays below)."""
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names, strict=False))):
        out = F.when(value < cut if strict else value <= cut, F.lit(name)).otherwise(out)
    return F.when(value.isNull(), F.lit("unknown")).otherwise(out)


def area_band(area_m2: Column) -> Column:
    return banded(area_m2, [40, 60, 85, 102, 135], ["<40", "40-60", "60-85", "85-102", "102-135", "135+"], strict=True)


def age_band(build_year: Column, ref_year: int) -> Column:
    return banded(F.lit(ref_year) - build_year, [5, 10, 15, 20, 30], ["0-5", "6-10", "11-15", "16-20", "21-30", "31+"])


def station_band(metres: Column) -> Column:
    return banded(metres, [400, 800, 1200], ["<=400", "<=800", "<=1200", "far"])


def floor_band(floor: Column, top: Column) -> Column:
    """first, low, middle, high or top; relative to the top floor of tall buildings."""
    share = floor / top
    tall = F.when(floor >= top, "top").when(share <= 0.25, "low").when(share <= 0.65, "middle").otherwise("high")
    flat = F.when(floor <= 3, "low").when(floor <= 7, "middle").otherwise("high")
    return F.when(floor.isNull(), "unknown").when(floor <= 1, "first").when(top >= 8, tall).otherwise(flat)


def verdict(gap_pct: Column) -> Column:
    """Of an asking price's gap to the fair price; the bounds differ in what they include."""
    return (
        F.when(gap_pct.isNull(), F.lit(None).cast("string"))
        .when(gap_pct <= -10, "very cheap").when(gap_pct <= -3, "cheap").when(gap_pct < 3, "fair").when(gap_pct < 10, "dear").otherwise("very dear")
    )


def pct_change(now: Column, then: Column) -> Column:
    """In percent; null if the base is null or zero."""
    return F.when(then != 0, (now / then - 1) * 100)


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline: x and one column for each knot but the last two."""
    t, k = list(knots), len(knots)
    beyond = lambda at: F.greatest(x - at, F.lit(0.0))
    cube = lambda at: beyond(at) * beyond(at) * beyond(at)
    out = [x]
    for j in range(k - 2):
        gap = t[-1] - t[-2]
        term = cube(t[j]) - cube(t[-2]) * ((t[-1] - t[j]) / gap) + cube(t[-1]) * ((t[-2] - t[j]) / gap)
        out.append(term / (t[-1] - t[0]) ** 2)
    return out


def interval_score(low: Column, high: Column, y: Column, alpha: float = 0.2) -> Column:
    miss = F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))
    return high - low + 2 / alpha * miss


def normal_p(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a series whose terms are all positive; beyond eight it is zero."""
    x2 = z * z / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda acc, n: F.struct((acc["term"] * 2 * x2 / (2 * n + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * x2 / (2 * n + 1)).alias("sum")), lambda acc: acc["sum"])
    inside = F.sqrt(F.lit(2 / 3.141592653589793)) * F.abs(z) * F.exp(-x2) * terms
    return F.when(F.abs(z) > 8, 0.0).otherwise(F.greatest(1 - inside, F.lit(0.0)))


def dcf(cash: Column, growth: Column, rate: Column, terminal: float = 0.025, years: int = 5) -> Column:
    """Value of cash that grows for some years and then for ever; null if rate is within one
    point of the terminal growth."""
    ratio = (1 + growth) / (1 + rate)
    flows = reduce(lambda acc, t: acc + cash * F.pow(ratio, F.lit(t)), range(1, years + 1), F.lit(0.0))
    last = cash * F.pow(ratio, F.lit(years)) * (1 + terminal) / (rate - terminal)
    return F.when(rate - terminal >= 0.01, flows + last)


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds / 60


def household_band(count: Column) -> Column:
    """By number of households; none or zero is unknown."""
    return banded(F.when(count != 0, count), [300, 600, 1000, 1500], ["<300", "300-600", "600-1000", "1000-1500", "1500+"], strict=True)


def area_type_key(area_m2: Column) -> Column:
    """Whole square metres, halves to the even one."""
    return F.bround(area_m2, 0).cast("long")


def knots_for(n: Column) -> Column:
    """How many spline knots a number of complexes carries."""
    return F.when(n >= 1500, 7).when(n >= 700, 6).when(n >= 250, 5).otherwise(4)


def log_to_pct(delta: Column) -> Column:
    return (F.exp(delta) - 1) * 100


def month_number(ym: Column) -> Column:
    """Of yyyyMM."""
    return (F.substring(ym, 1, 4).cast("long") * 12 + F.substring(ym, 5, 2).cast("long") - 1).cast("long")


def month_name(number: Column) -> Column:
    """yyyyMM of a month's number."""
    return F.concat(F.lpad(F.floor(number / 12).cast("string"), 4, "0"), F.lpad((number % 12 + 1).cast("string"), 2, "0"))


def shift_month(ym: Column, months: int) -> Column:
    return month_name(month_number(ym) + months)


def quarter_end(quarter: Column) -> Column:
    """The number of the last month of yyyyQn."""
    return (F.substring(quarter, 1, 4).cast("long") * 12 + F.substring(quarter, 6, 1).cast("long") * 3 - 1).cast("long")


def fifth_of(percentile: Column) -> Column:
    """0 to 4 by percentile."""
    return F.least(F.floor(percentile / 20), F.lit(4)).cast("long")


def sign_of(low: Column, high: Column) -> Column:
    """What an interval says about a sign."""
    return F.when(low > 0, "pos").when(high < 0, "neg").otherwise("none")


def near(a: Column, b: Column, share: float = 0.03) -> Column:
    return F.abs(a - b) <= share * (a + b) / 2


def line_at(i1: Column, v1: Column, i2: Column, v2: Column, t: Column) -> Column:
    """The value at t of the line through two points."""
    return v1 + (v2 - v1) * (t - i1) / (i2 - i1)


def cagr(now: Column, then: Column, years: int) -> Column:
    """Growth a year; null unless both values are positive."""
    return F.when((now > 0) & (then > 0), F.pow(now / then, F.lit(1 / years)) - 1)


def dcf_rows(cash: Column, growth: Column, rate: Column, years: int = 5) -> Column:
    """array<struct<year, cash, discount, value>> of the growing years."""
    def row(t: Column) -> Column:
        flow, discount = cash * F.pow(1 + growth, t), 1 / F.pow(1 + rate, t)
        return F.struct(t.alias("year"), flow.alias("cash"), discount.alias("discount"), (flow * discount).alias("value"))

    return F.array(*(row(F.lit(t)) for t in range(1, years + 1)))


def implied_growth(cash: Column, rate: Column, cap: Column, low: float = -0.5, high: float = 1.0, terminal: float = 0.025, years: int = 5) -> Column:
    """The growth at which dcf gives cap, by halving [low, high] 60 times; null if it isn't there. Batches of rows are
    halved together, with the powers of dcf as one polynomial."""

    def value(cash: np.ndarray, growth: np.ndarray, rate: np.ndarray, last: np.ndarray) -> np.ndarray:
        ratio = (1 + growth) / (1 + rate)
        out = 1 + last
        for _ in range(years - 1):
            out = out * ratio + 1
        return cash * (out * ratio)

    @F.pandas_udf("double")
    def found(cash: pd.Series, rate: pd.Series, cap: pd.Series) -> pd.Series:
        c, r, v = (x.to_numpy(dtype=np.float64, na_value=np.nan) for x in (cash, rate, cap))
        with np.errstate(all="ignore"):
            last = np.where(r - terminal >= 0.01, (1 + terminal) / (r - terminal), np.nan)
            lo, hi = np.full(len(c), low), np.full(len(c), high)
            for _ in range(60):
                mid = (lo + hi) / 2
                under = value(c, mid, r, last) < v
                lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
            return pd.Series(np.where(np.isnan(last), np.nan, (lo + hi) / 2))

    inside = (dcf(cash, F.lit(low), rate, terminal, years) <= cap) & (cap <= dcf(cash, F.lit(high), rate, terminal, years))
    return F.when(inside, found(cash.cast("double"), rate.cast("double"), cap.cast("double")))


def rounded(value: Column, places: int = 2) -> Column:
    """Null for what is no finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.round(value, places))


def interpolated(xs: Column, ys: Column, x: Column) -> Column:
    """Piecewise-linear through (xs, ys), xs rising; level beyond both ends."""
    after = F.size(F.filter(xs, lambda v: v <= x))
    at = lambda a, k: F.get(a, k)
    inner = line_at(at(xs, after - 1), at(ys, after - 1), at(xs, after), at(ys, after), x)
    return F.when(after == 0, at(ys, F.lit(0))).when(after == F.size(xs), at(ys, after - 1)).otherwise(inner)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _sides(ring: Column) -> Column:
    """The sides of a closed ring array<struct<x, y>>, whose last point is its first."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(_sides(ring), F.lit(0.0), lambda acc, s: acc + s["x1"] * s["y2"] - s["x2"] * s["y1"])) / 2


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring: a ray to the right crosses an odd number of sides."""
    def crosses(s: Column) -> Column:
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"]))

    return F.size(F.filter(_sides(ring), crosses)) % 2 == 1


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)
