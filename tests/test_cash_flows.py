"""Implied growth against plain halving, what isn't there, and many rows."""

import time

import pytest
from pyspark.sql import functions as F

from hearthline.functions import scalars


def test_implied_growth_against_plain_halving(spark):
    def dcf(cash, growth, rate):
        z = (1 + growth) / (1 + rate)
        return sum(cash * z**t for t in range(1, 6)) + cash * z**5 * 1.025 / (rate - 0.025)

    def halved(cash, rate, cap):
        if None in (cash, rate, cap) or rate - 0.025 < 0.01 or not dcf(cash, -0.5, rate) <= cap <= dcf(cash, 1.0, rate):
            return None
        low, high = -0.5, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if dcf(cash, mid, rate) < cap else (low, mid)
        return (low + high) / 2

    rows = [(100.0, 0.09, 1000.0), (100.0, 0.05, 9000.0), (0.0, 0.09, 0.0), (100.0, 0.03, 1000.0), (None, 0.09, 1.0), (5.0, None, 1.0), (5.0, 0.1, None), (1.0, 0.13, 1e9), (-3.0, 0.08, -50.0)]
    got = spark.createDataFrame(rows, "cash double, rate double, cap double").select(scalars.implied_growth(*map(F.col, ("cash", "rate", "cap")))).collect()
    assert [g[0] for g in got] == [want if want is None else pytest.approx(want, abs=1e-12) for want in (halved(*r) for r in rows)]


def test_implied_growth_of_many_rows(spark):
    rows = spark.range(0, 500_000, 1, 4).select((F.col("id") % 977 + 1.0).alias("cash"), (F.col("id") % 11 / 100).alias("g"), (F.col("id") % 9 / 100 + 0.05).alias("rate"))
    began = time.time()
    off = rows.select(F.max(F.abs(scalars.implied_growth(F.col("cash"), F.col("rate"), scalars.dcf(F.col("cash"), F.col("g"), F.col("rate"))) - F.col("g")))).first()[0]
    assert off < 1e-9
    assert time.time() - began < 20
