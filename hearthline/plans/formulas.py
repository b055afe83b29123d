"""Formulas and parsers applied to whole tables, row by row: scalars, cash flows, listing texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions import listings, scalars
from hearthline.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def line_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, keys, months and shares of every line."""
    c = F.col
    day = c("l_shipdate").cast("date")
    ym = F.date_format(day, "yyyyMM")
    quarter = F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    return _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.round(scalars.seconds_to_minutes(c("l_extendedprice")), 4).alias("minutes"), scalars.household_band(c("l_partkey")).alias("households"), scalars.area_type_key(c("l_quantity") / 2).alias("area_key"),
        scalars.knots_for(c("l_partkey")).cast("long").alias("knots"), F.round(scalars.log_to_pct(c("l_discount")), 8).alias("pct"), scalars.month_number(ym).alias("month"), scalars.shift_month(ym, -7).alias("shifted"),
        scalars.quarter_end(quarter).alias("quarter_end"), scalars.fifth_of(c("l_quantity") * 2).alias("fifth"), scalars.sign_of(c("l_tax") - 0.04, c("l_discount") - 0.03).alias("sign"), scalars.near(c("l_quantity"), c("l_linenumber") * 5.0).alias("near"),
        F.round(scalars.line_at(F.lit(1), c("l_quantity"), F.lit(8), c("l_quantity") * 2, c("l_linenumber")), 6).alias("on_line"), F.round(scalars.cagr(c("l_extendedprice"), c("l_quantity") * 900, 3), 8).alias("cagr"), F.datediff(F.lit("2002-01-01"), day).cast("long").alias("days"),
        scalars.rounded(F.log(c("l_discount")), 6).alias("log_discount"),
    )


LINE_FORMULAS = """SELECT l_orderkey, l_linenumber, round(l_extendedprice / 60, 4) AS minutes,
  CASE WHEN l_partkey = 0 THEN 'unknown' WHEN l_partkey < 300 THEN '<300' WHEN l_partkey < 600 THEN '300-600' WHEN l_partkey < 1000 THEN '600-1000' WHEN l_partkey < 1500 THEN '1000-1500' ELSE '1500+' END AS households,
  CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS area_key, CAST(CASE WHEN l_partkey >= 1500 THEN 7 WHEN l_partkey >= 700 THEN 6 WHEN l_partkey >= 250 THEN 5 ELSE 4 END AS BIGINT) AS knots, round((exp(l_discount) - 1) * 100, 8) AS pct,
  year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month, strftime(date_trunc('month', l_shipdate) - INTERVAL 7 MONTH, '%Y%m') AS shifted, year(l_shipdate) * 12 + quarter(l_shipdate) * 3 - 1 AS quarter_end, CAST(least(floor(l_quantity * 2 / 20), 4) AS BIGINT) AS fifth,
  CASE WHEN l_tax - 0.04 > 0 THEN 'pos' WHEN l_discount - 0.03 < 0 THEN 'neg' ELSE 'none' END AS sign, abs(l_quantity - l_linenumber * 5.0::DOUBLE) <= 0.03::DOUBLE * (l_quantity + l_linenumber * 5.0::DOUBLE) / 2 AS near,
  round(l_quantity + (l_quantity * 2 - l_quantity) * (l_linenumber - 1) / 7, 6) AS on_line, round(pow(l_extendedprice / (l_quantity * 900), 1.0::DOUBLE / 3) - 1, 8) AS cagr, date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01') AS days,
  CASE WHEN l_discount > 0 THEN round(ln(l_discount), 6) END AS log_discount FROM lineitem"""


def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of each line's price as cash that grows by the discount, the sum of its growing years,
    and the growth that the value implies, which is the discount again."""
    cash, growth, rate = F.col("l_extendedprice"), F.col("l_discount"), F.lit(0.05) + F.col("l_tax")
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", scalars.dcf(cash, growth, rate).alias("value"), scalars.dcf_rows(cash, growth, rate).alias("rows"), cash.alias("cash"), rate.alias("rate"))
    years = sum((F.col("rows")[k]["value"] for k in range(5)), F.lit(0.0))
    return rows.select("l_orderkey", "l_linenumber", F.round("value", 2).alias("value"), F.round(years, 2).alias("growing"), F.round(scalars.implied_growth(F.col("cash"), F.col("rate"), F.col("value")), 6).alias("growth"))


CASH_FLOWS = """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS c, l_discount AS g, 0.05::DOUBLE + l_tax AS r, list_sum(list_transform(range(1, 6), lambda t: l_extendedprice * pow((1 + l_discount) / (1 + 0.05::DOUBLE + l_tax), t))) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(s + c * pow((1 + g) / (1 + r), 5) * 1.025::DOUBLE / (r - 0.025::DOUBLE), 2) AS value, round(s, 2) AS growing, round(g, 6) AS growth FROM l"""


def parsed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line written as a listing's text and read again."""
    c = F.col
    man = (F.floor(c("l_extendedprice")) % 9000 + 1000).cast("long")
    comma = F.concat(F.floor(man / 1000).cast("string"), F.lit(","), F.lpad((man % 1000).cast("string"), 3, "0"))
    text = F.concat(
        F.lit("한빛 아파트 "), (c("l_suppkey") % 900 + 1).cast("string"), F.lit("동\n매매 "), (F.floor(c("l_extendedprice") / 10000) + 1).cast("string"), F.lit("억 "), comma, F.lit("\n"), comma,
        F.lit("만원/3.3㎡평당가 도움말\n아파트"), (c("l_quantity").cast("long") + 90).cast("string"), F.lit("B㎡ (전용"), (c("l_quantity").cast("long") + 20).cast("string"), F.lit("A)"), c("l_linenumber").cast("string"), F.lit("/25층"),
        F.element_at(F.array(*map(F.lit, ["남동", "북", "서"])), (c("l_linenumber") % 3 + 1).cast("int")), F.lit("향"),
    )
    rows = listings.with_readings(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", text.alias("text")), c("text"), "l_orderkey", "l_linenumber")
    return rows.select(
        "l_orderkey", "l_linenumber", "price", c("area.exclusive").alias("exclusive"), c("area.supply").alias("supply"), c("floor.floor").alias("floor"), c("floor.top").alias("top"),
        listings.building(c("laid"), True).alias("building"), listings.stated_price(c("laid"), True).alias("stated"), listings.facing_group(listings.facing(c("laid"), True)).alias("facing"),
    )


PARSED_LISTINGS = """WITH l AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 9000 + 1000 AS man FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 10000) + 1 AS BIGINT) * 10000 + man AS price, CAST(CAST(l_quantity AS BIGINT) + 20 AS DOUBLE) AS exclusive, CAST(CAST(l_quantity AS BIGINT) + 90 AS DOUBLE) AS supply, CAST(l_linenumber AS BIGINT) AS floor, CAST(25 AS BIGINT) AS top,
  CAST(l_suppkey % 900 + 1 AS VARCHAR) AS building, man AS stated, CASE l_linenumber % 3 WHEN 0 THEN '동' WHEN 1 THEN '북' ELSE '서' END AS facing FROM l"""

QUERIES = {f.__name__: f for f in (line_formulas, cash_flows, parsed_listings)}
SQL = {"line_formulas": LINE_FORMULAS, "cash_flows": CASH_FLOWS, "parsed_listings": PARSED_LISTINGS}
