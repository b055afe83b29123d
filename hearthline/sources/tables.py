"""The logical tables of the engine, bound to the star-schema Parquet tables.

Each function reads only the columns that it names, so a query's projection and filters reach
the scan. Types are made explicit here: amounts and areas are doubles, keys are longs, months
are ``yyyy-MM`` strings with a long month index beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.operators.ranks import quantiles

#: Fixed value: square metres of one pyeong.
PYEONG = 3.305785


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("long")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trade: complex_id, deal_date, deal_ym, mi, exclusive_area, area_key,
    floor, dong, deal_amount, ppp, deal_type (direct, broker or '')."""
    x = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "direct").when(F.col("l_returnflag") == "A", "broker").otherwise("")
    area = F.col("l_quantity").cast("double")
    day = F.col("l_shipdate").cast("date")
    return x.select(
        F.col("l_partkey").cast("long").alias("complex_id"),
        day.alias("deal_date"),
        F.date_format(day, "yyyy-MM").alias("deal_ym"),
        month_index(day).alias("mi"),
        area.alias("exclusive_area"),
        F.bround(area, 0).cast("long").alias("area_key"),
        F.col("l_linenumber").cast("long").alias("floor"),
        F.col("l_suppkey").cast("long").alias("dong"),
        F.col("l_extendedprice").cast("double").alias("deal_amount"),
        (F.col("l_extendedprice").cast("double") / (area / PYEONG)).alias("ppp"),
        kind.alias("deal_type"),
    )


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complex_id, name, sgg, umd, size (1 to 50; stands for age and households), level."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("complex_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("sgg"),
        F.col("p_type").alias("umd"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_retailprice").cast("double").alias("level"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (order priority), day, close: the mean order value of the day."""
    x = table(spark, sf_dir, "orders")
    rows = x.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("v"))
    return rows.groupBy("symbol", "day").agg(F.avg("v").alias("close"))


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (order priority), ym, mi, value: the mean order value of the month; cents and n: the sum
    in cents and the number of orders."""
    x = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = x.select(F.col("o_orderpriority").alias("series"), F.date_format(day, "yyyy-MM").alias("ym"), month_index(day).alias("mi"), F.col("o_totalprice").cast("double").alias("v"))
    return rows.groupBy("series", "ym", "mi").agg(F.avg("v").alias("value"), F.sum(F.round(F.col("v") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))


def region_months(spark: SparkSession, sf_dir: str, median: bool = False) -> DataFrame:
    """region (market segment), ym, mi, volume, mean_price, and where asked for median_price."""
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = orders.select(F.col("o_custkey"), F.date_format(day, "yyyy-MM").alias("ym"), month_index(day).alias("mi"), F.col("o_totalprice").cast("double").alias("v"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("region"))
    each = rows.join(who, "o_custkey")
    per = each.groupBy("region", "ym", "mi").agg(F.count("*").alias("volume"), F.avg("v").alias("mean_price"))
    if not median:
        return per
    return per.join(quantiles(each, ["region", "ym"], "v", [0.5]).select("region", "ym", F.col("q")[0].alias("median_price")), ["region", "ym"])


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings seen over a lifetime: user_id, kind, price, first_seen, last_seen (seconds)."""
    x = table(spark, sf_dir, "events")
    first = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    return x.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("event_type").alias("kind"),
        F.col("value").cast("double").alias("price"),
        first.alias("first_seen"),
        (first + F.floor(F.col("value").cast("double") * 60)).cast("long").alias("last_seen"),
    )
