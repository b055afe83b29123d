"""All queries over the reference tables, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.plans import bars, effects, filings, formulas, hedonic, loads, lookups, market, matching, outlook, series, signals, supply

FLAGSHIP = "market_index"


def monthly_trade_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("ym")).agg(F.count("*").alias("n_trades"), F.round(F.avg("l_extendedprice"), 2).alias("mean_amount"))


MONTHLY_TRADE_VOLUME = "SELECT strftime(l_shipdate, '%Y-%m') AS ym, count(*) AS n_trades, round(avg(l_extendedprice), 2) AS mean_amount FROM lineitem GROUP BY 1"


def queries() -> dict:
    return {"monthly_trade_volume": monthly_trade_volume, **market.QUERIES, **series.QUERIES, **bars.QUERIES, **signals.QUERIES, **lookups.QUERIES, **loads.QUERIES, **formulas.QUERIES, **filings.QUERIES, **outlook.QUERIES, **supply.QUERIES, **hedonic.QUERIES, **effects.QUERIES, **matching.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"monthly_trade_volume": MONTHLY_TRADE_VOLUME, **market.SQL, **series.SQL, **bars.SQL, **signals.SQL, **lookups.SQL, **loads.SQL, **formulas.SQL, **filings.SQL, **outlook.SQL, **supply.SQL, **hedonic.SQL, **effects.SQL, **matching.SQL}
