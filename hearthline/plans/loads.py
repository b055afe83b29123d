"""Loads: merges with what was fetched anew, snapshots, disappearances, gates, key sets.

Orders stand for what is fetched: those of one half were loaded, those of another are fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.operators.merge import common, filled, gone, put, seen, upsert
from hearthline.sources.tables import daily_bars, table

MOST_LOG = 0.25  # of a day's change
SPLIT = "1999-01-01"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("series"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("ym")
    )


ORDERS = "o AS (SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderpriority AS series, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%Y-%m') AS ym FROM orders)"


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the orders as loaded, two thirds as fetched later with prices twice as high; an older
    version never replaces a newer one."""
    o = _orders(spark, sf_dir).select("order_id", "price", "day")
    old = o.where("order_id % 3 <> 0").withColumn("version", F.expr("if(order_id % 6 = 1, 3, 1)"))
    new = o.where("order_id % 3 <> 1 or order_id % 6 = 1").withColumns({"price": F.col("price") * 2, "version": F.lit(2)})
    return upsert(old, new, ["order_id"], "version")


MERGED_ORDERS = f"""WITH {ORDERS} SELECT order_id, CASE WHEN order_id % 6 <> 1 AND order_id % 3 <> 1 THEN price * 2 ELSE price END AS price, day,
  CASE WHEN order_id % 6 = 1 THEN 3 WHEN order_id % 3 <> 1 THEN 2 ELSE 1 END AS version FROM o"""


def vanished_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen before SPLIT and not in the snapshot after it, of segments scanned both times."""
    o, c = _orders(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("part"))
    j = o.join(c, "customer")
    before = j.where(F.col("day") < SPLIT).groupBy("customer", "part").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    now = j.where((F.col("day") >= SPLIT) & (F.col("part") != "BUILDING"))
    units = seen(before, now, ["customer", "part"], SPLIT)
    return gone(units, before, now, "part", SPLIT).select("customer", "part", "first_seen", "last_seen")


VANISHED_CUSTOMERS = f"""WITH {ORDERS}, j AS (SELECT o.customer, c_mktsegment AS part, day FROM o JOIN customer ON c_custkey = o.customer)
SELECT customer, part, min(day) AS first_seen, max(day) AS last_seen FROM j WHERE day < '{SPLIT}' AND part IN (SELECT part FROM j WHERE day >= '{SPLIT}' AND part <> 'BUILDING')
  AND customer NOT IN (SELECT customer FROM j WHERE day >= '{SPLIT}' AND part <> 'BUILDING') GROUP BY 1, 2"""


def months_to_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, month) that are due: not loaded yet, or among the last three of all, which are always
    fetched again."""
    o = _orders(spark, sf_dir).select("series", "ym", "day")
    due = o.select("series", "ym").distinct()
    loaded = o.where(F.col("day") < SPLIT).select("series", "ym").distinct()
    recent = due.withColumn("back", F.dense_rank().over(Window.partitionBy("series").orderBy(F.desc("ym")))).where("back <= 3").select("series", "ym")
    return due.join(loaded, ["series", "ym"], "left_anti").union(recent).distinct()


MONTHS_TO_LOAD = f"""WITH {ORDERS}, d AS (SELECT DISTINCT series, ym FROM o), r AS (SELECT series, ym, dense_rank() OVER (PARTITION BY series ORDER BY ym DESC) AS back FROM d)
SELECT series, ym FROM r WHERE back <= 3 OR (series, ym) NOT IN (SELECT series, ym FROM o WHERE day < '{SPLIT}')"""


def bar_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a symbol's daily closes from being loaded: closes that aren't above zero, days
    that come twice, jumps above MOST_LOG; and the first day of a jump."""
    order = Window.partitionBy("symbol").orderBy("day")
    bars = daily_bars(spark, sf_dir).withColumn("was", F.lag("close").over(order))
    jump = F.abs(F.log(F.when((F.col("close") > 0) & (F.col("was") > 0), F.col("close") / F.col("was")))) > MOST_LOG
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("close") <= 0).alias("bad"), (F.count("day") - F.countDistinct("day")).alias("twice"), F.count_if(jump).alias("jumps"), F.min(F.when(jump, F.col("day").cast("string"))).alias("first_jump"))


BAR_PROBLEMS = f"""WITH b AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2), w AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS was FROM b),
j AS (SELECT *, coalesce(close > 0 AND was > 0 AND abs(ln(close / was)) > {MOST_LOG}, false) AS jump FROM w)
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE close <= 0) AS bad, count(day) - count(DISTINCT day) AS twice, count(*) FILTER (WHERE jump) AS jumps, CAST(min(day) FILTER (WHERE jump) AS VARCHAR) AS first_jump FROM j GROUP BY 1"""


def source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of one total, year by year: orders, and their lines; a year is trusted where both
    have all twelve months and they are within a tenth of each other in scale."""
    o = _orders(spark, sf_dir).groupBy(F.substring("ym", 1, 4).alias("year")).agg(F.count("*").alias("orders"), F.countDistinct("ym").alias("months"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count("*").alias("lines"), F.countDistinct(F.date_format("l_shipdate", "yyyy-MM")).alias("line_months"))
    j = o.join(lines, "year").withColumn("ratio", F.round(F.col("lines") / F.col("orders") / 4, 6))
    return j.select("year", "orders", "lines", "ratio", ((F.abs(F.col("ratio") - 1) <= 0.1) & (F.col("months") == 12) & (F.col("line_months") == 12)).alias("trusted"))


SOURCE_GAPS = f"""WITH {ORDERS}, a AS (SELECT substr(ym, 1, 4) AS year, count(*) AS orders, count(DISTINCT ym) AS months FROM o GROUP BY 1), l AS (SELECT strftime(l_shipdate, '%Y') AS year, count(*) AS lines, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS lm FROM lineitem GROUP BY 1)
SELECT year, orders, lines, round(lines / orders / 4, 6) AS ratio, abs(round(lines / orders / 4, 6) - 1) <= 0.1 AND months = 12 AND lm = 12 AS trusted FROM a JOIN l USING (year)"""


def filled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their size taken from details where these have one that isn't zero."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("complex_id"), F.col("p_size").cast("long").alias("size"))
    details = p.where("complex_id % 2 = 0").withColumn("size", F.expr("if(complex_id % 4 = 0, 0, size + 100)"))
    return filled(p, details, ["complex_id"], ["size"])


FILLED_SIZES = "SELECT p_partkey AS complex_id, CAST(CASE WHEN p_partkey % 4 = 2 THEN p_size + 100 ELSE p_size END AS BIGINT) AS size FROM part"


def kept_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of suppliers after some were replaced, some added and some deleted by a blank."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("note"))
    new = s.where("unit % 3 <> 0").withColumn("note", F.expr("if(unit % 3 = 1, '  ', concat('new ', note))"))
    return put(s.where("unit % 2 = 0"), new, ["unit"], "note")


KEPT_NOTES = "SELECT s_suppkey AS unit, CASE WHEN s_suppkey % 3 = 2 THEN 'new ' || s_name ELSE s_name END AS note FROM supplier WHERE s_suppkey % 3 = 2 OR (s_suppkey % 3 = 0 AND s_suppkey % 2 = 0)"


def month_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that all series have, and months of the first series that another one lacks."""
    o = _orders(spark, sf_dir).where("order_id % 7 < 2").select("series", "day")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    each = [o.where(F.col("series") == n).select("day") for n in names]
    both = common(each, "day").select("day", F.lit("in all").alias("what"))
    lost = each[0].subtract(each[1]).select("day", F.lit("lost").alias("what"))
    union = each[2].union(each[3]).distinct().intersect(each[4]).select("day", F.lit("in either").alias("what"))
    return both.unionByName(lost).unionByName(union)


MONTH_SETS = f"""WITH {ORDERS}, s AS (SELECT series, day FROM o WHERE order_id % 7 < 2)
SELECT day, 'in all' AS what FROM s GROUP BY 1 HAVING count(DISTINCT series) = 5
UNION ALL SELECT day, 'lost' FROM (SELECT day FROM s WHERE series = '1-URGENT' EXCEPT SELECT day FROM s WHERE series = '2-HIGH')
UNION ALL SELECT day, 'in either' FROM ((SELECT day FROM s WHERE series = '3-MEDIUM' UNION SELECT day FROM s WHERE series = '4-NOT SPECIFIED') INTERSECT SELECT day FROM s WHERE series = '5-LOW')"""

QUERIES = {f.__name__: f for f in (merged_orders, vanished_customers, months_to_load, bar_problems, source_gaps, filled_sizes, kept_notes, month_sets)}
SQL = {
    "merged_orders": MERGED_ORDERS, "vanished_customers": VANISHED_CUSTOMERS, "months_to_load": MONTHS_TO_LOAD, "bar_problems": BAR_PROBLEMS, "source_gaps": SOURCE_GAPS,
    "filled_sizes": FILLED_SIZES, "kept_notes": KEPT_NOTES, "month_sets": MONTH_SETS,
}
