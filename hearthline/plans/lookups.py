"""Joins as of a date, within stretches, of shifted months, and with what may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.functions.scalars import month_name, sign_of
from hearthline.operators.asof import as_of, within
from hearthline.sources.tables import daily_bars, monthly_series, table, trades

LAG_QUARTERS = 3  # months until a quarter's figure is known
REACH, FINEST = 2500, 9  # metres to a station; how often a cell as wide as that is halved
#: Terms of office as (name, first day, last day); shared days belong to the later.
TERMS = [("first", "1992-01-01", "1995-12-31"), ("second", "1995-12-31", "1997-06-30"), ("third", "1998-01-01", "1999-12-31"), ("fourth", "2000-01-01", None)]

MONTHLY = "m AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
_NAME = "lpad(CAST({0} // 12 AS VARCHAR), 4, '0') || lpad(CAST({0} % 12 + 1 AS VARCHAR), 2, '0')"


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), (F.year(day) * 12 + F.quarter(day) * 3 - 1).cast("long").alias("end"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return rows.groupBy("series", "end").agg(F.sum("cents").alias("cents"))


QUARTERS = "q AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) * 12 + quarter(o_orderdate) * 3 - 1 AS BIGINT) AS qe, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2)"


def known_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter's sum for each month from when it is known until the next one is."""
    q = _quarters(spark, sf_dir)
    until = F.coalesce(F.lead("end").over(Window.partitionBy("series").orderBy("end")) - 1, F.col("end")) + LAG_QUARTERS
    rows = q.withColumn("until", until).select("series", "end", "cents", F.explode(F.sequence(F.col("end") + LAG_QUARTERS, "until")).alias("mi"))
    return rows.select("series", month_name(F.col("mi")).alias("ym"), month_name(F.col("end")).alias("quarter"), "cents")


KNOWN_QUARTERS = f"""WITH {QUARTERS}, s AS (SELECT *, coalesce(lead(qe) OVER (PARTITION BY series ORDER BY qe) - 1, qe) + {LAG_QUARTERS} AS until FROM q),
x AS (SELECT series, qe, cents, unnest(range(qe + {LAG_QUARTERS}, until + 1)) AS mi FROM s)
SELECT series, {_NAME.format('mi')} AS ym, {_NAME.format('qe')} AS quarter, cents FROM x"""


def fresh_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every trade the last monthly figure of its own kind of month that is at most three months
    old, one month after its month; null where none is."""
    t = trades(spark, sf_dir).select(F.when(F.col("deal_type") == "direct", "1-URGENT").otherwise("5-LOW").alias("series"), "mi").groupBy("series", "mi").agg(F.count("*").alias("n"))
    m = monthly_series(spark, sf_dir).where("mi % 5 < 2").select("series", (F.col("mi") + 1).alias("known"), F.col("mi").alias("of_mi"), F.round("value", 4).alias("value"))
    return as_of(t, m, ["series"], "mi", "known", 3).select("series", "mi", "n", month_name(F.col("of_mi")).alias("of_month"), "value")


FRESH_FIGURES = f"""WITH {MONTHLY}, t AS (SELECT CASE WHEN l_returnflag = 'R' THEN '1-URGENT' ELSE '5-LOW' END AS series, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS mi, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT series, mi + 1 AS known, mi AS of_mi, value FROM m WHERE mi % 5 < 2),
j AS (SELECT t.series, t.mi, t.n, k.known, k.of_mi, k.value FROM t ASOF LEFT JOIN k ON t.series = k.series AND t.mi >= k.known)
SELECT series, mi, n, CASE WHEN known >= mi - 3 THEN {_NAME.format('of_mi')} END AS of_month, CASE WHEN known >= mi - 3 THEN round(value, 4) END AS value FROM j"""


def carried_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with holes, and its last month carried on for two months at most."""
    m = monthly_series(spark, sf_dir).where("mi % 7 <> 3").select("series", "mi", F.round("value", 4).alias("value"))
    last = m.groupBy("series").agg(F.max_by("value", "mi").alias("value"), F.max("mi").alias("last"))
    more = last.select("series", F.explode(F.sequence(F.col("last") + 1, F.col("last") + 2)).alias("mi"), "value")
    return m.unionByName(more)


CARRIED_FIGURES = f"""WITH {MONTHLY}, k AS (SELECT series, mi, round(value, 4) AS value FROM m WHERE mi % 7 <> 3),
l AS (SELECT series, arg_max(value, mi) AS value, max(mi) AS last_mi FROM k GROUP BY 1)
SELECT series, mi, value FROM k UNION ALL SELECT series, last_mi + o, value FROM l, (SELECT unnest([1, 2]) AS o)"""


def release_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, filed 60 days after its day, the last shipment of its customer after its day
    and not after it was filed: the day on which the figure was known; else the day it was filed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("low"))
    orders = orders.withColumn("high", F.col("low") + 60)
    ships = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("day"))
    ships = ships.join(orders.select("order_id", "customer"), "order_id").select("customer", "day").distinct()
    last = within(orders, ships, ["customer"], "low", "high", "day", 60).groupBy("order_id").agg(F.max("day").alias("day"))
    return orders.join(last, "order_id", "left").select("order_id", F.coalesce("day", "high").alias("known"), F.col("day").isNotNull().alias("released"))


RELEASE_DAYS = """WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS c, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS low FROM orders),
s AS (SELECT DISTINCT c, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day FROM lineitem JOIN o ON l_orderkey = order_id),
l AS (SELECT order_id, max(day) AS day FROM o JOIN s ON o.c = s.c AND day > low AND day <= low + 60 GROUP BY 1)
SELECT o.order_id, coalesce(day, low + 60) AS known, day IS NOT NULL AS released FROM o LEFT JOIN l USING (order_id)"""


def year_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change in percent to the first close 355 to 375 days before; only from closes above zero."""
    bars = daily_bars(spark, sf_dir).select("symbol", F.unix_date("day").cast("long").alias("t"), F.round("close", 2).alias("close"))
    stretches = bars.withColumns({"low": F.col("t") - 376, "high": F.col("t") - 355})
    then = bars.where("close > 0").select("symbol", F.col("t").alias("then"), F.col("close").alias("was"))
    found = within(stretches, then, ["symbol"], "low", "high", "then", 21).groupBy("symbol", "t", "close").agg(F.min_by("was", "then").alias("was"))
    return found.select("symbol", "t", (F.round((F.col("close") / F.col("was") - 1) * 100, 1) + F.lit(0.0)).alias("change"))


YEAR_AGO = """WITH b AS (SELECT o_orderpriority AS symbol, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY 1, 2),
j AS (SELECT a.symbol, a.t, a.close, arg_min(c.close, c.t) AS was FROM b a JOIN b c ON a.symbol = c.symbol AND a.t - c.t BETWEEN 355 AND 375 AND c.close > 0 GROUP BY 1, 2, 3)
SELECT symbol, t, round((close / was - 1) * 100, 1) + 0.0 AS change FROM j"""


def terms_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was in office on the first of each month; of terms that share a day the later one."""
    terms = spark.createDataFrame([(k, *x) for k, x in enumerate(TERMS)], "k int, name string, first string, last string")
    months = monthly_series(spark, sf_dir).select(F.concat_ws("-", "ym", F.lit("01")).alias("day")).distinct()
    # a handful of terms
    hit = (F.col("first") <= F.col("day")) & (F.col("last").isNull() | (F.col("day") <= F.col("last")))
    return months.join(F.broadcast(terms), hit, "left").groupBy("day").agg(F.max_by("name", "k").alias("term"))


TERMS_OF_MONTHS = "WITH terms(k, name, first, last) AS (VALUES {}), d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-01') AS day FROM orders) SELECT day, arg_max(name, k) AS term FROM d LEFT JOIN terms ON first <= day AND (last IS NULL OR day <= last) GROUP BY 1".format(
    ", ".join(f"({k}, '{n}', '{a}', {repr(b) if b else 'NULL'})" for k, (n, a, b) in enumerate(TERMS))
)


def moves_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, difference and growth of each series over twelve calendar months, beside the price
    twelve months on; growth needs a base above zero."""
    s = monthly_series(spark, sf_dir).select("series", "mi", "value")
    then = s.select("series", (F.col("mi") + 12).alias("mi"), F.col("value").alias("then"))
    ahead = s.select("series", (F.col("mi") - 12).alias("mi"), F.col("value").alias("ahead"))
    j = s.join(then, ["series", "mi"]).join(ahead, ["series", "mi"])
    growth = F.when(F.col("then") > 0, F.round((F.col("value") / F.col("then") - 1) * 100, 6))
    return j.select("series", "mi", F.round("value", 4).alias("level"), F.round(F.col("value") - F.col("then"), 4).alias("difference"), growth.alias("growth"), F.round(F.log(F.col("ahead") / F.col("value")), 8).alias("target"))


MOVES_AHEAD = f"""WITH {MONTHLY} SELECT a.series, a.mi, round(a.value, 4) AS level, round(a.value - b.value, 4) AS difference, CASE WHEN b.value > 0 THEN round((a.value / b.value - 1) * 100, 6) END AS growth, round(ln(c.value / a.value), 8) AS target
FROM m a JOIN m b ON a.series = b.series AND b.mi = a.mi - 12 JOIN m c ON a.series = c.series AND c.mi = a.mi + 12"""


def common_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in which every series has a value and its change is known, with the values side by side."""
    m = monthly_series(spark, sf_dir).select("mi", "series", F.round("value", 4).alias("value"))
    whole = m.groupBy("mi").agg(F.count("*").alias("have")).crossJoin(F.broadcast(m.agg(F.countDistinct("series").alias("all")))).where("have = `all`").select("mi")  # one row
    return m.join(whole, "mi", "left_semi").groupBy("mi").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("series", "value")))).alias("v")).select("mi", F.col("v")["1-URGENT"].alias("urgent"), F.col("v")["5-LOW"].alias("low"), F.size("v").cast("long").alias("n"))


COMMON_MONTHS = f"""WITH {MONTHLY}, k AS (SELECT mi FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT series) FROM m))
SELECT mi, max(round(value, 4)) FILTER (WHERE series = '1-URGENT') AS urgent, max(round(value, 4)) FILTER (WHERE series = '5-LOW') AS low, count(*) AS n FROM m JOIN k USING (mi) GROUP BY 1"""


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its nation, region and figures of its orders where it has any; the first
    that is known of two lookups names its place."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"), F.col("n_regionkey").alias("region"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("region_name"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").cast("string").alias("latest"))
    # nations and regions are tables of a few rows by nature
    j = c.join(F.broadcast(n), "nation", "left").join(F.broadcast(r), "region", "left").join(o, "customer", "left")
    return j.select("customer", F.coalesce("region_name", "nation_name", "segment").alias("place"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("latest", F.lit("")).alias("latest"))


CUSTOMER_PLACES = """WITH o AS (SELECT o_custkey, count(*) AS n, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS latest FROM orders GROUP BY 1)
SELECT c_custkey AS customer, coalesce(r_name, n_name, c_mktsegment) AS place, coalesce(n, 0) AS n, coalesce(latest, '') AS latest FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey"""


def untraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By segment: customers, those without an order, those without a recent one, and the share."""
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    without = c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").withColumn("none", F.lit(1))
    old = c.join(recent, "c_custkey", "left_anti").withColumn("old", F.lit(1))
    j = c.join(without.select("c_custkey", "none"), "c_custkey", "left").join(old.select("c_custkey", "old"), "c_custkey", "left")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count("none").alias("without"), F.count("old").alias("not_recent"), F.round(F.count("none") / F.count("*"), 6).alias("share"))


UNTRADED = """SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')) AS not_recent,
  round(count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) / count(*), 6) AS share FROM customer GROUP BY 1"""


def long_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment with at least 12 orders, and the trend's sign from an interval of their
    mean against the overall mean of the segment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    per = o.groupBy("c_custkey").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).where("n >= 12")
    c = per.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    half = 1.96 * F.col("sd") / F.sqrt("n")
    c = c.withColumn("gap", F.col("mean") - F.avg("mean").over(Window.partitionBy("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("customer"), "n", sign_of(F.round(F.col("gap") - half, 4), F.round(F.col("gap") + half, 4)).alias("sign"))


LONG_HISTORIES = """WITH p AS (SELECT o_custkey, count(*) AS n, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS mean, stddev_samp(CAST(round(o_totalprice * 100) AS BIGINT)) AS sd FROM orders GROUP BY 1 HAVING count(*) >= 12),
g AS (SELECT c_custkey, n, mean - avg(mean) OVER (PARTITION BY c_mktsegment) AS gap, 1.96 * sd / sqrt(n) AS half FROM p JOIN customer ON c_custkey = o_custkey)
SELECT c_custkey AS customer, n, CASE WHEN round(gap - half, 4) > 0 THEN 'pos' WHEN round(gap + half, 4) < 0 THEN 'neg' ELSE 'none' END AS sign FROM g"""


def nearest(places: DataFrame, stations: DataFrame, reach: int, most: int) -> DataFrame:
    """id, rank, station, metres: the nearest stations of each place within reach, `most` of them, equal metres by
    station. places: id, x, y; stations: station, sx, sy; metres.

    Equal places are looked up once, and of stations in one place only the first `most` can be shown. A place looks
    in the smallest square cell around it that holds `most` stations: they lie within the cell's diagonal, so no nearer
    one lies beyond two cells of that size. So a place meets about as many stations however dense they lie.
    Where not even a cell as wide as the reach holds enough, that cell and those beside it are looked at."""
    c = F.col
    spots = stations.groupBy("sx", "sy").agg(F.slice(F.array_sort(F.collect_set("station")), 1, most).alias("ids"))
    cell = lambda v, level: F.floor(v * F.pow(F.lit(2.0), level) / reach)  # noqa: E731  exact: halves of the reach
    levels = F.explode(F.sequence(F.lit(0), F.lit(FINEST))).alias("level")
    celled = lambda df, x, y: df.select("*", levels).withColumns({"cx": cell(c(x), c("level")), "cy": cell(c(y), c("level"))})
    held = celled(spots, "sx", "sy")
    full = held.groupBy("level", "cx", "cy").agg(F.sum(F.size("ids")).alias("n")).where(c("n") >= most)
    own = places.select("x", "y").distinct()
    finest = celled(own, "x", "y").join(full, ["level", "cx", "cy"]).groupBy("x", "y").agg(F.max("level").alias("level"))
    around = own.join(finest, ["x", "y"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    wide = F.when(c("level") == 0, 1).otherwise(2)
    step = lambda name: F.explode(F.sequence(-wide, wide)).alias(name)
    around = around.select("*", step("dx")).select("*", step("dy")).select("x", "y", "level", (cell(c("x"), c("level")) + c("dx")).alias("cx"), (cell(c("y"), c("level")) + c("dy")).alias("cy"))
    pairs = around.join(held, ["level", "cx", "cy"]).withColumn("metres", F.round(F.hypot(c("x") - c("sx"), c("y") - c("sy")), 3)).where(c("metres") <= reach)
    near = pairs.select("x", "y", "metres", F.explode("ids").alias("station"))
    order = Window.partitionBy("x", "y").orderBy("metres", "station")
    ranks = near.withColumn("rank", F.row_number().over(order).cast("long")).where(c("rank") <= most)
    return places.join(ranks, ["x", "y"]).select("id", "rank", "station", "metres")


def near_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each complex's nearest five stations within 2.5 km, in metres on a grid of 88,800 and 111,000
    metres a degree."""
    place = lambda key, k: F.pmod(key * k, F.lit(9973)) * 4.0  # noqa: E731  metres; stands for coordinates
    complex_id, station = F.col("p_partkey").cast("long"), F.col("s_suppkey").cast("long")
    c = table(spark, sf_dir, "part").select(complex_id.alias("id"), place(complex_id, 7919).alias("x"), place(complex_id, 4409).alias("y"))
    s = table(spark, sf_dir, "supplier").select(station.alias("station"), place(station, 6701).alias("sx"), place(station, 3557).alias("sy"))
    return nearest(c, s, REACH, 5).withColumnRenamed("id", "complex_id")


NEAR_STATIONS = """WITH c AS (SELECT p_partkey AS complex_id, (p_partkey * 7919 % 9973) * 4.0 AS x, (p_partkey * 4409 % 9973) * 4.0 AS y FROM part),
s AS (SELECT s_suppkey AS station, (s_suppkey * 6701 % 9973) * 4.0 AS sx, (s_suppkey * 3557 % 9973) * 4.0 AS sy FROM supplier),
j AS (SELECT complex_id, station, round(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), 3) AS metres FROM c, s),
r AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY metres, station) AS rank FROM j WHERE metres <= 2500) SELECT complex_id, rank, station, CAST(metres AS DOUBLE) AS metres FROM r WHERE rank <= 5"""

QUERIES = {f.__name__: f for f in (known_quarters, fresh_figures, carried_figures, release_days, year_ago, terms_of_months, moves_ahead, common_months, customer_places, untraded, long_histories, near_stations)}
SQL = {
    "known_quarters": KNOWN_QUARTERS, "fresh_figures": FRESH_FIGURES, "carried_figures": CARRIED_FIGURES, "release_days": RELEASE_DAYS, "year_ago": YEAR_AGO, "terms_of_months": TERMS_OF_MONTHS,
    "moves_ahead": MOVES_AHEAD, "common_months": COMMON_MONTHS, "customer_places": CUSTOMER_PLACES, "untraded": UNTRADED, "long_histories": LONG_HISTORIES, "near_stations": NEAR_STATIONS,
}
