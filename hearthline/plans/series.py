"""Monthly series and regional statistics: transforms, z, episodes, cycles, ranks.

A series has one row for each month of the calendar, so windows over a series hold hundreds of
rows however large the tables are that it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.functions.scalars import pct_change
from hearthline.sources.tables import monthly_series, region_months


def by(key: str = "series"):
    return Window.partitionBy(key).orderBy("mi")


def whole(key: str = "series"):
    return Window.partitionBy(key)


SERIES = """s AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS ym, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)"""
REGIONS = """r AS (SELECT c_mktsegment AS region, strftime(o_orderdate, '%Y-%m') AS ym, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi, count(*) AS volume, avg(o_totalprice) AS mean_price, quantile_cont(o_totalprice, 0.5) AS median_price
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


def full(n: int, out: Column, key: str = "series") -> Column:
    """out, where n rows are there."""
    return F.when(F.count("*").over(by(key).rowsBetween(1 - n, 0)) == n, out)


def roll_sum(n: int) -> Column:
    return full(n, F.sum("value").over(by().rowsBetween(1 - n, 0)))


def roll_mean(n: int) -> Column:
    return full(n, F.avg("value").over(by().rowsBetween(1 - n, 0)))


def series_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing sums and means, and changes over twelve rows (positional) and twelve months
    (calendar: null where the row twelve back is of another month)."""
    v, then = F.col("value"), F.lag("value", 12).over(by())
    return monthly_series(spark, sf_dir).select(
        "series", "ym",
        F.round(roll_sum(12), 4).alias("roll12"),
        F.round(roll_mean(3), 4).alias("mean3"),
        F.round(pct_change(v, then), 6).alias("yoy"),
        F.round(v - then, 4).alias("diff12"),
        F.round(F.when((v > 0) & (then > 0), F.log(v / then) * 100), 6).alias("log12"),
        F.round(pct_change(F.lead("value", 12).over(by()), v), 6).alias("fwd12"),
        F.round(F.when(F.col("mi") - F.lag("mi", 12).over(by()) == 12, pct_change(v, then)), 6).alias("yoy_calendar"),
    )


SERIES_TRANSFORMS = f"""WITH {SERIES}, w AS (SELECT *, lag(value, 12) OVER o AS then_, lead(value, 12) OVER o AS ahead, lag(mi, 12) OVER o AS mi12,
  sum(value) OVER (o ROWS 11 PRECEDING) AS s12, count(*) OVER (o ROWS 11 PRECEDING) AS n12, avg(value) OVER (o ROWS 2 PRECEDING) AS m3, count(*) OVER (o ROWS 2 PRECEDING) AS n3 FROM s WINDOW o AS (PARTITION BY series ORDER BY mi))
SELECT series, ym, round(CASE WHEN n12 = 12 THEN s12 END, 4) AS roll12, round(CASE WHEN n3 = 3 THEN m3 END, 4) AS mean3, round(CASE WHEN then_ <> 0 THEN (value / then_ - 1) * 100 END, 6) AS yoy, round(value - then_, 4) AS diff12,
  round(CASE WHEN value > 0 AND then_ > 0 THEN ln(value / then_) * 100 END, 6) AS log12, round(CASE WHEN value <> 0 THEN (ahead / value - 1) * 100 END, 6) AS fwd12, round(CASE WHEN mi - mi12 = 12 AND then_ <> 0 THEN (value / then_ - 1) * 100 END, 6) AS yoy_calendar FROM w"""


def with_z(rows: DataFrame) -> DataFrame:
    """z against the whole series by its population deviation; 0 where that is 0."""
    sd = F.stddev_pop("value").over(whole())
    return rows.withColumn("z", F.when(sd == 0, 0.0).otherwise((F.col("value") - F.avg("value").over(whole())) / sd))


def series_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_z(monthly_series(spark, sf_dir)).select("series", "ym", F.round("z", 6).alias("z"))


SERIES_Z = f"WITH {SERIES} SELECT series, ym, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM s WINDOW w AS (PARTITION BY series)"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier months whose z is within half a deviation of the series' last, joined to one
    episode while they are at most twelve months apart, and what came after."""
    last_z = F.last("z").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last_mi = F.max("mi").over(whole())
    rows = with_z(monthly_series(spark, sf_dir)).withColumn("fwd12", pct_change(F.lead("value", 12).over(by()), F.col("value")))
    near = rows.withColumn("now", last_z).withColumn("end", last_mi).where("abs(z - now) <= 0.5 and mi <= end - 24")
    opened = F.when(F.coalesce(F.col("mi") - F.lag("mi").over(by()), F.lit(99)) > 12, 1).otherwise(0)
    part = near.withColumn("opened", opened).withColumn("episode", F.sum("opened").over(by()))
    return part.groupBy("series", "episode").agg(F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym"), F.count("*").alias("months"), F.round(F.median("z"), 6).alias("z"), F.round(F.median("fwd12"), 6).alias("fwd12"))


EPISODES = f"""WITH {SERIES}, z AS (SELECT *, CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z, (lead(value, 12) OVER (PARTITION BY series ORDER BY mi) / value - 1) * 100 AS fwd12, max(mi) OVER w AS mi_end FROM s WINDOW w AS (PARTITION BY series)),
n AS (SELECT *, last_value(z) OVER (PARTITION BY series ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z_now FROM z),
k AS (SELECT *, CASE WHEN coalesce(mi - lag(mi) OVER (PARTITION BY series ORDER BY mi), 99) > 12 THEN 1 ELSE 0 END AS opened FROM n WHERE abs(z - z_now) <= 0.5 AND mi <= mi_end - 24),
e AS (SELECT *, CAST(sum(opened) OVER (PARTITION BY series ORDER BY mi) AS BIGINT) AS episode FROM k)
SELECT series, episode, min(ym) AS first_ym, max(ym) AS last_ym, count(*) AS months, round(quantile_cont(z, 0.5), 6) AS z, round(quantile_cont(fwd12, 0.5), 6) AS fwd12 FROM e GROUP BY 1, 2"""


def trend_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation in percent from a log trend that is fitted to the months so far, from the 24th."""
    so_far = by().rowsBetween(Window.unboundedPreceding, 0)
    rows = monthly_series(spark, sf_dir).withColumn("y", F.log("value"))
    at = F.regr_intercept("y", "mi").over(so_far) + F.regr_slope("y", "mi").over(so_far) * F.col("mi")
    rows = rows.withColumn("n", F.count("*").over(so_far)).withColumn("dev", (F.exp(F.col("y") - at) - 1) * 100)
    return rows.where("n >= 24").select("series", "ym", F.round("dev", 4).alias("dev"))


TREND_DEVIATION = f"""WITH {SERIES}, t AS (SELECT series, ym, mi, ln(value) AS y, count(*) OVER o AS n, regr_intercept(ln(value), mi) OVER o AS a, regr_slope(ln(value), mi) OVER o AS b FROM s WINDOW o AS (PARTITION BY series ORDER BY mi ROWS UNBOUNDED PRECEDING))
SELECT series, ym, round((exp(y - a - b * mi) - 1) * 100, 4) AS dev FROM t WHERE n >= 24"""


def expanding_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile of each month among the months so far, ties at half weight, from the 24th."""
    rows = monthly_series(spark, sf_dir).select("series", "ym", "mi", F.round("value", 2).alias("value"))
    past = F.collect_list("value").over(by().rowsBetween(Window.unboundedPreceding, 0))  # months, some hundreds
    rows = rows.withColumn("past", past).where(F.size("past") >= 24)
    below = F.size(F.filter("past", lambda x: x < F.col("value")))
    equal = F.size(F.filter("past", lambda x: x == F.col("value")))
    return rows.select("series", "ym", F.round((below + 0.5 * equal) / F.size("past") * 100, 6).alias("pct"))


EXPANDING_PERCENTILE = f"""WITH {SERIES}, v AS (SELECT series, ym, mi, round(value, 2) AS value FROM s),
j AS (SELECT a.series, a.ym, count(*) AS n, count(*) FILTER (WHERE b.value < a.value) AS below, count(*) FILTER (WHERE b.value = a.value) AS equal FROM v a JOIN v b ON a.series = b.series AND b.mi <= a.mi GROUP BY 1, 2)
SELECT series, ym, round((below + 0.5 * equal) / n * 100, 6) AS pct FROM j WHERE n >= 24"""


def lead_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a series' trailing sum with its trailing sum 27 calendar months later."""
    roll = monthly_series(spark, sf_dir).withColumn("roll", roll_sum(12)).where("roll is not null").select("series", "mi", "roll")
    later = roll.select("series", (F.col("mi") - 27).alias("mi"), F.col("roll").alias("later"))
    return roll.join(later, ["series", "mi"]).groupBy("series").agg(F.count("*").alias("n"), F.round(F.corr("roll", "later"), 6).alias("r"))


LEAD_CORRELATION = f"""WITH {SERIES}, w AS (SELECT series, mi, sum(value) OVER (PARTITION BY series ORDER BY mi ROWS 11 PRECEDING) AS roll, count(*) OVER (PARTITION BY series ORDER BY mi ROWS 11 PRECEDING) AS n FROM s),
k AS (SELECT * FROM w WHERE n = 12) SELECT a.series, count(*) AS n, round(corr(a.roll, b.roll), 6) AS r FROM k a JOIN k b ON a.series = b.series AND b.mi = a.mi + 27 GROUP BY 1"""


def year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the years that have all twelve months; a month is its mean to four places, in whole
    numbers, so sums don't depend on their order."""
    months = monthly_series(spark, sf_dir).select("series", "ym", "cents", "n")
    rows = months.withColumn("units", F.expr("(cents * 200 + n) div (2 * n)")).groupBy("series", F.substring("ym", 1, 4).alias("year")).agg(F.sum("units").alias("total"), F.count("*").alias("months"))
    return rows.where("months = 12").select("series", "year", (F.col("total") / 10000).alias("total"))


YEAR_TOTALS = """WITH m AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y') AS year, month(o_orderdate) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT series, year, CAST(sum((cents * 200 + n) // (2 * n)) AS BIGINT) / 10000 AS total FROM m GROUP BY 1, 2 HAVING count(*) = 12"""


def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and by how much, a series is higher twelve rows later."""
    rows = monthly_series(spark, sf_dir).select("series", pct_change(F.lead("value", 12).over(by()), F.col("value")).alias("fwd")).where("fwd is not null")
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.round(F.median("fwd"), 6).alias("median"), F.round(F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)), 6).alias("positive"))


BASE_RATE = f"WITH {SERIES}, f AS (SELECT series, (lead(value, 12) OVER (PARTITION BY series ORDER BY mi) / value - 1) * 100 AS fwd FROM s) SELECT series, count(*) AS n, round(quantile_cont(fwd, 0.5), 6) AS median, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM f WHERE fwd IS NOT NULL GROUP BY 1"


def from_last():
    return Window.partitionBy("region").orderBy(F.desc("mi"))



def cycle_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's peak (first maximum), trough at or after it (first minimum), and where it
    stands against both, with its changes over 3 and 12 rows."""
    rows = region_months(spark, sf_dir).select("region", "ym", "mi", F.round("mean_price", 4).alias("v"))
    rows = rows.withColumn("d3", pct_change(F.col("v"), F.lag("v", 3).over(by("region")))).withColumn("d12", pct_change(F.col("v"), F.lag("v", 12).over(by("region"))))
    top = rows.groupBy("region").agg(F.max(F.struct("v", -F.col("mi"))).alias("p")).select("region", F.col("p.v").alias("peak"), (-F.col("p.col2")).alias("peak_mi"))
    after = rows.join(top, "region").where("mi >= peak_mi")
    low = after.groupBy("region").agg(F.min(F.struct("v", "mi")).alias("t")).select("region", F.col("t.v").alias("trough"), F.col("t.mi").alias("trough_mi"))
    last = rows.groupBy("region").agg(F.max_by(F.struct("v", "d3", "d12"), "mi").alias("l"))
    return last.join(top, "region").join(low, "region").select(
        "region", F.col("peak_mi").cast("long").alias("peak_mi"), F.col("trough_mi").cast("long").alias("trough_mi"),
        F.round(pct_change(F.col("l.v"), F.col("peak")), 6).alias("from_peak"), F.round(pct_change(F.col("l.v"), F.col("trough")), 6).alias("from_trough"),
        F.round("l.d3", 6).alias("d3"), F.round("l.d12", 6).alias("d12"),
    )


CYCLE_PHASE = f"""WITH {REGIONS}, v AS (SELECT region, ym, mi, round(mean_price, 4) AS v FROM r),
d AS (SELECT *, (v / lag(v, 3) OVER o - 1) * 100 AS d3, (v / lag(v, 12) OVER o - 1) * 100 AS d12, row_number() OVER (PARTITION BY region ORDER BY v DESC, mi) AS hi, row_number() OVER (PARTITION BY region ORDER BY mi DESC) AS back FROM v WINDOW o AS (PARTITION BY region ORDER BY mi)),
p AS (SELECT region, v AS peak, mi AS peak_mi FROM d WHERE hi = 1),
t AS (SELECT region, v AS trough, mi AS trough_mi FROM (SELECT d.region, v, mi, row_number() OVER (PARTITION BY d.region ORDER BY v, mi) AS lo FROM d JOIN p ON p.region = d.region AND mi >= peak_mi) WHERE lo = 1)
SELECT d.region, peak_mi, trough_mi, round((v / peak - 1) * 100, 6) AS from_peak, round((v / trough - 1) * 100, 6) AS from_trough, round(d3, 6) AS d3, round(d12, 6) AS d12 FROM d JOIN p USING (region) JOIN t USING (region) WHERE back = 1"""


def volume_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-month price change against the volume of the last 12 months over the yearly mean
    of the 60 before."""
    rows = region_months(spark, sf_dir)
    change = pct_change(F.col("mean_price"), F.lag("mean_price", 12).over(by("region")))
    rows = rows.withColumn("change", change).withColumn("back", F.row_number().over(from_last()))
    out = rows.groupBy("region").agg(
        F.max(F.when(F.col("back") == 1, F.col("change"))).alias("change"),
        F.sum(F.when(F.col("back") <= 12, F.col("volume"))).alias("recent"),
        F.sum(F.when(F.col("back").between(13, 72), F.col("volume"))).alias("past"),
    )
    return out.select("region", F.round("change", 6).alias("change"), "recent", F.round(F.col("recent") / (F.col("past") / 5), 6).alias("ratio"))


VOLUME_SUPPORT = f"""WITH {REGIONS}, b AS (SELECT region, volume, (mean_price / lag(mean_price, 12) OVER (PARTITION BY region ORDER BY mi) - 1) * 100 AS change, row_number() OVER (PARTITION BY region ORDER BY mi DESC) AS back FROM r),
o AS (SELECT region, max(change) FILTER (WHERE back = 1) AS change, CAST(sum(volume) FILTER (WHERE back <= 12) AS BIGINT) AS recent, sum(volume) FILTER (WHERE back BETWEEN 13 AND 72) AS past FROM b GROUP BY 1)
SELECT region, round(change, 6) AS change, recent, round(recent / (past / 5), 6) AS ratio FROM o"""


def sample_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean volume of the last twelve months, the regions' upper median of it, and whether a
    region has less than half of that."""
    rows = region_months(spark, sf_dir).withColumn("back", F.row_number().over(from_last())).where("back <= 12")
    depth = rows.groupBy("region").agg(F.avg("volume").alias("depth"))
    mid = depth.agg(F.sort_array(F.collect_list("depth")).alias("d")).select(F.element_at("d", (F.size("d") / 2).cast("int") + 1).alias("mid"))  # by regions, tens of rows
    return depth.join(F.broadcast(mid)).select("region", F.round("depth", 6).alias("depth"), F.round("mid", 6).alias("mid"), (F.col("depth") < F.col("mid") / 2).alias("thin"))


SAMPLE_DEPTH = f"""WITH {REGIONS}, b AS (SELECT region, volume, row_number() OVER (PARTITION BY region ORDER BY mi DESC) AS back FROM r), d AS (SELECT region, avg(volume) AS depth FROM b WHERE back <= 12 GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY depth) AS pos, count(*) OVER () AS n FROM d), m AS (SELECT depth AS mid FROM k WHERE pos = n // 2 + 1)
SELECT region, round(depth, 6) AS depth, round(mid, 6) AS mid, depth < mid / 2 AS thin FROM d, m"""


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's correlation of volume and price over the months of each region, ties at their
    mean rank."""
    rows = region_months(spark, sf_dir, True).select("region", F.col("volume").cast("double").alias("a"), F.round("median_price", 2).alias("b"))
    for x in ("a", "b"):
        rank = F.rank().over(Window.partitionBy("region").orderBy(x))
        rows = rows.withColumn(f"r{x}", rank + (F.count("*").over(Window.partitionBy("region", x)) - 1) / 2)
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


RANK_CORRELATION = f"""WITH {REGIONS}, x AS (SELECT region, volume AS a, round(median_price, 2) AS b FROM r),
k AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY a) + (count(*) OVER (PARTITION BY region, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY region ORDER BY b) + (count(*) OVER (PARTITION BY region, b) - 1) / 2 AS rb FROM x)
SELECT region, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k GROUP BY 1"""


def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over median price in each region's latest month."""
    last = region_months(spark, sf_dir, True).groupBy("region").agg(F.max_by(F.struct("ym", "mean_price", "median_price"), "mi").alias("l"))
    return last.select("region", "l.ym", F.round(F.col("l.mean_price") / F.col("l.median_price"), 6).alias("spread"))


PRICE_SPREAD = f"WITH {REGIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mi DESC) AS back FROM r) SELECT region, ym, round(mean_price / median_price, 6) AS spread FROM b WHERE back = 1"


def chained_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels cast back from each region's last level by the ratio of its trailing index, and
    their mean over regions by month."""
    rows = region_months(spark, sf_dir, True)
    index = full(3, F.avg("mean_price").over(by("region").rowsBetween(-2, 0)), "region")
    rows = rows.withColumn("ix", index).where("ix is not null")
    frame = by("region").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.last("median_price").over(frame) * F.col("ix") / F.last("ix").over(frame)
    return rows.withColumn("level", level).groupBy("ym").agg(F.count("*").alias("regions"), F.round(F.avg("level"), 4).alias("level"))


CHAINED_LEVEL = f"""WITH {REGIONS}, i AS (SELECT *, avg(mean_price) OVER (o ROWS 2 PRECEDING) AS ix, count(*) OVER (o ROWS 2 PRECEDING) AS n FROM r WINDOW o AS (PARTITION BY region ORDER BY mi)),
l AS (SELECT ym, last_value(median_price) OVER w * ix / last_value(ix) OVER w AS level FROM i WHERE n = 3 WINDOW w AS (PARTITION BY region ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT ym, count(*) AS regions, round(avg(level), 4) AS level FROM l GROUP BY 1"""

QUERIES = {f.__name__: f for f in (series_transforms, series_z, episodes, trend_deviation, expanding_percentile, lead_correlation, year_totals, base_rate, cycle_phase, volume_support, sample_depth, rank_correlation, price_spread, chained_level)}
SQL = {
    "series_transforms": SERIES_TRANSFORMS, "series_z": SERIES_Z, "episodes": EPISODES, "trend_deviation": TREND_DEVIATION, "expanding_percentile": EXPANDING_PERCENTILE, "lead_correlation": LEAD_CORRELATION, "year_totals": YEAR_TOTALS,
    "base_rate": BASE_RATE, "cycle_phase": CYCLE_PHASE, "volume_support": VOLUME_SUPPORT, "sample_depth": SAMPLE_DEPTH, "rank_correlation": RANK_CORRELATION, "price_spread": PRICE_SPREAD, "chained_level": CHAINED_LEVEL,
}
