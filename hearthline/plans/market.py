"""Trades: composition-free price index, comparable sales, floor and building effects, groups.

Medians and quantiles are exact. Those of cells such as (complex, area type) are grouped
aggregates; those of months and bands, which grow with the table, come from ranks over ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.functions.scalars import area_band, floor_band
from hearthline.operators.ranks import beside_median, quantiles, ranked
from hearthline.sources.tables import complexes, trades

TRADES = """trades AS (
  SELECT l_partkey AS complex_id, CAST(l_shipdate AS DATE) AS deal_date, strftime(l_shipdate, '%Y-%m') AS deal_ym, l_quantity AS exclusive_area,
    CAST(round_even(l_quantity, 0) AS BIGINT) AS area_key, CAST(l_linenumber AS BIGINT) AS floor, l_suppkey AS dong, l_extendedprice AS deal_amount,
    l_extendedprice / (l_quantity / 3.305785) AS ppp, CASE l_returnflag WHEN 'R' THEN 'direct' WHEN 'A' THEN 'broker' ELSE '' END AS deal_type
  FROM lineitem)"""


def open_market(t: DataFrame) -> DataFrame:
    """Trades without direct deals; an unknown kind stays."""
    return t.where(~F.col("deal_type").eqNullSafe("direct"))


def index_of(t: DataFrame) -> DataFrame:
    """deal_ym, n, idx: the median of prices relative to their cell's median, by month.

    Cells need three trades; a month with fewer than five carries the last value kept, and the
    first month is always kept; the last month is 1."""
    t = open_market(t)
    cells = beside_median(t.select("complex_id", "area_key", "deal_ym", "ppp"), ["complex_id", "area_key"], "ppp", "base", "cell").where("cell >= 3")
    rel = cells.select("deal_ym", (F.col("ppp") / F.col("base")).alias("rel"))
    months = quantiles(rel, ["deal_ym"], "rel", [0.5], hold=True).select("deal_ym", "n", F.col("q")[0].alias("med"))
    in_order = Window.orderBy("deal_ym")  # one row for each month of the calendar
    kept = F.when((F.col("n") >= 5) | (F.row_number().over(in_order) == 1), F.col("med"))
    carried = months.withColumn("kept", kept).withColumn("level", F.last("kept", ignorenulls=True).over(in_order))
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return carried.select("deal_ym", "n", (F.col("level") / F.last("level").over(whole)).alias("idx"))


def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(trades(spark, sf_dir)).withColumn("idx", F.round("idx", 6))


MARKET_INDEX = f"""WITH {TRADES}, t AS (SELECT * FROM trades WHERE deal_type IS DISTINCT FROM 'direct'),
base AS (SELECT complex_id, area_key, quantile_cont(ppp, 0.5) AS base FROM t GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT deal_ym, count(*) AS n, quantile_cont(ppp / base, 0.5) AS med FROM t JOIN base USING (complex_id, area_key) GROUP BY 1),
k AS (SELECT deal_ym, n, CASE WHEN n >= 5 OR row_number() OVER (ORDER BY deal_ym) = 1 THEN med END AS kept FROM m),
c AS (SELECT deal_ym, n, last_value(kept IGNORE NULLS) OVER (ORDER BY deal_ym) AS level FROM k)
SELECT deal_ym, n, round(level / last_value(level) OVER (ORDER BY deal_ym ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS idx FROM c"""


def _described(value: str) -> list:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count("*").alias("n"), F.round(q[1], 1).alias("median"), F.round(F.avg(value), 1).alias("mean"), F.round(q[0], 1).alias("p25"),
        F.round(q[2], 1).alias("p75"), F.round(F.min(value), 1).alias("low"), F.round(F.max(value), 1).alias("high"),
    ]


_DESCRIBED = """count(*) AS n, round(quantile_cont(ppp, 0.5), 1) AS median, round(avg(ppp), 1) AS mean, round(quantile_cont(ppp, 0.25), 1) AS p25,
  round(quantile_cont(ppp, 0.75), 1) AS p75, round(min(ppp), 1) AS low, round(max(ppp), 1) AS high"""


def complex_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each complex and area type: how many trades, and their prices."""
    return open_market(trades(spark, sf_dir)).groupBy("complex_id", "area_key").agg(*_described("ppp"))


COMPLEX_OVERVIEW = f"WITH {TRADES} SELECT complex_id, area_key, {_DESCRIBED} FROM trades WHERE deal_type <> 'direct' GROUP BY 1, 2"


def area_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of complexes (their medians) by area band."""
    t = open_market(trades(spark, sf_dir)).withColumn("band", area_band(F.col("exclusive_area")))
    per = t.groupBy("band", "complex_id").agg(F.median("ppp").alias("ppp"))
    plain = per.groupBy("band").agg(F.round(F.avg("ppp"), 1).alias("mean"), F.round(F.min("ppp"), 1).alias("low"), F.round(F.max("ppp"), 1).alias("high"))
    at = lambda k: F.round(F.col("q")[k], 1)
    ranked = quantiles(per, ["band"], "ppp", [0.25, 0.5, 0.75], hold=True).select("band", "n", at(1).alias("median"), at(0).alias("p25"), at(2).alias("p75"))
    return ranked.join(plain, "band")


AREA_BAND_STATS = f"""WITH {TRADES}, t AS (
  SELECT CASE WHEN exclusive_area < 40 THEN '<40' WHEN exclusive_area < 60 THEN '40-60' WHEN exclusive_area < 85 THEN '60-85' WHEN exclusive_area < 102 THEN '85-102' WHEN exclusive_area < 135 THEN '102-135' ELSE '135+' END AS band, complex_id, ppp
  FROM trades WHERE deal_type <> 'direct'), per AS (SELECT band, complex_id, quantile_cont(ppp, 0.5) AS ppp FROM t GROUP BY 1, 2)
SELECT band, {_DESCRIBED} FROM per GROUP BY 1"""


def floor_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by floor band: month-neutral prices relative to the median of their (complex, area)
    cell of four trades at least, pooled over all cells; trades without a floor take no part."""
    t = open_market(trades(spark, sf_dir)).where("floor is not null")
    tops = t.groupBy("complex_id").agg(F.max("floor").alias("top"))
    months = index_of(trades(spark, sf_dir)).select("deal_ym", "idx")
    adj = F.col("ppp") / F.coalesce(F.when(F.col("idx") != 0, F.col("idx")), F.lit(1.0))
    t = t.join(F.broadcast(months), "deal_ym", "left").withColumn("adj", adj)  # months of a calendar
    cells = beside_median(t, ["complex_id", "area_key"], "adj", "mid", "cell").where("cell >= 4 and mid > 0")
    rel = cells.join(tops, "complex_id").select(floor_band(F.col("floor"), F.col("top")).alias("band"), (F.col("adj") / F.col("mid")).alias("rel"))
    return quantiles(rel, ["band"], "rel", [0.5], hold=True).where("n >= 5").select("band", "n", F.round(F.col("q")[0], 4).alias("factor"))


_INDEX = """base AS (SELECT complex_id, area_key, quantile_cont(ppp, 0.5) AS base FROM t GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT deal_ym, count(*) AS n, quantile_cont(ppp / base, 0.5) AS med FROM t JOIN base USING (complex_id, area_key) GROUP BY 1),
k AS (SELECT deal_ym, CASE WHEN n >= 5 OR row_number() OVER (ORDER BY deal_ym) = 1 THEN med END AS kept FROM m),
c AS (SELECT deal_ym, last_value(kept IGNORE NULLS) OVER (ORDER BY deal_ym) AS level FROM k),
ix AS (SELECT deal_ym, level / last_value(level) OVER (ORDER BY deal_ym ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS idx FROM c)"""

FLOOR_FACTORS = f"""WITH {TRADES}, t AS (SELECT * FROM trades WHERE deal_type <> 'direct'), {_INDEX}, tops AS (SELECT complex_id, max(floor) AS top FROM t GROUP BY 1),
a AS (SELECT t.*, ppp / coalesce(nullif(idx, 0), 1) AS adj FROM t LEFT JOIN ix USING (deal_ym) WHERE floor IS NOT NULL),
cells AS (SELECT complex_id, area_key, quantile_cont(adj, 0.5) AS mid FROM a GROUP BY 1, 2 HAVING count(*) >= 4),
rel AS (SELECT CASE WHEN floor <= 1 THEN 'first' WHEN top >= 8 THEN CASE WHEN floor >= top THEN 'top' WHEN floor / top <= 0.25 THEN 'low' WHEN floor / top <= 0.65 THEN 'middle' ELSE 'high' END
  WHEN floor <= 3 THEN 'low' WHEN floor <= 7 THEN 'middle' ELSE 'high' END AS band, adj / mid AS rel FROM a JOIN tops USING (complex_id) JOIN cells USING (complex_id, area_key) WHERE mid > 0)
SELECT band, count(*) AS n, round(quantile_cont(rel, 0.5), 4) AS factor FROM rel GROUP BY 1 HAVING count(*) >= 5"""


def fair_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fair price for each complex and area type: the median of month-neutral comparable
    sales, of the type itself if it has three, else of the whole complex; with a quantile band
    and a confidence by sample size. Prices are at the last month's level."""
    t = open_market(trades(spark, sf_dir))
    months = index_of(trades(spark, sf_dir)).select("deal_ym", "idx")
    # months of a calendar: a hundred rows or so
    neutral = t.join(F.broadcast(months), "deal_ym", "left").withColumn("adj", F.col("ppp") / F.coalesce(F.when(F.col("idx") != 0, F.col("idx")), F.lit(1.0)))
    q = F.percentile("adj", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = neutral.groupBy("complex_id", "area_key").agg(F.count("*").alias("own_n"), q.alias("own"), F.median("exclusive_area").alias("area"))
    whole = neutral.groupBy("complex_id").agg(F.count("*").alias("all_n"), q.alias("all"))
    both = own.join(whole, "complex_id").withColumn("stage", F.when(F.col("own_n") >= 3, "type").when(F.col("all_n") >= 3, "complex"))
    use = F.when(F.col("stage") == "type", F.col("own")).otherwise(F.col("all"))
    n = F.when(F.col("stage") == "type", F.col("own_n")).otherwise(F.col("all_n"))
    out = both.where("stage is not null").select("complex_id", "area_key", "stage", n.alias("n"), (F.col("area") / 3.305785).alias("pyeong"), use.alias("q"))
    at = lambda k: F.round(F.col("q")[k] * F.col("pyeong") + 1e-7, 4)  # noqa: E731  halves go up, whatever the last bit
    confidence = F.when(F.col("stage") == "complex", "low").when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "medium").otherwise("low")
    return out.select("complex_id", "area_key", "stage", "n", at(1).alias("fair"), at(0).alias("fair_low"), at(2).alias("fair_high"), confidence.alias("confidence"))


FAIR_PRICE = f"""WITH {TRADES}, t AS (SELECT * FROM trades WHERE deal_type <> 'direct'),
{_INDEX},
a AS (SELECT t.*, ppp / coalesce(nullif(idx, 0), 1) AS adj FROM t LEFT JOIN ix USING (deal_ym)),
own AS (SELECT complex_id, area_key, count(*) AS own_n, quantile_cont(adj, [0.25, 0.5, 0.75]) AS own, quantile_cont(exclusive_area, 0.5) AS area FROM a GROUP BY 1, 2),
whole AS (SELECT complex_id, count(*) AS all_n, quantile_cont(adj, [0.25, 0.5, 0.75]) AS whole FROM a GROUP BY 1),
j AS (SELECT complex_id, area_key, CASE WHEN own_n >= 3 THEN 'type' WHEN all_n >= 3 THEN 'complex' END AS stage, CASE WHEN own_n >= 3 THEN own_n ELSE all_n END AS n,
  area / 3.305785 AS p, CASE WHEN own_n >= 3 THEN own ELSE whole END AS q FROM own JOIN whole USING (complex_id))
SELECT complex_id, area_key, stage, n, round(q[2] * p + 1e-7, 4) AS fair, round(q[1] * p + 1e-7, 4) AS fair_low, round(q[3] * p + 1e-7, 4) AS fair_high,
  CASE WHEN stage = 'complex' THEN 'low' WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM j WHERE stage IS NOT NULL"""


def building_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of a building within its (complex, area) cells, in log price, shrunk towards zero.

    Cells need two buildings, buildings two trades. Between-building variance is estimated by
    moments over all buildings."""
    t = open_market(trades(spark, sf_dir)).select("complex_id", "area_key", "dong", F.log("ppp").alias("y"))
    cells = t.groupBy("complex_id", "area_key").agg(F.countDistinct("dong").alias("dongs"), F.avg("y").alias("mid")).where("dongs >= 2").drop("dongs")
    dev = t.join(cells, ["complex_id", "area_key"]).select("complex_id", "dong", (F.col("y") - F.col("mid")).alias("e"))
    per = dev.groupBy("complex_id", "dong").agg(F.count("*").alias("n"), F.avg("e").alias("m")).where("n >= 2")
    sigma = dev.agg(F.var_samp("e").alias("s2"))
    moments = per.agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum("n").alias("n_all"), F.count("*").alias("k"))
    scale = moments.join(sigma).select("s2", F.greatest(F.expr("(sq - s2 * k) / n_all"), F.lit(0.0)).alias("tau2"))
    shrunk = F.expr("case when tau2 + s2 / n > 0 then tau2 / (tau2 + s2 / n) else 0 end")
    # one row of scalars
    return per.join(F.broadcast(scale)).select("complex_id", "dong", "n", F.round(F.col("m"), 6).alias("raw"), (F.round(F.col("m") * shrunk, 6) + F.lit(0.0)).alias("effect"))


BUILDING_EFFECTS = f"""WITH {TRADES}, t AS (SELECT complex_id, area_key, dong, ln(ppp) AS y FROM trades WHERE deal_type <> 'direct'),
cells AS (SELECT complex_id, area_key, avg(y) AS mid FROM t GROUP BY 1, 2 HAVING count(DISTINCT dong) >= 2),
dev AS (SELECT complex_id, dong, y - mid AS e FROM t JOIN cells USING (complex_id, area_key)),
per AS (SELECT complex_id, dong, count(*) AS n, avg(e) AS m FROM dev GROUP BY 1, 2 HAVING count(*) >= 2),
sc AS (SELECT s2, greatest((sq - s2 * k) / n_all, 0) AS tau2 FROM (SELECT sum(n * m * m) AS sq, sum(n) AS n_all, count(*) AS k FROM per), (SELECT var_samp(e) AS s2 FROM dev))
SELECT complex_id, dong, n, round(m, 6) AS raw, round(m * CASE WHEN tau2 + s2 / n > 0 THEN tau2 / (tau2 + s2 / n) ELSE 0 END, 6) + 0.0 AS effect FROM per, sc"""


def district_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts: complexes, and the upper median and low and high ranks of their price levels
    (the element at floor(n q) of the sorted levels, not an interpolation)."""
    t = open_market(trades(spark, sf_dir))
    per = t.groupBy("complex_id").agg(F.round(F.avg("ppp"), 4).alias("level"), F.count("*").alias("n")).where("n >= 3")
    known = per.join(complexes(spark, sf_dir).select("complex_id", "sgg"), "complex_id")
    size = known.groupBy("sgg").agg(F.count("*").alias("size"))
    placed = ranked(known, ["sgg"], ["level", "complex_id"], "at").join(size, "sgg").withColumn("at", F.col("at") - 1)
    pick = lambda q: F.max(F.when(F.col("at") == F.floor(F.col("size") * q), F.col("level")))
    return placed.groupBy("sgg").agg(F.count("*").alias("complexes"), F.sum("n").alias("n_trades"), pick(0.5).alias("upper_median"), pick(0.25).alias("low"), pick(0.75).alias("high"))


DISTRICT_GROUPS = f"""WITH {TRADES}, per AS (SELECT complex_id, round(avg(ppp), 4) AS level, count(*) AS n FROM trades WHERE deal_type <> 'direct' GROUP BY 1 HAVING count(*) >= 3),
r AS (SELECT p_brand AS sgg, level, n, row_number() OVER (PARTITION BY p_brand ORDER BY level, complex_id) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS size FROM per JOIN part ON p_partkey = complex_id)
SELECT sgg, count(*) AS complexes, CAST(sum(n) AS BIGINT) AS n_trades, max(level) FILTER (WHERE pos = floor(size * 0.5)) AS upper_median, max(level) FILTER (WHERE pos = floor(size * 0.25)) AS low, max(level) FILTER (WHERE pos = floor(size * 0.75)) AS high FROM r GROUP BY 1"""


def deal_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of each kind by month, and the share of direct ones."""
    t = trades(spark, sf_dir).groupBy("deal_ym").agg(F.count("*").alias("n"), F.count_if(F.col("deal_type") == "direct").alias("direct"), F.count_if(F.col("deal_type") == "broker").alias("broker"))
    return t.select("deal_ym", "n", "direct", "broker", F.round(F.col("direct") / F.col("n"), 6).alias("direct_share"))


DEAL_TYPE_SHARES = f"WITH {TRADES} SELECT deal_ym, count(*) AS n, count(*) FILTER (WHERE deal_type = 'direct') AS direct, count(*) FILTER (WHERE deal_type = 'broker') AS broker, round(count(*) FILTER (WHERE deal_type = 'direct') / count(*), 6) AS direct_share FROM trades GROUP BY 1"


def hedonic_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage one of the hedonic model in closed form for one factor at a time: log price on log
    area and on floor within complexes (fixed effects absorbed by demeaning).

    One pass of sums; the complex means are a grouped aggregate, so nothing is collected."""
    t = trades(spark, sf_dir).select("complex_id", F.log("ppp").alias("y"), F.log(F.col("exclusive_area") / 84).alias("a"), F.col("floor").cast("double").alias("f"))
    mean = t.groupBy("complex_id").agg(F.avg("y").alias("my"), F.avg("a").alias("ma"), F.avg("f").alias("mf"))
    d = t.join(mean, "complex_id").select((F.col("y") - F.col("my")).alias("y"), (F.col("a") - F.col("ma")).alias("a"), (F.col("f") - F.col("mf")).alias("f"))
    s = d.agg(F.count("*").alias("n"), *(F.sum(F.col(x) * F.col(z)).alias(x + z) for x, z in ("aa", "af", "ff", "ay", "fy", "yy")))
    s = s.withColumn("det", F.expr("aa * ff - af * af"))
    b = s.withColumn("b_area", F.expr("(ff * ay - af * fy) / det")).withColumn("b_floor", F.expr("(aa * fy - af * ay) / det"))
    return b.select("n", F.round("b_area", 6).alias("b_area"), F.round("b_floor", 6).alias("b_floor"), F.round(F.expr("(b_area * ay + b_floor * fy) / yy"), 6).alias("within_r2"))


HEDONIC_WITHIN = """WITH t AS (SELECT l_partkey AS c, ln(l_extendedprice / (l_quantity / 3.305785)) AS y, ln(l_quantity / 84) AS a, CAST(l_linenumber AS DOUBLE) AS f FROM lineitem),
d AS (SELECT y - avg(y) OVER (PARTITION BY c) AS y, a - avg(a) OVER (PARTITION BY c) AS a, f - avg(f) OVER (PARTITION BY c) AS f FROM t),
s AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * f) AS af, sum(f * f) AS ff, sum(a * y) AS ay, sum(f * y) AS fy, sum(y * y) AS yy FROM d),
b AS (SELECT *, (ff * ay - af * fy) / (aa * ff - af * af) AS b_area, (aa * fy - af * ay) / (aa * ff - af * af) AS b_floor FROM s)
SELECT n, round(b_area, 6) AS b_area, round(b_floor, 6) AS b_floor, round((b_area * ay + b_floor * fy) / yy, 6) AS within_r2 FROM b"""


def recent_comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 latest trades of each complex, as a report shows them (a limit is the feature)."""
    t = open_market(trades(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("complex_id").orderBy(F.desc("deal_date"), F.desc("deal_amount"), "dong", "floor"))
    return t.withColumn("rank", rank).where("rank <= 40").select("complex_id", F.col("rank").cast("long").alias("rank"), F.col("deal_ym"), "exclusive_area", "floor", "deal_amount")


RECENT_COMPARABLES = f"WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY deal_date DESC, deal_amount DESC, dong, floor) AS rank FROM trades WHERE deal_type <> 'direct') SELECT complex_id, rank, deal_ym, exclusive_area, floor, deal_amount FROM r WHERE rank <= 40"

QUERIES = {f.__name__: f for f in (market_index, complex_overview, area_band_stats, floor_factors, fair_price, building_effects, district_groups, deal_type_shares, hedonic_within, recent_comparables)}
SQL = {
    "market_index": MARKET_INDEX, "complex_overview": COMPLEX_OVERVIEW, "area_band_stats": AREA_BAND_STATS, "floor_factors": FLOOR_FACTORS, "fair_price": FAIR_PRICE,
    "building_effects": BUILDING_EFFECTS, "district_groups": DISTRICT_GROUPS, "deal_type_shares": DEAL_TYPE_SHARES, "hedonic_within": HEDONIC_WITHIN, "recent_comparables": RECENT_COMPARABLES,
}
