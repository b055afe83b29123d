"""Supply against need: yearly balance, monthly ratio and running difference, peaks, ages, offers.

Households of a year are a region's different customers, demolitions its orders of status P,
completions those of status F. Households are counted once a year is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.functions.scalars import pct_change
from hearthline.operators.ranks import quantiles
from hearthline.plans.market import TRADES
from hearthline.sources.tables import complexes, month_index, region_months, table, trades

#: Years of a smoothed growth, share of the median growth below which a year is odd.
SMOOTH_YEARS, ODD_SHARE = 3, 0.25
#: Age bands (years, both ends within).
AGES = [("0-5", 0, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-30", 21, 30), ("31-40", 31, 40), ("over 40", 41, 999)]
#: Brokered trades and largest area of a complex in the model's frame; rank shares.
LEAST_BROKERED, LEAST_AREA, UPPER, MIDDLE = 3, 40, 0.66, 0.33


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, mi, y, m, done."""
    day = F.col("o_orderdate").cast("date")
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("region"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", month_index(day).alias("mi"))
    return rows.join(who, "o_custkey").groupBy("region", "mi").agg(F.count("*").alias("done")).withColumn("y", F.floor(F.col("mi") / 12)).withColumn("m", F.col("mi") % 12 + 1)


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    day = c("o_orderdate").cast("date")
    who = table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), c("c_mktsegment").alias("region"))
    once = table(spark, sf_dir, "orders").select("o_custkey", F.year(day).cast("long").alias("y"), (c("o_orderstatus") == "P").cast("long").alias("gone"))
    each = once.groupBy("o_custkey", "y").agg(F.sum("gone").alias("gone")).join(who, "o_custkey")  # a customer's year once
    yearly = each.groupBy("region", "y").agg(F.count("*").alias("households"), F.sum("gone").alias("demolish"))
    over = yearly.withColumn("last", F.max("y").over(Window.partitionBy("region"))).where("y < last").drop("last")
    w = Window.partitionBy("region").orderBy("y")
    grown = over.withColumn("growth", c("households") - F.lag("households").over(w)).where("growth IS NOT NULL")
    run = w.rowsBetween(1 - SMOOTH_YEARS, 0)
    need = grown.withColumn("smooth", F.when(F.count("*").over(run) == SMOOTH_YEARS, F.avg("growth").over(run)))
    sorted_growth = F.sort_array(F.collect_list("growth").over(Window.partitionBy("region")))  # a value a year
    mid = F.element_at(sorted_growth, (F.floor(F.size(sorted_growth) / 2) + 1).cast("int"))
    need = need.withColumn("mid", mid).withColumn("odd", (c("mid") != 0) & (c("growth") < c("mid") * ODD_SHARE))
    done = _months(spark, sf_dir).groupBy("region", "y").agg(F.sum("done").alias("done"), F.count("*").alias("n")).where("n = 12").drop("n")
    both = need.join(done, ["region", "y"], "full").withColumn("to", F.max(F.when(c("growth").isNotNull(), c("y"))).over(Window.partitionBy("region")))
    rows = both.where(c("growth").isNotNull() | (c("y") > c("to")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    need_, smooth = c("growth") + c("demolish"), c("smooth") + c("demolish")
    gap, gap_s = c("done") - need_, c("done") - smooth
    return rows.select(
        "region", "y", "households", "growth", "demolish", "smooth", "done", need_.alias("need"), smooth.alias("need_smooth"), gap.alias("gap"), F.coalesce("odd", F.lit(False)).alias("odd"),
        F.when(gap.isNotNull(), F.sum(gap).over(so_far)).alias("gap_cum"), F.when(gap_s.isNotNull(), F.sum(gap_s).over(so_far)).alias("gap_cum_smooth"), c("growth").isNull().alias("missing"))


BALANCE = f"""o AS (SELECT c_mktsegment AS region, o_custkey, o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi FROM orders JOIN customer ON c_custkey = o_custkey),
mm AS (SELECT region, mi, mi // 12 AS y, mi % 12 + 1 AS m, count(*) AS done FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2),
yy AS (SELECT region, y, count(DISTINCT o_custkey) AS households, count(*) FILTER (WHERE o_orderstatus = 'P') AS demolish FROM o GROUP BY 1, 2), yo AS (SELECT * FROM yy WHERE y < (SELECT max(y) FROM yy z WHERE z.region = yy.region)),
gr AS (SELECT * FROM (SELECT *, households - lag(households) OVER (PARTITION BY region ORDER BY y) AS growth FROM yo) WHERE growth IS NOT NULL),
md AS (SELECT region, list_sort(list(growth))[len(list(growth)) // 2 + 1] AS mid, max(y) AS to_ FROM gr GROUP BY 1),
sm AS (SELECT gr.*, mid, CASE WHEN count(*) OVER r = {SMOOTH_YEARS} THEN avg(growth) OVER r END AS smooth, mid <> 0 AND growth < mid * 0.25::DOUBLE AS odd FROM gr JOIN md USING (region) WINDOW r AS (PARTITION BY region ORDER BY y ROWS 2 PRECEDING)),
dn AS (SELECT region, y, CAST(sum(done) AS BIGINT) AS done FROM mm GROUP BY 1, 2 HAVING count(*) = 12),
bl AS (SELECT coalesce(sm.region, dn.region) AS region, coalesce(sm.y, dn.y) AS y, households, growth, demolish, smooth, done, growth + demolish AS need, smooth + demolish AS need_smooth, coalesce(odd, false) AS odd, growth IS NULL AS missing FROM sm FULL JOIN dn ON sm.region = dn.region AND sm.y = dn.y),
b AS (SELECT bl.*, done - need AS gap, CASE WHEN done - need IS NOT NULL THEN sum(done - need) OVER w END AS gap_cum, CASE WHEN done - need_smooth IS NOT NULL THEN sum(done - need_smooth) OVER w END AS gap_cum_smooth FROM bl JOIN md USING (region) WHERE growth IS NOT NULL OR y > to_ WINDOW w AS (PARTITION BY bl.region ORDER BY y))"""


def supply_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Need (growth of households and demolitions) and completions of each year, their difference
    and its running sum; years completed after the last known need stand alone."""
    d = lambda x: F.round(F.col(x).cast("double"), 4).alias(x)
    return _balance(spark, sf_dir).select("region", F.col("y").alias("year"), *map(d, ("households", "growth", "demolish", "smooth", "done", "need", "need_smooth", "gap", "gap_cum", "gap_cum_smooth")), F.col("odd").cast("string").alias("odd"), F.col("missing").cast("string").alias("missing"))


SUPPLY_BALANCE = f"""WITH {BALANCE} SELECT region, y AS year, {', '.join(f'round(CAST({x} AS DOUBLE), 4) AS {x}' for x in ('households', 'growth', 'demolish', 'smooth', 'done', 'need', 'need_smooth', 'gap', 'gap_cum', 'gap_cum_smooth'))},
CAST(odd AS VARCHAR) AS odd, CAST(missing AS VARCHAR) AS missing FROM b"""


def supply_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of twelve months as a share of their need, mixed of two years by months, the last
    known need carried on; and the running difference from the first smoothed year's January on, up
    to the first month without completions."""
    c = F.col
    b = _balance(spark, sf_dir)
    need = b.where(F.round("need_smooth") != 0).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("y", F.round("need_smooth").alias("v")))).alias("need"), F.min("y").alias("first"), F.max("y").alias("last"))
    start = b.where("gap_cum_smooth IS NOT NULL").groupBy("region").agg(F.min("y").alias("start"))
    w = Window.partitionBy("region").orderBy("mi")
    rows = _months(spark, sf_dir).withColumn("done12", F.when(F.count("*").over(w.rowsBetween(-11, 0)) == 12, F.sum("done").over(w.rowsBetween(-11, 0)))).join(need, "region").join(start, "region", "left")

    def of(y):
        return F.coalesce(F.try_element_at("need", y), F.when(y > c("last"), F.try_element_at("need", c("last"))))

    now, then = of(c("y")), F.when(c("m") < 12, of(c("y") - 1)).otherwise(0.0)
    mixed = F.when((c("y") >= c("first")) & ((c("m") == 12) | (c("y") - 1 >= c("first"))), (c("m") * now + (12 - c("m")) * then) / 12)
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(c("y") >= c("start"), c("done") - now / 12)
    cum = rows.select("region", "mi", F.when(mixed > 0, c("done12") / mixed * 100).alias("share"), step.alias("step"), (c("y") >= c("start")).alias("within"), (c("mi") - c("start") * 12).alias("place"))
    row = F.sum(c("within").cast("int")).over(whole)
    kept = c("within") & (row - 1 == c("place")) & (F.sum(F.when(c("within") & c("step").isNull(), 1).otherwise(0)).over(whole) == 0)
    return cum.select("region", c("mi").alias("month"), F.round("share", 4).alias("share"), F.round(F.when(kept, F.sum("step").over(whole)), 4).alias("running"))


SUPPLY_MONTHS = f"""WITH {BALANCE}, nd AS (SELECT region, y, round(need_smooth) AS v FROM b WHERE round(need_smooth) <> 0), ne AS (SELECT region, min(y) AS first_, max(y) AS last_ FROM nd GROUP BY 1), st AS (SELECT region, min(y) AS start FROM b WHERE gap_cum_smooth IS NOT NULL GROUP BY 1),
yrs AS (SELECT ne.region, g.y, CASE WHEN g.y > last_ THEN (SELECT v FROM nd WHERE nd.region = ne.region AND nd.y = last_) ELSE (SELECT v FROM nd WHERE nd.region = ne.region AND nd.y = g.y) END AS v FROM ne, (SELECT unnest(range(1990, 2010)) AS y) g),
x AS (SELECT mm.*, first_, start, CASE WHEN count(*) OVER r = 12 THEN sum(done) OVER r END AS done12, a.v AS now_, p.v AS then_ FROM mm JOIN ne USING (region) LEFT JOIN st USING (region) LEFT JOIN yrs a ON a.region = mm.region AND a.y = mm.y LEFT JOIN yrs p ON p.region = mm.region AND p.y = mm.y - 1 WINDOW r AS (PARTITION BY mm.region ORDER BY mi ROWS 11 PRECEDING)),
z AS (SELECT region, mi, done12, CASE WHEN y >= first_ AND (m = 12 OR y - 1 >= first_) THEN (m * now_ + (12 - m) * CASE WHEN m < 12 THEN then_ ELSE 0 END) / 12 END AS mixed, y >= start AS within_, done - now_ / 12 AS step, mi - start * 12 AS place FROM x),
k AS (SELECT region, mi, step FROM (SELECT region, mi, step, place, row_number() OVER w - 1 AS rn, count(*) FILTER (WHERE step IS NULL) OVER w AS holes FROM z WHERE within_ WINDOW w AS (PARTITION BY region ORDER BY mi)) WHERE rn = place AND holes = 0),
c AS (SELECT region, mi, sum(step) OVER (PARTITION BY region ORDER BY mi) AS running FROM k)
SELECT z.region, z.mi AS month, round(CASE WHEN mixed > 0 THEN done12 / mixed * 100 END, 4) AS share, round(running, 4) AS running FROM z LEFT JOIN c ON c.region = z.region AND c.mi = z.mi"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's latest month, its change on the same month a year before, its first highest month,
    its change on its first month, whether it begins late; from the largest change down."""
    s = region_months(spark, sf_dir).select("region", "ym", "mi", "volume")
    last = s.groupBy("region").agg(F.max(F.struct("mi", "ym", "volume")).alias("l"), F.max(F.struct("volume", -F.col("mi"), "ym")).alias("p"), F.min(F.struct("mi", "ym", "volume")).alias("f"))
    ago = s.select("region", (F.col("mi") + 12).alias("mi"), F.col("volume").alias("ago"))
    one = last.select("region", "l", "p", "f", F.col("l.mi").alias("mi")).join(ago, ["region", "mi"], "left")
    change = F.round(pct_change(F.col("l.volume").cast("double"), F.col("f.volume").cast("double")), 4)
    every = Window.partitionBy(F.lit(1))  # one row for each region
    out = one.withColumn("change", change).withColumn("late", F.col("f.mi") > F.min("f.mi").over(every))
    place = F.row_number().over(every.orderBy(F.desc_nulls_last("change"), "region"))
    return out.select("region", F.col("l.ym").alias("latest"), F.col("l.volume").alias("value"), F.round((F.col("l.volume") / F.col("ago") - 1) * 100, 4).alias("yearly"), F.col("p.ym").alias("peak"), F.col("p.volume").alias("peak_value"), "change", F.col("late").cast("string").alias("late"), place.cast("long").alias("place"))


PEAKS = """WITH s AS (SELECT c_mktsegment AS region, strftime(o_orderdate, '%Y-%m') AS ym, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi, count(*) AS volume FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
e AS (SELECT region, min(mi) AS a, max(mi) AS z, max(volume) AS top FROM s GROUP BY 1), o AS (SELECT e.region, l.ym AS latest, l.volume AS value, round((l.volume / g.volume - 1) * 100, 4) AS yearly, (SELECT arg_min(p.ym, p.mi) FROM s p WHERE p.region = e.region AND p.volume = top) AS peak, top AS peak_value, round((l.volume / f.volume - 1) * 100, 4) AS change, CAST(a > min(a) OVER () AS VARCHAR) AS late
  FROM e JOIN s l ON l.region = e.region AND l.mi = z JOIN s f ON f.region = e.region AND f.mi = a LEFT JOIN s g ON g.region = e.region AND g.mi = z - 12)
SELECT *, row_number() OVER (ORDER BY change DESC NULLS LAST, region) AS place FROM o"""


def age_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexes and their levels by age band, each band's share, and the share of 31 years and more."""
    p = complexes(spark, sf_dir).where("size IS NOT NULL").select("size", F.round(F.col("level") * 100).cast("long").alias("cents"))
    sizes = p.groupBy("size").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    bands = F.array(*(F.struct(F.lit(a).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, lo, hi in AGES))
    each = sizes.select("n", "cents", "size", F.explode(bands).alias("b"))
    own = F.col("size").between(F.col("b.lo"), F.col("b.hi"))
    by_band = each.groupBy("b.band", "b.lo").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("complexes"), F.sum(F.when(own, F.col("cents")).otherwise(0)).alias("cents"))
    all_ = Window.partitionBy(F.lit(1))
    total = F.greatest(F.sum("complexes").over(all_), F.lit(1))
    old = F.sum(F.when(F.col("lo") >= 31, F.col("complexes")).otherwise(0)).over(all_)
    return by_band.select("band", "complexes", "cents", F.round(F.col("complexes") / total * 100, 4).alias("pct"), F.round(old / total * 100, 4).alias("old_pct"))


AGE_PRESSURE = f"""WITH a(band, lo, hi) AS (VALUES {', '.join(f"('{a}', {lo}, {hi})" for a, lo, hi in AGES)}), b AS (SELECT band, lo, count(p_partkey) AS complexes, CAST(coalesce(sum(CAST(round(p_retailprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents FROM a LEFT JOIN part ON p_size BETWEEN lo AND hi GROUP BY 1, 2)
SELECT band, complexes, cents, round(complexes / greatest(sum(complexes) OVER (), 1) * 100, 4) AS pct, round(sum(complexes) FILTER (WHERE lo >= 31) OVER () / greatest(sum(complexes) OVER (), 1) * 100, 4) AS old_pct FROM b"""


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexes of the model's frame: those with three brokered trades and one of 40 square metres,
    with the mean and sample deviation of their log prices."""
    t = trades(spark, sf_dir).where("exclusive_area > 0 AND deal_amount > 0")
    brokered = F.sum((~F.col("deal_type").eqNullSafe("direct")).cast("long"))
    each = t.groupBy("complex_id").agg(F.count("*").alias("n"), brokered.alias("brokered"), F.max("exclusive_area").alias("largest"), F.avg(F.log("ppp")).alias("mean"), F.stddev_samp(F.log("ppp")).alias("sd"))
    return each.where((F.col("brokered") >= LEAST_BROKERED) & (F.col("largest") >= LEAST_AREA)).select("complex_id", "n", "brokered", "largest", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


MODEL_FRAME = f"""WITH {TRADES} SELECT complex_id, count(*) AS n, count(*) FILTER (WHERE deal_type <> 'direct') AS brokered, max(exclusive_area) AS largest, round(avg(ln(ppp)), 6) AS mean, round(stddev_samp(ln(ppp)), 6) AS sd FROM trades
WHERE exclusive_area > 0 AND deal_amount > 0 GROUP BY 1 HAVING count(*) FILTER (WHERE deal_type <> 'direct') >= 3 AND max(exclusive_area) >= 40"""


def variable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five quantiles of each variable of all trades, where ten values are known."""
    t = trades(spark, sf_dir)
    pairs = F.array(*(F.struct(F.lit(x).alias("variable"), F.col(x).cast("double").alias("value")) for x in ("exclusive_area", "floor", "ppp", "deal_amount")))
    q = quantiles(t.select(F.explode(pairs).alias("p")).select("p.*"), ["variable"], "value", [0.01, 0.25, 0.5, 0.75, 0.99]).where("n >= 10")
    return q.select("variable", "n", *(F.round(F.col("q")[i], 4).alias(name) for i, name in enumerate(("p1", "p25", "p50", "p75", "p99"))))


VARIABLE_RANGES = f"""WITH {TRADES}, v AS (SELECT 'exclusive_area' AS variable, exclusive_area AS value FROM trades UNION ALL SELECT 'floor', CAST(floor AS DOUBLE) FROM trades UNION ALL SELECT 'ppp', ppp FROM trades UNION ALL SELECT 'deal_amount', deal_amount FROM trades)
SELECT variable, count(value) AS n, {', '.join(f'round(quantile_cont(value, {q}::DOUBLE), 4) AS {n}' for q, n in ((0.01, 'p1'), (0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.99, 'p99')))} FROM v GROUP BY 1 HAVING count(value) >= 10"""


def building_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings' effects by their place within the complex, averaged over complexes with three
    buildings; none unless there are five such complexes."""
    c = F.col
    mean = trades(spark, sf_dir).where("ppp > 0").groupBy("complex_id", "dong").agg(F.avg(F.log("ppp")).alias("level"))
    whole, order = Window.partitionBy("complex_id"), Window.partitionBy("complex_id").orderBy("coef", "dong")
    effects = mean.select("complex_id", "dong", F.round(c("level") - F.avg("level").over(whole), 10).alias("coef"), F.count("*").over(whole).alias("n")).where("n >= 3")
    placed = effects.withColumn("i", F.row_number().over(order) - 1)
    share = c("i") / (c("n") - 1)
    band = F.when(c("i") == c("n") - 1, "highest").when(c("i") == 0, "lowest").when(share >= UPPER, "upper").when(share >= MIDDLE, "middle").otherwise("lower")
    levels = placed.withColumn("band", band).groupBy("band").agg(F.avg("coef").alias("mean"), F.count("*").alias("n"), F.sum((c("i") == 0).cast("long")).alias("firsts"))
    enough = F.sum("firsts").over(Window.partitionBy(F.lit(1))) >= 5  # one row for each band
    return levels.withColumn("enough", enough).where("enough").select("band", F.round((F.exp("mean") - 1) * 100, 4).alias("premium_pct"), "n")


BUILDING_LEVELS = f"""WITH {TRADES}, l AS (SELECT complex_id, dong, avg(ln(ppp)) AS level FROM trades WHERE ppp > 0 GROUP BY 1, 2), e AS (SELECT complex_id, dong, round(level - avg(level) OVER (PARTITION BY complex_id), 10) AS coef, count(*) OVER (PARTITION BY complex_id) AS n FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY coef, dong) - 1 AS i FROM e WHERE n >= 3), b AS (SELECT *, CASE WHEN i = n - 1 THEN 'highest' WHEN i = 0 THEN 'lowest' WHEN i / (n - 1) >= 0.66::DOUBLE THEN 'upper' WHEN i / (n - 1) >= 0.33::DOUBLE THEN 'middle' ELSE 'lower' END AS band FROM p)
SELECT band, round((exp(avg(coef)) - 1) * 100, 4) AS premium_pct, count(*) AS n FROM b WHERE (SELECT count(DISTINCT complex_id) FROM b) >= 5 GROUP BY 1"""


def merged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of one complex, area, floor and price (in hundred thousands) as one: how many, its first
    row, its notes in order of their first row, and the offer seen last (the cheapest of that day)."""
    c = F.col
    day = c("l_shipdate").cast("date").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("complex_id"), F.bround("l_quantity", 0).cast("long").alias("area_key"), c("l_linenumber").cast("long").alias("floor"), F.floor(c("l_extendedprice") / 100000).cast("long").alias("price"), F.concat(F.lit("note "), "l_returnflag").alias("note"), F.struct("l_orderkey", "l_linenumber").alias("row"), F.struct(day.alias("day"), (-c("l_extendedprice")).alias("price")).alias("seen"))
    key = ["complex_id", "area_key", "floor", "price"]
    notes = rows.groupBy(*key, "note").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.max("seen").alias("seen"))  # a group's notes are few
    out = notes.groupBy(*key).agg(F.sum("n").alias("listings"), F.min("row").alias("row"), F.sort_array(F.collect_list(F.struct("row", "note"))).alias("notes"), F.max("seen").alias("seen"))
    return out.select(*key, "listings", c("row.l_orderkey").alias("first_order"), F.array_join(F.transform("notes", lambda x: x["note"]), "; ").alias("notes"), c("seen.day").alias("last_day"), (-c("seen.price")).alias("asked"))


MERGED_OFFERS = """WITH l AS (SELECT l_partkey AS complex_id, CAST(round_even(l_quantity, 0) AS BIGINT) AS area_key, CAST(l_linenumber AS BIGINT) AS floor, CAST(floor(l_extendedprice / 100000) AS BIGINT) AS price, 'note ' || l_returnflag AS note, l_orderkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_extendedprice AS asked FROM lineitem),
n AS (SELECT complex_id, area_key, floor, price, note, min(l_orderkey) AS o FROM l GROUP BY ALL), t AS (SELECT complex_id, area_key, floor, price, string_agg(note, '; ' ORDER BY o, note) AS notes FROM n GROUP BY ALL),
a AS (SELECT complex_id, area_key, floor, price, count(*) AS listings, min(l_orderkey) AS first_order, max(day) AS last_day FROM l GROUP BY ALL)
SELECT a.*, notes, (SELECT min(l.asked) FROM l WHERE l.complex_id = a.complex_id AND l.area_key = a.area_key AND l.floor = a.floor AND l.price = a.price AND l.day = a.last_day) AS asked FROM a JOIN t USING (complex_id, area_key, floor, price)"""

QUERIES = {f.__name__: f for f in (supply_balance, supply_months, peaks, age_pressure, model_frame, variable_ranges, building_levels, merged_offers)}
SQL = {"supply_balance": SUPPLY_BALANCE, "supply_months": SUPPLY_MONTHS, "peaks": PEAKS, "age_pressure": AGE_PRESSURE, "model_frame": MODEL_FRAME, "variable_ranges": VARIABLE_RANGES, "building_levels": BUILDING_LEVELS, "merged_offers": MERGED_OFFERS}
