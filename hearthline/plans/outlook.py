"""What followed: rises and the paths after them, slopes on the market, forecasts walked forward.

A series has one row for each month of the calendar; windows and pairs of months are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.functions.scalars import interval_score, normal_p
from hearthline.operators.recursions import recursions
from hearthline.plans.bars import BARS
from hearthline.plans.effects import month_closes
from hearthline.plans.series import SERIES, by
from hearthline.sources.tables import daily_bars, monthly_series, table

#: Months that join rises, months around an event, months of a slope (most, least).
RISE_GAP, EVENT_SPAN, SLOPE_MONTHS = 12, (-12, 48), (60, 24)
#: Share outside an interval, returns known before a forecast.
ALPHA, LEAST_TRAINED = 0.2, 36
AHEAD = 3  # months ahead of a forecast
#: What a day keeps of its weight on the next, days that volatility begins with, trading days of a month, months that a rate may be old.
FADE, WARM, TRADING, STALE = 0.94, 60, 21, 3
EARNING_YEARS, EARNING_LAG, PULL_BACK = 3, 3, 6


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_series(spark, sf_dir).select("series", "mi", "ym", "value")


def _rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, from, to, rise: rises of the highest value so far, joined within RISE_GAP months."""
    w = by()
    top = _monthly(spark, sf_dir).withColumn("top", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ups = top.withColumn("rise", F.col("top") - F.lag("top").over(w)).where("rise > 1e-9")
    apart = F.coalesce((F.col("mi") - F.lag("mi").over(w) > RISE_GAP).cast("int"), F.lit(1))
    runs = ups.withColumn("run", F.sum(apart).over(w))
    return runs.groupBy("series", "run").agg(F.min("mi").alias("from"), F.max("mi").alias("to"), F.sum("rise").alias("rise"))


RISES = """t AS (SELECT *, max(value) OVER (PARTITION BY series ORDER BY mi) AS top FROM s), u AS (SELECT *, top - lag(top) OVER (PARTITION BY series ORDER BY mi) AS rise FROM t),
v AS (SELECT *, CASE WHEN mi - lag(mi) OVER (PARTITION BY series ORDER BY mi) <= 12 THEN 0 ELSE 1 END AS apart FROM u WHERE rise > 1e-9::DOUBLE), x AS (SELECT *, sum(apart) OVER (PARTITION BY series ORDER BY mi) AS run FROM v),
r AS (SELECT series, run, min(mi) AS "from", max(mi) AS "to", sum(rise) AS rise FROM x GROUP BY 1, 2)"""


def rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last month of each run of rises, and how far it rose."""
    return _rises(spark, sf_dir).select("series", F.col("from").cast("long").alias("from_month"), F.col("to").cast("long").alias("to_month"), F.round("rise", 4).alias("rise"))


RISES_SQL = f"""WITH {SERIES}, {RISES} SELECT series, "from" AS from_month, "to" AS to_month, round(rise, 4) AS rise FROM r"""


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of all series around the first month of each rise, as a share of that month's."""
    months = _monthly(spark, sf_dir).groupBy("mi").agg(F.avg("value").alias("index"))
    numbered = months.withColumn("at", F.row_number().over(Window.orderBy("mi")))  # a row for each month of the calendar
    start = _rises(spark, sf_dir).select("series", F.col("from").alias("mi")).join(numbered, "mi").select("series", F.col("mi").alias("start"), F.col("at").alias("at0"), F.col("index").alias("base"))
    steps = start.select("*", F.explode(F.sequence(*map(F.lit, EVENT_SPAN))).alias("k")).withColumn("at", F.col("at0") + F.col("k"))
    return steps.join(numbered.select("at", "index"), "at").select("series", F.col("start").cast("long").alias("start_month"), F.col("k").cast("long").alias("k"), F.round(F.col("index") / F.col("base") * 100, 6).alias("path"))


EVENT_PATHS = f"""WITH {SERIES}, {RISES}, m AS (SELECT mi, avg(value) AS v, row_number() OVER (ORDER BY mi) AS at_ FROM s GROUP BY 1)
SELECT series, "from" AS start_month, n.at_ - m.at_ AS k, round(n.v / m.v * 100, 6) AS path FROM r JOIN m ON m.mi = r."from" JOIN m n ON n.at_ BETWEEN m.at_ - 12 AND m.at_ + 48"""


def market_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of a series' monthly log returns on the market's, over the last 60 pairs of finished
    months that follow each other; none under 24."""
    most, least = SLOPE_MONTHS
    s = _monthly(spark, sf_dir)
    market = s.groupBy("mi").agg(F.avg("value").alias("market"))
    w = by()
    done = s.join(market, "mi").withColumn("last", F.max("mi").over(Window.partitionBy("series"))).where("mi < last")
    pairs = done.select(
        "series", "mi", F.log(F.col("value") / F.lag("value").over(w)).alias("y"), F.log(F.col("market") / F.lag("market").over(w)).alias("x"), (F.col("mi") - F.lag("mi").over(w)).alias("step")).where("step = 1")
    newest = pairs.withColumn("back", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("mi")))).where(F.col("back") <= most)
    out = newest.groupBy("series").agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("n_months"), F.min("mi").alias("from_month"), F.max("mi").alias("to_month"))
    return out.where(F.col("n_months") >= least).select("series", F.round("slope", 6).alias("slope"), "n_months", "from_month", "to_month")


MARKET_SLOPES = f"""WITH {SERIES}, m AS (SELECT mi, avg(value) AS mv FROM s GROUP BY 1), d AS (SELECT * FROM (SELECT s.*, mv, max(mi) OVER (PARTITION BY series) AS last_ FROM s JOIN m USING (mi)) WHERE mi < last_),
p AS (SELECT series, mi, ln(value / lag(value) OVER w) AS y, ln(mv / lag(mv) OVER w) AS x, mi - lag(mi) OVER w AS step FROM d WINDOW w AS (PARTITION BY series ORDER BY mi)),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mi DESC) AS back FROM p WHERE step = 1)
SELECT series, round(regr_slope(y, x), 6) AS slope, count(*) AS n_months, min(mi) AS from_month, max(mi) AS to_month FROM b WHERE back <= 60 GROUP BY 1 HAVING count(*) >= 24"""


def long_earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price over the mean earnings of whole years up to some months before, or up to the last
    earnings known at most six months earlier still. Earnings are orders' mean counts in hundreds; a
    series' last five months have none."""
    n = EARNING_YEARS * 12
    s = monthly_series(spark, sf_dir).select("series", "mi", "ym", "value", "n")
    w = by()
    known = F.when(F.col("mi") <= F.max("mi").over(Window.partitionBy("series")) - 5, F.col("n") * 100.0)
    e = s.withColumn("earned", known)
    window = w.rangeBetween(1 - n, 0)
    mean = F.when((F.count("earned").over(window) == n), F.avg("earned").over(window))
    e = e.withColumn("at", F.when(F.col("earned").isNotNull(), F.struct("mi", mean.alias("mean"))))
    found = F.max("at").over(w.rangeBetween(-EARNING_LAG - PULL_BACK, -EARNING_LAG))
    out = e.withColumn("found", found).where(F.col("found.mean") > 0)
    return out.select("series", "ym", F.col("found.mi").cast("long").alias("earned_to"), F.round(F.col("value") / F.col("found.mean"), 6).alias("ratio"))


LONG_EARNINGS = """WITH s AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS ym, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi, avg(o_totalprice) AS value, count(*) AS n FROM orders GROUP BY 1, 2, 3),
e AS (SELECT series, mi, n * 100.0::DOUBLE AS earned FROM s WHERE mi <= (SELECT max(z.mi) FROM s z WHERE z.series = s.series) - 5),
t AS (SELECT s.series, s.ym, s.value, max(e.mi) AS earned_to FROM s JOIN e ON e.series = s.series AND e.mi BETWEEN s.mi - 9 AND s.mi - 3 GROUP BY 1, 2, 3)
SELECT t.series, t.ym, t.earned_to, round(any_value(t.value) / avg(e.earned), 6) AS ratio FROM t JOIN e ON e.series = t.series AND e.mi BETWEEN t.earned_to - 35 AND t.earned_to GROUP BY 1, 2, 3 HAVING count(*) = 36 AND avg(e.earned) > 0"""


def years_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly return in percent to the same month two years on; null where it isn't known."""
    then = F.max("value").over(by().rangeBetween(24, 24))
    return _monthly(spark, sf_dir).select("series", "ym", F.round((F.pow(then / F.col("value"), 0.5) - 1) * 100, 6).alias("yearly"))


YEARS_AHEAD = f"""WITH {SERIES} SELECT s.series, s.ym, round((pow(z.value / s.value, 0.5::DOUBLE) - 1) * 100, 6) AS yearly FROM s LEFT JOIN s z ON z.series = s.series AND z.mi = s.mi + 24"""


def forecasts(s: DataFrame, h: int) -> DataFrame:
    """series, mi, y (the log return over h months to come), model, centre, low, high: no change, or
    the mean of the past; around it the quantiles of returns that ended by then."""
    w = by()
    ret = s.withColumn("y", F.log(F.lead("value", h).over(w) / F.col("value")))
    past = w.rowsBetween(Window.unboundedPreceding, -h)
    trained = ret.select("series", "mi", "y", F.count("y").over(past).alias("n"), F.avg("y").over(past).alias("mean"), F.percentile("y", F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2))).over(past).alias("q"))
    centres = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), c.alias("centre")) for m, c in [("same", F.lit(0.0)), ("mean", F.col("mean"))])))
    ready = trained.where((F.col("n") >= LEAST_TRAINED) & F.col("y").isNotNull()).select("*", centres.alias("m"))
    centre = F.col("m.centre")
    return ready.select("series", "mi", "y", "m.model", centre.alias("centre"), (centre + F.col("q")[0] - F.col("mean")).alias("low"), (centre + F.col("q")[1] - F.col("mean")).alias("high"))


FORECASTS = """w AS (SELECT series, mi, ln(lead(value, 3) OVER o / value) AS y FROM s WINDOW o AS (PARTITION BY series ORDER BY mi)), i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mi) AS pos FROM w),
c AS (SELECT a.series, a.mi, a.y, avg(b.y) AS mean, quantile_cont(b.y, 0.1) AS q1, quantile_cont(b.y, 0.9) AS q9 FROM i a JOIN i b ON b.series = a.series AND b.pos <= a.pos - 3 WHERE a.y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(b.y) >= 36),
f AS (SELECT series, mi, y, model, centre, centre + q1 - mean AS low, centre + q9 - mean AS high FROM (SELECT *, unnest(['same', 'mean']) AS model, unnest([0.0::DOUBLE, mean]) AS centre FROM c))"""


def walked_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's forecasts of the next three months, from what was known then, and their score."""
    f = forecasts(_monthly(spark, sf_dir), AHEAD)
    return f.select("series", F.col("mi").cast("long").alias("month"), "model", *(F.round(x, 6).alias(x) for x in ("y", "centre", "low", "high")), F.round(interval_score(F.col("low"), F.col("high"), F.col("y"), ALPHA), 6).alias("score"))


_SCORE = "(high - low) + 10 * greatest(low - y, 0) + 10 * greatest(y - high, 0)"
WALKED_FORECASTS = f"""WITH {SERIES}, {FORECASTS} SELECT series, mi AS month, model, round(y, 6) AS y, round(centre, 6) AS centre, round(low, 6) AS low, round(high, 6) AS high, round({_SCORE}, 6) AS score FROM f"""


def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, coverage, width and score of the two forecasts, and the t of their squared errors'
    difference with overlapping months allowed for and its p; t is negative where the mean is better."""
    f = forecasts(_monthly(spark, sf_dir), AHEAD)
    c = F.col
    loss = F.pow(c("centre") - c("y"), 2)
    own = f.groupBy("series", "model").agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(loss)), 6).alias("rmse"), F.round(F.avg(c("y").between(c("low"), c("high")).cast("double")), 6).alias("coverage"),
        F.round(F.avg(c("high") - c("low")), 6).alias("width"), F.round(F.avg(interval_score(c("low"), c("high"), c("y"), ALPHA)), 6).alias("score"))
    d = f.groupBy("series", "mi").agg(F.sum(F.when(c("model") == "mean", loss).otherwise(-loss)).alias("d"))
    tested = mean_test(d, AHEAD - 1).withColumn("p", F.round(normal_p(F.col("t")), 6))
    return own.join(tested, "series").select("series", "model", "n", "rmse", "coverage", "width", "score", F.round("t", 4).alias("t"), "p")


def mean_test(d: DataFrame, lag: int) -> DataFrame:
    """series, t: the mean of d over its standard error, with weights that fall over lag rows."""
    off = F.col("d") - F.avg("d").over(Window.partitionBy("series"))
    dev = d.withColumn("v", off)
    terms = dev.select("series", "d", "v", *((F.col("v") * F.lag("v", k).over(by())).alias(f"g{k}") for k in range(1, lag + 1)))
    around = sum((2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) for k in range(1, lag + 1)), F.lit(0.0))
    n = F.count("*")
    return terms.groupBy("series").agg(F.avg("d").alias("m"), ((F.sum(F.col("v") * F.col("v")) + around) / n).alias("var"), n.alias("k")).select("series", F.when((F.col("var") > 0) & (F.col("k") > 1), F.col("m") / F.sqrt(F.col("var") / F.col("k"))).alias("t"))


FORECAST_SCORES = f"""WITH {SERIES}, {FORECASTS}, d AS (SELECT series, mi, sum(CASE WHEN model = 'mean' THEN 1 ELSE -1 END * pow(centre - y, 2)) AS d FROM f GROUP BY 1, 2),
v AS (SELECT series, mi, d, d - avg(d) OVER (PARTITION BY series) AS v FROM d), g AS (SELECT series, d, v, v * lag(v, 1) OVER o AS g1, v * lag(v, 2) OVER o AS g2 FROM v WINDOW o AS (PARTITION BY series ORDER BY mi)),
t AS (SELECT series, avg(d) / sqrt((sum(v * v) + 2 * (2.0::DOUBLE / 3) * sum(g1) + 2 * (1.0::DOUBLE / 3) * sum(g2)) / count(*) / count(*)) AS t FROM g GROUP BY 1)
SELECT series, model, count(*) AS n, round(sqrt(avg(pow(centre - y, 2))), 6) AS rmse, round(avg(CASE WHEN y BETWEEN low AND high THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(high - low), 6) AS width, round(avg({_SCORE}), 6) AS score, round(any_value(t), 4) AS t, round(any_value(greatest(1 - list_sum(list_transform(range(0, 201), lambda n: exp((2 * n + 1) * ln(abs(t) / sqrt(2)) - lgamma(n + 1.5) - t * t / 2))), 0)), 6) AS p FROM f JOIN t USING (series) GROUP BY 1, 2"""


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series' months above its mean, each that is at least twelve after the last one kept."""
    high = _monthly(spark, sf_dir).withColumn("mean", F.avg("value").over(Window.partitionBy("series"))).where("value > mean")
    months = high.groupBy("series").agg(F.sort_array(F.collect_list("mi")).alias("months"))  # of the calendar
    apart = lambda kept, m: F.when(F.size(kept) == 0, True).otherwise(m - F.try_element_at(kept, F.lit(-1)) >= 12)
    kept = F.aggregate("months", F.array().cast("array<bigint>"), lambda kept, m: F.when(apart(kept, m), F.concat(kept, F.array(m))).otherwise(kept))
    return months.select("series", F.posexplode(kept).alias("place", "month")).select("series", (F.col("place") + 1).cast("long").alias("place"), "month")


THINNED = f"""WITH RECURSIVE {SERIES}, h AS (SELECT series, mi FROM (SELECT *, avg(value) OVER (PARTITION BY series) AS mean FROM s) WHERE value > mean),
k AS (SELECT series, CAST(1 AS BIGINT) AS place, min(mi) AS month FROM h GROUP BY 1 UNION ALL SELECT * FROM (SELECT k.series, k.place + 1, (SELECT min(h.mi) FROM h WHERE h.series = k.series AND h.mi >= k.month + 12) AS month FROM k) WHERE month IS NOT NULL)
SELECT * FROM k"""

# ---- forecasts from a riskless rate and from volatility


def daily_volatility(bars: DataFrame) -> DataFrame:
    """symbol, mi, vol: the deviation of daily log returns at each month's end, old days fading by FADE; it begins with
    the mean of WARM days. bars: symbol, day, close."""
    c, at = F.col, F.col("at")
    step = F.log(c("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("day")))
    squares = bars.withColumn("square", step * step).where("square is not null")
    fade = {"var": (F.when(at < WARM, 1.0).otherwise(FADE), F.when(at < WARM, c("square") / WARM).otherwise((1 - FADE) * c("square")))}
    known = recursions(squares, ["symbol"], ["day"], fade).where(at >= WARM)
    return known.groupBy("symbol", (F.year("day") * 12 + F.month("day") - 1).cast("long").alias("mi")).agg(F.sqrt(F.max_by("var", "day")).alias("vol"))


def month_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's volatility at the end of each month."""
    return daily_volatility(daily_bars(spark, sf_dir)).select("symbol", F.col("mi").alias("month"), F.round("vol", 8).alias("vol"))


_VOLATILITY = f"""sq AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k, square FROM (SELECT symbol, day, pow(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)), 2) AS square FROM b) WHERE square IS NOT NULL),
st AS (SELECT symbol, avg(square) AS var FROM sq WHERE k < {WARM} GROUP BY 1 HAVING count(*) = {WARM}),
vr AS (SELECT symbol, {WARM - 1} AS k, NULL::DATE AS day, var FROM st UNION ALL SELECT sq.symbol, sq.k, sq.day, {FADE}::DOUBLE * vr.var + {1 - FADE}::DOUBLE * square FROM vr JOIN sq ON sq.symbol = vr.symbol AND sq.k = vr.k + 1),
vo AS MATERIALIZED (SELECT symbol, CAST(year(day) * 12 + month(day) - 1 AS BIGINT) AS mi, sqrt(arg_max(var, day)) AS vol FROM vr WHERE day IS NOT NULL GROUP BY 1, 2)"""
MONTH_VOLATILITY = f"WITH RECURSIVE {BARS}, {_VOLATILITY} SELECT symbol, mi AS month, round(vol, 8) AS vol FROM vo"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mi, rate: a yearly riskless rate in percent, each month's mean discount standing for it."""
    return table(spark, sf_dir, "lineitem").groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("long").alias("mi")).agg((F.avg("l_discount") * 100).alias("rate"))


def risk_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's forecasts of the next three months' log return: what the riskless rate then known gives and the mean
    excess so far, with the quantiles of excesses, or of excesses by their volatility times that of now."""
    c, h = F.col, AHEAD
    line = Window.partitionBy("symbol").orderBy("mi")
    closes = month_closes(spark, sf_dir)
    known = F.last("rate", ignorenulls=True).over(line.rangeBetween(-STALE, 0))
    rows = closes.join(rates(spark, sf_dir), "mi", "left").join(daily_volatility(daily_bars(spark, sf_dir)), ["symbol", "mi"], "left")
    rows = rows.withColumns({"rf": F.log1p(known / 100) * h / 12, "y": F.log(F.lead("close", h).over(line) / c("close"))}).withColumn("excess", c("y") - c("rf"))
    past = F.collect_list(F.when(c("excess").isNotNull(), F.struct("excess", "vol"))).over(line.rowsBetween(Window.unboundedPreceding, -h))  # a calendar's months
    ready = rows.withColumn("past", past).where((F.size("past") >= LEAST_TRAINED) & c("rf").isNotNull() & c("y").isNotNull())
    mean = F.aggregate("past", F.lit(0.0), lambda acc, x: acc + x["excess"]) / F.size("past")
    ready = ready.withColumn("mean", mean)
    scale = (TRADING * h) ** 0.5
    off = F.array_sort(F.transform("past", lambda x: x["excess"] - c("mean")))
    by_vol = F.array_sort(F.transform(F.filter("past", lambda x: x["vol"].isNotNull()), lambda x: (x["excess"] - c("mean")) / (x["vol"] * scale)))
    models = F.array(F.struct(F.lit("rate").alias("model"), off.alias("off"), F.lit(1.0).alias("width")), F.struct(F.lit("volatility").alias("model"), by_vol.alias("off"), (c("vol") * scale).alias("width")))
    each = ready.select("symbol", "mi", "y", (c("rf") + c("mean")).alias("centre"), F.explode(models).alias("m")).where((F.size("m.off") >= LEAST_TRAINED) & c("m.width").isNotNull())

    def quantile(q: float):
        place = (F.size("m.off") - 1) * F.lit(q)
        low, high = F.get("m.off", F.floor(place).cast("int")), F.get("m.off", F.ceil(place).cast("int"))
        return c("centre") + (low + (high - low) * (place - F.floor(place))) * c("m.width")

    out = each.select("symbol", "mi", "y", "m.model", "centre", quantile(ALPHA / 2).alias("low"), quantile(1 - ALPHA / 2).alias("high"))
    return out.select("symbol", c("mi").alias("month"), "model", *(F.round(x, 6).alias(x) for x in ("y", "centre", "low", "high")), F.round(interval_score(c("low"), c("high"), c("y"), ALPHA), 6).alias("score"))


RISK_FORECASTS = f"""WITH RECURSIVE {BARS}, {_VOLATILITY}, mc AS (SELECT symbol, mi, close FROM (SELECT symbol, CAST(year(day) * 12 + month(day) - 1 AS BIGINT) AS mi, arg_max(close, day) AS close FROM b GROUP BY 1, 2) m WHERE mi < (SELECT max(CAST(year(day) * 12 + month(day) - 1 AS BIGINT)) FROM b WHERE b.symbol = m.symbol)),
rt AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS mi, avg(l_discount) * 100 AS rate FROM lineitem GROUP BY 1),
x AS MATERIALIZED (SELECT mc.symbol, mc.mi, vol, (SELECT ln(1 + arg_max(rate, rt.mi) / 100) * {AHEAD} / 12 FROM rt WHERE rt.mi BETWEEN mc.mi - {STALE} AND mc.mi) AS rf, ln(lead(close, {AHEAD}) OVER o / close) AS y, row_number() OVER o AS pos FROM mc LEFT JOIN vo ON vo.symbol = mc.symbol AND vo.mi = mc.mi WINDOW o AS (PARTITION BY mc.symbol ORDER BY mc.mi)),
m AS (SELECT a.symbol, a.mi, any_value(a.y) AS y, any_value(a.vol) AS vol, any_value(a.pos) AS pos, any_value(a.rf) + avg(p.y - p.rf) AS centre, avg(p.y - p.rf) AS mean FROM x a JOIN x p ON p.symbol = a.symbol AND p.pos <= a.pos - {AHEAD} WHERE a.rf IS NOT NULL AND a.y IS NOT NULL AND p.y - p.rf IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST_TRAINED}),
q AS (SELECT m.symbol, m.mi, quantile_cont(p.y - p.rf - mean, {ALPHA / 2}::DOUBLE) AS a1, quantile_cont(p.y - p.rf - mean, {1 - ALPHA / 2}::DOUBLE) AS a2, quantile_cont((p.y - p.rf - mean) / (p.vol * sqrt({TRADING * AHEAD})), {ALPHA / 2}::DOUBLE) FILTER (WHERE p.vol IS NOT NULL) AS b1, quantile_cont((p.y - p.rf - mean) / (p.vol * sqrt({TRADING * AHEAD})), {1 - ALPHA / 2}::DOUBLE) FILTER (WHERE p.vol IS NOT NULL) AS b2, count(p.vol) AS nv
  FROM m JOIN x p ON p.symbol = m.symbol AND p.pos <= m.pos - {AHEAD} WHERE p.y - p.rf IS NOT NULL GROUP BY 1, 2),
f AS (SELECT symbol, mi, y, 'rate' AS model, centre, centre + a1 AS low, centre + a2 AS high FROM m JOIN q USING (symbol, mi) UNION ALL SELECT symbol, mi, y, 'volatility', centre, centre + b1 * vol * sqrt({TRADING * AHEAD}), centre + b2 * vol * sqrt({TRADING * AHEAD}) FROM m JOIN q USING (symbol, mi) WHERE vol IS NOT NULL AND nv >= {LEAST_TRAINED})
SELECT symbol, mi AS month, model, round(y, 6) AS y, round(centre, 6) AS centre, round(low, 6) AS low, round(high, 6) AS high, round({_SCORE}, 6) AS score FROM f"""

QUERIES = {"rises": rises, "event_paths": event_paths, "market_slopes": market_slopes, "long_earnings": long_earnings, "years_ahead": years_ahead, "walked_forecasts": walked_forecasts, "forecast_scores": forecast_scores, "thinned": thinned, "month_volatility": month_volatility, "risk_forecasts": risk_forecasts}
SQL = {"rises": RISES_SQL, "event_paths": EVENT_PATHS, "market_slopes": MARKET_SLOPES, "long_earnings": LONG_EARNINGS, "years_ahead": YEARS_AHEAD, "walked_forecasts": WALKED_FORECASTS, "forecast_scores": FORECAST_SCORES, "thinned": THINNED, "month_volatility": MONTH_VOLATILITY, "risk_forecasts": RISK_FORECASTS}
