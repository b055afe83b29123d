"""Daily closes and asking prices: indicators, signals, returns, ranks, lifetimes.

Windows run within one symbol; a symbol has one row for each day. Recursive indicators are
folds over a symbol's ordered closes, in grouped pandas functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.functions.scalars import pct_change, verdict
from hearthline.operators.recursions import recursions
from hearthline.operators.ranks import quantiles, ranked
from hearthline.sources.tables import daily_bars, quotes
from hearthline.storage import ship

BARS = "b AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"
QUOTES = "q AS (SELECT user_id, event_type AS kind, value AS price FROM events)"


def by_day():
    return Window.partitionBy("symbol").orderBy("day")


def _day():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-day mean and population deviation, and the bands two deviations away."""
    frame = by_day().rowsBetween(-19, 0)
    rows = daily_bars(spark, sf_dir).withColumns({"n": F.count("*").over(frame), "mean": F.avg("close").over(frame), "sd": F.stddev_pop("close").over(frame)}).where("n = 20")
    return rows.select("symbol", _day(), F.round("mean", 6).alias("mean"), F.round(F.expr("mean - 2 * sd"), 6).alias("low"), F.round(F.expr("mean + 2 * sd"), 6).alias("high"))


BOLLINGER = f"""WITH {BARS}, w AS (SELECT symbol, day, count(*) OVER o AS n, avg(close) OVER o AS mean, stddev_pop(close) OVER o AS sd FROM b WINDOW o AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING))
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, round(mean, 6) AS mean, round(mean - 2 * sd, 6) AS low, round(mean + 2 * sd, 6) AS high FROM w WHERE n = 20"""


def channel_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose close leaves the channel of the 20 days before (the day itself excluded)."""
    frame = by_day().rowsBetween(-20, -1)
    rows = daily_bars(spark, sf_dir).withColumns({"n": F.count("*").over(frame), "top": F.max("close").over(frame), "bottom": F.min("close").over(frame)})
    side = F.when(F.col("close") > F.col("top"), "up").when(F.col("close") < F.col("bottom"), "down")
    return rows.where("n = 20").withColumn("side", side).where("side is not null").select("symbol", _day(), "side")


CHANNEL_BREAKOUTS = f"""WITH {BARS}, w AS (SELECT *, count(*) OVER o AS n, max(close) OVER o AS top, min(close) OVER o AS bottom FROM b WINDOW o AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CASE WHEN close > top THEN 'up' ELSE 'down' END AS side FROM w WHERE n = 20 AND (close > top OR close < bottom)"""


def average_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the 50-day mean crosses the 200-day mean: at most it the day before and
    above it now, or the reverse."""
    fast, slow = by_day().rowsBetween(-49, 0), by_day().rowsBetween(-199, 0)
    rows = daily_bars(spark, sf_dir).withColumns({"n": F.count("*").over(slow), "gap": F.round(F.avg("close").over(fast) - F.avg("close").over(slow), 6)}).where("n = 200")
    was = F.lag("gap").over(by_day())
    rows = rows.withColumn("side", F.when((was <= 0) & (F.col("gap") > 0), "up").when((was >= 0) & (F.col("gap") < 0), "down"))
    return rows.where("side is not null").select("symbol", _day(), "side")


AVERAGE_CROSSINGS = f"""WITH {BARS}, w AS (SELECT symbol, day, count(*) OVER s AS n, round(avg(close) OVER f - avg(close) OVER s, 6) AS gap FROM b WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING), s AS (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING)),
l AS (SELECT *, lag(gap) OVER (PARTITION BY symbol ORDER BY day) AS was FROM w WHERE n = 200)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CASE WHEN gap > 0 THEN 'up' ELSE 'down' END AS side FROM l WHERE (was <= 0 AND gap > 0) OR (was >= 0 AND gap < 0)"""


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest fall of each symbol below its highest close so far, in percent."""
    high = F.max("close").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    return daily_bars(spark, sf_dir).withColumn("high", high).groupBy("symbol").agg(F.count("*").alias("days"), F.round(F.min(pct_change(F.col("close"), F.col("high"))), 6).alias("drawdown"))


DRAWDOWN = f"WITH {BARS}, h AS (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS high FROM b) SELECT symbol, count(*) AS days, round(min((close / high - 1) * 100), 6) AS drawdown FROM h GROUP BY 1"


def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of buying on the next day and selling 20 days after that, at 0.1 % a side."""
    out = F.lead("close", 21).over(by_day()) / F.lead("close", 1).over(by_day()) * 0.999 * 0.999 - 1
    return daily_bars(spark, sf_dir).withColumn("ret", F.round(out, 6)).where("ret is not null").select("symbol", _day(), "ret")


FORWARD_RETURNS = f"""WITH {BARS}, r AS (SELECT symbol, day, round(lead(close, 21) OVER o / lead(close, 1) OVER o * 0.999 * 0.999 - 1, 6) AS ret FROM b WINDOW o AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, ret FROM r WHERE ret IS NOT NULL"""


def month_end_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last close of each month but the last, which is unfinished."""
    rows = daily_bars(spark, sf_dir).groupBy("symbol", F.date_format("day", "yyyy-MM").alias("ym")).agg(F.max_by("close", "day").alias("close"))
    return rows.withColumn("last", F.max("ym").over(Window.partitionBy("symbol"))).where("ym < last").select("symbol", "ym", F.round("close", 4).alias("close"))


MONTH_END_CLOSES = f"""WITH {BARS}, m AS (SELECT symbol, strftime(day, '%Y-%m') AS ym, arg_max(close, day) AS close FROM b GROUP BY 1, 2), l AS (SELECT *, max(ym) OVER (PARTITION BY symbol) AS last_ym FROM m)
SELECT symbol, ym, round(close, 4) AS close FROM l WHERE ym < last_ym"""


def fold_indicators(bars: DataFrame) -> DataFrame:
    """EMA 12 and 26 with their difference and its EMA 9, and Wilder's RSI 14. bars: symbol, day, close.

    All are linear recursions: an average moves by its share of what is new, and begins with the first value."""
    c, at = F.col, F.col("at")
    change = c("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    rows = bars.withColumns({"gain": F.greatest(change, F.lit(0.0)), "loss": F.greatest(-change, F.lit(0.0))})

    def ema(value, n: int, first: int = 0):
        share = 2 / (n + 1)
        return F.when(at <= first, 0.0).otherwise(1 - share), F.when(at < first, 0.0).when(at == first, value).otherwise(share * value)

    def wilder(value, n: int):
        return F.when(at <= n, 1.0).otherwise((n - 1) / n), F.when(at < 1, 0.0).otherwise(value / n)

    first = recursions(rows, ["symbol"], ["day"], {"fast": ema(c("close"), 12), "slow": ema(c("close"), 26), "up": wilder(c("gain"), 14), "down": wilder(c("loss"), 14)})
    macd = first.drop("at").withColumn("macd", c("fast") - c("slow"))
    both = recursions(macd, ["symbol"], ["day"], {"signal": ema(c("macd"), 9, 25)})
    rsi = F.when(at >= 14, F.when(c("down") == 0, 100.0).otherwise(100 - 100 / (1 + c("up") / c("down"))))
    return both.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.when(at >= 25, c("macd")), 6).alias("macd"), F.round(F.when(at >= 25, c("signal")), 6).alias("signal"), F.round(rsi, 6).alias("rsi"))


def folded_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD and RSI by symbol and day."""
    return fold_indicators(daily_bars(spark, sf_dir))


FOLDED_INDICATORS = f"""WITH RECURSIVE {BARS}, x AS (SELECT symbol, day, close, row_number() OVER o - 1 AS k, greatest(close - lag(close) OVER o, 0) AS gain, greatest(lag(close) OVER o - close, 0) AS loss FROM b WINDOW o AS (PARTITION BY symbol ORDER BY day)),
f AS (SELECT symbol, day, k, close AS fast, close AS slow, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS signal FROM x WHERE k = 0 UNION ALL
  SELECT symbol, day, k, fast, slow, up, down, CASE WHEN k < 25 THEN 0 WHEN k = 25 THEN fast - slow ELSE was * 0.8::DOUBLE + 0.2::DOUBLE * (fast - slow) END FROM (
    SELECT x.symbol, x.day, x.k, f.signal AS was, f.fast + 2.0::DOUBLE / 13 * (close - f.fast) AS fast, f.slow + 2.0::DOUBLE / 27 * (close - f.slow) AS slow, f.up * CASE WHEN x.k <= 14 THEN 1 ELSE 13.0::DOUBLE / 14 END + gain / 14 AS up, f.down * CASE WHEN x.k <= 14 THEN 1 ELSE 13.0::DOUBLE / 14 END + loss / 14 AS down
    FROM f JOIN x ON x.symbol = f.symbol AND x.k = f.k + 1))
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN k >= 25 THEN fast - slow END, 6) AS macd, round(CASE WHEN k >= 25 THEN signal END, 6) AS signal, round(CASE WHEN k >= 14 THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END, 6) AS rsi FROM f"""


def asking_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' asking prices against the median of their kind: gap, verdict and rank, cheapest
    first within the kind."""
    q = quotes(spark, sf_dir).groupBy("user_id", "kind").agg(F.count("*").alias("seen"), F.avg("price").alias("price"))
    mid = quantiles(q, ["kind"], "price", [0.5]).select("kind", F.col("q")[0].alias("mid"))
    rows = q.join(mid, "kind").withColumn("gap", F.round(pct_change(F.col("price"), F.col("mid")), 4))
    return ranked(rows, ["kind"], ["gap", "user_id"]).select("kind", "user_id", "seen", "gap", verdict(F.col("gap")).alias("verdict"), "rank")


ASKING_RANKS = f"""WITH {QUOTES}, u AS (SELECT user_id, kind, count(*) AS seen, avg(price) AS price FROM q GROUP BY 1, 2), m AS (SELECT kind, quantile_cont(price, 0.5) AS mid FROM u GROUP BY 1),
g AS (SELECT kind, user_id, seen, round((price / mid - 1) * 100, 4) AS gap FROM u JOIN m USING (kind))
SELECT kind, user_id, seen, gap, CASE WHEN gap <= -10 THEN 'very cheap' WHEN gap <= -3 THEN 'cheap' WHEN gap < 3 THEN 'fair' WHEN gap < 10 THEN 'dear' ELSE 'very dear' END AS verdict, row_number() OVER (PARTITION BY kind ORDER BY gap, user_id) AS rank FROM g"""

QUERIES = {f.__name__: f for f in (bollinger, channel_breakouts, average_crossings, drawdown, forward_returns, month_end_closes, folded_indicators, asking_ranks)}
SQL = {"bollinger": BOLLINGER, "channel_breakouts": CHANNEL_BREAKOUTS, "average_crossings": AVERAGE_CROSSINGS, "drawdown": DRAWDOWN, "forward_returns": FORWARD_RETURNS, "folded_indicators": FOLDED_INDICATORS, "month_end_closes": MONTH_END_CLOSES, "asking_ranks": ASKING_RANKS}
