"""Figures as filed: which filing counts, quarters from cumulative spans, twelve months, nine tests.

A fact says that a company's figure over a span (or at its end, where it has no start) was filed on a
day. The facts are made of orders: each quarter's filing gives the sum since the year's first day,
the second quarter's also that quarter alone, and a year's sum is filed again, corrected, a year on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.sources.tables import table

#: Days of a quarter's span, days of a year's span, days between spans that still join.
QUARTER_DAYS, YEAR_DAYS, GAP_DAYS = (80, 100), (350, 380), 7
YEARS_TESTED, LEAST_YEARS = 10, 5
ASKED = "1998-06-30"  # day of the figures known then


def _quarter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company (nation), y, k (quarter), cents and n of its orders; paid, owed, first: cents by kind."""
    day = F.col("o_orderdate").cast("date")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("company"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year(day).alias("y"), F.quarter(day).alias("k"), cents.alias("cents"), "o_orderstatus", "o_orderpriority")
    part = lambda test: F.sum(F.when(test, F.col("cents")).otherwise(0))
    return rows.join(who, "o_custkey").groupBy("company", "y", "k").agg(
        F.sum("cents").alias("cents"), F.count("*").alias("n"), part(F.col("o_orderstatus") == "F").alias("paid"), part(F.col("o_orderstatus") == "O").alias("owed"), part(F.col("o_orderpriority") < "3").alias("first"))


QUARTER_SUMS = """s AS (SELECT CAST(c_nationkey AS BIGINT) AS company, year(o_orderdate) AS y, quarter(o_orderdate) AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS n,
  sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS paid, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS owed,
  sum(CASE WHEN o_orderpriority < '3' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS "first" FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, concept, start (null: at the end), end, filed, form, value."""
    c = F.col
    begin = F.make_date("y", F.lit(1), F.lit(1))
    end = F.last_day(F.make_date("y", c("k") * 3, F.lit(1)))
    own = F.make_date("y", c("k") * 3 - 2, F.lit(1))
    last = c("k") == 4
    filed = F.date_add(end, F.when(last, 75).otherwise(40))
    form = F.when(last, "10-K").otherwise("10-Q")
    year = Window.partitionBy("company", "y").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)

    def fact(concept: str, start: Column, filed: Column, value: Column, form: Column = form, when: Column | None = None) -> Column:
        row = F.struct(F.lit(concept).alias("concept"), start.alias("start"), end.alias("end"), filed.alias("filed"), form.alias("form"), value.cast("long").alias("value"))
        return row if when is None else F.when(when, row)

    none = F.lit(None).cast("date")
    rows = _quarter_sums(spark, sf_dir).withColumn("so_far", F.sum("cents").over(year))
    made = F.array(
        fact("revenue", begin, filed, c("so_far")), fact("revenue", own, filed, c("cents"), when=c("k") == 2),
        fact("revenue", begin, F.date_add(end, 440), c("so_far") + 100_000, F.lit("10-K"), last),
        fact("shares_out", none, filed, c("n"), when=c("k") % 2 == 1), fact("shares_diluted", own, filed, c("n") * 2),
    )
    return rows.select("company", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select("company", "f.*")


FACTS = f"""{QUARTER_SUMS}, u AS (SELECT *, sum(cents) OVER (PARTITION BY company, y ORDER BY k) AS so_far, make_date(y, 1, 1) AS b, last_day(make_date(y, k * 3, 1)) AS e, make_date(y, k * 3 - 2, 1) AS own FROM s),
d AS (SELECT *, e + CAST(CASE WHEN k = 4 THEN 75 ELSE 40 END AS INTEGER) AS handed, CASE WHEN k = 4 THEN '10-K' ELSE '10-Q' END AS kind FROM u),
facts AS (SELECT company, 'revenue' AS concept, b AS "start", e AS "end", handed AS filed, kind AS form, CAST(so_far AS BIGINT) AS value FROM d UNION ALL SELECT company, 'revenue', own, e, handed, kind, CAST(cents AS BIGINT) FROM d WHERE k = 2
  UNION ALL SELECT company, 'revenue', b, e, e + 440, '10-K', CAST(so_far + 100000 AS BIGINT) FROM d WHERE k = 4 UNION ALL SELECT company, 'shares_out', NULL, e, handed, kind, n FROM d WHERE k % 2 = 1
  UNION ALL SELECT company, 'shares_diluted', own, e, handed, kind, n * 2 FROM d)"""


def picked(rows: DataFrame, concept: str, as_of: str | None = None, first: bool = False) -> DataFrame:
    """Each span's value by the last filing (the first, where asked) until as_of; ties to the smaller."""
    known = rows.where(F.col("concept") == concept)
    if as_of:
        known = known.where(F.col("filed") <= F.lit(as_of).cast("date"))
    value = F.min_by("value", F.struct("filed", "value")) if first else F.max_by("value", F.struct("filed", -F.col("value")))
    return known.groupBy("company", "start", "end").agg(value.alias("value"))


def quarters(rows: DataFrame, concept: str, as_of: str | None = None, first: bool = False) -> DataFrame:
    """company, start, end, value: quarters as filed, else the difference of two spans that start on
    one day and follow each other."""
    spans = picked(rows, concept, as_of, first).where(F.col("start").isNotNull())
    w = Window.partitionBy("company", "start").orderBy("end")
    steps = spans.withColumn("from", F.date_add(F.lag("end").over(w), 1)).withColumn("step", F.col("value") - F.lag("value").over(w))

    def quarter(start: Column) -> Column:
        return (F.datediff("end", start) + 1).between(*QUARTER_DAYS)

    made = F.array(
        F.when(quarter(F.col("start")), F.struct(F.lit(0).alias("rank"), F.col("start").alias("start"), F.col("value").alias("value"))),
        F.when(quarter(F.col("from")), F.struct(F.lit(1).alias("rank"), F.col("from").alias("start"), F.col("step").alias("value"))),
    )
    found = steps.select("company", "end", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("q"))
    return found.groupBy("company", "end").agg(F.min("q").alias("q")).select("company", "q.start", "end", "q.value")


def _picked_sql(concept: str, order: str = "DESC", as_of: str | None = None, name: str = "p") -> str:
    until = f" AND filed <= DATE '{as_of}'" if as_of else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, "start", "end" ORDER BY filed {order}, value) AS rn FROM facts WHERE concept = '{concept}'{until}) WHERE rn = 1)"""


QUARTERS = """g AS (SELECT company, "start", "end", value, lag("end") OVER w + 1 AS "from", value - lag(value) OVER w AS step FROM p WHERE "start" IS NOT NULL WINDOW w AS (PARTITION BY company, "start" ORDER BY "end")),
q0 AS (SELECT company, 0 AS r, "start", "end", value FROM g WHERE date_diff('day', "start", "end") + 1 BETWEEN 80 AND 100 UNION ALL SELECT company, 1, "from", "end", step FROM g WHERE date_diff('day', "from", "end") + 1 BETWEEN 80 AND 100),
q AS (SELECT company, "start", "end", value FROM (SELECT *, row_number() OVER (PARTITION BY company, "end" ORDER BY r, "start", value) AS rn FROM q0) WHERE rn = 1)"""


def latest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span of revenue by its last, its first, and its last filing known on a day."""
    rows = facts(spark, sf_dir)
    known = picked(rows, "revenue", ASKED).withColumnRenamed("value", "known")
    first = picked(rows, "revenue", first=True).withColumnRenamed("value", "first_filed")
    on = ["company", "start", "end"]
    return picked(rows, "revenue").join(first, on).join(known, on, "left").select("company", F.col("start").cast("string").alias("span_start"), F.col("end").cast("string").alias("span_end"), "value", "first_filed", F.col("known").cast("double").alias("known"))


LATEST_FILINGS = f"""WITH {FACTS}, {_picked_sql('revenue')}, {_picked_sql('revenue', 'ASC', None, 'f')}, {_picked_sql('revenue', 'DESC', ASKED, 'a')}
SELECT p.company, CAST(p."start" AS VARCHAR) AS span_start, CAST(p."end" AS VARCHAR) AS span_end, p.value, f.value AS first_filed, CAST(a.value AS DOUBLE) AS known FROM p JOIN f USING (company, "start", "end") LEFT JOIN a USING (company, "start", "end")"""


def filed_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of revenue, and the sum of four that follow each other without a gap."""
    w = Window.partitionBy("company").orderBy("end")
    joins = F.abs(F.datediff("start", F.lag("end").over(w)) - 1) <= GAP_DAYS
    q = quarters(facts(spark, sf_dir), "revenue").withColumn("joins", F.coalesce(joins, F.lit(False)))
    whole = (F.count("*").over(w.rowsBetween(-3, 0)) == 4) & F.min("joins").over(w.rowsBetween(-2, 0))
    return q.select("company", F.col("start").cast("string").alias("quarter_start"), F.col("end").cast("string").alias("quarter_end"), "value", F.when(whole, F.sum("value").over(w.rowsBetween(-3, 0))).cast("double").alias("twelve_months"))


FILED_QUARTERS = f"""WITH {FACTS}, {_picked_sql('revenue')}, {QUARTERS}, j AS (SELECT *, coalesce(abs(date_diff('day', lag("end") OVER w, "start") - 1) <= 7, false) AS joins FROM q WINDOW w AS (PARTITION BY company ORDER BY "end"))
SELECT company, CAST("start" AS VARCHAR) AS quarter_start, CAST("end" AS VARCHAR) AS quarter_end, CAST(value AS BIGINT) AS value,
  CASE WHEN count(*) OVER (w ROWS 3 PRECEDING) = 4 AND bool_and(joins) OVER (w ROWS 2 PRECEDING) THEN CAST(sum(value) OVER (w ROWS 3 PRECEDING) AS DOUBLE) END AS twelve_months FROM j WINDOW w AS (PARTITION BY company ORDER BY "end")"""


def shares_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares at each year's middle as then known: those outstanding, unless diluted ones are newer."""
    days = F.transform(F.sequence(F.lit(1995), F.lit(2002)), lambda y: F.make_date(y, F.lit(6), F.lit(30)))
    rows = facts(spark, sf_dir).where(F.col("concept").isin("shares_out", "shares_diluted"))
    each = rows.select("*", F.explode(days).alias("day")).where("filed <= day")
    span = F.datediff("end", "start") + 1
    usable = F.when(F.col("concept") == "shares_out", F.col("start").isNull()).otherwise(span.between(*QUARTER_DAYS))
    newest = F.struct("end", (F.col("concept") == "shares_out").alias("out"), "filed", -F.col("value"))
    best = each.where(usable).groupBy("company", "day").agg(F.max_by(F.struct("concept", "end", "value"), newest).alias("b"))
    return best.select("company", F.col("day").cast("string").alias("day"), F.col("b.concept").alias("kind"), F.col("b.end").cast("string").alias("at"), F.col("b.value").alias("shares"))


SHARES_KNOWN = f"""WITH {FACTS}, days AS (SELECT make_date(CAST(y AS INTEGER), 6, 30) AS day FROM range(1995, 2003) t(y)),
o AS (SELECT company, day, max("end") AS "end" FROM facts JOIN days ON filed <= day WHERE concept = 'shares_out' GROUP BY 1, 2), l AS (SELECT company, day, max("end") AS "end" FROM facts JOIN days ON filed <= day WHERE concept = 'shares_diluted' AND date_diff('day', "start", "end") + 1 BETWEEN 80 AND 100 GROUP BY 1, 2),
w AS (SELECT company, day, CASE WHEN l."end" IS NULL OR o."end" >= l."end" THEN 'shares_out' ELSE 'shares_diluted' END AS kind, CASE WHEN l."end" IS NULL OR o."end" >= l."end" THEN o."end" ELSE l."end" END AS newest FROM o FULL JOIN l USING (company, day))
SELECT w.company, CAST(day AS VARCHAR) AS day, kind, CAST(newest AS VARCHAR) AS "at", arg_max(value, filed) AS shares FROM w JOIN facts f ON f.company = w.company AND f.concept = kind AND f."end" = newest AND f.filed <= day GROUP BY 1, 2, 3, 4"""


def first_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each period's end the first filing whose newest span ends there."""
    docs = facts(spark, sf_dir).where(F.col("start").isNotNull()).groupBy("company", "filed", "form").agg(F.max("end").alias("end"))
    return docs.groupBy("company", "end").agg(F.min(F.struct("filed", "form")).alias("f"), F.count("*").alias("n")).select("company", F.col("end").cast("string").alias("period_end"), F.col("f.filed").cast("string").alias("filed"), "f.form", F.col("n").alias("n_filings"))


FIRST_FILINGS = f"""WITH {FACTS}, docs AS (SELECT company, filed, form, max("end") AS "end" FROM facts WHERE "start" IS NOT NULL GROUP BY 1, 2, 3)
SELECT company, CAST("end" AS VARCHAR) AS period_end, CAST(min(filed) AS VARCHAR) AS filed, arg_min(form, filed) AS form, count(*) AS n_filings FROM docs GROUP BY 1, "end" """


def yearly_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years' sums in order, and whether the last ten reach nine tenths of their mean (null: under five)."""
    span = F.datediff("end", "start") + 1
    years = picked(facts(spark, sf_dir), "revenue").where(span.between(*YEAR_DAYS))
    each = years.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("end", "value"))).alias("all"))  # a row a year
    last = F.slice(F.reverse("all"), 1, YEARS_TESTED)
    # whole numbers on both sides: 10 n v >= 9 sum
    total = F.aggregate(last, F.lit(0).cast("long"), lambda acc, x: acc + x["value"])
    passed = F.forall("last", lambda x: x["value"] * F.size("last") * 10 >= F.col("total") * 9)
    out = each.select("company", "all", last.alias("last"), total.alias("total"))
    return out.select("company", F.size("all").cast("long").alias("n_years"), F.element_at("all", -1)["value"].alias("latest"), F.when(F.size("last") >= LEAST_YEARS, passed).cast("string").alias("passed"))


YEARLY_TESTS = f"""WITH {FACTS}, {_picked_sql('revenue')}, a AS (SELECT company, "end", value, row_number() OVER (PARTITION BY company ORDER BY "end" DESC) AS back FROM p WHERE date_diff('day', "start", "end") + 1 BETWEEN 350 AND 380),
t AS (SELECT company, count(*) AS n, sum(value) AS total FROM a WHERE back <= 10 GROUP BY 1)
SELECT a.company, count(*) AS n_years, max(CASE WHEN back = 1 THEN value END) AS latest, CASE WHEN any_value(n) >= 5 THEN CAST(bool_and(value * n * 10 >= total * 9) FILTER (WHERE back <= 10) AS VARCHAR) END AS passed FROM a JOIN t USING (company) GROUP BY 1"""


def nine_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine signs of a year's health against the year before; null where a figure is missing."""
    c = F.col
    s = _quarter_sums(spark, sf_dir).groupBy("company", "y").agg(*(F.sum(x).alias(x) for x in ("cents", "n", "paid", "owed", "first")))
    w = Window.partitionBy("company").orderBy("y")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    own = s.select(
        "company", "y", c("cents").alias("revenue"), (c("paid") - c("owed")).alias("income"), (c("first") - c("owed")).alias("cash"), c("first").alias("profit"),
        F.sum("cents").over(run).alias("assets"), F.sum("owed").over(run).alias("debt"), c("paid").alias("current"), F.when(c("owed") > 0, c("owed")).alias("due"), c("n").alias("shares"))

    def before(x: str) -> Column:
        return F.when(F.lag("y").over(w) == c("y") - 1, F.lag(x).over(w))

    names = ("revenue", "income", "profit", "assets", "debt", "current", "due", "shares")
    both = own.select("*", *(before(x).alias(f"{x}_0") for x in names))

    def ratio(x: str, y: str, then: str = "") -> Column:
        return c(x + then) / F.when(c(y + then) != 0, c(y + then))

    def up(x: str, y: str) -> Column:
        return ratio(x, y) - ratio(x, y, "_0") > 0

    tests = [ratio("income", "assets") > 0, c("cash") > 0, up("income", "assets"), c("cash") > c("income"), ratio("debt", "assets") - ratio("debt", "assets", "_0") < 0, up("current", "due"), c("shares") <= c("shares_0"), up("profit", "revenue"), up("revenue", "assets")]
    passed = sum((F.coalesce(t.cast("long"), F.lit(0)) for t in tests), F.lit(0).cast("long"))
    known = sum((t.isNotNull().cast("long") for t in tests), F.lit(0).cast("long"))
    marks = F.concat(*(F.coalesce(F.when(t, "y").when(~t, "n"), F.lit("-")) for t in tests))
    return both.select("company", c("y").cast("long").alias("year"), marks.alias("marks"), passed.alias("passed"), known.alias("known"))


_TESTS = [
    "income / nullif(assets, 0) > 0", "cash > 0", "income / nullif(assets, 0) - income_0 / nullif(assets_0, 0) > 0", "cash > income", "debt / nullif(assets, 0) - debt_0 / nullif(assets_0, 0) < 0",
    "current / nullif(due, 0) - current_0 / nullif(due_0, 0) > 0", "shares <= shares_0", "profit / nullif(revenue, 0) - profit_0 / nullif(revenue_0, 0) > 0", "revenue / nullif(assets, 0) - revenue_0 / nullif(assets_0, 0) > 0",
]
NINE_TESTS = f"""WITH {QUARTER_SUMS}, t AS (SELECT company, y, sum(cents)::DOUBLE AS cents, sum(n)::DOUBLE AS n, sum(paid)::DOUBLE AS paid, sum(owed)::DOUBLE AS owed, sum("first")::DOUBLE AS fst FROM s GROUP BY 1, 2),
o AS (SELECT company, y, cents AS revenue, paid - owed AS income, fst - owed AS cash, fst AS profit, sum(cents) OVER w AS assets, sum(owed) OVER w AS debt, paid AS current, CASE WHEN owed > 0 THEN owed END AS due, n AS shares FROM t WINDOW w AS (PARTITION BY company ORDER BY y)),
b AS (SELECT o.*, {', '.join(f'z.{x} AS {x}_0' for x in ('revenue', 'income', 'profit', 'assets', 'debt', 'current', 'due', 'shares'))} FROM o LEFT JOIN o z ON z.company = o.company AND z.y = o.y - 1),
k AS (SELECT company, y, [{', '.join(_TESTS)}] AS m FROM b)
SELECT company, y AS year, array_to_string(list_transform(m, lambda x: CASE WHEN x THEN 'y' WHEN NOT x THEN 'n' ELSE '-' END), '') AS marks, len(list_filter(m, lambda x: x)) AS passed, len(list_filter(m, lambda x: x IS NOT NULL)) AS known FROM k"""

QUERIES = {"latest_filings": latest_filings, "filed_quarters": filed_quarters, "shares_known": shares_known, "first_filings": first_filings, "yearly_tests": yearly_tests, "nine_tests": nine_tests}
SQL = {"latest_filings": LATEST_FILINGS, "filed_quarters": FILED_QUARTERS, "shares_known": SHARES_KNOWN, "first_filings": FIRST_FILINGS, "yearly_tests": YEARLY_TESTS, "nine_tests": NINE_TESTS}
