"""Listings pasted in bulk, and whose they are.

A paste is rows of lines. A listing begins at a line that a price line follows, and a running count of
such lines gives every line its listing, so a paste of any length is split as a stream. Names are
matched without comparing every text with every name: a text's stretches of letters meet the names as equal keys.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.functions import listings
from hearthline.operators import blocks
from hearthline.sources.tables import complexes, table, trades
from hearthline.storage import LINES, ship

#: Words of a price line, of a specification, of a checked date; the line that fences a memo.
DEALS, SPEC, CHECKED, FENCE = "매매|전세|월세", "㎡|평|층", "확인", '"'
SPEC_LINES, MEMO_LENGTH = 3, 300
DATE = r"(20\d\d)\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})"
CHECKED_DATE = CHECKED + r"[^\d]{0,8}(20\d\d|\d\d)\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})"
AGO = r"(\d{1,3})\s*(일|주|개월)\s*전"
AGO_DAYS = {"일": 1, "주": 7, "개월": 30}
MARKS = blocks.Marks(blocks.regex(rf"\A\s*(?:{DEALS})\s*[\d억]"), SPEC, (blocks.regex(CHECKED_DATE), blocks.regex(DATE), blocks.regex(AGO)), AGO_DAYS, FENCE, SPEC_LINES, MEMO_LENGTH)
BUILDING = r"\s*(?:\d{1,4}|[가-힣])\s*동\s*$"
#: The least letters of a name inside a text, of a shared beginning; candidates that are shown.
INSIDE, SHARED, SHOWN = 3, 4, 6
MERGED = 12  # ids that a beginning keeps: more than are shown


def split(lines: DataFrame, today: str) -> DataFrame:
    """paste, block (from 1), text (name, price and specification lines), confirmed_on, memo. lines: paste, no, line.

    A memo stands between two fence lines; one that isn't closed is none. The date is one that is called checked,
    else any, else so many days ago; a date to come is none."""
    c = F.col
    ship(lines.sparkSession, LINES)
    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    solid = lines.where(c("line").rlike(r"[^ \r\t]")).select("paste", c("no").cast("long").alias("no"), "line")
    # one order of a paste serves all that is counted in it
    placed = solid.withColumn("row", F.row_number().over(Window.partitionBy("paste").orderBy("no")).cast("long"))
    days = (date.fromisoformat(today) - date(1970, 1, 1)).days
    per = placed.mapInArrow(blocks.splitter(MARKS, days), f"paste {kind['paste']}, block long, name string, price string, spec string, confirmed_on date, memo string")
    return per.select("paste", "block", F.concat_ws("\n", "name", "price", "spec").alias("text"), "confirmed_on", "memo")


# ---- names


def head_key(text: Column) -> Column:
    """The first line's name as names are compared, without its building."""
    line = F.trim(F.get(F.split(F.trim(text), r"\r?\n"), F.lit(0)))
    return listings.name_key(F.regexp_replace(line, BUILDING, ""))


def candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, complex_id, matched (letters), exact: the names that a text's first line may mean. texts: id, key; names:
    complex_id, key. Names that stand in the text come before any other, and only without one those that
    begin alike; the most letters first, SHOWN of them.

    Every stretch of a text that is as long as some name is looked up as a key, so what meets is a match; of names
    that begin alike the longest beginnings are looked up, each with the few ids that could be shown."""
    c = F.col
    lengths = F.broadcast(names.where(F.length("key") >= INSIDE).agg(F.collect_set(F.length("key")).alias("lengths")))  # one row of different lengths
    place = F.explode(F.flatten(F.transform("lengths", lambda n: F.when(F.length("key") >= n, F.transform(F.sequence(F.lit(1), F.length("key") - n + 1), lambda i: F.substring(c("key"), i, n))).otherwise(F.array().cast("array<string>")))))
    parts = texts.crossJoin(lengths).select("id", place.alias("key")).distinct()
    inside = parts.join(names, "key").select("id", "complex_id", F.length("key").alias("matched"), F.lit(True).alias("exact"))
    rank = Window.partitionBy("id").orderBy(F.desc("matched"), "complex_id")
    shown = inside.withColumn("place", F.row_number().over(rank)).where(c("place") <= SHOWN)
    begins = lambda key: F.explode(F.when(F.length(key) >= SHARED, F.transform(F.sequence(F.lit(SHARED), F.length(key)), lambda n: F.substring(c(key), F.lit(1), n))))
    starts = names.where(F.length("key") >= SHARED).select("complex_id", begins("key").alias("start"))
    few = starts.withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("complex_id"))).where(c("k") <= MERGED).groupBy("start").agg(F.collect_list("complex_id").alias("ids"))
    rest = texts.join(inside.select("id").distinct(), "id", "left_anti").select("id", begins("key").alias("start"))
    alike = rest.join(few, "start").select("id", F.length("start").alias("matched"), F.explode("ids").alias("complex_id")).groupBy("id", "complex_id").agg(F.max("matched").alias("matched"))
    return shown.unionByName(alike.withColumn("exact", F.lit(False)).withColumn("place", F.row_number().over(rank)).where(c("place") <= SHOWN))


def resolved(found: DataFrame, texts: DataFrame, buildings: DataFrame) -> DataFrame:
    """id, candidates (ids in order), matched, exact, complex_id. One of the longest names that stand in the text is
    the listing's, if it is alone, or alone has the listing's building. texts: id, building; buildings: complex_id, building."""
    c = F.col
    longest = found.withColumn("best", F.max(F.when(c("exact"), c("matched"))).over(Window.partitionBy("id")))
    known = longest.join(texts.select("id", "building"), "id").join(buildings.select("complex_id", "building", F.lit(True).alias("has")), ["complex_id", "building"], "left")
    top, has = c("exact") & (c("matched") == c("best")), F.coalesce("has", F.lit(False))
    per = known.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("place", "complex_id"))).alias("list"), F.max("matched").alias("matched"), F.bool_or("exact").alias("exact"), F.count_if(top).alias("n_top"),
        F.count_if(top & has).alias("n_has"), F.max(F.when(top, c("complex_id"))).alias("alone"), F.max(F.when(top & has, c("complex_id"))).alias("by_building"),
    )
    chosen = F.when(c("n_top") == 1, c("alone")).when(c("n_has") == 1, c("by_building"))
    return per.select("id", F.array_join(F.transform("list", lambda x: x["complex_id"].cast("string")), ",").alias("candidates"), F.col("matched").cast("long").alias("matched"), "exact", chosen.alias("complex_id"))


# ---- queries

SUFFIXES = 40


def names_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complex_id, name, key: a part's name with a number, so that names repeat."""
    rows = complexes(spark, sf_dir).select("complex_id", F.concat("name", F.lit(" "), (F.col("complex_id") % SUFFIXES).cast("string")).alias("name"))
    return rows.withColumn("key", listings.name_key(F.col("name")))


def matched_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of each complex that had trades, in its building of the highest number, written as people do (every fifth
    name misspelt), and which complexes it may be."""
    own = trades(spark, sf_dir).groupBy("complex_id").agg(F.max("dong").alias("building"))
    names = names_of(spark, sf_dir)
    wrong = F.concat(F.substring("name", 1, 6), F.lit("x"), F.expr("substring(name, 7)"))
    written_as = F.when(F.col("complex_id") % 5 == 0, wrong).otherwise(F.initcap("name"))
    texts = own.join(names, "complex_id").select(F.col("complex_id").alias("id"), F.concat(written_as, F.lit(" 아파트 "), "building", F.lit("동\n매매 3억")).alias("text"), "building")
    keyed = texts.select("id", head_key(F.col("text")).alias("key"), "building")
    buildings = trades(spark, sf_dir).select("complex_id", F.col("dong").alias("building")).distinct()
    return resolved(candidates(keyed.select("id", "key"), names.select("complex_id", "key")), keyed, buildings)


MATCHED_LISTINGS = f"""WITH nm AS MATERIALIZED (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % {SUFFIXES}) AS name, replace(lower(p_name || ' ' || (p_partkey % {SUFFIXES})), ' ', '') AS key FROM part),
ow AS (SELECT l_partkey AS id, max(l_suppkey) AS building FROM lineitem GROUP BY 1),
tx AS MATERIALIZED (SELECT id, building, CASE WHEN id % 5 = 0 THEN replace(lower(name[1:6] || 'x' || name[7:]), ' ', '') ELSE key END AS key FROM ow JOIN nm USING (id)),
ins AS MATERIALIZED (SELECT tx.id, nm.id AS complex_id, length(nm.key) AS matched, true AS exact FROM tx JOIN nm ON contains(tx.key, nm.key) WHERE length(nm.key) >= {INSIDE}),
alk AS (SELECT id, complex_id, matched, false AS exact FROM (SELECT tx.id, nm.id AS complex_id, coalesce(list_max(list_filter(range({SHARED}, least(length(tx.key), length(nm.key)) + 1), lambda n: tx.key[1:n] = nm.key[1:n])), 0) AS matched FROM tx JOIN nm ON tx.key[1:{SHARED}] = nm.key[1:{SHARED}] WHERE tx.id NOT IN (SELECT id FROM ins)) WHERE matched >= {SHARED}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY matched DESC, complex_id) AS place FROM (SELECT * FROM ins UNION ALL SELECT * FROM alk)) WHERE place <= {SHOWN}),
bd AS (SELECT DISTINCT l_partkey AS complex_id, l_suppkey AS building FROM lineitem),
k AS (SELECT f.*, bd.building IS NOT NULL AS has, exact AND matched = max(matched) OVER (PARTITION BY f.id) AS top FROM f JOIN tx USING (id) LEFT JOIN bd ON bd.complex_id = f.complex_id AND bd.building = tx.building)
SELECT id, string_agg(CAST(complex_id AS VARCHAR), ',' ORDER BY place) AS candidates, CAST(max(matched) AS BIGINT) AS matched, bool_or(exact) AS exact,
  CASE WHEN count(*) FILTER (WHERE top) = 1 THEN max(complex_id) FILTER (WHERE top) WHEN count(*) FILTER (WHERE top AND has) = 1 THEN max(complex_id) FILTER (WHERE top AND has) END AS complex_id FROM k GROUP BY 1"""


def pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paste, no, line: each order as a list that someone copied, its lines as listings of five layouts
    (with a memo, a date, advertising with numbers, blank lines, an open fence)."""
    c = F.col
    man = (F.floor(c("l_extendedprice")) % 9000 + 1000).cast("long")
    head = F.concat(F.lit("한빛"), (c("l_partkey") % 50).cast("string"), F.lit(" "), (c("l_suppkey") % 900 + 1).cast("string"), F.lit("동"))
    price = F.concat(F.lit("매매 "), (F.floor(c("l_extendedprice") / 10000) + 1).cast("string"), F.lit("억 "), F.floor(man / 1000).cast("string"), F.lit(","), F.lpad((man % 1000).cast("string"), 3, "0"))
    spec = F.concat(F.lit("아파트"), (c("l_quantity").cast("long") + 90).cast("string"), F.lit("㎡ (전용"), (c("l_quantity").cast("long") + 20).cast("string"), F.lit(")"), c("l_linenumber").cast("string"), F.lit("/25층남향"))
    memo = F.concat(F.lit("급매 피"), c("l_partkey").cast("string"), F.lit(" 확정"))
    day = F.concat(F.lit("집주인확인매물 "), F.date_format(F.add_months(F.col("l_shipdate").cast("date"), 120), "yyyy.MM.dd"))
    # the parts of a listing are columns of their own: one method with the texts of all layouts would be too long to be compiled
    texts = {"공유하기", "알림관심매물", "임대분양가27,000 홍보문구", FENCE, ""}
    layouts = [
        ["head", "price", "spec"], ["head", "", "price", "spec", FENCE, "memo", FENCE, "date"], ["공유하기", "head", "price", "알림관심매물", "spec", "date"],
        ["head", "price", "spec", "임대분양가27,000 홍보문구", FENCE, FENCE, "memo", FENCE], ["head", "price", "spec", FENCE, "memo", ""],
    ]
    kind = (c("l_partkey") + c("l_linenumber")) % len(layouts)
    holds = lambda part: kind.isin([k for k, layout in enumerate(layouts) if part in layout])
    parts = {"head": head, "price": price, "spec": spec, "memo": F.when(holds("memo"), memo), "date": F.when(holds("date"), day), "kind": kind}
    chosen = F.coalesce(*(F.when(c("kind") == k, F.array(*(F.lit(x) if x in texts else c(x) for x in layout))) for k, layout in enumerate(layouts)))
    length = F.coalesce(*(F.when(kind == k, len(layout)) for k, layout in enumerate(layouts)))
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "lineitem").withColumn("before", F.coalesce(F.sum(length).over(before), F.lit(0)))
    return rows.select("l_orderkey", "before", *(x.alias(name) for name, x in parts.items())).select(c("l_orderkey").alias("paste"), "before", F.posexplode(chosen).alias("o", "line")).select("paste", (c("before") + c("o") + 1).alias("no"), "line")


def pasted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's list split into listings, and each listing read."""
    c = F.col
    found = listings.with_readings(split(pastes(spark, sf_dir), "2020-01-01"), c("text"), "paste", "block", "confirmed_on", "memo")
    return found.select(
        "paste", "block", "price", c("area.exclusive").alias("exclusive"), c("area.supply").alias("supply"), c("floor.floor").alias("floor"), c("floor.top").alias("top"),
        listings.building(c("laid"), True).alias("building"), listings.facing(c("laid"), True).alias("facing"), c("confirmed_on").cast("string").alias("confirmed_on"), "memo",
    )


PASTED_LISTINGS = """WITH l AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 9000 + 1000 AS man, (l_partkey + l_linenumber) % 5 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS block FROM lineitem)
SELECT l_orderkey AS paste, block, CAST(floor(l_extendedprice / 10000) + 1 AS BIGINT) * 10000 + man AS price, CAST(CAST(l_quantity AS BIGINT) + 20 AS DOUBLE) AS exclusive, CAST(CAST(l_quantity AS BIGINT) + 90 AS DOUBLE) AS supply, CAST(l_linenumber AS BIGINT) AS floor, CAST(25 AS BIGINT) AS top,
  CAST(l_suppkey % 900 + 1 AS VARCHAR) AS building, '남향' AS facing, CASE WHEN kind IN (1, 2) THEN strftime(CAST(l_shipdate AS DATE) + INTERVAL 10 YEAR, '%Y-%m-%d') END AS confirmed_on, CASE WHEN kind IN (1, 3) THEN '급매 피' || l_partkey || ' 확정' END AS memo FROM l"""

QUERIES = {f.__name__: f for f in (matched_listings, pasted_listings)}
SQL = {"matched_listings": MATCHED_LISTINGS, "pasted_listings": PASTED_LISTINGS}
