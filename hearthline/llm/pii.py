"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: wide forms of addresses, numbers and
names of hosts. Boosted trees score each candidate by its format (length, digits, separators,
checks) and its context (the characters beside it and words before it). Candidates that pass the
exact base rules are taken as they are; of the others those are taken whose score reaches the
threshold of their kind, which is calibrated on held-out candidates to a precision.

The trees learn from base spans (right) and from wide candidates that fail a check or that
come from corrupted copies of base spans (wrong), of all documents: examples with equal features are one,
weighted by their number. All of it is DataFrame functions and the ML library's JVM trees.

Rows: a null text is empty. Columns of the input other than the text are kept.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.spans import listed, matches, whole_row
from hearthline.storage import written

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.99

JOIN = "\x01"  # stands for a separator inside a run, so that patterns need no loops over groups


def _runs(text: Column, separators: str, beside: str) -> Column:
    """text with the separators between two characters of `beside` as JOIN; same length."""
    return F.regexp_replace(F.translate(text, JOIN, "\x02"), rf"(?<=[{beside}])[{separators}](?=[{beside}])", JOIN)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    value = lambda c, k: c.cast("int") * F.when(k % 2 == 0, 1).otherwise(2)
    odd = F.transform(F.split(F.reverse(digits), ""), lambda c, k: value(c, k) - F.when(value(c, k) > 9, 9).otherwise(0))
    return F.aggregate(odd, F.lit(0), lambda a, b: a + b) % 10 == 0


def _spans(found: Column, rank: int, base: Column | bool) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base")))


def base_spans(text: Column) -> Column:
    """array<struct<rank, start, end, base>> of the exact rules, by kind and then start."""
    label = "A-Za-z0-9-"
    dotted = _runs(text, ".", label)
    email = matches(dotted, rf"(?:(?<![A-Za-z0-9._%+{JOIN}-])|\G)[A-Za-z0-9._%+{JOIN}-]+@[{label}]++{JOIN}[{label}{JOIN}]++")
    ip = matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    part = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255
    ip = F.filter(ip, lambda x: F.forall(F.split(x["value"], r"\."), part))
    card = matches(_runs(text, r"\x20-", "0-9"), rf"[0-9][0-9{JOIN}]+")
    card = F.filter(card, lambda x: F.length(_digits(x["value"])).between(13, 19) & luhn(_digits(x["value"])))
    phone = matches(text, r"\+[0-9][\x20().0-9-]+[0-9]")
    phone = F.filter(phone, lambda x: F.length(_digits(x["value"])).between(9, 15))
    return F.concat(*(_spans(found, rank, True) for rank, found in enumerate([email, ip, card, phone])))


#: Wide forms, by kind: what a person may write in place of the base form.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?[a-z0-9-]{1,63}\x20?(?:\.|[(\[{<]\x20?dot\x20?[)\]}>])\x20?[a-z]{2,24}",
    "card": r"(?<![0-9])[0-9]{4}([\x20./_-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}


def wide_spans(text: Column) -> Column:
    return F.concat(*(_spans(matches(text, WIDE[k]), KINDS.index(k), False) for k in WIDE))


FEATURES = ["kind", "n", "n_digits", "n_letters", "n_seps", "has_plus", "has_at", "checks", "beside_word", "cue", "repeats"]
CUE = r"(?i)(mail|@|contact|phone|tel|call|mobile|card|visa|payment|ip|host|address)"


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each proposed span, of documents that have any, with its features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.concat(base_spans(text), F.when(text.rlike(r"[0-9]{3}|(?i:\Wat\W)"), wide_spans(text)).otherwise(F.expr("cast(array() as array<struct<rank:int,start:int,end:int,base:boolean>>)")))
    rows = docs.select("doc_id", text.alias("text"), F.crc32(text).alias("tag"), spans.alias("spans")).where(F.size("spans") > 0)
    rows = rows.select("doc_id", "tag", "text", F.explode("spans").alias("s")).select("doc_id", "tag", "s.*", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"), F.expr("substring(text, greatest(s.start - 24, 0) + 1, s.start - greatest(s.start - 24, 0))").alias("before"), F.expr("substring(text, s.end + 1, 1)").alias("after"))
    return with_features(rows)


def with_features(rows: DataFrame) -> DataFrame:
    digits = _digits(F.col("value"))
    parts = F.split("value", r"[^0-9]+")
    checks = (
        F.when(F.col("rank") == 0, F.col("value").rlike(r"(?i)^[a-z0-9._%+-]+(@|\W*\bat\b\W*)[a-z0-9-]+(\.|\W*\bdot\b\W*)[a-z]"))
        .when(F.col("rank") == 1, F.size(parts) == 4)
        .when(F.col("rank") == 2, F.length(digits).between(13, 19) & luhn(digits))
        .otherwise(F.length(digits).between(9, 15) & ~digits.rlike("^0*$"))
    )
    return rows.withColumns({
        "kind": F.col("rank").cast("double"),
        "n": F.length("value").cast("double"),
        "n_digits": F.length(digits).cast("double"),
        "n_letters": F.length(F.regexp_replace("value", "[^A-Za-z]", "")).cast("double"),
        "n_seps": F.length(F.regexp_replace("value", "[A-Za-z0-9]", "")).cast("double"),
        "has_plus": F.col("value").startswith("+").cast("double"),
        "has_at": F.col("value").contains("@").cast("double"),
        "checks": F.coalesce(checks.cast("double"), F.lit(0.0)),
        "beside_word": (F.col("before").rlike(r"[A-Za-z0-9]$") | F.col("after").rlike("[A-Za-z0-9]")).cast("double"),
        "cue": F.col("before").rlike(CUE).cast("double"),
        "repeats": digits.rlike(r"([0-9])\1{6}").cast("double"),
    })


def _spoiled(rows: DataFrame) -> DataFrame:
    """Wrong examples made of right ones: the last digit of numbers changed, so that checks
    fail, and addresses without their host's end."""
    last = F.expr("substring(value, length(value), 1)")
    other = F.when(last.rlike("[0-9]"), ((last.cast("int") + 1) % 10).cast("string")).otherwise(F.lit(""))
    value = F.when(F.col("rank") == 0, F.regexp_replace("value", r"\..*$", "")).when(F.col("rank") == 3, F.expr("substring(value, 2, greatest(length(value) - 8, 0))")).otherwise(F.concat(F.expr("substring(value, 1, length(value) - 1)"), other))
    return with_features(rows.select("doc_id", "tag", "rank", "start", "end", "base", value.alias("value"), "before", "after"))


def train(found: DataFrame) -> tuple[GBTClassificationModel | None, list[float]]:
    """found: candidates. The model, and the least score for each kind (2.0: none)."""
    right = found.where("base")
    wrong = _spoiled(right).where("checks = 0 or rank in (0, 1, 3)")
    strange = found.where("not base and checks = 0")
    held = F.expr("pmod(xxhash64(doc_id, 7), 4) = 0")
    fields = ["rank", held.alias("held"), (~held | F.col("doc_id").isNull()).alias("learn"), *FEATURES]
    rows = right.select(*fields, F.lit(1.0).alias("label")).union(wrong.select(*fields, F.lit(0.0).alias("label"))).union(strange.select(*fields, F.lit(0.0).alias("label")))
    rows = rows.groupBy("rank", "held", "learn", "label", *FEATURES).agg(F.count("*").cast("double").alias("weight"))
    rows = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("rank", "held", "learn", "label", "weight", "features"), "examples")
    kinds = rows.agg(F.countDistinct("label")).first()[0]
    if kinds < 2:
        return None, [2.0] * len(KINDS)
    learn = rows.where("learn")
    if learn.agg(F.countDistinct("label")).first()[0] < 2:
        learn = rows
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=8, maxDepth=4, stepSize=0.3, seed=7).fit(learn)
    scored = model.transform(rows.where("held")).select("rank", "label", "weight", F.round(vector_to_array("probability")[1], 2).alias("score"))
    table = scored.groupBy("rank", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("n")).collect()
    least = []
    for rank in range(len(KINDS)):
        best, right_n, n = 2.0, 0.0, 0
        for r in sorted((r for r in table if r["rank"] == rank), key=lambda r: -r["score"]):
            right_n, n = right_n + r["right"], n + r["n"]
            if right_n / n >= PRECISION:
                best = r["score"]
        least.append(max(best, 0.5))
    return model, least


def select(found: DataFrame, model: GBTClassificationModel | None, least: list[float]) -> DataFrame:
    """The candidates to redact: base ones, and others whose score is enough and that touch no
    base span (checked where spans are gathered)."""
    if model is None:
        return found.where("base").withColumn("score", F.lit(1.0))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 2))
    need = F.element_at(F.array(*map(F.lit, least)), F.col("rank") + 1)
    return scored.where(F.col("base") | (F.col("score") >= need) & (F.col("checks") == 1))


def find_pii(docs: DataFrame) -> DataFrame:
    """Each row of docs without its text, with spans array<struct<rank, start, end, base, score>>."""
    found = written(candidates(docs), "candidates")
    model, least = train(found)
    kept = select(found, model, least)
    spans = kept.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("rank", "start", "end", "base", "score"))).alias("spans"))
    apart = F.filter("spans", lambda x: x["base"] | ~F.exists("spans", lambda y: y["base"] & (y["start"] < x["end"]) & (x["start"] < y["end"])))
    spans = spans.select(F.col("doc_id").alias("id"), "tag", apart.alias("spans"))
    docs = docs.drop("spans")
    keys = docs.select(whole_row(docs.drop("text")), F.col("doc_id").alias("own"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    out = keys.join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("crc") == F.col("tag")), "left")
    return out.select("row.*", F.coalesce("spans", F.expr("cast(array() as array<struct<rank:int,start:int,end:int,base:boolean,score:double>>)")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: listed(name(x), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter(base, lambda x: x["rank"] == k)).cast("long")
    return found.select("doc_id", *(of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
