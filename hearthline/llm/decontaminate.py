"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and
an exact check. DataFrame functions only.

Words are runs of letters and digits, in lower case. A window of a document is as long as some
benchmark item; a document shorter than the item is one window. Windows are laid by a join on
shared shingles (five words; all words of a shorter item): at every start, also at the edges, from
which a window holds as many places of an item's shingles as the threshold asks for. A window with
fewer cannot be similar. Windows and items get 64-bit SimHashes of their words. Fingerprints are cut into
``radius + 1`` blocks; two within the radius agree in one block at least, so a join by item,
block and value finds all of them; a window is joined with the items that it was laid for only, as
it is similar to no other. For these the similarity of the two bags of shingles, sum of least
counts over sum of greatest counts, decides.

Rows: a null text has no words; an item without words matches nothing. A null doc_id is a
document like any other in the result. Rows that repeat a doc_id give one result. A repeated
item_id gives its best similarity; of equally similar windows the first counts. Other columns,
whatever their names, play no part and are kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.spans import bound, unused
from hearthline.storage import written

SHINGLE = 5
RADIUS = 20
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000  # of item shingles or item blocks, tens of bytes each
LANES = 16
LANE_WORDS = 32_767  # what a lane can count


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order; none if there are fewer words."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(size), x, *(F.get(w, i + k) for k in range(1, size))))


def bag(w: Column) -> Column:
    """The shingles that similarity counts: of five words, or the whole of fewer words."""
    short = F.array(F.xxhash64(F.lit(0), F.array_join(w, " ")))
    return F.when(F.size(w) >= SHINGLE, shingles(w, SHINGLE)).otherwise(short)


def simhash(w: Column) -> Column:
    """64 bits: bit p is set if more than half of the words' hashes have it.

    The counts of four bits at a time are added up in 16-bit lanes of one number, for the first
    32,767 words; further words are counted for each bit."""
    mask = 0x0001000100010001
    hashes = F.transform(F.slice(w, 1, LANE_WORDS), lambda x: F.xxhash64(x))
    further = F.transform(F.slice(w, LANE_WORDS + 1, F.greatest(F.size(w) - LANE_WORDS, F.lit(0))), lambda x: F.xxhash64(x))
    lanes = [_lane(hashes, j, mask) for j in range(LANES)]
    out = F.lit(0).cast("long")
    for j, lane in enumerate(lanes):
        for part in range(4):
            p = LANES * part + j
            count = F.shiftrightunsigned(lane, LANES * part).bitwiseAND(F.lit(0xFFFF).cast("long"))
            count = count + F.when(F.size(w) > LANE_WORDS, _ones(further, p)).otherwise(F.lit(0).cast("long"))
            out = out.bitwiseOR(F.when(count * 2 > F.size(w), F.shiftleft(F.lit(1).cast("long"), p)).otherwise(F.lit(0).cast("long")))
    return out


def _lane(hashes: Column, j: int, mask: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask)))


def _ones(hashes: Column, p: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, p).bitwiseAND(F.lit(1).cast("long")))


def blocks(fingerprint: Column, radius: int) -> Column:
    """array<struct<block, value>>: radius + 1 runs of bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def similarity(a: Column, b: Column) -> Column:
    """Of two bags. Distinct shingles are intersected as sets; only those that repeat in both are
    counted one by one."""
    count = lambda bag_, x: F.size(F.filter(bag_, lambda y: y == x))
    again = lambda bag_: bound(F.array_sort(bag_), lambda s: F.array_distinct(F.filter(F.transform(s, lambda x, i: F.when(x == F.get(s, i - 1), x)), lambda x: x.isNotNull())))
    more = F.aggregate(F.array_intersect(again(a), again(b)), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)) - 1)
    return bound(F.size(F.array_intersect(a, b)) + more, lambda common: common / (F.size(a) + F.size(b) - common))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start, n, words: the windows that hold enough shingles of an item of n
    words to be similar to it. A document shorter than the item is one window.

    items: item_id, words, n."""
    text = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("words"))
    hits = None
    for size in [r[0] for r in items.select(F.least("n", F.lit(SHINGLE))).distinct().collect()]:  # 5, or 1 to 4 for short items
        own = items.where(F.least("n", F.lit(SHINGLE)) == size)
        marks = own.select("item_id", "n", F.explode(shingles(F.col("words"), size)).alias("h")).distinct()
        found = text.select("doc_id", "key", F.size("words").alias("total"), F.posexplode(shingles(F.col("words"), size)).alias("pos", "h"))
        found = found.join(_bounded(written(marks, "marks")), "h").select("doc_id", "key", "total", "item_id", "n", "pos", F.lit(size).alias("size"))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n"), words(F.col("text")).alias("words")).where("false")
    # the key keeps rows that repeat a doc_id apart
    hits = hits.groupBy("doc_id", "key", "total", "item_id", "n", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    held = hits.withColumn("span", F.expr("least(n, total) - size + 1"))  # shingles of a window
    # of two bags of a and b shingles that share c, c / (a + b - c) >= threshold
    held = held.withColumn("need", F.ceil(F.lit(threshold) * (F.col("n") - F.col("size") + 1 + F.col("span")) / (1 + threshold) - 1e-9).cast("int"))
    held = held.withColumn("need", F.greatest("need", F.lit(1))).where("size(at) >= need")
    # windows that hold the need shared places from at[i] on start from at[i + need - 1] - span + 1 to at[i]
    runs = F.expr("filter(transform(slice(at, 1, size(at) - need + 1), (x, i) -> struct(greatest(at[i + need - 1] - span + 1, 0) AS low, least(x, greatest(total - n, 0)) AS high)), r -> r.low <= r.high)")
    starts = held.select("doc_id", "key", "item_id", "n", F.explode(runs).alias("r")).select("doc_id", "key", "item_id", "n", F.explode(F.sequence("r.low", "r.high")).alias("start"))
    starts = starts.groupBy("doc_id", "key").agg(F.collect_set(F.struct("item_id", "n", "start")).alias("laid"))
    starts = written(starts, "starts").withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    few = (starts.agg(F.sum(F.size("laid"))).first()[0] or 0) <= BROADCAST_ROWS
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    laid = keyed.join(F.broadcast(starts) if few else starts, F.col("key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    laid = laid.select("doc_id", words(F.col("text")).alias("words"), "laid").select("doc_id", "words", F.explode("laid").alias("w"))
    return laid.select("doc_id", "w.item_id", "w.start", "w.n", F.expr("slice(words, w.start + 1, w.n)").alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: for each document and item that it
    holds, the most similar window (the first of several)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    items = written(items.withColumn("fp", simhash(F.col("words"))).withColumn("bag", bag(F.col("words"))), "items")
    laid = written(windows(docs, items, threshold), "laid")
    laid = laid.withColumn("fp", simhash(F.col("words"))).withColumn("bag", bag(F.col("words"))).withColumn("held", F.size("words")).drop("words")
    keys = items.select("item_id", F.col("fp").alias("item_fp"), F.col("bag").alias("item_bag"), F.explode(blocks(F.col("fp"), radius)).alias("b")).select("item_id", "item_fp", "item_bag", "b.*")
    keys = _bounded(written(keys, "keys"))
    near = laid.select("doc_id", "item_id", "start", "held", "fp", "bag", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("doc_id", "item_id", "start", "held", "fp", "bag", "b.*")
    pairs = near.join(keys, ["item_id", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # a pair can agree in several blocks; it is compared in the first of them
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(radius)
    for k, cut in reversed(list(enumerate(_masks(radius)))):
        first = F.when(apart.bitwiseAND(F.lit(cut)) == 0, F.lit(k)).otherwise(first)
    pairs = pairs.where(F.col("block") == first)
    scored = pairs.select("doc_id", "item_id", "start", F.col("held").alias("n"), similarity(F.col("bag"), F.col("item_bag")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"), "n")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.at")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"))


def _masks(radius: int) -> list[int]:
    """The bits of each block, as signed numbers."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that hold no benchmark item. If one row without a doc_id holds an item, all
    rows without a doc_id go, as rows that repeat a doc_id do."""
    leak = unused(docs, "leak")
    bad = written(contaminated(docs, benchmark, **params).select("doc_id").distinct(), "leaks").withColumnRenamed("doc_id", leak)
    few = bad.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(F.col(leak)), "left_anti")
