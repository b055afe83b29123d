"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by linear models over hashed words and word
beginnings. Each model also sees the probabilities of the categories before it; while training
these are out-of-fold, from models that did not see the row, so a later model learns how far an
earlier one can be trusted. The last category, `toxic`, is flagged from a threshold that is
calibrated on the out-of-fold probabilities of all labelled rows; the models themselves learn from
a bounded number of rows of each class.

The categories: two kinds of toxic texts, told apart by clustering the toxic rows' features, as
labels don't name kinds; and toxic, which the labels give. Clustering looks at the CLUSTER_SLOTS feature
slots that most of the sampled toxic rows have, of those that speak for toxic, a bound on what is fitted; the
models use every slot. (The labels' quality as a category before
these was tried; it made the last link no better.)

Rows: a text that is null or has no words has probabilities from the intercepts alone. Without
labels of both kinds nothing is flagged and probabilities are 0. Of rows that repeat a doc_id one
text is learned from, the first in order, and each is scored; of repeated labels the worst counts;
equal texts get equal scores. Columns of the input are kept; p_<category> and toxic replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from hearthline.llm import hashing
from hearthline.llm.memory import released

CATEGORIES = ["kind_a", "kind_b", "toxic"]
BITS = 20
CLUSTER_SLOTS = 512  # that tell the kinds of toxic texts apart
FOLDS = 3
EVIDENCE = 4.5  # standard deviations from chance at which a slot may carry a weight
ROWS_PER_CLASS = 4_000  # labelled rows that the chain learns from
BROADCAST_ROWS = 1_000_000  # labelled doc_ids; beyond that they are joined by a shuffle
BINS = 100_000  # of the histogram of probabilities that sets the threshold
NO_WORD = r"[^\pL]+"
SLICE = 1 << 21  # bytes of text that are looked at together, at least one text


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def word_slots(words: pa.Array) -> np.ndarray:
    """words x 3: the slots of each word and of its beginnings of 4 and 5 letters; -1: the word is
    shorter than that."""
    out = [(hashing.strings(words) >> np.uint64(64 - BITS)).astype(np.int64)]
    long = np.asarray(pc.utf8_length(words))
    for n in (4, 5):
        start = hashing.mix(hashing.strings(pc.utf8_slice_codeunits(words, 0, n)) ^ np.uint64(n))
        out.append(np.where(long >= n, (start >> np.uint64(64 - BITS)).astype(np.int64), -1))
    return np.stack(out, 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, text numbers): the distinct slots of each whole text, by text."""
    cols, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for offset, part in hashing.slices(texts, SLICE):
        split = pc.split_pattern_regex(pc.utf8_lower(part), NO_WORD)
        text, words = np.asarray(pc.list_parent_indices(split)), pc.list_flatten(split)
        full = np.asarray(pc.not_equal(words, ""), bool)
        coded = words.filter(pa.array(full)).dictionary_encode()
        n = len(coded.dictionary)
        if not n:
            continue
        pairs = _distinct(text[full].astype(np.int64) * n + np.asarray(coded.indices))
        text, found = np.repeat(pairs // n, 3), word_slots(coded.dictionary)[pairs % n].ravel()
        pairs = _distinct((text[found >= 0] << BITS) | found[found >= 0])
        cols.append(pairs & ((1 << BITS) - 1))
        rows.append((pairs >> BITS) + offset)
    return np.concatenate(cols), np.concatenate(rows)


@dataclass
class Link:
    weights: np.ndarray
    before: np.ndarray  # weights of the earlier categories' log-odds
    intercept: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    threshold: float = 2.0
    folds: list["Chain"] = field(default_factory=list)  # what did not see the rows of each fold
    scores: np.ndarray | None = None  # out-of-fold probabilities of the rows that were learned from


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_link(cols: np.ndarray, rows: np.ndarray, n: int, before: np.ndarray, y: np.ndarray, rounds: int = 80, l2: float = 0.2) -> Link:
    """Logistic regression by Adagrad over all rows; cols and rows: the non-zero entries.

    Only slots whose share of positive rows is EVIDENCE deviations from chance get a weight."""
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    seen, hit = np.bincount(cols, minlength=1 << BITS), np.bincount(cols, y[rows], minlength=1 << BITS)
    kept = np.flatnonzero(np.abs(hit - seen * rate) > EVIDENCE * np.sqrt(seen * rate * (1 - rate) + 0.5))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    use = place[cols] >= 0
    cols, rows = place[cols[use]], rows[use]
    w, b, v = np.zeros(len(kept)), 0.0, np.zeros(before.shape[1])
    sw, sb, sv = np.full(len(w), 1e-8), 1e-8, np.full(len(v), 1e-8)
    balance = np.sqrt(np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1))))  # half way to even classes
    for _ in range(rounds):
        error = (_sigmoid(np.bincount(rows, w[cols], minlength=n) + before @ v + b) - y) * balance
        gw = np.bincount(cols, error[rows], minlength=len(w)) + l2 * w
        gb, gv = error.sum(), before.T @ error
        sw, sb, sv = sw + gw**2, sb + gb**2, sv + gv**2
        w = w - 0.5 * gw / np.sqrt(sw)
        b = b - 0.5 * gb / np.sqrt(sb)
        v = v - 0.5 * gv / np.sqrt(sv)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Link(weights, v, float(b))


def _apply(link: Link, cols, rows, n, before) -> np.ndarray:
    return _sigmoid(np.bincount(rows, link.weights[cols], minlength=n) + before @ link.before + link.intercept)


def kinds(cols: np.ndarray, rows: np.ndarray, toxic: np.ndarray, rounds: int = 10) -> np.ndarray:
    """0 or 1 for each row: which of two clusters its features are nearer to. The clusters are those
    of the toxic rows over slots that speak for toxic, by cosine, started from the two rows that
    are farthest from all and from each other."""
    n, rate = len(toxic), toxic.mean()
    seen, hit = np.bincount(cols, minlength=1 << BITS), np.bincount(cols, toxic[rows].astype(float), minlength=1 << BITS)
    kept = np.flatnonzero(hit - seen * rate > EVIDENCE * np.sqrt(seen * rate * (1 - rate) + 0.5))
    kept = kept[np.argsort(-hit[kept], kind="stable")[:CLUSTER_SLOTS]]
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    use = place[cols] >= 0
    table = np.zeros((n, max(len(kept), 1)), np.float32)
    table[rows[use], place[cols[use]]] = 1
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    own = table[toxic == 1]
    first = int((own @ own.mean(0)).argmin())
    centres = np.stack([own[first], own[int((own @ own[first]).argmin())]])
    for _ in range(rounds):
        near = (own @ centres.T).argmax(1)
        centres = np.stack([own[near == k].mean(0) if (near == k).any() else centres[k] for k in (0, 1)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return (table @ centres.T).argmax(1)


def train_chain(texts: list[str | None], toxic: np.ndarray, folds: np.ndarray, chained: bool = True) -> Chain:
    """Without `chained` the last link alone, to compare."""
    n = len(texts)
    cols, rows = features(pa.array(texts, pa.large_string()))
    kind = kinds(cols, rows, toxic)
    truth = {"kind_a": toxic * (kind == 0), "kind_b": toxic * (kind == 1), "toxic": toxic}
    before = np.zeros((n, 0))
    chain = Chain(folds=[Chain() for _ in range(FOLDS)])
    for category in CATEGORIES if chained else CATEGORIES[-1:]:
        y = truth[category].astype(float)
        out = np.zeros(n)
        for fold in range(FOLDS):
            inside = folds == fold
            learn = np.flatnonzero(~inside)
            at = np.full(n, -1)
            at[learn] = np.arange(len(learn))
            use = at[rows] >= 0
            link = fit_link(cols[use], at[rows[use]], len(learn), before[learn], y[learn])
            chain.folds[fold].links.append(link)
            out[inside] = _apply(link, cols, rows, n, before)[inside]
        chain.links.append(fit_link(cols, rows, n, before, y))
        before = np.column_stack([before, _logit(out)])
    order = np.argsort(-out, kind="stable")
    chain.threshold = best_threshold(out[order], toxic[order], 1 - toxic[order])
    chain.scores = out
    return chain


def best_threshold(p: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold with the best F score that weighs precision twice as much as recall, as clean
    documents are to be left alone; in the middle of the gap below it. p: falling probabilities,
    with the number of rows of each class that have them."""
    hits = np.cumsum(toxic)
    score = 1.25 * hits / (hits + np.cumsum(clean) + 0.25 * max(toxic.sum(), 1))
    k = int(np.argmax(score))
    low = p[k + 1] if k + 1 < len(p) else 0.0
    return float((p[k] + low) / 2)


def _score_folds(shared):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: list[Chain] = shared.value
        for batch in batches:
            fold, p = np.asarray(batch.column("fold")).astype(int), np.zeros(batch.num_rows)
            cols, rows = features(batch.column("text"))
            for f, chain in enumerate(chains):
                own = fold[rows] == f
                p = np.where(fold == f, _chained(chain, cols[own], rows[own], len(p))[-1], p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.rint(p * BINS).astype(np.int64))], names=["doc_id", "bin"])

    return run


def calibrate(docs: DataFrame, known: DataFrame, folds: list[Chain]) -> float:
    """The threshold from a histogram of the out-of-fold probabilities of all labelled rows."""
    few = known.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text")
    if few:  # beyond that all texts are scored and only scores are joined
        rows = rows.join(F.broadcast(known.select("doc_id")), "doc_id")
    rows = rows.select("doc_id", "text", F.expr(f"coalesce(pmod(xxhash64(text), {FOLDS}), 0)").alias("fold"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("bin", T.LongType())])
    scored = rows.mapInArrow(_score_folds(docs.sparkSession.sparkContext.broadcast(folds)), schema)
    scored = scored.join(F.broadcast(known) if few else known, "doc_id")
    bins = scored.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
    bins.sort(key=lambda r: -r["bin"])
    p, toxic, clean = (np.array([r[c] for r in bins]) for c in ("bin", "toxic", "clean"))
    return best_threshold(p / BINS, toxic, clean)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Chain:
    """Learns from about rows_per_class labelled documents of each class, taken by a hash; the
    threshold comes from all labelled documents."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Chain()
    share = F.when(F.col("toxic") == 1, F.lit(rows_per_class / counts[1])).otherwise(F.lit(rows_per_class / counts[0]))
    chosen = known.where(F.expr("pmod(xxhash64(doc_id), 1000000)") < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.orderBy("doc_id").select("text", "toxic", F.expr(f"coalesce(pmod(xxhash64(text), {FOLDS}), 0)").alias("fold"))
    found = [(r["text"], r["toxic"], r["fold"]) for r in rows.toLocalIterator()]  # as many rows as the bound says
    if len({x[1] for x in found}) < 2:
        return Chain()
    texts, toxic, folds = zip(*found, strict=True)
    chain = train_chain(list(texts), np.array(toxic), np.array(folds))
    return Chain(chain.links, calibrate(docs, known, chain.folds))


def _chained(chain: Chain, cols: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """The probabilities of each category for n texts."""
    before, outs = np.zeros((n, 0)), []
    for link in chain.links:
        outs.append(_apply(link, cols, rows, n, before))
        before = np.column_stack([before, _logit(outs[-1])])
    return outs


def _predict(shared, text_at: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in batches:
            cols, rows = features(batch.column(text_at))
            outs = _chained(chain, cols, rows, batch.num_rows) or [np.zeros(batch.num_rows)] * len(CATEGORIES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x) for x in outs), pa.array(outs[-1] >= chain.threshold)],
                names=[*batch.schema.names, *(f"p_{c}" for c in CATEGORIES), "toxic"],
            )

    return run


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category and toxic, whether the document is flagged."""
    new = [*(f"p_{c}" for c in CATEGORIES), "toxic"]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2**BITS weights for each category
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.DoubleType()) for c in new[:-1]), T.StructField("toxic", T.BooleanType())])
    return docs.mapInArrow(_predict(shared, docs.columns.index("text")), schema)
