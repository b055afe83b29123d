"""Exact top-k search by integer inner product: columnar branch-and-bound.

Vectors are dealt into blocks; each pair of a query block and a candidate block is one group.
In it candidates lie column-wise. Scores are accumulated over blocks of dimensions, those with
the most mass first. What the other dimensions can still add is at most the product of the
norms that remain (Cauchy-Schwarz); a candidate whose bound is below the k-th best lower bound
of every query in a tile is dropped and the columns are compacted. Survivors get exact scores.

Rows: vectors that are null or hold a null or non-finite component take no part, nor do rows
with a null id. Vectors of different lengths are as if filled up with zeros. Rows that repeat
an id and its vector are each candidates of the others, and each is a query. Integers are 64
bits wide; scores past that wrap around.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.storage import written

QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 8_192
TILE = 32  # queries that share a compacted candidate table
STEP = 8  # dimensions in a block

SCHEMA = "q long, qv long, qn long, id long, n long, score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    lens = vectors.map(len).to_numpy()
    if len(lens) and (lens == width).all() and width:
        return np.concatenate(vectors.to_numpy()).astype(np.int64).reshape(-1, width)
    out = np.zeros((len(vectors), width), np.int64)
    for k, x in enumerate(vectors):
        out[k, : len(x)] = x
    return out


def best(queries: np.ndarray, columns: np.ndarray, allowed: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the candidates that can be among its k best, exactly bounded.

    queries: (q, d); columns: (d, n), candidates by column; allowed: (q, n), which candidates
    may answer."""
    q, d = queries.shape
    order = np.argsort(-(np.abs(queries).sum(0).astype(float) * np.abs(columns).sum(1)), kind="stable")
    queries, columns = queries[:, order].astype(float), columns[order].astype(float)
    tails_q = np.sqrt(np.cumsum((queries**2)[:, ::-1], 1))[:, ::-1]
    tails_c = np.sqrt(np.cumsum((columns**2)[::-1], 0))[::-1]
    alive = np.flatnonzero(allowed.any(0))
    partial = np.zeros((q, len(alive)))
    for at in range(0, d, STEP):
        if len(alive) <= k:
            break
        partial += queries[:, at : at + STEP] @ columns[at : at + STEP, alive]
        if at + STEP < d:
            rest = tails_q[:, at + STEP, None] * tails_c[None, at + STEP, alive]
        else:
            rest = np.zeros_like(partial)
        slack = 1e-9 * (np.abs(partial) + rest) + 0.5
        low = np.where(allowed[:, alive], partial - rest - slack, -np.inf)
        floor = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k] if len(alive) > k else np.full(q, -np.inf)
        can = allowed[:, alive] & (partial + rest + slack >= floor[:, None])
        keep = can.any(0)
        if keep.mean() < 0.9:  # compaction
            alive, partial = alive[keep], partial[:, keep]
    out = []
    for j in range(q):
        out.append(alive[allowed[j, alive]])
    return out


def _group(k: int):
    def run(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {c: [] for c in ("q", "qv", "qn", "id", "n", "score")}
        if len(left) and len(right):
            width = max(int(left["v"].map(len).max()), int(right["v"].map(len).max()))
            qs, cs = _matrix(left["v"], width), _matrix(right["v"], width)
            columns = np.ascontiguousarray(cs.T)
            ids, n = right["id"].to_numpy(), right["n"].to_numpy()
            for lo in range(0, len(qs), TILE):
                tile = qs[lo : lo + TILE]
                own = left.iloc[lo : lo + TILE]
                same = (own["id"].to_numpy()[:, None] == ids[None]) & np.array([(cs == x).all(1) for x in tile])
                weights = n[None] - same  # its own row is no candidate
                for j, found in enumerate(best(tile, columns, weights > 0, k)):
                    if not len(found):
                        continue
                    score = (columns[:, found] * tile[j][:, None]).sum(0)
                    top = np.lexsort((ids[found], -score))[:k]
                    rows["q"] += [int(own["id"].iloc[j])] * len(top)
                    rows["qv"] += [int(own["key"].iloc[j])] * len(top)
                    rows["qn"] += [int(own["n"].iloc[j])] * len(top)
                    rows["id"] += ids[found][top].tolist()
                    rows["n"] += np.minimum(weights[j, found][top], k).tolist()
                    rows["score"] += score[top].tolist()
        return pd.DataFrame(rows, dtype=np.int64)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of the other rows for every row that
    is_query holds for; ties go to the smaller id."""
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    v = F.col(vector_col)
    whole = whole.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    rows = whole.select(F.col(id_col).cast("long").alias("id"), quantized(v, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.groupBy("id", "v").agg(F.count("*").alias("n"), F.max("asks").alias("asks")), "vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    cb, qb = max(6, -(-n // CANDIDATE_BLOCK)), max(1, -(-asking // QUERY_BLOCK))
    block = lambda blocks: F.expr(f"cast(pmod(xxhash64(id, v), {blocks}) as int)")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where("asks").select("id", "v", "n", F.xxhash64("v").alias("key"), block(qb).alias("qb"), every(cb).alias("cb"))
    others = rows.select("id", "v", "n", block(cb).alias("cb"), every(qb).alias("qb"))
    found = queries.groupBy("qb", "cb").cogroup(others.groupBy("qb", "cb")).applyInPandas(_group(k), SCHEMA)
    copies = found.select("q", "qv", "qn", "id", "score", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    ranked = copies.withColumn("rank", F.row_number().over(Window.partitionBy("q", "qv").orderBy(F.desc("score"), "id", "copy"))).where(F.col("rank") <= k)
    ranked = ranked.select("q", "rank", "id", "score", F.explode(F.sequence(F.lit(1), F.col("qn").cast("int"))).alias("as_query"))
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
