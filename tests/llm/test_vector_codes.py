"""Vector codes against distances to all entries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import vector_codes as vc
from hearthline.llm.queries import op12_vector_codes, oracle_sql

DATA = "/root/testdata/sf0.001"


def brute(book, points):
    square = ((points[:, None] - book[None]) ** 2).sum(2)
    return square.argmin(1), square.min(1)


@pytest.mark.parametrize("seed", range(12))
def test_tree_finds_the_nearest_entry_with_ties(seed):
    rng = np.random.default_rng(seed)
    k, d, spread = int(rng.integers(1, 17)), int(rng.integers(1, 9)), int(rng.choice([2, 5, 4096, 1 << 26]))
    book = rng.integers(-spread, spread + 1, (k, d))
    book[rng.integers(0, k, k // 3)] = book[0]  # equal entries
    points = np.concatenate([rng.integers(-spread, spread + 1, (500, d)), book, (book[:, None] + book[None]).reshape(-1, d) // 2])
    index, square = vc.nearest(vc.build(book), book, points)
    want, least = brute(book, points)
    assert (index == want).all() and (square == least).all()


def test_tree_prunes():
    rng = np.random.default_rng(1)
    book = rng.integers(0, 50, (16, 4)) + 10_000 * rng.integers(0, 4, (16, 1))
    points = book[rng.integers(0, 16, 2000)] + rng.integers(-3, 4, (2000, 4))
    seen: list[int] = []
    index, square = vc.nearest(vc.build(book), book, points, seen)
    assert (index == brute(book, points)[0]).all()
    assert sum(seen) < 0.75 * 16 * len(points)


def plain(rows):
    """rows: (id, vector, label). The contract over whole arrays."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    size = width // 8
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = np.array([v + [0] * (width - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), width)
    codes, errors, listed = np.zeros((len(kept), 8), int), np.zeros(len(kept), int), []
    for p in range(8):
        own = m[:, p * size : (p + 1) * size]
        book = own[:16].copy()
        for _ in range(6):
            index, _d = brute(book, own)
            for e in set(index.tolist()):
                book[e] = [sum(c) // int((index == e).sum()) for c in own[index == e].T.tolist()]
        index, square = brute(book, own)
        codes[:, p], errors = index, errors + square
        listed += book.ravel().tolist()
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in code), int(e), labels[label], sha) for (i, _, label), code, e in zip(kept, codes, errors, strict=True))


def got(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vc.digest(*vc.compress(df)).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_query_against_plain_arrays(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in op12_vector_codes(spark, DATA).collect()) == plain(rows)


def test_sql(same):
    same(op12_vector_codes, oracle_sql()["op12_vector_codes"])


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=16)], int(rng.integers(0, 3))) for i in rng.permutation(60)]
    rows += [(3, None, 1), (4, [1.0, None], 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] * 16, None), (None, [0.5] * 16, None), (None, [0.25] * 16, None)]
    rows += [(7, rows[0][1], None), (0, rows[1][1], 2), (0, rows[1][1], 2), (90, [0.125] * 5, 1), (91, [], 1)] + [(100 + k, [0.5] * 16, 7) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == plain(rows)
    clashing = df.withColumns({c: F.lit(2.0) for c in ("v", "id", "code", "error", "label_error", "salt", "part", "entry", "pos", "value")})
    assert got(clashing) == plain(rows)


def test_few_rows_and_none(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(2, [1.0] * 8, None), (1, [-1.0] * 8, None), (3, [0.75] * 8, 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert got(spark.createDataFrame([(1, [], None)], SCHEMA)) == [("1", "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    coded = spark.createDataFrame([(k, k % 3 or None, "00", k) for k in range(100)], "id long, label int, code string, error long")
    want = sorted(map(repr, vc.with_label_errors(coded).collect()))
    monkeypatch.setattr(vc, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, vc.with_label_errors(coded).collect())) == want


def test_huge_components_count_as_the_bound(spark):
    rows = [(k, [3e38 if k % 2 else -3e38] * 8, 1) for k in range(40)]
    assert {r[2] for r in got(spark.createDataFrame(rows, SCHEMA))} == {0}
