"""Product-quantized vector codes, with nearest entries found in vantage-point trees.

Components are integers, floor(4096 x). A vector is cut into equal consecutive parts; each part
position has a codebook of at most 16 entries, which starts as that part of the vectors with the
smallest ids and is fitted by rounds of assignment and componentwise floor means. In a round Spark
deals the vectors; a task assigns its parts and adds them up by entry, and only sums, whose
number is that of the codebooks' components, reach the driver.

The entries of a position lie in a vantage-point tree: a node is an entry, with the span of its
distances to the entries below it, inside and outside. A part visits the nearer side first and the
other if its bound isn't above the best distance found (non-strict, so ties are seen). Spans are
rounded outwards and bounds down; every distance that decides is a sum of integers, and ties go to
the lower index.

Rows: vectors that are null or hold a null or non-finite component are dropped. A null id counts as
the greatest; rows that repeat an id are rows like others, and of those with one id the smaller
vector comes first. With fewer than 16 rows codebooks have fewer entries. Vectors of different
lengths, and lengths that no 8 equal parts make, are as if filled up with zeros. Components beyond
2^26 in size (|x| of 16384) count as that, so that sums stay in 64 bits; a sum over a label that
doesn't fit is null. Other columns than id, vector and label are not read. An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.memory import released
from hearthline.storage import forget, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
MOST = 1 << 26
SLICE = 8192  # vectors that are assigned at once
BROADCAST_ROWS = 500_000  # labels with their sums, of 16 bytes each
SALTS = 64


# ---- the tree


@dataclass
class Node:
    """An entry, and below it those nearer to it and those farther, with the span of their distances."""

    entry: int
    inside: "Node | None" = None
    outside: "Node | None" = None
    spans: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


def _down(x: np.ndarray | float) -> np.ndarray:
    return np.nextafter(np.sqrt(x), -np.inf)


def _up(x: np.ndarray | float) -> np.ndarray:
    return np.nextafter(np.sqrt(x), np.inf)


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


def build(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over some entries of a codebook. The vantage point is that farthest from their mean."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries].astype(float)
    at = int(((own - own.mean(0)) ** 2).sum(1).argmax())
    node, rest = Node(int(entries[at])), np.delete(entries, at)
    if len(rest):
        far = _squares(book[rest], book[node.entry])
        order = np.argsort(far, kind="stable")
        half = (len(rest) + 1) // 2
        sides = [order[:half], order[half:]]
        node.spans = tuple((float(_down(far[s].min())), float(_up(far[s].max()))) if len(s) else (np.inf, np.inf) for s in sides)
        node.inside = build(book, rest[sides[0]])
        node.outside = build(book, rest[sides[1]]) if len(sides[1]) else None
    return node


def nearest(tree: Node, book: np.ndarray, points: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry. seen: gets the number of points at each visit."""
    best, index = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if seen is not None:
            seen.append(len(rows))
        square = _squares(points[rows], book[node.entry])
        wins = (square < best[rows]) | ((square == best[rows]) & (node.entry < index[rows]))
        best[rows[wins]], index[rows[wins]] = square[wins], node.entry
        children = [c for c in (node.inside, node.outside) if c is not None]
        if not children:
            return
        low, high = _down(square), _up(square)
        bounds = [np.maximum(np.maximum(low - hi, lo - high), 0.0) for lo, hi in node.spans]
        floors = [np.maximum(b * b * (1 - 1e-12) - 1e-6, 0.0) for b in bounds]
        if len(children) == 1:
            go = floors[0] <= best[rows]
            if go.any():
                visit(children[0], rows[go])
            return
        first = (bounds[1] < bounds[0]).astype(int)  # the nearer side
        for turn in (0, 1):
            for side in (0, 1):
                mine = first == (side if turn == 0 else 1 - side)
                go = mine & (floors[side] <= best[rows])
                if go.any():
                    visit(children[side], rows[go])

    if len(points):
        visit(tree, np.arange(len(points)))
    return index, best


# ---- codebooks


def quantized(vector: Column) -> Column:
    most = F.lit(float(MOST))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * x.cast("double"), most), -most)))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """One row for each vector, filled up with zeros."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[k, : b - a] = flat[a:b]
    return out


def _assigned(books: list[np.ndarray], width: int) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of a column of vectors, in slices: the vectors, and the index and squared distance of each part."""
    trees = [build(b) for b in books]
    size = width // PARTS

    def run(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for lo in range(0, len(column), SLICE):
            v = _matrix(column.slice(lo, SLICE), width)
            found = [nearest(t, b, np.ascontiguousarray(v[:, p * size : (p + 1) * size])) for p, (t, b) in enumerate(zip(trees, books, strict=True))]
            yield v, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows or more, as a tree is walked once for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SLICE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _sums(books: list[np.ndarray], width: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigned, size, k = _assigned(books, width), width // PARTS, len(books[0])
        counts, totals = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, size), np.int64)
        for batch in _gathered(batches):
            for v, index, _ in assigned(batch.column(0)):
                for p in range(PARTS):
                    own = v[:, p * size : (p + 1) * size]
                    counts[p] += np.bincount(index[:, p], minlength=k)
                    order = np.argsort(index[:, p], kind="stable")
                    there, starts = np.unique(index[order, p], return_index=True)
                    totals[p, there] += np.add.reduceat(own[order], starts, axis=0)
        part, entry = np.nonzero(counts)
        values = np.concatenate([counts[part, entry, None], totals[part, entry]], 1)
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(part, size + 1), "entry": np.repeat(entry, size + 1), "pos": np.tile(np.arange(size + 1), len(part)), "value": values.ravel(),
        })

    return run


def _codes(books: list[np.ndarray], width: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigned = _assigned(books, width)
        for batch in _gathered(batches):
            at = 0
            for v, index, square in assigned(batch.column(0)):
                own = batch.slice(at, len(v))
                at += len(v)
                codes = ["".join(map("{:02x}".format, row)) for row in index.tolist()]
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(codes), pa.array(square.sum(1))], names=["id", "label", "code", "error"])

    return run


@dataclass
class Codebooks:
    books: list[np.ndarray]  # for each part position, entries by components
    width: int

    def listed(self) -> str:
        """All components by part, entry and position, comma-joined."""
        return ",".join(str(x) for b in self.books for x in b.ravel().tolist())


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """v, id, label of the rows that are kept."""
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(sound).select(quantized(x).alias("v"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """rows: what integers() gives."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // PARTS) * PARTS
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    start = np.zeros((len(first), width), np.int64)
    for k, v in enumerate(first):
        start[k, : len(v)] = v
    size = width // PARTS
    books = [start[:, p * size : (p + 1) * size].copy() for p in range(PARTS)]
    for _ in range(rounds if width and len(first) else 0):
        partial = rows.select("v").mapInArrow(_sums(books, width), "part long, entry long, pos long, value long")
        sums = {(r["part"], r["entry"], r["pos"]): r["value"] for r in partial.groupBy("part", "entry", "pos").agg(F.sum("value").alias("value")).collect()}
        for (part, entry, pos), count in list(sums.items()):
            if pos == 0:
                books[part][entry] = [sums[part, entry, k + 1] // count for k in range(size)]
    return Codebooks(books, width)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """id, label, code, error."""
    label = rows.schema["label"].dataType.simpleString()
    if not codebooks.width or not len(codebooks.books[0]):
        none = F.lit("00" * PARTS)
        return rows.select("id", "label", none.alias("code"), F.lit(0).cast("long").alias("error"))
    return rows.mapInArrow(_codes(codebooks.books, codebooks.width), f"id long, label {label}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: its error summed over equal labels, nulls together."""
    sums = written(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label_errors")
    if sums.count() <= BROADCAST_ROWS:
        joined = coded.alias("c").join(F.broadcast(sums).alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    else:  # a label may hold any share of the rows
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.alias("c").join(spread.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")) & (F.col("c.salt") == F.col("s.salt")))
    return joined.select("c.id", "c.label", "c.code", "c.error", "s.label_error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error of each row that is kept; the codebooks)."""
    rows = written(integers(vectors, id_col, vector_col, label_col), "integers")
    codebooks = fit(rows)
    coded = written(encode(rows, codebooks), "codes")
    forget(rows)
    return with_label_errors(coded), codebooks


def digest(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    named = coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error")
    return named.withColumn("codebooks_sha256", F.lit(hashlib.sha256(codebooks.listed().encode()).hexdigest()))
