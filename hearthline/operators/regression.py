"""Least squares over tables of any length.

A row has a response, numeric terms and dummies (the numbers of the terms that are one). Spark adds
up cross-products where the rows are, and what is solved on the driver has the size of the terms
alone. Group effects are absorbed from sums: the cross-products of deviations from group
means are those of the rows less those of the groups' sums, and a group has few sums for each
term, however many rows it has. Both come from one pass over the rows.

Rows of clustered() lie group by group and name their group's size, so a task knows which groups it holds whole and
settles them on the spot; the few larger ones and those that two tasks share are added up from parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hearthline.functions.distributions import chi2_sf, normal_p
from hearthline.functions.scalars import spline_basis
from hearthline.storage import number_rows, written

SLICE = 4096  # rows that are laid out as a matrix at once
MOST = 16_384  # rows of one group that a task holds at once

CELLS = "i int, j int, v double"


def design(rows: DataFrame, y: Column, numeric: list[Column], dummies: list[Column], *keep: str) -> DataFrame:
    """y, x array<double>, hot array<int>, and the kept columns. dummies: the number of the term
    that is one, or null."""
    x = F.array(*(c.cast("double") for c in numeric)) if numeric else F.expr("cast(array() as array<double>)")
    none = F.expr("cast(array() as array<int>)")
    hot = F.concat(none, *(F.when(c.isNotNull(), F.array(c.cast("int"))).otherwise(none) for c in dummies))
    return rows.select(*keep, y.cast("double").alias("y"), x.alias("x"), hot.alias("hot"))


@dataclass(frozen=True)
class Flat:
    """Rows that hold y, numeric terms and the numbers of their dummies (int, or null) in plain columns. They cost a fraction of
    design()'s arrays to send to a task, which lays out splines itself. splines: knots by numeric column, None for a
    column that is one term."""

    splines: tuple[tuple[str, tuple[float, ...] | None], ...]
    hot: tuple[str, ...]

    def columns(self) -> list[str]:
        return ["y", *(name for name, _ in self.splines), *self.hot]

    def thin(self, batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
        """As _thin()."""
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        terms = [t for name, knots in self.splines for t in spline_terms(column(name), knots)]
        h = np.full((batch.num_rows, len(self.hot)), p + 2)
        for k, name in enumerate(self.hot):
            h[:, k] = batch.column(name).fill_null(p + 2).to_numpy()
        return np.column_stack([*terms, column("y")]), h

    def predicted(self, beta: np.ndarray) -> Column:
        terms = [t for name, knots in self.splines for t in (spline_basis(F.col(name), knots) if knots else [F.col(name)])]
        b = F.array(*map(F.lit, map(float, beta)))
        numeric = sum((t * float(beta[k]) for k, t in enumerate(terms)), F.lit(0.0))
        return sum((F.when(F.col(name).isNotNull(), F.get(b, F.col(name))).otherwise(0.0) for name in self.hot), numeric)


def spline_terms(x: np.ndarray, knots: tuple[float, ...] | None) -> list[np.ndarray]:
    """spline_basis() of many values at once."""
    if not knots:
        return [x]
    t, beyond = knots, [np.maximum(x - at, 0.0) for at in knots]
    cubes, gap = [b * b * b for b in beyond], knots[-1] - knots[-2]
    return [x] + [(cubes[j] - cubes[-2] * ((t[-1] - t[j]) / gap) + cubes[-1] * ((t[-2] - t[j]) / gap)) / (t[-1] - t[0]) ** 2 for j in range(len(t) - 2)]


def _columns(flat: Flat | None) -> list[str]:
    return flat.columns() if flat else ["y", "x", "hot"]


def _matrix(batch: pa.RecordBatch, p: int, flat: Flat | None = None) -> np.ndarray:
    """The rows' terms and then the response."""
    numeric, h = _thin(batch, p, flat)
    out = np.zeros((len(numeric), p + 3))
    out[:, [*range(numeric.shape[1] - 1), p]] = numeric
    out[np.arange(len(h))[:, None], h] = 1.0
    return out[:, : p + 1]


def _thin(batch: pa.RecordBatch, p: int, flat: Flat | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows' numeric terms and the response; and the numbers of their dummies, padded by p + 2."""
    if flat:
        return flat.thin(batch, p)
    n = batch.num_rows
    x, hot = batch.column("x"), batch.column("hot")
    numeric = np.hstack([x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
    lengths = np.diff(hot.offsets.to_numpy())
    h = np.full((n, lengths.max(initial=0)), p + 2)
    h[np.arange(h.shape[1]) < lengths[:, None]] = hot.flatten().to_numpy(zero_copy_only=False)
    return numeric, h


def _products(numeric: np.ndarray, h: np.ndarray, w: np.ndarray, p: int) -> np.ndarray:
    """Weighted cross-products of thin rows: a row's dummies meet its few terms only, not all others' zeros."""
    wide, at = p + 3, [*range(numeric.shape[1] - 1), p]
    weighted_ = numeric * w[:, None]
    out = np.zeros((wide, wide))
    out[np.ix_(at, at)] = numeric.T @ weighted_
    for one in h.T:
        for c, i in enumerate(at):
            v = np.bincount(one, weighted_[:, c], wide)
            out[i] += v
            out[:, i] += v
        for other in h.T:
            out += np.bincount(one * wide + other, w, wide * wide).reshape(wide, wide)
    return out[: p + 1, : p + 1]


def _cells(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(m)
    return pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": m[i, j]})


def _summed(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Cells of tasks, added up. At most the square of the number of terms reach the driver."""
    out = np.zeros(shape)
    with number_rows(cells.sparkSession):
        for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[r["i"], r["j"]] = r["v"]
    return out


def moments(rows: DataFrame, p: int, weight: Column | None = None, flat: Flat | None = None) -> np.ndarray:
    """Weighted cross-products of the terms and the response, (p + 1) x (p + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                total += _products(*_thin(part, p, flat), part.column("w").to_numpy(zero_copy_only=False), p)
        yield _cells(total)

    return _summed(rows.select(*_columns(flat), (F.lit(1.0) if weight is None else weight).alias("w")).mapInArrow(run, CELLS), (p + 1, p + 1))


def moments_by(rows: DataFrame, p: int, weight: Column, fold: Column, folds: int, flat: Flat | None = None) -> np.ndarray:
    """moments() of each fold, folds x (p + 1) x (p + 1), in one pass. fold: a number below folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, p + 1, p + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                (numeric, h), w, f = _thin(part, p, flat), part.column("w").to_numpy(zero_copy_only=False), part.column("f").to_numpy(zero_copy_only=False)
                for k in np.unique(f):
                    total[k] += _products(numeric[f == k], h[f == k], w[f == k], p)
        yield _cells(total.reshape(folds * (p + 1), p + 1))

    cells = rows.select(*_columns(flat), weight.cast("double").alias("w"), fold.cast("int").alias("f")).mapInArrow(run, CELLS)
    return _summed(cells, (folds * (p + 1), p + 1)).reshape(folds, p + 1, p + 1)


def fold_errors(sums: np.ndarray, kept: list[int]) -> list[float]:
    """The weighted error of each fold under the fit of the others, from their sums alone: a fold's model is that of the
    whole less the fold, and what it misses is a form in the fold's sums. kept: the terms that the fits use. The
    last sums of a fold hold its weight at the constant, term 0."""
    whole, out = sums.sum(0), []
    y = sums.shape[1] - 1
    for own in sums:
        rest = whole - own
        b = inverted(rest[np.ix_(kept, kept)]) @ rest[kept, y]
        missed = own[y, y] - 2 * b @ own[kept, y] + b @ own[np.ix_(kept, kept)] @ b
        out.append(float(np.sqrt(max(missed, 0.0) / own[0, 0])) if own[0, 0] > 0 else float("nan"))
    return out


def clustered(rows: DataFrame, group: str, parts: int | None = None, **about: Column) -> DataFrame:
    """rows with those of a group one after another, and the group's size, so that a task adds them up before anything is sent.
    parts: how many to deal them to; about: further aggregates of a group."""
    dealt = rows.repartition(parts, group) if parts else rows.repartition(group)
    whole = Window.partitionBy(group)
    return dealt.sortWithinPartitions(group).select("*", *(c.over(whole).alias(name) for name, c in {"size": F.count("*"), **about}.items()))


def _blocks(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of clustered(), where groups start in them, how many rows each has there, and whether those are all of it.
    A group isn't cut unless it has more than MOST rows or the task got a part of it only."""

    def starts_of(rows: pa.RecordBatch) -> np.ndarray:
        codes = rows.column(group).dictionary_encode("encode").indices.to_numpy()
        return np.append(0, np.flatnonzero(np.diff(codes)) + 1)

    def block(rows: pa.RecordBatch, starts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        counts = np.diff(np.append(starts, rows.num_rows))
        return rows, starts, counts, counts == rows.column("size").to_numpy()[starts]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held = [*held, batch] if batch.num_rows else held
        if sum(b.num_rows for b in held) >= SLICE:
            rows = pa.concat_batches(held)
            starts = starts_of(rows)
            last, starts = (rows.num_rows, starts) if rows.num_rows - starts[-1] > MOST else (int(starts[-1]), starts[:-1])
            if last:
                yield block(rows.slice(0, last), starts)
            held = [rows.slice(last)] if last < rows.num_rows else []
    if held:
        rows = pa.concat_batches(held)
        yield block(rows, starts_of(rows))


def _group_sums(numeric: np.ndarray, h: np.ndarray, starts: np.ndarray, counts: np.ndarray, w: np.ndarray, p: int) -> np.ndarray:
    """Groups x (p + 2): weighted sums of the terms, of the response and of one."""
    own, at = np.repeat(np.arange(len(starts)), counts) * (p + 3), [*range(numeric.shape[1] - 1), p, p + 1]
    out = np.zeros((len(starts), p + 3))
    for one in h.T:
        out += np.bincount(own + one, w, out.size).reshape(out.shape)
    out[:, at] = np.add.reduceat(np.hstack([numeric, np.ones((len(numeric), 1))]) * w[:, None], starts)
    return out[:, : p + 2]


def _added(parts: DataFrame, group: str) -> dict:
    """The sums of each group that came in parts; these are few, see _blocks()."""
    out: dict = {}
    for r in parts.select(group, "part").collect():
        out[r[group]] = out.get(r[group], 0) + np.array(r["part"])
    return out


def _absorbed_products(rows: DataFrame, group: str, p: int, flat: Flat | None = None) -> tuple[np.ndarray, dict]:
    """(cross-products of deviations from group means, the sums of groups that came in parts). rows: clustered()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for block, starts, counts, whole in _blocks(batches, group):
            numeric, h = _thin(block, p, flat)
            one = np.ones(len(numeric))
            total += _products(numeric, h, one, p)
            s = _group_sums(numeric, h, starts, counts, one, p)
            total -= _about_means(s[whole], p)
            if not whole.all():
                keys = block.column(group).take(pa.array(starts[~whole]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(list(s[~whole]), pa.list_(pa.float64())), *_nulls(len(keys), *CELL_TYPES)], names=[group, "part", "i", "j", "v"])
        cells = _cells(total)
        yield pa.RecordBatch.from_arrays([*_nulls(cells.num_rows, kind, pa.list_(pa.float64())), *cells.columns], names=[group, "part", "i", "j", "v"])

    kind = _arrow(rows, group)
    laid = rows.select(group, "size", *_columns(flat)).mapInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, part array<double>, {CELLS}")
    with number_rows(rows.sparkSession):
        found = written(laid, "sums")
    parts = _added(found.where("part is not null"), group)
    within = _summed(found.where("i is not null").select("i", "j", "v"), (p + 1, p + 1))
    return (within - _about_means(np.array(list(parts.values())), p) if parts else within), parts


def _about_means(s: np.ndarray, p: int) -> np.ndarray:
    """The sum over groups of s s' / n."""
    return s[:, : p + 1].T @ (s[:, : p + 1] / s[:, p + 1 :])


CELL_TYPES = (pa.int32(), pa.int32(), pa.float64())


def _nulls(n: int, *types: pa.DataType) -> list[pa.Array]:
    return [pa.nulls(n, t) for t in types]


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(rows.schema[column].dataType)


def group_moments(rows: DataFrame, group: str, p: int, weights: dict[str, Column], by: str) -> tuple[np.ndarray, DataFrame]:
    """(moments() under the weight called `by`, and what each term (p: the response, p + 1: one) sums to in each group
    under each weight: group, k array<int>, and an array for each weight), in one pass. A k may come more than
    once, each with a part of the sum: one part for each task and stretch of the group's rows, so rows are best clustered()."""
    names = list(weights)
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, open_ = np.zeros((p + 1, p + 1)), None, None

        def parts(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            """sums: weights x groups x terms."""
            g, k = np.nonzero((sums != 0).any(0))
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(g, minlength=len(keys)))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(k, pa.int32())), *(pa.ListArray.from_arrays(offsets, pa.array(v[g, k])) for v in sums)]
            none = [pa.nulls(len(keys), t) for t in (pa.int32(), pa.int32(), pa.float64())]
            return pa.RecordBatch.from_arrays([keys, *lists, *none], names=[group, "k", *names, "i", "j", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                (numeric, h), w = _thin(part, p), [part.column(f"w_{name}").to_numpy(zero_copy_only=False) for name in names]
                total += _products(numeric, h, w[names.index(by)], p)
                codes = part.column(group).dictionary_encode("encode").indices.to_numpy()
                starts = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
                own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, part.num_rows))) * (p + 3)
                full, at_terms = np.hstack([numeric, np.ones((len(numeric), 1))]), [*range(numeric.shape[1] - 1), p, p + 1]
                sums = np.zeros((len(names), len(starts), p + 3))
                for out, v in zip(sums, w, strict=True):
                    for one in h.T:
                        out += np.bincount(own + one, v, len(starts) * (p + 3)).reshape(out.shape)
                    out[:, at_terms] = np.add.reduceat(full * v[:, None], starts)
                sums = sums[:, :, : p + 2]
                keys = part.column(group).take(pa.array(starts))
                if last is not None and last.equals(keys.slice(0, 1)):
                    sums[:, 0] += open_[:, 0]
                elif last is not None:
                    yield parts(last, open_)
                if len(keys) > 1:
                    yield parts(keys.slice(0, len(keys) - 1), sums[:, :-1])
                last, open_ = keys.slice(len(keys) - 1), sums[:, -1:]
        if last is not None:
            yield parts(last, open_)
            cells = _cells(total)
            none = [pa.nulls(cells.num_rows, t) for t in (last.type, pa.list_(pa.int32()), *[pa.list_(pa.float64())] * len(names))]
            yield pa.RecordBatch.from_arrays([*none, *cells.columns], names=[group, "k", *names, "i", "j", "v"])

    laid = rows.select(group, "y", "x", "hot", *(w.cast("double").alias(f"w_{name}") for name, w in weights.items()))
    found = written(laid.mapInArrow(run, f"{group} {kind}, k array<int>, {', '.join(f'{n} array<double>' for n in names)}, {CELLS}"), "sums")
    per = found.where("i is null").groupBy(group).agg(F.collect_list(F.struct("k", *names)).alias("s"))
    return _summed(found.where("i is not null").select("i", "j", "v"), (p + 1, p + 1)), per.select(group, *(F.flatten(F.col("s")[c]).alias(c) for c in ("k", *names)))


def _dense(batch: pa.RecordBatch, column: str, p: int) -> np.ndarray:
    """A row for each group: its sums by term, then of the response and of one."""
    ks, vs = batch.column("k"), batch.column(column)
    at = np.repeat(np.arange(batch.num_rows), np.diff(ks.offsets.to_numpy())) * (p + 2) + ks.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(at, vs.flatten().to_numpy(zero_copy_only=False), batch.num_rows * (p + 2)).reshape(batch.num_rows, p + 2)


def inverted(gram: np.ndarray) -> np.ndarray:
    """The inverse, terms first brought to one scale; a term that others make up gets their share."""
    d = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return np.linalg.pinv(gram / np.outer(d, d), rcond=1e-13, hermitian=True) / np.outer(d, d)


def within_products(rows: DataFrame, group: str, p: int, flat: Flat | None = None) -> np.ndarray:
    """Cross-products of deviations from group means. rows: as those of absorbed()."""
    return _absorbed_products(_laid_by(rows, group), group, p, flat)[0]


def _laid_by(rows: DataFrame, group: str) -> DataFrame:
    return rows if "size" in rows.columns else written(clustered(rows, group), "design")


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    gram: np.ndarray  # cross-products of the terms and the response as fitted
    n: int
    groups: int = 0
    clustered: np.ndarray | None = None
    ssr: float = 0.0

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def p_values(self) -> list[float]:
        return [normal_p(b / s) if s > 0 else float("nan") for b, s in zip(self.beta, self.se(), strict=True)]

    def wald(self, names: list[str]) -> tuple[float, int, float]:
        """(statistic, degrees, p) of the terms being zero together."""
        at = [self.names.index(x) for x in names]
        b, v = self.beta[at], self.cov[np.ix_(at, at)]
        stat = float(b @ np.linalg.pinv(v, hermitian=True) @ b)
        return stat, len(at), chi2_sf(stat, len(at))

    def contrast(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effect, standard error) of each combination of terms."""
        return rows @ self.beta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", rows, self.cov, rows), 0))

    def vif(self) -> dict[str, float]:
        """Of the terms but the constant: the diagonal of the inverse correlation."""
        p = len(self.names)
        g = self.gram[:p, :p]
        if "const" in self.names:
            c = self.names.index("const")
            g = g - np.outer(g[c], g[c]) / g[c, c]
        at = [k for k, name in enumerate(self.names) if name != "const" and g[k, k] > 0]
        d = np.sqrt(np.diag(g)[at])
        inverse = np.linalg.pinv(g[np.ix_(at, at)] / np.outer(d, d), hermitian=True)
        return {self.names[k]: float(v) for k, v in zip(at, np.diag(inverse), strict=True)}


def predicted(rows: DataFrame, beta: np.ndarray, flat: Flat | None = None) -> Column:
    """x and hot times their coefficients, of rows laid out by design(), or flat."""
    if flat:
        return flat.predicted(beta)
    b = F.array(*map(F.lit, map(float, beta)))
    first = rows.select(F.size("x").alias("width")).first()  # every row has as many
    numeric = sum((F.col("x")[k] * float(beta[k]) for k in range(first["width"] if first else 0)), F.lit(0.0))
    return numeric + F.aggregate("hot", F.lit(0.0), lambda acc, h: acc + F.get(b, h))


def absorbed(rows: DataFrame, group: str, names: list[str], flat: Flat | None = None) -> tuple[Fit, DataFrame, DataFrame]:
    """Least squares within groups: (fit, levels, residuals).

    rows: from design(), or flat, with the group; best from rows that were clustered() and written, with their `size`, else that is
    done here. Covariance: heteroskedasticity-robust (HC1), and clustered by
    group. levels: group, n, alpha (the mean of what the terms leave), se, which adds the robust variance of
    the mean and that of the coefficients at the group's mean. residuals: rows with their e."""
    p, rows = len(names), _laid_by(rows, group)
    within, parts = _absorbed_products(rows, group, p, flat)
    inverse = inverted(within[:p, :p])
    beta = inverse @ within[:p, p]
    known = {g: float((s[p] - s[:p] @ beta) / s[p + 1]) for g, s in parts.items()}
    kind, spelled = _arrow(rows, group), rows.schema[group].dataType.simpleString()
    kinds = {group: kind, "n": pa.int64(), "alpha": pa.float64(), "ee": pa.float64(), "k": pa.list_(pa.int32()), "s": pa.list_(pa.float64()), "part": pa.list_(pa.float64()), "i": pa.int32(), "j": pa.int32(), "v": pa.float64()}

    def laid(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()], names=list(kinds))

    def settled(keys: pa.Array, s: np.ndarray, q: np.ndarray, alpha: np.ndarray) -> pa.RecordBatch:
        """What is kept of whole groups: of their sums those that aren't zero."""
        g, k = np.nonzero(s[:, :p])
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(g, minlength=len(s)))), pa.int32())
        return laid(**{group: keys, "n": pa.array(s[:, p + 1].astype(np.int64)), "alpha": pa.array(alpha), "ee": pa.array(q[:, p + 1]), "k": pa.ListArray.from_arrays(offsets, pa.array(k, pa.int32())), "s": pa.ListArray.from_arrays(offsets, pa.array(s[g, k]))})

    def meats(s: np.ndarray, scores: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Robust and clustered, of groups' sums weighted by one, e and its square; without the rows' own squares."""
        mean = s[:, :p] / s[:, p + 1 :]
        cross = q[:, :p].T @ mean
        return np.hstack([(mean * q[:, p + 1 :]).T @ mean - cross - cross.T, scores[:, :p].T @ scores[:, :p]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, b = np.zeros((p + 1, 2 * p + 1)), np.append(beta, [0.0] * 3)
        for block, starts, counts, whole in _blocks(batches, group):
            numeric, h = _thin(block, p, flat)
            left = numeric[:, -1] - numeric[:, :-1] @ beta[: numeric.shape[1] - 1] - b[h].sum(1)
            alpha, keys = np.add.reduceat(left, starts) / counts, block.column(group).take(pa.array(starts))
            parted = np.array([k in known for k in keys.to_pylist()]) if known else np.zeros(len(keys), bool)
            if not (whole | parted).all():
                raise RuntimeError("a group lies in other tasks than in the pass before")
            alpha[parted], whole = [known[k] for k in keys.filter(pa.array(parted)).to_pylist()], ~parted
            e = left - np.repeat(alpha, counts)
            s, scores, q = (_group_sums(numeric, h, starts, counts, w, p) for w in (np.ones(len(e)), e, e * e))
            total[:p, :p] += _products(numeric, h, e * e, p)[:p, :p]
            total[:p, : 2 * p] += meats(s[whole], scores[whole], q[whole])
            total[p, :3] += len(e), q[:, p + 1].sum(), whole.sum()
            yield settled(keys.filter(pa.array(whole)), s[whole], q[whole], alpha[whole])
            if not whole.all():
                yield laid(**{group: keys.filter(pa.array(~whole)), "part": pa.array(list(np.hstack([s, scores, q])[~whole]), pa.list_(pa.float64()))})
        cells = _cells(total)
        yield laid(i=cells["i"], j=cells["j"], v=cells["v"])

    out = rows.select(group, "size", *_columns(flat)).mapInArrow(run, f"{group} {spelled}, n long, alpha double, ee double, k array<int>, s array<double>, part array<double>, {CELLS}")
    with number_rows(rows.sparkSession):
        found = written(out, "groups")
    both = _summed(found.where("i is not null").select("i", "j", "v"), (p + 1, 2 * p + 1))
    n, ssr, g = int(round(both[p, 0])), float(both[p, 1]), int(round(both[p, 2])) + len(known)
    meat, groups = both[:p, : 2 * p], found.where("n is not null").select(group, "n", "alpha", "ee", "k", "s")
    if known:
        sums = _added(found.where("part is not null"), group)
        s, scores, q = np.split(np.array(list(sums.values())), 3, axis=1)
        meat = meat + meats(s, scores, q)
        more = settled(pa.array(list(sums), kind), s, q, np.array([known[k] for k in sums]))
        groups = groups.unionByName(rows.sparkSession.createDataFrame(more.to_pylist(), f"{group} {spelled}, n long, alpha double, ee double, k array<int>, s array<double>, part array<double>, {CELLS}").select(*groups.columns))
    cov = inverse @ meat[:, :p] @ inverse * (n / max(n - p, 1))
    clustered = inverse @ meat[:, p:] @ inverse * (g / max(g - 1, 1) * (n - 1) / max(n - p, 1))
    fit = Fit(names, beta, cov, within, n, g, clustered, ssr)
    spare = n / max(n - p - g, 1)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("n").to_numpy()
            ks, vs = batch.column("k"), batch.column("s")
            mean = np.zeros((batch.num_rows, p))
            mean[np.repeat(np.arange(batch.num_rows), np.diff(ks.offsets.to_numpy())), ks.flatten().to_numpy(zero_copy_only=False)] = vs.flatten().to_numpy(zero_copy_only=False)
            mean /= count[:, None]
            carried = np.maximum(((mean @ cov) * mean).sum(1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (group, "n", "alpha")), pa.array(np.sqrt(batch.column("ee").to_numpy() * spare / count**2 + carried))], names=[group, "n", "alpha", "se"])

    levels = groups.mapInArrow(errors, f"{group} {spelled}, n long, alpha double, se double")
    residuals = rows.withColumn("_left", F.col("y") - predicted(rows, beta, flat)).join(groups.select(group, "alpha"), group).withColumn("e", F.col("_left") - F.col("alpha")).drop("_left", "size")
    return fit, levels, residuals


def weighted(rows: DataFrame, names: list[str], weight: Column | None = None, small: int = 250, flat: Flat | None = None) -> tuple[Fit, DataFrame]:
    """(fit, rows with w, fitted and e) of weighted least squares. rows: from design(), or flat, best written. The covariance is
    robust: HC1, or HC3 below `small` rows."""
    held = rows.withColumn("w", F.lit(1.0) if weight is None else weight)
    fit = refitted(held, names, moments(held, len(names), F.col("w"), flat), held.count(), list(range(len(names))), small, flat)
    return fit, held.withColumn("fitted", predicted(held, fit.beta, flat)).withColumn("e", F.col("y") - F.col("fitted"))


def refitted(held: DataFrame, names: list[str], gram: np.ndarray, n: int, kept: list[int], small: int = 250, flat: Flat | None = None) -> Fit:
    """The fit on some of the terms, from the cross-products of all and one pass over the rows. held: n rows from design(), or
    flat, with their weight w."""
    p = len(names)
    short = inverted(gram[np.ix_(kept, kept)])
    beta, inverse = np.zeros(p + 3), np.zeros((p, p))
    beta[kept], inverse[np.ix_(kept, kept)] = short @ gram[kept, p], short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                (numeric, h), w = _thin(part, p, flat), part.column("w").to_numpy(zero_copy_only=False)
                e = numeric[:, -1] - numeric[:, :-1] @ beta[: numeric.shape[1] - 1] - beta[h].sum(1)
                u = w * e
                if n < small:
                    z = _matrix(part, p, flat)[:, :p]
                    u = u / np.maximum(1 - w * np.einsum("ij,jk,ik->i", z, inverse, z), 1e-12)
                total[:p] += _products(numeric, h, u * u, p)[:p, :p]
                total[p, 0] += (w * e * e).sum()
        yield _cells(total)

    found = _summed(held.select(*_columns(flat), "w").mapInArrow(run, CELLS), (p + 1, p))
    cov = short @ found[np.ix_(kept, kept)] @ short * (1.0 if n < small else n / max(n - len(kept), 1))
    used = [*kept, p]
    return Fit([names[k] for k in kept], beta[kept], cov, gram[np.ix_(used, used)], n, ssr=float(found[p, 0]))


# ---- splines

#: Percentiles of spline knots by their number.
KNOT_PERCENTS = {3: (10, 50, 90), 4: (5, 35, 65, 95), 5: (5, 27.5, 50, 72.5, 95), 6: (5, 23, 41, 59, 77, 95), 7: (2.5, 18.33, 34.17, 50, 65.83, 81.67, 97.5)}


def knots_for(n: int) -> int:
    """How many knots a number of rows carries."""
    return 7 if n >= 1500 else 6 if n >= 700 else 5 if n >= 250 else 4


def settled_knots(at: dict[float, float], distinct: int, most: int) -> list[float] | None:
    """The most knots, up to `most`, whose percentiles all differ; none if the variable hardly varies.
    at: values by percentile."""
    if distinct < 4:
        return None
    for k in range(min(most, max(3, min(distinct - 1, max(KNOT_PERCENTS)))), 2, -1):
        found = [at[q] for q in KNOT_PERCENTS[k]]
        if all(b - a > 1e-9 for a, b in zip(found, found[1:], strict=False)):
            return found
    return None


def spline_names(name: str, knots: list[float] | None) -> list[str]:
    return [name] + [f"{name}__nl{j}" for j in range(1, len(knots) - 1 if knots else 1)]
