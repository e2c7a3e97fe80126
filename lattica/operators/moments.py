"""Moments of many columns at once: one centred Gram matrix per section, merged as needed.

Every task reduces its rows to one small matrix per section it has seen (count, means,
centred products). Matrices of the same section, and of the sections of a fold or a year,
are merged pairwise by the shift of their means, which loses no digits to large means. No
row is copied per pair of columns or per fold.

A column with missing values enters as two: a flag where it is missing and its value, 0
there. Sums over rows where both of two columns are present, and sums after imputing any
constant, are linear in those products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import finite

#: Partial matrices of one section meet in two steps, of which the first has so many places.
_SPREAD = 32
_MOMENTS = "n double, mean array<double>, scatter array<double>"

Part = tuple[float, np.ndarray, np.ndarray]


def merged(parts: list[Part]) -> Part:
    """The moments of all rows from those of disjoint sets of them."""
    n = np.array([p[0] for p in parts])
    means = np.stack([p[1] for p in parts])
    total = n.sum()
    mean = n @ means / total
    shift = means - mean
    return total, mean, sum(p[2] for p in parts) + (shift * n[:, None]).T @ shift


def _columns(values: np.ndarray, extra: np.ndarray, squares: bool) -> np.ndarray:
    missing = np.isnan(values)
    known = np.where(missing, 0.0, values)
    blocks = [missing.astype(float), known]
    if squares:
        blocks.append(known * known)
    return np.concatenate([*blocks, extra], 1)


def _floats(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1) if names else np.zeros((batch.num_rows, 0))


def _merge(keys: list[str]):
    def merge(table: pa.Table) -> pa.Table:
        rows = zip(table.column("n").to_pylist(), table.column("mean").to_pylist(), table.column("scatter").to_pylist(), strict=True)
        parts = [(n, np.array(mean), np.array(scatter).reshape(len(mean), -1)) for n, mean, scatter in rows]
        n, mean, scatter = merged(parts)
        own = [table.column(k)[:1] for k in keys]
        return pa.table([*own, pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=[*keys, "n", "mean", "scatter"])

    return merge


def merge_moments(moments: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Moments of coarser sections; ``moments`` has the keys. A group holds one matrix per finer section."""
    keys = list(keys)
    schema = ", ".join(f"{k} {moments.schema[k].dataType.simpleString()}" for k in keys)
    return moments.select(*keys, "n", "mean", "scatter").groupBy(*keys).applyInArrow(_merge(keys), f"{schema}, {_MOMENTS}")


def section_moments(df: DataFrame, names: Iterable[str], others: Iterable[str] = (), by: str = "trade_date", squares: bool = False) -> DataFrame:
    """``(by, n, mean, scatter)``: moments per section of the missing flags of ``names``, their
    values (0 where missing), with ``squares`` their squares, and of ``others`` (never missing).

    NaN and infinite values are missing; rows that miss one of ``others`` are left out, and so
    are rows without a section. Matrices are flat, row by row. Shift a column with gaps whose
    mean is far from 0 for its spread: the 0 that stands for a gap costs it digits.
    """
    names, others = list(names), list(others)
    rows = df.select(by, *[finite(c).alias(c) for c in [*names, *others]]).where(F.col(by).isNotNull())
    for c in others:
        rows = rows.where(F.col(c).isNotNull())

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[object, Part] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column(by).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            z = _columns(_floats(batch, names), _floats(batch, others), squares)[order]
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            for a, b, key in zip(cuts, [*cuts[1:], len(order)], coded.dictionary.to_pylist(), strict=True):
                mean = z[a:b].mean(0)
                part = (float(b - a), mean, (z[a:b] - mean).T @ (z[a:b] - mean))
                found[key] = merged([found[key], part]) if key in found else part
        place = TaskContext.get().partitionId() % _SPREAD
        for key, (n, mean, scatter) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], batch_type), pa.array([place], pa.int32()), pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])],
                [by, "_place", "n", "mean", "scatter"],
            )

    kind = rows.schema[by].dataType
    batch_type = pa.date32() if kind.simpleString() == "date" else pa.int32() if kind.simpleString() == "int" else pa.string()
    parts = rows.mapInArrow(reduce, f"{by} {kind.simpleString()}, _place int, {_MOMENTS}")
    return merge_moments(merge_moments(parts, [by, "_place"]), [by])


def imputed(n: float, mean: np.ndarray, scatter: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Means and centred products of columns whose gaps are filled, and of them with the last
    other column: (means, products, mean of the other, products with it)."""
    k = len(fill)
    through = np.zeros((k + 1, len(mean)))
    through[np.arange(k), np.arange(k)] = fill
    through[np.arange(k), k + np.arange(k)] = 1.0
    through[k, -1] = 1.0
    centre, products = through @ mean, through @ scatter @ through.T
    return centre[:k], products[:k, :k], float(centre[k]), products[:k, k]


def pairwise(n: float, mean: np.ndarray, scatter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs present and Pearson correlations of ``k`` columns (NaN: one side constant), with ``squares``."""
    raw = scatter + n * np.outer(mean, mean)
    flag, value, square = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    gone = n * mean[flag]
    both = n - gone[:, None] - gone[None, :] + raw[flag, flag]
    x = n * mean[value][:, None] - raw[value, flag]  # sum of a where b is present
    xx = n * mean[square][:, None] - raw[square, flag]
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.maximum(xx - x * x / both, 0.0)
        spread = np.where(spread > 1e-12 * np.abs(xx), spread, 0.0)
        value_ = (raw[value, value] - x * x.T / both) / np.sqrt(spread * spread.T)
    return np.rint(both), np.where((spread > 0) & (spread.T > 0), value_, np.nan)


def pairwise_correlations(moments: DataFrame, names: Iterable[str], keys: Iterable[str]) -> DataFrame:
    """``(keys, factor_a, factor_b, pairs, correlation)`` from moments taken with ``squares``."""
    names, keys = list(names), list(keys)
    k = len(names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mean = np.array(batch.column("mean")[i].as_py())
                pairs, found = pairwise(batch.column("n")[i].as_py(), mean, np.array(batch.column("scatter")[i].as_py()).reshape(len(mean), -1), k)
                at = pa.array(np.full(k * k, i))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(at) for c in keys],
                        pa.array(np.repeat(names, k).tolist()), pa.array(np.tile(names, k).tolist()),
                        pa.array(pairs.ravel().astype(np.int64)), pa.array(found.ravel(), pa.float64(), mask=np.isnan(found.ravel())),
                    ],
                    [*keys, "factor_a", "factor_b", "pairs", "correlation"],
                )

    schema = ", ".join(f"{c} {moments.schema[c].dataType.simpleString()}" for c in keys)
    return moments.select(*keys, "n", "mean", "scatter").mapInArrow(solve, f"{schema}, factor_a string, factor_b string, pairs long, correlation double")


def _places(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a column (missing last), and for each ordered row the begin and end of its tie."""
    order = np.argsort(column, kind="stable")
    value = column[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = value[1:] != value[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    heads = np.flatnonzero(fresh)
    end = np.append(heads[1:], len(order))[np.cumsum(fresh) - 1]
    return order, begin, end


def spearman_matrix(values: np.ndarray) -> np.ndarray:
    """Rank correlations of every pair of columns on the rows where both are present (NaN: none).

    A column is sorted once. Its ranks among the rows another column has are running counts
    of those rows along that order, so no pair is sorted again.
    """
    k = values.shape[1]
    known = ~np.isnan(values)
    places = [_places(values[:, i]) for i in range(k)]

    def ranks(i: int, rows: np.ndarray) -> np.ndarray:
        order, begin, end = places[i]
        count = np.concatenate([[0], np.cumsum(rows[order])])
        out = np.empty(len(order))
        out[order] = (count[begin] + count[end] + 1) / 2.0
        return out[rows]

    out = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i, k):
            rows = known[:, i] & known[:, j]
            if rows.sum() < 2:
                continue
            a, b = ranks(i, rows), ranks(j, rows)
            a, b = a - a.mean(), b - b.mean()
            size = np.sqrt((a @ a) * (b @ b))
            if size > 0:
                out[i, j] = out[j, i] = 1.0 if i == j else (a @ b) / size
    return out


def mean_spearman(df: DataFrame, names: Iterable[str], by: str = "trade_date") -> DataFrame:
    """``(factor_a, factor_b, correlation)``: rank correlations per section on pairwise-complete
    rows, averaged over the sections that have one. Rows travel once, to their section."""
    names = list(names)
    rows = df.select(by, *[finite(c).alias(c) for c in names]).where(F.col(by).isNotNull())

    def solve(table: pa.Table) -> pa.Table:
        found = spearman_matrix(_floats(table.combine_chunks(), names)).ravel()
        return pa.table([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found, pa.float64(), mask=np.isnan(found))], names=["pair", "value"])

    daily = rows.groupBy(by).applyInArrow(solve, "pair int, value double")
    label = F.array(*[F.lit(n) for n in names])
    return daily.groupBy("pair").agg(F.avg("value").alias("correlation")).select(
        label[F.floor(F.col("pair") / len(names)).cast("int")].alias("factor_a"), label[F.col("pair") % len(names)].alias("factor_b"), "correlation"
    )
