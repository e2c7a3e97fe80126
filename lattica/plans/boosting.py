"""Histogram gradient boosting over all folds at once, one Spark aggregation per tree level.

Features are cut into bins once. For every level of a tree, tasks sum the residuals of their
rows by fold, node, feature and bin; the sums, bounded by folds x nodes x features x bins, pick
the splits of all folds together. A split learns on which side missing values do better. After
each tree a fold's validation error is known; a fold stops when it has not fallen for
``patience`` trees and keeps the trees up to its best.

Residuals are summed as fixed-point integers and bin edges come from integer counts, so the
model does not depend on how the rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import finite
from lattica.session import settle

_PARTS = ("train", "validation", "test")
#: Cells from which bin edges are read, and the fixed-point scale of residual sums.
_CELLS, _POINT = 4096, 1 << 24
#: Trees after which the margins of all rows are written anew, so that a pass applies few trees.
_FOLD_IN = 8


@dataclass(frozen=True)
class BoostSettings:
    max_trees: int = 40
    step: float = 0.1
    depth: int = 3
    bins: int = 32
    least_rows: int = 20
    penalty: float = 1.0
    patience: int = 5


@dataclass
class Tree:
    """Splits by node (root 1, children 2k and 2k + 1): (feature, last left bin, missing goes left); values of leaves."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node each row has come to; code -1 is a missing value."""
        at = np.ones(len(codes), np.int64)
        if not self.splits:
            return at
        feature, last, missing_left = (np.zeros(max(self.splits) + 1, kind) for kind in (np.int64, np.int64, bool))
        inner = np.zeros(2 * len(feature), bool)
        for node, split in self.splits.items():
            feature[node], last[node], missing_left[node] = split
            inner[node] = True
        row = np.arange(len(codes))
        for _ in range(max(self.splits).bit_length()):
            open_ = inner[at]
            node = np.where(open_, at, 0)
            code = codes[row, feature[node]]
            left = np.where(code < 0, missing_left[node], code <= last[node])
            at = np.where(open_, 2 * at + ~left, at)
        return at

    def margins(self, codes: np.ndarray) -> np.ndarray:
        worth = np.zeros(2 * max([0, *self.splits]) + 2)
        for node, value in self.values.items():
            worth[node] = value
        return worth[self.nodes(codes)]


@dataclass
class Fold:
    """One fold's model while it grows."""

    base: float
    trees: list[Tree] = field(default_factory=list)
    gains: dict[int, float] = field(default_factory=dict)
    errors: list[float] = field(default_factory=list)  # mean squared validation error after 0, 1, .. trees
    done: bool = False

    def best(self) -> int:
        return int(np.argmin(self.errors)) if self.errors else 0


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of up to ``bins`` bins of about equal counts per feature, from exact counts
    in fixed cells of a squashed scale (so no outlier widens them)."""
    scales = rows.agg(*[F.avg(F.abs(f)).alias(f) for f in features]).first()
    scale = {f: float(f"{scales[f]:.2g}") if scales[f] else 1.0 for f in features}
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.floor((F.atan(F.col(f) / scale[f]) / math.pi + 0.5) * _CELLS).cast("int").alias("cell")) for i, f in enumerate(features)])
    counts = rows.select(F.inline(cells)).where("cell is not null").groupBy("feature", "cell").count().collect()  # features x cells at most
    edges = []
    for i, f in enumerate(features):
        found = np.zeros(_CELLS + 1, np.int64)
        for r in counts:
            if r["feature"] == i:
                found[r["cell"]] = r["count"]
        total = np.cumsum(found)
        wanted = total[-1] * np.arange(1, bins) / bins
        last = np.unique(np.searchsorted(total, wanted, "left"))
        edges.append(np.tan(((last + 1) / _CELLS - 0.5) * math.pi) * scale[f] if total[-1] else np.zeros(0))
    return edges


def _binned(rows: DataFrame, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((batch.num_rows, len(features)), np.int16)
            for i, f in enumerate(features):
                value = batch.column(f).to_numpy(zero_copy_only=False).astype(float)
                codes[:, i] = np.where(np.isnan(value), -1, np.searchsorted(edges[i], value, "left"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("trade_date", "symbol", "label")], _packed(codes)], ["trade_date", "symbol", "label", "codes"])

    return settle(rows.mapInArrow(cut, "trade_date date, symbol string, label double, codes binary"))


def _packed(table: np.ndarray) -> pa.Array:
    """The rows of a table as binary values."""
    ends = np.arange(len(table) + 1, dtype=np.int32) * (table.shape[1] * table.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(table))])


def _unpacked(packed: pa.Array, kind: type) -> np.ndarray:
    """The table that ``_packed`` made into binary values, read where it lies."""
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(packed), -1)


class _Rows:
    """A batch as arrays: codes, label, part per fold (-1: none), margin per fold."""

    def __init__(self, batch: pa.RecordBatch, features: int, parts: tuple[np.ndarray, np.ndarray], bases: list[float]):
        self.codes = _unpacked(batch.column("codes"), np.int16)
        self.label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        days, table = parts
        day = batch.column("trade_date").cast(pa.int32()).to_numpy()
        at = np.searchsorted(days, day).clip(0, len(days) - 1)
        self.part = np.where((days[at] == day)[:, None], table[at], -1)
        if "margins" in batch.schema.names:
            self.margin = _unpacked(batch.column("margins"), np.float64).copy()
        else:
            self.margin = np.tile(np.array(bases), (batch.num_rows, 1))

    def apply(self, folds: list[list[Tree]], upto: int = 2) -> None:
        """Add the trees of each fold to the margins of its rows, of parts up to ``upto``."""
        for k, trees in enumerate(folds):
            mine = np.flatnonzero((self.part[:, k] >= 0) & (self.part[:, k] <= upto)) if trees else []
            codes = self.codes[mine]
            for tree in trees:
                self.margin[mine, k] += tree.margins(codes)


_SUMS = "fold int, node long, feature int, bin int, grad long, n long"


def _level(features: int, bins: int, parts, bases: list[float], new: list[list[Tree]], growing: list[Tree | None]):
    """Sums by fold, open node, feature and bin; with node 0 the validation errors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [[] if t is None else sorted(n for n in _leaves(t) if n not in t.values) for t in growing]
        sums = [np.zeros((2, len(own), features, bins), np.int64) for own in nodes]
        errors = np.zeros((len(growing), 2), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _Rows(batch, features, parts, bases)
            rows.apply(new, 1)  # rows of a test part enter no sum
            known = ~np.isnan(rows.label)
            for k, tree in enumerate(growing):
                if tree is None:
                    continue
                if not tree.splits:
                    check = np.flatnonzero(known & (rows.part[:, k] == 1))
                    residual = rows.label[check] - rows.margin[check, k]
                    errors[k] += [np.rint(residual**2 * _POINT).astype(np.int64).sum(), len(check)]
                use = np.flatnonzero(known & (rows.part[:, k] == 0))
                codes = rows.codes[use]
                at = tree.nodes(codes)
                place = np.full(max(nodes[k]) + 1, -1)
                place[nodes[k]] = np.arange(len(nodes[k]))
                slot = np.where(at < len(place), place[np.minimum(at, len(place) - 1)], -1)
                grad = np.rint((rows.label[use] - rows.margin[use, k]) * _POINT).astype(np.int64)
                codes, slot, grad = codes[slot >= 0], slot[slot >= 0], grad[slot >= 0]
                cell = ((slot[:, None] * features + np.arange(features)) * bins + codes + 1).ravel()
                size = sums[k][0].size
                each = np.repeat(grad, features)
                if np.abs(grad).sum(dtype=float) < 2**52:  # whole numbers that doubles add up exactly
                    added = np.bincount(cell, each, size).astype(np.int64)
                else:
                    added = np.zeros(size, np.int64)
                    np.add.at(added, cell, each)
                sums[k][0] += added.reshape(sums[k][0].shape)
                sums[k][1] += np.bincount(cell, minlength=size).reshape(sums[k][1].shape)
        found = [(np.array([[k, 0, 0, 0]]), errors[k, :1], errors[k, 1:]) for k, t in enumerate(growing) if t is not None and not t.splits]
        for k, own in enumerate(nodes):
            if own:
                slot, feature, code = np.nonzero(sums[k][1])
                key = np.stack([np.full(len(slot), k), np.array(own)[slot], feature, code - 1], 1)
                found.append((key, sums[k][0][slot, feature, code], sums[k][1][slot, feature, code]))
        keys, grad, n = (np.concatenate([f[i] for f in found]) for i in range(3))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys.T, grad, n], types, strict=True)], ["fold", "node", "feature", "bin", "grad", "n"])

    return add


def best_split(sums: dict[tuple[int, int], tuple[int, int]], features: int, settings: BoostSettings) -> tuple[float, int, int, bool] | None:
    """(gain, feature, last left bin, missing goes left) of a node, from (feature, bin) -> (sum, rows).

    The first of equal gains stands: lower feature, lower bin, missing to the left.
    """
    least, penalty, best = settings.least_rows, settings.penalty, None
    value = lambda g, n: (g / _POINT) ** 2 / (n + penalty)
    for f in range(features):
        bins = sorted(b for g, b in sums if g == f)
        grad, n = sum(sums[f, b][0] for b in bins), sum(sums[f, b][1] for b in bins)
        lost = sums.get((f, -1), (0, 0))
        known = [b for b in bins if b >= 0]
        left_g = left_n = 0
        for b in known[:-1] if lost[1] == 0 else known:
            left_g, left_n = left_g + sums[f, b][0], left_n + sums[f, b][1]
            for missing_left in (True, False) if lost[1] else (False,):
                a, m = (left_g + lost[0], left_n + lost[1]) if missing_left else (left_g, left_n)
                if m < least or n - m < least:
                    continue
                gain = value(a, m) + value(grad - a, n - m) - value(grad, n)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, b, missing_left)
    return best


def _sides(sums: dict[tuple[int, int], tuple[int, int]], feature: int, last: int, missing_left: bool) -> list[tuple[int, int]]:
    """(sum, rows) left and right of a split of a node."""
    out = [[0, 0], [0, 0]]
    for (f, code), (grad, n) in sums.items():
        if f == feature:
            side = out[not (missing_left if code < 0 else code <= last)]
            side[0] += grad
            side[1] += n
    return [tuple(side) for side in out]


def _grow(tree: Tree, fold: Fold, sums: dict[int, dict], level: int, features: int, settings: BoostSettings) -> None:
    """Split the open nodes of a level, or close them."""
    for node, mine in sorted(sums.items()):
        found = best_split(mine, features, settings) if level < settings.depth else None
        if found is None:
            grad, n = (sum(v[i] for (f, _), v in mine.items() if f == 0) for i in range(2))
            tree.values[node] = settings.step * grad / _POINT / (n + settings.penalty)
        else:
            tree.splits[node] = found[1:]
            fold.gains[found[1]] = fold.gains.get(found[1], 0.0) + found[0]
            if level == settings.depth - 1:  # the leaves below hold what this level has summed
                for child, (grad, n) in zip((2 * node, 2 * node + 1), _sides(mine, *found[1:]), strict=True):
                    if n:
                        tree.values[child] = settings.step * grad / _POINT / (n + settings.penalty)


def boost(rows: DataFrame, features, dates: DataFrame, settings: BoostSettings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions of test rows, fold report, importances), for folds ``(test_year, part, trade_date)``.

    ``rows`` has ``label``; rows without one only get predictions. NaN and infinite feature
    values are missing. A fold without training rows predicts 0.
    """
    settings, features = settings or BoostSettings(), list(features)
    spark = rows.sparkSession
    clean = settle(rows.select("trade_date", "symbol", finite("label").alias("label"), *[finite(f).alias(f) for f in features]))
    marked = dates.select("test_year", "part", "trade_date").collect()  # calendar x folds
    years = sorted({r["test_year"] for r in marked})
    epoch = np.datetime64("1970-01-01")
    days = np.unique([(np.datetime64(r["trade_date"]) - epoch).astype(int) for r in marked]).astype(np.int32)
    table = np.full((len(days), len(years)), -1, np.int8)
    for r in marked:
        table[np.searchsorted(days, (np.datetime64(r["trade_date"]) - epoch).astype(int)), years.index(r["test_year"])] = _PARTS.index(r["part"])
    parts = (days, table)
    training = dates.where("part = 'train'").select("test_year", "trade_date")
    fitted = clean.where("label is not null").join(F.broadcast(training.select("trade_date").distinct()), "trade_date", "left_semi")
    edges = bin_edges(fitted, features, settings.bins)
    binned = _binned(clean, features, edges)
    means = {r[0]: r[1] for r in clean.join(F.broadcast(training), "trade_date").groupBy("test_year").agg(F.round(F.avg("label"), 9)).collect()}
    folds = [Fold(means.get(y) or 0.0) for y in years]
    bases = [f.base for f in folds]
    applied = [0] * len(folds)  # trees that the written margins hold

    def pass_over(growing: list[Tree | None]) -> dict:
        new = [f.trees[a:] for f, a in zip(folds, applied, strict=True)]
        found = binned.drop("symbol").mapInArrow(_level(len(features), max(map(len, edges), default=0) + 2, parts, bases, new, growing), _SUMS).groupBy("fold", "node", "feature", "bin").agg(F.sum("grad").alias("grad"), F.sum("n").alias("n"))
        out: dict = {}
        for r in found.collect():  # folds x nodes x features x bins
            out.setdefault((r["fold"], r["node"]), {})[r["feature"], r["bin"]] = (r["grad"], r["n"])
        return out

    for grown in range(settings.max_trees + 1):
        trees: list[Tree | None] = [None if f.done else Tree() for f in folds]
        for level in range(settings.depth + 1):
            open_ = [t if t is not None and (level == 0 or any(n not in t.values for n in _leaves(t))) else None for t in trees]
            if not any(t is not None for t in open_):
                break
            sums = pass_over(open_)
            for k, fold in enumerate(folds):
                if open_[k] is None:
                    continue
                if level == 0:
                    error, n = sums.get((k, 0), {}).get((0, 0), (0, 0))
                    fold.errors.append(error / _POINT / n if n else math.inf)
                    stale = len(fold.errors) - 1 - fold.best() >= settings.patience
                    if stale or grown == settings.max_trees or (k, 1) not in sums or not n:
                        fold.done, trees[k] = True, None
                        continue
                _grow(trees[k], fold, {node: s for (f, node), s in sums.items() if f == k and node > 0}, level, len(features), settings)
        for fold, tree in zip(folds, trees, strict=True):
            if tree is not None:
                fold.trees.append(tree)
        if all(f.done for f in folds):
            break
        if any(len(f.trees) - a >= _FOLD_IN for f, a in zip(folds, applied, strict=True)):
            binned = _with_margins(binned, len(features), parts, bases, [f.trees[a:] for f, a in zip(folds, applied, strict=True)])
            applied = [len(f.trees) for f in folds]

    kept = [f.trees[: f.best()] for f in folds]
    scored = _predictions(binned.drop("margins") if "margins" in binned.columns else binned, len(features), parts, bases, kept, years)
    report = [(y, f.best(), len(f.trees), f.errors[0] if f.errors else None, min(f.errors, default=None)) for y, f in zip(years, folds, strict=True)]
    gains = [(y, "boosted", name, f.gains.get(i, 0.0) / (sum(f.gains.values()) or 1.0)) for y, f in zip(years, folds, strict=True) for i, name in enumerate(features)]
    return (
        scored,
        spark.createDataFrame(report, "test_year int, trees_kept int, trees_grown int, mean_error double, best_error double"),
        spark.createDataFrame(gains, "test_year int, model string, feature string, importance double"),
    )


def _leaves(tree: Tree) -> list[int]:
    """Nodes without a split that rows can come to."""
    below = [1] if not tree.splits else [c for n in tree.splits for c in (2 * n, 2 * n + 1)]
    return [n for n in below if n not in tree.splits]


def _with_margins(binned: DataFrame, features: int, parts, bases, new: list[list[Tree]]) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch, features, parts, bases)
            rows.apply(new)
            names = ["trade_date", "symbol", "label", "codes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _packed(rows.margin)], [*names, "margins"])

    return settle(binned.mapInArrow(write, "trade_date date, symbol string, label double, codes binary, margins binary"))


def _predictions(binned: DataFrame, features: int, parts, bases, kept: list[list[Tree]], years: list[int]) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch, features, parts, bases)
            rows.apply(kept)
            for k, year in enumerate(years):
                mine = np.flatnonzero(rows.part[:, k] == 2)
                own = [batch.column(c).take(pa.array(mine)) for c in ("trade_date", "symbol", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), year, np.int32)), *own, pa.array(rows.margin[mine, k])], ["test_year", "trade_date", "symbol", "label", "prediction"])

    return binned.mapInArrow(score, "test_year int, trade_date date, symbol string, label double, prediction double")
