"""Cross-section primitives: statistics, ranks and medians inside one date.

A section is every row that shares ``keys`` (usually the trade date). Where a
section is known to fit one task a plain window is used. Beyond that bound the
section is cut into value ranges, each range is numbered on its own and the
range totals are added back, so no date ever has to fit in a task. The ranges
come from a hash sample of (value, tie-break) pairs, so that even one value held
by every row splits; the sample only places the cuts, all rows are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.session import settle

ROWS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class Layout:
    """How many ranges a section needs and how sparsely to sample for the cuts."""

    splits: int = 1
    sample_every: int = ROWS_PER_TASK // 64

    @classmethod
    def for_bound(cls, rows_per_section: int) -> Layout:
        """``rows_per_section`` is an upper bound, e.g. the number of listed symbols."""
        return cls(splits=max(1, -(-rows_per_section // ROWS_PER_TASK)))


WHOLE = Layout()


def _match(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Left join in which NULL keys meet NULL keys, as they do in a window."""
    named = {k: f"_k_{i}" for i, k in enumerate(keys)}
    right = other.select(*[F.col(c).alias(named.get(c, c)) for c in other.columns])
    same = F.lit(True)
    for key, name in named.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return df.join(right, same, "left").drop(*named.values())


def add_stats(df: DataFrame, keys, stats: dict[str, Column], layout: Layout = WHOLE) -> DataFrame:
    """Attach per-section aggregates to every row."""
    if layout.splits == 1:
        over = W.partitionBy(*keys)
        return df.withColumns({name: agg.over(over) for name, agg in stats.items()})
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return _match(df, totals, keys)


def _slots(df: DataFrame, keys, order: Column, seed: str, known: Column, layout: Layout) -> DataFrame:
    """Add ``_slot``: the range of ``order`` a row falls in, cut at sampled quantiles."""
    drawn = df.where(known & (F.pmod(F.xxhash64(seed), F.lit(layout.sample_every)) == 0))
    steps = F.sequence(F.lit(1), F.lit(layout.splits - 1))
    cuts = (
        drawn.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(order)).alias("_picks"))
        .select(
            *keys,
            F.transform(
                steps, lambda i: F.get("_picks", F.floor(F.size("_picks") * i / layout.splits).cast("int"))
            ).alias("_cuts"),
        )
    )
    below = F.size(F.filter("_cuts", lambda cut: cut < order))
    slot = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)
    return _match(df, cuts, keys).withColumn("_slot", slot).drop("_cuts")


def _ranged(df: DataFrame, keys, value: str, tie: str, descending: bool, layout: Layout) -> DataFrame:
    ordered = -F.col(value) if descending else F.col(value)
    pair = F.struct(ordered.alias("v"), F.col(tie).alias("t"))
    return _slots(df, keys, pair, tie, F.col(value).isNotNull(), layout)


def add_running(
    df: DataFrame, keys, order: list[str], values: dict[str, Column], layout: Layout = WHOLE
) -> DataFrame:
    """Running sums along ``order`` (non-null columns) inside each key, own row included.

    Beyond the bound of one task a key is cut into ranges of the order; each range is
    summed on its own and starts from the total of the ranges before it.
    """
    if layout.splits == 1:
        path = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: F.coalesce(F.sum(v).over(path), F.lit(0)) for n, v in values.items()})
    pair = F.struct(*order)
    cut = _slots(settle(df), keys, pair, order[-1], F.lit(True), layout).withColumns(
        {f"_v_{n}": v for n, v in values.items()}
    )
    totals = cut.groupBy(*keys, "_slot").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_slot", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values]
    )
    path = W.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = {n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(path), F.lit(0)) for n in values}
    return (
        _match(cut, starts, [*keys, "_slot"])
        .withColumns(inner)
        .drop("_slot", *[f"_v_{n}" for n in values], *[f"_s_{n}" for n in values])
    )


def add_positions(
    df: DataFrame,
    keys,
    value: str,
    *,
    tie: str = "symbol",
    descending: bool = False,
    position: str = "_pos",
    total: str | None = None,
    layout: Layout = WHOLE,
) -> DataFrame:
    """First-come rank of ``value`` in its section (ties by ``tie``); NULL stays unranked."""
    known = F.col(value).isNotNull()
    first = (F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), F.col(tie).asc())
    if layout.splits == 1:
        out = df.withColumn(position, F.when(known, F.row_number().over(W.partitionBy(*keys).orderBy(*first))))
        return out if total is None else out.withColumn(total, F.count(value).over(W.partitionBy(*keys)))
    ranged = _ranged(settle(df), keys, value, tie, descending, layout)
    cumulative = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_slot").agg(F.count(value).alias("_size"))
    offsets = sizes.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_size").over(cumulative), F.lit(0)).alias("_offset"),
        F.sum("_size").over(W.partitionBy(*keys)).alias("_total"),
    )
    inner = F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*first))
    out = _match(ranged, offsets, [*keys, "_slot"]).withColumn(
        position, F.when(known, (F.col("_offset") + inner).cast("int"))
    )
    if total is not None:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_slot", "_offset", "_total")


def add_average_rank(
    df: DataFrame, keys, value: str, name: str, *, tie: str = "symbol", layout: Layout = WHOLE
) -> DataFrame:
    """Rank with ties sharing their mean, NULL where the value is NULL."""
    known = F.col(value).isNotNull()
    if layout.splits == 1:
        # ties are the row's peers in the same order, so rank and ties share one sort
        order = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        peers = order.rangeBetween(W.currentRow, W.currentRow)
        ranked = df.withColumns({"_low": F.rank().over(order), "_ties": F.count(value).over(peers)})
        shared = F.when(known, F.col("_low") + (F.col("_ties") - 1) / F.lit(2.0))
        return ranked.withColumn(name, shared).drop("_low", "_ties")
    placed = settle(add_positions(df, keys, value, tie=tie, position="_p", layout=layout))
    shared = (
        placed.where(known)
        .groupBy(*keys, value)
        .agg((F.min("_p") + (F.count("*") - 1) / F.lit(2.0)).alias(name))
    )
    return _match(placed.drop("_p"), shared, [*keys, value])


def add_median(
    df: DataFrame, keys, value: str, name: str, *, tie: str = "symbol", layout: Layout = WHOLE
) -> DataFrame:
    """Exact median of the non-null values of a section."""
    if layout.splits == 1:
        return df.withColumn(name, F.median(value).over(W.partitionBy(*keys)))
    placed = settle(add_positions(df, keys, value, tie=tie, position="_p", total="_n", layout=layout))
    middle = F.col("_p").isin(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    medians = placed.where(middle).groupBy(*keys).agg(F.avg(value).alias(name))
    return _match(placed.drop("_p", "_n"), medians, keys)
