"""Rolling factors as window columns over one symbol partition.

Every factor declares its inputs and lookback. A builder receives the named
window frames of the panel and returns a column; columns that a frame must run
over (returns, log changes) are staged first, because windows cannot nest. All
stages share one partitioning and ordering, so a suite of factors costs a single
exchange on the symbol.

A symbol partition holds at most one row per session (the panel key is unique),
which bounds it by the calendar length whatever the size of the panel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import all_of, at_least, finite, flag, paired, pearson_over, positive, ratio
from lattica.operators.checks import require_columns

PRICE = "_price"
RETURN = "_return"
LOG_CHANGE = "_log_change"
MARKET = "_market_return"
RESIDUAL = "_residual"
GAP = "_overnight_gap"
STAGES = (PRICE, RETURN, LOG_CHANGE, MARKET, RESIDUAL)
#: Rows of a residual's regression.
RESIDUAL_ROWS = 60


class Frames:
    """Window frames of one panel: ordered rows of a symbol (and segment)."""

    def __init__(self, partition: Iterable[str]):
        self.ordered: WindowSpec = W.partitionBy(*partition).orderBy("trade_date")

    def last(self, rows: int) -> WindowSpec:
        return self.ordered.rowsBetween(1 - rows, 0)

    def lag(self, column: str | Column, rows: int = 1) -> Column:
        return F.lag(column, rows).over(self.ordered)

    def mean(self, value: Column, rows: int, minimum: int) -> Column:
        frame = self.last(rows)
        return at_least(value, frame, minimum, F.avg(value).over(frame))

    def std(self, value: Column, rows: int, minimum: int) -> Column:
        frame = self.last(rows)
        return at_least(value, frame, minimum, F.stddev_samp(value).over(frame))


@dataclass(frozen=True)
class Factor:
    """A named factor: declared inputs, rows of history, and its column builder."""

    name: str
    inputs: tuple[str, ...]
    lookback: int
    build: Callable[[Frames], Column]
    stages: tuple[str, ...] = field(default=(PRICE,))


def momentum(lookback: int, skip: int) -> Callable[[Frames], Column]:
    if not lookback > skip >= 0:
        raise ValueError("momentum needs lookback > skip >= 0")
    return lambda f: ratio(f.lag(PRICE, skip) if skip else F.col(PRICE), f.lag(PRICE, lookback)) - 1


def reversal(rows: int) -> Callable[[Frames], Column]:
    return lambda f: -(ratio(PRICE, f.lag(PRICE, rows)) - 1)


def _amihud(f: Frames) -> Column:
    traded = F.when(F.col("amount") != 0, F.col("amount"))
    return f.mean(ratio(F.abs(RETURN), traded), 20, 15)


def _downside(f: Frames) -> Column:
    loss = F.when(F.col(RETURN).isNotNull(), F.pow(F.least(F.col(RETURN), F.lit(0.0)), F.lit(2.0)))
    return F.sqrt(f.mean(loss, 20, 15))


def _overnight(f: Frames) -> Column:
    return f.mean(F.col(GAP), 5, 5)


def _intraday(f: Frames) -> Column:
    return f.mean(ratio("close", positive("open")) - 1, 20, 15)


def _amount_momentum(f: Frames) -> Column:
    traded = F.when(F.col("amount") != 0, F.col("amount"))
    return ratio(f.mean(traded, 5, 4), f.mean(traded, 20, 15)) - 1


def _price_volume(f: Frames) -> Column:
    frame = f.last(20)
    pairs = paired(F.col(RETURN), F.col(LOG_CHANGE))[0]
    return at_least(pairs, frame, 15, pearson_over(F.col(RETURN), F.col(LOG_CHANGE), frame))


def _range_position(f: Frames) -> Column:
    return f.mean(ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 20, 20)


_R = (PRICE, RETURN)
BUILT_IN = [
    Factor("momentum_20_5", ("close",), 20, momentum(20, 5)),
    Factor("momentum_60_5", ("close",), 60, momentum(60, 5)),
    Factor("momentum_120_20", ("close",), 120, momentum(120, 20)),
    Factor("reversal_5", ("close",), 5, reversal(5)),
    Factor("reversal_20", ("close",), 20, reversal(20)),
    Factor("amihud_20", ("close", "amount"), 20, _amihud, _R),
    Factor("volatility_20", ("close",), 20, lambda f: f.std(F.col(RETURN), 20, 15), _R),
    Factor("volatility_60", ("close",), 60, lambda f: f.std(F.col(RETURN), 60, 40), _R),
    Factor("downside_volatility_20", ("close",), 20, _downside, _R),
    Factor("overnight_reversal_5", ("adj_open", "adj_close"), 5, _overnight, (PRICE, GAP)),
    Factor("intraday_momentum_20", ("open", "close"), 20, _intraday, ()),
    Factor("turnover_mean_20", ("turnover_rate",), 20, lambda f: f.mean(F.col("turnover_rate"), 20, 15), ()),
    Factor("amount_momentum_20", ("amount",), 20, _amount_momentum, ()),
    Factor("price_volume_corr_20", ("close", "amount"), 20, _price_volume, (PRICE, RETURN, LOG_CHANGE)),
    Factor(
        "ivol_60",
        ("close",),
        120,
        lambda f: f.std(F.col(RESIDUAL), 60, 40),
        (PRICE, RETURN, MARKET, RESIDUAL),
    ),
    Factor("book_to_price", ("book_value", "market_cap"), 0, lambda f: ratio("book_value", "market_cap"), ()),
    Factor("earnings_yield", ("net_profit_ttm", "market_cap"), 0, lambda f: ratio("net_profit_ttm", "market_cap"), ()),
    Factor("range_position_20", ("close", "high", "low"), 20, _range_position, ()),
    Factor("my_momentum_20", ("close",), 20, momentum(20, 0)),
]
REGISTRY: dict[str, Factor] = {f.name: f for f in BUILT_IN}
_BUILT_IN_NAMES = frozenset(REGISTRY)


def factor(name: str) -> Factor:
    if name not in REGISTRY:
        raise KeyError(f"unknown factor {name!r}; choose from {sorted(REGISTRY)}")
    return REGISTRY[name]


def required_inputs(names: Iterable[str]) -> list[str]:
    """Columns a set of factors reads, keys first; this is what a pruned scan selects."""
    needed = {c for n in names for c in factor(n).inputs}
    return ["trade_date", "symbol", *sorted(needed)]


def warmup_rows(names: Iterable[str]) -> int:
    return max((factor(n).lookback for n in names), default=0)


def register(definition: Factor, *, title: str, description: str, direction: int) -> Factor:
    """Add a user factor after checking its declaration."""
    if not re.fullmatch(r"[a-z][a-z0-9_]{0,79}", definition.name):
        raise ValueError("factor names start with a lower-case letter: a-z, 0-9 and _ only")
    if definition.name in _BUILT_IN_NAMES:
        raise ValueError(f"{definition.name!r} is a built-in factor")
    if not title.strip() or not description.strip():
        raise ValueError("title and description are required")
    if direction not in (-1, 1):
        raise ValueError("direction is 1 or -1")
    if not 0 <= definition.lookback <= 2000:
        raise ValueError("lookback is between 0 and 2000 rows")
    if not definition.inputs:
        raise ValueError("declare at least one input column")
    REGISTRY[definition.name] = definition
    return definition


def unregister(name: str) -> None:
    if name in _BUILT_IN_NAMES:
        raise ValueError("built-in factors stay registered")
    REGISTRY.pop(name, None)


def price_column(columns) -> Column:
    if "adj_close" in columns:
        return finite("adj_close")
    return F.col("close") * (F.col("adj_factor") if "adj_factor" in columns else F.lit(1.0))


def partition_of(df: DataFrame) -> list[str]:
    return ["symbol", "research_segment"] if "research_segment" in df.columns else ["symbol"]


def last_rows(df: DataFrame, rows: int) -> DataFrame:
    """The last rows of every frame, counted along the order that the factors share."""
    back = F.count("*").over(W.partitionBy(*partition_of(df))) - F.row_number().over(Frames(partition_of(df)).ordered)
    return df.withColumn("_back", back).where(F.col("_back") < rows).drop("_back")


def _since(df: DataFrame, rows: int) -> DataFrame:
    """At least the last rows of every frame: those from the date on of the last but so many.

    Only keys travel to find the dates; one date for each frame, a small row, is sent to all tasks.
    """
    keys = partition_of(df)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("trade_date")))
    dates = df.select(*keys, "trade_date").withColumn("_place", place).where(F.col("_place") == rows)
    dates = dates.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("trade_date").alias("_since"))
    same = all_of(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)
    kept = df.join(F.broadcast(dates), same, "left").where(F.col("_since").isNull() | (F.col("trade_date") >= F.col("_since")))
    return kept.drop("_since", *[f"_{k}" for k in keys])


def _stage(df: DataFrame, frames: Frames, wanted: set[str], resumed: bool = False, tail: int | None = None) -> DataFrame:
    """Add the columns that factor frames run over.

    ``resumed`` says that only rows with ``_new`` are new; the others bring what was staged
    for them as ``_kept_<stage>``, and only sessions of new rows enter the market mean.
    ``tail`` says that only so many last rows of a frame are wanted, so rows long before them
    enter the market mean only.
    """

    def staged(name: str, value: Column) -> Column:
        return F.when(F.col("_new"), value).otherwise(F.col(f"_kept{name}")) if resumed else value

    if PRICE in wanted:
        df = df.withColumn(PRICE, price_column(df.columns))
    every = df
    if tail is not None:
        df = _since(df, tail + RESIDUAL_ROWS + 1)  # one more, for the return of the first
    first: dict[str, Column] = {}
    if RETURN in wanted:
        first[RETURN] = staged(RETURN, ratio(PRICE, frames.lag(PRICE)) - 1)
    if LOG_CHANGE in wanted:
        log_amount = F.when(F.col("amount") > 0, F.ln("amount"))
        first[LOG_CHANGE] = staged(LOG_CHANGE, log_amount - frames.lag(log_amount))
    if GAP in wanted:
        first[GAP] = staged(GAP, -(ratio("adj_open", positive(frames.lag("adj_close"))) - 1))
    if first:
        df = df.withColumns(first)
    if MARKET in wanted:
        # one row per session, so the broadcast is bounded by the calendar
        known = df.where("_new") if resumed else df if tail is None else every.withColumn(RETURN, first[RETURN])
        mean = known.groupBy("trade_date").agg(F.avg(RETURN).alias("_mean"))
        df = df.join(F.broadcast(mean), "trade_date", "left").withColumn(MARKET, staged(MARKET, F.col("_mean"))).drop("_mean")
    if RESIDUAL in wanted:
        if tail is not None:
            df = last_rows(df, tail + RESIDUAL_ROWS)
        frame = frames.last(RESIDUAL_ROWS)
        x, y = paired(F.col(RETURN), F.col(MARKET))
        covariance = at_least(x, frame, 40, F.covar_samp(x, y).over(frame))
        variance = at_least(F.col(MARKET), frame, 40, F.var_samp(MARKET).over(frame))
        df = df.withColumn("_beta", ratio(covariance, variance))
        df = df.withColumn(RESIDUAL, staged(RESIDUAL, F.col(RETURN) - F.col("_beta") * F.col(MARKET))).drop("_beta")
    return df


def staged_columns(names: Iterable[str]) -> list[str]:
    """The staged columns that a set of factors needs, in the order they are built."""
    wanted = {s for n in names for s in factor(n).stages}
    return [s for s in (*STAGES[1:], GAP) if s in wanted]


def compute_factors(panel: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add one column per factor in a single pass; masked outside the universe.

    ``research_segment`` joins the window key, amounts flagged as outside the price
    range count as missing, and ``in_universe`` masks the result.
    """
    return with_factors(panel, names).drop(*STAGES, GAP)


def staged(panel: DataFrame, names: Iterable[str], resumed: bool = False, tail: int | None = None) -> DataFrame:
    """The panel with the columns that the frames of some factors run over, as in ``_stage``."""
    names = list(names)
    require_columns(panel, required_inputs(names))
    work = panel
    if "amount_outside_price_range" in panel.columns and "amount" in panel.columns:
        believed = F.when(~flag("amount_outside_price_range"), F.col("amount"))
        work = work.withColumns({"_amount": F.col("amount"), "amount": believed})
    wanted = {s for n in names for s in factor(n).stages}
    return _stage(work, Frames(partition_of(panel)), wanted, resumed, tail)


def _cleaned(work: DataFrame, names: list[str]) -> DataFrame:
    # built first, cleaned in the next projection: a window expression is then
    # computed once however often its value is tested
    inside = flag("in_universe") if "in_universe" in work.columns else F.lit(True)
    return given(work.withColumns({n: F.when(inside, finite(n)) for n in names}))


def given(work: DataFrame) -> DataFrame:
    """Staged rows with the amounts they came with."""
    return work.withColumn("amount", F.col("_amount")).drop("_amount") if "_amount" in work.columns else work


def with_factors(panel: DataFrame, names: Iterable[str]) -> DataFrame:
    """``compute_factors`` that leaves the staged columns in."""
    names = list(names)
    frames = Frames(partition_of(panel))
    return _cleaned(staged(panel, names).withColumns({n: factor(n).build(frames) for n in names}), names)


def new_factors(rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """Factors of the rows with ``_new`` among staged rows, the last of their frames.

    A frame costs the rows it spans for every row it stands on, so factors are built by
    lookback, longest first, and rows that no shorter one reaches are left out on the way.
    """
    names = list(names)
    frames, keys = Frames(partition_of(rows)), partition_of(rows)
    rows = rows.withColumn("_at", F.row_number().over(frames.ordered))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_new"), F.col("_at"))).over(W.partitionBy(*keys)))
    for lookback in sorted({factor(n).lookback for n in names}, reverse=True):
        rows = rows.where(F.col("_at") >= F.col("_first") - lookback)
        rows = rows.withColumns({n: factor(n).build(frames) for n in names if factor(n).lookback == lookback})
    return _cleaned(rows.where("_new"), names)


def compute_factor(panel: DataFrame, name: str) -> DataFrame:
    """Canonical signal table ``(trade_date, symbol, factor)``."""
    return compute_factors(panel, [name]).select("trade_date", "symbol", F.col(name).alias("factor"))


def pandas_factor(panel: DataFrame, name: str, inputs: Iterable[str], function) -> DataFrame:
    """User factor written for one symbol's pandas frame, run per symbol by Spark.

    ``function`` sees only the keys and its declared inputs, in date order, and
    returns a numeric Series aligned with the frame.
    """
    columns = ["trade_date", "symbol", *dict.fromkeys(inputs)]
    keys = partition_of(panel)
    extra = [k for k in keys if k not in columns]

    def run(pdf):
        pdf = pdf.sort_values("trade_date").reset_index(drop=True)
        values = function(pdf[columns].copy())
        if len(values) != len(pdf) or not values.index.equals(pdf.index):
            raise ValueError("a factor returns one value per input row, in order")
        if values.dtype.kind not in "fiu":
            raise TypeError("factor values are numeric")
        out = pdf[["trade_date", "symbol"]].copy()
        out["factor"] = values.astype("float64")
        return out

    result = panel.select(*columns, *extra).groupBy(*keys).applyInPandas(
        run, "trade_date date, symbol string, factor double"
    )
    return result


def contract_report(signals: DataFrame) -> DataFrame:
    """Counts a factor must satisfy: no infinity and at least one value."""
    value = F.col("factor")
    infinite = F.count_if(F.abs(value) == float("inf"))
    known = F.count_if(value.isNotNull() & ~F.isnan(value))
    return signals.agg(
        F.count("*").alias("rows"), infinite.alias("infinite_values"), known.alias("known_values")
    ).withColumn("passed", (F.col("infinite_values") == 0) & (F.col("known_values") > 0))


def look_ahead_report(panel: DataFrame, compute: Callable[[DataFrame], DataFrame], cutoff, tolerance: float = 1e-10) -> DataFrame:
    """Recompute on history up to ``cutoff`` and compare with the full run."""
    cutoff = F.lit(cutoff).cast("date") if not isinstance(cutoff, Column) else cutoff
    before = F.col("trade_date") <= cutoff
    full = compute(panel).where(before).select("trade_date", "symbol", F.col("factor").alias("full"))
    prefix = compute(panel.where(before)).select("trade_date", "symbol", F.col("factor").alias("prefix"))
    near = F.abs(F.col("full") - F.col("prefix")) <= tolerance * F.greatest(F.lit(1.0), F.abs("full"))
    same = F.coalesce(near, F.col("full").isNull() & F.col("prefix").isNull())
    return (
        full.join(prefix, ["trade_date", "symbol"], "full")
        .agg(F.count("*").alias("rows"), F.count_if(~same).alias("changed_rows"))
        .withColumn("passed", F.col("changed_rows") == 0)
    )
