"""The factor suite: one pass over the panel, every diagnostic grouped by factor."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import flag
from lattica.operators.adjust import adjusted_open
from lattica.operators.composite import equal_weight_composite
from lattica.operators.diagnostics import (
    annual_ic,
    coverage_gate,
    coverage_table,
    factor_correlation,
    hac_mean,
    information_coefficient,
    quantile_returns,
    stability_table,
    summarize_ic,
    top_minus_bottom,
)
from lattica.operators.factors import compute_factors
from lattica.operators.labels import add_execution_returns, add_forward_returns
from lattica.operators.portfolio import descending_rank
from lattica.operators.preprocess import preprocess
from lattica.operators.sections import WHOLE, Layout
from lattica.operators.universe import UniverseRule, apply_universe
from lattica.session import settle

LONG_KEYS = ("factor", "trade_date")


@dataclass(frozen=True)
class SuiteSettings:
    factors: dict[str, int]
    horizon: int = 5
    groups: int = 5
    minimum_coverage: float = 0.6
    minimum_valid: int = 1
    n_mad: float = 5.0
    neutralize_size: bool = False
    neutralize_industry: bool = False
    universe: UniverseRule = field(default_factory=UniverseRule)
    start: str | None = None
    recent_windows: tuple[int, ...] = ()
    min_observations: int = 10


@dataclass
class SuiteResult:
    long: DataFrame
    scores: DataFrame
    ic: DataFrame
    execution_ic: DataFrame
    summary: DataFrame
    annual: DataFrame
    quantiles: DataFrame
    coverage: DataFrame
    stability: DataFrame
    correlation: DataFrame
    latest: DataFrame


def prepare_market(panel: DataFrame, settings: SuiteSettings) -> DataFrame:
    return adjusted_open(apply_universe(panel, settings.universe))


def long_scores(panel: DataFrame, settings: SuiteSettings, layout: Layout = WHOLE) -> DataFrame:
    """``(factor, trade_date, symbol, ..., factor_processed, score, labels)``.

    Factors and labels share the symbol exchange; the unpivot adds no shuffle and all
    cross-section work is keyed by (factor, date).
    """
    names = list(settings.factors)
    market = compute_factors(prepare_market(panel, settings), names)
    market = add_execution_returns(add_forward_returns(market, (settings.horizon,), "adj_close"), (settings.horizon,))
    exposures = [c for c in ("market_cap", "industry") if c in market.columns]
    keep = ["trade_date", "symbol", "in_universe", "close", *exposures,
            f"forward_return_{settings.horizon}d", f"next_open_return_{settings.horizon}d"]
    long = market.select(*keep, *names).unpivot(keep, names, "factor", "value")
    long = preprocess(
        long, "value", settings.n_mad, settings.neutralize_size, settings.neutralize_industry, LONG_KEYS, layout
    )
    raw = long.withColumn("_ungated", F.col("factor_processed"))
    gated = coverage_gate(raw, "factor_processed", settings.minimum_coverage, LONG_KEYS, layout=layout)
    directions = F.create_map(*[F.lit(x) for pair in settings.factors.items() for x in pair])
    return gated.withColumn("score", F.col("factor_processed") * directions[F.col("factor")])


def wide_scores(long: DataFrame, names) -> DataFrame:
    """Back to one row per (date, symbol): a single aggregation."""
    once = [c for c in long.columns if c in ("in_universe", "close") or c.startswith(("forward_return", "next_open"))]
    return long.groupBy("trade_date", "symbol").agg(
        *[F.max(F.when(F.col("factor") == n, F.col("score"))).alias(n) for n in names],
        *[F.max(c).alias(c) for c in once],
    )


def run_suite(panel: DataFrame, settings: SuiteSettings, layout: Layout = WHOLE, cut: bool = True) -> SuiteResult:
    """Everything the suite reports. The long score table is materialised once."""
    names = list(settings.factors)
    close_label = f"forward_return_{settings.horizon}d"
    open_label = f"next_open_return_{settings.horizon}d"
    long = long_scores(panel, settings, layout)
    if cut:
        long = settle(long)
    since = F.lit(True) if settings.start is None else F.col("trade_date") >= F.lit(settings.start).cast("date")
    studied = long.where(since)
    per_year = 252.0 / settings.horizon
    ic = information_coefficient(
        studied, "factor_processed", close_label, LONG_KEYS, min_observations=settings.min_observations, layout=layout
    )
    execution = information_coefficient(
        studied, "factor_processed", open_label, LONG_KEYS, min_observations=settings.min_observations, layout=layout
    )
    groups = quantile_returns(studied, "factor_processed", close_label, settings.groups, LONG_KEYS, layout)
    directions = F.create_map(*[F.lit(x) for pair in settings.factors.items() for x in pair])
    hac = hac_mean(execution, "ic", max(settings.horizon - 1, 4), ("factor",))
    summary = (
        summarize_ic(ic, ("factor",), per_year)
        .join(hac, "factor")
        .join(top_minus_bottom(groups, ("factor",)), "factor", "left")
        .withColumn("direction", directions[F.col("factor")])
        .withColumn("oriented_mean_ic", F.col("mean_ic") * F.col("direction"))
        .withColumn("next_open_oriented_ic", F.col("hac_mean") * F.col("direction"))
    )
    oriented = information_coefficient(
        studied, "score", close_label, LONG_KEYS, min_observations=settings.min_observations, layout=layout
    )
    scores = equal_weight_composite(wide_scores(long, names), names, settings.minimum_valid, settings.start, layout)
    last = scores.agg(F.max("trade_date").alias("trade_date"))
    newest = scores.join(F.broadcast(last), "trade_date", "left_semi").where(flag("in_universe"))
    return SuiteResult(
        long=long,
        scores=scores,
        ic=ic,
        execution_ic=execution,
        summary=summary,
        annual=annual_ic(execution, ("factor",)),
        quantiles=groups,
        coverage=coverage_table(studied, "_ungated", settings.minimum_coverage, LONG_KEYS),
        stability=stability_table(oriented, settings.recent_windows),
        correlation=factor_correlation(scores.where(since), names, layout),
        latest=descending_rank(newest, "factor_processed", layout),
    )
