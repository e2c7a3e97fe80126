"""Composed studies: latest scoring, single-factor study, grids, dataset builds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import all_of, flag, present, row_mean
from lattica.functions.trading import Costs
from lattica.operators.adjust import (
    fill_suspensions,
    inferred_listing,
    limit_flags,
    normalized_to_latest,
    price_chain,
)
from lattica.operators.diagnostics import (
    ic_decay,
    information_coefficient,
    quantile_returns,
    rank_autocorrelation,
    summarize_ic,
    top_group_turnover,
)
from lattica.operators.factors import compute_factors, momentum, Factor, Frames, PRICE, price_column, partition_of
from lattica.operators.labels import add_forward_returns
from lattica.operators.merging import merge_sources, raw_with_adjusted
from lattica.operators.performance import (
    equal_weight_benchmark,
    nav,
    TRADED,
    performance_metrics,
    portfolio_returns,
)
from lattica.operators.portfolio import buffered_top_n, descending_rank, top_n_weights
from lattica.operators.preprocess import preprocess, zscore
from lattica.operators.quality import acceptance, audit_panel, bad_ohlc, validate_panel
from lattica.operators.sections import WHOLE, Layout
from lattica.operators.universe import (
    UniverseRule,
    apply_universe,
    attach_membership,
    attach_membership_backfilled,
    attach_shared_memberships,
)
from lattica.schema import KNOWN
from lattica.session import settle

__all__ = [
    "latest_cross_section", "score_latest", "momentum_study", "momentum_grid", "holdings_grid", "universe_size",
    "build_dataset", "build_small_dataset", "consolidate_panel",
]


def latest_cross_section(panel: DataFrame, min_listed_days: int = 120, min_amount: float = 0.0) -> DataFrame:
    """Rows of the last date with ``in_universe`` from its own statuses."""
    last = panel.agg(F.max("trade_date").alias("trade_date"))
    tests = [
        flag("in_index"),
        ~flag("is_st"),
        ~flag("is_suspended"),
        F.coalesce(F.col("listing_age_sessions") + 1 >= min_listed_days, F.lit(False)),
        F.coalesce(F.col("amount") >= min_amount, F.lit(False)),
        *[flag(c) for c in KNOWN],
    ]
    if "amount_outside_price_range" in panel.columns:
        tests.append(~flag("amount_outside_price_range"))
    return panel.join(F.broadcast(last), "trade_date", "left_semi").withColumn("in_universe", all_of(tests))


def score_latest(
    panel: DataFrame, factors: dict[str, int], min_listed_days: int = 120, min_amount: float = 0.0,
    minimum_coverage: float = 0.8, minimum_valid: int = 1, n_mad: float = 5.0, layout: Layout = WHOLE,
) -> DataFrame:
    """Composite score and rank of the last date; thin factors are left out.

    Factors need history, so they run over the panel and only the last date is kept;
    every later step touches one cross-section.
    """
    names = list(factors)
    history = compute_factors(panel.drop("in_universe"), names)
    latest = latest_cross_section(history, min_listed_days, min_amount)
    long = latest.unpivot(["trade_date", "symbol", "in_universe", "close"], names, "factor", "value")
    long = long.withColumn("value", F.when(F.col("in_universe"), F.col("value")))
    keys = ("factor", "trade_date")
    long = preprocess(long, "value", n_mad, False, False, keys, layout)
    members = F.count_if("in_universe")
    shares = long.groupBy("factor").agg(F.try_divide(F.count("value"), members).alias("coverage"))
    directions = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    score = F.when(F.col("coverage") >= minimum_coverage, F.col("factor_processed") * directions[F.col("factor")])
    scored = long.join(F.broadcast(shares), "factor").withColumn("score", score)  # one row per factor
    wide = scored.groupBy("trade_date", "symbol", "in_universe", "close").agg(
        *[F.max(F.when(F.col("factor") == n, F.col("score"))).alias(n) for n in names]
    )
    count = present(names)
    raw = F.when((count >= minimum_valid) & F.col("in_universe"), row_mean(names))
    wide = wide.withColumns({"valid_factor_count": count, "composite_raw": raw})
    wide = zscore(wide, "composite_raw", "factor_processed", layout=layout)
    return descending_rank(wide, "factor_processed", layout)


def _momentum_signal(market: DataFrame, lookback: int, skip: int) -> DataFrame:
    frames = Frames(partition_of(market))
    own = Factor("momentum", ("close",), lookback, momentum(lookback, skip))
    return market.withColumn(PRICE, price_column(market.columns)).withColumn("factor", own.build(frames)).drop(PRICE)


@dataclass
class MomentumStudy:
    audit: DataFrame
    ic: DataFrame
    summary: DataFrame
    decay: DataFrame
    quantiles: DataFrame
    persistence: DataFrame
    turnover: DataFrame
    weights: DataFrame
    benchmark: DataFrame
    size: DataFrame


def momentum_study(
    panel: DataFrame, lookback: int = 60, skip: int = 5, top_n: int = 20, rule: UniverseRule | None = None,
    horizons=(1, 5, 10, 20), layout: Layout = WHOLE,
) -> MomentumStudy:
    """Audit, adjust, universe, factor, diagnostics and benchmark of one momentum factor."""
    market = apply_universe(normalized_to_latest(panel), rule or UniverseRule())
    signal = _momentum_signal(market, lookback, skip)
    signal = signal.withColumn("factor", F.when(F.col("in_universe"), F.col("factor")))
    signal = preprocess(signal, "factor", layout=layout)
    labeled = add_forward_returns(signal, (5,), "close")
    ic = information_coefficient(labeled, "factor_processed", "forward_return_5d", layout=layout)
    return MomentumStudy(
        audit=audit_panel(panel),
        ic=ic,
        summary=summarize_ic(ic),
        decay=ic_decay(signal, "factor_processed", horizons, layout=layout),
        quantiles=quantile_returns(labeled, "factor_processed", "forward_return_5d", layout=layout),
        persistence=rank_autocorrelation(signal, "factor_processed", layout=layout),
        turnover=top_group_turnover(signal, "factor_processed", layout=layout),
        weights=top_n_weights(signal, "factor_processed", top_n, max_weight=max(0.03, 1.0 / max(1, top_n))),
        benchmark=equal_weight_benchmark(market, 1_000_000.0, price="close"),
        size=universe_size(market, top_n),
    )


def universe_size(df: DataFrame, top_n: int) -> DataFrame:
    """Median daily universe size and the top N it can support."""
    daily = df.groupBy("trade_date").agg(F.count_if(flag("in_universe")).alias("_n"))
    return daily.agg(F.median("_n").alias("median_universe")).withColumn(
        "effective_top_n", F.least(F.lit(top_n), F.floor("median_universe")).cast("int")
    )


def momentum_grid(panel: DataFrame, variants, top_n: int, costs: Costs | None = None, layout: Layout = WHOLE) -> DataFrame:
    """(lookback, skip, frequency) variants evaluated together.

    All lookbacks are columns of one window pass; the variant id is a key of the IC,
    weight and return steps.
    """
    market = apply_universe(panel, UniverseRule(min_listed_days=1))
    market = settle(market.select(*[c for c in market.columns if c in {*TRADED, *partition_of(market), "close", "adj_factor"}]))  # read by the signals and the returns
    frames = Frames(partition_of(market))
    pairs = sorted({(lb, sk) for lb, sk, _ in variants})
    signals = market.withColumn(PRICE, price_column(market.columns)).withColumns(
        {f"m_{lb}_{sk}": momentum(lb, sk)(frames) for lb, sk in pairs}
    )
    signals = add_forward_returns(signals, (5,), "adj_close")
    names = [f"m_{lb}_{sk}" for lb, sk in pairs]
    long = signals.unpivot(["trade_date", "symbol", "forward_return_5d"], names, "pair", "value")
    long = preprocess(long, "value", 5.0, False, False, ("pair", "trade_date"), layout)
    long = settle(long.select("pair", "trade_date", "symbol", "forward_return_5d", "factor_processed"))  # read by the IC and by every frequency
    ic = information_coefficient(long, "factor_processed", "forward_return_5d", ("pair", "trade_date"), layout=layout)
    by_pair = ic.groupBy("pair").agg(
        F.avg("ic").alias("mean_rank_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_win_rate")
    )
    weights = None
    for frequency in sorted({f for _, _, f in variants}):
        tag = F.concat("pair", F.lit("_"), F.lit(frequency))
        wanted = [f"m_{lb}_{sk}" for lb, sk, f in variants if f == frequency]
        part = top_n_weights(
            long.where(F.col("pair").isin(wanted)).withColumn("variant", tag), "factor_processed", top_n, frequency,
            max(0.03, 1.0 / max(1, top_n)), by=("variant", "pair"),
        )
        weights = part if weights is None else weights.unionByName(part)
    returns = nav(portfolio_returns(market, weights, costs, by=("variant", "pair")), by=("variant", "pair"))
    metrics = performance_metrics(returns, by=("variant", "pair"))
    return metrics.join(F.broadcast(by_pair), "pair").drop("pair")  # one row per lookback pair


def holdings_grid(
    panel: DataFrame, signals: DataFrame, signal: str, holdings=(5, 10, 20), frequencies=("W-FRI", "M"),
    exit_rank: int = 30, base_top_n: int = 20, base_frequency: str = "W-FRI", cost_factor: float = 2.0,
    max_weight: float = 0.10, costs: Costs | None = None,
) -> DataFrame:
    """Change one dimension at a time: holdings, frequency, cost.

    Every variant is the buffered strategy with its own dates. Invalid ones stay as rows.
    """
    costs = costs or Costs()
    spark = panel.sparkSession
    cases = [("baseline", base_top_n, base_frequency, 1.0)]
    cases += [(f"holdings_{n}", n, base_frequency, 1.0) for n in holdings if exit_rank >= n]
    cases += [(f"frequency_{f}", base_top_n, f, 1.0) for f in frequencies]
    cases.append(("scaled_cost", base_top_n, base_frequency, cost_factor))
    invalid = [(f"holdings_{n}", "invalid") for n in holdings if exit_rank < n]
    variants = spark.createDataFrame(cases, "case string, top_n int, frequency string, cost_factor double")
    best = settle(signals.where(F.col(signal).isNotNull()).select("trade_date", "symbol", signal))
    weights = None
    for n, frequency in sorted({c[1:3] for c in cases}):
        part = buffered_top_n(best, signal, n, max(exit_rank, n), frequency, max_weight)
        mine = variants.where((F.col("top_n") == n) & (F.col("frequency") == frequency)).select("case")
        part = part.join(F.broadcast(mine), F.lit(True))  # the cases that hold these weights
        weights = part if weights is None else weights.unionByName(part)
    weights = settle(weights).select("case", "trade_date", "symbol", "target_weight")
    returns = portfolio_returns(panel, weights, costs, by=("case",))
    scaled = returns.join(F.broadcast(variants.select("case", "cost_factor")), "case").withColumn(
        "net_return", F.col("gross_return") - F.col("cost") * F.col("cost_factor")
    )
    metrics = performance_metrics(nav(scaled, by=("case",)), by=("case",))
    done = metrics.withColumn("status", F.when(F.col("valid"), "ready").otherwise("failed"))
    if invalid:
        done = done.unionByName(spark.createDataFrame(invalid, "case string, status string"), allowMissingColumns=True)
    return done


# --- dataset builds -------------------------------------------------------------


@dataclass
class BuiltDataset:
    panel: DataFrame
    acceptance: DataFrame
    refusals: DataFrame


def build_dataset(
    a: DataFrame, b: DataFrame, sessions: DataFrame, basics: DataFrame, memberships: DataFrame, labels: dict[str, str],
    preferred: str,
) -> BuiltDataset:
    """Two sources to the canonical panel: merge, chain, memberships, acceptance.

    ``refusals`` counts what blocks activation; the caller writes the panel only when
    all counts are zero and ``acceptance.accepted`` is true.
    """
    merged = merge_sources(a, b)
    panel = price_chain(merged, sessions, basics)
    panel = attach_shared_memberships(panel, memberships, labels, "in_any_index", allow_partial=True)
    label = labels[preferred]
    panel = panel.withColumns(
        {
            "in_index": F.col(f"in_{label}"),
            "membership_complete": F.col(f"{label}_membership_complete"),
            "membership_date": F.col(f"{label}_membership_date"),
            "is_usable_market_data": ~F.col("amount_outside_price_range"),
        }
    )
    prices = ["open", "high", "low", "close", "adj_open", "adj_close"]
    unresolved = ~all_of(F.coalesce(F.col(c) > 0, F.lit(False)) for c in prices)
    refusals = panel.agg(
        F.count_if(unresolved).alias("unresolved_prices"),
        F.count_if(~(flag("is_st_known") & flag("is_suspended_known"))).alias("unknown_status"),
        F.count_if(~flag("is_suspended") & (F.col("volume").isNull() | F.col("amount").isNull())).alias("unresolved_activity"),
        F.count_if(bad_ohlc()).alias("invalid_ohlc"),
    )
    source = merged.agg(F.count("*").alias("source_rows"))
    return BuiltDataset(panel, acceptance(panel, source), refusals)


def build_small_dataset(bars: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suspension marks, membership, validation and audit of single-source bars."""
    panel = attach_membership(fill_suspensions(bars), snapshots)
    return panel, validate_panel(panel), audit_panel(panel)


def consolidate_panel(raw: DataFrame, adjusted: DataFrame, snapshots: DataFrame, end=None) -> DataFrame:
    """Raw and adjusted bars to a panel with inferred listing, limits and membership."""
    paired = raw_with_adjusted(raw, adjusted)
    if end is not None:
        paired = paired.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return attach_membership_backfilled(limit_flags(inferred_listing(paired)), snapshots)


