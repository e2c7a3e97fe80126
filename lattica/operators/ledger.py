"""Reconciliation of saved ledgers: equity, trades, positions, keyed by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import all_of, finite, flag

RTOL, ATOL = 1e-9, 1e-6

CHECKS = [
    "equity_finite_nonnegative",
    "trades_finite_nonnegative",
    "positions_finite_nonnegative",
    "positive_integer_shares",
    "valid_trade_sides",
    "positive_trade_prices",
    "dates_within_equity_calendar",
    "gross_equals_price_times_shares",
    "position_values_equal_marks_times_shares",
    "equity_equals_cash_plus_market_value",
    "daily_position_values_match_equity",
    "cash_reconciles_from_executions",
    "holdings_reconcile_from_executions",
    "never_short_from_executions",
    "execution_on_next_observed_session",
    "unique_equity_dates",
    "unique_position_keys",
]


def _far(actual: Column, expected: Column, largest: float | None = None) -> Column:
    """Further apart than rounding explains; ``largest``: no amount above it widens the tolerance."""
    size = F.abs(expected) if largest is None else F.least(F.abs(expected), F.lit(float(largest)))
    near = F.abs(actual - expected) <= ATOL + RTOL * size
    return ~F.coalesce(near, F.lit(False))


def _count(test: Column) -> Column:
    return F.count_if(test)


def _bad_numbers(columns) -> Column:
    return ~all_of(F.coalesce(finite(c) >= -1e-8, F.lit(False)) for c in columns)


def _whole(column: str) -> Column:
    c = finite(column)
    return F.coalesce((c > 0) & (c == F.floor(c)), F.lit(False))


def signed_shares() -> Column:
    return F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares"))


def cash_flow() -> Column:
    direction = F.when(F.col("side") == "SELL", F.col("gross")).otherwise(-F.col("gross"))
    return direction - F.col("fee") - F.col("tax")


def audit_ledger(equity: DataFrame, trades: DataFrame, positions: DataFrame, initial_cash: float, by=("run_id",)) -> DataFrame:
    """Seventeen named checks per run: ``(by..., check, violations, max_abs_error, passed)``.

    The books must start flat and see no outside cash. A run whose trades or positions have
    no equity rows is listed and fails ``equity_finite_nonnegative``. Holdings are compared interval
    by interval between executions, so the session x symbol grid is never built. Cash may be off
    by rounding of the initial cash at most, however far trading has moved the balance since.
    """
    if not initial_cash > 0:
        raise ValueError("initial_cash must be positive")
    by = list(by)
    order = W.partitionBy(*by).orderBy("trade_date")
    calendar = equity.select(*by, "trade_date").distinct().withColumn("_idx", F.row_number().over(order))

    # equity rows against trades and positions of the same session
    flows = trades.groupBy(*by, "trade_date").agg(F.sum(cash_flow()).alias("_flow"))
    held = positions.groupBy(*by, "trade_date").agg(F.sum("market_value").alias("_held"))
    book = (
        equity.join(flows, [*by, "trade_date"], "left")
        .join(held, [*by, "trade_date"], "left")
        .withColumn("_held", F.coalesce("_held", F.lit(0.0)))
        .withColumn(
            "_cash",
            F.lit(float(initial_cash))
            + F.sum(F.coalesce("_flow", F.lit(0.0))).over(order.rowsBetween(W.unboundedPreceding, 0)),
        )
    )
    total = F.col("cash") + F.col("market_value")
    per_equity = book.groupBy(*by).agg(
        _count(_bad_numbers(["cash", "market_value", "equity"])).alias("equity_finite_nonnegative"),
        _count(_far(F.col("equity"), total)).alias("equity_equals_cash_plus_market_value"),
        F.max(F.abs(F.col("equity") - total)).alias("_e_equity_equals_cash_plus_market_value"),
        _count(_far(F.col("market_value"), F.col("_held"))).alias("daily_position_values_match_equity"),
        F.max(F.abs(F.col("market_value") - F.col("_held"))).alias("_e_daily_position_values_match_equity"),
        _count(_far(F.col("cash"), F.col("_cash"), initial_cash)).alias("cash_reconciles_from_executions"),
        F.max(F.abs(F.col("cash") - F.col("_cash"))).alias("_e_cash_reconciles_from_executions"),
    )

    # trades
    signals = trades.select(*by, F.col("signal_date")).distinct()
    upcoming = _next_by_run(signals, calendar, by)
    checked = (
        trades.join(calendar.select(*by, "trade_date", F.lit(True).alias("_open")), [*by, "trade_date"], "left")
        .join(upcoming, [*by, "signal_date"], "left")
    )
    product = F.col("price") * F.col("shares")
    on_time = F.coalesce(flag("_signal_open") & (F.col("_next") == F.col("trade_date")), F.lit(False))
    per_trade = checked.groupBy(*by).agg(
        _count(_bad_numbers(["shares", "price", "gross", "fee", "tax"])).alias("trades_finite_nonnegative"),
        _count(~_whole("shares")).alias("_whole_t"),
        _count(~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False))).alias("valid_trade_sides"),
        _count(~F.coalesce(F.col("price") > 0, F.lit(False))).alias("positive_trade_prices"),
        _count(~flag("_open")).alias("_open_t"),
        _count(_far(F.col("gross"), product)).alias("gross_equals_price_times_shares"),
        F.max(F.abs(F.col("gross") - product)).alias("_e_gross_equals_price_times_shares"),
        _count(~on_time).alias("execution_on_next_observed_session"),
    )

    # positions
    marked = positions.join(
        calendar.select(*by, "trade_date", F.lit(True).alias("_open")), [*by, "trade_date"], "left"
    )
    worth = F.col("close") * F.col("shares")
    per_position = marked.groupBy(*by).agg(
        _count(_bad_numbers(["shares", "close", "market_value"])).alias("positions_finite_nonnegative"),
        _count(~_whole("shares")).alias("_whole_p"),
        _count(~flag("_open")).alias("_open_p"),
        _count(_far(F.col("market_value"), worth)).alias("position_values_equal_marks_times_shares"),
        F.max(F.abs(F.col("market_value") - worth)).alias("_e_position_values_equal_marks_times_shares"),
    )
    per_holding = _holdings(calendar, trades, positions, by)
    once = [
        rows.groupBy(*by, *key).agg((F.count("*") - 1).alias("_more")).groupBy(*by).agg(F.sum("_more").alias(name))
        for rows, key, name in (
            (equity, ["trade_date"], "unique_equity_dates"),
            (positions, ["trade_date", "symbol"], "unique_position_keys"),
        )
    ]

    wide = calendar.groupBy(*by).agg(F.count("*").alias("_sessions"))
    if by:
        runs = trades.select(*by).unionByName(positions.select(*by)).distinct()
        wide = wide.join(runs, by, "full")
    for part in (per_equity, per_trade, per_position, per_holding, *once):
        wide = wide.join(part, by, "left") if by else wide.join(part, F.lit(True), "left")
    zero = F.lit(0)
    wide = wide.withColumns(
        {
            "equity_finite_nonnegative": F.coalesce("equity_finite_nonnegative", zero) + F.when(F.coalesce("_sessions", zero) == 0, 1).otherwise(0),
            "positive_integer_shares": F.coalesce("_whole_t", zero) + F.coalesce("_whole_p", zero),
            "dates_within_equity_calendar": F.coalesce("_open_t", zero) + F.coalesce("_open_p", zero),
        }
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.coalesce(F.col(name), zero).cast("long").alias("violations"),
                (F.coalesce(F.col(f"_e_{name}"), F.lit(0.0)) if f"_e_{name}" in wide.columns else F.lit(None).cast("double")).alias(
                    "max_abs_error"
                ),
            )
            for name in CHECKS
        ]
    )
    return wide.select(*by, F.inline(rows)).withColumn("passed", F.col("violations") == 0)


def _next_by_run(signals: DataFrame, calendar: DataFrame, by) -> DataFrame:
    """Next session of each run after its signal date; run calendars are short lists."""
    marks = calendar.select(*by, F.col("trade_date").alias("at"), F.col("trade_date").alias("_s"), F.lit(0).alias("side"))
    asks = signals.select(*by, F.col("signal_date").alias("at"), F.lit(None).cast("date").alias("_s"), F.lit(1).alias("side"))
    order = W.partitionBy(*by).orderBy("at", "side")
    back = W.partitionBy(*by).orderBy(F.desc("at"), F.desc("side"))
    same = F.last("_s", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        marks.unionByName(asks)
        .withColumns(
            {
                "_next": F.last("_s", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)),
                "_signal_open": same == F.col("at"),
            }
        )
        .where("side = 1")
        .select(*by, F.col("at").alias("signal_date"), "_next", "_signal_open")
    )


def _holdings(calendar: DataFrame, trades: DataFrame, positions: DataFrame, by) -> DataFrame:
    """Compare positions with the running sum of executions.

    Positions are matched to the execution interval they fall in; an interval with a
    non-zero expected holding must have one position row per session.
    """
    keys = [*by, "symbol"]
    length = calendar.groupBy(*by).agg(F.max("_idx").alias("_last"))
    changes = (
        trades.groupBy(*keys, "trade_date")
        .agg(F.sum(signed_shares()).alias("_net"))
        .join(calendar, [*by, "trade_date"])
    )
    rows = positions.join(calendar, [*by, "trade_date"]).select(*keys, "_idx", F.col("shares").alias("_actual"))
    events = changes.select(*keys, "_idx", "_net").join(rows, [*keys, "_idx"], "full")
    order = W.partitionBy(*keys).orderBy("_idx")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumns(
        {
            "_expected": F.sum(F.coalesce("_net", F.lit(0.0))).over(so_far),
            "_next_idx": F.lead("_idx").over(order),
        }
    )
    events = events.join(length, by) if by else events.join(length, F.lit(True))
    # sessions up to the next event (or the end) that carry no row of their own
    silent = F.coalesce("_next_idx", F.col("_last") + 1) - F.col("_idx") - 1
    actual = F.coalesce("_actual", F.lit(0.0))
    gap = F.abs(actual - F.col("_expected"))
    unreported = F.when((silent > 0) & _far(F.lit(0.0), F.col("_expected")), silent).otherwise(F.lit(0))
    return events.groupBy(*by).agg(
        F.sum(F.when(_far(actual, F.col("_expected")), F.lit(1)).otherwise(F.lit(0)) + unreported).alias(
            "holdings_reconcile_from_executions"
        ),
        F.max(F.greatest(gap, F.when(silent > 0, F.abs("_expected")).otherwise(F.lit(0.0)))).alias(
            "_e_holdings_reconcile_from_executions"
        ),
        F.sum(F.when(F.col("_expected") < 0, 1 + silent).otherwise(F.lit(0))).alias("never_short_from_executions"),
    )


def profit_bridge(equity: DataFrame, trades: DataFrame, initial_cash: float, by=("run_id",)) -> DataFrame:
    """Net profit, explicit fees and taxes, and profit before them."""
    by = list(by)
    end = equity.groupBy(*by).agg(
        F.count("*").alias("sessions"), (F.max_by("equity", "trade_date") - float(initial_cash)).alias("net_profit")
    )
    paid = trades.groupBy(*by).agg(
        F.count("*").alias("trade_count"), F.sum(F.col("fee") + F.col("tax")).alias("explicit_costs")
    )
    joined = end.join(paid, by, "left") if by else end.join(paid, F.lit(True), "left")
    return joined.select(
        *by,
        "sessions",
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
        "net_profit",
        F.coalesce("explicit_costs", F.lit(0.0)).alias("explicit_costs"),
        (F.col("net_profit") + F.coalesce("explicit_costs", F.lit(0.0))).alias("profit_before_costs"),
    )


def strategy_diagnostics(
    equity: DataFrame, trades: DataFrame, positions: DataFrame, issues: DataFrame, targets: DataFrame,
    initial_cash: float, by=("run_id",),
) -> DataFrame:
    """Trade, rebalance, holding, cash and event counts per run."""
    by = list(by)
    base = equity.groupBy(*by).agg(
        F.count("*").alias("_sessions"), F.avg(F.try_divide("cash", "equity")).alias("average_cash_ratio")
    )
    parts = [
        trades.groupBy(*by).agg(
            F.count("*").alias("trade_count"), F.sum(F.col("fee") + F.col("tax")).alias("total_cost")
        ),
        # distinct names per held session, averaged over all sessions (an empty one is 0)
        positions.groupBy(*by, "trade_date").agg(F.countDistinct("symbol").alias("_n")).groupBy(*by).agg(F.sum("_n").alias("_held")),
        issues.groupBy(*by).agg(
            F.count_if(F.col("side").isin("BUY", "SELL", "REBALANCE")).alias("unfilled_events"),
            F.count_if(F.col("side") == "VALUATION").alias("stale_valuation_events"),
            F.count_if(F.col("side") == "CORPORATE_ACTION").alias("corporate_action_events"),
        ),
        targets.groupBy(*by, "trade_date").agg(F.count("*").alias("_n")).groupBy(*by).agg(
            F.count("*").alias("rebalance_count"), F.avg("_n").alias("average_target_holdings")
        ),
    ]
    for part in parts:
        base = base.join(part, by, "left") if by else base.join(part, F.lit(True), "left")
    zero = F.lit(0)
    return base.select(
        *by,
        F.coalesce("trade_count", zero).alias("trade_count"),
        F.coalesce("rebalance_count", zero).alias("rebalance_count"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        (F.coalesce("_held", zero) / F.col("_sessions")).alias("average_holdings"),
        "average_target_holdings",
        "average_cash_ratio",
        (F.coalesce("total_cost", F.lit(0.0)) / float(initial_cash)).alias("cost_to_initial_cash"),
        F.coalesce("unfilled_events", zero).alias("unfilled_events"),
        F.coalesce("stale_valuation_events", zero).alias("stale_valuation_events"),
        F.coalesce("corporate_action_events", zero).alias("corporate_action_events"),
    )

