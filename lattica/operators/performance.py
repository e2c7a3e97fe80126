"""Weights to returns, NAV and metrics; execution and valuation reports.

Everything is keyed by run (``by``); a run has one row per session, so run windows
are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import finite, flag, positive, ratio
from lattica.functions.trading import Costs, data_issue, stamp_rate, transfer_rate
from lattica.operators.calendars import next_session, session_list
from lattica.session import settle


def effective_schedule(signal_dates: DataFrame, sessions: DataFrame, by=()) -> DataFrame:
    """Per run and session: the execution in force (``exec_date``) and the one before it.

    Each run follows its own signal dates only, whatever runs stand beside it.
    """
    by = list(by)
    signals = signal_dates.select(*by, F.col("trade_date").alias("signal_date")).distinct()
    executed = next_session(signals.select(F.col("signal_date").alias("trade_date")), sessions).where("exec_date IS NOT NULL")
    # two signals before the same session: the later one stands
    schedule = signals.join(F.broadcast(executed), "signal_date")  # one row per signal date
    schedule = schedule.groupBy(*by, "exec_date").agg(F.max("signal_date").alias("signal_date"))
    grid = sessions.select("trade_date")
    if by:
        grid = F.broadcast(grid).join(signals.select(*by).distinct(), F.lit(True))  # runs x sessions: the output's own size
    schedule = schedule.withColumn("is_execution", F.lit(True)).withColumnRenamed("exec_date", "trade_date")
    marked = grid.join(schedule, [*by, "trade_date"], "left")
    order = W.partitionBy(*by).orderBy("trade_date")  # one row per session
    return marked.select(
        *by,
        "trade_date",
        F.last("signal_date", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("signal_date"),
        F.last("signal_date", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("prior_signal"),
        F.coalesce("is_execution", F.lit(False)).alias("is_execution"),
    ).where("signal_date IS NOT NULL")


#: Columns of a market that returns and blocked trades depend on.
TRADED = (
    "trade_date", "symbol", "adj_open", "adj_close", "open", "is_suspended", "is_limit_up", "is_limit_down", "is_usable_market_data",
    "is_st_known", "is_suspended_known", "limit_status_known", "up_limit", "down_limit",
)


def portfolio_returns(market: DataFrame, weights: DataFrame, costs: Costs | None = None, by=()) -> DataFrame:
    """Return per run and session of weights that trade at the next session's open.

    On an execution session the old weights earn the overnight move and the new ones
    the move from the open; on others the weights in force earn close to close. A name that
    cannot trade at an execution keeps the weight it has (see ``executed_weights``).
    Proportional costs (commission, transfer, stamp duty on sales, slippage) are
    charged on turnover. This is a weight-based estimate: board lots, partial fills
    and idle cash from rounding are outside it.
    """
    costs = costs or Costs()
    by = list(by)
    sessions = settle(session_list(market))
    weights = settle(weights.select(*by, "trade_date", "symbol", "target_weight"))  # read for the dates, the targets and what they replace
    names = weights.select("symbol").distinct()
    # only names that are ever held have returns or trades; the calendar is everybody's
    market = settle(market.select(*[c for c in market.columns if c in TRADED]).join(names, "symbol", "left_semi"))
    schedule = settle(effective_schedule(weights, sessions, by))
    weights = settle(executed_weights(weights, market, schedule, by))  # read for the weights in force, those leaving, and turnover
    previous = F.lag("adj_close").over(W.partitionBy("symbol").orderBy("trade_date"))
    moves = market.select(
        "trade_date",
        "symbol",
        (ratio("adj_close", positive("adj_open")) - 1).alias("_day"),
        (ratio("adj_open", positive(previous)) - 1).alias("_night"),
        (ratio("adj_close", positive(previous)) - 1).alias("_full"),
    )
    held = weights.select(*by, F.col("trade_date").alias("signal_date"), "symbol", F.col("target_weight").alias("w"))
    current = schedule.join(held, [*by, "signal_date"]).select(
        *by, "trade_date", "symbol", "w", F.when(F.col("is_execution"), "day").otherwise("full").alias("_part")
    )
    leaving = (
        schedule.where("is_execution AND prior_signal IS NOT NULL")
        .select(*by, "trade_date", F.col("prior_signal").alias("signal_date"))
        .join(held, [*by, "signal_date"])
        .select(*by, "trade_date", "symbol", "w", F.lit("night").alias("_part"))
    )
    move = F.when(F.col("_part") == "day", F.col("_day")).when(F.col("_part") == "night", F.col("_night")).otherwise(F.col("_full"))
    earned = (
        current.unionByName(leaving)
        .join(moves, ["trade_date", "symbol"])
        .groupBy(*by, "trade_date")
        .agg(F.sum(F.col("w") * F.coalesce(move, F.lit(0.0))).alias("gross_return"))
    )
    traded = turnover(weights, schedule, by)
    buy = costs.commission_rate + costs.slippage
    charged = traded.withColumn(
        "cost",
        F.col("bought") * (transfer_rate("trade_date", costs) + buy)
        + F.col("sold") * (transfer_rate("trade_date", costs) + stamp_rate("trade_date", costs) + buy),
    )
    grid = schedule.select(*by, "trade_date")
    return (
        grid.join(earned, [*by, "trade_date"], "left")
        .join(charged, [*by, "trade_date"], "left")
        .select(
            *by,
            "trade_date",
            F.coalesce("gross_return", F.lit(0.0)).alias("gross_return"),
            F.coalesce("cost", F.lit(0.0)).alias("cost"),
            F.coalesce(F.col("bought") + F.col("sold"), F.lit(0.0)).alias("turnover"),
        )
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
    )


def trade_blocks(market: DataFrame) -> DataFrame:
    """``(trade_date, symbol, no_buy, no_sell)`` per bar: unusable data, suspensions and price limits."""
    columns = market.columns
    if "open" in columns:
        issue = data_issue(columns).isNotNull()
    else:
        issue = F.coalesce(finite("adj_open") <= 0, F.lit(True))
    state = lambda name: flag(name) if name in columns else F.lit(False)
    stopped = issue | state("is_suspended")
    return market.select("trade_date", "symbol", (stopped | state("is_limit_up")).alias("no_buy"), (stopped | state("is_limit_down")).alias("no_sell"))


def executed_weights(weights: DataFrame, market: DataFrame, schedule: DataFrame, by=()) -> DataFrame:
    """The weights that stand after each execution, by its signal date.

    A name without a bar on the session, with an unusable or suspended one, or at the price
    limit of its side does not trade: its old weight stays, and the next execution tries
    again with that execution's target. Only names that are blocked at a wanted change are
    followed through all executions (a fold over their run's execution dates); all others
    stand at their targets. A blocked sale can leave the total above the targets' total.
    """
    by = list(by)
    steps = schedule.where("is_execution").select(*by, F.col("trade_date").alias("exec_date"), "signal_date", "prior_signal")
    held = weights.select(*by, F.col("trade_date").alias("signal_date"), "symbol", F.col("target_weight").alias("w"))
    key = [*by, "signal_date"]
    targets = steps.join(held, key).select(*key, "exec_date", "symbol", "w")
    before = steps.where("prior_signal IS NOT NULL").select(*key, "exec_date", F.col("prior_signal").alias("_prior")).join(
        held.withColumnRenamed("signal_date", "_prior"), [*by, "_prior"]
    ).select(*key, "exec_date", "symbol", F.col("w").alias("_was"))
    bars = trade_blocks(market).withColumnRenamed("trade_date", "exec_date").withColumn("_bar", F.lit(True))
    no_buy, no_sell = (F.col("_bar").isNull() | flag(c) for c in ("no_buy", "no_sell"))
    zero = F.lit(0.0)
    change = targets.join(before, [*key, "exec_date", "symbol"], "full").withColumn("_move", F.coalesce("w", zero) - F.coalesce("_was", zero))
    blocked = change.where("_move <> 0").join(bars, ["exec_date", "symbol"], "left").where(((F.col("_move") > 0) & no_buy) | ((F.col("_move") < 0) & no_sell))
    stuck = settle(blocked.select(*by, "symbol").distinct())
    free = targets.join(stuck, [*by, "symbol"], "left_anti").select(*key, "symbol", "w")

    each = steps.join(stuck, by) if by else steps.join(stuck, F.lit(True))  # executions x blocked names
    path = each.join(held, [*key, "symbol"], "left").join(bars, ["exec_date", "symbol"], "left")
    step = F.struct("exec_date", "signal_date", F.coalesce("w", zero).alias("goal"), no_buy.alias("no_buy"), no_sell.alias("no_sell"))
    path = path.groupBy(*by, "symbol").agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    start = F.struct(zero.alias("w"), F.array().cast("array<struct<signal_date:date,w:double>>").alias("log"))

    def trade(state: Column, step: Column) -> Column:
        stays = ((step["goal"] > state["w"]) & step["no_buy"]) | ((step["goal"] < state["w"]) & step["no_sell"])
        w = F.when(stays, state["w"]).otherwise(step["goal"])
        return F.struct(w.alias("w"), F.concat(state["log"], F.array(F.struct(step["signal_date"].alias("signal_date"), w.alias("w")))).alias("log"))

    followed = path.select(*by, "symbol", F.inline(F.aggregate("_steps", start, trade, lambda s: s["log"]))).where("w <> 0")
    return free.unionByName(followed.select(*key, "symbol", "w")).select(*by, F.col("signal_date").alias("trade_date"), "symbol", F.col("w").alias("target_weight"))


def turnover(weights: DataFrame, schedule: DataFrame, by=()) -> DataFrame:
    """Weight bought and sold at each execution session."""
    by = list(by)
    steps = schedule.where("is_execution").select(*by, "trade_date", "signal_date", "prior_signal")
    held = weights.select(*by, F.col("trade_date").alias("signal_date"), "symbol", F.col("target_weight").alias("w"))
    key = [*by, "signal_date"]
    new = steps.select(*key, "trade_date").join(held, key).select(*by, "trade_date", "symbol", F.col("w").alias("_d"))
    old = (
        steps.where("prior_signal IS NOT NULL")
        .select(*by, "trade_date", F.col("prior_signal").alias("signal_date"))
        .join(held, key)
        .select(*by, "trade_date", "symbol", (-F.col("w")).alias("_d"))
    )
    change = new.unionByName(old).groupBy(*by, "trade_date", "symbol").agg(F.sum("_d").alias("_d"))
    return change.groupBy(*by, "trade_date").agg(
        F.sum(F.greatest("_d", F.lit(0.0))).alias("bought"), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).alias("sold")
    )


def nav(returns: DataFrame, initial: float = 1.0, by=(), value: str = "net_return") -> DataFrame:
    """Compounded equity per run."""
    path = W.partitionBy(*by).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return returns.withColumn("equity", F.lit(float(initial)) * F.product(1 + F.col(value)).over(path))


def with_drawdown(equity: DataFrame, by=()) -> DataFrame:
    path = W.partitionBy(*by).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return equity.withColumn("drawdown", ratio("equity", F.max("equity").over(path)) - 1)


def normalized_nav(equity: DataFrame, by=()) -> DataFrame:
    path = W.partitionBy(*by).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return equity.withColumn("nav", ratio("equity", F.first("equity").over(path)))


def performance_metrics(equity: DataFrame, periods_per_year: int = 252, by=()) -> DataFrame:
    """Total and annual return, volatility, Sharpe, drawdown, Calmar per run.

    ``valid`` is false for tables that cannot be measured (missing, negative or
    recovered-from-zero equity, repeated dates, fewer than two rows); their metrics
    are NULL.
    """
    by = list(by)
    order = W.partitionBy(*by).orderBy("trade_date")
    value = finite("equity")
    before = F.lag(value).over(order)
    path = with_drawdown(equity, by).withColumns({"_v": value, "_p": before})
    change = F.when((F.col("_p") == 0) & (F.col("_v") == 0), F.lit(0.0)).otherwise(ratio("_v", "_p") - 1)
    path = path.withColumn("_r", F.when(F.col("_p").isNotNull(), change))
    per = path.groupBy(*by).agg(
        F.count("*").alias("_rows"),
        F.countDistinct("trade_date").alias("_dates"),
        F.count("_v").alias("_known"),
        F.count_if(F.col("_v") < 0).alias("_negative"),
        F.count_if((F.col("_p") == 0) & (F.col("_v") > 0)).alias("_revived"),
        F.min_by("_v", "trade_date").alias("_start"),
        F.max_by("_v", "trade_date").alias("_end"),
        F.avg("_r").alias("_mean"),
        F.stddev_samp("_r").alias("_std"),
        F.min("drawdown").alias("_dd"),
    )
    valid = (
        (F.col("_rows") >= 2)
        & (F.col("_rows") == F.col("_dates"))
        & (F.col("_rows") == F.col("_known"))
        & (F.col("_negative") == 0)
        & (F.col("_revived") == 0)
        & (F.col("_start") > 0)
    )
    per = per.withColumn("valid", F.coalesce(valid, F.lit(False)))
    total = F.when(F.col("valid"), ratio("_end", "_start") - 1)
    years = (F.col("_rows") - 1) / periods_per_year
    annual = F.when(F.col("valid"), F.pow(1 + total, 1 / F.when(years > 0, years)) - 1)
    scale = float(periods_per_year) ** 0.5
    return per.select(
        *by,
        "valid",
        total.alias("total_return"),
        annual.alias("annual_return"),
        F.when(F.col("valid"), F.col("_std") * scale).alias("annual_volatility"),
        F.when(F.col("valid") & (F.col("_std") > 0), ratio("_mean", "_std") * scale).alias("sharpe"),
        F.when(F.col("valid"), F.col("_dd")).alias("max_drawdown"),
        F.when(F.col("_dd") < 0, ratio(annual, F.abs("_dd"))).alias("calmar"),
    )


def traded_turnover(trades: DataFrame, equity: DataFrame, by=()) -> DataFrame:
    """Sum of gross / 2 / mean equity; 0 without trades, NULL without positive equity."""
    mean = equity.groupBy(*by).agg(F.avg("equity").alias("_mean"))
    gross = trades.groupBy(*by).agg(F.sum("gross").alias("_gross"))
    joined = mean.join(gross, list(by), "left") if by else mean.join(gross, F.lit(True), "left")
    value = F.when(F.col("_gross").isNull(), F.lit(0.0)).when(F.col("_mean") > 0, F.col("_gross") / 2 / F.col("_mean"))
    return joined.select(*by, value.alias("turnover"))


def annual_returns(equity: DataFrame, by=()) -> DataFrame:
    order = W.partitionBy(*by).orderBy("trade_date")
    change = F.coalesce(ratio("equity", F.lag("equity").over(order)) - 1, F.lit(0.0))
    return (
        equity.withColumn("_r", change)
        .groupBy(*by, F.year("trade_date").alias("year"))
        .agg((F.product(1 + F.col("_r")) - 1).alias("annual_return"))
    )


def equal_weight_benchmark(
    market: DataFrame, initial_cash: float, eligibility: str = "in_universe", price: str = "adj_close", start_date=None
) -> DataFrame:
    """Daily equal-weight return of the names eligible at the previous session."""
    if initial_cash <= 0:
        raise ValueError("initial_cash must be positive")
    keys = ["symbol", "research_segment"] if "research_segment" in market.columns else ["symbol"]
    sessions = session_list(market)
    rows = market.select(*keys, "trade_date", price, eligibility).join(F.broadcast(sessions), "trade_date")
    own = W.partitionBy(*keys).orderBy("trade_date")
    any_row = W.partitionBy("symbol").orderBy("trade_date")
    rows = rows.withColumns(
        {
            "_r": ratio(price, F.lag(price).over(own)) - 1,
            "_was": F.lag(eligibility).over(own),
            "_step": F.col("session_idx") - F.lag("session_idx").over(any_row),
        }
    )
    daily = rows.where(flag("_was") & (F.col("_step") == 1)).groupBy("trade_date").agg(F.avg("_r").alias("_r"))
    series = sessions.join(daily, "trade_date", "left").select("trade_date", F.coalesce("_r", F.lit(0.0)).alias("return"))
    if start_date is not None:
        start = F.lit(start_date).cast("date")
        series = series.where(F.col("trade_date") >= start)
        first = F.row_number().over(W.orderBy("trade_date")) == 1
        series = series.withColumn("return", F.when(first, F.lit(0.0)).otherwise(F.col("return")))
    return nav(series, initial_cash, value="return")


def execution_report(targets: DataFrame, market: DataFrame, by=()) -> DataFrame:
    """For each target and side: the next session's bar and why it could not trade."""
    by = list(by)
    sessions = session_list(market)
    schedule = next_session(targets.select("trade_date").distinct(), sessions).where("exec_date IS NOT NULL")
    states = [c for c in market.columns if c not in ("trade_date", "symbol")]
    bars = market.select(F.col("trade_date").alias("exec_date"), "symbol", F.lit(True).alias("_bar"), *states)
    wanted = (
        targets.select(*by, F.col("trade_date").alias("signal_date"), "symbol", "target_weight")
        .join(F.broadcast(schedule), "signal_date")  # one row per signal date
        .join(bars, ["exec_date", "symbol"], "left")
    )
    issue = data_issue(wanted.columns)
    halted = flag("is_suspended") if "is_suspended" in wanted.columns else F.lit(False)
    up = flag("is_limit_up") if "is_limit_up" in wanted.columns else F.lit(False)
    down = flag("is_limit_down") if "is_limit_down" in wanted.columns else F.lit(False)

    def reason(at_limit, text: str):
        return (
            F.when(F.col("_bar").isNull(), "NO_BAR")
            .when(issue.isNotNull(), issue)
            .when(halted, "SUSPENDED")
            .when(at_limit, text)
        )

    return wanted.select(
        *by,
        "signal_date",
        "exec_date",
        "symbol",
        "target_weight",
        reason(up, "LIMIT_UP").alias("buy_block"),
        reason(down, "LIMIT_DOWN").alias("sell_block"),
    )


def stale_valuations(targets: DataFrame, market: DataFrame, by=()) -> DataFrame:
    """Held sessions without a valid close, with the last valid mark they are valued at."""
    by = list(by)
    sessions = session_list(market)
    schedule = effective_schedule(targets, sessions, by).select(*by, "trade_date", "signal_date")
    held = targets.select(*by, F.col("trade_date").alias("signal_date"), "symbol").join(schedule, [*by, "signal_date"])
    marks = market.select("trade_date", "symbol", positive(finite("close")).alias("_mark"))
    so_far = W.partitionBy(*by, "symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return (
        held.join(marks, ["trade_date", "symbol"], "left")
        .withColumn("last_mark", F.last("_mark", ignorenulls=True).over(so_far))
        .where("_mark IS NULL")
        .select(*by, "trade_date", "signal_date", "symbol", "last_mark")
    )


def replay_day(date, equity: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Signal date and the rows of each ledger table for one session.

    ``targets`` is matched on the signal date, every other table on the session.
    """
    day = F.lit(date).cast("date")
    sessions = session_list(equity)
    out = {"equity": equity.where(F.col("trade_date") == day)}
    for name, frame in tables.items():
        if name != "targets":
            out[name] = frame.where(F.col("trade_date") == day)
            continue
        schedule = next_session(frame.select("trade_date").distinct(), sessions)
        signal = schedule.where(F.col("exec_date") == day).agg(F.max("signal_date").alias("trade_date"))
        out[name] = frame.join(F.broadcast(signal), "trade_date", "left_semi")
    return out


def cost_drag(with_cost: DataFrame, without_cost: DataFrame, benchmark: DataFrame | None = None, by=("run_id",)) -> DataFrame:
    """No-cost minus with-cost annual return, and the excess over a benchmark."""
    a = with_cost.select(*by, F.col("annual_return").alias("_net"))
    b = without_cost.select(*by, F.col("annual_return").alias("_gross"))
    joined = a.join(b, list(by))
    if benchmark is not None:
        joined = joined.join(benchmark.select(F.col("annual_return").alias("_bench")), F.lit(True))
        excess = F.col("_net") - F.col("_bench")
    else:
        excess = F.lit(None).cast("double")
    return joined.select(
        *by,
        F.col("_net").alias("annual_return"),
        (F.col("_gross") - F.col("_net")).alias("cost_drag"),
        excess.alias("annual_excess_return"),
    )


def paired_modes(results: DataFrame, keys, mode: str, base: str, other: str, measures) -> DataFrame:
    """Difference ``other - base`` of each measure between two modes of the same case."""
    wide = results.groupBy(*keys).agg(
        *[F.max(F.when(F.col(mode) == base, F.col(m))).alias(f"_{m}_a") for m in measures],
        *[F.max(F.when(F.col(mode) == other, F.col(m))).alias(f"_{m}_b") for m in measures],
        F.countDistinct(F.when(F.col(mode).isin(base, other), F.col(mode))).alias("_modes"),
    )
    return wide.where("_modes = 2").select(
        *keys, *[(F.col(f"_{m}_b") - F.col(f"_{m}_a")).alias(f"{m}_difference") for m in measures]
    )
