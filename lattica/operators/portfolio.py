"""Target weights, account-aware selection and order sizing.

``by`` names extra keys (strategy, variant, run) so that many portfolios are built
in one job. Row numbers that are cut at a constant prune each task's rows before
the shuffle (window group limit), so a crowded date costs N rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import finite, flag, let
from lattica.functions.symbols import board_allowed
from lattica.functions.trading import (
    Costs,
    affordable_quantity,
    commission,
    order_minimum,
    round_order,
    stamp_rate,
)
from lattica.operators.calendars import is_rebalance_due, rebalance_dates
from lattica.operators.checks import require_columns
from lattica.operators.sections import WHOLE, Layout, add_positions, add_running, add_stats


@dataclass(frozen=True)
class SelectionRule:
    top_n: int = 20
    exit_rank: int = 30
    max_weight: float = 0.05
    cash_buffer: float = 0.0
    mode: str = "rank"
    allow_star: bool = True
    allow_growth: bool = True

    def __post_init__(self):
        if self.exit_rank < self.top_n or self.top_n <= 0:
            raise ValueError("exit_rank >= top_n > 0 is required")
        if self.mode not in ("rank", "affordable"):
            raise ValueError("mode is rank or affordable")

    @property
    def slot_weight(self) -> float:
        return min(1.0 / self.top_n, self.max_weight)


def _at_rebalance(signals: DataFrame, frequency: str, next_session, by=()) -> DataFrame:
    """Rows on a strategy's own rebalance dates: each strategy's calendar is its own data's."""
    keys = [*by, "trade_date"]
    dates = rebalance_dates(signals, frequency, next_session, by).select(*keys)
    return signals.join(F.broadcast(dates), keys, "left_semi")  # one row per strategy and period


def _best(by=()):
    return W.partitionBy(*by, "trade_date")


def top_n_weights(
    signals: DataFrame,
    signal: str = "factor_processed",
    top_n: int = 20,
    frequency: str = "W-FRI",
    max_weight: float = 0.10,
    next_session=None,
    by=(),
) -> DataFrame:
    """N highest scores per rebalance date, weight min(1/n, cap), rest in cash.

    A score that is no number (NaN, infinite) is a missing one.
    """
    require_columns(signals, ["trade_date", "symbol", signal])
    signals = signals.withColumn(signal, finite(signal))
    if top_n <= 0 or not 0 < max_weight <= 1:
        raise ValueError("top_n is positive and max_weight is in (0, 1]")
    work = _at_rebalance(signals, frequency, next_session, by).where(F.col(signal).isNotNull())
    order = _best(by).orderBy(F.desc(signal), "symbol")
    chosen = work.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n)
    held = F.count("*").over(_best(by))
    return chosen.select(
        *by, "trade_date", "symbol", F.least(1 / held, F.lit(max_weight)).alias("target_weight"), signal
    )


def buffered_top_n(
    signals: DataFrame,
    signal: str = "factor_processed",
    top_n: int = 20,
    exit_rank: int = 30,
    frequency: str = "W-FRI",
    max_weight: float = 0.05,
    next_session=None,
    by=(),
) -> DataFrame:
    """Keep members while their rank stays within ``exit_rank``; fill from the top.

    Membership on a date depends on the date before, so each strategy is folded over
    its rebalance dates. A strategy's state is (dates x exit_rank) symbols: bounded
    by the calendar and the rule, never by the number of stocks. A score that is no
    number (NaN, infinite) is a missing one.
    """
    require_columns(signals, ["trade_date", "symbol", signal])
    signals = signals.withColumn(signal, finite(signal))
    if exit_rank < top_n or top_n <= 0:
        raise ValueError("exit_rank >= top_n > 0 is required")
    work = _at_rebalance(signals, frequency, next_session, by).where(F.col(signal).isNotNull())
    order = _best(by).orderBy(F.desc(signal), "symbol")
    ranked = (
        work.select(*by, "trade_date", "symbol", signal)
        .withColumn("factor_rank", F.row_number().over(order))
        .where(F.col("factor_rank") <= exit_rank)
    )
    per_date = ranked.groupBy(*by, "trade_date").agg(
        F.array_sort(F.collect_list(F.struct("factor_rank", "symbol"))).alias("_r")
    )
    days = per_date.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("trade_date", F.col("_r.symbol").alias("today")))).alias("_days")
    )
    nothing = F.struct(
        F.array().cast("array<string>").alias("held"),
        F.array().cast("array<struct<trade_date:date,held:array<string>>>").alias("log"),
    )

    def step(state: Column, date: Column) -> Column:
        stay = F.filter(state["held"], lambda s: F.array_contains(date["today"], s))
        held = F.slice(F.array_union(stay, date["today"]), 1, top_n)
        entry = F.struct(date["trade_date"].alias("trade_date"), held.alias("held"))
        return F.struct(held.alias("held"), F.concat(state["log"], F.array(entry)).alias("log"))

    log = days.select(*by, F.inline(F.aggregate("_days", nothing, step, lambda s: s["log"])))
    weight = F.least(F.try_divide(F.lit(1.0), F.size("held")), F.lit(max_weight))
    members = log.select(*by, "trade_date", weight.alias("target_weight"), F.explode("held").alias("symbol"))
    return members.join(ranked, [*by, "trade_date", "symbol"]).select(
        *by, "trade_date", "symbol", "target_weight", signal, "factor_rank"
    )


def descending_rank(df: DataFrame, signal: str, layout: Layout = WHOLE, out: str = "factor_rank") -> DataFrame:
    """First-come rank of a score, highest first, ties by symbol."""
    return add_positions(df, ["trade_date"], signal, descending=True, position=out, layout=layout)


def account_equity(cash: DataFrame, holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: cash plus holdings at the given prices (``cash`` is a one-row table)."""
    value = holdings.join(prices.select("symbol", "close"), "symbol").agg(
        F.coalesce(F.sum(F.col("shares") * F.col("close")), F.lit(0.0)).alias("_held")
    )
    return cash.join(value, F.lit(True)).select((F.col("cash") + F.col("_held")).alias("equity"))


def selection_audit(
    signals: DataFrame,
    prices: DataFrame,
    holdings: DataFrame,
    account: DataFrame,
    rule: SelectionRule,
    costs: Costs,
    signal: str = "factor_processed",
    layout: Layout = WHOLE,
) -> DataFrame:
    """Every candidate of one account's signal date with its rank, cost and reason.

    ``account`` is a one-row table holding ``equity``; ``holdings`` is ``(symbol, shares)``.
    """
    scored = signals.where(finite(signal).isNotNull()).select("trade_date", "symbol", signal)
    ranked = descending_rank(scored, signal, layout)
    owned = holdings.where("shares > 0").select("symbol", F.lit(True).alias("held"))
    work = (
        ranked.join(prices.select("symbol", F.col("close").alias("reference_close")), "symbol", "left")
        .join(owned, "symbol", "left")
        .join(F.broadcast(account.select("equity")), F.lit(True))  # one row
    )
    slot = F.greatest(F.lit(0.0), F.col("equity") * (rule.slot_weight * (1 - rule.cash_buffer)))
    price = finite("reference_close")
    gross = order_minimum("symbol", costs.lot_size) * price * (1 + costs.slippage)
    work = work.withColumns(
        {
            "held": F.coalesce("held", F.lit(False)),
            "slot_budget": slot,
            "minimum_cost": F.when(gross > 0, gross + commission(gross, "trade_date", costs)),
        }
    )
    short = (
        ~F.col("held") & F.coalesce(F.col("minimum_cost") > F.col("slot_budget") + 1e-9, F.lit(False))
        if rule.mode == "affordable"
        else F.lit(False)
    )
    block = (
        F.when(~board_allowed("symbol", star=rule.allow_star, growth=rule.allow_growth), "BOARD_NOT_ALLOWED")
        .when(F.coalesce(price <= 0, F.lit(True)), "PRICE_MISSING")
        .when(short, "BUDGET_BELOW_MINIMUM_ORDER")
    )
    work = work.withColumn("_block", block)
    kept = F.col("held") & (F.col("factor_rank") <= rule.exit_rank)
    queue = W.partitionBy("trade_date").orderBy(F.desc(kept), "factor_rank")
    chosen = (
        work.where("_block IS NULL")
        .withColumn("_place", F.row_number().over(queue))
        .where(F.col("_place") <= rule.top_n)
        .select("trade_date", "symbol", F.lit(True).alias("selected"))
    )
    # at most top_n rows
    work = work.join(F.broadcast(chosen), ["trade_date", "symbol"], "left")
    work = work.withColumn("selected", F.coalesce("selected", F.lit(False)))
    reason = (
        F.when(F.col("selected") & F.col("held"), "HELD_WITHIN_BUFFER")
        .when(F.col("selected"), "ENTERS_PORTFOLIO")
        .otherwise(F.coalesce("_block", F.lit("SLOTS_FULL")))
    )
    return work.select(
        "trade_date", "symbol", signal, "factor_rank", "reference_close", "minimum_cost", "slot_budget", "held",
        "selected", reason.alias("reason"),
    )


def targets_from_audit(audit: DataFrame, rule: SelectionRule, signal: str = "factor_processed") -> DataFrame:
    chosen = audit.where("selected")
    count = F.count("*").over(W.partitionBy("trade_date"))  # at most top_n rows
    allocation = (
        F.lit(rule.slot_weight) if rule.mode == "affordable" else F.least(1 / count, F.lit(rule.max_weight))
    )
    return chosen.select(
        "trade_date", "symbol", (allocation * (1 - rule.cash_buffer)).alias("target_weight"), signal, "factor_rank"
    )


# --- validation ----------------------------------------------------------------


def weight_violations(weights: DataFrame, by=()) -> DataFrame:
    """Dates whose weights are not finite, negative, duplicated or above 100%."""
    w = finite("target_weight")
    per_key = weights.groupBy(*by, "trade_date", "symbol").agg(
        F.count("*").alias("_n"),
        F.sum(w).alias("_w"),
        F.count_if(w.isNull()).alias("_bad"),
        F.count_if(w < 0).alias("_negative"),
    )
    per = per_key.groupBy(*by, "trade_date").agg(
        F.sum("_w").alias("total_weight"),
        F.sum("_bad").alias("not_finite"),
        F.sum("_negative").alias("negative"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
    )
    wrong = (
        (F.col("total_weight") > 1 + 1e-9)
        | (F.col("not_finite") > 0)
        | (F.col("negative") > 0)
        | (F.col("duplicates") > 0)
    )
    return per.where(wrong)


def account_violations(accounts: DataFrame, holdings: DataFrame) -> DataFrame:
    """Accounts with unusable cash or share counts."""
    cash = finite("cash")
    bad_cash = accounts.where(cash.isNull() | (cash < 0)).select("account_id", F.lit("CASH_INVALID").alias("problem"))
    shares = finite("shares")
    bad_shares = (
        holdings.where(shares.isNull() | (shares < 0) | (shares != F.floor(shares)))
        .groupBy("account_id")
        .agg(F.count("*").alias("_n"))
        .select("account_id", F.lit("SHARES_INVALID").alias("problem"))
    )
    return bad_cash.unionByName(bad_shares)


# --- order sizing -----------------------------------------------------------------

ORDER_COLUMNS = [
    "account_id", "status", "symbol", "side", "current_shares", "target_shares", "shares", "reference_close",
    "target_weight", "factor_rank", "estimated_price", "estimated_fee", "estimated_tax", "estimated_cash_after",
    "unfilled_shares", "conditional_on_sells",
]


def _sold_first(work: DataFrame, date: Column, costs: Costs, layout: Layout) -> DataFrame:
    """Add the outcome of every sale and the cash it leaves.

    A sale that pays for itself always goes through. One that does not (tiny gross
    against the minimum fee) needs cash from the account or from sales before it; only
    those few are folded in order.
    """
    account = ["account_id"]
    order = ["_first", "_second"]
    selling = F.col("side") == "SELL"
    work = work.withColumns(
        {
            "_first": F.coalesce("factor_rank", F.lit(2**31 - 1)),
            "_second": F.coalesce("symbol", F.lit("")),
            "requested": F.abs(F.col("target_shares") - F.col("current_shares")),
            "estimated_price": F.col("reference_close")
            * F.when(selling, F.lit(1 - costs.slippage)).otherwise(F.lit(1 + costs.slippage)),
        }
    )
    legal = F.when(
        selling, round_order("requested", "symbol", costs.lot_size, holding="current_shares")
    ).otherwise(round_order("requested", "symbol", costs.lot_size))
    work = work.withColumn("_legal", legal).withColumn("_gross", F.col("_legal") * F.col("estimated_price"))
    work = work.withColumns(
        {
            "_fee": F.when(F.col("_legal") > 0, commission("_gross", date, costs)).otherwise(F.lit(0.0)),
            "_tax": F.col("_gross") * stamp_rate(date, costs),
        }
    )
    work = work.withColumn("_net", F.when(selling, F.col("_gross") - F.col("_fee") - F.col("_tax")))
    sure = F.coalesce(F.greatest("_net", F.lit(0.0)), F.lit(0.0))
    work = add_running(work, account, order, {"_place": F.lit(1), "_earned": sure}, layout)
    work = work.withColumn("_money", F.col("cash") + F.col("_earned") - sure)
    doubtful = F.when(F.col("_net") < 0, F.struct("_place", "_money", "_net"))
    work = add_stats(work, account, {"_queue": F.collect_list(doubtful)}, layout)
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<bigint>").alias("passed"))

    def admit(state: Column, sale: Column) -> Column:
        pays = sale["_money"] + state["spent"] + sale["_net"] >= 0
        return F.when(
            pays,
            F.struct(
                (state["spent"] + sale["_net"]).alias("spent"),
                F.concat(state["passed"], F.array(sale["_place"].cast("bigint"))).alias("passed"),
            ),
        ).otherwise(state)

    passes = F.aggregate(F.array_sort("_queue"), start, admit, lambda s: s["passed"])
    passed = selling & ((F.col("_net") >= 0) | F.array_contains(passes, F.col("_place").cast("bigint")))
    work = work.withColumn("_passed", F.coalesce(passed, F.lit(False)))
    work = work.withColumns(
        {
            "shares": F.when(F.col("_passed"), F.col("_legal")).otherwise(F.lit(0)),
            "estimated_fee": F.when(F.col("_passed"), F.col("_fee")).otherwise(F.lit(0.0)),
            "estimated_tax": F.when(F.col("_passed"), F.col("_tax")).otherwise(F.lit(0.0)),
            "_net": F.when(F.col("_passed"), F.col("_net")).otherwise(F.lit(0.0)),
        }
    )
    work = add_running(work, account, order, {"_raised": F.col("_net")}, layout)
    work = add_stats(
        work,
        account,
        {"_total": F.sum("_net"), "_most": F.max("shares"), "_moves": F.count("side")},
        layout,
    )
    return work.withColumns(
        {
            "estimated_cash_after": F.col("cash") + F.col("_raised"),
            "_after_sales": F.col("cash") + F.col("_total"),
            "_sold": F.col("_most") > 0,
        }
    ).drop("_queue", "_money", "_earned", "_raised", "_gross", "_fee", "_tax", "_net", "_passed", "_total", "_most")


def _buys(work: DataFrame, date: Column, costs: Costs) -> DataFrame:
    """Buys in rank order, each limited by the cash the ones before it left.

    Only targets can be bought, so an account's list is bounded by its portfolio size.
    """
    carried = [
        "symbol", "current_shares", "target_shares", "reference_close", "target_weight", "factor_rank", "requested",
        "_legal", "estimated_price",
    ]
    buys = work.where("side = 'BUY'").groupBy("account_id", "_after_sales", "_sold").agg(
        F.array_sort(F.collect_list(F.struct("_place", *carried))).alias("_queue")
    )
    row = "array<struct<shares:bigint,fee:double,cash_after:double>>"
    start = F.struct(F.col("_after_sales").alias("cash"), F.array().cast(row).alias("log"))

    def fill(state: Column, order: Column) -> Column:
        quantity = affordable_quantity(
            order["_legal"], order["estimated_price"], state["cash"], order["symbol"], date, costs
        )

        def book(shares: Column) -> Column:
            gross = shares * order["estimated_price"]
            fee = F.when(shares > 0, commission(gross, date, costs)).otherwise(F.lit(0.0))
            return F.struct(shares.alias("shares"), fee.alias("fee"), (state["cash"] - gross - fee).alias("cash_after"))

        def post(entry: Column) -> Column:
            return F.struct(entry["cash_after"].alias("cash"), F.concat(state["log"], F.array(entry)).alias("log"))

        return let(let(quantity, book), post)

    filled = buys.withColumn("_log", F.aggregate("_queue", start, fill, lambda s: s["log"]))
    rows = filled.select("account_id", "_sold", F.explode(F.arrays_zip("_queue", "_log")).alias("_z"))
    return rows.select(
        "account_id",
        *[F.col(f"_z._queue.{c}").alias(c) for c in carried if c != "_legal"],
        F.col("_z._log.shares").alias("shares"),
        F.col("_z._log.fee").alias("estimated_fee"),
        F.lit(0.0).alias("estimated_tax"),
        F.col("_z._log.cash_after").alias("estimated_cash_after"),
        F.lit("BUY").alias("side"),
        F.col("_sold").alias("conditional_on_sells"),
    )


def estimate_orders(
    targets: DataFrame, accounts: DataFrame, holdings: DataFrame, prices: DataFrame, trade_date, costs: Costs,
    layout: Layout = WHOLE,
) -> DataFrame:
    """Orders that move each account to its targets: sells first, then affordable buys.

    ``targets`` is ``(account_id, symbol, target_weight, factor_rank)``, ``holdings``
    ``(account_id, symbol, shares)``. Accounts missing a price for a target or a
    holding get a single PRICE_MISSING row; accounts with nothing to do get NO_TRADE.
    No orders are made, but one row with the reason, for an account that is not in
    ``accounts`` (ACCOUNT_UNKNOWN), whose weights are missing, negative, no numbers, above
    100 % together or given twice for a symbol (WEIGHTS_INVALID), or that needs a symbol
    with two different prices (PRICE_AMBIGUOUS). Holdings of a symbol add up.
    Everything but the buy fold runs in windows of one exchange on the account;
    ``layout`` (bound: the number of listed symbols) cuts an account into ranges when
    its holdings could outgrow a task.
    """
    date = trade_date if isinstance(trade_date, Column) else F.lit(trade_date).cast("date")
    key = ["account_id", "symbol"]
    owned = holdings.where("shares > 0").groupBy(*key).agg(F.sum("shares").cast("long").alias("current_shares"))
    sound = finite("target_weight") >= 0
    wanted = targets.groupBy(*key).agg(
        F.max(finite("target_weight")).alias("target_weight"),
        F.min(F.col("factor_rank").cast("int")).alias("factor_rank"),
        ((F.count("*") > 1) | ~F.every(F.coalesce(sound, F.lit(False)))).alias("_unsound"),
    )
    known = prices.groupBy("symbol").agg(F.min(finite("close")).alias("reference_close"), F.max(finite("close")).alias("_other"))
    lines = owned.join(wanted, key, "full").join(known, "symbol", "left")
    priced = F.col("symbol").isNull() | F.coalesce(F.col("reference_close") > 0, F.lit(False))
    work = (
        accounts.select("account_id", F.col("cash").cast("double").alias("cash"), F.lit(True).alias("_known"))
        .join(lines, "account_id", "full")
        .withColumns(
            {
                "current_shares": F.coalesce("current_shares", F.lit(0)),
                "target_weight": F.coalesce("target_weight", F.lit(0.0)),
            }
        )
    )
    stats = {
        "_complete": F.min(priced),
        "_ambiguous": F.max(F.coalesce(F.col("reference_close") != F.col("_other"), F.lit(False))),
        "_refused": F.max(flag("_unsound")),
        "_weights": F.sum("target_weight"),
        "_worth": F.sum(F.col("current_shares") * F.col("reference_close")),
    }
    work = add_stats(work, ["account_id"], stats, layout)
    problem = (
        F.when(F.col("_known").isNull(), "ACCOUNT_UNKNOWN")
        .when(F.col("_refused") | (F.col("_weights") > 1 + 1e-9), "WEIGHTS_INVALID")
        .when(~F.col("_complete"), "PRICE_MISSING")
        .when(F.col("_ambiguous"), "PRICE_AMBIGUOUS")
    )
    work = work.withColumn("_problem", problem)
    work = work.withColumn("_equity", F.col("cash") + F.coalesce("_worth", F.lit(0.0)))
    desired = F.col("_equity") * F.col("target_weight") / F.col("reference_close")
    work = work.withColumn("target_shares", round_order(desired, "symbol", costs.lot_size))
    move = F.when(F.col("target_shares") < F.col("current_shares"), "SELL").when(
        F.col("target_shares") > F.col("current_shares"), "BUY"
    )
    work = work.withColumn("side", F.when(F.col("_problem").isNull() & F.col("symbol").isNotNull(), move))
    work = _sold_first(work, date, costs, layout).withColumn("conditional_on_sells", F.lit(False))

    columns = [c for c in ORDER_COLUMNS if c not in ("status", "unfilled_shares")]
    both = work.where("side = 'SELL'").select(*columns, "requested").unionByName(
        _buys(work, date, costs).select(*columns, "requested")
    )
    orders = both.withColumns(
        {
            "status": F.when(F.col("shares") > 0, "REVIEW_REQUIRED").otherwise("UNFILLED"),
            "unfilled_shares": F.col("requested") - F.col("shares"),
        }
    ).select(*ORDER_COLUMNS)
    still = work.where("_moves = 0 AND _place = 1").select(
        "account_id",
        F.coalesce("_problem", F.lit("NO_TRADE")).alias("status"),
        F.when(F.col("_problem").isNull(), F.col("cash")).alias("estimated_cash_after"),
    )
    return orders.unionByName(still, allowMissingColumns=True)


def next_session_orders(
    targets: DataFrame,
    accounts: DataFrame,
    holdings: DataFrame,
    prices: DataFrame,
    signal_date: str,
    next_date: str | None,
    frequency: str,
    costs: Costs,
    layout: Layout = WHOLE,
) -> DataFrame:
    """Order table of the next session, or the status row that explains its absence."""
    ids = accounts.select("account_id")
    signal = F.lit(signal_date).cast("date")
    blank = ids.select("account_id", *[F.lit(None).cast("string").alias("status")])

    def only(status: str, upcoming: Column) -> DataFrame:
        return blank.withColumns({"status": F.lit(status), "signal_date": signal, "planned_trade_date": upcoming})

    if next_date is None:
        return only("CALENDAR_UNKNOWN", F.lit(None).cast("date"))
    if next_date <= signal_date:
        raise ValueError("the planned session must be after the signal date")
    upcoming = F.lit(next_date).cast("date")
    due = is_rebalance_due(signal, upcoming, frequency)
    orders = estimate_orders(targets, accounts, holdings, prices, upcoming, costs, layout)
    dated = orders.where(due).withColumns({"signal_date": signal, "planned_trade_date": upcoming})
    waiting = only("NO_TRADE", upcoming).where(~due)
    return dated.unionByName(waiting, allowMissingColumns=True)
