"""Portfolio, order, performance and ledger queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog.base import query, symbol_sql, with_daily, with_weekly
from lattica.catalog.research import (
    DECAY_LABELS,
    SIGNED,
    SUMMARY,
    composite,
    ic_sql,
    process_sql,
    quantile_sql,
    rounded,
    sig_sql,
    signals,
)
from lattica.catalog.rules import lot
from lattica.functions.trading import Costs
from lattica.operators import calendars, ledger, performance, portfolio
from lattica.operators.portfolio import SelectionRule
from lattica.operators.preprocess import preprocess
from lattica.operators.universe import UniverseRule, apply_universe
from lattica.plans import studies
from lattica.plans.panel import section_layout, symbol_of, table, weekly_panel
from lattica.session import settle


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


TOP = process_sql("sig", "reversal_5", "trade_date", False) + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY factor_processed DESC, symbol) AS rk
    FROM processed WHERE factor_processed IS NOT NULL) WHERE rk <= 10),
  weights AS (SELECT trade_date, symbol, least(1.0 / count(*) OVER (PARTITION BY trade_date), 0.08) AS target_weight, factor_processed FROM top)"""


def processed(spark, sf, bars=None):
    return preprocess(signals(spark, sf, bars), "reversal_5", 5.0, False, False, layout=section_layout(spark, sf))


def weights(spark, sf, bars=None):
    return portfolio.top_n_weights(processed(spark, sf, bars), "factor_processed", 10, "W-FRI", 0.08)


@query(
    "top_n_weights",
    sig_sql(TOP + " SELECT trade_date, symbol, round(target_weight, 6) AS target_weight, round(factor_processed, 6) AS factor_processed FROM weights"),
)
def top_n_weights(spark, sf):
    return weights(spark, sf).select("trade_date", "symbol", r("target_weight"), r("factor_processed"))


@query(
    "rebalance_dates",
    with_daily(
        """SELECT 'M' AS frequency, max(trade_date) AS trade_date FROM daily GROUP BY date_trunc('month', trade_date) HAVING date_trunc('month', max(trade_date)) <> DATE '2001-11-01'
      UNION ALL SELECT 'W-FRI', max(trade_date) FROM daily GROUP BY date_trunc('week', trade_date + 2)
      UNION ALL SELECT DISTINCT 'D', trade_date FROM daily"""
    ),
)
def rebalance_dates(spark, sf):
    bars = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))
    parts = [
        calendars.rebalance_dates(bars, "M", "2001-11-20").select(F.lit("M").alias("frequency"), "trade_date"),
        calendars.rebalance_dates(bars, "W-FRI").select(F.lit("W-FRI").alias("frequency"), "trade_date"),
        calendars.rebalance_dates(bars, "D").select(F.lit("D").alias("frequency"), "trade_date"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rebalance_due",
    with_daily(
        """, s AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM daily))
      SELECT trade_date, date_trunc('month', trade_date) <> date_trunc('month', nxt) AS monthly,
        date_trunc('week', trade_date + 2) <> date_trunc('week', nxt + 2) AS weekly, TRUE AS daily FROM s WHERE nxt IS NOT NULL"""
    ),
)
def rebalance_due(spark, sf):
    bars = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))
    s = calendars.session_list(bars).withColumn("nxt", F.lead("trade_date").over(W.orderBy("trade_date")))
    due = lambda f: calendars.is_rebalance_due("trade_date", "nxt", f)
    return s.where("nxt IS NOT NULL").select("trade_date", due("M").alias("monthly"), due("W-FRI").alias("weekly"), due("D").alias("daily"))


@query(
    "buffered_top_n",
    "WITH RECURSIVE " + sig_sql(
        process_sql("sig", "reversal_5", "trade_date", False)
        + """, ranked AS (SELECT * FROM (SELECT trade_date, symbol, factor_processed, row_number() OVER (PARTITION BY trade_date ORDER BY factor_processed DESC, symbol) AS rk
        FROM processed WHERE factor_processed IS NOT NULL) WHERE rk <= 15),
      days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx, list(symbol ORDER BY rk) AS today FROM ranked GROUP BY trade_date),
      walk AS (SELECT idx, trade_date, today[1:8] AS held FROM days WHERE idx = 1 UNION ALL
        SELECT d.idx, d.trade_date, list_concat(list_filter(w.held, lambda s: list_contains(d.today, s)), list_filter(d.today, lambda s: NOT list_contains(w.held, s)))[1:8]
        FROM walk w JOIN days d ON d.idx = w.idx + 1),
      m AS (SELECT trade_date, least(1.0 / len(held), 0.1) AS target_weight, unnest(held) AS symbol FROM walk)
      SELECT trade_date, symbol, round(target_weight, 6) AS target_weight, round(factor_processed, 6) AS factor_processed, rk AS factor_rank FROM m JOIN ranked USING (trade_date, symbol)"""
    ).removeprefix("WITH "),
)
def buffered_top_n(spark, sf):
    out = portfolio.buffered_top_n(processed(spark, sf), "factor_processed", 8, 15, "W-FRI", 0.1)
    return out.select("trade_date", "symbol", r("target_weight"), r("factor_processed"), "factor_rank")


# --- one account on the latest signal date ---------------------------------------------

ACCOUNT = SIGNED + f""", lat AS (SELECT * FROM composite WHERE trade_date = (SELECT max(trade_date) FROM composite)),
  px AS (SELECT symbol, close / 50 AS close FROM lat WHERE volume % 10 <> 0), hold AS (SELECT symbol, volume * 10 AS shares FROM lat WHERE volume % 3 = 0),
  eq AS (SELECT 20000 + coalesce(sum(shares * close), 0) AS equity FROM hold JOIN px USING (symbol)),
  rk AS (SELECT trade_date, symbol, factor_processed, split_part(symbol, '.', 1) AS code, DATE '2001-10-29' AS d, row_number() OVER (ORDER BY factor_processed DESC, symbol) AS factor_rank FROM lat WHERE factor_processed IS NOT NULL),
  cand AS (SELECT rk.*, px.close AS reference_close, hold.symbol IS NOT NULL AS held, eq.equity * 0.1 * 0.95 AS slot_budget,
      (CASE WHEN code LIKE '688%' THEN 200 ELSE 100 END) * px.close * 1.0005 AS gross FROM rk LEFT JOIN px USING (symbol) LEFT JOIN hold USING (symbol), eq),
  cost AS (SELECT *, CASE WHEN gross > 0 THEN gross + greatest(5.0, gross * 0.0003) + gross * 0.00002 END AS minimum_cost FROM cand),
  blk AS (SELECT *, CASE WHEN code LIKE '688%' OR code LIKE '689%' THEN 'BOARD_NOT_ALLOWED' WHEN coalesce(reference_close <= 0, TRUE) THEN 'PRICE_MISSING'
      WHEN $MODE AND NOT held AND minimum_cost > slot_budget + 1e-9 THEN 'BUDGET_BELOW_MINIMUM_ORDER' END AS block FROM cost),
  sel AS (SELECT symbol, row_number() OVER (ORDER BY (held AND factor_rank <= 15) DESC, factor_rank) AS place FROM blk WHERE block IS NULL),
  audit AS (SELECT blk.*, coalesce(place <= 10, FALSE) AS selected FROM blk LEFT JOIN sel USING (symbol))"""
AUDIT_SELECT = """ SELECT symbol, factor_rank, round(minimum_cost, 6) AS minimum_cost, round(slot_budget, 6) AS slot_budget, selected,
  CASE WHEN selected AND held THEN 'HELD_WITHIN_BUFFER' WHEN selected THEN 'ENTERS_PORTFOLIO' ELSE coalesce(block, 'SLOTS_FULL') END AS reason FROM audit"""


def account(spark, sf, mode: str):
    scores = composite(spark, sf)
    last = scores.agg(F.max("trade_date").alias("trade_date"))
    latest = scores.join(F.broadcast(last), "trade_date", "left_semi")
    prices = latest.where("volume % 10 <> 0").select("symbol", (F.col("close") / 50).alias("close"))
    holdings = latest.where("volume % 3 = 0").select("symbol", (F.col("volume") * 10).alias("shares"))
    cash = last.select(F.lit(20000.0).alias("cash"))
    equity = portfolio.account_equity(cash, holdings, prices)
    rule = SelectionRule(top_n=10, exit_rank=15, max_weight=0.1, cash_buffer=0.05, mode=mode, allow_star=False)
    audit = portfolio.selection_audit(
        latest.select("trade_date", "symbol", "factor_processed"), prices, holdings, equity, rule, Costs(), layout=section_layout(spark, sf)
    )
    return audit, rule


def _selection(mode: str, sql_mode: str):
    @query(f"selection_{mode}", sig_sql(ACCOUNT.replace("$MODE", sql_mode) + AUDIT_SELECT))
    def audit(spark, sf):
        out, _ = account(spark, sf, mode)
        return out.select("symbol", "factor_rank", r("minimum_cost"), r("slot_budget"), "selected", "reason")


_selection("rank", "FALSE")
_selection("affordable", "TRUE")


@query(
    "selection_targets",
    sig_sql(ACCOUNT.replace("$MODE", "FALSE") + " SELECT symbol, round(least(1.0 / count(*) OVER (), 0.1) * 0.95, 6) AS target_weight, factor_rank FROM audit WHERE selected"),
)
def selection_targets(spark, sf):
    audit, rule = account(spark, sf, "rank")
    return portfolio.targets_from_audit(audit, rule).select("symbol", r("target_weight"), "factor_rank")


# --- orders of many accounts -------------------------------------------------------------

FEE = "(greatest(5.0, {g} * 0.0003) + {g} * 0.00001)"
ORDERS = f"""WITH RECURSIVE px AS (SELECT {symbol_sql('l_suppkey')} AS symbol, round(max(l_extendedprice / l_quantity) / 100, 2) AS close FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY l_suppkey),
  li AS (SELECT o_custkey AS account_id, {symbol_sql('(l_suppkey + CASE WHEN l_suppkey % 11 = 0 AND o_custkey % 5 <> 0 THEN 1 ELSE 0 END)')} AS symbol, l_quantity, l_extendedprice, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  acc AS (SELECT c_custkey AS account_id, greatest(c_acctbal, 0) AS cash FROM customer),
  hold AS (SELECT account_id, symbol, CAST(sum(l_quantity) * 10 AS BIGINT) AS shares FROM li WHERE l_returnflag = 'R' GROUP BY 1, 2),
  tgt AS (SELECT account_id, symbol, 0.9 / count(*) OVER (PARTITION BY account_id) AS target_weight, row_number() OVER (PARTITION BY account_id ORDER BY sum(l_extendedprice) DESC, symbol) AS factor_rank
    FROM li WHERE l_returnflag = 'A' GROUP BY account_id, symbol),
  ln AS (SELECT coalesce(h.account_id, t.account_id) AS account_id, coalesce(h.symbol, t.symbol) AS symbol, coalesce(shares, 0) AS cur, coalesce(target_weight, 0) AS w, factor_rank
    FROM hold h FULL JOIN tgt t ON h.account_id = t.account_id AND h.symbol = t.symbol),
  lp AS (SELECT ln.*, close FROM ln LEFT JOIN px USING (symbol)),
  val AS (SELECT account_id, sum(cur * close) AS v, bool_and(coalesce(close > 0, FALSE)) AS ok FROM lp GROUP BY 1),
  st AS (SELECT acc.account_id, cash, cash + coalesce(v, 0) AS equity, coalesce(ok, TRUE) AS ok FROM acc LEFT JOIN val USING (account_id)),
  wk AS (SELECT lp.*, split_part(symbol, '.', 1) AS code, cash, equity, {lot("equity * w / close", "split_part(symbol, '.', 1)")} AS goal FROM lp JOIN st USING (account_id) WHERE ok),
  sl0 AS (SELECT *, cur - goal AS wish, close * 0.9995 AS price FROM wk WHERE goal < cur),
  sl1 AS (SELECT *, CASE WHEN wish >= cur THEN cur ELSE {lot('wish')} END AS q FROM sl0),
  sl2 AS (SELECT *, CASE WHEN q > 0 THEN {FEE.format(g='q * price')} ELSE 0 END AS fee, q * price * 0.0005 AS tax FROM sl1),
  sells AS (SELECT *, cash + sum(q * price - fee - tax) OVER (PARTITION BY account_id ORDER BY factor_rank NULLS LAST, symbol) AS after FROM sl2),
  raised AS (SELECT account_id, sum(q * price - fee - tax) AS raised, max(q) > 0 AS sold FROM sl2 GROUP BY 1),
  by0 AS (SELECT wk.*, goal - cur AS wish, {lot('goal - cur')} AS legal, close * 1.0005 AS price, row_number() OVER (PARTITION BY account_id ORDER BY factor_rank, symbol) AS place FROM wk WHERE goal > cur),
  buys AS (SELECT account_id, 0 AS place, NULL::BIGINT AS q, 0.0::DOUBLE AS fee, cash + coalesce(raised, 0) AS after FROM st LEFT JOIN raised USING (account_id) WHERE ok
    UNION ALL SELECT account_id, place, q, CASE WHEN q > 0 THEN {FEE.format(g='q * price')} ELSE 0 END, after - q * price - CASE WHEN q > 0 THEN {FEE.format(g='q * price')} ELSE 0 END FROM (
      SELECT b.account_id, n.place, n.price, b.after, CASE WHEN b.after <= 5 THEN 0 ELSE {lot('least(n.legal, least(b.after / (n.price * 1.00031), (b.after - 5) / (n.price * 1.00001)))', 'n.code')} END AS q
      FROM buys b JOIN by0 n ON n.account_id = b.account_id AND n.place = b.place + 1)),
  orders_out AS (SELECT account_id, symbol, 'SELL' AS side, cur AS current_shares, goal AS target_shares, q AS shares, fee, after, wish - q AS unfilled, FALSE AS conditional FROM sells
    UNION ALL SELECT n.account_id, n.symbol, 'BUY', n.cur, n.goal, b.q, b.fee, b.after, n.wish - b.q, coalesce(sold, FALSE) FROM buys b JOIN by0 n ON n.account_id = b.account_id AND n.place = b.place LEFT JOIN raised r ON r.account_id = n.account_id)
  SELECT account_id, CASE WHEN shares > 0 THEN 'REVIEW_REQUIRED' ELSE 'UNFILLED' END AS status, symbol, side, current_shares, target_shares, shares, round(fee, 4) AS estimated_fee,
    round(after, 4) AS estimated_cash_after, CAST(unfilled AS BIGINT) AS unfilled_shares, conditional AS conditional_on_sells FROM orders_out
  UNION ALL SELECT account_id, 'NO_TRADE', NULL, NULL, NULL, NULL, NULL, NULL, round(cash, 4), NULL, NULL FROM st WHERE ok AND account_id NOT IN (SELECT account_id FROM wk WHERE goal <> cur)
  UNION ALL SELECT account_id, 'PRICE_MISSING', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM st WHERE NOT ok"""


def scaled_round(value, digits: int):
    """Rounding of a double as SQL does it: scaled, to the nearest whole number, scaled back."""
    return F.round(value * 10.0**digits) / 10.0**digits


def account_tables(spark, sf):
    lines = table(spark, sf, "lineitem")
    sym = symbol_of("l_suppkey").alias("symbol")
    priced = F.col("l_suppkey") % 11 != 0
    prices = lines.where(priced).groupBy("l_suppkey").agg(
        scaled_round(F.max(F.col("l_extendedprice") / F.col("l_quantity")) / 100, 2).alias("close")
    ).select(sym, "close")
    # names without a price are booked by every fifth account only; others book the next name instead
    named = F.col("l_suppkey") + F.when(priced | (F.col("o_custkey") % 5 == 0), 0).otherwise(1)
    booked = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("_named", named).select(
        F.col("o_custkey").alias("account_id"), symbol_of("_named").alias("symbol"), "l_quantity", "l_extendedprice", "l_returnflag"
    )
    holdings = booked.where("l_returnflag = 'R'").groupBy("account_id", "symbol").agg(
        (F.sum("l_quantity") * 10).cast("long").alias("shares")
    )
    traded = booked.where("l_returnflag = 'A'").groupBy("account_id", "symbol").agg(F.sum("l_extendedprice").alias("_a"))
    order = W.partitionBy("account_id").orderBy(F.desc("_a"), "symbol")
    share = F.lit(0.9) / F.count("*").over(W.partitionBy("account_id"))  # an account's names, as many as it traded
    targets = traded.withColumn("factor_rank", F.row_number().over(order)).select(
        "account_id", "symbol", share.alias("target_weight"), "factor_rank"
    )
    accounts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("cash")
    )
    return targets, accounts, holdings, prices


ORDER_VIEW = [
    "account_id", "status", "symbol", "side", "current_shares", "target_shares", "shares", "estimated_fee", "estimated_cash_after",
    "unfilled_shares", "conditional_on_sells",
]


def order_view(df, *more):
    return df.withColumns({c: scaled_round(F.col(c), 4) for c in ("estimated_fee", "estimated_cash_after")}).select(*ORDER_VIEW, *more)


@query("estimate_orders", ORDERS)
def estimate_orders(spark, sf):
    return order_view(portfolio.estimate_orders(*account_tables(spark, sf), "2024-03-04", Costs(), section_layout(spark, sf)))


@query(
    "order_refusals",
    f"""WITH li AS (SELECT o_custkey AS account_id, {symbol_sql('l_suppkey')} AS symbol, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  hold AS (SELECT DISTINCT account_id, symbol FROM li WHERE l_returnflag = 'R'),
  tgt AS (SELECT account_id, symbol, row_number() OVER (PARTITION BY account_id ORDER BY symbol) AS rk FROM (SELECT DISTINCT account_id, symbol FROM li WHERE l_returnflag = 'A')),
  c AS (SELECT c_custkey AS account_id, c_acctbal AS b, c_mktsegment AS seg FROM customer),
  known AS (SELECT account_id FROM c WHERE seg <> 'BUILDING'),
  twice AS (SELECT {symbol_sql('s_suppkey')} AS symbol FROM supplier WHERE s_acctbal > 9000),
  used AS (SELECT account_id FROM hold UNION SELECT account_id FROM tgt),
  bad AS (SELECT DISTINCT account_id FROM tgt JOIN c USING (account_id) WHERE b < 0 OR (b < 3000 AND rk = 2)),
  two AS (SELECT DISTINCT account_id FROM (SELECT account_id, symbol FROM hold UNION SELECT account_id, symbol FROM tgt) JOIN twice USING (symbol))
  SELECT account_id, CASE WHEN account_id NOT IN (SELECT account_id FROM known) THEN 'ACCOUNT_UNKNOWN' WHEN account_id IN (SELECT account_id FROM bad) THEN 'WEIGHTS_INVALID' ELSE 'PRICE_AMBIGUOUS' END AS status, 1::BIGINT AS rows
  FROM used WHERE account_id NOT IN (SELECT account_id FROM known) OR account_id IN (SELECT account_id FROM bad) OR account_id IN (SELECT account_id FROM two)""",
)
def order_refusals(spark, sf):
    """Accounts that get one row with a reason: unknown ones, unsound weights, two prices of a symbol."""
    lines = table(spark, sf, "lineitem")
    booked = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("account_id"), symbol_of("l_suppkey").alias("symbol"), "l_quantity", "l_returnflag"
    )
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), "c_acctbal", "c_mktsegment")
    holdings = booked.where("l_returnflag = 'R'").groupBy("account_id", "symbol").agg(F.sum("l_quantity").alias("shares"))
    place = F.row_number().over(W.partitionBy("account_id").orderBy("symbol"))  # an account's names
    targets = booked.where("l_returnflag = 'A'").select("account_id", "symbol").distinct().withColumn("factor_rank", place).join(customers, "account_id")
    share = F.lit(0.9) / F.count("*").over(W.partitionBy("account_id"))
    # poor accounts ask for more than they have, others for less than nothing of their second name
    weight = F.when(F.col("c_acctbal") < 0, share * 1.3).when((F.col("c_acctbal") < 3000) & (F.col("factor_rank") == 2), -share).otherwise(share)
    targets = targets.select("account_id", "symbol", weight.alias("target_weight"), "factor_rank")
    prices = lines.groupBy("l_suppkey").agg((F.max(F.col("l_extendedprice") / F.col("l_quantity")) / 100).alias("close")).select(symbol_of("l_suppkey").alias("symbol"), "close")
    rich = table(spark, sf, "supplier").where("s_acctbal > 9000").select(symbol_of("s_suppkey").alias("symbol"))
    prices = prices.unionByName(prices.join(rich, "symbol", "left_semi").withColumn("close", F.col("close") + 1))
    accounts = customers.where("c_mktsegment <> 'BUILDING'").select("account_id", F.greatest("c_acctbal", F.lit(0.0)).alias("cash"))
    out = portfolio.estimate_orders(targets, accounts, holdings, prices, "2024-03-04", Costs(), section_layout(spark, sf))
    refused = out.where(F.col("status").isin("ACCOUNT_UNKNOWN", "WEIGHTS_INVALID", "PRICE_AMBIGUOUS"))
    return refused.groupBy("account_id", "status").agg(F.count("*").alias("rows"))


@query(
    "next_session_orders",
    ORDERS.replace("SELECT account_id, CASE WHEN shares > 0", "SELECT *, DATE '2024-03-01' AS signal_date, DATE '2024-03-04' AS planned_trade_date FROM (SELECT account_id, CASE WHEN shares > 0") + ")",
)
def next_session_orders(spark, sf):
    out = portfolio.next_session_orders(*account_tables(spark, sf), "2024-03-01", "2024-03-04", "W-FRI", Costs(), section_layout(spark, sf))
    return order_view(out, "signal_date", "planned_trade_date")


@query(
    "orders_not_due",
    "SELECT c_custkey AS account_id, 'NO_TRADE' AS status, DATE '2024-03-05' AS signal_date, DATE '2024-03-06' AS planned_trade_date FROM customer",
)
def orders_not_due(spark, sf):
    out = portfolio.next_session_orders(*account_tables(spark, sf), "2024-03-05", "2024-03-06", "W-FRI", Costs())
    return out.select("account_id", "status", "signal_date", "planned_trade_date")


LATEST_FACTORS = {"reversal_5": 1, "momentum_20_5": -1, "volatility_20": 1}


@query(
    "score_latest",
    sig_sql(
        """, el AS (SELECT *, NOT is_st AND NOT is_suspended AND amount >= 20000 AS in_universe FROM sig WHERE trade_date = (SELECT max(trade_date) FROM sig)),
      lg AS (SELECT trade_date, symbol, in_universe, unnest(['reversal_5', 'momentum_20_5', 'volatility_20']) AS factor, unnest([1, -1, 1]) AS dir,
        unnest([CASE WHEN in_universe THEN reversal_5 END, CASE WHEN in_universe THEN momentum_20_5 END, CASE WHEN in_universe THEN volatility_20 END]) AS value FROM el)"""
        + process_sql("lg", "value", "factor", False)
        + """, cv AS (SELECT factor, count(value) / count(*) FILTER (WHERE in_universe) AS coverage FROM lg GROUP BY 1),
      sc AS (SELECT symbol, in_universe, CASE WHEN coverage >= 0.8 THEN factor_processed * dir END AS score FROM processed JOIN cv USING (factor)),
      w AS (SELECT symbol, in_universe, count(score) AS valid_factor_count, CASE WHEN count(score) >= 2 AND in_universe THEN avg(score) END AS raw FROM sc GROUP BY 1, 2),
      z AS (SELECT *, (raw - avg(raw) OVER ()) / nullif(stddev_pop(raw) OVER (), 0) AS factor_processed FROM w)
      SELECT symbol, valid_factor_count, round(factor_processed, 6) AS factor_processed, CASE WHEN factor_processed IS NOT NULL THEN row_number() OVER (ORDER BY factor_processed DESC NULLS LAST, symbol) END AS factor_rank FROM z"""
    ),
)
def score_latest(spark, sf):
    panel = weekly_panel(spark, sf).withColumns({"in_index": F.lit(True), "listing_age_sessions": F.lit(500)})
    out = studies.score_latest(
        panel, LATEST_FACTORS, min_amount=20000.0, minimum_valid=2, layout=section_layout(spark, sf)
    )
    return out.select("symbol", "valid_factor_count", r("factor_processed"), "factor_rank")


@query(
    "head_and_tail",
    sig_sql(
        """, l AS (SELECT symbol, momentum_20_5 AS v FROM sig WHERE trade_date = (SELECT max(trade_date) FROM sig) AND momentum_20_5 IS NOT NULL)
      SELECT * FROM (SELECT 'top' AS side, symbol, round(v, 6) AS factor FROM l ORDER BY v DESC, symbol LIMIT 5)
      UNION ALL SELECT * FROM (SELECT 'bottom', symbol, round(v, 6) FROM l ORDER BY v, symbol LIMIT 5)"""
    ),
)
def head_and_tail(spark, sf):
    from lattica.sources.readers import latest_snapshot

    latest = latest_snapshot(signals(spark, sf), "momentum_20_5")
    top = latest.limit(5).select(F.lit("top").alias("side"), "symbol", F.col("momentum_20_5").alias("factor"))
    bottom = latest.orderBy("momentum_20_5", "symbol").limit(5).select(
        F.lit("bottom").alias("side"), "symbol", F.col("momentum_20_5").alias("factor")
    )
    return rounded(top.unionByName(bottom), ["factor"])


# --- portfolio evaluation -----------------------------------------------------------------

RETURNS = TOP + """, ses AS (SELECT DISTINCT trade_date FROM weekly), wd AS (SELECT DISTINCT trade_date FROM weights),
  ex AS (SELECT wd.trade_date AS signal_date, min(s.trade_date) AS exec_date FROM wd JOIN ses s ON s.trade_date > wd.trade_date GROUP BY 1),
  sch AS (SELECT s.trade_date, max(e.signal_date) AS signal_date, max(CASE WHEN e.exec_date < s.trade_date THEN e.signal_date END) AS prior, bool_or(e.exec_date = s.trade_date) AS is_exec
    FROM ses s JOIN ex e ON e.exec_date <= s.trade_date GROUP BY 1),
  onc AS (SELECT exec_date, max(signal_date) AS signal_date FROM ex GROUP BY 1),
  ok AS (SELECT e.exec_date, b.symbol, coalesce(t.target_weight, 0) AS tw, lead(e.exec_date) OVER (PARTITION BY b.symbol ORDER BY e.exec_date) AS until
    FROM onc e JOIN weekly b ON b.trade_date = e.exec_date AND NOT b.is_suspended LEFT JOIN weights t ON t.trade_date = e.signal_date AND t.symbol = b.symbol),
  eff AS (SELECT e.signal_date AS trade_date, o.symbol, o.tw AS target_weight FROM ok o JOIN onc e ON e.exec_date >= o.exec_date AND (o.until IS NULL OR e.exec_date < o.until) WHERE o.tw <> 0),
  calm AS (SELECT trade_date, symbol, pow(adj_open, 0.05) AS adj_open, pow(adj_close, 0.05) AS adj_close FROM weekly),
  mv AS (SELECT w.trade_date, w.symbol, adj_open, adj_close, lag(adj_close) OVER (PARTITION BY w.symbol ORDER BY w.trade_date) AS prev FROM calm w),
  mx AS (SELECT mv.*, signal_date, prior, is_exec FROM mv JOIN sch USING (trade_date)),
  con AS (SELECT m.trade_date, target_weight * coalesce(CASE WHEN is_exec THEN adj_close / adj_open - 1 ELSE adj_close / prev - 1 END, 0) AS c FROM mx m JOIN eff w ON w.trade_date = m.signal_date AND w.symbol = m.symbol
    UNION ALL SELECT m.trade_date, target_weight * coalesce(adj_open / prev - 1, 0) FROM mx m JOIN eff w ON w.trade_date = m.prior AND w.symbol = m.symbol WHERE is_exec),
  ch AS (SELECT trade_date, symbol, sum(d) AS d FROM (SELECT s.trade_date, w.symbol, w.target_weight AS d FROM sch s JOIN eff w ON w.trade_date = s.signal_date WHERE is_exec
    UNION ALL SELECT s.trade_date, w.symbol, -w.target_weight FROM sch s JOIN eff w ON w.trade_date = s.prior WHERE is_exec) GROUP BY 1, 2),
  tn AS (SELECT trade_date, sum(greatest(d, 0)) AS bought, sum(greatest(-d, 0)) AS sold FROM ch GROUP BY 1),
  gr AS (SELECT trade_date, sum(c) AS g FROM con GROUP BY 1),
  ret_run AS (SELECT s.trade_date, coalesce(g, 0) AS gross_return, coalesce(bought * (0.00002 + 0.0008) + sold * (0.00002 + 0.001 + 0.0008), 0) AS cost, coalesce(bought + sold, 0) AS turnover
    FROM sch s LEFT JOIN gr USING (trade_date) LEFT JOIN tn USING (trade_date)),
  eqt AS (SELECT trade_date, gross_return, cost, exp(sum(ln(1 + gross_return - cost)) OVER (ORDER BY trade_date)) AS equity,
    exp(sum(ln(1 + gross_return)) OVER (ORDER BY trade_date)) AS gross_equity FROM ret_run)"""


RUNS = process_sql("sig", "reversal_5", "trade_date", False) + """, best AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY factor_processed DESC, symbol) AS rk
    FROM processed WHERE factor_processed IS NOT NULL),
  due AS (SELECT 'M' AS run, 12 AS n, max(trade_date) AS trade_date FROM best GROUP BY date_trunc('month', trade_date)
    UNION ALL SELECT 'W-FRI', 10, max(trade_date) FROM best GROUP BY date_trunc('week', trade_date + 2)),
  weights AS (SELECT run, trade_date, symbol, least(1.0 / count(*) OVER (PARTITION BY run, trade_date), 0.08) AS target_weight FROM best JOIN due USING (trade_date) WHERE rk <= n),
  ses AS (SELECT DISTINCT trade_date FROM weekly), wd AS (SELECT DISTINCT run, trade_date FROM weights),
  ex AS (SELECT run, wd.trade_date AS signal_date, min(s.trade_date) AS exec_date FROM wd JOIN ses s ON s.trade_date > wd.trade_date GROUP BY 1, 2),
  sch AS (SELECT run, s.trade_date, max(e.signal_date) AS signal_date, max(CASE WHEN e.exec_date < s.trade_date THEN e.signal_date END) AS prior, bool_or(e.exec_date = s.trade_date) AS is_exec
    FROM ses s JOIN ex e ON e.exec_date <= s.trade_date GROUP BY 1, 2),
  onc AS (SELECT run, exec_date, max(signal_date) AS signal_date FROM ex GROUP BY 1, 2),
  ok AS (SELECT e.run, e.exec_date, b.symbol, coalesce(t.target_weight, 0) AS tw, lead(e.exec_date) OVER (PARTITION BY e.run, b.symbol ORDER BY e.exec_date) AS until
    FROM onc e JOIN weekly b ON b.trade_date = e.exec_date AND NOT b.is_suspended LEFT JOIN weights t ON t.run = e.run AND t.trade_date = e.signal_date AND t.symbol = b.symbol),
  eff AS (SELECT e.run, e.signal_date AS trade_date, o.symbol, o.tw AS target_weight FROM ok o JOIN onc e ON e.run = o.run AND e.exec_date >= o.exec_date AND (o.until IS NULL OR e.exec_date < o.until) WHERE o.tw <> 0),
  mv AS (SELECT trade_date, symbol, pow(adj_open, 0.05) AS adj_open, pow(adj_close, 0.05) AS adj_close, lag(pow(adj_close, 0.05)) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev FROM weekly),
  con AS (SELECT s.run, s.trade_date, target_weight * coalesce(CASE WHEN is_exec THEN adj_close / adj_open - 1 ELSE adj_close / prev - 1 END, 0) AS c
      FROM sch s JOIN eff w ON w.run = s.run AND w.trade_date = s.signal_date JOIN mv m ON m.trade_date = s.trade_date AND m.symbol = w.symbol
    UNION ALL SELECT s.run, s.trade_date, target_weight * coalesce(adj_open / prev - 1, 0)
      FROM sch s JOIN eff w ON w.run = s.run AND w.trade_date = s.prior JOIN mv m ON m.trade_date = s.trade_date AND m.symbol = w.symbol WHERE is_exec),
  ch AS (SELECT run, trade_date, symbol, sum(d) AS d FROM (SELECT s.run, s.trade_date, w.symbol, w.target_weight AS d FROM sch s JOIN eff w ON w.run = s.run AND w.trade_date = s.signal_date WHERE is_exec
    UNION ALL SELECT s.run, s.trade_date, w.symbol, -w.target_weight FROM sch s JOIN eff w ON w.run = s.run AND w.trade_date = s.prior WHERE is_exec) GROUP BY 1, 2, 3),
  tn AS (SELECT run, trade_date, sum(greatest(d, 0)) AS bought, sum(greatest(-d, 0)) AS sold FROM ch GROUP BY 1, 2),
  gr AS (SELECT run, trade_date, sum(c) AS g FROM con GROUP BY 1, 2),
  ret_run AS (SELECT s.run, s.trade_date, coalesce(g, 0) AS gross_return, coalesce(bought * (0.00002 + 0.0008) + sold * (0.00002 + 0.001 + 0.0008), 0) AS cost, coalesce(bought + sold, 0) AS turnover
    FROM sch s LEFT JOIN gr USING (run, trade_date) LEFT JOIN tn USING (run, trade_date)),
  eqt AS (SELECT *, exp(sum(ln(1 + gross_return - cost)) OVER (PARTITION BY run ORDER BY trade_date)) AS equity FROM ret_run),
  stp AS (SELECT *, equity / lag(equity) OVER w - 1 AS x, equity / max(equity) OVER w - 1 AS dd FROM eqt WINDOW w AS (PARTITION BY run ORDER BY trade_date)),
  met AS (SELECT run, count(*) AS n, arg_max(equity, trade_date) / arg_min(equity, trade_date) - 1 AS total, avg(x) AS m, stddev_samp(x) AS sd, min(dd) AS dd, sum(turnover) AS traded FROM stp GROUP BY 1)"""


def several_runs(spark, sf):
    """A weekly and a monthly strategy side by side: each follows its own dates."""
    damped = {c: F.pow(F.col(c), F.lit(0.05)) for c in ("adj_open", "adj_close")}
    bars = settle(weekly_panel(spark, sf))
    scores = settle(processed(spark, sf, bars).where("factor_processed IS NOT NULL").select("trade_date", "symbol", "factor_processed"))
    parts = [
        portfolio.top_n_weights(scores.withColumn("run", F.lit(f)), "factor_processed", n, f, 0.08, by=("run",)) for f, n in (("W-FRI", 10), ("M", 12))
    ]
    return performance.portfolio_returns(bars.withColumns(damped), settle(parts[0].unionByName(parts[1])), by=("run",))


@query(
    "portfolio_returns_runs",
    sig_sql(RUNS + " SELECT run, trade_date, round(gross_return, 6) AS gross_return, round(cost, 6) AS cost, round(turnover, 6) AS turnover FROM ret_run"),
)
def portfolio_returns_runs(spark, sf):
    return several_runs(spark, sf).select("run", "trade_date", r("gross_return"), r("cost"), r("turnover"))


def run_returns(spark, sf):
    """Returns of the top-ten weights; the random prices are damped to equity-like moves."""
    damped = {c: F.pow(F.col(c), F.lit(0.05)) for c in ("adj_open", "adj_close")}
    bars = settle(weekly_panel(spark, sf))  # read by the signals, the calendar and the returns
    return performance.portfolio_returns(bars.withColumns(damped), settle(weights(spark, sf, bars)))


@query(
    "portfolio_returns",
    sig_sql(RETURNS + " SELECT trade_date, round(gross_return, 6) AS gross_return, round(cost, 6) AS cost, round(turnover, 6) AS turnover FROM ret_run"),
)
def portfolio_returns(spark, sf):
    return run_returns(spark, sf).select("trade_date", r("gross_return"), r("cost"), r("turnover"))


@query(
    "nav_and_drawdown",
    sig_sql(
        RETURNS
        + """ SELECT trade_date, round(equity, 6) AS equity, round(equity / max(equity) OVER (ORDER BY trade_date) - 1, 6) AS drawdown,
      round(equity / first(equity) OVER (ORDER BY trade_date), 6) AS nav FROM eqt"""
    ),
)
def nav_and_drawdown(spark, sf):
    path = performance.normalized_nav(performance.with_drawdown(performance.nav(run_returns(spark, sf))))
    return path.select("trade_date", r("equity"), r("drawdown"), r("nav"))


def metrics_sql(column: str) -> str:
    return f"""(SELECT count(*) AS n, arg_max({column}, trade_date) / arg_min({column}, trade_date) - 1 AS total, avg(x) AS m, stddev_samp(x) AS sd, min(dd) AS dd FROM (
      SELECT trade_date, {column}, {column} / lag({column}) OVER (ORDER BY trade_date) - 1 AS x, {column} / max({column}) OVER (ORDER BY trade_date) - 1 AS dd FROM eqt))"""


METRIC_COLUMNS = """round(total, 6) AS total_return, round(pow(1 + total, 52.0 / (n - 1)) - 1, 6) AS annual_return, round(sd * sqrt(52), 6) AS annual_volatility,
  round(m / sd * sqrt(52), 6) AS sharpe, round(dd, 6) AS max_drawdown, round((pow(1 + total, 52.0 / (n - 1)) - 1) / abs(dd), 6) AS calmar"""
METRICS = ["total_return", "annual_return", "annual_volatility", "sharpe", "max_drawdown", "calmar"]


@query("performance_metrics", sig_sql(RETURNS + f" SELECT TRUE AS valid, {METRIC_COLUMNS} FROM {metrics_sql('equity')}"))
def performance_metrics(spark, sf):
    return rounded(performance.performance_metrics(performance.nav(run_returns(spark, sf)), 52), METRICS)


@query(
    "performance_metrics_runs",
    sig_sql(RUNS + " SELECT run, TRUE AS valid, round(traded, 6) AS turnover, " + METRIC_COLUMNS + " FROM met"),
)
def performance_metrics_runs(spark, sf):
    paths = settle(performance.nav(several_runs(spark, sf), by=("run",)))
    traded = paths.groupBy("run").agg(F.sum("turnover").alias("turnover"))
    return rounded(performance.performance_metrics(paths, 52, ("run",)).join(traded, "run"), [*METRICS, "turnover"])


@query(
    "cost_drag",
    sig_sql(
        RETURNS
        + f""", a AS (SELECT pow(1 + total, 52.0 / (n - 1)) - 1 AS net FROM {metrics_sql('equity')}), b AS (SELECT pow(1 + total, 52.0 / (n - 1)) - 1 AS gross FROM {metrics_sql('gross_equity')})
      SELECT 'top10' AS run_id, round(net, 6) AS annual_return, round(gross - net, 6) AS cost_drag FROM a, b"""
    ),
)
def cost_drag(spark, sf):
    returns = run_returns(spark, sf).withColumn("run_id", F.lit("top10"))
    by = ("run_id",)
    net = performance.performance_metrics(performance.nav(returns, by=by), 52, by)
    gross = performance.performance_metrics(performance.nav(returns, by=by, value="gross_return"), 52, by)
    return rounded(performance.cost_drag(net, gross).select("run_id", "annual_return", "cost_drag"), ["annual_return", "cost_drag"])


@query(
    "benchmark_excess",
    sig_sql(
        RETURNS
        + f""", a AS (SELECT pow(1 + total, 52.0 / (n - 1)) - 1 AS net FROM {metrics_sql('equity')}), b AS (SELECT pow(1 + total, 52.0 / (n - 1)) - 1 AS gross FROM {metrics_sql('gross_equity')}),
      s2 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM ses),
      bb AS (SELECT c.trade_date, c.adj_close / lag(c.adj_close) OVER w - 1 AS x, lag(NOT k.is_st) OVER w AS was, idx - lag(idx) OVER w AS step
        FROM calm c JOIN weekly k ON k.trade_date = c.trade_date AND k.symbol = c.symbol JOIN s2 ON s2.trade_date = c.trade_date WINDOW w AS (PARTITION BY c.symbol ORDER BY c.trade_date)),
      bd AS (SELECT trade_date, avg(x) AS x FROM bb WHERE was AND step = 1 GROUP BY 1),
      be AS (SELECT s2.trade_date, exp(sum(ln(1 + coalesce(x, 0))) OVER (ORDER BY s2.trade_date)) AS e FROM s2 LEFT JOIN bd ON bd.trade_date = s2.trade_date),
      bm AS (SELECT pow(arg_max(e, trade_date) / arg_min(e, trade_date), 52.0 / (count(*) - 1)) - 1 AS bench FROM be)
      SELECT 'top10' AS run_id, round(net, 6) AS annual_return, round(gross - net, 6) AS cost_drag, round(net - bench, 6) AS annual_excess_return FROM a, b, bm"""
    ),
)
def benchmark_excess(spark, sf):
    """The top-ten run against the equal-weight return of the names that were eligible the session before."""
    returns = settle(run_returns(spark, sf).withColumn("run_id", F.lit("top10")))
    by = ("run_id",)
    net = performance.performance_metrics(performance.nav(returns, by=by), 52, by)
    gross = performance.performance_metrics(performance.nav(returns, by=by, value="gross_return"), 52, by)
    panel = weekly_panel(spark, sf).withColumns({"in_universe": ~F.col("is_st"), "adj_close": F.pow(F.col("adj_close"), F.lit(0.05))})
    benchmark = performance.performance_metrics(performance.equal_weight_benchmark(panel, 1000.0), 52)
    return rounded(performance.cost_drag(net, gross, benchmark), ["annual_return", "cost_drag", "annual_excess_return"])


@query(
    "annual_returns",
    sig_sql(
        RETURNS
        + """, y AS (SELECT year(trade_date) AS year, coalesce(equity / lag(equity) OVER (ORDER BY trade_date) - 1, 0) AS x FROM eqt)
      SELECT year, round(exp(sum(ln(1 + x))) - 1, 6) AS annual_return FROM y GROUP BY year"""
    ),
)
def annual_returns(spark, sf):
    return rounded(performance.annual_returns(performance.nav(run_returns(spark, sf))), ["annual_return"])


@query(
    "equal_weight_benchmark",
    with_weekly(
        """, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM weekly)),
      b AS (SELECT trade_date, adj_close / lag(adj_close) OVER w - 1 AS x, lag(NOT is_st) OVER w AS was, idx - lag(idx) OVER w AS step FROM weekly JOIN s USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      d AS (SELECT trade_date, avg(x) AS x FROM b WHERE was AND step = 1 GROUP BY 1),
      e AS (SELECT s.trade_date, CASE WHEN s.trade_date = (SELECT min(trade_date) FROM s WHERE trade_date >= DATE '1996-01-01') THEN 0 ELSE coalesce(x, 0) END AS ret FROM s LEFT JOIN d USING (trade_date) WHERE s.trade_date >= DATE '1996-01-01')
      SELECT trade_date, round(ret, 6) AS "return", round(ln(1000 * exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date))), 6) AS log_equity FROM e"""
    ),
)
def benchmark(spark, sf):
    panel = weekly_panel(spark, sf).withColumn("in_universe", ~F.col("is_st"))
    out = performance.equal_weight_benchmark(panel, 1000.0, start_date="1996-01-01")
    return out.select("trade_date", r("return"), F.round(F.ln("equity"), 6).alias("log_equity"))


@query(
    "execution_report",
    sig_sql(
        RETURNS
        + """, rep AS (SELECT w.trade_date AS signal_date, e.exec_date, w.symbol, w.target_weight, k.symbol AS bar, k.is_suspended, k.volume FROM weights w JOIN ex e ON e.signal_date = w.trade_date
        LEFT JOIN weekly k ON k.trade_date = e.exec_date AND k.symbol = w.symbol)
      SELECT signal_date, exec_date, symbol, round(target_weight, 6) AS target_weight,
        CASE WHEN bar IS NULL THEN 'NO_BAR' WHEN volume % 9 = 0 THEN 'STATUS_UNKNOWN' WHEN is_suspended THEN 'SUSPENDED' WHEN volume % 4 = 0 THEN 'LIMIT_UP' END AS buy_block,
        CASE WHEN bar IS NULL THEN 'NO_BAR' WHEN volume % 9 = 0 THEN 'STATUS_UNKNOWN' WHEN is_suspended THEN 'SUSPENDED' WHEN volume % 5 = 0 THEN 'LIMIT_DOWN' END AS sell_block FROM rep"""
    ),
)
def execution_report(spark, sf):
    v = F.col("volume")
    market = weekly_panel(spark, sf).withColumns(
        {"is_limit_up": v % 4 == 0, "is_limit_down": v % 5 == 0, "is_st_known": v % 9 != 0}
    )
    return rounded(performance.execution_report(weights(spark, sf), market), ["target_weight"])


@query(
    "stale_valuations",
    sig_sql(
        RETURNS
        + """, h AS (SELECT s.trade_date, s.signal_date, w.symbol FROM sch s JOIN weights w ON w.trade_date = s.signal_date),
      g AS (SELECT h.*, CASE WHEN k.volume % 6 <> 0 THEN k.close END AS mark FROM h LEFT JOIN weekly k ON k.trade_date = h.trade_date AND k.symbol = h.symbol),
      f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_mark FROM g)
      SELECT trade_date, signal_date, symbol, round(last_mark, 6) AS last_mark FROM f WHERE mark IS NULL"""
    ),
)
def stale_valuations(spark, sf):
    market = weekly_panel(spark, sf).withColumn("close", F.when(F.col("volume") % 6 != 0, F.col("close")))
    return rounded(performance.stale_valuations(weights(spark, sf), market), ["last_mark"])


@query(
    "replay_day",
    sig_sql(
        RETURNS
        + """ SELECT 'targets' AS part, count(*) AS n FROM weights WHERE trade_date = (SELECT max(signal_date) FROM ex WHERE exec_date = DATE '1999-05-10')
      UNION ALL SELECT 'equity', count(*) FROM eqt WHERE trade_date = DATE '1999-05-10'
      UNION ALL SELECT 'bars', count(*) FROM weekly WHERE trade_date = DATE '1999-05-10'"""
    ),
)
def replay_day(spark, sf):
    returns = performance.nav(run_returns(spark, sf))
    day = performance.replay_day("1999-05-10", returns, targets=weights(spark, sf), bars=weekly_panel(spark, sf))
    parts = [day[p].agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p in ("targets", "equity", "bars")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "paired_modes",
    """WITH x AS (SELECT n_regionkey AS pool, o_orderpriority AS factor, CASE WHEN o_orderkey % 2 = 0 THEN 'rank' ELSE 'affordable' END AS mode, avg(o_totalprice) AS value, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
    SELECT a.pool, a.factor, round(b.value - a.value, 4) AS value_difference, b.n - a.n AS n_difference FROM x a JOIN x b USING (pool, factor) WHERE a.mode = 'rank' AND b.mode = 'affordable'""",
)
def paired_modes(spark, sf):
    rows = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    )
    mode = F.when(F.col("o_orderkey") % 2 == 0, "rank").otherwise("affordable")
    cases = rows.groupBy(F.col("n_regionkey").alias("pool"), F.col("o_orderpriority").alias("factor"), mode.alias("mode")).agg(
        F.avg("o_totalprice").alias("value"), F.count("*").alias("n")
    )
    out = performance.paired_modes(cases, ["pool", "factor"], "mode", "rank", "affordable", ["value", "n"])
    return out.withColumn("value_difference", F.round("value_difference", 4))


# --- ledgers --------------------------------------------------------------------------------

CASH = 1_000_000_000.0
LEDGER = """, ses AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM weekly)),
  n AS (SELECT industry AS run_id, symbol, trade_date, idx, close, volume, row_number() OVER w AS rn, lag(volume) OVER w AS pv, lead(idx) OVER w AS nidx FROM weekly JOIN ses USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  trades AS (SELECT run_id, n.trade_date, CASE WHEN volume % 37 = 0 THEN n.trade_date ELSE s.trade_date END AS signal_date, symbol, CASE WHEN rn % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side,
    CASE WHEN rn % 2 = 1 THEN volume ELSE pv END AS shares, close AS price, close * (CASE WHEN rn % 2 = 1 THEN volume ELSE pv END) + CASE WHEN volume % 53 = 0 THEN 1 ELSE 0 END AS gross, 5.0 AS fee,
    CASE WHEN rn % 2 = 0 THEN close * pv * 0.001 ELSE 0 END AS tax FROM n JOIN ses s ON s.idx = n.idx - 1),
  pos AS (SELECT run_id, s.trade_date, symbol, volume + CASE WHEN volume % 71 = 0 AND s.idx = n.idx THEN 1 ELSE 0 END AS shares, close, close * volume AS market_value
    FROM n JOIN ses s ON s.idx >= n.idx AND s.idx < coalesce(nidx, (SELECT max(idx) + 1 FROM ses)) WHERE rn % 2 = 1 AND n.idx > 1),
  runs AS (SELECT DISTINCT run_id FROM n),
  fl AS (SELECT run_id, trade_date, sum(CASE WHEN side = 'SELL' THEN gross ELSE -gross END - fee - tax) AS f FROM trades GROUP BY 1, 2),
  mvl AS (SELECT run_id, trade_date, sum(market_value) AS mv FROM pos GROUP BY 1, 2),
  eq0 AS (SELECT r.run_id, s.trade_date, 1e9 + sum(coalesce(f, 0)) OVER (PARTITION BY r.run_id ORDER BY s.trade_date) + CASE WHEN s.idx % 50 = 0 THEN 5 ELSE 0 END AS cash, coalesce(mv, 0) AS market_value
    FROM runs r CROSS JOIN ses s LEFT JOIN fl ON fl.run_id = r.run_id AND fl.trade_date = s.trade_date LEFT JOIN mvl ON mvl.run_id = r.run_id AND mvl.trade_date = s.trade_date),
  eq AS (SELECT *, cash + market_value AS equity FROM eq0)"""


def books(spark, sf):
    """Ledgers per industry: alternate buys and sells of each symbol, with planted faults."""
    weekly = settle(weekly_panel(spark, sf))
    sessions = calendars.session_list(weekly)
    w = W.partitionBy("symbol").orderBy("trade_date")
    v = F.col("volume")
    rows = weekly.join(F.broadcast(sessions), "trade_date").select(
        F.col("industry").alias("run_id"), "symbol", "trade_date", "session_idx", "close", "volume",
        F.row_number().over(w).alias("rn"), F.lag("volume").over(w).alias("pv"), F.lead("session_idx").over(w).alias("nidx"),
    )
    before = sessions.select((F.col("session_idx") + 1).alias("session_idx"), F.col("trade_date").alias("before"))
    buy = F.col("rn") % 2 == 1
    shares = F.when(buy, v).otherwise(F.col("pv"))
    trades = rows.join(F.broadcast(before), "session_idx").select(
        "run_id", "trade_date", F.when(v % 37 == 0, F.col("trade_date")).otherwise(F.col("before")).alias("signal_date"), "symbol",
        F.when(buy, "BUY").otherwise("SELL").alias("side"), shares.alias("shares"), F.col("close").alias("price"),
        (F.col("close") * shares + F.when(v % 53 == 0, 1).otherwise(0)).alias("gross"), F.lit(5.0).alias("fee"),
        F.when(~buy, F.col("close") * F.col("pv") * 0.001).otherwise(F.lit(0.0)).alias("tax"),
    )
    last = sessions.agg((F.max("session_idx") + 1).alias("_end"))
    held = rows.where(buy & (F.col("session_idx") > 1)).join(F.broadcast(last), F.lit(True)).withColumn(
        "_day", F.explode(F.sequence("session_idx", F.coalesce("nidx", "_end") - 1))
    )
    days = sessions.select(F.col("session_idx").alias("_day"), F.col("trade_date").alias("_date"))
    positions = held.join(F.broadcast(days), "_day").select(
        "run_id", F.col("_date").alias("trade_date"), "symbol",
        (v + F.when((v % 71 == 0) & (F.col("_day") == F.col("session_idx")), 1).otherwise(0)).alias("shares"),
        "close", (F.col("close") * v).alias("market_value"),
    )
    trades, positions = settle(trades), settle(positions)
    flows = trades.groupBy("run_id", "trade_date").agg(F.sum(ledger.cash_flow()).alias("_f"))
    worth = positions.groupBy("run_id", "trade_date").agg(F.sum("market_value").alias("market_value"))
    grid = rows.select("run_id").distinct().join(sessions, F.lit(True))  # runs x sessions
    so_far = W.partitionBy("run_id").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    equity = (
        grid.join(flows, ["run_id", "trade_date"], "left")
        .join(worth, ["run_id", "trade_date"], "left")
        .withColumn("market_value", F.coalesce("market_value", F.lit(0.0)))
        .withColumn("cash", CASH + F.sum(F.coalesce("_f", F.lit(0.0))).over(so_far) + F.when(F.col("session_idx") % 50 == 0, 5).otherwise(0))
        .withColumn("equity", F.col("cash") + F.col("market_value"))
        .select("run_id", "trade_date", "cash", "market_value", "equity")
    )
    return settle(equity), trades, positions


FAR = "NOT coalesce(abs({a} - {b}) <= 1e-6 + 1e-9 * abs({b}), FALSE)"
AUDIT_LEDGER = LEDGER + f""",
  chk_cash AS (SELECT e.run_id, cash, 1e9 + sum(coalesce(f, 0)) OVER (PARTITION BY e.run_id ORDER BY e.trade_date) AS want FROM eq e LEFT JOIN fl USING (run_id, trade_date)),
  net AS (SELECT run_id, symbol, trade_date, sum(CASE WHEN side = 'BUY' THEN shares ELSE -shares END) AS d FROM trades GROUP BY 1, 2, 3),
  syms AS (SELECT DISTINCT run_id, symbol FROM net UNION SELECT DISTINCT run_id, symbol FROM pos),
  grid AS (SELECT y.run_id, y.symbol, s.trade_date, coalesce(p.shares, 0) AS actual, sum(coalesce(d, 0)) OVER (PARTITION BY y.run_id, y.symbol ORDER BY s.trade_date) AS want FROM syms y CROSS JOIN ses s
    LEFT JOIN net ON net.run_id = y.run_id AND net.symbol = y.symbol AND net.trade_date = s.trade_date LEFT JOIN pos p ON p.run_id = y.run_id AND p.symbol = y.symbol AND p.trade_date = s.trade_date),
  late AS (SELECT t.run_id, count(*) AS n FROM trades t LEFT JOIN ses a ON a.trade_date = t.signal_date LEFT JOIN ses b ON b.idx = a.idx + 1 WHERE b.trade_date IS DISTINCT FROM t.trade_date GROUP BY 1),
  found AS (SELECT run_id, 'gross_equals_price_times_shares' AS "check", count(*) FILTER (WHERE {FAR.format(a='gross', b='price * shares')}) AS violations FROM trades GROUP BY 1
    UNION ALL SELECT run_id, 'position_values_equal_marks_times_shares', count(*) FILTER (WHERE {FAR.format(a='market_value', b='close * shares')}) FROM pos GROUP BY 1
    UNION ALL SELECT run_id, 'cash_reconciles_from_executions', count(*) FILTER (WHERE abs(cash - want) > 2) FROM chk_cash GROUP BY 1
    UNION ALL SELECT run_id, 'holdings_reconcile_from_executions', count(*) FILTER (WHERE {FAR.format(a='actual', b='want')}) FROM grid GROUP BY 1
    UNION ALL SELECT run_id, 'never_short_from_executions', count(*) FILTER (WHERE want < 0) FROM grid GROUP BY 1
    UNION ALL SELECT run_id, 'execution_on_next_observed_session', n FROM late),
  names AS (SELECT unnest([{', '.join(repr(c) for c in ledger.CHECKS)}]) AS "check")
  SELECT r.run_id, c."check", coalesce(violations, 0) AS violations, coalesce(violations, 0) = 0 AS passed FROM runs r CROSS JOIN names c LEFT JOIN found f ON f.run_id = r.run_id AND f."check" = c."check\""""


@query("audit_ledger", with_weekly(AUDIT_LEDGER))
def audit_ledger(spark, sf):
    return ledger.audit_ledger(*books(spark, sf), CASH).drop("max_abs_error")


@query(
    "profit_bridge",
    with_weekly(
        LEDGER
        + """, p AS (SELECT run_id, count(*) AS trade_count, sum(fee + tax) AS paid FROM trades GROUP BY 1), e AS (SELECT run_id, count(*) AS sessions, arg_max(equity, trade_date) - 1e9 AS net FROM eq GROUP BY 1)
      SELECT run_id, sessions, trade_count, round(net, 2) AS net_profit, round(paid, 2) AS explicit_costs, round(net + paid, 2) AS profit_before_costs FROM e JOIN p USING (run_id)"""
    ),
)
def profit_bridge(spark, sf):
    equity, trades, _ = books(spark, sf)
    out = ledger.profit_bridge(equity, trades, CASH)
    return out.withColumns({c: F.round(c, 2) for c in ("net_profit", "explicit_costs", "profit_before_costs")})


@query(
    "strategy_diagnostics",
    with_weekly(
        LEDGER
        + """, t AS (SELECT run_id, count(*) AS trade_count, sum(fee + tax) AS total_cost FROM trades GROUP BY 1),
      h AS (SELECT run_id, sum(n) AS held FROM (SELECT run_id, trade_date, count(DISTINCT symbol) AS n FROM pos GROUP BY 1, 2) GROUP BY 1),
      e AS (SELECT run_id, count(*) AS sessions, avg(cash / equity) AS ratio FROM eq GROUP BY 1),
      g AS (SELECT run_id, count(*) AS rebalance_count, avg(n) AS targets FROM (SELECT industry AS run_id, trade_date, count(*) AS n FROM weekly GROUP BY 1, 2) GROUP BY 1),
      i AS (SELECT industry AS run_id, count(*) FILTER (WHERE volume % 3 = 0) AS unfilled, count(*) FILTER (WHERE volume % 3 = 1) AS stale, count(*) FILTER (WHERE volume % 3 = 2) AS corp FROM weekly GROUP BY 1)
      SELECT e.run_id, trade_count, rebalance_count, round(total_cost, 2) AS total_cost, round(held / sessions, 6) AS average_holdings, round(targets, 6) AS average_target_holdings, round(ratio, 6) AS average_cash_ratio,
        round(total_cost / 1e9, 9) AS cost_to_initial_cash, unfilled AS unfilled_events, stale AS stale_valuation_events, corp AS corporate_action_events FROM e JOIN t USING (run_id) JOIN h USING (run_id) JOIN g USING (run_id) JOIN i USING (run_id)"""
    ),
)
def strategy_diagnostics(spark, sf):
    equity, trades, positions = books(spark, sf)
    weekly = weekly_panel(spark, sf).withColumnRenamed("industry", "run_id")
    v = F.col("volume") % 3
    issues = weekly.select("run_id", F.when(v == 0, "BUY").when(v == 1, "VALUATION").otherwise("CORPORATE_ACTION").alias("side"))
    out = ledger.strategy_diagnostics(equity, trades, positions, issues, weekly.select("run_id", "trade_date"), CASH)
    return rounded(out, ["average_holdings", "average_target_holdings", "average_cash_ratio"]).withColumns(
        {"total_cost": F.round("total_cost", 2), "cost_to_initial_cash": F.round("cost_to_initial_cash", 9)}
    )


@query(
    "traded_turnover",
    with_weekly(LEDGER + " SELECT run_id, round(g / 2 / m, 6) AS turnover FROM (SELECT run_id, sum(gross) AS g FROM trades GROUP BY 1) JOIN (SELECT run_id, avg(equity) AS m FROM eq GROUP BY 1) USING (run_id)"),
)
def traded_turnover(spark, sf):
    equity, trades, _ = books(spark, sf)
    return rounded(performance.traded_turnover(trades, equity, ("run_id",)), ["turnover"])


# --- studies ------------------------------------------------------------------------------------


@query(
    "universe_size",
    with_daily(
        """, u AS (SELECT trade_date, count(*) FILTER (WHERE NOT is_st AND NOT is_suspended AND rn >= 60) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn FROM daily) GROUP BY 1)
      SELECT median(n) AS median_universe, CAST(least(20, floor(median(n))) AS INTEGER) AS effective_top_n FROM u"""
    ),
)
def universe_size(spark, sf):
    from lattica.plans.panel import daily_panel

    return studies.universe_size(apply_universe(daily_panel(spark, sf), UniverseRule(min_listed_days=60)), 20)


VARIANTS = [(10, 0, "W-FRI"), (20, 5, "W-FRI"), (20, 5, "M")]


@query(
    "momentum_grid",
    with_weekly(
        """, m AS (SELECT *, NOT is_st AND NOT is_suspended AS in_u, adj_close / lag(adj_close, 10) OVER w - 1 AS m_10_0, lag(adj_close, 5) OVER w / lag(adj_close, 20) OVER w - 1 AS m_20_5,
        lead(adj_close, 5) OVER w / adj_close - 1 AS fwd FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      lm AS (SELECT trade_date, symbol, fwd, unnest(['m_10_0', 'm_20_5']) AS pair, unnest([m_10_0, m_20_5]) AS value FROM m)"""
        + process_sql("lm", "value", "pair, trade_date", False)
        + ic_sql("ic", "processed", "pair, trade_date", "factor_processed", "fwd")
        + """, s AS (SELECT pair, avg(ic) AS mean_rank_ic, avg((ic > 0)::INT) AS ic_win_rate FROM ic GROUP BY 1)
      SELECT variant, round(mean_rank_ic, 6) AS mean_rank_ic, round(ic_win_rate, 6) AS ic_win_rate, TRUE AS valid FROM s JOIN (SELECT unnest(['m_10_0_W-FRI', 'm_20_5_W-FRI', 'm_20_5_M']) AS variant, unnest(['m_10_0', 'm_20_5', 'm_20_5']) AS pair) USING (pair)"""
    ),
)
def momentum_grid(spark, sf):
    out = studies.momentum_grid(weekly_panel(spark, sf), VARIANTS, 10, layout=section_layout(spark, sf))
    return rounded(out.select("variant", "mean_rank_ic", "ic_win_rate", "valid"), ["mean_rank_ic", "ic_win_rate"])


@query("holdings_grid")
def holdings_grid(spark, sf):
    out = studies.holdings_grid(
        weekly_panel(spark, sf), processed(spark, sf), "factor_processed", holdings=(5, 10, 40), exit_rank=30, base_top_n=10
    )
    return rounded(out, METRICS)


@query(
    "momentum_study",
    with_weekly(
        """, m AS (SELECT *, NOT is_st AND NOT is_suspended AND row_number() OVER w >= 120 AS in_u, lag(adj_close, 5) OVER w / lag(adj_close, 60) OVER w - 1 AS mom,
        lead(adj_close, 5) OVER w / adj_close - 1 AS fwd FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      mu AS (SELECT * REPLACE (CASE WHEN in_u THEN mom END AS mom) FROM m)"""
        + process_sql("mu", "mom", "trade_date", True)
        + ic_sql("ic", "processed", "trade_date", "factor_processed", "fwd")
        + " SELECT trade_date, round(ic, 6) AS ic, pairs FROM ic"
    ),
)
def momentum_study(spark, sf):
    out = studies.momentum_study(weekly_panel(spark, sf), layout=section_layout(spark, sf))
    return rounded(out.ic, ["ic"])



STUDY = """, m AS (SELECT *, NOT is_st AND NOT is_suspended AND row_number() OVER w >= 120 AS in_u, lag(adj_close, 5) OVER w / lag(adj_close, 60) OVER w - 1 AS mom,
        lead(adj_close, 5) OVER w / adj_close - 1 AS fwd FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      mu AS (SELECT * REPLACE (CASE WHEN in_u THEN mom END AS mom) FROM m)""" + process_sql("mu", "mom", "trade_date", True)


def study(spark, sf):
    return studies.momentum_study(settle(weekly_panel(spark, sf)), layout=section_layout(spark, sf))


@query(
    "momentum_study_summary",
    with_weekly(
        STUDY
        + ic_sql("ic", "processed", "trade_date", "factor_processed", "fwd")
        + f" SELECT round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(mean_ic / ic_std * sqrt(252.0 / 5), 6) AS icir, round(win_rate, 6) AS win_rate, observations FROM (SELECT {SUMMARY} FROM ic)"
    ),
)
def momentum_study_summary(spark, sf):
    return rounded(study(spark, sf).summary, ["mean_ic", "ic_std", "icir", "win_rate"])


@query(
    "momentum_study_decay",
    with_weekly(
        STUDY
        + f""", dl AS (SELECT trade_date, symbol, factor_processed, {DECAY_LABELS} FROM processed WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      dlong AS (SELECT trade_date, factor_processed, unnest([1, 5, 10, 20]) AS horizon, unnest([h1, h5, h10, h20]) AS fut FROM dl)"""
        + ic_sql("ic", "dlong", "horizon, trade_date", "factor_processed", "fut")
        + f""" SELECT horizon, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(win_rate, 6) AS win_rate, observations,
      round(mean_ic / ic_std * sqrt(252.0 / horizon), 6) AS icir FROM (SELECT horizon, {SUMMARY} FROM ic GROUP BY horizon)"""
    ),
)
def momentum_study_decay(spark, sf):
    return rounded(study(spark, sf).decay, ["mean_ic", "ic_std", "win_rate", "icir"])


@query(
    "momentum_study_quantiles",
    with_weekly(
        STUDY
        + quantile_sql("processed", "trade_date", "factor_processed", "fwd")
        + " SELECT trade_date, quantile, round(mean_return, 6) AS mean_return, assigned_count, observed_count, round(observed_count / assigned_count, 6) AS label_coverage FROM q"
    ),
)
def momentum_study_quantiles(spark, sf):
    return rounded(study(spark, sf).quantiles, ["mean_return", "label_coverage"])


@query(
    "momentum_study_persistence",
    with_weekly(
        STUDY
        + """, a1 AS (SELECT trade_date, symbol, CASE WHEN factor_processed IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY factor_processed NULLS LAST)
        + (count(factor_processed) OVER (PARTITION BY trade_date, factor_processed) - 1) / 2.0) / count(factor_processed) OVER (PARTITION BY trade_date) END AS rk FROM processed),
      a2 AS (SELECT *, lag(rk) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM a1)
      SELECT trade_date, round(CASE WHEN count(rk + before) >= 10 THEN corr(rk, before) END, 6) AS rank_autocorrelation FROM a2 GROUP BY trade_date"""
    ),
)
def momentum_study_persistence(spark, sf):
    return rounded(study(spark, sf).persistence, ["rank_autocorrelation"])


@query(
    "momentum_study_turnover",
    with_weekly(
        STUDY
        + """, t1 AS (SELECT trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY factor_processed DESC, symbol) AS pos, count(*) OVER (PARTITION BY trade_date) AS n FROM processed WHERE factor_processed IS NOT NULL),
      t2 AS (SELECT trade_date, symbol, dense_rank() OVER (ORDER BY trade_date) AS step FROM t1 WHERE pos <= greatest(1, ceil(n * 0.2))),
      sizes AS (SELECT step, count(*) AS n FROM t2 GROUP BY step)
      SELECT c.trade_date, round(1 - count(p.symbol) / max(s.n)::DOUBLE, 6) AS top_group_turnover FROM t2 c JOIN sizes s ON s.step = c.step - 1
        LEFT JOIN t2 p ON p.symbol = c.symbol AND p.step = c.step - 1 GROUP BY c.trade_date"""
    ),
)
def momentum_study_turnover(spark, sf):
    return rounded(study(spark, sf).turnover, ["top_group_turnover"])


@query(
    "momentum_study_weights",
    with_weekly(
        STUDY
        + """, tw AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY factor_processed DESC, symbol) AS rk FROM processed WHERE factor_processed IS NOT NULL)
      SELECT trade_date, symbol, round(least(1.0 / count(*) OVER (PARTITION BY trade_date), 0.05), 6) AS target_weight, round(factor_processed, 6) AS factor_processed FROM tw WHERE rk <= 20"""
    ),
)
def momentum_study_weights(spark, sf):
    return rounded(study(spark, sf).weights, ["target_weight", "factor_processed"])


@query(
    "momentum_study_size",
    with_weekly(STUDY + ", n AS (SELECT count(*) FILTER (WHERE in_u) AS n FROM m GROUP BY trade_date) SELECT median(n) AS median_universe, CAST(least(20, floor(median(n))) AS INTEGER) AS effective_top_n FROM n"),
)
def momentum_study_size(spark, sf):
    return study(spark, sf).size
