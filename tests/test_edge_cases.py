"""Blocked names, scores that are no numbers, changes without priority, books without equity, unsound order inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.trading import Costs
from lattica.operators import ledger, merging, performance, portfolio, preprocess
from lattica.operators.calendars import session_list

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
MARKET = "trade_date date, symbol string, open double, close double, adj_open double, adj_close double, is_suspended boolean, is_limit_up boolean, is_limit_down boolean"
WEIGHTS = "trade_date date, symbol string, target_weight double"


def bar(day, symbol, opened=10.0, close=10.0, halted=False, up=False, down=False):
    return (day, symbol, opened, close, opened, close, halted, up, down)


def test_a_name_without_a_bar_is_not_bought_before_it_trades(spark):
    market = [bar(d, "y") for d in DAYS[:6]] + [bar(DAYS[0], "x", 10.0, 10.0), bar(DAYS[3], "x", 11.0, 11.45), bar(DAYS[4], "x", 11.45, 12.0), bar(DAYS[5], "x", 12.0, 12.0)]
    weights = spark.createDataFrame([(DAYS[0], "x", 1.0), (DAYS[3], "x", 1.0)], WEIGHTS)
    free = Costs(commission_rate=0.0, transfer_fee_rate=0.0, stamp_duty_rate=0.0, historical_stamp_duty_rate=0.0, slippage_bps=0.0)
    got = {r.trade_date: (r.gross_return, r.turnover) for r in performance.portfolio_returns(spark.createDataFrame(market, MARKET), weights, free).collect()}
    assert got[DAYS[1]] == (0.0, 0.0) and got[DAYS[2]] == (0.0, 0.0) and got[DAYS[3]] == (0.0, 0.0)
    assert got[DAYS[4]] == (pytest.approx(12.0 / 11.45 - 1), 1.0)  # the next execution finds it trading


def stepwise(market, weights):
    """Weights after each execution, one execution and name at a time."""
    bars = {(b[0], b[1]): b for b in market}
    sessions = sorted({b[0] for b in market})
    executions = {}
    for signal in sorted({w[0] for w in weights}):
        after = [s for s in sessions if s > signal]
        if after:
            executions[after[0]] = signal
    held, out = {}, {}
    for day, signal in sorted(executions.items()):
        goal = {s: w for d, s, w in weights if d == signal}
        for name in sorted(set(held) | set(goal)):
            now, want, b = held.get(name, 0.0), goal.get(name, 0.0), bars.get((day, name))
            if want == now or b is None or b[6] or not b[2] or b[2] <= 0 or (want > now and b[7]) or (want < now and b[8]):
                continue
            held[name] = want
        out.update({(signal, s): w for s, w in held.items() if w})
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocked_names_keep_their_weight(spark, seed):
    rng = np.random.default_rng(seed)
    symbols = [f"S{i}" for i in range(8)]
    market = [
        bar(d, s, None if rng.random() < 0.05 else 10.0 + rng.random(), 10.0 + rng.random(), bool(rng.random() < 0.1), bool(rng.random() < 0.2), bool(rng.random() < 0.2))
        for d in DAYS for s in symbols if rng.random() < 0.8
    ]
    weights = [(d, s, float(rng.integers(1, 5)) / 40) for d in DAYS[2:-1:3] for s in symbols if rng.random() < 0.5]
    frame, targets = spark.createDataFrame(market, MARKET), spark.createDataFrame(weights, WEIGHTS)
    schedule = performance.effective_schedule(targets, session_list(frame))
    got = performance.executed_weights(targets, frame, schedule)
    assert {(r.trade_date, r.symbol): r.target_weight for r in got.collect()} == stepwise(market, weights)


def test_scores_that_are_no_numbers_are_not_ranked(spark):
    scores = spark.createDataFrame([(DAYS[0], "nan", float("nan")), (DAYS[0], "inf", float("inf")), (DAYS[0], "a", 1.0), (DAYS[0], "b", 2.0), (DAYS[0], "none", None)], "trade_date date, symbol string, s double")
    assert sorted(r.symbol for r in portfolio.top_n_weights(scores, "s", 2).collect()) == ["a", "b"]
    assert sorted(r.symbol for r in portfolio.buffered_top_n(scores, "s", 2, 3).collect()) == ["a", "b"]


def test_preprocessing_leaves_out_what_is_no_number(spark):
    rows = [(DAYS[0], f"S{i}", float(v)) for i, v in enumerate([1, 2, 3, 4, 100])]
    plain = spark.createDataFrame(rows, "trade_date date, symbol string, factor double")
    odd = plain.unionByName(spark.createDataFrame([(DAYS[0], "nan", float("nan")), (DAYS[0], "inf", float("-inf"))], plain.schema))
    for step in (lambda d: preprocess.winsorize_mad(d, "factor", "out"), lambda d: preprocess.zscore(d, "factor", "out"), lambda d: preprocess.preprocess(d).withColumn("out", F.col("factor_processed"))):
        wanted, got = ({r.symbol: r.out for r in step(d).collect()} for d in (plain, odd))
        assert got == {**wanted, "nan": None, "inf": None}


def test_changes_without_priority_replace_rows_without(spark):
    base = spark.createDataFrame([("A", DAYS[0], 1.0), ("B", DAYS[0], 5.0)], "symbol string, trade_date date, close double")
    change = base.where("symbol = 'A'").withColumn("close", F.lit(2.0))
    for own in (change, change.withColumn("priority", F.lit(None).cast("int"))):
        got = {r.symbol: (r.close, r.priority) for r in merging.upsert(base, own).collect()}
        assert got == {"A": (2.0, 0), "B": (5.0, -1)}


def test_a_run_without_equity_fails(spark):
    equity = spark.createDataFrame([("a", DAYS[0], 100.0, 0.0, 100.0)], "run_id string, trade_date date, cash double, market_value double, equity double")
    trades = spark.createDataFrame([("b", DAYS[0], DAYS[0], "x", "BUY", 1.0, 5.0, 5.0, 0.0, 0.0)], "run_id string, trade_date date, signal_date date, symbol string, side string, shares double, price double, gross double, fee double, tax double")
    positions = spark.createDataFrame([("c", DAYS[0], "x", 1.0, 5.0, 5.0)], "run_id string, trade_date date, symbol string, shares double, close double, market_value double")
    failed = {(r.run_id, r.check) for r in ledger.audit_ledger(equity, trades, positions, 100.0).collect() if not r.passed}
    assert not [c for r, c in failed if r == "a"]
    for run in "bc":
        assert {(run, "equity_finite_nonnegative"), (run, "dates_within_equity_calendar")} <= failed


def test_unsound_order_inputs_get_one_row_with_the_reason(spark):
    targets = [(1, "600001.SH", 0.9, 1), (1, "600002.SH", 0.9, 2), (2, "600001.SH", -0.5, 1), (3, "600001.SH", float("nan"), 1), (4, "600001.SH", 0.4, 1), (4, "600001.SH", 0.4, 1), (5, "600003.SH", 0.5, 1), (6, "600001.SH", 0.5, 1), (9, "600001.SH", 0.5, 1)]
    frame = spark.createDataFrame(targets, "account_id int, symbol string, target_weight double, factor_rank int")
    accounts = spark.createDataFrame([(k, 10_000.0) for k in range(1, 8)], "account_id int, cash double")
    holdings = spark.createDataFrame([(7, "600001.SH", 100.0), (7, "600001.SH", 200.0), (8, "600001.SH", 5.0)], "account_id int, symbol string, shares double")
    prices = spark.createDataFrame([("600001.SH", 10.0), ("600001.SH", 10.0), ("600002.SH", 10.0), ("600003.SH", 10.0), ("600003.SH", 11.0)], "symbol string, close double")
    found = portfolio.estimate_orders(frame, accounts, holdings, prices, "2024-03-04", Costs()).collect()
    assert {r.account_id: r.status for r in found} == {1: "WEIGHTS_INVALID", 2: "WEIGHTS_INVALID", 3: "WEIGHTS_INVALID", 4: "WEIGHTS_INVALID", 5: "PRICE_AMBIGUOUS", 6: "REVIEW_REQUIRED", 7: "REVIEW_REQUIRED", 8: "ACCOUNT_UNKNOWN", 9: "ACCOUNT_UNKNOWN"}
    assert len(found) == 9 and {r.account_id: (r.side, r.shares) for r in found if r.side} == {6: ("BUY", 500), 7: ("SELL", 300)}
