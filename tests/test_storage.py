"""Writes by arrival, snapshots, fingerprints, memberships, extracts and ledgers that must be refused."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lattica.operators import ledger, merging, universe
from lattica.sources import vendors, writers

DAY = dt.date(2024, 1, 2)
BARS = "trade_date date, symbol string, close double, priority int"


def bars(spark, *data, arrival=None):
    df = spark.createDataFrame([(DAY, s, c, p) for s, c, p in data], BARS)
    return df if arrival is None else df.withColumn("arrival", F.lit(arrival).cast("long"))


def closes(df):
    return {r.symbol: r.close for r in df.collect()}


def test_corrections_of_one_priority_win(spark):
    many = [(f"S{i}", float(i), 1) for i in range(200)]
    fixed = [(s, c + 1000, p) for s, c, p in many]
    assert closes(merging.upsert(bars(spark, *many), bars(spark, *fixed))) == {s: c for s, c, _ in fixed}


def test_replays_and_lesser_sources_change_nothing(spark):
    first, second, third = (bars(spark, ("A", c, 1), arrival=n) for n, c in enumerate((1.0, 2.0, 3.0)))
    table = merging.upsert(merging.upsert(first, second), third)
    assert closes(merging.upsert(table, second)) == {"A": 3.0}
    assert closes(merging.upsert(table, bars(spark, ("A", 9.0, 0), arrival=9))) == {"A": 3.0}
    assert closes(merging.upsert(table, bars(spark, ("A", 4.0, 1)))) == {"A": 4.0}


def test_yearly_table_takes_two_corrections(spark, tmp_path):
    path = str(tmp_path / "bars")
    for close in (1.0, 2.0, 3.0):
        writers.upsert_years(spark, path, bars(spark, ("A", close, 1), ("B", -close, 1)))
    assert closes(spark.read.parquet(path)) == {"A": 3.0, "B": -3.0}
    assert [p.name for p in tmp_path.iterdir() if "staging" not in p.name] == ["bars"]


def test_moved_null_and_added_column_are_seen(spark, tmp_path):
    a = spark.createDataFrame([(None, 5.0)], "x double, y double")
    b = spark.createDataFrame([(5.0, None)], "x double, y double")
    assert not writers.same_content(a, b)
    assert writers.write_once(a, str(tmp_path), "2024-01-02") == "RECORDED"
    assert writers.write_once(a, str(tmp_path), "2024-01-02") == "VERIFIED_EXISTING"
    for other in (b, a.withColumn("z", F.lit(1)), a.drop("y")):
        with pytest.raises(RuntimeError):
            writers.write_once(other, str(tmp_path), "2024-01-02")


def test_repeated_members_do_not_multiply_bars(spark):
    market = bars(spark, ("A", 1.0, 1), ("B", 2.0, 1))
    members = spark.createDataFrame([(DAY, "A", 0.2), (DAY, "A", 0.3)], "trade_date date, symbol string, weight double")
    found = rows(universe.attach_membership(market, members), "symbol")
    assert [(r["symbol"], r["in_index"], r["index_weight"]) for r in found] == [("A", True, 0.3), ("B", False, 0.0)]


def test_unrequested_and_empty_partitions_are_listed(spark):
    data = spark.createDataFrame([(1, "A", DAY), (9, "A", DAY)], "partition int, code string, d date")
    windows = spark.createDataFrame([(1, DAY, DAY), (2, DAY, DAY)], "partition int, start_date date, end_date date")
    out = vendors.extract_violations(data, ["code", "d"], "code", "d", windows, data.select("code"), 10)
    found = {r.partition: (r.rows, r.unrequested_partition, r.accepted) for r in out.collect()}
    assert found == {1: (1, False, True), 2: (0, False, True), 9: (1, True, False)}


def test_repeated_ledger_keys_fail(spark):
    equity = spark.createDataFrame([("r", DAY, 100.0, 0.0, 100.0)] * 2, "run_id string, trade_date date, cash double, market_value double, equity double")
    trades = spark.createDataFrame(
        [], "run_id string, trade_date date, signal_date date, symbol string, side string, shares double, price double, gross double, fee double, tax double"
    )
    positions = spark.createDataFrame([], "run_id string, trade_date date, symbol string, shares double, close double, market_value double")
    failed = {r.check for r in ledger.audit_ledger(equity, trades, positions, 100.0).collect() if not r.passed}
    assert failed == {"unique_equity_dates"}
