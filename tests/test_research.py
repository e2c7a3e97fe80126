"""Diagnostics, membership and data-quality rules on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import adjust, calendars, diagnostics, merging, quality, universe
from lattica.operators.checks import assert_unique, require_columns
from lattica.plans.folds import chronological_split, require_parts
from lattica.sources import vendors


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def hac_by_hand(values, lags):
    x = np.array([np.nan if v is None else v for v in values])
    ok = np.isfinite(x)
    n, mean = ok.sum(), x[ok].mean()
    e = np.where(ok, x - mean, 0)
    used = min(lags, len(x) - 1)
    s = e @ e + sum(2 * (1 - k / (used + 1)) * (e[k:] @ e[:-k]) for k in range(1, used + 1))
    return mean, np.sqrt(max(0, s) / n**2 * n / (n - 1)), used


@pytest.mark.parametrize("lags", [0, 2, 4, 9])
def test_hac(spark, lags):
    values = [0.1, None, 0.3, -0.2, 0.05, None, 0.2]
    df = spark.createDataFrame([(day(i), v) for i, v in enumerate(values)], "trade_date date, ic double")
    got = diagnostics.hac_mean(df, "ic", lags).first()
    mean, se, used = hac_by_hand(values, lags)
    assert got.hac_mean == pytest.approx(mean) and got.hac_se == pytest.approx(se)
    assert got.hac_lags == used and got.hac_observations == 5


def test_hac_keeps_calendar_slots(spark):
    df = spark.createDataFrame([(day(0), 0.1), (day(2), 0.3), (day(3), 0.2)], "trade_date date, ic double")
    slots = spark.createDataFrame([(day(i),) for i in range(4)], "trade_date date")
    got = diagnostics.hac_mean(df, "ic", 1, sessions=slots).first()
    assert got.hac_se == pytest.approx(hac_by_hand([0.1, None, 0.3, 0.2], 1)[1])


def test_thin_hac_is_null(spark):
    df = spark.createDataFrame([(day(0), 0.1)], "trade_date date, ic double")
    assert diagnostics.hac_mean(df, "ic").first().hac_se is None


def test_quantiles_ignore_labels(spark):
    base = [(day(0), f"S{i}", float(i), float(i)) for i in range(10)]
    df = spark.createDataFrame(base, "trade_date date, symbol string, f double, y double")
    holes = df.withColumn("y", F.when(F.col("f") > 2, F.col("y")))
    full = {r["quantile"]: r for r in diagnostics.quantile_returns(df, "f", "y").collect()}
    gaps = {r["quantile"]: r for r in diagnostics.quantile_returns(holes, "f", "y").collect()}
    assert {q: r.assigned_count for q, r in full.items()} == {q: r.assigned_count for q, r in gaps.items()} == {q: 2 for q in range(1, 6)}
    assert gaps[1].label_coverage == 0 and gaps[1].mean_return is None


def test_membership_never_looks_ahead(spark):
    bars = spark.createDataFrame([(day(i), s) for i in range(4) for s in "AB"], "trade_date date, symbol string")
    snaps = spark.createDataFrame([(day(1), "A", 2.0), (day(3), "B", 3.0)], "trade_date date, symbol string, weight double")
    got = {(r.trade_date, r.symbol): (r.in_index, r.index_weight) for r in universe.attach_membership(bars, snaps).collect()}
    assert [got[(day(i), "A")][0] for i in range(4)] == [False, True, True, False]
    assert got[(day(3), "B")] == (True, 3.0)


def test_strict_memberships_refuse_partial_snapshots(spark):
    bars = spark.createDataFrame([(day(1), "A")], "trade_date date, symbol string")
    snaps = spark.createDataFrame([("I", day(0), "A", False)], "index_code string, trade_date date, symbol string, snapshot_complete boolean")
    with pytest.raises(ValueError, match="incomplete"):
        universe.attach_shared_memberships(bars, snaps, {"I": "idx"}, "any")


def test_chain_never_bridges_a_missing_session(spark):
    data = [(day(0), "600001.SH", 10.0, None), (day(1), "600001.SH", 11.0, 10.0), (day(3), "600001.SH", 20.0, 11.0), (day(4), "600001.SH", 22.0, 10.0)]
    raw = spark.createDataFrame(
        [(d, s, c, c, c, c, p, 1.0, c, False, False, True, True) for d, s, c, p in data],
        "trade_date date, symbol string, open double, high double, low double, close double, preclose double, volume double, amount double,"
        "is_st boolean, is_suspended boolean, is_st_known boolean, is_suspended_known boolean",
    )
    sessions = calendars.session_list(spark.createDataFrame([(day(i),) for i in range(5)], "trade_date date"))
    basics = spark.createDataFrame([("600001.SH", dt.date(1999, 1, 1))], "symbol string, list_date date")
    out = adjust.price_chain(raw, sessions, basics).orderBy("trade_date").collect()
    assert [r.research_segment for r in out] == [1, 1, 2, 2]
    assert [r.adj_factor for r in out] == [1.0, 1.0, 1.0, 2.0]


def test_gap_islands_equal_brute_force(spark, weekly):
    sessions = calendars.session_list(weekly)
    master = weekly.select("symbol").distinct().withColumns(
        {"list_date": F.lit("1996-05-01").cast("date"), "delist_date": F.lit("2000-03-01").cast("date")}
    )
    expected = merging.listed_ranges(sessions, master, "1995-01-01", "2001-12-31")
    got = merging.gap_islands(expected, weekly, sessions)
    total = got.agg(F.sum("missing_sessions")).first()[0]
    days = [r.trade_date for r in sessions.orderBy("trade_date").collect() if dt.date(1996, 5, 1) <= r.trade_date < dt.date(2000, 3, 1)]
    seen = {(r.symbol, r.trade_date) for r in weekly.select("symbol", "trade_date").collect()}
    symbols = {s for s, _ in seen}
    assert total == sum((s, d) not in seen for s in symbols for d in days)


def test_merge_refuses_duplicates(spark):
    cols = "trade_date date, symbol string, open double, high double, low double, close double, preclose double, volume double, amount double"
    one = spark.createDataFrame([(day(0), "A", *[1.0] * 7)], cols)
    with pytest.raises(ValueError, match="duplicate"):
        merging.merge_sources(one.unionByName(one), one)
    assert merging.merge_sources(one, one).first().source_presence == "both"


def test_priority_is_settled_the_same_way_in_any_order(spark):
    df = spark.createDataFrame([(day(0), "A", float(i), 3) for i in range(50)], "trade_date date, symbol string, close double, priority int")
    first = merging.by_priority(df).first().close
    assert merging.by_priority(df.orderBy(F.desc("close")).repartition(7)).first().close == first


def test_vendor_rules(spark):
    bad = spark.createDataFrame([("2020-01-02", "sh.600000", "abc", "3")], "date string, code string, close string, adjustflag string")
    with pytest.raises(Exception):
        vendors.normalize_vendor_a(bad, check=False).collect()
    adjusted = spark.createDataFrame([("2020-01-02", "sh.600000", "1", "1")], "date string, code string, close string, adjustflag string")
    with pytest.raises(ValueError, match="adjusted"):
        vendors.normalize_vendor_a(adjusted)


def test_audit_codes(spark):
    good = [(day(i), "A", 10.0, 11.0, 9.0, 10.0, 5.0, 50.0) for i in range(3)]
    cols = "trade_date date, symbol string, open double, high double, low double, close double, volume double, amount double"
    codes = lambda df, **kw: {r.code for r in quality.audit_panel(df, **kw).collect()}
    df = spark.createDataFrame(good, cols)
    assert {"LOW_IS_ST_KNOWN", "IMPORTANT_MISSING"} <= codes(df)
    assert "DUPLICATE_KEYS" in codes(df.unionByName(df.limit(1)))
    assert "RAW_ADJUSTED_PRICE_MISSING" in codes(df, dual_prices=True)
    assert "INVALID_ADJUSTED_PRICE" in codes(df.withColumns({"adj_open": F.lit(-1.0), "adj_close": F.lit(1.0)}), dual_prices=True)
    assert codes(df.drop("close")) == {"MISSING_COLUMNS"}
    later = spark.createDataFrame([(day(i),) for i in range(5)], "trade_date date")
    assert {"MISSING_TRADE_DATES", "RECENT_SYMBOL_DATE_GAPS"} <= codes(df, sessions=calendars.session_list(later))


def test_guards(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(ValueError):
        require_columns(df, ["c"])
    with pytest.raises(ValueError):
        assert_unique(df, ["a"])
    assert_unique(df, ["a", "b"])


def test_empty_split_is_refused(spark):
    df = spark.createDataFrame([(day(i),) for i in range(5)], "trade_date date")
    with pytest.raises(ValueError):
        require_parts(chronological_split(df, "2020-01-02", "2020-01-31"))
    with pytest.raises(ValueError):
        chronological_split(df, "2020-02-01", "2020-01-01")


def test_audit_counts_keys_and_dates_with_nulls_and_repeats(spark):
    schema = "trade_date date, symbol string, open double, high double, low double, close double, volume double, amount double, in_index boolean"
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    values = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    keys = [(days[0], "a", True), (days[0], "a", True), (days[0], "b", True), (None, "b", True), (None, "b", False), (days[1], "a", False), (days[2], "a", True), (days[2], "a", False), (days[2], "b", False), (days[2], None, True)]
    panel = spark.createDataFrame([(d, s, *values, m) for d, s, m in keys], schema)
    counted = lambda df: {r.code: r["count"] for r in quality.audit_panel(df, expected_latest_symbols=3).collect()}
    got = counted(panel)
    assert got["DUPLICATE_KEYS"] == 3 and got["INVALID_DATES"] == 2
    assert got["INDEX_MEMBERSHIP_EMPTY"] == 1  # the second day
    assert got["INCOMPLETE_LATEST_CROSS_SECTION"] == 2  # of the last day's members one has a symbol
    assert counted(panel.limit(0))["INCOMPLETE_LATEST_CROSS_SECTION"] == 3
