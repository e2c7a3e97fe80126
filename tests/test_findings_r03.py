"""Cases of the third review: each failed before its finding was settled."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.catalog import portfolios, rules, storage
from lattica.functions.trading import Costs, affordable_quantity
from lattica.llm import jaccard, suffixdedup
from lattica.operators import factors, ledger
from lattica.operators.diagnostics import information_coefficient
from lattica.plans import boosting, ridge, rolling, studies
from lattica.schema import BAR
from lattica.sources import versions
from lattica.streaming import latest


def test_slopes_of_the_loss_equal_the_rows(spark):
    """Every fit set and penalty: the slope is the sum over the rows of the set, gaps filled."""
    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    x = rng.normal(size=(12, 9, 2))
    x[rng.random(x.shape) < 0.2] = np.nan
    y = rng.normal(size=(12, 9))
    rows = [(d, f"S{j}", *(None if math.isnan(v) else float(v) for v in x[i, j]), float(y[i, j])) for i, d in enumerate(days) for j in range(9)]
    parts = [(2022, d, "train" if i < 5 else "validation" if i < 8 else "test") for i, d in enumerate(days)] + [(2023, d, "train" if i < 8 else "validation") for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "trade_date date, symbol string, a double, b double, label double").repartition(3)
    dates = spark.createDataFrame(parts, "test_year int, trade_date date, part string")
    fits = ridge.fit_ridge(frame, dates, ["a", "b"], [0.5, 20.0]).localCheckpoint()
    wrong = fits.withColumn("coefficients", F.transform("coefficients", lambda c: c + 0.25))
    for given in (fits, wrong):
        kept = {(r.test_year, r.fitted_on, r.alpha): r for r in given.collect()}
        got = {}
        for r in ridge.loss_slopes(frame, dates, ["a", "b"], given).collect():
            got.setdefault((r.test_year, r.fitted_on, r.alpha), {})[r.place] = (r.rows, r.slope)
        assert got.keys() == kept.keys() and len(got) == 8
        for key, fit in kept.items():
            mine = [i for y_, d, p in parts if y_ == key[0] and (p == "train" or (p == "validation" and key[1] != "train")) for i in [days.index(d)]]
            z = x[mine].reshape(-1, 2)
            z = (np.where(np.isnan(z), fit.medians, z) - fit.means) / fit.scales
            want = z.T @ (y[mine].ravel() - fit.intercept - z @ np.array(fit.coefficients)) - key[2] * np.array(fit.coefficients)
            assert [got[key][i][0] for i in (0, 1)] == [len(z)] * 2
            assert [got[key][i][1] for i in (0, 1)] == pytest.approx(list(want), abs=1e-9)


def test_file_choice_holds_any_number_of_symbols(spark, tmp_path):
    """Thousands of symbols are data of the plan, not expressions in it."""
    path = str(tmp_path / "t")
    bars = spark.range(6000).select(F.lit(dt.date(2020, 1, 3)).alias("trade_date"), F.format_string("S%05d", "id").alias("symbol"), F.lit(1.0).alias("close"))
    versions.append(bars.repartition(4), path, 100)
    live = versions.files(spark, path, versions.latest(spark, path))
    wanted = [f"S{i:05d}" for i in range(3000)]
    plan = lambda names: len(versions.chosen(live, symbols=names)._jdf.queryExecution().optimizedPlan().toString())
    some = spark.createDataFrame([(s,) for s in wanted], "symbol string")
    assert plan(some) < 2 * plan(some.limit(2))
    for given in (wanted, some, some.unionByName(some)):
        assert sorted(r.symbol for r in versions.read(spark, path, symbols=given).collect()) == wanted
    few = versions.chosen(live, symbols=wanted[:2])
    assert 0 < few.count() < live.count() / 3
    assert versions.read(spark, path, symbols=[]).count() == 0


def test_rates_are_added_up_as_decimals(spark):
    """400 shares cost exactly the cash; 1.0003 + 0.00002 in doubles is above 1.00032."""
    frame = spark.createDataFrame([(q, p, q * p * 1.00032) for q in (300, 400, 1000) for p in (62.5, 125.0, 250.0)], "want long, price double, cash double")
    quantity = affordable_quantity(F.col("want") * 2, "price", "cash", F.lit("688001.SH"), F.lit("2020-01-02").cast("date"), Costs())
    out = frame.withColumn("got", quantity).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_cash_faults_do_not_hide_behind_a_large_balance(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(3)]
    cash = [1e6, 1e6 - 2e10 - 5.0, 1e6 - 2e10 - 5.0 + 5.0]  # the last is off by five
    equity = spark.createDataFrame([("r", d, c, 0.0, c) for d, c in zip(days, cash, strict=True)], "run_id string, trade_date date, cash double, market_value double, equity double")
    trades = spark.createDataFrame(
        [("r", days[1], days[0], "A", "BUY", 1e9, 20.0, 2e10, 5.0, 0.0)],
        "run_id string, trade_date date, signal_date date, symbol string, side string, shares double, price double, gross double, fee double, tax double",
    )
    positions = spark.createDataFrame([], "run_id string, trade_date date, symbol string, shares double, close double, market_value double")
    found = {r.check: r.violations for r in ledger.audit_ledger(equity, trades, positions, 1e6).collect()}
    assert found["cash_reconciles_from_executions"] == 1


def test_prices_between_two_cents_round_as_in_sql(spark):
    import duckdb

    from lattica.catalog.portfolios import scaled_round

    values = [1042.745, 1.005, 2.675, 8.345, 0.125, 33.335, 1042.7449, -1.005]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(scaled_round(F.col("v"), 2)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values]


def test_no_correlation_is_zero_and_not_its_last_bit(spark):
    """Ranks with a covariance of exactly 0, in every order of the rows."""
    rng = np.random.default_rng(5)
    found = 0
    sections = []
    while found < 30:
        y = rng.permutation(13).tolist()
        if sum((i - 6) * (v - 6) for i, v in enumerate(y)) == 0:
            order = rng.permutation(13)
            sections += [(found, f"S{i:02d}", float(i), float(y[i])) for i in order]
            found += 1
    frame = spark.createDataFrame(sections, "trade_date int, symbol string, x double, y double")
    assert {r.ic for r in information_coefficient(frame, "x", "y").collect()} == {0.0}
    halves = frame.withColumn("y", F.floor(F.col("y") / 2))
    want = spark.createDataFrame(halves.toPandas().groupby("trade_date")[["x", "y"]].corr("spearman").unstack().iloc[:, 1].reset_index(name="c").set_axis(["trade_date", "c"], axis=1))
    for r in information_coefficient(halves, "x", "y").join(want, "trade_date").collect():
        assert r.ic == pytest.approx(r.c, abs=1e-12)


def test_a_state_computes_no_factor_of_old_rows(spark, tmp_path):
    """A factor that fails on rows out of reach of the new ones: neither the first state nor its extension meets them."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    panel = spark.createDataFrame([(d, s, 10.0 + i) for i, d in enumerate(days) for s in "AB"], "trade_date date, symbol string, close double")
    old = F.raise_error(F.lit("an old row")).cast("double")
    failing = factors.Factor("reaches_two", ("close",), 2, lambda f: F.when(F.lag("trade_date", 0).over(f.ordered) < F.lit(days[8]), old).otherwise(f.lag("close", 2)), ())
    factors.register(failing, title="t", description="d", direction=1)
    try:
        names, path = ["reaches_two", "momentum_20_5"], str(tmp_path / "state")
        rolling.run_sessions(spark, path, panel.where(F.col("trade_date") <= F.lit(days[9])), names)
        got = rolling.run_sessions(spark, path, panel.where(F.col("trade_date") > F.lit(days[9])), names)
        assert sorted((r.trade_date, r.symbol, r.reaches_two) for r in got.collect()) == [(days[i], s, 8.0 + i) for i in (10, 11) for s in "AB"]
    finally:
        factors.unregister("reaches_two")


def test_a_load_of_many_files_is_one_batch(spark, tmp_path):
    """A load that many tasks wrote: none of its rows is late for another of its files."""
    root = str(tmp_path)
    days = [dt.date(2024, 1, 1), dt.date(2024, 6, 1), dt.date(2023, 1, 1)]
    for day in days:
        row = spark.createDataFrame([(day, "A", 1.0, 1, 1)], "trade_date date, symbol string, close double, priority int, sequence long")
        row = row.withColumns({f.name: F.lit(None).cast(f.dataType) for f in BAR if f.name not in row.columns})
        row.select(*BAR.names, "sequence").write.mode("append").parquet(f"{root}/inbox")
    bars = latest.numbered_stream(spark, f"{root}/inbox", None)
    latest.keep_latest(bars, f"{root}/table", f"{root}/late", f"{root}/progress", 30).awaitTermination()
    assert sorted(r.trade_date for r in versions.read(spark, f"{root}/table").collect()) == sorted(days)


def test_bars_of_vendor_c_are_built_once(spark):
    """Its five tables come from one stored set of bars: the plan that joins them reads no trades."""
    files = rules.vendor_c_normalize(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_loads_of_one_vendor_share_its_bars(spark):
    """Four of the five loads of the upsert queries come from one stored set of bars."""
    loads = storage.arrivals(spark, "/root/testdata/sf0.001")
    assert [any("lineitem" in f for f in load.inputFiles()) for load in loads] == [True, False, False, False, False]


def test_leaves_of_a_tree_cost_no_pass_of_their_own(spark, monkeypatch):
    """A tree is grown in as many passes over the rows as it is deep; the last leaves follow from the sums above them."""
    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    x = rng.normal(size=(600, 2))
    rows = spark.createDataFrame([(days[i % 30], f"S{i}", float(abs(a) + (b > 0) * a), float(a), float(b)) for i, (a, b) in enumerate(x)], "trade_date date, symbol string, label double, a double, b double")
    dates = spark.createDataFrame([(2021, d, "train" if i < 15 else "validation" if i < 22 else "test") for i, d in enumerate(days)], "test_year int, trade_date date, part string")
    passes, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: passes.append(1) or level(*a))
    scored, report, _ = boosting.boost(rows, ["a", "b"], dates, boosting.BoostSettings(max_trees=4, step=0.5, depth=3, least_rows=2, patience=4))
    grown = report.first()
    assert grown.trees_grown == 4 and scored.count() == sum(i % 30 >= 22 for i in range(600))
    assert len(passes) == 4 * 3 + 1


def test_a_grid_reads_its_panel_once(spark, tmp_path):
    """The panel behind all variants is built once, however many steps read it; names never held reach no return."""
    rng = np.random.default_rng(9)
    days = [dt.date(2020, 1, 6) + dt.timedelta(days=7 * i) for i in range(40)]
    data = [(d, f"S{j}", *[float(10 + rng.random())] * 4, False, False, 1e6) for d in days for j in range(12)]
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(data, "trade_date date, symbol string, open double, close double, adj_open double, adj_close double, is_st boolean, is_suspended boolean, amount double")
    known = frame.withColumns({c: F.lit(True) for c in ("is_st_known", "is_suspended_known", "limit_status_known")})
    panel = known.mapInArrow(count, known.schema)
    out = studies.momentum_grid(panel, [(10, 0, "W-FRI"), (20, 5, "W-FRI"), (20, 5, "M")], 3).collect()
    assert len(out) == 3 and built.value == len(data)


def test_scores_of_several_runs_are_stored_without_the_panel(spark, monkeypatch):
    """Weights need date, symbol and score; the other columns of the panel are stored once, not twice."""
    stored, settle = [], portfolios.settle
    monkeypatch.setattr(portfolios, "settle", lambda df: stored.append(df.columns) or settle(df))
    portfolios.several_runs(spark, "/root/testdata/sf0.001")
    assert ["trade_date", "symbol", "factor_processed"] in stored
    assert sum("market_cap" in columns for columns in stored) == 1


def test_strings_of_many_batches_are_sorted_once(monkeypatch):
    """What copies have in common is added to the family of suffix arrays once, and every batch still gets its answer."""
    rng = np.random.default_rng(7)
    pool = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (50, 50, 61, 84)]
    pool += [pool[3][5:60], pool[2][:50]]  # suffixes of others
    batches = []
    for _ in range(9):
        mine = rng.permutation(len(pool))[:4]
        docs = np.sort(rng.integers(0, 50, (4, 2)), axis=1)
        batches.append({"data": b"".join(pool[i] for i in mine), "length": bytes(len(pool[i]) for i in mine), "least": docs[:, 0].tobytes(), "most": docs[:, 1].tobytes(), "strings": [pool[i] for i in mine], "docs": docs})
    least = {}
    for b in batches:
        for s, (d, _) in zip(b["strings"], b["docs"].tolist(), strict=True):
            for p in range(len(s) - 49):
                least[s[p : p + 50]] = min(d, least.get(s[p : p + 50], d))
    want = set()
    for k, b in enumerate(batches):
        for e, (s, (_, d)) in enumerate(zip(b["strings"], b["docs"].tolist(), strict=True)):
            want |= {(k, e, p, least[s[p : p + 50]]) for p in range(len(s) - 49) if least[s[p : p + 50]] < d}
    for fewest in (1, 3, 1 << 12):
        monkeypatch.setattr(suffixdedup, "FEWEST", fewest)
        added, add = [], suffixdedup.LevelFamily.add
        with monkeypatch.context() as m:
            m.setattr(suffixdedup.LevelFamily, "add", lambda self, rows, docs: added.append(len(rows)) or add(self, rows, docs))
            got = {
                (k, int(e), p, int(d))
                for k, (entry, first, stop, docs) in suffixdedup.answered(batches)
                for e, a, b, d in zip(np.frombuffer(entry, np.uint32), first, stop, np.frombuffer(docs, np.int64), strict=True)
                for p in range(a, b)
            }
        assert got == want and sum(added) == sum(len(s) - 49 for s in pool)


def test_texts_are_not_shuffled_to_drop_some(spark):
    """Only rows that the bit filter cannot tell from those that go are joined; nulls and repeated ids stay as before."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i % 7 :] + [f"x{i % 7}"] * 3)) for i in range(30)] + [(None, "a b"), (None, None), (3, "c d e"), (29, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.one_of_each(docs)
        groups = jaccard.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
        want = docs.join(groups, "doc_id", "left_anti")
        assert 0 < groups.count() < 30 and kept.exceptAll(want).count() == 0 and want.exceptAll(kept).count() == 0
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert plan.lstrip().startswith("Union") and "perhaps" in plan[: plan.index("Join")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
