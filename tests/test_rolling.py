"""A state that is extended session by session gives what a full run gives."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators.factors import BUILT_IN, compute_factors
from lattica.plans import rolling
from lattica.sources import versions

NAMES = [f.name for f in BUILT_IN]


@pytest.fixture(scope="module")
def panel(spark):
    """Symbols that trade every day, seldom, from late on, and not at the end; gaps, zeros and universe changes."""
    rng, rows = np.random.default_rng(4), []
    for k, symbol in enumerate("ABCDEF"):
        close = 10.0
        for day in range(190):
            if (k == 1 and day % 3) or (k == 2 and day < 150) or (k == 3 and day > 170) or (k == 4 and rng.random() < 0.3):
                continue
            close *= float(np.exp(rng.normal(0, 0.03)))
            opened = close * float(np.exp(rng.normal(0, 0.01)))
            amount = None if rng.random() < 0.05 else float(rng.integers(0, 5) * 1000)
            rows.append(
                (dt.date(2024, 1, 1) + dt.timedelta(days=day), symbol, opened, max(opened, close) * 1.01, min(opened, close) * 0.99, close, opened * 1.1, close * 1.1, amount, 0.01 * k,
                 None if k == 5 else 1e6, 100.0, 5.0, bool(rng.random() < 0.9), bool(rng.random() < 0.05), "s1" if day < 100 else "s2")
            )
    columns = "trade_date date, symbol string, open double, high double, low double, close double, adj_open double, adj_close double, amount double, turnover_rate double, market_cap double, book_value double, net_profit_ttm double, in_universe boolean, amount_outside_price_range boolean, research_segment string"
    return spark.createDataFrame(rows, columns).cache()


def values(df):
    return {(r.trade_date, r.symbol): tuple(r[n] for n in NAMES) for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for key, row in a.items():
        for name, x, y in zip(NAMES, row, b[key], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-12)), (key, name, x, y)


@pytest.mark.parametrize("segments", [True, False])
def test_extended_state_equals_full_run(spark, panel, tmp_path, segments):
    panel = panel if segments else panel.drop("research_segment")
    full = values(compute_factors(panel, NAMES))
    path, got, last = str(tmp_path / "state"), {}, dt.date(2023, 1, 1)
    for day in (140, 141, 155, 156, 190):
        end = dt.date(2024, 1, 1) + dt.timedelta(days=day)
        part = panel.where((F.col("trade_date") > F.lit(last)) & (F.col("trade_date") <= F.lit(end)))
        got |= values(rolling.run_sessions(spark, path, part, NAMES))
        last = end
    same(full, got)
    state = versions.read(spark, path)
    assert state.groupBy(*rolling.partition_of(state)).count().agg(F.max("count")).first()[0] <= 120


def test_old_sessions_are_refused_and_leave_the_state(spark, panel, tmp_path):
    path = str(tmp_path / "state")
    rolling.run_sessions(spark, path, panel, ["reversal_5", "ivol_60"])
    before = versions.latest(spark, path).number
    with pytest.raises(Exception, match="is not after the state"):
        rolling.run_sessions(spark, path, panel.where("trade_date = '2024-07-01'"), ["reversal_5", "ivol_60"])
    assert versions.latest(spark, path).number == before
