"""Histogram boosting: splits against brute force, missing values, patience, and no dependence on partitioning."""

import datetime as dt

import numpy as np
import pytest

from lattica.plans import boosting
from lattica.plans.boosting import BoostSettings, Tree, best_split

SETTINGS = BoostSettings(max_trees=12, step=0.3, depth=2, bins=8, least_rows=5, patience=3)


def test_best_split_equals_trying_every_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        codes = rng.integers(-1, 4, (60, 3))
        grad = rng.integers(-1000, 1000, 60) * (boosting._POINT // 1000) + (codes[:, 1] < 0) * boosting._POINT
        sums = {(f, b): (int(grad[codes[:, f] == b].sum()), int((codes[:, f] == b).sum())) for f in range(3) for b in range(-1, 4) if (codes[:, f] == b).any()}
        found = best_split(sums, 3, SETTINGS)
        value = lambda m: (grad[m].sum() / boosting._POINT) ** 2 / (m.sum() + SETTINGS.penalty)  # noqa: B023, E731
        every = []
        for f in range(3):
            for b in range(4):
                for left_missing in (True, False):
                    left = np.where(codes[:, f] < 0, left_missing, codes[:, f] <= b)
                    if min(left.sum(), (~left).sum()) >= SETTINGS.least_rows:
                        every.append(value(left) + value(~left) - value(np.ones(60, bool)))
        assert found[0] == pytest.approx(max(every))


def test_trees_send_missing_values_where_they_learned():
    tree = Tree({1: (0, 2, True), 3: (1, 0, False)}, {2: 1.0, 6: 2.0, 7: 3.0})
    codes = np.array([[-1, 5], [2, 0], [3, 0], [3, 1], [9, -1]])
    assert tree.margins(codes).tolist() == [1.0, 1.0, 2.0, 3.0, 3.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = []
    for d in range(60):
        for s in range(20):
            a, b, noise = rng.normal(), rng.normal(), rng.normal()
            gone = rng.random() < 0.3
            label = (1.0 if a > 0.3 else -0.5) + (2.0 if gone else 0.2 * b) + 0.1 * noise
            data.append((dt.date(2020, 1, 1) + dt.timedelta(days=d), f"S{s}", None if (d, s) == (3, 3) else label, a, None if gone else b, float("nan") if s == 5 else noise))
    return spark.createDataFrame(data, "trade_date date, symbol string, label double, a double, b double, junk double").cache()


@pytest.fixture(scope="module")
def dates(spark):
    cuts = {2021: (0, 25, 35, 45), 2022: (10, 35, 45, 60)}
    marked = [(y, p, dt.date(2020, 1, 1) + dt.timedelta(days=d)) for y, c in cuts.items() for p, lo, hi in zip(("train", "validation", "test"), c[:-1], c[1:], strict=True) for d in range(lo, hi)]
    return spark.createDataFrame(marked, "test_year int, part string, trade_date date")


def test_boosting_learns_and_does_not_depend_on_partitions(rows, dates):
    first = boosting.boost(rows.repartition(2), ["a", "b", "junk"], dates, SETTINGS)
    again = boosting.boost(rows.repartition(7, "symbol"), ["a", "b", "junk"], dates, SETTINGS)
    report = {r.test_year: r for r in first[1].collect()}
    assert all(r.best_error < 0.2 * r.mean_error and r.trees_kept > 3 for r in report.values())
    scored = {(r.test_year, r.trade_date, r.symbol): r.prediction for r in first[0].collect()}
    assert len(scored) == (10 + 15) * 20
    assert scored == {(r.test_year, r.trade_date, r.symbol): r.prediction for r in again[0].collect()}
    assert first[1].collect() == again[1].collect()
    gain = {(r.test_year, r.feature): r.importance for r in first[2].collect()}
    assert all(gain[y, "a"] + gain[y, "b"] > 0.95 and sum(gain[y, f] for f in ("a", "b", "junk")) == pytest.approx(1) for y in report)


def test_boosting_of_noise_stops_early(spark, rows, dates):
    noise = rows.selectExpr("trade_date", "symbol", "cast(pmod(xxhash64(symbol, trade_date), 100) as double) / 100 as label", "junk")
    report = boosting.boost(noise, ["junk"], dates, SETTINGS)[1].collect()
    assert all(r.trees_grown - r.trees_kept <= SETTINGS.patience and r.best_error <= r.mean_error for r in report)
