"""Factors: metamorphic properties and hand-worked numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica.operators import factors
from lattica.operators.factors import REGISTRY, Factor, compute_factor, compute_factors

NAMES = sorted(REGISTRY)


def digest(df, names):
    """Rounded rows keyed by (date, symbol)."""
    cols = [F.round(n, 8).alias(n) for n in names]
    return {(r[0], r[1]): tuple(r[2:]) for r in df.select("trade_date", "symbol", *cols).collect()}


@pytest.fixture(scope="module")
def base(weekly):
    return digest(compute_factors(weekly, NAMES), NAMES)


def test_every_factor_has_values(base):
    for i, name in enumerate(NAMES):
        # weekly bars of one trade have no range, so that factor is rare
        assert sum(v[i] is not None for v in base.values()) >= (1 if name == "range_position_20" else 1000), name


def test_input_order_does_not_matter(weekly, base):
    shuffled = weekly.repartition(7, "volume").orderBy(F.desc("amount"))
    assert digest(compute_factors(shuffled, NAMES), NAMES) == base


def test_prefix_is_stable(weekly, base):
    cut = dt.date(1999, 6, 28)
    prefix = digest(compute_factors(weekly.where(F.col("trade_date") <= cut), NAMES), NAMES)
    assert prefix == {k: v for k, v in base.items() if k[0] <= cut}


def test_future_prices_do_not_leak(weekly, base):
    cut = dt.date(1999, 6, 28)
    later = F.col("trade_date") > cut
    bumped = weekly.withColumns(
        {c: F.when(later, F.col(c) * 7).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "adj_open", "adj_close", "amount")}
    )
    got = digest(compute_factors(bumped, NAMES), NAMES)
    assert {k: v for k, v in got.items() if k[0] <= cut} == {k: v for k, v in base.items() if k[0] <= cut}


def test_other_symbols_matter_only_to_the_market_factor(weekly, base):
    names = [n for n in NAMES if n != "ivol_60"]
    few = digest(compute_factors(weekly.where("symbol LIKE '600%'"), names), names)
    places = [NAMES.index(n) for n in names]
    assert few == {k: tuple(v[i] for i in places) for k, v in base.items() if k in few}


def test_segment_restarts_windows(weekly):
    split = weekly.withColumn("research_segment", F.when(F.col("trade_date") < "1999-01-01", 1).otherwise(2))
    out = compute_factor(split, "reversal_5").where("trade_date >= '1999-01-01'")
    first = out.join(out.groupBy("symbol").agg(F.min("trade_date").alias("trade_date")), ["symbol", "trade_date"])
    assert first.where("factor IS NOT NULL").count() == 0


def test_universe_masks(weekly):
    out = compute_factor(weekly.withColumn("in_universe", ~F.col("is_st")), "reversal_5")
    joined = out.join(weekly.select("trade_date", "symbol", "is_st"), ["trade_date", "symbol"])
    assert joined.where("is_st AND factor IS NOT NULL").count() == 0
    assert joined.where("NOT is_st AND factor IS NOT NULL").count() > 0


def test_hand_worked_momentum_and_overnight(spark):
    rows = [(dt.date(2020, 1, i + 1), "A", float(p), float(p), float(p) * 1.1, float(p)) for i, p in enumerate([10, 11, 12, 12, 15, 18])]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, close double, adj_close double, adj_open double, amount double")
    last = compute_factors(df, ["reversal_5", "overnight_reversal_5"]).orderBy(F.desc("trade_date")).first()
    assert last.reversal_5 == pytest.approx(-(18 / 10 - 1))
    gaps = [-(1.1 * b / a - 1) for a, b in zip([10, 11, 12, 12, 15], [11, 12, 12, 15, 18])]
    assert last.overnight_reversal_5 == pytest.approx(sum(gaps) / 5)


def test_unknown_factor_and_missing_column(weekly):
    with pytest.raises(KeyError):
        compute_factor(weekly, "nope")
    with pytest.raises(ValueError, match="missing columns"):
        compute_factor(weekly.drop("close"), "reversal_5")


def test_registration_rules():
    own = Factor("my_range", ("high", "low"), 1, lambda f: F.col("high") - F.col("low"), ())
    with pytest.raises(ValueError):
        factors.register(Factor("reversal_5", ("close",), 5, own.build), title="t", description="d", direction=1)
    with pytest.raises(ValueError):
        factors.register(Factor("Bad", ("close",), 5, own.build), title="t", description="d", direction=1)
    with pytest.raises(ValueError):
        factors.register(own, title="t", description="d", direction=2)
    factors.register(own, title="t", description="d", direction=1)
    try:
        assert factors.required_inputs(["my_range"]) == ["trade_date", "symbol", "high", "low"]
    finally:
        factors.unregister("my_range")


def test_look_ahead_is_caught(weekly):
    def peeking(panel):
        mean = panel.groupBy("symbol").agg(F.avg("close").alias("m"))
        return panel.join(mean, "symbol").select("trade_date", "symbol", (F.col("close") / F.col("m")).alias("factor"))

    bad = factors.look_ahead_report(weekly, peeking, "1999-06-28").first()
    good = factors.look_ahead_report(weekly, lambda p: compute_factor(p, "volatility_20"), "1999-06-28").first()
    assert not bad.passed and bad.changed_rows > 0
    assert good.passed and good.rows > 0


def test_pandas_factor_contract(weekly):
    with pytest.raises(Exception, match="numeric"):
        factors.pandas_factor(weekly, "f", ["close"], lambda p: p["close"].astype(str)).collect()
    wild = factors.pandas_factor(weekly, "f", ["close"], lambda p: p["close"] * float("inf"))
    assert not factors.contract_report(wild).first().passed
