"""Split cross-sections must equal whole ones, also when one value fills a third of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import diagnostics, preprocess
from lattica.operators.sections import ROWS_PER_TASK, WHOLE, Layout, add_average_rank, add_median, add_positions, add_running, add_stats

SPLIT = Layout(splits=5, sample_every=2)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    data = []
    for d, n in (("2020-01-02", 300), ("2020-01-03", 37), ("2020-01-06", 3), ("2020-01-07", 1)):
        for i in range(n):
            value = 1.0 if i % 3 == 0 else float(np.round(rng.normal(), 1))
            data.append((d, f"S{i:04d}", None if i % 11 == 5 else value, float(rng.normal()), f"I{i % 4}", float(rng.uniform(1, 9))))
    pdf = pd.DataFrame(data, columns=["d", "symbol", "v", "y", "industry", "market_cap"])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "d string, symbol string, v double, y double, industry string, market_cap double")
    return df.withColumn("trade_date", F.to_date("d")).drop("d").repartition(4).cache()


def table(df, *columns):
    found = df.select("trade_date", "symbol", *columns).collect()
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found), key=str)


KEYS = ["trade_date"]


@pytest.mark.parametrize("descending", [False, True])
def test_positions(frame, descending):
    run = lambda lay: table(add_positions(frame, KEYS, "v", descending=descending, position="p", total="n", layout=lay), "p", "n")
    assert run(SPLIT) == run(WHOLE)


def test_average_rank_matches_pandas(frame):
    run = lambda lay: table(add_average_rank(frame, KEYS, "v", "r", layout=lay), "r")
    whole = run(WHOLE)
    assert run(SPLIT) == whole
    pdf = frame.toPandas()
    pdf["r"] = pdf.groupby("trade_date")["v"].rank(method="average")
    want = {(r.trade_date, r.symbol): r.r for r in pdf.itertuples()}
    for date, symbol, got in whole:
        expected = want[(date, symbol)]
        assert got is None and np.isnan(expected) or got == expected


def test_median_matches_pandas(frame):
    run = lambda lay: table(add_median(frame, KEYS, "v", "m", layout=lay), "m")
    assert run(SPLIT) == run(WHOLE)
    want = frame.toPandas().groupby("trade_date")["v"].median()
    for date, _, got in run(SPLIT):
        assert (got is None and np.isnan(want[date])) or abs(got - want[date]) < 1e-12


def test_stats(frame):
    run = lambda lay: table(add_stats(frame, KEYS, {"m": F.avg("v"), "s": F.stddev_pop("v")}, lay), "m", "s")
    assert run(SPLIT) == run(WHOLE)


def test_preprocess_and_quantiles(frame):
    run = lambda lay: table(preprocess.preprocess(frame, "v", layout=lay), "factor_winsor", "factor_z", "factor_processed")
    assert run(SPLIT) == run(WHOLE)
    cut = lambda lay: table(diagnostics.assign_quantiles(frame.where("v IS NOT NULL"), "v", 5, layout=lay), "quantile")
    assert cut(SPLIT) == cut(WHOLE)


def test_information_coefficient(frame):
    run = lambda lay: sorted(
        (str(r.trade_date), r.pairs, None if r.ic is None else round(r.ic, 9))
        for r in diagnostics.information_coefficient(frame, "v", "y", layout=lay).collect()
    )
    assert run(SPLIT) == run(WHOLE)
    assert run(WHOLE)[0][2] is not None and run(WHOLE)[-1][2] is None


def test_no_split_part_holds_the_hot_value(frame):
    """A value shared by a third of a date is spread over several ranges."""
    from lattica.operators.sections import _ranged

    ranged = _ranged(frame, KEYS, "v", "symbol", False, SPLIT)
    sizes = ranged.where("trade_date = '2020-01-02' AND v = 1.0").groupBy("_slot").count().collect()
    assert len(sizes) >= 2


def test_layout_follows_the_bound():
    assert Layout.for_bound(10).splits == 1
    assert Layout.for_bound(ROWS_PER_TASK * 3 + 1).splits == 4


def nulls(spark):
    """NULL keys, groups and values, ties, and both zeros."""
    rows = [(None if i % 4 == 0 else i % 4, f"S{i:03d}", (None, 0.0, -0.0, 1.5, 1.5, 2.0)[i % 6], float(i)) for i in range(240)]
    return spark.createDataFrame(rows, "k int, symbol string, v double, w double").repartition(3)


def same(spark, run):
    key = lambda r: tuple(str(0.0 if v == 0 else v) for v in r)
    frames = [run(nulls(spark), layout) for layout in (WHOLE, SPLIT)]
    whole, split = (sorted(key(r) for r in df.select(*sorted(df.columns)).collect()) for df in frames)
    assert whole == split and len(whole) == 240


def test_split_forms_keep_null_keys(spark):
    stats = {"n": F.count("*"), "m": F.sum("w")}
    same(spark, lambda df, lay: add_stats(df, ["k"], stats, lay))
    same(spark, lambda df, lay: add_running(df, ["k"], ["w", "symbol"], {"s": F.col("w")}, lay))
    same(spark, lambda df, lay: add_positions(df, ["k"], "v", position="p", total="n", layout=lay))
    same(spark, lambda df, lay: add_average_rank(df, ["k"], "v", "a", layout=lay))
    same(spark, lambda df, lay: add_median(df, ["k"], "w", "m", layout=lay))


def test_neutralize_without_known_industry(spark):
    rng = np.random.default_rng(3)
    rows = [("2020-01-02", f"S{i:03d}", float(rng.normal()), None, float(rng.uniform(1, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "d string, symbol string, v double, industry string, market_cap double").withColumn("trade_date", F.to_date("d"))
    found = [
        {r.symbol: None if r[1] is None else round(r[1], 9) for r in preprocess.neutralize(df, "v", "n", layout=lay).select("symbol", "n").collect()}
        for lay in (WHOLE, SPLIT)
    ]
    assert found[0] == found[1] and len(found[0]) == 40
