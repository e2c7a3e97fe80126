"""Gram moments, rank correlations and fold medians against numpy and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import diagnostics, moments
from lattica.operators.sections import Layout
from lattica.plans import ridge

NAMES = ["a", "b", "c", "d", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({"trade_date": [dt.date(2020, 1, 1) + dt.timedelta(days=int(k)) for k in rng.integers(0, 25, n)], "symbol": [f"S{k:04d}" for k in range(n)]})
    pdf["a"] = rng.normal(1e6, 1, n)
    pdf["b"] = np.round(pdf["a"] - 1e6 + rng.normal(0, 1, n), 1)
    pdf["c"] = rng.integers(0, 3, n).astype(float)
    pdf["d"] = rng.normal(0, 1, n)
    pdf["flat"] = 4.0
    pdf["label"] = rng.normal(0, 1, n)
    for name, share in (("a", 0.1), ("b", 0.3), ("c", 0.2), ("d", 0.9)):
        pdf.loc[rng.random(n) < share, name] = None
    odd = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    return pdf, odd.withColumn("d", F.when(F.col("symbol") == "S0003", float("inf")).otherwise(F.col("d"))).cache()


def clean(pdf):
    out = pdf.copy()
    out.loc[out.symbol == "S0003", "d"] = np.nan
    return out


def test_merged_parts_equal_the_whole():
    rng = np.random.default_rng(1)
    z = rng.normal(1e9, 1, (300, 4))
    parts = [(float(len(p)), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))) for p in np.split(z, [1, 40, 41, 200])]
    n, mean, scatter = moments.merged(parts)
    assert n == 300 and np.allclose(mean, z.mean(0), rtol=1e-15)
    assert np.allclose(scatter, (z - z.mean(0)).T @ (z - z.mean(0)), atol=1e-4)
    n, mean, again = moments.merged([moments.merged(parts[:2]), moments.merged(parts[2:])])
    assert np.allclose(again, scatter, atol=1e-4)


def test_pairwise_correlations_equal_pandas(table):
    pdf, df = table
    daily = moments.section_moments(df.withColumn("a", F.col("a") - 1e6), NAMES, squares=True)
    found = moments.pairwise_correlations(moments.merge_moments(daily.withColumn("month", F.month("trade_date")), ["month"]), NAMES, ["month"]).collect()
    wanted, counts = clean(pdf)[NAMES].corr(), clean(pdf)[NAMES].notna().astype(float)
    for r in found:
        assert r.month == 1 and r.pairs == int((counts[r.factor_a] * counts[r.factor_b]).sum())
        if "flat" in (r.factor_a, r.factor_b):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(wanted.loc[r.factor_a, r.factor_b], abs=1e-9)


def test_rank_correlations_equal_pandas_and_the_split_form(table):
    pdf, df = table
    whole = {(r.factor_a, r.factor_b): r.correlation for r in diagnostics.factor_correlation(df, NAMES).collect()}
    days = [g[NAMES].corr("spearman", min_periods=2) for _, g in clean(pdf).groupby("trade_date")]
    for (a, b), value in whole.items():
        wanted = np.nanmean([d.loc[a, b] for d in days]) if "flat" not in (a, b) else None
        assert value == (None if wanted is None else pytest.approx(wanted, abs=1e-9))
    split = {(r.factor_a, r.factor_b): r.correlation for r in diagnostics.factor_correlation(df.withColumn("d", F.when(F.col("d") < 1e300, F.col("d"))), NAMES, Layout(splits=3, sample_every=4)).collect()}
    assert whole.keys() == split.keys()
    for key, value in split.items():
        assert value == (None if whole[key] is None else pytest.approx(whole[key], abs=1e-9))


def test_medians_over_overlapping_fit_sets(spark, table):
    pdf, df = table
    days = sorted(pdf.trade_date.unique())
    sets = [(y, part, d) for y, (lo, hi) in {2020: (0, 9), 2021: (3, 20), 2022: (19, 25), 2023: (7, 8)}.items() for part, end in (("train", hi), ("train+validation", min(hi + 3, 25))) for d in days[lo:end]]
    frame = spark.createDataFrame(sets, "test_year int, fitted_on string, trade_date date")
    same = df.withColumn("c", F.when(F.col("c").isNotNull(), F.lit(1.5)))  # one value in most rows
    for source, own in ((df, clean(pdf)), (same, clean(pdf).assign(c=lambda t: t.c.where(t.c.isna(), 1.5)))):
        rows = source.withColumn("d", F.when(F.col("d") < 1e300, F.col("d")))
        for r in ridge.fold_medians(rows, frame, NAMES).collect():
            mine = own[own.trade_date.isin([d for y, p, d in sets if (y, p) == (r.test_year, r.fitted_on)])]
            assert r.medians == pytest.approx([0.0 if np.isnan(v) else v for v in mine[NAMES].median()], abs=1e-12)


def test_ridge_equals_numpy(spark, table):
    pdf, df = table
    days = sorted(pdf.trade_date.unique())
    parts = [(2021, "train" if k < 12 else "validation" if k < 18 else "test", d) for k, d in enumerate(days)]
    dates = spark.createDataFrame(parts, "test_year int, part string, trade_date date")
    for r in ridge.fit_ridge(df.withColumn("a", F.col("a") - 1e6), dates, NAMES, [0.5, 50.0]).collect():
        mine = clean(pdf).assign(a=lambda t: t.a - 1e6)[lambda t: t.trade_date.isin([d for _, p, d in parts if p == "train" or (p == "validation" and r.fitted_on != "train")])]
        x = mine[NAMES].fillna(mine[NAMES].median()).to_numpy()
        spread = x.std(0)
        z = (x - x.mean(0)) / np.where(spread > 0, spread, 1)
        y = mine.label - mine.label.mean()
        beta = np.linalg.solve(z.T @ z + r.alpha * np.eye(len(NAMES)), z.T @ y)
        assert r.coefficients == pytest.approx(beta.tolist(), abs=1e-7) and r.intercept == pytest.approx(mine.label.mean())
