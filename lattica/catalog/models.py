"""Suite, walk-forward and model queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.base import query, with_weekly
from lattica.catalog.research import (
    LONG,
    NAMES,
    SIGNALS,
    SIGNED,
    SUMMARY,
    composite,
    ic_sql,
    process_sql,
    quantile_sql,
    rounded,
    sig_sql,
    signals,
    z_sql,
)
from lattica.catalog.factors import EVERY, IVOL, RETURNS, SCALE
from lattica.operators import diagnostics, labels
from lattica.operators.calendars import session_list
from lattica.operators.factors import compute_factors
from lattica.operators.moments import merge_moments, pairwise_correlations, section_moments
from lattica.operators.universe import UniverseRule
from lattica.plans import ridge, walkforward
from lattica.plans.boosting import BoostSettings, boost
from lattica.plans.folds import fold_dates, year_folds
from lattica.plans.panel import section_layout, table, weekly_panel
from lattica.plans.suite import SuiteSettings, run_suite
from lattica.session import settle

FEATURES = ["reversal_5", "momentum_20_5"]
ALPHAS = [1.0, 100.0]
EMBARGO = 6


def folds_sql(embargo: int = EMBARGO) -> str:
    return f""", fs0 AS (SELECT DISTINCT trade_date FROM weekly),
  heads AS (SELECT unnest(range((SELECT min(year(trade_date)) FROM fs0) + 3, (SELECT max(year(trade_date)) FROM fs0) + 1)) AS test_year),
  spans AS (SELECT test_year, 'train' AS part, test_year - 3 AS lo, test_year - 2 AS hi FROM heads
    UNION ALL SELECT test_year, 'validation', test_year - 1, test_year - 1 FROM heads UNION ALL SELECT test_year, 'test', test_year, test_year FROM heads),
  dated AS (SELECT test_year, part, trade_date, row_number() OVER (PARTITION BY test_year, part ORDER BY trade_date DESC) AS back FROM spans JOIN fs0 ON year(trade_date) BETWEEN lo AND hi),
  folds AS (SELECT test_year, part, trade_date FROM dated WHERE part = 'test' OR back > {embargo})"""


def sessions_of(df):
    return session_list(df)


def model_rows(spark, sf):
    """The model frame, materialised once: moments, medians and predictions all read it."""
    scores = signals(spark, sf).withColumn("in_universe", ~F.col("is_st"))
    return settle(walkforward.model_frame(scores, FEATURES, "next_open_return_5d", 1, section_layout(spark, sf)))


MODEL = SIGNALS + """, mf0 AS (SELECT trade_date, symbol, reversal_5 AS f1, momentum_20_5 AS f2, next_open_return_5d AS y0 FROM sig
    WHERE NOT is_st AND (reversal_5 IS NOT NULL OR momentum_20_5 IS NOT NULL)),
  mf AS (SELECT *, CASE WHEN y0 IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY y0 NULLS LAST) + (count(y0) OVER (PARTITION BY trade_date, y0) - 1) / 2.0)
    / count(y0) OVER (PARTITION BY trade_date) - 0.5 END AS label FROM mf0)""" + folds_sql() + """,
  fsets AS (SELECT test_year, 'train' AS fitted_on, trade_date FROM folds WHERE part = 'train' UNION ALL SELECT test_year, 'train+validation', trade_date FROM folds WHERE part <> 'test'),
  fr AS (SELECT test_year, fitted_on, f1, f2, label FROM mf JOIN fsets USING (trade_date) WHERE label IS NOT NULL),
  med AS (SELECT test_year, fitted_on, coalesce(median(f1), 0) AS m1, coalesce(median(f2), 0) AS m2 FROM fr GROUP BY 1, 2),
  imp AS (SELECT test_year, fitted_on, m1, m2, coalesce(f1, m1) AS x1, coalesce(f2, m2) AS x2, label FROM fr JOIN med USING (test_year, fitted_on)),
  st AS (SELECT test_year, fitted_on, any_value(m1) AS m1, any_value(m2) AS m2, count(*) AS n, avg(x1) AS a1, avg(x2) AS a2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(label) AS ay,
    covar_pop(x1, x2) AS c12, covar_pop(x1, label) AS c1y, covar_pop(x2, label) AS c2y FROM imp GROUP BY 1, 2),
  sys AS (SELECT *, n * c12 / (s1 * s2) AS g, n * c1y / s1 AS t1, n * c2y / s2 AS t2, unnest([1.0, 100.0])::DOUBLE AS alpha FROM st),
  coef AS (SELECT *, ((n + alpha) * t1 - g * t2) / ((n + alpha) * (n + alpha) - g * g) AS b1, ((n + alpha) * t2 - g * t1) / ((n + alpha) * (n + alpha) - g * g) AS b2 FROM sys)"""


@query(
    "ridge_coefficients",
    with_weekly(
        MODEL
        + """ SELECT test_year, fitted_on, alpha, round(ay, 6) AS intercept, round(m1, 6) AS median_1, round(a2, 6) AS mean_2, round(s1, 6) AS scale_1,
      round(b1, 6) AS beta_1, round(b2, 6) AS beta_2 FROM coef"""
    ),
)
def ridge_coefficients(spark, sf):
    rows = model_rows(spark, sf)
    dates = fold_dates(sessions_of(weekly_panel(spark, sf)), year_folds(sessions_of(weekly_panel(spark, sf)), 2, 1, 1), EMBARGO)
    out = ridge.fit_ridge(rows, dates, FEATURES, ALPHAS)
    pick = lambda c, i, n: F.round(F.col(c)[i], 6).alias(n)
    return out.select(
        "test_year", "fitted_on", "alpha", F.round("intercept", 6).alias("intercept"), pick("medians", 0, "median_1"),
        pick("means", 1, "mean_2"), pick("scales", 0, "scale_1"), pick("coefficients", 0, "beta_1"), pick("coefficients", 1, "beta_2"),
    )


def predict_sql(name: str, part: str, source: str) -> str:
    return f""", {name} AS (SELECT c.test_year, c.alpha, mf.trade_date, mf.symbol, mf.label, (coalesce(f1, 0) + coalesce(f2, 0)) / ((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT) AS equal_weight,
    ay + (coalesce(f1, m1) - a1) / s1 * b1 + (coalesce(f2, m2) - a2) / s2 * b2 AS prediction FROM mf JOIN folds USING (trade_date) JOIN {source} c ON c.test_year = folds.test_year WHERE part = '{part}')"""


WALK = (
    MODEL
    + ", trained AS (SELECT * FROM coef WHERE fitted_on = 'train')"
    + predict_sql("vp", "validation", "trained")
    + ic_sql("vic", "vp", "test_year, alpha, trade_date", "prediction", "label", 5)
    + """, va AS (SELECT test_year, alpha, avg(ic) AS validation_ic FROM vic GROUP BY 1, 2),
  best AS (SELECT test_year, alpha, validation_ic FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY validation_ic DESC, alpha) AS k FROM va WHERE validation_ic IS NOT NULL) WHERE k = 1),
  refit AS (SELECT coef.*, validation_ic FROM coef JOIN best USING (test_year, alpha) WHERE fitted_on = 'train+validation')"""
    + predict_sql("tp", "test", "refit")
)


def walk(spark, sf):
    rows = model_rows(spark, sf)
    sessions = settle(sessions_of(weekly_panel(spark, sf)))
    return walkforward.ridge_walk_forward(
        rows, FEATURES, ALPHAS, sessions, 2, 1, 1, EMBARGO, section_layout(spark, sf)
    )


@query(
    "ridge_predictions",
    with_weekly(
        WALK
        + """ SELECT test_year, trade_date, symbol, round(label, 6) AS label, round(prediction, 6) AS ridge_prediction, round(equal_weight, 6) AS equal_weight_prediction FROM tp"""
    ),
)
def ridge_predictions(spark, sf):
    return rounded(walk(spark, sf)[0], ["label", "ridge_prediction", "equal_weight_prediction"])


@query(
    "ridge_walk_forward",
    with_weekly(
        WALK
        + ic_sql("tic", "tp", "test_year, trade_date", "prediction", "label", 5)
        + ic_sql("eic", "tp", "test_year, trade_date", "equal_weight", "label", 5)
        + """ SELECT r.test_year, r.alpha AS ridge_alpha, round(r.validation_ic, 6) AS ridge_validation_ic, round((SELECT avg(ic) FROM tic WHERE tic.test_year = r.test_year), 6) AS ridge_test_ic,
      round((SELECT avg(ic) FROM eic WHERE eic.test_year = r.test_year), 6) AS equal_weight_test_ic, (SELECT count(*) FROM tp WHERE tp.test_year = r.test_year) AS test_rows FROM refit r"""
    ),
)
def ridge_walk_forward(spark, sf):
    return rounded(walk(spark, sf)[1], ["ridge_validation_ic", "ridge_test_ic", "equal_weight_test_ic"])


@query(
    "importance_stability",
    with_weekly(
        WALK
        + """, im AS (SELECT test_year, unnest(['reversal_5', 'momentum_20_5']) AS feature, unnest([b1, b2]) AS b, abs(b1) + abs(b2) AS t FROM refit)
      SELECT 'ridge' AS model, feature, round(avg(b / t), 6) AS mean_normalized_importance, round(stddev_samp(b / t), 6) AS importance_std, round(avg((b > 0)::INT), 6) AS positive_share,
        count(DISTINCT test_year) AS folds FROM im GROUP BY feature"""
    ),
)
def importance_stability(spark, sf):
    out = walkforward.importance_stability(walk(spark, sf)[2])
    return rounded(out, ["mean_normalized_importance", "importance_std", "positive_share"])


@query("boosted_trees")
def boosted_trees(spark, sf):
    rows = model_rows(spark, sf)
    split = sessions_of(rows).select(
        "trade_date",
        F.when(F.col("trade_date") < "1999-01-01", "train").when(F.col("trade_date") < "2000-01-01", "validation").otherwise("test").alias("part"),
    )
    return walkforward.boosted_trees(rows, FEATURES, split)


SELECTION = (
    SIGNALS
    + LONG
    + ic_sql("ic", "long", "factor, trade_date", "value", "next_open_return_5d")
    + folds_sql()
    + """, fm AS (SELECT test_year, factor, avg(ic) FILTER (WHERE part = 'train') AS train_ic, avg(ic) FILTER (WHERE part = 'validation') AS validation_ic FROM ic JOIN folds USING (trade_date) WHERE part <> 'test' GROUP BY 1, 2),
  kept AS (SELECT *, validation_ic / sum(validation_ic) OVER (PARTITION BY test_year) AS weight FROM fm WHERE train_ic > 0 AND validation_ic > 0),
  fw AS (SELECT h.test_year, k.factor, k.train_ic, k.validation_ic, k.weight FROM (SELECT DISTINCT test_year FROM folds) h LEFT JOIN kept k USING (test_year)),
  cnt AS (SELECT test_year, count(factor) AS selected_count FROM fw GROUP BY 1)"""
)
OOS = SELECTION + f""", lr AS (SELECT f.test_year, l.trade_date, l.symbol, l.next_open_return_5d, l.value, w.weight FROM long l JOIN folds f ON f.trade_date = l.trade_date AND f.part = 'test'
    LEFT JOIN fw w ON w.test_year = f.test_year AND w.factor = l.factor),
  ag AS (SELECT test_year, trade_date, symbol, any_value(next_open_return_5d) AS y, sum(value * weight) AS top, sum(weight) FILTER (WHERE value IS NOT NULL) AS bottom, count(value * weight) AS seen FROM lr GROUP BY 1, 2, 3),
  rw AS (SELECT ag.*, selected_count, CASE WHEN seen >= least(2, selected_count) AND selected_count > 0 THEN top / nullif(bottom, 0) END AS raw FROM ag JOIN cnt USING (test_year)),
  oos AS (SELECT *, {z_sql('raw', 'trade_date')} AS factor_processed FROM rw)"""


def selection(spark, sf):
    scores = settle(signals(spark, sf))
    return walkforward.selection_walk_forward(
        scores, NAMES, "next_open_return_5d", session_list(scores), 2, 1, 1, EMBARGO, 2, section_layout(spark, sf)
    )


@query(
    "factor_selection",
    with_weekly(SELECTION + " SELECT test_year, factor, round(train_ic, 6) AS train_ic, round(validation_ic, 6) AS validation_ic, round(weight, 6) AS weight FROM fw"),
)
def factor_selection(spark, sf):
    return rounded(selection(spark, sf)[0], ["train_ic", "validation_ic", "weight"])


@query(
    "walk_forward_scores",
    with_weekly(OOS + " SELECT test_year, trade_date, symbol, round(factor_processed, 6) AS factor_processed, selected_count = 0 AS force_cash FROM oos"),
)
def walk_forward_scores(spark, sf):
    out = selection(spark, sf)[1].select("test_year", "trade_date", "symbol", "factor_processed", "force_cash")
    return rounded(out, ["factor_processed"])


@query(
    "walk_forward_folds",
    with_weekly(
        OOS
        + ic_sql("oic", "oos", "test_year, trade_date", "factor_processed", "y")
        + """ SELECT test_year, coalesce((SELECT string_agg(factor, ',' ORDER BY factor) FROM fw WHERE fw.test_year = c.test_year AND factor IS NOT NULL), '') AS selected_factors, selected_count,
      round((SELECT avg(ic) FROM oic WHERE oic.test_year = c.test_year), 6) AS test_mean_ic FROM cnt c"""
    ),
)
def walk_forward_folds(spark, sf):
    return rounded(selection(spark, sf)[2], ["test_mean_ic"])


@query(
    "fixed_rule_walk_forward",
    sig_sql(
        SIGNED
        + ic_sql("ic", "composite", "trade_date", "factor_processed", "next_open_return_5d")
        + """, b AS (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM sig),
      h AS (SELECT k AS fold, CAST(lo + to_years(CAST(3 + k - 1 AS INTEGER)) AS DATE) AS ts FROM b, range(1, 10) t(k) WHERE lo + to_years(CAST(3 + k AS INTEGER)) <= hi + 7),
      p AS (SELECT fold, 'train' AS part, CAST(ts - INTERVAL 3 YEAR AS DATE) AS lo, CAST(ts - INTERVAL 1 YEAR AS DATE) AS hi FROM h UNION ALL SELECT fold, 'validation', CAST(ts - INTERVAL 1 YEAR AS DATE), ts FROM h
        UNION ALL SELECT fold, 'test', ts, CAST(ts + INTERVAL 1 YEAR AS DATE) FROM h),
      d AS (SELECT fold, part, trade_date, ic, row_number() OVER (PARTITION BY fold, part ORDER BY trade_date DESC) AS back FROM p JOIN ic ON trade_date >= lo AND trade_date < hi)
      SELECT fold, min(trade_date) FILTER (WHERE part = 'train') AS train_first_date, max(trade_date) FILTER (WHERE part = 'validation') AS validation_last_date, max(trade_date) FILTER (WHERE part = 'test') AS test_last_date,
        round(avg(ic) FILTER (WHERE part = 'train'), 6) AS train_mean_ic, round(avg(ic) FILTER (WHERE part = 'validation'), 6) AS validation_mean_ic, round(avg(ic) FILTER (WHERE part = 'test'), 6) AS test_mean_ic
      FROM d WHERE part = 'test' OR back > 6 GROUP BY fold"""
    ),
)
def fixed_rule(spark, sf):
    scores = settle(composite(spark, sf))
    out = walkforward.fixed_rule_walk_forward(
        scores, "factor_processed", "next_open_return_5d", session_list(scores), 2, 1, 1, EMBARGO, section_layout(spark, sf)
    )
    means = ["train_mean_ic", "validation_mean_ic", "test_mean_ic"]
    return rounded(out.select("fold", "train_first_date", "validation_last_date", "test_last_date", *means), means)


# --- the suite -----------------------------------------------------------------------------

SETTINGS = SuiteSettings(
    factors={"reversal_5": 1, "momentum_20_5": -1, "volatility_20": 1},
    minimum_coverage=0.9,
    minimum_valid=2,
    universe=UniverseRule(min_listed_days=10),
    start="1996-01-01",
    recent_windows=(26, 52),
)
SUITE = SIGNALS + """, su AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) >= 10 AND NOT is_st AND NOT is_suspended AS in_universe FROM sig),
  lg AS (SELECT trade_date, symbol, in_universe, forward_return_5d, next_open_return_5d, unnest(['reversal_5', 'momentum_20_5', 'volatility_20']) AS factor, unnest([1, -1, 1]) AS dir,
    unnest([CASE WHEN in_universe THEN reversal_5 END, CASE WHEN in_universe THEN momentum_20_5 END, CASE WHEN in_universe THEN volatility_20 END]) AS value FROM su)""" + process_sql(
    "lg", "value", "factor, trade_date", False, "raw_scores"
) + """, gate AS (SELECT factor, trade_date, avg((factor_processed IS NOT NULL)::INT) FILTER (WHERE in_universe) AS coverage FROM raw_scores GROUP BY 1, 2),
  long_scores AS (SELECT r.* REPLACE (CASE WHEN coalesce(coverage < 0.9, FALSE) THEN NULL ELSE factor_processed END AS factor_processed), coverage FROM raw_scores r JOIN gate USING (factor, trade_date)),
  studied AS (SELECT * FROM long_scores WHERE trade_date >= DATE '1996-01-01')"""


def suite(spark, sf):
    return run_suite(weekly_panel(spark, sf), SETTINGS, section_layout(spark, sf))


@query(
    "suite_summary",
    with_weekly(
        SUITE
        + ic_sql("ic", "studied", "factor, trade_date", "factor_processed", "forward_return_5d")
        + ic_sql("xic", "studied", "factor, trade_date", "factor_processed", "next_open_return_5d")
        + quantile_sql("studied", "factor, trade_date", "factor_processed", "forward_return_5d")
        + f""", s AS (SELECT factor, {SUMMARY} FROM ic GROUP BY factor), x AS (SELECT factor, avg(ic) AS hac_mean, count(ic) AS hac_observations FROM xic GROUP BY 1),
      m AS (SELECT factor, quantile, avg(mean_return) AS v FROM q GROUP BY 1, 2), t AS (SELECT factor, arg_max(v, quantile) - arg_min(v, quantile) AS spread FROM m GROUP BY 1)
      SELECT factor, CASE factor WHEN 'momentum_20_5' THEN -1 ELSE 1 END AS direction, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(win_rate, 6) AS win_rate, observations, round(mean_ic / ic_std * sqrt(50.4), 6) AS icir,
        round(hac_mean, 6) AS hac_mean, hac_observations, round(spread, 6) AS top_minus_bottom FROM s JOIN x USING (factor) JOIN t USING (factor)"""
    ),
)
def suite_summary(spark, sf):
    out = suite(spark, sf).summary
    numbers = ["mean_ic", "ic_std", "win_rate", "icir", "hac_mean", "top_minus_bottom"]
    return rounded(out.select("factor", "direction", "observations", "hac_observations", *numbers), numbers)


@query(
    "suite_scores",
    with_weekly(
        SUITE
        + f""", w AS (SELECT trade_date, symbol, any_value(in_universe) AS in_universe, max(factor_processed * dir) FILTER (WHERE factor = 'reversal_5') AS reversal_5, max(factor_processed * dir) FILTER (WHERE factor = 'momentum_20_5') AS momentum_20_5,
        max(factor_processed * dir) FILTER (WHERE factor = 'volatility_20') AS volatility_20, count(factor_processed) AS valid_factor_count, CASE WHEN count(factor_processed) >= 2 THEN avg(factor_processed * dir) END AS raw FROM long_scores GROUP BY 1, 2),
      z AS (SELECT *, {z_sql('raw', 'trade_date')} AS z FROM w)
      SELECT trade_date, symbol, round(reversal_5, 6) AS reversal_5, round(momentum_20_5, 6) AS momentum_20_5, round(volatility_20, 6) AS volatility_20, valid_factor_count,
        round(CASE WHEN in_universe AND trade_date >= DATE '1996-01-01' THEN z END, 6) AS factor_processed FROM z"""
    ),
)
def suite_scores(spark, sf):
    columns = [*SETTINGS.factors, "factor_processed"]
    return rounded(suite(spark, sf).scores.select("trade_date", "symbol", "valid_factor_count", *columns), columns)


@query(
    "suite_coverage",
    with_weekly(
        SUITE
        + """ SELECT factor, trade_date, round(any_value(coverage), 6) AS coverage, coalesce(any_value(coverage) >= 0.9, FALSE) AS meets_threshold FROM studied GROUP BY 1, 2"""
    ),
)
def suite_coverage(spark, sf):
    return rounded(suite(spark, sf).coverage, ["coverage"])


@query(
    "suite_latest",
    with_weekly(
        SUITE
        + f""", w AS (SELECT symbol, any_value(in_universe) AS in_universe, count(factor_processed) AS n, CASE WHEN count(factor_processed) >= 2 THEN avg(factor_processed * dir) END AS raw
        FROM long_scores WHERE trade_date = (SELECT max(trade_date) FROM long_scores) GROUP BY 1),
      z AS (SELECT *, (raw - avg(raw) OVER ()) / nullif(stddev_pop(raw) OVER (), 0) AS z FROM w)
      SELECT symbol, round(z, 6) AS factor_processed, CASE WHEN z IS NOT NULL THEN row_number() OVER (ORDER BY z DESC NULLS LAST, symbol) END AS factor_rank FROM z WHERE in_universe"""
    ),
)
def suite_latest(spark, sf):
    return rounded(suite(spark, sf).latest.select("symbol", "factor_processed", "factor_rank"), ["factor_processed"])


# --- all built-in factors ---------------------------------------------------------------------

ALL_NAMES = list(EVERY)
ALL_ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
ALL_VALUES = RETURNS.replace("FROM daily", "FROM weekly") + IVOL + ", av AS (SELECT trade_date, symbol, adj_open, is_st, " + ", ".join(
    f"round(({formula}) * {SCALE.get(name, 1.0)}, 8) AS {name}" for name, formula in EVERY.items()
) + f""" FROM e WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  al AS (SELECT trade_date, symbol, unnest([{", ".join(f"'{n}'" for n in ALL_NAMES)}]) AS factor, unnest([{", ".join(ALL_NAMES)}]) AS value FROM av),
  ap AS (SELECT a.factor AS factor_a, b.factor AS factor_b, a.trade_date, year(a.trade_date) AS year, a.value AS x, b.value AS y FROM al a JOIN al b ON a.trade_date = b.trade_date AND a.symbol = b.symbol
    WHERE a.factor <= b.factor AND a.value IS NOT NULL AND b.value IS NOT NULL)"""


def all_factors(spark, sf):
    """The nineteen factors, at eight digits so that ties do not hang on the last bit of a running mean."""
    panel = compute_factors(weekly_panel(spark, sf), ALL_NAMES)
    return panel.withColumns({n: F.round(F.col(n) * SCALE.get(n, 1.0), 8) for n in ALL_NAMES})


@query(
    "factor_correlation_all",
    with_weekly(ALL_VALUES + ic_sql("ic", "ap", "factor_a, factor_b, trade_date", "x", "y", 1) + " SELECT factor_a, factor_b, round(avg(ic), 6) AS correlation FROM ic GROUP BY 1, 2"),
)
def factor_correlation_all(spark, sf):
    """Mean daily rank correlation of all pairs of the nineteen factors."""
    out = diagnostics.factor_correlation(all_factors(spark, sf), ALL_NAMES, section_layout(spark, sf))
    return rounded(out.where("factor_a <= factor_b"), ["correlation"])


@query(
    "factor_gram",
    with_weekly(
        ALL_VALUES
        + """ SELECT year, factor_a, factor_b, count(*) AS pairs, round(CASE WHEN stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN corr(x, y) END, 5) AS correlation FROM ap GROUP BY 1, 2, 3"""
    ),
)
def factor_gram(spark, sf):
    """Pearson correlations of all pairs per year, from one Gram matrix per session."""
    daily = section_moments(all_factors(spark, sf), ALL_NAMES, squares=True)
    yearly = merge_moments(daily.withColumn("year", F.year("trade_date")), ["year"])
    out = pairwise_correlations(yearly, ALL_NAMES, ["year"]).where("factor_a <= factor_b AND pairs > 0")
    return out.withColumn("correlation", F.round("correlation", 5))


ALL_MODEL = (
    ALL_VALUES
    + """, ay AS (SELECT trade_date, symbol, lead(adj_open, 6) OVER w / lead(adj_open, 1) OVER w - 1 AS y0 FROM av WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  am AS (SELECT av.*, y0 FROM av JOIN ay USING (trade_date, symbol) WHERE NOT is_st AND num_known >= 1)""".replace("num_known", "(" + " + ".join(f"({n} IS NOT NULL)::INT" for n in ALL_NAMES) + ")")
    + folds_sql()
    + """, fsets AS (SELECT test_year, 'train' AS fitted_on, trade_date FROM folds WHERE part = 'train' UNION ALL SELECT test_year, 'train+validation', trade_date FROM folds WHERE part <> 'test')"""
)


def all_model(spark, sf):
    scores = labels.add_execution_returns(all_factors(spark, sf), (5,)).withColumn("in_universe", ~F.col("is_st"))
    rows = settle(walkforward.model_frame(scores, ALL_NAMES, "next_open_return_5d", 1, section_layout(spark, sf)))
    sessions = settle(sessions_of(weekly_panel(spark, sf)))
    return rows, fold_dates(sessions, year_folds(sessions, 2, 1, 1), EMBARGO)


@query(
    "fold_medians_all",
    with_weekly(
        ALL_MODEL
        + """, ml AS (SELECT test_year, fitted_on, unnest(["""
        + ", ".join(f"'{n}'" for n in ALL_NAMES)
        + "]) AS feature, unnest(["
        + ", ".join(ALL_NAMES)
        + """]) AS value FROM am JOIN fsets USING (trade_date) WHERE y0 IS NOT NULL)
  SELECT test_year, fitted_on, feature, round(coalesce(median(value), 0), 6) AS median FROM ml GROUP BY 1, 2, 3"""
    ),
)
def fold_medians_all(spark, sf):
    """Exact medians of all factors over overlapping fit sets; a row is not copied per fit set."""
    rows, dates = all_model(spark, sf)
    out = ridge.fold_medians(rows.where("label IS NOT NULL"), ridge._fit_sets(dates), ALL_NAMES)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in ALL_NAMES]).alias("feature"), F.col("medians").alias("median"))
    return out.select("test_year", "fitted_on", F.inline(named)).withColumn("median", F.round("median", 6))


@query(
    "ridge_all_factors",
    with_weekly(
        ALL_MODEL
        + """ SELECT test_year, fitted_on, unnest([0.1, 1, 10, 100, 1000, 10000])::DOUBLE AS alpha, count(*) AS rows, 19 AS features, TRUE AS stationary FROM am JOIN fsets USING (trade_date) WHERE y0 IS NOT NULL GROUP BY 1, 2"""
    ),
)
def ridge_all_factors(spark, sf):
    """Ridge over nineteen factors and six penalties: at a solution the loss, taken from the rows, has no slope."""
    rows, dates = all_model(spark, sf)
    rows = rows.where("label IS NOT NULL")
    fits = settle(ridge.fit_ridge(rows, dates, ALL_NAMES, ALL_ALPHAS))
    slopes = ridge.loss_slopes(rows, dates, ALL_NAMES, fits)
    sums = slopes.groupBy("test_year", "fitted_on", "alpha").agg(F.max("rows").alias("rows"), F.max(F.abs("slope")).alias("_slope"), F.count("*").cast("int").alias("features"))
    return sums.select("test_year", "fitted_on", "alpha", "rows", "features", (F.col("_slope") < 1e-6 * F.col("rows")).alias("stationary"))


# --- boosted trees ----------------------------------------------------------------------------

EXPLAINED = [n for n in ALL_NAMES if "volatility" not in n and n not in ("ivol_60", "my_momentum_20", "reversal_20")]
SMALL_BOOST = BoostSettings(max_trees=10, step=0.3, depth=3, patience=3)


@query(
    "histogram_boosting",
    with_weekly(
        ALL_VALUES
        + folds_sql()
        + f""", tr AS (SELECT test_year, count(*) AS test_rows FROM av JOIN folds USING (trade_date) WHERE part = 'test' AND NOT is_st AND ({" OR ".join(f"{n} IS NOT NULL" for n in EXPLAINED)}) GROUP BY 1)
      SELECT test_year, test_rows, TRUE AS learned, TRUE AS kept, 1.0::DOUBLE AS importance FROM tr"""
    ),
)
def histogram_boosting(spark, sf):
    """The rank of volatility from the other factors, all folds at once: the validation error falls below the mean's."""
    scores = all_factors(spark, sf).withColumn("in_universe", ~F.col("is_st"))
    rows = settle(walkforward.model_frame(scores, EXPLAINED, "volatility_20", 1, section_layout(spark, sf)))
    sessions = settle(sessions_of(weekly_panel(spark, sf)))
    scored, report, gains = boost(rows, EXPLAINED, fold_dates(sessions, year_folds(sessions, 2, 1, 1), EMBARGO), SMALL_BOOST)
    tests = scored.groupBy("test_year").agg(F.count("prediction").alias("test_rows"))
    whole = gains.groupBy("test_year").agg(F.round(F.sum("importance"), 6).alias("importance"))
    flags = report.select("test_year", (F.col("best_error") < F.col("mean_error")).alias("learned"), (F.col("trees_kept") > 0).alias("kept"))
    return tests.join(flags, "test_year").join(whole, "test_year")


@query(
    "model_comparison",
    with_weekly(
        WALK
        + ic_sql("tic", "tp", "test_year, trade_date", "prediction", "label", 5)
        + ic_sql("eic", "tp", "test_year, trade_date", "equal_weight", "label", 5)
        + """ SELECT r.test_year, round((SELECT avg(ic) FROM tic WHERE tic.test_year = r.test_year), 6) AS ridge_test_ic, round((SELECT avg(ic) FROM eic WHERE eic.test_year = r.test_year), 6) AS equal_weight_test_ic,
      TRUE AS boosted_bounded, (SELECT count(*) FROM tp WHERE tp.test_year = r.test_year) AS test_rows, 4::BIGINT AS importances FROM refit r"""
    ),
)
def model_comparison(spark, sf):
    """Ridge, boosted and equal-weight predictions of the same rows; ``boosted_bounded``: its rank IC is known and in [-1, 1], or no tree was kept."""
    sessions = settle(sessions_of(weekly_panel(spark, sf)))
    both, folds, importance = walkforward.model_comparison(model_rows(spark, sf), FEATURES, ALPHAS, sessions, 2, 1, 1, EMBARGO, section_layout(spark, sf), SMALL_BOOST)
    tests = both.where("boosted_prediction IS NOT NULL").groupBy("test_year").agg(F.count("*").alias("_rows"))
    listed = importance.groupBy("test_year").agg(F.count("*").alias("importances"))
    bounded = F.coalesce(F.abs("boosted_test_ic") <= 1, F.col("trees_kept") == 0)
    out = folds.select("test_year", "ridge_test_ic", "equal_weight_test_ic", bounded.alias("boosted_bounded"))
    return rounded(out.join(tests, "test_year").join(listed, "test_year").withColumnRenamed("_rows", "test_rows"), ["ridge_test_ic", "equal_weight_test_ic"])
