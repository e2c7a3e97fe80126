"""Cross-section and diagnostics queries on the weekly panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.base import query, with_weekly
from lattica.operators import calendars, diagnostics, labels, preprocess
from lattica.operators.composite import equal_weight_composite, signed_weight_composite
from lattica.operators.factors import compute_factors
from lattica.operators.merging import feature_matrix
from lattica.plans.panel import section_layout, weekly_panel

NAMES = ["reversal_5", "momentum_20_5", "volatility_20", "amount_momentum_20"]


def signals(spark, sf, bars=None):
    """Weekly panel with four factors and both five-step labels."""
    panel = compute_factors(weekly_panel(spark, sf) if bars is None else bars, NAMES)
    return labels.add_execution_returns(labels.add_forward_returns(panel, (5,), "adj_close"), (5,))


FR20 = "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
FR5 = "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
SIGNALS = f""", sr AS (SELECT *, adj_close / lag(adj_close) OVER w - 1 AS ret FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  sig AS (SELECT *, -(adj_close / lag(adj_close, 5) OVER w - 1) AS reversal_5,
    lag(adj_close, 5) OVER w / lag(adj_close, 20) OVER w - 1 AS momentum_20_5,
    CASE WHEN count(ret) OVER {FR20} >= 15 THEN stddev_samp(ret) OVER {FR20} END AS volatility_20,
    (CASE WHEN count(amount) OVER {FR5} >= 4 THEN avg(amount) OVER {FR5} END)
      / (CASE WHEN count(amount) OVER {FR20} >= 15 THEN avg(amount) OVER {FR20} END) - 1 AS amount_momentum_20,
    lead(adj_close, 5) OVER w / adj_close - 1 AS forward_return_5d,
    lead(adj_open, 6) OVER w / lead(adj_open, 1) OVER w - 1 AS next_open_return_5d
    FROM sr WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))"""
LONG = """, long AS (SELECT trade_date, symbol, market_cap, industry, forward_return_5d, next_open_return_5d, unnest(['reversal_5', 'momentum_20_5', 'volatility_20', 'amount_momentum_20']) AS factor,
    unnest([reversal_5, momentum_20_5, volatility_20, amount_momentum_20]) AS value FROM sig)"""


def ic_sql(name: str, source: str, keys: str, x: str, y: str, minimum: int = 10, ranked: bool = True) -> str:
    """CTEs ending in ``name(keys, ic, pairs)``."""

    def rank(c: str) -> str:
        if not ranked:
            return c
        return (
            f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {c} NULLS LAST)"
            f" + (count({c}) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0 END"
        )

    return f""", {name}_v AS (SELECT {keys}, CASE WHEN {y} IS NOT NULL THEN {x} END AS a, CASE WHEN {x} IS NOT NULL THEN {y} END AS b FROM {source}),
    {name}_r AS (SELECT {keys}, a, {rank('a')} AS ra, {rank('b')} AS rb FROM {name}_v),
    {name} AS (SELECT {keys}, CASE WHEN count(a) >= {minimum} AND stddev_samp(ra) > 0 AND stddev_samp(rb) > 0 THEN corr(ra, rb) END AS ic,
      count(a) AS pairs FROM {name}_r GROUP BY {keys})"""


def sig_sql(body: str) -> str:
    return with_weekly(SIGNALS + body)


def z_sql(value: str, keys: str) -> str:
    return f"({value} - avg({value}) OVER (PARTITION BY {keys})) / nullif(stddev_pop({value}) OVER (PARTITION BY {keys}), 0)"


def process_sql(source: str, value: str, keys: str, neutral: bool, out: str = "processed") -> str:
    """CTEs ending in ``out`` with factor_winsor, factor_z and factor_processed."""
    base = f""", p1 AS (SELECT *, median({value}) OVER (PARTITION BY {keys}) AS med FROM {source}),
    p2 AS (SELECT *, median(abs({value} - med)) OVER (PARTITION BY {keys}) AS mad FROM p1),
    p3 AS (SELECT *, CASE WHEN {value} IS NULL THEN NULL WHEN mad > 0 THEN least(greatest({value}, med - 5 * 1.4826 * mad), med + 5 * 1.4826 * mad) ELSE {value} END AS factor_winsor FROM p2),
    p4 AS (SELECT *, {z_sql('factor_winsor', keys)} AS factor_z FROM p3)"""
    if not neutral:
        return base + f", {out} AS (SELECT *, factor_z AS factor_processed FROM p4)"
    return base + f""", p5 AS (SELECT *, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS x0,
      coalesce(industry, min(industry) OVER (PARTITION BY {keys})) AS g FROM p4),
    p5b AS (SELECT {keys}, count(DISTINCT industry) AS inds FROM p5 GROUP BY {keys}),
    p6 AS (SELECT *, CASE WHEN factor_z IS NOT NULL AND x0 IS NOT NULL THEN factor_z END AS y, CASE WHEN factor_z IS NOT NULL THEN x0 END AS x FROM p5 JOIN p5b USING ({keys})),
    p7 AS (SELECT *, y - avg(y) OVER (PARTITION BY {keys}, g) AS yd, x - avg(x) OVER (PARTITION BY {keys}, g) AS xd FROM p6),
    p8 AS (SELECT *, CASE WHEN count(y) OVER (PARTITION BY {keys}) > 2 + greatest(inds - 1, 0) THEN
        yd - coalesce(sum(xd * yd) OVER (PARTITION BY {keys}) / nullif(sum(xd * xd) OVER (PARTITION BY {keys}), 0), 0) * xd END AS res FROM p7),
    {out} AS (SELECT *, {z_sql('res', keys)} AS factor_processed FROM p8)"""


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("forward_returns", sig_sql(" SELECT trade_date, symbol, round(forward_return_5d, 6) AS forward_return_5d FROM sig"))
def forward_returns(spark, sf):
    out = labels.add_forward_returns(weekly_panel(spark, sf), (5,), "adj_close")
    return out.select("trade_date", "symbol", r("forward_return_5d"))


@query("execution_returns", sig_sql(" SELECT trade_date, symbol, round(next_open_return_5d, 6) AS next_open_return_5d FROM sig"))
def execution_returns(spark, sf):
    out = labels.add_execution_returns(weekly_panel(spark, sf), (5,))
    return out.select("trade_date", "symbol", r("next_open_return_5d"))


@query(
    "one_row_return",
    sig_sql(" SELECT trade_date, symbol, round(ret, 6) AS ret FROM sig"),
)
def one_row_return(spark, sf):
    from pyspark.sql import Window as W

    from lattica.functions.numeric import ratio

    w = W.partitionBy("symbol").orderBy("trade_date")
    out = weekly_panel(spark, sf).withColumn("ret", ratio("adj_close", F.lag("adj_close").over(w)) - 1)
    return out.select("trade_date", "symbol", r("ret"))


@query(
    "winsorize_mad",
    sig_sql(process_sql("sig", "reversal_5", "trade_date", False) + " SELECT trade_date, symbol, round(factor_winsor, 6) AS factor_winsor FROM processed"),
)
def winsorize(spark, sf):
    out = preprocess.winsorize_mad(signals(spark, sf), "reversal_5", "factor_winsor", layout=section_layout(spark, sf))
    return out.select("trade_date", "symbol", r("factor_winsor"))


@query("zscore", sig_sql(f" SELECT trade_date, symbol, round({z_sql('reversal_5', 'trade_date')}, 6) AS z FROM sig"))
def zscore(spark, sf):
    out = preprocess.zscore(signals(spark, sf), "reversal_5", "z", layout=section_layout(spark, sf))
    return out.select("trade_date", "symbol", r("z"))


@query(
    "neutralize",
    sig_sql(
        process_sql("sig", "reversal_5", "trade_date", True)
        + " SELECT trade_date, symbol, round(res, 6) AS residual FROM processed"
    ),
)
def neutralize(spark, sf):
    lay = section_layout(spark, sf)
    out = preprocess.winsorize_mad(signals(spark, sf), "reversal_5", "factor_winsor", layout=lay)
    out = preprocess.zscore(out, "factor_winsor", "factor_z", layout=lay)
    out = preprocess.neutralize(out, "factor_z", "residual", layout=lay)
    return out.select("trade_date", "symbol", r("residual"))


@query(
    "preprocess_factor",
    sig_sql(
        process_sql("sig", "reversal_5", "trade_date", True)
        + " SELECT trade_date, symbol, round(factor_winsor, 6) AS factor_winsor, round(factor_z, 6) AS factor_z, round(factor_processed, 6) AS factor_processed FROM processed"
    ),
)
def preprocess_factor(spark, sf):
    out = preprocess.preprocess(signals(spark, sf), "reversal_5", layout=section_layout(spark, sf))
    return out.select("trade_date", "symbol", r("factor_winsor"), r("factor_z"), r("factor_processed"))


@query(
    "rank_label",
    sig_sql(
        """ SELECT trade_date, symbol, round(CASE WHEN forward_return_5d IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY forward_return_5d NULLS LAST)
      + (count(forward_return_5d) OVER (PARTITION BY trade_date, forward_return_5d) - 1) / 2.0) / count(forward_return_5d) OVER (PARTITION BY trade_date) - 0.5 END, 6) AS label FROM sig"""
    ),
)
def rank_label(spark, sf):
    out = preprocess.rank_label(signals(spark, sf), "forward_return_5d", layout=section_layout(spark, sf))
    return out.select("trade_date", "symbol", r("label"))


IC_BODY = " SELECT trade_date, round(ic, 6) AS ic, pairs FROM ic"


@query("rank_ic", sig_sql(ic_sql("ic", "sig", "trade_date", "reversal_5", "forward_return_5d") + IC_BODY))
def rank_ic(spark, sf):
    out = diagnostics.information_coefficient(signals(spark, sf), "reversal_5", "forward_return_5d", layout=section_layout(spark, sf))
    return out.select("trade_date", r("ic"), "pairs")


@query("pearson_ic", sig_sql(ic_sql("ic", "sig", "trade_date", "reversal_5", "forward_return_5d", ranked=False) + IC_BODY))
def pearson_ic(spark, sf):
    out = diagnostics.information_coefficient(signals(spark, sf), "reversal_5", "forward_return_5d", method="pearson")
    return out.select("trade_date", r("ic"), "pairs")


@query("prediction_ic", sig_sql(ic_sql("ic", "sig", "trade_date", "momentum_20_5", "next_open_return_5d", 5) + IC_BODY))
def prediction_ic(spark, sf):
    from lattica.plans.ridge import prediction_ic as run

    out = run(signals(spark, sf), "momentum_20_5", "next_open_return_5d", layout=section_layout(spark, sf))
    return out.select("trade_date", r("ic"), "pairs")


SUMMARY = "avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg((ic > 0)::INT) AS win_rate, count(ic) AS observations"
LONG_IC = SIGNALS + LONG + ic_sql("ic", "long", "factor, trade_date", "value", "forward_return_5d")


def long_ic(spark, sf):
    long = diagnostics.melt_factors(signals(spark, sf), NAMES, ["trade_date", "symbol", "forward_return_5d", "next_open_return_5d"])
    return diagnostics.information_coefficient(
        long, "value", "forward_return_5d", ("factor", "trade_date"), layout=section_layout(spark, sf)
    )


@query(
    "ic_summary",
    with_weekly(
        LONG_IC
        + f""" SELECT factor, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(win_rate, 6) AS win_rate, observations,
      round(mean_ic / ic_std * sqrt(50.4), 6) AS icir FROM (SELECT factor, {SUMMARY} FROM ic GROUP BY factor)"""
    ),
)
def ic_summary(spark, sf):
    return rounded(diagnostics.summarize_ic(long_ic(spark, sf), ("factor",)), ["mean_ic", "ic_std", "win_rate", "icir"])


@query(
    "annual_ic",
    with_weekly(
        LONG_IC
        + """ SELECT factor, year(trade_date) AS year, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std,
      round(avg((ic > 0)::INT), 6) AS win_rate, count(*) AS days FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2"""
    ),
)
def annual_ic(spark, sf):
    return rounded(diagnostics.annual_ic(long_ic(spark, sf), ("factor",)), ["mean_ic", "ic_std", "win_rate"])


HORIZONS = (1, 5, 10, 20)
DECAY_LABELS = ", ".join(f"lead(adj_close, {h}) OVER w / adj_close - 1 AS h{h}" for h in HORIZONS)


@query(
    "ic_decay",
    sig_sql(
        f""", dl AS (SELECT trade_date, symbol, reversal_5, {DECAY_LABELS} FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      dlong AS (SELECT trade_date, reversal_5, unnest([1, 5, 10, 20]) AS horizon, unnest([h1, h5, h10, h20]) AS fut FROM dl)"""
        + ic_sql("ic", "dlong", "horizon, trade_date", "reversal_5", "fut")
        + f""" SELECT horizon, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(win_rate, 6) AS win_rate, observations,
      round(mean_ic / ic_std * sqrt(252.0 / horizon), 6) AS icir FROM (SELECT horizon, {SUMMARY} FROM ic GROUP BY horizon)"""
    ),
)
def ic_decay(spark, sf):
    out = diagnostics.ic_decay(signals(spark, sf), "reversal_5", HORIZONS, "adj_close", layout=section_layout(spark, sf))
    return rounded(out, ["mean_ic", "ic_std", "win_rate", "icir"])


def quantile_sql(source: str, keys: str, value: str, future: str, groups: int = 5) -> str:
    return f""", q1 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value}, symbol) AS pos, count(*) OVER (PARTITION BY {keys}) AS n,
      min({value}) OVER (PARTITION BY {keys}) AS lo, max({value}) OVER (PARTITION BY {keys}) AS hi FROM {source} WHERE {value} IS NOT NULL),
    q2 AS (SELECT *, greatest(1, CAST(ceil((pos - 1) * {groups} / (n - 1)::DOUBLE) AS INTEGER)) AS quantile FROM q1 WHERE n >= {groups} AND lo < hi),
    q AS (SELECT {keys}, quantile, avg({future}) AS mean_return, count(*) AS assigned_count, count({future}) AS observed_count FROM q2 GROUP BY {keys}, quantile)"""


@query(
    "quantile_returns",
    sig_sql(
        quantile_sql("sig", "trade_date", "reversal_5", "forward_return_5d")
        + """ SELECT trade_date, quantile, round(mean_return, 6) AS mean_return, assigned_count, observed_count,
      round(observed_count / assigned_count, 6) AS label_coverage FROM q"""
    ),
)
def quantile_returns(spark, sf):
    out = diagnostics.quantile_returns(signals(spark, sf), "reversal_5", "forward_return_5d", layout=section_layout(spark, sf))
    return rounded(out, ["mean_return", "label_coverage"])


@query(
    "top_minus_bottom",
    with_weekly(
        SIGNALS + LONG + quantile_sql("long", "factor, trade_date", "value", "forward_return_5d")
        + """, m AS (SELECT factor, quantile, avg(mean_return) AS v FROM q GROUP BY 1, 2)
      SELECT factor, round(arg_max(v, quantile) - arg_min(v, quantile), 6) AS top_minus_bottom FROM m GROUP BY factor"""
    ),
)
def top_minus_bottom(spark, sf):
    long = diagnostics.melt_factors(signals(spark, sf), NAMES, ["trade_date", "symbol", "forward_return_5d"])
    groups = diagnostics.quantile_returns(
        long, "value", "forward_return_5d", by=("factor", "trade_date"), layout=section_layout(spark, sf)
    )
    return rounded(diagnostics.top_minus_bottom(groups, ("factor",)), ["top_minus_bottom"])


@query(
    "rank_autocorrelation",
    sig_sql(
        """, a1 AS (SELECT trade_date, symbol, CASE WHEN reversal_5 IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY reversal_5 NULLS LAST)
        + (count(reversal_5) OVER (PARTITION BY trade_date, reversal_5) - 1) / 2.0) / count(reversal_5) OVER (PARTITION BY trade_date) END AS rk FROM sig),
      a2 AS (SELECT *, lag(rk) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM a1)
      SELECT trade_date, round(CASE WHEN count(rk + before) >= 10 THEN corr(rk, before) END, 6) AS rank_autocorrelation FROM a2 GROUP BY trade_date"""
    ),
)
def rank_autocorrelation(spark, sf):
    out = diagnostics.rank_autocorrelation(signals(spark, sf), "reversal_5", layout=section_layout(spark, sf))
    return rounded(out, ["rank_autocorrelation"])


@query(
    "top_group_turnover",
    sig_sql(
        """, d AS (SELECT max(trade_date) AS trade_date FROM sig GROUP BY date_trunc('month', trade_date)),
      t1 AS (SELECT trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY reversal_5 DESC, symbol) AS pos,
        count(*) OVER (PARTITION BY trade_date) AS n FROM sig JOIN d USING (trade_date) WHERE reversal_5 IS NOT NULL),
      t2 AS (SELECT trade_date, symbol, dense_rank() OVER (ORDER BY trade_date) AS step FROM t1 WHERE pos <= greatest(1, ceil(n * 0.2))),
      sizes AS (SELECT step, count(*) AS n FROM t2 GROUP BY step)
      SELECT c.trade_date, round(1 - count(p.symbol) / max(s.n)::DOUBLE, 6) AS top_group_turnover FROM t2 c JOIN sizes s ON s.step = c.step - 1
        LEFT JOIN t2 p ON p.symbol = c.symbol AND p.step = c.step - 1 GROUP BY c.trade_date"""
    ),
)
def top_group_turnover(spark, sf):
    out = diagnostics.top_group_turnover(signals(spark, sf), "reversal_5", 0.2, "M", section_layout(spark, sf))
    return rounded(out, ["top_group_turnover"])


@query(
    "factor_stability",
    with_weekly(
        LONG_IC
        + """, y AS (SELECT factor, 'year_' || year(trade_date) AS "window", min(trade_date) AS start_date, max(trade_date) AS end_date,
        avg(ic) AS mean_ic, avg((ic > 0)::INT) AS win_rate, count(ic) AS observations FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2),
      s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS back FROM (SELECT DISTINCT trade_date FROM ic)),
      n AS (SELECT unnest([26, 52]) AS length),
      b AS (SELECT length, min(trade_date) AS start_date, max(trade_date) AS end_date FROM n JOIN s ON back <= length GROUP BY length),
      t AS (SELECT factor, 'recent_' || length || 'd' AS "window", any_value(b.start_date) AS start_date, any_value(b.end_date) AS end_date, avg(ic) AS mean_ic,
        avg((ic > 0)::INT) AS win_rate, count(ic) AS observations FROM ic JOIN b ON ic.trade_date BETWEEN b.start_date AND b.end_date GROUP BY factor, length)
      SELECT factor, "window", start_date, end_date, round(mean_ic, 6) AS mean_ic, round(win_rate, 6) AS win_rate, observations FROM (SELECT * FROM y UNION ALL SELECT * FROM t)"""
    ),
)
def factor_stability(spark, sf):
    return rounded(diagnostics.stability_table(long_ic(spark, sf), (26, 52)), ["mean_ic", "win_rate"])


HAC_L = 4
HAC_SUMS = ", ".join(
    f"sum(e * l{k}) * 2 * (1 - {k} / (least({HAC_L}, count(*) - 1) + 1.0)) AS w{k}" for k in range(1, HAC_L + 1)
)


@query(
    "hac_mean",
    with_weekly(
        LONG_IC
        + f""", h1 AS (SELECT *, avg(ic) OVER (PARTITION BY factor) AS m FROM ic),
      h2 AS (SELECT factor, trade_date, ic, m, coalesce(ic - m, 0) AS e FROM h1),
      h3 AS (SELECT *, {', '.join(f'lag(e, {k}) OVER (PARTITION BY factor ORDER BY trade_date) AS l{k}' for k in range(1, HAC_L + 1))} FROM h2),
      h4 AS (SELECT factor, count(ic) AS n, any_value(m) AS m, sum(e * e) AS w0, {HAC_SUMS} FROM h3 GROUP BY factor),
      h5 AS (SELECT *, sqrt(greatest(0, w0 + w1 + w2 + w3 + w4) / (n * (n - 1))) AS se FROM h4)
      SELECT factor, round(m, 6) AS hac_mean, round(se, 6) AS hac_se, round(m / se, 6) AS hac_t, round(m - 1.96 * se, 6) AS hac_ci_low,
        round(m + 1.96 * se, 6) AS hac_ci_high, 4::BIGINT AS hac_lags, n AS hac_observations FROM h5"""
    ),
)
def hac(spark, sf):
    out = diagnostics.hac_mean(long_ic(spark, sf), "ic", HAC_L, ("factor",))
    return rounded(out, ["hac_mean", "hac_se", "hac_t", "hac_ci_low", "hac_ci_high"])


@query(
    "factor_correlation",
    with_weekly(
        SIGNALS + LONG
        + """, pr AS (SELECT a.factor AS factor_a, b.factor AS factor_b, a.trade_date, a.value AS x, b.value AS y FROM long a JOIN long b
        ON a.trade_date = b.trade_date AND a.symbol = b.symbol WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"""
        + ic_sql("ic", "pr", "factor_a, factor_b, trade_date", "x", "y", 1)
        + " SELECT factor_a, factor_b, round(avg(ic), 6) AS correlation FROM ic GROUP BY 1, 2"
    ),
)
def factor_correlation(spark, sf):
    out = diagnostics.factor_correlation(signals(spark, sf), NAMES, section_layout(spark, sf))
    return rounded(out, ["correlation"])


@query(
    "coverage_gate",
    with_weekly(
        SIGNALS + LONG
        + """, u AS (SELECT long.*, market_cap IS NOT NULL AND NOT is_st AS in_universe FROM long JOIN (SELECT trade_date, symbol, is_st FROM weekly) USING (trade_date, symbol)),
      c AS (SELECT factor, trade_date, avg((value IS NOT NULL)::INT) FILTER (WHERE in_universe) AS coverage FROM u GROUP BY 1, 2)
      SELECT factor, trade_date, round(coverage, 6) AS coverage, coalesce(coverage >= 0.95, FALSE) AS meets_threshold,
        (SELECT count(value) FROM u WHERE u.factor = c.factor AND u.trade_date = c.trade_date AND NOT coalesce(c.coverage < 0.95, FALSE)) AS kept FROM c"""
    ),
)
def coverage_gate(spark, sf):
    keys = ("factor", "trade_date")
    long = diagnostics.melt_factors(signals(spark, sf), NAMES, ["trade_date", "symbol", "market_cap", "is_st"])
    long = long.withColumn("in_universe", F.col("market_cap").isNotNull() & ~F.col("is_st"))
    table = diagnostics.coverage_table(long, "value", 0.95, keys)
    gated = diagnostics.coverage_gate(long, "value", 0.95, keys, layout=section_layout(spark, sf))
    kept = gated.groupBy(*keys).agg(F.count("value").alias("kept"))
    return rounded(table, ["coverage"]).join(kept, list(keys))


@query(
    "feature_matrix",
    sig_sql(
        """ SELECT trade_date, symbol, round(reversal_5, 6) AS rev, round(momentum_20_5, 6) AS mom FROM sig
      WHERE reversal_5 IS NOT NULL OR momentum_20_5 IS NOT NULL"""
    ),
)
def matrix(spark, sf):
    s = signals(spark, sf)
    tables = {
        "rev": s.where("reversal_5 IS NOT NULL").select("trade_date", "symbol", F.col("reversal_5").alias("factor")),
        "mom": s.where("momentum_20_5 IS NOT NULL").select("trade_date", "symbol", F.col("momentum_20_5").alias("factor")),
    }
    return rounded(feature_matrix(tables), ["rev", "mom"])


EQUAL = """, e1 AS (SELECT *, (reversal_5 IS NOT NULL)::INT + (momentum_20_5 IS NOT NULL)::INT + (volatility_20 IS NOT NULL)::INT AS valid_factor_count,
      coalesce(reversal_5, 0) + coalesce(momentum_20_5, 0) + coalesce(volatility_20, 0) AS total, NOT is_st AS in_universe FROM sig),
    e2 AS (SELECT *, CASE WHEN valid_factor_count >= 2 THEN total / valid_factor_count END AS composite_raw FROM e1)"""


@query(
    "equal_weight_composite",
    sig_sql(
        EQUAL
        + f""", e3 AS (SELECT *, {z_sql('composite_raw', 'trade_date')} AS z FROM e2)
      SELECT trade_date, symbol, valid_factor_count, round(composite_raw, 6) AS composite_raw,
        round(CASE WHEN in_universe AND trade_date >= DATE '1996-01-01' THEN z END, 6) AS factor_processed FROM e3"""
    ),
)
def equal_composite(spark, sf):
    s = signals(spark, sf).withColumn("in_universe", ~F.col("is_st"))
    out = equal_weight_composite(s, NAMES[:3], 2, "1996-01-01", section_layout(spark, sf))
    return out.select("trade_date", "symbol", "valid_factor_count", r("composite_raw"), r("factor_processed"))


SIGNED = """, c1 AS (SELECT *, NOT is_st AS in_universe, (reversal_5 IS NOT NULL)::INT + (momentum_20_5 IS NOT NULL)::INT + (volatility_20 IS NOT NULL)::INT AS valid_factor_count,
      coalesce(reversal_5, 0) * 1.0 + coalesce(momentum_20_5, 0) * 0.5 + coalesce(volatility_20, 0) * -2.0 AS top,
      (reversal_5 IS NOT NULL)::INT * 1.0 + (momentum_20_5 IS NOT NULL)::INT * 0.5 + (volatility_20 IS NOT NULL)::INT * 2.0 AS bottom FROM sig),
    c2 AS (SELECT *, CASE WHEN in_universe AND valid_factor_count >= 2 THEN top / nullif(bottom, 0) END AS composite_raw FROM c1)""" + (
    f", composite AS (SELECT *, {z_sql('composite_raw', 'trade_date')} AS factor_processed FROM c2)"
)
WEIGHTS = {"reversal_5": 1.0, "momentum_20_5": 0.5, "volatility_20": -2.0}


def composite(spark, sf):
    s = signals(spark, sf).withColumn("in_universe", ~F.col("is_st"))
    return signed_weight_composite(s, WEIGHTS, 0.5, section_layout(spark, sf))


@query(
    "signed_weight_composite",
    sig_sql(SIGNED + " SELECT trade_date, symbol, valid_factor_count, round(composite_raw, 6) AS composite_raw, round(factor_processed, 6) AS factor_processed FROM composite"),
)
def signed_composite(spark, sf):
    return composite(spark, sf).select("trade_date", "symbol", "valid_factor_count", r("composite_raw"), r("factor_processed"))


@query(
    "latest_rank",
    sig_sql(
        SIGNED
        + """, l AS (SELECT * FROM composite WHERE trade_date = (SELECT max(trade_date) FROM composite))
      SELECT symbol, round(factor_processed, 6) AS factor_processed, CASE WHEN factor_processed IS NOT NULL THEN
        row_number() OVER (ORDER BY factor_processed DESC NULLS LAST, symbol) END AS factor_rank FROM l"""
    ),
)
def latest_rank(spark, sf):
    from lattica.operators.portfolio import descending_rank

    s = composite(spark, sf)
    last = s.agg(F.max("trade_date").alias("trade_date"))
    out = descending_rank(s.join(F.broadcast(last), "trade_date", "left_semi"), "factor_processed", section_layout(spark, sf))
    return out.select("symbol", r("factor_processed"), "factor_rank")


@query(
    "session_list",
    with_weekly("SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_idx FROM (SELECT DISTINCT trade_date FROM weekly)"),
)
def session_list(spark, sf):
    return calendars.session_list(weekly_panel(spark, sf))


@query(
    "trailing_sessions",
    with_weekly("SELECT DISTINCT trade_date FROM weekly ORDER BY 1 DESC LIMIT 60"),
)
def trailing(spark, sf):
    sessions = calendars.session_list(weekly_panel(spark, sf))
    return calendars.trailing_sessions(sessions, 60).select("trade_date")
