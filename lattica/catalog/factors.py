"""Factor queries F1-F20 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.base import query, with_daily
from lattica.operators.calendars import session_list
from lattica.operators.factors import compute_factors
from lattica.plans.panel import PLAIN, daily_panel, derived
from lattica.plans.rolling import run_sessions
from lattica.session import scratch_path, settle

RETURNS = """, r AS (SELECT *, CASE WHEN lag(adj_close) OVER w <> 0 THEN adj_close / lag(adj_close) OVER w END - 1 AS ret,
    ln(amount) - lag(ln(amount)) OVER w AS dlog,
    -(adj_open / lag(adj_close) OVER w - 1) AS gap
    FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))"""


def mom(lookback: int, skip: int) -> str:
    return f"lag(adj_close, {skip}) OVER w / lag(adj_close, {lookback}) OVER w - 1"


def frame(rows: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def mean(x: str, rows: int, minimum: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(rows)} >= {minimum} THEN avg({x}) OVER {frame(rows)} END"


def std(x: str, rows: int, minimum: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(rows)} >= {minimum} THEN stddev_samp({x}) OVER {frame(rows)} END"


FORMULAS = {
    "momentum_20_5": mom(20, 5),
    "momentum_60_5": mom(60, 5),
    "momentum_120_20": mom(120, 20),
    "reversal_5": f"-({mom(5, 0)})",
    "reversal_20": f"-({mom(20, 0)})",
    "amihud_20": mean("abs(ret) / nullif(amount, 0)", 20, 15),
    "volatility_20": std("ret", 20, 15),
    "volatility_60": std("ret", 60, 40),
    "downside_volatility_20": f"sqrt({mean('CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END', 20, 15)})",
    "overnight_reversal_5": mean("gap", 5, 5),
    "intraday_momentum_20": mean("close / open - 1", 20, 15),
    "turnover_mean_20": mean("turnover_rate", 20, 15),
    "amount_momentum_20": f"({mean('amount', 5, 4)}) / ({mean('amount', 20, 15)}) - 1",
    "price_volume_corr_20": (
        f"CASE WHEN count(ret + dlog) OVER {frame(20)} >= 15 THEN corr(ret, dlog) OVER {frame(20)} END"
    ),
    "book_to_price": "book_value / nullif(market_cap, 0)",
    "earnings_yield": "net_profit_ttm / nullif(market_cap, 0)",
    "range_position_20": mean("CASE WHEN high > low THEN (close - low) / (high - low) END", 20, 20),
    "my_momentum_20": mom(20, 0),
}
# amihud values are of order 1e-6, so they are compared at a finer scale
SCALE = {"amihud_20": 1e6}


def _register(name: str, formula: str) -> None:
    scale = SCALE.get(name, 1.0)
    sql = with_daily(
        RETURNS
        + f" SELECT trade_date, symbol, round(({formula}) * {scale}, 6) AS factor FROM r"
        + " WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"
    )

    @query(f"factor_{name}", sql)
    def run(spark, sf_dir):
        out = compute_factors(daily_panel(spark, sf_dir), [name])
        return out.select("trade_date", "symbol", F.round(F.col(name) * scale, 6).alias("factor"))


for _name, _formula in FORMULAS.items():
    _register(_name, _formula)


IVOL = f""", m AS (SELECT *, avg(ret) OVER (PARTITION BY trade_date) AS mkt FROM r),
    b AS (SELECT *, CASE WHEN count(ret) OVER {frame(60)} >= 40 THEN
        covar_samp(ret, mkt) OVER {frame(60)} END / nullif(CASE WHEN count(mkt) OVER {frame(60)} >= 40 THEN
        var_samp(mkt) OVER {frame(60)} END, 0) AS beta FROM m),
    e AS (SELECT *, ret - beta * mkt AS res FROM b)"""
IVOL_SQL = with_daily(RETURNS + IVOL + f" SELECT trade_date, symbol, round({std('res', 60, 40)}, 6) AS factor FROM e")


@query("factor_ivol_60", IVOL_SQL)
def ivol(spark, sf_dir):
    out = compute_factors(daily_panel(spark, sf_dir), ["ivol_60"])
    return out.select("trade_date", "symbol", F.round("ivol_60", 6).alias("factor"))


EVERY = {**FORMULAS, "ivol_60": std("res", 60, 40)}


@query(
    "rolling_state",
    with_daily(
        RETURNS
        + IVOL
        + ", v AS (SELECT trade_date, symbol, "
        + ", ".join(f"round(({formula}) * {SCALE.get(name, 1.0)}, 6) AS {name}" for name, formula in EVERY.items())
        + " FROM e WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS back FROM (SELECT DISTINCT trade_date FROM daily))"
        + " SELECT v.* FROM v JOIN s USING (trade_date) WHERE back <= 12"
    ),
)
def rolling_state(spark, sf_dir):
    """All factors of the last twelve sessions, seven and then five of them added to a stored state."""
    panel = settle(daily_panel(spark, sf_dir).select(*PLAIN)).withColumns(derived())
    sessions = settle(session_list(panel))
    total = sessions.agg(F.max("session_idx").alias("_total"))
    dated = panel.join(F.broadcast(sessions.join(total, F.lit(True))), "trade_date").withColumn("_left", F.col("_total") - F.col("session_idx"))
    path = scratch_path(spark, "state")
    run_sessions(spark, path, dated.where("_left >= 12"), EVERY)
    parts = [run_sessions(spark, path, dated.where(days), EVERY) for days in ("_left BETWEEN 5 AND 11", "_left < 5")]
    return parts[0].unionByName(parts[1]).select("trade_date", "symbol", *[F.round(F.col(n) * SCALE.get(n, 1.0), 6).alias(n) for n in EVERY])
