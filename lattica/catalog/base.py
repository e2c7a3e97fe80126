"""Query registry and the SQL view of the panels that ``plans.panel`` builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def symbol_sql(key: str) -> str:
    return (
        f"(CASE {key} % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '688' END"
        f" || repeat('0', greatest(0, 3 - length(CAST({key} AS VARCHAR)))) || CAST({key} AS VARCHAR)"
        f" || CASE WHEN {key} % 4 IN (1, 2) THEN '.SZ' ELSE '.SH' END)"
    )


def bars_sql(date: str, order: str, where: str = "TRUE") -> str:
    return f"""
    SELECT {date} AS trade_date, {symbol_sql('l_suppkey')} AS symbol,
      arg_min(l_extendedprice / l_quantity, {order}) AS open,
      max(l_extendedprice / l_quantity) AS high,
      min(l_extendedprice / l_quantity) AS low,
      arg_max(l_extendedprice / l_quantity, {order}) AS close,
      sum(l_quantity) AS volume, sum(l_extendedprice) AS amount,
      max(l_discount) >= 0.0999 AS is_st, min(l_quantity) <= 1 AS is_suspended,
      1 + max(l_tax) AS adj_factor
    FROM lineitem WHERE {where} GROUP BY {date}, l_suppkey"""


DAY = "CAST(l_shipdate AS DATE)"
WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"
DAY_ORDER = "(l_orderkey * 8 + l_linenumber)"
WEEK_ORDER = "((isodow(l_shipdate) - 1) * 1152921504606846976 + l_orderkey * 8 + l_linenumber)"

MASTER = f"""master AS (
    SELECT {symbol_sql('s_suppkey')} AS symbol, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS market_cap,
      'IND' || n_regionkey AS industry
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def _panel(name: str, bars: str) -> str:
    return f"""{name}_bars AS ({bars}), {name} AS (
    SELECT b.*, market_cap, industry, volume / 100 AS turnover_rate, open * adj_factor AS adj_open,
      close * adj_factor AS adj_close, amount * 0.8 AS book_value, amount * 0.05 AS net_profit_ttm,
      TRUE AS is_st_known, TRUE AS is_suspended_known, TRUE AS limit_status_known
    FROM {name}_bars b LEFT JOIN master USING (symbol))"""


DAILY = MASTER + ", " + _panel("daily", bars_sql(DAY, DAY_ORDER))
WEEKLY = MASTER + ", " + _panel("weekly", bars_sql(WEEK, WEEK_ORDER))
SNAPSHOTS = f"""month_totals AS (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {symbol_sql('l_suppkey')} AS symbol,
      sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, l_suppkey),
  snapshots AS (
    SELECT CAST(month + INTERVAL 1 MONTH AS DATE) AS trade_date, symbol, round(amount / 1000, 2) AS weight
    FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY amount DESC, symbol) AS pos,
            count(*) OVER (PARTITION BY month) AS n FROM month_totals) WHERE pos * 2 <= n)"""
EVENTS = f"""adj_events AS (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, {symbol_sql('l_suppkey')} AS symbol,
      1 + max(l_discount) AS adj_factor FROM lineitem GROUP BY 1, l_suppkey)"""
VENDOR_A = f"vendor_a AS (SELECT *, open AS preclose FROM ({bars_sql(DAY, DAY_ORDER, 'l_orderkey % 3 < 2')}))"
VENDOR_B = f"vendor_b AS (SELECT *, open AS preclose FROM ({bars_sql(DAY, DAY_ORDER, 'l_orderkey % 3 > 0')}))"


def with_daily(body: str) -> str:
    return f"WITH {DAILY} {body}"


def with_weekly(body: str) -> str:
    return f"WITH {WEEKLY} {body}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"
