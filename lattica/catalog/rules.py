"""Panel contract, row rules and trading-rule queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.catalog.base import DAY, DAY_ORDER, query, r6, symbol_sql, with_daily, with_weekly
from lattica.functions.dates import lenient_date
from lattica.functions.symbols import board_allowed, symbol_to_vendor, vendor_to_symbol
from lattica.functions.trading import (
    Costs,
    affordable_quantity,
    commission,
    data_issue,
    execution_price,
    round_order,
    stamp_rate,
)
from lattica.operators import adjust, calendars, quality
from lattica.operators.checks import duplicate_keys
from lattica.operators.composite import template_weights
from lattica.operators.factors import REGISTRY
from lattica.operators.portfolio import account_violations, weight_violations
from lattica.operators.universe import UniverseRule, apply_universe
from lattica.plans.folds import chronological_split, fold_dates, year_folds
from lattica.plans.panel import daily_panel, symbol_of, table, weekly_panel
from lattica.session import settle
from lattica.sources import vendors


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def cents(expression: str) -> str:
    """Half-up rounding to cents of the decimal value, as a double."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)"


BAR = ["open", "high", "low", "close", "volume", "amount"]
# a price is cents over a quantity, so nine digits never end on a tie
DIGITS = {c: 2 if c in ("volume", "amount") else 9 for c in BAR}
BAR_SQL = ", ".join(f"round({c}, {DIGITS[c]}) AS {c}" for c in BAR)


@query("panel_daily", with_daily(f"SELECT trade_date, symbol, {BAR_SQL}, is_st, is_suspended, round(adj_factor, 6) AS adj_factor, industry, round(market_cap, 6) AS market_cap FROM daily"))
def panel_daily(spark, sf):
    return daily_panel(spark, sf).select(
        "trade_date", "symbol", *[r(c, DIGITS[c]) for c in BAR], "is_st", "is_suspended", r("adj_factor"), "industry", r("market_cap")
    )


@query("panel_weekly", with_weekly(f"SELECT trade_date, symbol, {BAR_SQL}, is_st, is_suspended, round(adj_factor, 6) AS adj_factor FROM weekly"))
def panel_weekly(spark, sf):
    return weekly_panel(spark, sf).select("trade_date", "symbol", *[r(c, DIGITS[c]) for c in BAR], "is_st", "is_suspended", r("adj_factor"))


@query(
    "normalize_panel",
    with_daily(
        """SELECT trade_date, symbol, round(open, 9) AS open, CASE WHEN volume % 7 <> 0 THEN volume END AS volume,
      coalesce(CASE WHEN volume % 5 <> 0 THEN is_st END, FALSE) AS is_st, FALSE AS is_limit_up, FALSE AS is_st_known,
      1.0::DOUBLE AS adj_factor, 'UNKNOWN' AS industry FROM daily"""
    ),
)
def normalize_panel(spark, sf):
    bars = daily_panel(spark, sf)
    raw = bars.select(
        F.expr("cast(trade_date as timestamp) + interval 9 hours").alias("trade_date"),
        "symbol", "open", "high", "low", "close",
        F.when(F.col("volume") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string")).alias("volume"),
        "amount",
        F.when(F.col("volume") % 5 != 0, F.col("is_st")).alias("is_st"),
    )
    out = quality.normalize_panel(raw)
    return out.select("trade_date", "symbol", r("open", 9), "volume", "is_st", "is_limit_up", "is_st_known", "adj_factor", "industry")


@query(
    "validate_panel",
    with_daily(
        """, p AS (SELECT trade_date, symbol, open, high, low, CASE WHEN volume % 13 = 0 THEN high + 1 ELSE close END AS close,
        CASE WHEN volume % 17 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN volume % 19 <> 0 THEN amount END AS amount FROM daily)
      SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(trade_date) AS start_date, max(trade_date) AS end_date,
        round(avg((amount IS NULL)::INT) / 6, 6) AS missing_ratio,
        count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS nonpositive_prices,
        count(*) FILTER (WHERE high < greatest(open, close, low)) AS high_too_low,
        count(*) FILTER (WHERE low > least(open, close, high)) AS low_too_high,
        count(*) FILTER (WHERE volume < 0 OR amount < 0) AS negative_activity,
        0::BIGINT AS duplicate_keys FROM p"""
    ),
)
def validate_panel(spark, sf):
    bars = daily_panel(spark, sf)
    broken = bars.select(
        "trade_date", "symbol", "open", "high", "low",
        F.when(F.col("volume") % 13 == 0, F.col("high") + 1).otherwise(F.col("close")).alias("close"),
        F.when(F.col("volume") % 17 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.when(F.col("volume") % 19 != 0, F.col("amount")).alias("amount"),
    )
    return quality.validate_panel(broken).withColumn("missing_ratio", F.round("missing_ratio", 6))


GAPPY_SQL = """, g AS (SELECT trade_date, symbol, open, high, low, CASE WHEN volume % 7 <> 0 THEN close END AS close, volume,
    CASE WHEN volume % 11 <> 0 THEN amount END AS amount, is_suspended, adj_close,
    CASE WHEN volume % 13 <> 0 THEN adj_open END AS adj_open FROM daily)"""


def gappy(spark, sf):
    v = F.col("volume")
    return daily_panel(spark, sf).select(
        "trade_date", "symbol", "open", "high", "low",
        F.when(v % 7 != 0, F.col("close")).alias("close"), "volume",
        F.when(v % 11 != 0, F.col("amount")).alias("amount"), "is_suspended", "adj_close",
        F.when(v % 13 != 0, F.col("adj_open")).alias("adj_open"),
    )


@query(
    "missing_reason",
    with_daily(
        GAPPY_SQL
        + """, c AS (SELECT CASE WHEN is_suspended THEN 'SUSPENDED' WHEN close IS NULL OR amount IS NULL THEN 'PROVIDER_GAP'
        WHEN adj_open IS NULL OR adj_close IS NULL THEN 'ADJUSTMENT_GAP' ELSE 'OK' END AS missing_reason FROM g)
      SELECT missing_reason, missing_reason IN ('OK', 'SUSPENDED') AS is_usable_market_data, count(*) AS n FROM c GROUP BY 1, 2"""
    ),
)
def missing_reason(spark, sf):
    return quality.classify_missing(gappy(spark, sf)).groupBy("missing_reason", "is_usable_market_data").agg(F.count("*").alias("n"))


@query(
    "supplied_limit_flags",
    with_daily(
        """SELECT trade_date, symbol, volume % 3 <> 0 AND open >= high * (1 - 1e-6) AS is_limit_up,
      volume % 3 <> 0 AND open <= low * (1 + 1e-6) AS is_limit_down FROM daily"""
    ),
)
def supplied_limit_flags(spark, sf):
    bars = daily_panel(spark, sf).withColumns(
        {"up_limit": F.col("high"), "down_limit": F.col("low"), "limit_status_known": F.col("volume") % 3 != 0}
    )
    return quality.supplied_limit_flags(bars).select("trade_date", "symbol", "is_limit_up", "is_limit_down")


LIMIT_RATE_SQL = """CASE WHEN age < 5 AND (code LIKE '688%' OR (code LIKE '30%' AND trade_date >= DATE '2020-08-24')
      OR ((code LIKE '60%' OR code LIKE '00%') AND trade_date >= DATE '2023-04-10')) THEN NULL
    WHEN code LIKE '688%' OR (code LIKE '30%' AND trade_date >= DATE '2020-08-24') THEN 0.20
    WHEN is_st AND trade_date < DATE '2026-07-06' THEN 0.05 ELSE 0.10 END"""


@query(
    "limit_rule",
    with_daily(
        f""", a AS (SELECT CAST(trade_date + INTERVAL 22 YEAR AS DATE) AS trade_date, symbol, open, is_st,
        split_part(symbol, '.', 1) AS code, row_number() OVER w - 1 AS age,
        {cents('lag(close) OVER w * (0.9 + 0.01 * (volume % 20))')} AS preclose FROM daily
        WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      b AS (SELECT *, {LIMIT_RATE_SQL} AS rate FROM a),
      c AS (SELECT *, {cents('preclose * (1 + rate)')} AS up_limit, {cents('preclose * (1 - rate)')} AS down_limit FROM b)
      SELECT trade_date, symbol, up_limit, down_limit, rate IS NULL AS is_no_limit_session,
        coalesce(abs(open - up_limit) <= 0.0051, FALSE) AS is_limit_up,
        coalesce(abs(open - down_limit) <= 0.0051, FALSE) AS is_limit_down,
        preclose IS NOT NULL AS limit_status_known FROM c"""
    ),
)
def limit_rule(spark, sf):
    w = W.partitionBy("symbol").orderBy("trade_date")
    bars = daily_panel(spark, sf).select(
        F.add_months("trade_date", 22 * 12).alias("trade_date"), "symbol", "open", "is_st",
        (F.row_number().over(w) - 1).alias("listing_age_sessions"),
        F.round(F.lag("close").over(w) * (0.9 + 0.01 * (F.col("volume") % 20)), 2).alias("preclose"),
    )
    return adjust.limit_flags(bars).select(
        "trade_date", "symbol", "up_limit", "down_limit", "is_no_limit_session", "is_limit_up", "is_limit_down", "limit_status_known"
    )


@query(
    "limit_rule_adjusted",
    with_daily(
        f""", a AS (SELECT CAST(trade_date + INTERVAL 22 YEAR AS DATE) AS trade_date, symbol, open, is_st,
        split_part(symbol, '.', 1) AS code, 100 AS age, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS preclose FROM daily),
      b AS (SELECT *, {LIMIT_RATE_SQL} AS rate FROM a)
      SELECT trade_date, symbol, coalesce(abs(open / preclose - 1 - rate) <= 0.003, FALSE) AS is_limit_up,
        coalesce(abs(open / preclose - 1 + rate) <= 0.003, FALSE) AS is_limit_down FROM b"""
    ),
)
def limit_rule_adjusted(spark, sf):
    w = W.partitionBy("symbol").orderBy("trade_date")
    bars = daily_panel(spark, sf).select(
        F.add_months("trade_date", 22 * 12).alias("trade_date"), "symbol", "open", "is_st", F.lag("close").over(w).alias("preclose")
    )
    return adjust.limit_flags(bars, adjusted_prices=True).select("trade_date", "symbol", "is_limit_up", "is_limit_down")


@query(
    "universe_mask",
    with_daily(
        """SELECT trade_date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) >= 60
      AND NOT is_st AND NOT is_suspended AND amount >= 20000 AS in_universe FROM daily"""
    ),
)
def universe_mask(spark, sf):
    rule = UniverseRule(min_listed_days=60, min_amount=20000.0, require_known_status=True)
    return apply_universe(daily_panel(spark, sf), rule).select("trade_date", "symbol", "in_universe")


@query(
    "adjusted_open",
    with_daily("SELECT trade_date, symbol, round(close * adj_factor, 9) AS adj_close, round(open * adj_factor, 9) AS adj_open FROM daily"),
)
def adjusted_open(spark, sf):
    out = adjust.adjusted_open(daily_panel(spark, sf).drop("adj_close", "adj_open"))
    return out.select("trade_date", "symbol", r("adj_close", 9), r("adj_open", 9))


@query(
    "vendor_a_normalize",
    with_daily(
        """SELECT trade_date, symbol, open, CASE WHEN volume % 7 <> 0 THEN close END AS close, volume,
      volume % 5 <> 0 AS is_suspended_known, volume % 5 = 1 AS is_suspended, TRUE AS is_st_known, is_st FROM """
        + "(SELECT * REPLACE (" + cents('open') + " AS open, " + cents('close') + " AS close) FROM daily)"
    ),
)
def vendor_a_normalize(spark, sf):
    v = F.col("volume").cast("int")
    raw = daily_panel(spark, sf).select(
        F.col("trade_date").cast("string").alias("date"), symbol_to_vendor("symbol").alias("code"),
        F.round("open", 2).cast("string").alias("open"),
        F.when(v % 7 == 0, "").otherwise(F.round("close", 2).cast("string")).alias("close"),
        F.col("volume").cast("string").alias("volume"), F.lit("3").alias("adjustflag"),
        F.when(v % 5 == 1, "0").when(v % 5 == 0, "").otherwise("1").alias("tradestatus"),
        F.when(F.col("is_st"), "1").otherwise("0").alias("isST"),
    )
    out = vendors.normalize_vendor_a(raw)
    return out.select("trade_date", "symbol", "open", "close", "volume", "is_suspended_known", "is_suspended", "is_st_known", "is_st")


@query(
    "vendor_b_normalize",
    f"""WITH b AS (SELECT {DAY} AS trade_date, l_suppkey, arg_min(l_extendedprice, {DAY_ORDER}) AS open, sum(l_quantity) AS volume, sum(l_extendedprice) AS worth
      FROM lineitem GROUP BY 1, 2)
    SELECT trade_date, lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') || '.SH' AS symbol,
      round(open, 6) AS open, volume, round(worth, 2) AS market_value_raw, CAST(NULL AS DOUBLE) AS return_ex_cash FROM b""",
)
def vendor_b_normalize(spark, sf):
    lines = table(spark, sf, "lineitem")
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    raw = lines.groupBy(F.to_date("l_shipdate").cast("string").alias("trddt"), F.col("l_suppkey").alias("stkcd")).agg(
        F.min_by("l_extendedprice", order).alias("opnprc"), F.sum("l_quantity").cast("string").alias("dnshrtrd"),
        F.sum("l_extendedprice").alias("dsmvtll"),
    )
    text = F.col("s_suppkey").cast("string")
    code = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(text))), text)
    codes = table(spark, sf, "supplier").select(code.alias("code"), F.concat(code, F.lit(".SH")).alias("symbol"))
    return vendors.normalize_vendor_b(raw, codes).select(
        "trade_date", "symbol", r("open"), "volume", r("market_value_raw", 2), "return_ex_cash"
    )


@query(
    "vendor_c_normalize",
    with_daily(
        """, s AS (SELECT *, volume % 10 = 3 AS halted, volume % 20 = 3 AS absent FROM daily)
      SELECT trade_date, symbol, CASE WHEN NOT absent THEN round(open, 9) END AS open, CASE WHEN NOT absent THEN volume * 100 END AS volume,
        CASE WHEN NOT absent THEN round(amount * 1000, 6) END AS amount, CASE WHEN volume % 4 <> 0 THEN round(adj_factor, 6) END AS adj_factor,
        round(market_cap * 10000, 6) AS market_cap, coalesce(NOT absent AND open >= high * (1 - 1e-6), FALSE) AS is_limit_up,
        TRUE AS limit_status_known, halted AS is_suspended, TRUE AS is_suspended_known, FALSE AS is_st, FALSE AS is_st_known FROM s"""
    ),
)
def vendor_c_normalize(spark, sf):
    built = daily_panel(spark, sf).withColumnRenamed("symbol", "ts_code")
    # five tables come from it: the bars are built once
    bars = settle(built.select("trade_date", "ts_code", *BAR[:4], "volume", "amount", "adj_factor", "turnover_rate", "market_cap"))
    v = F.col("volume")
    daily = bars.where(v % 20 != 3).select("trade_date", "ts_code", *BAR[:4], v.alias("vol"), "amount")
    keys = ["trade_date", "ts_code"]
    out = vendors.normalize_vendor_c(
        daily,
        bars.where(v % 4 != 0).select(*keys, "adj_factor"),
        basics=bars.select(*keys, "turnover_rate", F.col("market_cap").alias("total_mv"), F.col("market_cap").alias("circ_mv")),
        limits=bars.select(*keys, F.col("high").alias("up_limit"), F.col("low").alias("down_limit")),
        suspended=bars.where(v % 10 == 3).select(*keys),
    )
    return out.select(
        "trade_date", "symbol", r("open", 9), "volume", r("amount"), r("adj_factor"), r("market_cap"), "is_limit_up",
        "limit_status_known", "is_suspended", "is_suspended_known", "is_st", "is_st_known",
    )


@query(
    "symbol_conversion",
    f"""WITH s AS (SELECT {symbol_sql('s_suppkey')} AS symbol FROM supplier)
    SELECT symbol, lower(split_part(symbol, '.', 2)) || '.' || split_part(symbol, '.', 1) AS vendor_code, symbol AS back,
      split_part(symbol, '.', 1) NOT LIKE '688%' AND split_part(symbol, '.', 1) NOT LIKE '689%' AS without_star,
      split_part(symbol, '.', 1) NOT LIKE '300%' AND split_part(symbol, '.', 1) NOT LIKE '301%' AS without_growth FROM s""",
)
def symbol_conversion(spark, sf):
    s = table(spark, sf, "supplier").select(symbol_of("s_suppkey").alias("symbol"))
    s = s.withColumn("vendor_code", symbol_to_vendor("symbol"))
    return s.select(
        "symbol", "vendor_code", vendor_to_symbol("vendor_code").alias("back"),
        board_allowed("symbol", star=False, growth=True).alias("without_star"),
        board_allowed("symbol", star=True, growth=False).alias("without_growth"),
    )


ISSUE_SQL = """CASE WHEN susp IS NULL THEN 'STATUS_UNKNOWN' WHEN NOT usable THEN 'DATA_UNUSABLE' WHEN NOT st_known THEN 'STATUS_UNKNOWN'
      WHEN coalesce(o <= 0, TRUE) THEN 'OPEN_INVALID' WHEN up > 0 AND o > up + 0.0051 THEN 'OPEN_ABOVE_LIMIT'
      WHEN down > 0 AND o < down - 0.0051 THEN 'OPEN_BELOW_LIMIT' END"""


@query(
    "executability",
    with_daily(
        f""", m AS (SELECT trade_date, symbol, CASE WHEN volume % 11 <> 0 THEN is_suspended END AS susp, volume % 13 <> 0 AS usable,
        volume % 17 <> 0 AS st_known, CASE WHEN volume % 19 <> 0 THEN open ELSE 0 END AS o,
        CASE WHEN volume % 5 = 0 THEN low ELSE high END AS up, CASE WHEN volume % 7 = 0 THEN high ELSE low END AS down FROM daily)
      SELECT trade_date, symbol, {ISSUE_SQL} AS reason,
        round(ln(greatest(least(o * 1.0005, up), down)), 9) AS log_buy_price, round(ln(greatest(least(o * 0.9995, up), down)), 9) AS log_sell_price FROM m"""
    ),
)
def executability(spark, sf):
    v = F.col("volume")
    m = daily_panel(spark, sf).select(
        "trade_date", "symbol",
        F.when(v % 11 != 0, F.col("is_suspended")).alias("is_suspended"), (v % 13 != 0).alias("is_usable_market_data"),
        (v % 17 != 0).alias("is_st_known"), F.when(v % 19 != 0, F.col("open")).otherwise(F.lit(0.0)).alias("open"),
        F.when(v % 5 == 0, F.col("low")).otherwise(F.col("high")).alias("up_limit"),
        F.when(v % 7 == 0, F.col("high")).otherwise(F.col("low")).alias("down_limit"),
    )
    price = lambda side: F.round(F.ln(execution_price(F.lit(side), "open", "up_limit", "down_limit", 0.0005)), 9)
    return m.select(
        "trade_date", "symbol", data_issue(m.columns).alias("reason"), price("BUY").alias("log_buy_price"), price("SELL").alias("log_sell_price")
    )


FEE_DATE = "CAST(l_shipdate + INTERVAL 24 YEAR AS DATE)"
LEVY_SQL = "(0.00001 * CASE WHEN d < DATE '2022-04-29' THEN 2 ELSE 1 END)"


def lot(q: str, code: str = "code") -> str:
    step = f"(CASE WHEN {code} LIKE '688%' OR {code} LIKE '689%' THEN 1 ELSE 100 END)"
    least = f"(CASE WHEN {code} LIKE '688%' OR {code} LIKE '689%' THEN 200 ELSE 100 END)"
    rounded = f"(floor(greatest({q}, 0) / {step}) * {step})"
    return f"(CASE WHEN {rounded} >= {least} THEN CAST({rounded} AS BIGINT) ELSE 0 END)"


@query(
    "fees_and_lots",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {FEE_DATE} AS d, {symbol_sql('l_suppkey')} AS symbol, split_part({symbol_sql('l_suppkey')}, '.', 1) AS code,
        l_extendedprice AS gross, l_quantity * 13 AS want, l_quantity * 9 AS holding FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, symbol, round(greatest(5.0, gross * 0.0003) + gross * {LEVY_SQL}, 8) AS fee,
      CASE WHEN d < DATE '2023-08-28' THEN 0.001::DOUBLE ELSE 0.0005::DOUBLE END AS stamp_rate, {lot('want')} AS lots,
      CASE WHEN want >= holding THEN CAST(holding AS BIGINT) ELSE {lot('want')} END AS exit_lots FROM t""",
)
def fees_and_lots(spark, sf):
    costs = Costs()
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.add_months(F.to_date("l_shipdate"), 288).alias("d"), symbol_of("l_suppkey").alias("symbol"),
        F.col("l_extendedprice").alias("gross"), (F.col("l_quantity") * 13).alias("want"), (F.col("l_quantity") * 9).alias("holding"),
    )
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "symbol", F.round(commission("gross", "d", costs), 8).alias("fee"),
        stamp_rate("d", costs).alias("stamp_rate"), round_order("want", "symbol").alias("lots"),
        round_order("want", "symbol", holding="holding").alias("exit_lots"),
    )


def fee(q: str) -> str:
    return f"(greatest(5.0, {q} * price * 0.0003) + {q} * price * {LEVY_SQL})"


@query(
    "affordable_quantity",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {FEE_DATE} AS d, split_part({symbol_sql('l_suppkey')}, '.', 1) AS code,
        {cents('l_extendedprice / l_quantity / 10')} AS price, l_quantity * 40 AS want, {cents('l_extendedprice * 3')} AS cash FROM lineitem),
      f AS (SELECT *, {lot(f'least(want, least(cash / (price * (1.0003 + {LEVY_SQL})), (cash - 5) / (price * (1 + {LEVY_SQL}))))')} AS q FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN cash <= 5 OR price <= 0 THEN 0
      WHEN q > 0 AND q * price + {fee('q')} > cash + 1e-9 THEN {lot("q - (CASE WHEN code LIKE '688%' THEN 1 ELSE 100 END)")} ELSE q END AS quantity FROM f""",
)
def affordable(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.add_months(F.to_date("l_shipdate"), 288).alias("d"), symbol_of("l_suppkey").alias("symbol"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") / 10, 2).alias("price"),
        (F.col("l_quantity") * 40).alias("want"), F.round(F.col("l_extendedprice") * 3, 2).alias("cash"),
    )
    quantity = affordable_quantity("want", "price", "cash", "symbol", "d", Costs())
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", quantity.alias("quantity"))


@query(
    "chronological_split",
    with_daily(
        """SELECT part, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date FROM (
      SELECT trade_date, CASE WHEN trade_date <= DATE '1998-12-31' - 10 THEN 'train'
        WHEN trade_date > DATE '1998-12-31' + 10 AND trade_date <= DATE '2000-06-30' - 10 THEN 'validation'
        WHEN trade_date > DATE '2000-06-30' + 10 THEN 'test' END AS part FROM daily) WHERE part IS NOT NULL GROUP BY part"""
    ),
)
def split(spark, sf):
    out = chronological_split(daily_panel(spark, sf), "1998-12-31", "2000-06-30", 10)
    return out.groupBy("part").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query(
    "drop_last_dates",
    with_daily(
        """, d AS (SELECT DISTINCT trade_date FROM daily ORDER BY 1 DESC LIMIT 7)
      SELECT symbol, count(*) AS n, max(trade_date) AS last_date FROM daily WHERE trade_date NOT IN (SELECT trade_date FROM d) GROUP BY symbol"""
    ),
)
def drop_last(spark, sf):
    out = calendars.drop_last_dates(daily_panel(spark, sf), 7)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_date").alias("last_date"))


FOLD_SQL = """, s AS (SELECT DISTINCT trade_date FROM weekly),
  heads AS (SELECT unnest(range((SELECT min(year(trade_date)) FROM s) + 3, (SELECT max(year(trade_date)) FROM s) + 1)) AS test_year),
  spans AS (SELECT test_year, 'train' AS part, test_year - 3 AS lo, test_year - 2 AS hi FROM heads
    UNION ALL SELECT test_year, 'validation', test_year - 1, test_year - 1 FROM heads
    UNION ALL SELECT test_year, 'test', test_year, test_year FROM heads),
  dated AS (SELECT test_year, part, trade_date, row_number() OVER (PARTITION BY test_year, part ORDER BY trade_date DESC) AS back
    FROM spans JOIN s ON year(trade_date) BETWEEN lo AND hi),
  folds AS (SELECT test_year, part, trade_date FROM dated WHERE part = 'test' OR back > 3)"""


@query("fold_dates", with_weekly(FOLD_SQL + " SELECT test_year, part, trade_date FROM folds"))
def folds(spark, sf):
    sessions = calendars.session_list(weekly_panel(spark, sf))
    return fold_dates(sessions, year_folds(sessions, 2, 1, 1), 3)


@query(
    "amount_outside_range",
    with_daily(
        """, t AS (SELECT trade_date, symbol, low, high, volume, CASE WHEN volume % 9 = 0 THEN amount * 1.4 WHEN volume % 10 = 0 THEN amount * 0.5 ELSE amount END AS amount FROM daily)
      SELECT trade_date, symbol, amount / volume < low - 0.011 OR amount / volume > high + 0.011 AS outside FROM t"""
    ),
)
def outside_range(spark, sf):
    v = F.col("volume")
    t = daily_panel(spark, sf).withColumn(
        "amount", F.when(v % 9 == 0, F.col("amount") * 1.4).when(v % 10 == 0, F.col("amount") * 0.5).otherwise(F.col("amount"))
    )
    return t.select("trade_date", "symbol", quality.amount_outside_range().alias("outside"))


@query(
    "lenient_dates",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {DAY} AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 5 <> 4 THEN d END AS parsed FROM t""",
)
def lenient_dates(spark, sf):
    d = F.to_date("l_shipdate")
    k = F.col("l_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, d.cast("string"))
        .when(k == 2, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0"))).when(k == 3, F.concat(F.lit(" "), F.date_format(d, "yyyy/MM/dd")))
        .otherwise("unknown")
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lenient_date(text).alias("parsed"))


@query(
    "corporate_events",
    f"""WITH e AS (SELECT l_orderkey, lpad(CAST(l_suppkey * 7 AS VARCHAR), 6, '0') AS code,
        CASE WHEN l_linenumber = 1 THEN 'CA' WHEN l_linenumber = 2 THEN 'SD' ELSE 'XX' END AS kind, {DAY} AS ex_date,
        CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_shipdate AS DATE) - CAST(l_orderkey % 7 AS INTEGER) + 1 END AS announced,
        CASE WHEN l_orderkey % 8 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(l_orderkey % 5 AS INTEGER) - 1 END AS paid,
        l_discount - 0.01 AS amount FROM lineitem),
      f AS (SELECT *, code || CASE WHEN code LIKE '6%' THEN '.SH' ELSE '.SZ' END AS symbol FROM e),
      g AS (SELECT *, count(*) OVER (PARTITION BY symbol, ex_date, kind) AS n FROM f)
    SELECT symbol, kind, ex_date, announced AS announcement_date, paid AS payment_date, round(amount, 6) AS amount_per_share,
      concat_ws(';', CASE WHEN NOT regexp_full_match(code, '[036][0-9]{{5}}') THEN 'unsupported_symbol' END,
        CASE WHEN kind NOT IN ('CA', 'SD') THEN 'unsupported_kind' END,
        CASE WHEN announced IS NULL THEN 'unknown_announcement' END, CASE WHEN announced > ex_date THEN 'announcement_after_ex_date' END,
        CASE WHEN paid IS NULL THEN 'unknown_payment_date' END, CASE WHEN paid < ex_date THEN 'payment_before_ex_date' END,
        CASE WHEN amount < 0 THEN 'invalid_amount' END, CASE WHEN n > 1 THEN 'duplicate_event' END) AS issues FROM g""",
)
def corporate_events(spark, sf):
    d = F.to_date("l_shipdate")
    raw = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 7).alias("stkcd"),
        F.when(F.col("l_linenumber") == 1, " ca").when(F.col("l_linenumber") == 2, "SD").otherwise("xx").alias("disttyp"),
        F.date_format(d, "yyyyMMdd").alias("exdistdt"),
        F.when(F.col("l_orderkey") % 9 != 0, F.date_add(d, (1 - F.col("l_orderkey") % 7).cast("int"))).cast("string").alias("annodt"),
        F.when(F.col("l_orderkey") % 8 != 0, F.date_add(d, (F.col("l_orderkey") % 5 - 1).cast("int"))).cast("string").alias("paydt"),
        (F.col("l_discount") - 0.01).cast("string").alias("amount"),
        F.lit("").alias("roprc"),
    )
    out = vendors.normalize_events(raw)
    return out.select("symbol", "kind", "ex_date", "announcement_date", "payment_date", r("amount_per_share"), "issues")


@query(
    "latest_eligible",
    with_weekly(
        """SELECT symbol, row_number() OVER (ORDER BY symbol) AS n FROM weekly WHERE trade_date = (SELECT max(trade_date) FROM weekly)
      AND NOT is_st AND NOT is_suspended AND amount >= 50000"""
    ),
)
def latest_eligible(spark, sf):
    from lattica.plans.studies import latest_cross_section

    panel = weekly_panel(spark, sf).withColumns({"in_index": F.lit(True), "listing_age_sessions": F.lit(500)})
    out = latest_cross_section(panel, min_listed_days=120, min_amount=50000.0).where("in_universe")
    return out.select("symbol", F.row_number().over(W.partitionBy("trade_date").orderBy("symbol")).alias("n"))


@query(
    "weight_violations",
    with_weekly(
        """, w AS (SELECT trade_date, symbol, CASE WHEN volume = 50 THEN -0.1 ELSE 1.2 / count(*) OVER (PARTITION BY trade_date) * (0.5 + (volume % 10) / 10) END AS w FROM weekly)
      SELECT trade_date, round(sum(w), 6) AS total_weight, count(*) FILTER (WHERE w < 0) AS negative FROM w GROUP BY trade_date
      HAVING sum(w) > 1 + 1e-9 OR count(*) FILTER (WHERE w < 0) > 0"""
    ),
)
def bad_weights(spark, sf):
    n = F.count("*").over(W.partitionBy("trade_date"))
    w = F.when(F.col("volume") == 50, F.lit(-0.1)).otherwise(F.lit(1.2) / n * (0.5 + (F.col("volume") % 10) / 10))
    weights = weekly_panel(spark, sf).select("trade_date", "symbol", w.alias("target_weight"))
    return weight_violations(weights).select("trade_date", r("total_weight"), "negative")


@query(
    "account_violations",
    """WITH h AS (SELECT o_custkey AS account_id, l_suppkey, sum(l_quantity) - 40 + max(l_discount) * (l_suppkey % 2) AS shares
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey)
    SELECT c_custkey AS account_id, 'CASH_INVALID' AS problem FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT account_id, 'SHARES_INVALID' FROM h WHERE shares < 0 OR shares <> floor(shares) GROUP BY account_id""",
)
def bad_accounts(spark, sf):
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("cash"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    holdings = lines.groupBy(F.col("o_custkey").alias("account_id"), F.col("l_suppkey").alias("symbol")).agg(
        (F.sum("l_quantity") - 40 + F.max("l_discount") * (F.first("l_suppkey") % 2)).alias("shares")
    )
    return account_violations(accounts, holdings)


FACTOR_NAMES = sorted(REGISTRY)
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in FACTOR_NAMES) + "]"


@query(
    "factor_categories",
    f"""WITH n AS (SELECT DISTINCT ({NAMES_SQL})[CAST(p_partkey % {len(FACTOR_NAMES)} AS INTEGER) + 1] || '_' || p_size AS factor FROM part),
      c AS (SELECT factor, CASE WHEN factor LIKE 'momentum%' THEN 'momentum' WHEN factor LIKE 'reversal%' THEN 'reversal'
        WHEN factor LIKE 'volatility%' OR factor LIKE 'ivol%' OR factor LIKE 'downside%' THEN 'volatility'
        WHEN factor LIKE 'overnight_reversal%' THEN 'reversal' WHEN factor LIKE 'intraday_momentum%' THEN 'momentum'
        WHEN factor LIKE 'amihud%' OR factor LIKE 'turnover%' THEN 'liquidity'
        WHEN factor LIKE 'book%' OR factor LIKE 'earnings%' THEN 'fundamental' ELSE 'volume_price' END AS category FROM n)
    SELECT factor, category, round(1.0 / count(*) OVER (PARTITION BY category), 9) AS weight FROM c""",
)
def factor_categories(spark, sf):
    names = F.array(*[F.lit(n) for n in FACTOR_NAMES])
    pick = names[(F.col("p_partkey") % len(FACTOR_NAMES)).cast("int")]
    factors = table(spark, sf, "part").select(F.concat(pick, F.lit("_"), F.col("p_size")).alias("factor")).distinct()
    return template_weights(factors).withColumn("weight", F.round("weight", 9))


def _windows(monthly: bool) -> str:
    unit = "month" if monthly else "year"
    return f"""WITH q AS (SELECT l_suppkey, min({DAY}) AS s, max({DAY}) AS e FROM lineitem GROUP BY l_suppkey),
      h AS (SELECT l_suppkey, s, e, unnest(generate_series(date_trunc('{unit}', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 {unit}))::DATE AS head FROM q)
    SELECT l_suppkey, greatest(head, s) AS window_start, least(CAST(head + INTERVAL 1 {unit} AS DATE) - 1, e) AS window_end FROM h"""


def _window_query(monthly: bool):
    def run(spark, sf):
        d = F.to_date("l_shipdate")
        requests = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min(d).alias("start_date"), F.max(d).alias("end_date"))
        return calendars.partition_windows(requests, monthly).select("l_suppkey", "window_start", "window_end")

    return run


query("partition_windows_monthly", _windows(True))(_window_query(True))
query("partition_windows_yearly", _windows(False))(_window_query(False))


@query(
    "extract_violations",
    f"""WITH x AS (SELECT year(l_shipdate) AS partition, l_suppkey AS code, {DAY} AS d FROM lineitem),
      keyed AS (SELECT partition, code, d, count(*) AS n FROM x GROUP BY ALL),
      dup AS (SELECT partition, sum(n - 1) AS duplicate_rows FROM keyed GROUP BY partition)
    SELECT x.partition, count(*) AS rows, x.partition = 1995 AS unrequested_partition, count(*) FILTER (WHERE code % 10 = 3) AS unrequested_codes,
      count(*) FILTER (WHERE month(d) = 12 OR x.partition = 1995) AS dates_outside, CAST(max(duplicate_rows) AS BIGINT) AS duplicate_rows,
      count(*) > 9000 AS over_limit, FALSE AS accepted FROM x JOIN dup USING (partition) GROUP BY x.partition
    UNION ALL SELECT 2050, 0, FALSE, 0, 0, 0, FALSE, TRUE""",
)
def extract_check(spark, sf):
    """No window asks for 1995; one asks for a year without rows."""
    lines = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("partition"), F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d")
    )
    codes = table(spark, sf, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("code"))
    years = lines.select("partition").distinct().where("partition <> 1995").unionByName(spark.range(1).select(F.lit(2050).alias("partition")))
    windows = years.select(
        "partition", F.make_date("partition", F.lit(1), F.lit(1)).alias("start_date"),
        F.make_date("partition", F.lit(11), F.lit(30)).alias("end_date"),
    )
    return vendors.extract_violations(lines, ["code", "d"], "code", "d", windows, codes, 9000)


@query(
    "duplicate_keys",
    f"SELECT {DAY} AS trade_date, l_suppkey AS symbol, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"), F.col("l_suppkey").alias("symbol"))
    return duplicate_keys(lines, ["trade_date", "symbol"])


@query(
    "finite_boundary",
    r6("x", "x").join(["WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity % 5 > 1 THEN l_extendedprice END AS x FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, ", " FROM t"]),
)
def finite_boundary(spark, sf):
    from lattica.functions.numeric import finite

    q = F.col("l_quantity") % 5
    x = F.when(q == 0, F.lit(float("nan"))).when(q == 1, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(finite(x), 6).alias("x"))


