"""Source merge, membership, adjustment, gap and audit queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog.base import (
    EVENTS,
    SNAPSHOTS,
    VENDOR_A,
    VENDOR_B,
    query,
    symbol_sql,
    with_daily,
    with_weekly,
)
from lattica.catalog.rules import BAR, cents
from lattica.functions.symbols import SYMBOL_PATTERN
from lattica.operators import adjust, calendars, freshness, merging, quality, universe
from lattica.plans.panel import (
    adjustment_events,
    daily_bars,
    daily_panel,
    monthly_snapshots,
    symbol_of,
    table,
    vendor_bars,
    weekly_panel,
)
from lattica.session import settle
from lattica.plans.studies import build_dataset, build_small_dataset, consolidate_panel


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


FIELDS = ["open", "high", "low", "close", "preclose", "volume", "amount"]
# a price is cents over a quantity, so nine digits never end on a tie
DIGITS = {c: 2 if c in ("volume", "amount") else 9 for c in FIELDS}
MERGED = f"""{VENDOR_A}, {VENDOR_B}, merged AS (SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, coalesce(a.symbol, b.symbol) AS symbol,
    {', '.join(f'a.{c} AS {c}_a, b.{c} AS {c}_b, coalesce(a.{c}, b.{c}) AS {c}' for c in FIELDS)},
    CASE WHEN a.close IS NOT NULL THEN 'A' WHEN b.close IS NOT NULL THEN 'B' ELSE 'missing' END AS close_source,
    CASE WHEN a.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 'both' WHEN a.symbol IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS source_presence,
    coalesce(b.is_st, FALSE) AS is_st, coalesce(b.is_suspended, FALSE) AS is_suspended, b.symbol IS NOT NULL AS known,
    b.volume / 100 AS turnover_rate, a.amount * 2 AS market_value_raw, coalesce(a.volume, b.amount) AS both_have
    FROM vendor_a a FULL JOIN vendor_b b ON a.trade_date = b.trade_date AND a.symbol = b.symbol)"""


def merged(spark, sf, check=False):
    known = {"is_st_known": F.lit(True), "is_suspended_known": F.lit(True)}
    b = vendor_bars(spark, sf, "B").withColumns({**known, "turnover_rate": F.col("volume") / 100, "both_have": F.col("amount")})
    a = vendor_bars(spark, sf, "A").withColumns({"market_value_raw": F.col("amount") * 2, "both_have": F.col("volume")})
    return merging.merge_sources(a, b, check=check)


@query(
    "merge_sources",
    f"""WITH {MERGED} SELECT trade_date, symbol, {', '.join(f'round({c}, {DIGITS[c]}) AS {c}' for c in FIELDS)}, close_source, source_presence,
      round(turnover_rate, 6) AS turnover_rate, round(market_value_raw, 2) AS market_value_raw, round(both_have, 2) AS both_have,
      is_st, CASE WHEN known THEN 'B' ELSE 'unknown' END AS status_source, FALSE AS limit_status_known FROM merged""",
)
def merge_sources(spark, sf):
    return merged(spark, sf, check=True).select(
        "trade_date", "symbol", *[r(c, DIGITS[c]) for c in FIELDS], "close_source", "source_presence", "is_st", "status_source", "limit_status_known",
        r("turnover_rate"), r("market_value_raw", 2), r("both_have", 2),
    )


def _compare_sql() -> str:
    rows = []
    for c in FIELDS:
        tolerance = 1.0 if c in ("volume", "amount") else 0.011
        gap = f"abs({c}_a - {c}_b)"
        rows.append(
            f"SELECT '{c}' AS field, count({gap}) AS overlap, count(*) FILTER (WHERE {gap} > {tolerance}) AS different,"
            f" count(*) FILTER (WHERE {gap} > {tolerance} AND {gap} > abs({c}_a) * 1e-6) AS different_over_ppm,"
            f" round(max({gap}), 6) AS max_abs_difference FROM merged"
        )
    return f"WITH {MERGED} " + " UNION ALL ".join(rows)


@query("compare_sources", _compare_sql())
def compare_sources(spark, sf):
    return rounded(merging.compare_sources(merged(spark, sf)), ["max_abs_difference"])


@query(
    "staging_counters",
    f"""WITH {MERGED} SELECT year(trade_date) AS year, count(*) AS rows, count(*) FILTER (WHERE close_source = 'A') AS close_from_a,
      count(*) FILTER (WHERE close_source = 'B') AS close_from_b,
      count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR open <= 0) AS invalid_rows,
      0::BIGINT AS suspended_without_prices,
      count(*) FILTER (WHERE amount / volume < low - 0.011 OR amount / volume > high + 0.011) AS amount_outside_range FROM merged GROUP BY 1""",
)
def staging_counters(spark, sf):
    return merging.staging_counters(merged(spark, sf))


@query(
    "index_membership",
    with_daily(
        f""", {SNAPSHOTS}, eff AS (SELECT d.trade_date, max(s.trade_date) AS snap FROM (SELECT DISTINCT trade_date FROM daily) d
        LEFT JOIN (SELECT DISTINCT trade_date FROM snapshots) s ON s.trade_date <= d.trade_date GROUP BY 1)
      SELECT d.trade_date, d.symbol, s.symbol IS NOT NULL AS in_index, coalesce(s.weight, 0) AS index_weight
      FROM daily d JOIN eff USING (trade_date) LEFT JOIN snapshots s ON s.trade_date = eff.snap AND s.symbol = d.symbol"""
    ),
)
def index_membership(spark, sf):
    out = universe.attach_membership(daily_panel(spark, sf), monthly_snapshots(spark, sf))
    return out.select("trade_date", "symbol", "in_index", "index_weight")


LABELS = {"I1": "hs300", "I2": "zz500"}


def indexed_snapshots(spark, sf):
    """Two indices over the monthly constituents; I1 skips February, even boards only."""
    s = monthly_snapshots(spark, sf)
    one = s.where((F.month("trade_date") != 2) & F.col("symbol").startswith("6")).withColumn("index_code", F.lit("I1"))
    two = s.where(~F.col("symbol").startswith("6")).withColumn("index_code", F.lit("I2"))
    return one.unionByName(two).withColumn("snapshot_complete", F.month("trade_date") % 5 != 0)


INDEXED = """idx AS (SELECT *, 'I1' AS index_code FROM snapshots WHERE month(trade_date) <> 2 AND symbol LIKE '6%'
    UNION ALL SELECT *, 'I2' FROM snapshots WHERE symbol NOT LIKE '6%'),
  ieff AS (SELECT d.trade_date, c.index_code, max(s.trade_date) AS snap FROM (SELECT DISTINCT trade_date FROM daily) d
    CROSS JOIN (SELECT DISTINCT index_code FROM idx) c LEFT JOIN (SELECT DISTINCT index_code, trade_date FROM idx) s
      ON s.index_code = c.index_code AND s.trade_date <= d.trade_date GROUP BY 1, 2)"""


@query(
    "shared_memberships",
    with_daily(
        f""", {SNAPSHOTS}, {INDEXED}
      SELECT d.trade_date, d.symbol, a.symbol IS NOT NULL AS in_hs300, b.symbol IS NOT NULL AS in_zz500,
        a.symbol IS NOT NULL OR b.symbol IS NOT NULL AS in_csi800, e1.snap AS hs300_membership_date,
        coalesce(month(e1.snap) % 5 <> 0, FALSE) AS hs300_membership_complete
      FROM daily d JOIN ieff e1 ON e1.trade_date = d.trade_date AND e1.index_code = 'I1'
        JOIN ieff e2 ON e2.trade_date = d.trade_date AND e2.index_code = 'I2'
        LEFT JOIN idx a ON a.index_code = 'I1' AND a.trade_date = e1.snap AND a.symbol = d.symbol
        LEFT JOIN idx b ON b.index_code = 'I2' AND b.trade_date = e2.snap AND b.symbol = d.symbol"""
    ),
)
def shared_memberships(spark, sf):
    out = universe.attach_shared_memberships(
        daily_panel(spark, sf), indexed_snapshots(spark, sf), LABELS, "in_csi800", allow_partial=True
    )
    return out.select("trade_date", "symbol", "in_hs300", "in_zz500", "in_csi800", "hs300_membership_date", "hs300_membership_complete")


@query(
    "membership_backfilled",
    with_daily(
        f""", {SNAPSHOTS}, late AS (SELECT * FROM snapshots WHERE trade_date >= DATE '1996-01-01'),
      eff AS (SELECT d.trade_date, max(s.trade_date) AS snap FROM (SELECT DISTINCT trade_date FROM daily) d
        LEFT JOIN (SELECT DISTINCT trade_date FROM late) s ON s.trade_date <= d.trade_date GROUP BY 1)
      SELECT d.trade_date, d.symbol, s.symbol IS NOT NULL AS in_index,
        CASE WHEN eff.snap IS NULL THEN 'earliest_snapshot_backfill' ELSE 'point_in_time_snapshot' END AS membership_quality
      FROM daily d JOIN eff USING (trade_date) LEFT JOIN late s
        ON s.trade_date = coalesce(eff.snap, (SELECT min(trade_date) FROM late)) AND s.symbol = d.symbol"""
    ),
)
def membership_backfilled(spark, sf):
    late = monthly_snapshots(spark, sf).where("trade_date >= '1996-01-01'")
    out = universe.attach_membership_backfilled(daily_panel(spark, sf), late)
    return out.select("trade_date", "symbol", "in_index", "membership_quality")


@query(
    "asof_factor",
    with_daily(
        f""", {EVENTS}
      SELECT d.trade_date, d.symbol, round(coalesce(e.adj_factor, 1.0), 6) AS adj_factor
      FROM daily d ASOF LEFT JOIN adj_events e ON d.symbol = e.symbol AND d.trade_date >= e.trade_date"""
    ),
)
def asof_factor(spark, sf):
    out = adjust.asof_factors(daily_panel(spark, sf).select("trade_date", "symbol", "close"), adjustment_events(spark, sf))
    return out.select("trade_date", "symbol", r("adj_factor"))


@query(
    "raw_with_adjusted",
    f"""WITH {VENDOR_A}, {VENDOR_B} SELECT a.trade_date, a.symbol, round(b.close * 1.1, 9) AS adj_close, round(b.close * 1.1 / a.close, 6) AS adj_factor
      FROM vendor_a a JOIN vendor_b b ON a.trade_date = b.trade_date AND a.symbol = b.symbol""",
)
def raw_with_adjusted(spark, sf):
    adjusted = vendor_bars(spark, sf, "B").withColumn("close", F.col("close") * 1.1)
    out = merging.raw_with_adjusted(vendor_bars(spark, sf, "A"), adjusted)
    return out.select("trade_date", "symbol", r("adj_close", 9), r("adj_factor"))


@query(
    "next_session",
    with_daily(
        """, s AS (SELECT DISTINCT trade_date FROM daily), q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS signal_date FROM orders)
      SELECT q.signal_date, min(s.trade_date) AS exec_date FROM q LEFT JOIN s ON s.trade_date > q.signal_date GROUP BY 1"""
    ),
)
def next_session(spark, sf):
    signals = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date"))
    return calendars.next_session(signals, calendars.session_list(daily_panel(spark, sf)))


def listing(spark, sf):
    """Listing and delisting dates: first and last bar moved by a few days."""
    spans = daily_bars(table(spark, sf, "lineitem")).groupBy("symbol").agg(
        F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"), F.count("*").alias("n")
    )
    return spans.select(
        "symbol",
        F.when(F.col("n") % 4 != 0, F.date_sub("lo", 2)).alias("list_date"),
        F.when(F.col("n") % 3 != 0, F.date_add("hi", 3)).alias("delist_date"),
    )


LISTING = """listing AS (SELECT symbol, CASE WHEN count(*) % 4 <> 0 THEN min(trade_date) - 2 END AS list_date,
    CASE WHEN count(*) % 3 <> 0 THEN max(trade_date) + 3 END AS delist_date FROM daily GROUP BY symbol),
  ses AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM daily)),
  gone AS (SELECT l.symbol, s.trade_date, s.idx FROM listing l JOIN ses s ON s.trade_date >= greatest(DATE '1996-01-01', coalesce(list_date, DATE '1996-01-01'))
      AND s.trade_date <= least(DATE '2001-06-30', coalesce(delist_date - 1, DATE '2001-06-30'))
    ANTI JOIN daily d ON d.symbol = l.symbol AND d.trade_date = s.trade_date)"""


def islands(spark, sf, collapse=None):
    bars = daily_bars(table(spark, sf, "lineitem"))
    sessions = calendars.session_list(bars)
    expected = merging.listed_ranges(sessions, listing(spark, sf), "1996-01-01", "2001-06-30")
    return merging.gap_islands(expected, bars, sessions, collapse), sessions


@query(
    "missing_sessions",
    with_daily(
        f""", {LISTING} SELECT symbol, year(trade_date) AS year, count(*) AS missing_sessions, min(trade_date) AS first_missing,
      max(trade_date) AS last_missing FROM gone GROUP BY 1, 2"""
    ),
)
def missing_sessions(spark, sf):
    return merging.missing_by_year(*islands(spark, sf))


RUNS = """, runs AS (SELECT symbol, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS missing_sessions FROM (
    SELECT *, idx - row_number() OVER (PARTITION BY symbol ORDER BY idx) AS island FROM gone) GROUP BY symbol, island)"""


@query("gap_islands", with_daily(f", {LISTING}{RUNS} SELECT symbol, start_date, end_date, missing_sessions FROM runs"))
def gap_islands(spark, sf):
    return islands(spark, sf)[0].select("symbol", "start_date", "end_date", "missing_sessions")


@query(
    "gap_islands_collapsed",
    with_daily(
        f""", {LISTING}{RUNS}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM runs)
      SELECT symbol, start_date, end_date, missing_sessions, CASE WHEN n > 140 THEN min(start_date) OVER (PARTITION BY symbol) ELSE start_date END AS request_start,
        CASE WHEN n > 140 THEN max(end_date) OVER (PARTITION BY symbol) ELSE end_date END AS request_end FROM c"""
    ),
)
def gap_islands_collapsed(spark, sf):
    return islands(spark, sf, 140)[0].select("symbol", "start_date", "end_date", "missing_sessions", "request_start", "request_end")


@query(
    "request_ranges",
    f"""WITH {VENDOR_A}, span AS (SELECT symbol, min(trade_date) AS lo, max(trade_date) AS hi FROM vendor_a GROUP BY symbol),
      s AS (SELECT {symbol_sql('c_custkey')} AS symbol FROM customer), j AS (SELECT * FROM s LEFT JOIN span USING (symbol))
    SELECT symbol, DATE '1995-01-01' AS start_date, DATE '2001-12-31' AS end_date FROM j WHERE lo IS NULL
    UNION ALL SELECT symbol, DATE '1995-01-01', lo - 1 FROM j WHERE lo > DATE '1995-01-01'
    UNION ALL SELECT symbol, hi + 1, DATE '2001-12-31' FROM j WHERE hi < DATE '2001-12-31'""",
)
def request_ranges(spark, sf):
    symbols = table(spark, sf, "customer").select(symbol_of("c_custkey").alias("symbol"))  # most were never fetched
    return merging.request_ranges(vendor_bars(spark, sf, "A"), symbols, "1995-01-01", "2001-12-31")


@query(
    "replace_slices",
    f"""WITH {SNAPSHOTS}, fresh AS (SELECT trade_date, symbol, weight + 1 AS weight FROM snapshots WHERE year(trade_date) = 1999 AND symbol LIKE '6%')
    SELECT trade_date, symbol, weight FROM snapshots ANTI JOIN (SELECT DISTINCT trade_date FROM fresh) f USING (trade_date)
    UNION ALL SELECT * FROM fresh""",
)
def replace_slices(spark, sf):
    old = monthly_snapshots(spark, sf)
    new = old.where((F.year("trade_date") == 1999) & F.col("symbol").startswith("6")).withColumn("weight", F.col("weight") + 1)
    return universe.replace_slices(old, new.unionByName(new), ["trade_date"], ["trade_date", "symbol"])


@query(
    "reconcile_events",
    with_weekly(
        """, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM weekly)),
      m AS (SELECT symbol, trade_date, CASE WHEN idx - lag(idx) OVER w = 1 THEN lag(close) OVER w END AS previous_close,
        lag(close) OVER w * (1 - (volume % 5) / 100) AS preclose FROM weekly JOIN s USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      ev AS (SELECT symbol, trade_date AS ex_date, unnest(CASE WHEN volume % 3 = 0 THEN ['CA', 'SD'] ELSE ['CA'] END) AS kind, volume, volume % 4 <> 0 AS supported FROM weekly),
      p AS (SELECT symbol, ex_date, count(*) AS event_count, bool_and(supported) AS ok, coalesce(sum(CASE WHEN kind = 'CA' THEN volume / 100 END), 0) AS cash,
        coalesce(sum(CASE WHEN kind = 'SD' THEN (volume % 7) / 100 END), 0) AS bonus FROM ev GROUP BY 1, 2),
      j AS (SELECT p.*, previous_close, preclose, CASE WHEN ok AND previous_close > 0 AND preclose > 0 AND cash < previous_close THEN (previous_close - cash) / (1 + bonus) END AS expected
        FROM p LEFT JOIN m ON m.symbol = p.symbol AND m.trade_date = p.ex_date)
      SELECT symbol, ex_date, event_count, round(cash, 6) AS cash_per_share, round(expected + 1.3e-8, 6) AS expected_preclose,
        CASE WHEN expected IS NULL THEN 'NOT_COMPARABLE' WHEN abs(expected - preclose) <= 0.0151 THEN 'MATCH_WITHIN_TICK_TOLERANCE' ELSE 'REVIEW_DIFFERENCE' END AS status FROM j"""
    ),
)
def reconcile_events(spark, sf):
    weekly = weekly_panel(spark, sf)
    w = W.partitionBy("symbol").orderBy("trade_date")
    v = F.col("volume")
    prices = weekly.withColumn("preclose", F.lag("close").over(w) * (1 - (v % 5) / 100))
    kinds = F.when(v % 3 == 0, F.array(F.lit("CA"), F.lit("SD"))).otherwise(F.array(F.lit("CA")))
    events = weekly.select(
        "symbol", F.col("trade_date").alias("ex_date"), F.explode(kinds).alias("kind"), "volume", (v % 4 != 0).alias("supported")
    ).withColumn("amount_per_share", F.when(F.col("kind") == "CA", v / 100).otherwise((v % 7) / 100))
    out = merging.reconcile_events(events, prices, calendars.session_list(weekly))
    return out.select("symbol", "ex_date", "event_count", r("cash_per_share"), F.round(F.col("expected_preclose") + 1.3e-8, 6).alias("expected_preclose"), "status")


@query(
    "reference_price_changes",
    with_weekly(
        """, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM weekly)),
      m AS (SELECT symbol, trade_date, idx - lag(idx) OVER w AS step, lag(close) OVER w AS previous_close,
        lag(close) OVER w * (1 - (volume % 5) / 100) AS preclose FROM weekly JOIN s USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
      SELECT trade_date, symbol, round(previous_close, 9) AS previous_close, round(preclose, 9) AS preclose FROM m
      WHERE step = 1 AND preclose > 0 AND abs(previous_close - preclose) > 0.0051"""
    ),
)
def reference_price_changes(spark, sf):
    weekly = weekly_panel(spark, sf)
    w = W.partitionBy("symbol").orderBy("trade_date")
    bars = weekly.withColumn("preclose", F.lag("close").over(w) * (1 - (F.col("volume") % 5) / 100))
    out = merging.reference_price_changes(bars, calendars.session_list(weekly))
    return out.select("trade_date", "symbol", r("previous_close", 9), r("preclose", 9))


@query(
    "priority_dedupe",
    f"""WITH {VENDOR_A}, {VENDOR_B}, u AS (SELECT trade_date, symbol, close, volume, 1 AS priority FROM vendor_a
      UNION ALL SELECT trade_date, symbol, close, volume, 4 FROM vendor_b UNION ALL SELECT trade_date, symbol, close + 1, volume, 5 FROM vendor_a WHERE volume % 5 = 0)
    SELECT trade_date, symbol, round(close, 9) AS close, priority FROM u QUALIFY row_number() OVER (PARTITION BY trade_date, symbol ORDER BY priority DESC) = 1""",
)
def priority_dedupe(spark, sf):
    a, b = (vendor_bars(spark, sf, v).select("trade_date", "symbol", "close", "volume") for v in "AB")
    again = a.where(F.col("volume") % 5 == 0).withColumn("close", F.col("close") + 1)
    out = merging.by_priority(merging.union_sources([(1, a), (4, b.drop("volume")), (5, again)]))
    return out.select("trade_date", "symbol", r("close", 9), "priority")


@query(
    "fill_suspensions",
    with_daily(
        """, g AS (SELECT trade_date, symbol, CASE WHEN NOT is_suspended THEN open END AS open, CASE WHEN NOT is_suspended THEN close END AS close,
        CASE WHEN NOT is_suspended THEN adj_close END AS adj_close, is_suspended, volume, CASE WHEN volume % 3 = 0 THEN industry END AS industry FROM daily),
      f AS (SELECT *, last_value(close IGNORE NULLS) OVER w AS prev, last_value(adj_close IGNORE NULLS) OVER w AS aprev, last_value(industry IGNORE NULLS) OVER w AS ind
        FROM g WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT trade_date, symbol, round(CASE WHEN is_suspended THEN prev ELSE open END, 9) AS open, round(CASE WHEN is_suspended THEN prev ELSE close END, 9) AS close,
        round(CASE WHEN is_suspended THEN aprev ELSE adj_close END, 9) AS adj_close, CASE WHEN is_suspended THEN 0 ELSE volume END AS volume, ind AS industry,
        is_suspended AS was_suspension_filled FROM f"""
    ),
)
def fill_suspensions(spark, sf):
    on = ~F.col("is_suspended")
    bars = daily_panel(spark, sf)
    holes = bars.withColumns({c: F.when(on, F.col(c)) for c in ("open", "high", "low", "close", "adj_close")})
    holes = holes.withColumn("industry", F.when(F.col("volume") % 3 == 0, F.col("industry")))
    out = adjust.fill_suspensions(holes)
    return out.select("trade_date", "symbol", r("open", 9), r("close", 9), r("adj_close", 9), "volume", "industry", "was_suspension_filled")


@query(
    "normalized_to_latest",
    with_daily(
        """SELECT trade_date, symbol, round(close * (adj_factor / last_value(adj_factor) OVER (PARTITION BY symbol ORDER BY trade_date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 9) AS close, TRUE AS price_is_adjusted FROM daily"""
    ),
)
def normalized_to_latest(spark, sf):
    out = adjust.normalized_to_latest(daily_panel(spark, sf).drop("adj_close", "adj_open"))
    return out.select("trade_date", "symbol", r("close", 9), "price_is_adjusted")


@query(
    "inferred_listing",
    with_daily(
        """, named AS (SELECT trade_date, CASE WHEN symbol LIKE '6%' AND trade_date < DATE '1996-03-01' THEN 'OLD' || symbol ELSE symbol END AS symbol FROM daily),
      f AS (SELECT trade_date, symbol, min(trade_date) OVER (PARTITION BY symbol) AS first, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS age FROM named)
      SELECT trade_date, symbol, CASE WHEN late THEN age ELSE 999999 END AS listing_age_sessions, CASE WHEN late THEN first END AS list_date,
        CASE WHEN late THEN 'first_observed_in_full_history' ELSE 'precedes_history_or_unknown' END AS list_date_quality
      FROM (SELECT *, first > (SELECT min(trade_date) FROM f) + 30 AS late FROM f)"""
    ),
)
def inferred_listing(spark, sf):
    early = F.col("symbol").startswith("6") & (F.col("trade_date") < "1996-03-01")
    bars = daily_panel(spark, sf).withColumn("symbol", F.when(early, F.concat(F.lit("OLD"), "symbol")).otherwise(F.col("symbol")))
    return adjust.inferred_listing(bars).select("trade_date", "symbol", "listing_age_sessions", "list_date", "list_date_quality")


@query(
    "listing_age",
    with_daily(
        """, ses AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM daily)),
      l AS (SELECT symbol, CASE WHEN count(*) % 4 <> 0 THEN min(trade_date) + CAST(count(*) % 7 AS INTEGER) - 3 END AS list_date FROM daily GROUP BY symbol),
      k AS (SELECT l.*, (SELECT min(idx) FROM ses WHERE ses.trade_date >= l.list_date) AS first_idx FROM l)
      SELECT d.trade_date, d.symbol, CASE WHEN list_date IS NULL THEN -1 WHEN list_date < (SELECT min(trade_date) FROM ses) THEN 999999
        ELSE ses.idx - first_idx END AS listing_age_sessions FROM daily d JOIN ses USING (trade_date) JOIN k ON k.symbol = d.symbol"""
    ),
)
def listing_age(spark, sf):
    bars = daily_panel(spark, sf).select("trade_date", "symbol")
    sessions = calendars.session_list(bars)
    spans = bars.groupBy("symbol").agg(F.min("trade_date").alias("lo"), F.count("*").alias("n"))
    basics = spans.select(
        "symbol", F.when(F.col("n") % 4 != 0, F.date_add("lo", (F.col("n") % 7 - 3).cast("int"))).alias("list_date")
    )
    dated = calendars.session_gap(sessions, bars)
    return adjust.with_listing_age(dated, sessions, basics).select("trade_date", "symbol", "listing_age_sessions")


CHAIN_SQL = f""", ses AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM weekly)),
  raw AS (SELECT trade_date, symbol, idx, is_st, is_suspended, volume, amount, CASE WHEN NOT is_suspended THEN open END AS open, CASE WHEN NOT is_suspended THEN high END AS high,
    CASE WHEN NOT is_suspended THEN low END AS low, CASE WHEN NOT is_suspended THEN close END AS close,
    {cents("lag(close) OVER w * (1 - (volume % 3) / 100)")} AS preclose
    FROM weekly JOIN ses USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  marked AS (SELECT *, last_value(coalesce(close, CASE WHEN is_suspended AND preclose > 0 THEN preclose END) IGNORE NULLS)
    OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM raw),
  filled AS (SELECT * REPLACE (CASE WHEN is_suspended THEN mark ELSE open END AS open, CASE WHEN is_suspended THEN mark ELSE high END AS high,
    CASE WHEN is_suspended THEN mark ELSE low END AS low, CASE WHEN is_suspended THEN mark ELSE close END AS close,
    CASE WHEN is_suspended AND preclose IS NULL THEN mark ELSE preclose END AS preclose) FROM marked),
  linked AS (SELECT *, lag(close) OVER w / preclose AS mult, idx - lag(idx) OVER w AS step FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  broke AS (SELECT *, NOT coalesce(step = 1 AND mult > 0, FALSE) AS broken FROM linked),
  seg AS (SELECT *, CAST(sum(broken::INT) OVER (PARTITION BY symbol ORDER BY trade_date) AS BIGINT) AS research_segment FROM broke),
  chain AS (SELECT *, exp(sum(ln(CASE WHEN broken THEN 1.0 ELSE mult END)) OVER (PARTITION BY symbol, research_segment ORDER BY trade_date)) AS chain_factor FROM seg)"""


def chain_inputs(spark, sf):
    weekly = weekly_panel(spark, sf)
    w = W.partitionBy("symbol").orderBy("trade_date")
    on = ~F.col("is_suspended")
    raw = weekly.select(
        "trade_date", "symbol", *[F.when(on, F.col(c)).alias(c) for c in BAR[:4]],
        F.round(F.lag("close").over(w) * (1 - (F.col("volume") % 3) / 100), 2).alias("preclose"),
        "volume", "amount", "is_st", "is_suspended", "is_st_known", "is_suspended_known",
    )
    basics = weekly.select("symbol").distinct().withColumn("list_date", F.lit("1990-01-01").cast("date"))
    return raw, calendars.session_list(weekly), basics


@query(
    "price_chain",
    with_weekly(
        CHAIN_SQL
        + f""", lim AS (SELECT *, CASE WHEN symbol LIKE '688%' THEN 0.20 WHEN is_st THEN 0.05 ELSE 0.10 END AS rate FROM chain),
      lim2 AS (SELECT *, {cents('preclose * (1 + rate)')} AS up_limit, {cents('preclose * (1 - rate)')} AS down_limit FROM lim),
      lim3 AS (SELECT *, coalesce(preclose > 0 AND high <= up_limit + 0.011 AND low >= down_limit - 0.011, FALSE) AS known FROM lim2)
      SELECT trade_date, symbol, research_segment, round(close, 9) AS close, round(preclose, 9) AS preclose, round(chain_factor, 6) AS adj_factor,
        round(ln(close * chain_factor), 6) AS log_adj_close, up_limit, down_limit, known AS limit_status_known,
        known AND coalesce(abs(open - up_limit) <= 0.0051, FALSE) AS is_limit_up, is_suspended AS was_suspension_filled FROM lim3"""
    ),
)
def price_chain(spark, sf):
    out = adjust.price_chain(*chain_inputs(spark, sf))
    return out.select(
        "trade_date", "symbol", "research_segment", r("close", 9), r("preclose", 9), r("adj_factor"), F.round(F.ln("adj_close"), 6).alias("log_adj_close"), "up_limit", "down_limit",
        "limit_status_known", "is_limit_up", "was_suspension_filled",
    )


# --- audits ---------------------------------------------------------------------------


def audited(spark, sf):
    v = F.col("volume")
    bars = daily_panel(spark, sf)
    broken = bars.withColumns(
        {
            "close": F.when(v % 13 == 0, F.col("high") + 1).when(v % 31 != 0, F.col("close")),
            "volume": F.when(v % 17 == 0, -v).otherwise(v),
            "is_st_known": v % 29 != 0,
            "market_cap": F.when(v % 5 != 0, F.col("market_cap")),
            "in_index": v % 2 == 0,
        }
    ).drop("adj_close", "adj_open").where("trade_date <> DATE '2000-02-02'")
    return settle(broken)  # the audit reads it several times


AUDITED = """, au AS (SELECT * REPLACE (CASE WHEN volume % 13 = 0 THEN high + 1 WHEN volume % 31 <> 0 THEN close END AS close,
      CASE WHEN volume % 17 = 0 THEN -volume ELSE volume END AS volume, volume % 29 <> 0 AS is_st_known,
      CASE WHEN volume % 5 <> 0 THEN market_cap END AS market_cap), volume % 2 = 0 AS in_index FROM daily WHERE trade_date <> DATE '2000-02-02'),
    ses AS (SELECT DISTINCT trade_date FROM daily),
    car AS (SELECT *, last_value(close * adj_factor IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM au),
    jump AS (SELECT count(*) AS n FROM (SELECT c / lag(c) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS x FROM car) WHERE abs(x) > 0.25),
    win AS (SELECT trade_date FROM ses ORDER BY 1 DESC LIMIT 60),
    last_members AS (SELECT symbol FROM au WHERE trade_date = (SELECT max(trade_date) FROM au) AND in_index),
    gaps AS (SELECT count(*) AS n FROM last_members m JOIN (SELECT symbol, min(trade_date) AS first FROM au GROUP BY 1) f USING (symbol) JOIN win w ON w.trade_date >= f.first
      ANTI JOIN au ON au.symbol = m.symbol AND au.trade_date = w.trade_date),
    members AS (SELECT trade_date, count(*) FILTER (WHERE in_index) AS n FROM au GROUP BY 1),
    issues AS (SELECT 'ERROR' AS severity, 'INVALID_OHLC' AS code, count(*) AS count FROM au WHERE coalesce(open <= 0, FALSE) OR coalesce(close <= 0, FALSE) OR coalesce(high < greatest(open, close, low), FALSE) OR coalesce(low > least(open, close, high), FALSE)
      UNION ALL SELECT 'ERROR', 'NEGATIVE_ACTIVITY', count(*) FROM au WHERE volume < 0 OR amount < 0
      UNION ALL SELECT 'ERROR', 'MISSING_ACTIVE_MARKET_DATA', count(*) FROM au WHERE NOT is_suspended AND close IS NULL
      UNION ALL SELECT 'WARNING', 'LARGE_ADJUSTED_JUMPS', n FROM jump
      UNION ALL SELECT 'WARNING', 'IMPORTANT_MISSING', CAST(avg((market_cap IS NULL)::INT) > 0.01 AS BIGINT) FROM au
      UNION ALL SELECT 'ERROR', 'LOW_IS_ST_KNOWN', CASE WHEN avg(is_st_known::INT) < 0.99 THEN CAST(floor((1 - avg(is_st_known::INT)) * count(*)) AS BIGINT) ELSE 0 END FROM au
      UNION ALL SELECT 'ERROR', 'INDEX_MEMBERSHIP_EMPTY', CASE WHEN coalesce(median(n) FILTER (WHERE n > 0), 0) < 10 THEN count(*) FILTER (WHERE n = 0) ELSE 0 END FROM members
      UNION ALL SELECT 'ERROR', 'MISSING_TRADE_DATES', count(*) FROM ses ANTI JOIN au USING (trade_date)
      UNION ALL SELECT 'ERROR', 'RECENT_SYMBOL_DATE_GAPS', n FROM gaps
      UNION ALL SELECT 'ERROR', 'INCOMPLETE_LATEST_CROSS_SECTION', greatest(0, 90 - count(DISTINCT symbol)) FROM last_members)"""


@query("audit_panel", with_daily(AUDITED + " SELECT severity, code, count FROM issues WHERE count > 0"))
def audit_panel(spark, sf):
    sessions = calendars.session_list(daily_panel(spark, sf))
    return quality.audit_panel(audited(spark, sf), sessions, expected_latest_symbols=90)


@query(
    "audit_summary",
    with_daily(
        AUDITED
        + """ SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(trade_date) AS start_date, max(trade_date) AS end_date,
      count(DISTINCT trade_date) AS trade_dates, (SELECT count(DISTINCT symbol) FROM last_members) AS latest_symbols FROM au"""
    ),
)
def audit_summary(spark, sf):
    return quality.audit_summary(audited(spark, sf))


@query(
    "daily_coverage",
    with_daily(
        """SELECT trade_date, count(DISTINCT symbol) AS symbols, round(avg((volume % 7 = 0)::INT), 6) AS amount_missing,
      count(*) FILTER (WHERE is_suspended) AS suspended FROM daily GROUP BY trade_date"""
    ),
)
def daily_coverage(spark, sf):
    bars = daily_panel(spark, sf).withColumn("amount", F.when(F.col("volume") % 7 != 0, F.col("amount")))
    return rounded(quality.daily_coverage(bars), ["amount_missing"])


@query(
    "null_ratios",
    with_daily(
        AUDITED
        + """ SELECT unnest(['trade_date', 'close', 'market_cap', 'industry']) AS "column", unnest([round(avg((trade_date IS NULL)::INT), 6),
      round(avg((close IS NULL)::INT), 6), round(avg((market_cap IS NULL)::INT), 6), round(avg((industry IS NULL)::INT), 6)]) AS ratio FROM au"""
    ),
)
def null_ratios(spark, sf):
    out = quality.null_ratios(audited(spark, sf).select("trade_date", "close", "market_cap", "industry"))
    return rounded(out, ["ratio"])


@query(
    "acceptance",
    with_daily(
        """, p AS (SELECT *, volume % 2 = 0 AS member, month(trade_date) % 5 <> 0 AS complete, volume % 7 <> 0 AS known FROM daily)
      SELECT count(*) AS rows, count(*) FILTER (WHERE member AND NOT known) AS unknown_limit_member_rows,
        count(DISTINCT trade_date) FILTER (WHERE NOT complete) AS incomplete_sessions, (SELECT count(*) FROM (SELECT DISTINCT trade_date, symbol FROM p)) AS distinct_keys,
        count(*) FILTER (WHERE trade_date = (SELECT max(trade_date) FROM p)) AS latest_rows,
        count(*) FILTER (WHERE trade_date = (SELECT max(trade_date) FROM p) AND member) AS latest_members, count(*) AS source_rows, TRUE AS accepted FROM p"""
    ),
)
def acceptance(spark, sf):
    bars = daily_panel(spark, sf).withColumns(
        {
            "in_index": F.col("volume") % 2 == 0,
            "membership_complete": F.month("trade_date") % 5 != 0,
            "limit_status_known": F.col("volume") % 7 != 0,
        }
    )
    return quality.acceptance(bars, daily_bars(table(spark, sf, "lineitem")).agg(F.count("*").alias("source_rows")))


@query(
    "window_completeness",
    with_weekly(
        """, ses AS (SELECT DISTINCT trade_date FROM weekly WHERE trade_date <= DATE '2001-06-25' ORDER BY 1 DESC LIMIT 52),
      req AS (SELECT symbol, CASE WHEN count(*) % 2 = 0 THEN DATE '2001-01-01' END AS list_date FROM weekly GROUP BY symbol),
      e AS (SELECT r.symbol, s.trade_date FROM req r JOIN ses s ON list_date IS NULL OR s.trade_date >= list_date),
      m AS (SELECT e.symbol, e.trade_date, w.symbol IS NOT NULL AS seen, volume % 41 = 0 AS broken, volume % 3 <> 0 AS known FROM e LEFT JOIN weekly w ON w.symbol = e.symbol AND w.trade_date = e.trade_date),
      a AS (SELECT symbol, count(*) FILTER (WHERE NOT seen) AS missing_sessions, count(*) FILTER (WHERE seen AND broken) AS invalid_rows,
        count(*) FILTER (WHERE seen AND trade_date = DATE '2001-06-25') = 0 AS missing_latest,
        count(*) FILTER (WHERE seen AND trade_date = DATE '2001-06-25' AND NOT known) > 0 AS unknown_status FROM m GROUP BY symbol)
      SELECT *, missing_sessions = 0 AND invalid_rows = 0 AND NOT missing_latest AND NOT unknown_status AS complete FROM a"""
    ),
)
def window_completeness(spark, sf):
    weekly = weekly_panel(spark, sf)
    v = F.col("volume")
    bars = weekly.withColumns(
        {
            "close": F.when(v % 41 != 0, F.col("close")), "preclose": F.col("open"), "is_st_known": v % 3 != 0,
            "is_limit_up": F.lit(False), "is_limit_down": F.lit(False),
        }
    )
    required = weekly.groupBy("symbol").agg(F.when(F.count("*") % 2 == 0, F.lit("2001-01-01").cast("date")).alias("list_date"))
    return quality.window_completeness(bars, required, calendars.session_list(weekly), "2001-06-25", 52)


def requested_snapshots(spark, sf):
    """Each monthly snapshot requested twice; the second request of 1998 loses a board."""
    s = indexed_snapshots(spark, sf)
    again = s.where(~((F.year("trade_date") == 1998) & F.col("symbol").startswith("000")))
    return s.withColumn("request_date", F.date_add("trade_date", 3)).unionByName(
        again.withColumn("request_date", F.date_sub("trade_date", F.month("trade_date") % 2))
    )


REQUESTED = """, req AS (SELECT *, trade_date + 3 AS request_date FROM idx
    UNION ALL SELECT *, trade_date - CAST(month(trade_date) % 2 AS INTEGER) FROM idx WHERE NOT (year(trade_date) = 1998 AND symbol LIKE '000%'))"""


@query(
    "snapshot_violations",
    with_daily(
        f""", {SNAPSHOTS}, {INDEXED}{REQUESTED},
      a AS (SELECT index_code, request_date, count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT trade_date) AS dates, max(trade_date) AS latest,
        count(*) FILTER (WHERE NOT regexp_full_match(symbol, '[0-9]{{6}}\\.(SH|SZ)')) AS bad, CASE index_code WHEN 'I1' THEN 24 ELSE 24 END AS want FROM req GROUP BY 1, 2),
      b AS (SELECT *, concat_ws(';', CASE WHEN rows NOT BETWEEN want - 1 AND want THEN 'WRONG_SIZE' END, CASE WHEN symbols < rows THEN 'DUPLICATE_SYMBOL' END,
        CASE WHEN dates <> 1 THEN 'SEVERAL_DATES' END, CASE WHEN latest > request_date THEN 'FUTURE_SNAPSHOT' END, CASE WHEN bad > 0 THEN 'BAD_SYMBOL' END) AS reasons FROM a)
      SELECT index_code, request_date, rows, reasons FROM b WHERE reasons <> ''"""
    ),
)
def snapshot_violations(spark, sf):
    return universe.snapshot_violations(requested_snapshots(spark, sf), {"I1": 24, "I2": 24}, SYMBOL_PATTERN, allow_one_missing=True)


@query(
    "effective_conflicts",
    with_daily(
        f""", {SNAPSHOTS}, {INDEXED}{REQUESTED},
      s AS (SELECT index_code, trade_date, request_date, string_agg(symbol, ',' ORDER BY symbol) AS members FROM req GROUP BY 1, 2, 3)
      SELECT index_code, trade_date, count(DISTINCT members) AS member_sets FROM s GROUP BY 1, 2 HAVING count(DISTINCT members) > 1"""
    ),
)
def effective_conflicts(spark, sf):
    return universe.effective_conflicts(requested_snapshots(spark, sf))


@query(
    "incomplete_snapshots",
    with_daily(f", {SNAPSHOTS}, {INDEXED} SELECT DISTINCT index_code, trade_date FROM idx WHERE month(trade_date) % 5 = 0"),
)
def incomplete_snapshots(spark, sf):
    return universe.incomplete_snapshots(indexed_snapshots(spark, sf))


# --- composed builds -------------------------------------------------------------------


@query(
    "build_dataset",
    f"""WITH {MERGED}, {SNAPSHOTS}, ses AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM merged)),
      one AS (SELECT *, 'I1' AS index_code FROM snapshots WHERE month(trade_date) <> 2 AND symbol LIKE '6%'),
      l AS (SELECT m.symbol, m.trade_date, m.close, m.preclose, lag(close) OVER w / preclose AS mult, idx - lag(idx) OVER w AS step
        FROM merged m JOIN ses USING (trade_date) WINDOW w AS (PARTITION BY m.symbol ORDER BY m.trade_date)),
      s AS (SELECT *, CAST(sum((NOT coalesce(step = 1 AND mult > 0, FALSE))::INT) OVER (PARTITION BY symbol ORDER BY trade_date) AS BIGINT) AS research_segment FROM l),
      c AS (SELECT *, exp(sum(CASE WHEN coalesce(step = 1 AND mult > 0, FALSE) THEN ln(mult) ELSE 0 END) OVER (PARTITION BY symbol, research_segment ORDER BY trade_date)) AS f FROM s),
      eff AS (SELECT d.trade_date, max(x.trade_date) AS snap FROM (SELECT DISTINCT trade_date FROM merged) d LEFT JOIN (SELECT DISTINCT trade_date FROM one) x ON x.trade_date <= d.trade_date GROUP BY 1)
    SELECT c.trade_date, c.symbol, research_segment, round(ln(c.close * f), 6) AS log_adj_close, one.symbol IS NOT NULL AS in_index
    FROM c JOIN eff ON eff.trade_date = c.trade_date LEFT JOIN one ON one.trade_date = eff.snap AND one.symbol = c.symbol""",
)
def dataset(spark, sf):
    b = vendor_bars(spark, sf, "B").withColumns(
        {"is_st_known": F.lit(True), "is_suspended_known": F.lit(True), "is_suspended": F.lit(False)}
    )
    a = vendor_bars(spark, sf, "A")
    both = a.select("trade_date", "symbol").union(b.select("trade_date", "symbol"))
    basics = both.select("symbol").distinct().withColumn("list_date", F.lit("1990-01-01").cast("date"))
    built = build_dataset(a, b, calendars.session_list(both), basics, indexed_snapshots(spark, sf), LABELS, "I1")
    return built.panel.select("trade_date", "symbol", "research_segment", F.round(F.ln("adj_close"), 6).alias("log_adj_close"), "in_index")


@query(
    "build_small_dataset",
    with_daily(
        f""", {SNAPSHOTS}, eff AS (SELECT d.trade_date, max(s.trade_date) AS snap FROM (SELECT DISTINCT trade_date FROM daily) d
        LEFT JOIN (SELECT DISTINCT trade_date FROM snapshots) s ON s.trade_date <= d.trade_date GROUP BY 1)
      SELECT year(d.trade_date) AS year, count(*) AS rows, count(s.symbol) AS members, count(*) FILTER (WHERE d.volume % 9 = 0) AS holes
      FROM daily d JOIN eff USING (trade_date) LEFT JOIN snapshots s ON s.trade_date = eff.snap AND s.symbol = d.symbol GROUP BY 1"""
    ),
)
def small_dataset(spark, sf):
    bars = daily_panel(spark, sf)
    holes = bars.withColumn("close", F.when((F.col("volume") % 9 != 0) | F.col("is_suspended"), F.col("close")))
    panel, _, _ = build_small_dataset(holes.withColumn("is_suspended", F.lit(False)), monthly_snapshots(spark, sf))
    missing = F.count_if((F.col("volume") % 9 == 0))
    return panel.groupBy(F.year("trade_date").alias("year")).agg(
        F.count("*").alias("rows"), F.count_if("in_index").alias("members"), missing.alias("holes")
    )


@query(
    "consolidate_panel",
    f"""WITH {VENDOR_A}, {VENDOR_B}, {SNAPSHOTS}, p AS (SELECT a.trade_date, a.symbol, a.close, b.close * 1.1 AS adj_close, a.preclose, a.open, a.is_st FROM vendor_a a
        JOIN vendor_b b ON a.trade_date = b.trade_date AND a.symbol = b.symbol WHERE a.trade_date <= DATE '2000-12-31'),
      g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS age, min(trade_date) OVER (PARTITION BY symbol) > (SELECT min(trade_date) FROM p) + 30 AS late FROM p),
      h AS (SELECT *, CASE WHEN late THEN age ELSE 999999 END AS listing_age_sessions, CASE WHEN symbol LIKE '688%' AND late AND age < 5 THEN NULL WHEN symbol LIKE '688%' THEN 0.20 WHEN is_st THEN 0.05 ELSE 0.10 END AS rate FROM g),
      eff AS (SELECT d.trade_date, max(s.trade_date) AS snap FROM (SELECT DISTINCT trade_date FROM p) d LEFT JOIN (SELECT DISTINCT trade_date FROM snapshots) s ON s.trade_date <= d.trade_date GROUP BY 1)
    SELECT h.trade_date, h.symbol, round(adj_close / close, 6) AS adj_factor, listing_age_sessions, {cents('preclose * (1 + rate)')} AS up_limit, s.symbol IS NOT NULL AS in_index,
      CASE WHEN eff.snap IS NULL THEN 'earliest_snapshot_backfill' ELSE 'point_in_time_snapshot' END AS membership_quality
    FROM h JOIN eff USING (trade_date) LEFT JOIN snapshots s ON s.symbol = h.symbol AND s.trade_date = coalesce(eff.snap, (SELECT min(trade_date) FROM snapshots))""",
)
def consolidated(spark, sf):
    adjusted = vendor_bars(spark, sf, "B").withColumn("close", F.col("close") * 1.1)
    out = consolidate_panel(vendor_bars(spark, sf, "A"), adjusted, monthly_snapshots(spark, sf), "2000-12-31")
    return out.select("trade_date", "symbol", r("adj_factor"), "listing_age_sessions", "up_limit", "in_index", "membership_quality")


# --- incremental -------------------------------------------------------------------------


def calendar(spark, sf):
    """Calendar days of the orders; weekdays are sessions."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return days.withColumn("is_trading_day", F.weekday("trade_date") < 5)


CALENDAR = "cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date, isodow(CAST(o_orderdate AS DATE)) <= 5 AS is_trading_day FROM orders)"


@query(
    "latest_completed_session",
    f"""WITH {CALENDAR} SELECT max(trade_date) FILTER (WHERE is_trading_day AND trade_date <= DATE '2000-03-14') AS target_session,
      min(trade_date) FILTER (WHERE is_trading_day AND trade_date > DATE '2000-03-14') AS next_session, max(trade_date) AS covered_until,
      max(trade_date) >= DATE '2000-03-15' AS calendar_covers FROM cal""",
)
def latest_completed_session(spark, sf):
    return calendars.latest_completed(calendar(spark, sf), "2000-03-15 17:30:00", 18)


@query(
    "refetch_dates",
    with_daily(
        f""", req AS (SELECT {symbol_sql('s_suppkey')} AS symbol FROM supplier WHERE s_acctbal > 0),
      win AS (SELECT DISTINCT trade_date FROM daily WHERE trade_date <= DATE '2001-06-29' ORDER BY 1 DESC LIMIT 20)
      SELECT w.trade_date, count(DISTINCT r.symbol) AS symbols, (SELECT count(*) FROM req) AS required FROM win w LEFT JOIN daily d USING (trade_date)
        LEFT JOIN req r ON r.symbol = d.symbol GROUP BY 1 HAVING count(DISTINCT r.symbol) <> (SELECT count(*) FROM req) OR w.trade_date = DATE '2001-06-29'"""
    ),
)
def refetch_dates(spark, sf):
    required = table(spark, sf, "supplier").where("s_acctbal > 0").select(symbol_of("s_suppkey").alias("symbol"))
    bars = daily_panel(spark, sf)
    return freshness.refetch_dates(bars, required, calendars.session_list(bars), "2001-06-29")


@query(
    "refetch_symbols",
    with_weekly(
        """, ses AS (SELECT DISTINCT trade_date FROM weekly ORDER BY 1 DESC LIMIT 60),
      req AS (SELECT symbol, CASE WHEN count(*) % 2 = 0 THEN DATE '2001-01-01' END AS list_date FROM weekly GROUP BY symbol),
      e AS (SELECT r.symbol, s.trade_date FROM req r JOIN ses s ON list_date IS NULL OR s.trade_date >= list_date),
      m AS (SELECT symbol, count(*) AS missing FROM e ANTI JOIN weekly USING (symbol, trade_date) GROUP BY symbol),
      u AS (SELECT symbol, bool_or(volume % 97 = 0) AS unknown FROM weekly JOIN ses USING (trade_date) GROUP BY symbol)
      SELECT symbol, coalesce(missing, 0) AS missing_sessions, coalesce(unknown, FALSE) AS unknown_status FROM req LEFT JOIN m USING (symbol) LEFT JOIN u USING (symbol)
      WHERE coalesce(missing, 0) > 0 OR coalesce(unknown, FALSE)"""
    ),
)
def refetch_symbols(spark, sf):
    weekly = weekly_panel(spark, sf)
    sessions = calendars.trailing_sessions(calendars.session_list(weekly), 60)
    required = weekly.groupBy("symbol").agg(F.when(F.count("*") % 2 == 0, F.lit("2001-01-01").cast("date")).alias("list_date"))
    bars = weekly.withColumn("is_st_known", F.col("volume") % 97 != 0)
    return freshness.refetch_symbols(bars, required, sessions)


@query(
    "thin_dates",
    with_daily(
        """, win AS (SELECT DISTINCT trade_date FROM daily ORDER BY 1 DESC LIMIT 20), c AS (SELECT trade_date, count(*) AS rows FROM daily JOIN win USING (trade_date) GROUP BY 1)
      SELECT trade_date, rows, (SELECT max(rows) FROM c) AS largest FROM c WHERE rows < (SELECT max(rows) FROM c) * 0.9"""
    ),
)
def thin_dates(spark, sf):
    bars = daily_panel(spark, sf)
    return freshness.thin_dates(bars, calendars.session_list(bars))


@query(
    "result_status",
    f"""WITH {CALENDAR}, t AS (SELECT max(trade_date) FILTER (WHERE is_trading_day AND trade_date <= DATE '2000-03-15') AS target,
        min(trade_date) FILTER (WHERE is_trading_day AND trade_date > DATE '2000-03-15') AS nxt FROM cal),
      res AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 7 = 0 THEN 'failed' ELSE 'ready' END AS status,
        CASE WHEN c_custkey % 3 = 0 THEN DATE '2000-03-14' ELSE DATE '2000-03-15' END AS through, CASE WHEN c_custkey % 5 = 0 THEN DATE '2000-03-17' ELSE DATE '2000-03-16' END AS nextd FROM customer)
    SELECT run_id, CASE WHEN status <> 'ready' THEN 'NOT_READY' WHEN through IS DISTINCT FROM target THEN 'EXPIRED' WHEN nextd IS DISTINCT FROM nxt THEN 'NEXT_SESSION_DIFFERS' ELSE 'CURRENT' END AS freshness FROM res, t""",
)
def result_status(spark, sf):
    k = F.col("c_custkey")
    results = table(spark, sf, "customer").select(
        k.alias("run_id"), F.when(k % 7 == 0, "failed").otherwise("ready").alias("status"),
        F.when(k % 3 == 0, "2000-03-14").otherwise("2000-03-15").cast("date").alias("data_through"),
        F.when(k % 5 == 0, "2000-03-17").otherwise("2000-03-16").cast("date").alias("next_trade_date"),
    )
    target = calendars.latest_completed(calendar(spark, sf), "2000-03-15 18:30:00", 18)
    return freshness.result_status(results, target).select("run_id", "freshness")


@query(
    "completeness",
    f"""WITH {VENDOR_A}, {VENDOR_B}, s AS (SELECT {symbol_sql('s_suppkey')} AS symbol FROM supplier),
      j AS (SELECT s.symbol, least(a.m, b.m) AS latest FROM s LEFT JOIN (SELECT symbol, max(trade_date) AS m FROM vendor_a GROUP BY 1) a USING (symbol)
        LEFT JOIN (SELECT symbol, max(trade_date) AS m FROM vendor_b GROUP BY 1) b USING (symbol)),
      f AS (SELECT count(*) AS symbols, count(latest) AS paired_symbols, min(latest) AS complete_through, count(*) FILTER (WHERE latest >= DATE '2001-10-20') AS symbols_at_end FROM j),
      ses AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
    SELECT f.*, (SELECT count(*) FROM ses WHERE d > f.complete_through AND d <= DATE '2001-10-20') AS stale_sessions, (SELECT min(d) FROM ses WHERE d > f.complete_through) AS next_session FROM f""",
)
def completeness(spark, sf):
    lines = table(spark, sf, "lineitem")
    sessions = calendars.session_list(lines.select(F.to_date("l_shipdate").alias("trade_date")))
    symbols = table(spark, sf, "supplier").select(symbol_of("s_suppkey").alias("symbol"))
    return freshness.completeness(vendor_bars(spark, sf, "A"), vendor_bars(spark, sf, "B"), symbols, sessions, "2001-10-20")


