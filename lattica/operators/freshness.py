"""Incremental bookkeeping: what to refetch and how far data is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import flag
from lattica.operators.calendars import trailing_sessions


def refetch_dates(bars: DataFrame, required: DataFrame, sessions: DataFrame, target, recent: int = 20) -> DataFrame:
    """Recent sessions whose required-symbol count is short, plus the target session."""
    target = F.lit(target).cast("date")
    need = required.select("symbol").distinct()
    window = trailing_sessions(sessions.where(F.col("trade_date") <= target), recent).select("trade_date")
    seen = (
        bars.join(need, "symbol", "left_semi")
        .join(F.broadcast(window), "trade_date", "left_semi")
        .groupBy("trade_date")
        .agg(F.countDistinct("symbol").alias("symbols"))
    )
    size = need.agg(F.count("*").alias("required"))
    return (
        window.join(seen, "trade_date", "left")
        .join(F.broadcast(size), F.lit(True))
        .select("trade_date", F.coalesce("symbols", F.lit(0)).alias("symbols"), "required")
        .where((F.col("symbols") != F.col("required")) | (F.col("trade_date") == target))
    )


def refetch_symbols(bars: DataFrame, required: DataFrame, sessions: DataFrame) -> DataFrame:
    """Required symbols with missing sessions since listing, or unknown status rows.

    ``sessions`` is the window; expected counts come from its own index, so the
    symbol x session grid is not built.
    """
    first = sessions.agg(F.min("trade_date").alias("_lo"), F.count("*").alias("_all"))
    wanted = required.withColumn("list_date", F.col("list_date") if "list_date" in required.columns else F.lit(None).cast("date"))
    days = sessions.agg(F.array_sort(F.collect_list("trade_date")).alias("_days"))
    rows = bars.drop("list_date").join(F.broadcast(sessions.select("trade_date")), "trade_date", "left_semi").join(wanted, "symbol")
    seen = rows.groupBy("symbol").agg(
        F.countDistinct(
            F.when(F.col("list_date").isNull() | (F.col("trade_date") >= F.col("list_date")), F.col("trade_date"))
        ).alias("_observed"),
        F.max((~(flag("is_st_known") & flag("is_suspended_known"))).cast("int")).alias("_unknown"),
    )
    expected = F.size(F.filter("_days", lambda d: F.col("list_date").isNull() | (d >= F.col("list_date"))))
    return (
        wanted.join(seen, "symbol", "left")
        .join(F.broadcast(days), F.lit(True))
        .join(F.broadcast(first), F.lit(True))
        .select(
            "symbol",
            (expected - F.coalesce("_observed", F.lit(0))).cast("long").alias("missing_sessions"),
            (F.coalesce("_unknown", F.lit(0)) == 1).alias("unknown_status"),
        )
        .where("missing_sessions > 0 OR unknown_status")
    )


def thin_dates(bars: DataFrame, sessions: DataFrame, recent: int = 20, share: float = 0.9) -> DataFrame:
    """Recent sessions with fewer than ``share`` of the largest recent row count."""
    window = trailing_sessions(sessions, recent).select("trade_date")
    counts = bars.join(F.broadcast(window), "trade_date", "left_semi").groupBy("trade_date").agg(F.count("*").alias("rows"))
    filled = window.join(counts, "trade_date", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    top = F.max("rows").over(W.partitionBy())  # at most `recent` rows
    return filled.withColumn("largest", top).where(F.col("rows") < F.col("largest") * share)


def result_status(results: DataFrame, target: DataFrame) -> DataFrame:
    """Whether saved results are still current; ``target`` is ``latest_completed``'s row."""
    status = (
        F.when(F.col("status") != "ready", "NOT_READY")
        .when(~flag("calendar_covers") | F.col("next_session").isNull(), "CALENDAR_STALE")
        .when(~F.col("data_through").eqNullSafe(F.col("target_session")), "EXPIRED")
        .when(~F.col("next_trade_date").eqNullSafe(F.col("next_session")), "NEXT_SESSION_DIFFERS")
        .otherwise("CURRENT")
    )
    return results.join(F.broadcast(target), F.lit(True)).withColumn("freshness", status)


def completeness(raw: DataFrame, adjusted: DataFrame, symbols: DataFrame, sessions: DataFrame, requested_end) -> DataFrame:
    """One row: date through which every symbol has both tables, and how stale it is."""
    end = F.lit(requested_end).cast("date")
    a = raw.groupBy("symbol").agg(F.max("trade_date").alias("_raw"))
    b = adjusted.groupBy("symbol").agg(F.max("trade_date").alias("_adjusted"))
    both = symbols.select("symbol").distinct().join(a, "symbol", "left").join(b, "symbol", "left")
    latest = F.when(F.col("_raw").isNotNull() & F.col("_adjusted").isNotNull(), F.least("_raw", "_adjusted"))
    facts = both.select(latest.alias("_latest")).agg(
        F.count("*").alias("symbols"),
        F.count("_latest").alias("paired_symbols"),
        F.when(F.count("*") == F.count("_latest"), F.min("_latest")).alias("complete_through"),
        F.count_if(F.col("_latest") >= end).alias("symbols_at_end"),
    )
    through = F.col("complete_through")
    calendar = sessions.select("trade_date").join(F.broadcast(facts), F.lit(True)).agg(
        F.count_if((F.col("trade_date") > through) & (F.col("trade_date") <= end)).alias("stale_sessions"),
        F.min(F.when(F.col("trade_date") > through, F.col("trade_date"))).alias("next_session"),
    )
    return facts.join(calendar, F.lit(True)).withColumn(
        "stale_sessions", F.when(through.isNotNull(), F.col("stale_sessions"))
    )
