"""Sessions, rebalance dates, next-session and as-of lookups on dates.

Every window here without a partition runs over distinct dates only, so it is
bounded by the length of the calendar, never by the rows of the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.dates import period_key
from lattica.functions.numeric import col


def session_list(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """Distinct dates with a dense 1-based ``session_idx``."""
    return (
        df.select(date)
        .where(F.col(date).isNotNull())
        .distinct()
        .withColumn("session_idx", F.row_number().over(W.orderBy(date)))
    )


def open_sessions(calendar: DataFrame) -> DataFrame:
    """Sessions of a ``(trade_date, is_trading_day)`` calendar."""
    return session_list(calendar.where("is_trading_day"))


def trailing_sessions(sessions: DataFrame, count: int) -> DataFrame:
    return (
        sessions.withColumn("_back", F.row_number().over(W.orderBy(F.desc("trade_date"))))
        .where(F.col("_back") <= count)
        .drop("_back")
    )


def rebalance_dates(dates: DataFrame, frequency: str = "W-FRI", next_session=None, by=()) -> DataFrame:
    """Last observed date of each period (and strategy); a period still running is left out."""
    distinct = dates.select(*by, "trade_date").distinct()
    last = distinct.groupBy(*by, period_key("trade_date", frequency).alias("period")).agg(
        F.max("trade_date").alias("trade_date")
    )
    if next_session is not None and frequency.upper() != "D":
        upcoming = period_key(F.lit(next_session).cast("date"), frequency)
        last = last.where(F.col("period") != upcoming)
    return last


def is_rebalance_due(signal_date: str | Column, next_date: str | Column, frequency: str) -> Column:
    if frequency.upper() == "D":
        return F.lit(True)
    return period_key(signal_date, frequency) != period_key(next_date, frequency)


def next_session(dates: DataFrame, sessions: DataFrame, signal: str = "trade_date") -> DataFrame:
    """``(signal_date, exec_date)``: the first session strictly after each signal."""
    marks = sessions.select(F.col("trade_date").alias("at"), F.col("trade_date").alias("session"), F.lit(0).alias("side"))
    asks = dates.select(F.col(signal).alias("at"), F.lit(None).cast("date").alias("session"), F.lit(1).alias("side"))
    # read backwards, so that each row takes one step instead of scanning all that follows
    ahead = W.orderBy(F.desc("at"), F.desc("side")).rowsBetween(W.unboundedPreceding, -1)
    return (
        marks.unionByName(asks.distinct())
        .withColumn("exec_date", F.last("session", ignorenulls=True).over(ahead))
        .where("side = 1")
        .select(F.col("at").alias("signal_date"), "exec_date")
    )


def effective_dates(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest snapshot on or before each distinct date; NULL before the first."""
    marks = snapshots.select(F.col("trade_date").alias("at"), F.col("trade_date").alias("snap"), F.lit(0).alias("side"))
    asks = dates.select(F.col("trade_date").alias("at"), F.lit(None).cast("date").alias("snap"), F.lit(1).alias("side"))
    so_far = W.orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    return (
        marks.distinct()
        .unionByName(asks.distinct())
        .withColumn("snapshot_date", F.last("snap", ignorenulls=True).over(so_far))
        .where("side = 1")
        .select(F.col("at").alias("trade_date"), "snapshot_date")
    )


def drop_last_dates(df: DataFrame, count: int) -> DataFrame:
    """Rows outside the last ``count`` distinct dates of the table."""
    if count <= 0:
        return df
    back = F.row_number().over(W.orderBy(F.desc("trade_date")))
    kept = df.select("trade_date").distinct().withColumn("_back", back).where(F.col("_back") > count)
    return df.join(kept.select("trade_date"), "trade_date", "left_semi")


def partition_windows(requests: DataFrame, monthly: bool) -> DataFrame:
    """Split ``[start_date, end_date]`` rows into whole calendar months or years."""
    unit, step = ("month", "INTERVAL 1 MONTH") if monthly else ("year", "INTERVAL 1 YEAR")
    heads = F.expr(f"sequence(date_trunc('{unit}', start_date), cast(end_date as timestamp), {step})")
    head = F.col("_head").cast("date")
    following = F.add_months(head, 1 if monthly else 12)
    return (
        requests.where("start_date <= end_date")
        .withColumn("_head", F.explode(heads))
        .withColumn("window_start", F.greatest(head, F.col("start_date")))
        .withColumn("window_end", F.least(F.date_sub(following, 1), F.col("end_date")))
        .drop("_head")
    )


def latest_completed(calendar: DataFrame, as_of: str | Column, ready_hour: int = 18) -> DataFrame:
    """One row: the last session whose data is ready at ``as_of`` and the next session."""
    clock = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    today = clock.cast("date")
    ready = (F.col("trade_date") < today) | ((F.col("trade_date") == today) & (F.hour(clock) >= ready_hour))
    is_open = F.col("is_trading_day")
    target = calendar.agg(
        F.max(F.when(is_open & ready, F.col("trade_date"))).alias("target_session"),
        F.min(F.when(is_open & ~ready, F.col("trade_date"))).alias("next_session"),
        F.max("trade_date").alias("covered_until"),
    )
    return target.withColumn("calendar_covers", F.coalesce(F.col("covered_until") >= today, F.lit(False)))


def session_gap(sessions: DataFrame, df: DataFrame, date: str | Column = "trade_date") -> DataFrame:
    """Attach ``session_idx`` to a table (calendar side is small; AQE picks the join)."""
    return df.join(sessions.withColumnRenamed("trade_date", "_d"), col(date) == F.col("_d"), "left").drop("_d")
