"""Chronological splits and walk-forward folds as small date tables.

A fold never copies the panel: daily results are computed once and joined to the
(fold, part, date) table, whose size is calendar x folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.checks import require_columns


def chronological_split(df: DataFrame, train_end: str, validation_end: str, embargo_days: int = 0) -> DataFrame:
    """Add ``part`` (train, validation, test); rows inside an embargo gap are dropped."""
    require_columns(df, ["trade_date"])
    if train_end >= validation_end:
        raise ValueError("train_end must be before validation_end")
    date = F.col("trade_date")
    first, second = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    part = (
        F.when(date <= F.date_sub(first, embargo_days), "train")
        .when((date > F.date_add(first, embargo_days)) & (date <= F.date_sub(second, embargo_days)), "validation")
        .when(date > F.date_add(second, embargo_days), "test")
    )
    return df.withColumn("part", part).where("part IS NOT NULL")


def require_parts(split: DataFrame) -> None:
    found = {r.part for r in split.select("part").distinct().collect()}
    if found != {"train", "validation", "test"}:
        raise ValueError(f"empty split; found only {sorted(found)}")


def year_folds(sessions: DataFrame, train: int, validation: int, test: int, step: int | None = None) -> DataFrame:
    """``(test_year, part, year)``: which calendar years each fold uses for what."""
    step = step or test
    if min(train, validation, test, step) < 1:
        raise ValueError("window lengths are positive")
    span = sessions.agg(F.year(F.min("trade_date")).alias("_first"), F.year(F.max("trade_date")).alias("_last"))
    heads = span.where(F.col("_first") + train + validation <= F.col("_last")).select(
        F.explode(F.sequence(F.col("_first") + (train + validation), F.col("_last"), F.lit(step))).alias("test_year"),
        "_last",
    )
    head = F.col("test_year")
    parts = F.array(
        F.struct(F.lit("train").alias("part"), F.sequence(head - validation - train, head - validation - 1).alias("years")),
        F.struct(F.lit("validation").alias("part"), F.sequence(head - validation, head - 1).alias("years")),
        F.struct(F.lit("test").alias("part"), F.sequence(head, F.least(head + test - 1, F.col("_last"))).alias("years")),
    )
    return heads.select("test_year", F.inline(parts)).select("test_year", "part", F.explode("years").alias("year"))


def fold_dates(sessions: DataFrame, folds: DataFrame, embargo: int = 0) -> DataFrame:
    """``(test_year, part, trade_date)`` with the last ``embargo`` dates of each
    training and validation window removed."""
    dated = sessions.select("trade_date", F.year("trade_date").alias("year")).join(F.broadcast(folds), "year")
    return _without_tail(dated, embargo).select("test_year", "part", "trade_date")


def _without_tail(dated: DataFrame, embargo: int) -> DataFrame:
    back = F.row_number().over(W.partitionBy("test_year", "part").orderBy(F.desc("trade_date")))
    return dated.withColumn("_back", back).where((F.col("part") == "test") | (F.col("_back") > embargo)).drop("_back")


def anniversary_folds(sessions: DataFrame, train: int, validation: int, test: int, embargo: int = 0) -> DataFrame:
    """Folds that start on anniversaries of the first date: ``(fold, part, trade_date)``.

    A fold counts when its test window ends within seven days of the last date.
    """
    span = sessions.agg(F.min("trade_date").alias("_first"), F.max("trade_date").alias("_last"))
    start = F.add_months("_first", 12 * (train + validation))
    last_start = F.add_months(F.date_add("_last", 7), -12 * test)
    heads = span.where(start <= last_start).select(
        F.posexplode(F.sequence(start, last_start, F.expr(f"INTERVAL {test} YEAR"))).alias("_n", "test_start")
    )
    bounds = heads.select(
        (F.col("_n") + 1).alias("test_year"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("train").alias("part"),
                    F.add_months("test_start", -12 * (train + validation)).alias("lo"),
                    F.add_months("test_start", -12 * validation).alias("hi"),
                ),
                F.struct(
                    F.lit("validation").alias("part"),
                    F.add_months("test_start", -12 * validation).alias("lo"),
                    F.col("test_start").alias("hi"),
                ),
                F.struct(
                    F.lit("test").alias("part"),
                    F.col("test_start").alias("lo"),
                    F.add_months("test_start", 12 * test).alias("hi"),
                ),
            )
        ),
    )
    days = sessions.select("trade_date")
    inside = (F.col("trade_date") >= F.col("lo")) & (F.col("trade_date") < F.col("hi"))
    dated = days.join(F.broadcast(bounds), inside)  # three rows per fold
    return _without_tail(dated, embargo).select(F.col("test_year").alias("fold"), "part", "trade_date")
