"""Table scans. Column lists and date ranges reach the parquet reader."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.dates import lenient_date
from lattica.operators.calendars import session_list
from lattica.operators.checks import require_columns
from lattica.operators.factors import required_inputs, warmup_rows
from lattica.sources import versions

# What the research panel reads when no list is given.
RESEARCH_COLUMNS = [
    "trade_date", "symbol", "open", "high", "low", "close", "volume", "amount", "adj_open", "adj_close",
    "turnover_rate", "is_st", "is_suspended", "is_st_known", "is_suspended_known", "limit_status_known",
]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by suffix. CSV needs a schema; ``trade_date`` is parsed."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs a declared schema")
        text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "trade_date" else f.dataType) for f in schema])
        df = spark.read.schema(text).option("header", True).csv(path)
        return df.withColumn("trade_date", F.to_date("trade_date")) if "trade_date" in df.columns else df
    raise ValueError(f"unsupported table format: {path}")


def read_drifting(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Files of drifting schema as one table, columns united by name."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_report(spark: SparkSession, path: str, required: Iterable[str], dates=("trade_date",)) -> DataFrame:
    """Report CSV with a header: required columns checked, dates parsed leniently."""
    df = spark.read.option("header", True).csv(path)
    require_columns(df, required)
    return df.withColumns({d: lenient_date(d) for d in dates if d in df.columns})


def warmup_start(panel: DataFrame, start, rows: int) -> DataFrame:
    """One row: the session ``rows`` before the first session on or after ``start``.

    ``available`` says whether that much history exists.
    """
    start = F.lit(start).cast("date")
    sessions = session_list(panel)
    first = sessions.where(F.col("trade_date") >= start).agg(F.min("session_idx").alias("_first"))
    placed = sessions.join(F.broadcast(first), F.lit(True))
    wanted = F.col("session_idx") == F.greatest(F.lit(1), F.col("_first") - rows)
    return placed.where(wanted).select(
        F.col("trade_date").alias("scan_start"), (F.col("_first") - rows >= 1).alias("available")
    )


def load_for_factors(
    panel: DataFrame, names: Iterable[str], start, end, extra: Iterable[str] = (), allow_short: bool = False
) -> DataFrame:
    """Pruned warm-up scan: declared inputs only, from max(lookback) sessions before start.

    The scan bound is looked up first (one row) so that it reaches the file reader
    as a literal and prunes row groups.
    """
    names = list(names)
    columns = list(dict.fromkeys([*required_inputs(names), *extra]))
    require_columns(panel, columns)
    bound = warmup_start(panel, start, warmup_rows(names)).first()
    if bound is None:
        raise ValueError("no session on or after the requested start")
    if not bound.available and not allow_short:
        raise ValueError("history is shorter than the factors' lookback")
    end = F.lit(end).cast("date")
    return panel.select(*columns).where(F.col("trade_date").between(F.lit(bound.scan_start), end))


def load_version_for_factors(
    spark: SparkSession, path: str, names: Iterable[str], start, end, symbols: Iterable[str] | DataFrame | None = None, allow_short: bool = False
) -> DataFrame:
    """The warm-up scan of a versioned table: only files that can hold rows of it are opened."""
    names = list(names)
    bound = warmup_start(versions.read(spark, path, last=end).select("trade_date"), start, warmup_rows(names)).first()
    if bound is None:
        raise ValueError("no session on or after the requested start")
    if not bound.available and not allow_short:
        raise ValueError("history is shorter than the factors' lookback")
    rows = versions.read(spark, path, first=bound.scan_start, last=end, symbols=symbols)
    return rows.select(*required_inputs(names))


def load_research(panel: DataFrame, manifest: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The research panel, refused unless its manifest says ``ready``."""
    if not manifest.where((F.col("status") == "ready") & F.col("price_research_ready")).limit(1).collect():
        raise ValueError("dataset is not ready for research")
    wanted = list(columns or [c for c in RESEARCH_COLUMNS if c in panel.columns])
    require_columns(panel, wanted)
    return panel.select(*wanted)


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def load_scores(
    scores: DataFrame, market: DataFrame, factors: Iterable[str], start, end, allowed: Iterable[str],
    market_columns=("open", "close", "adj_close"),
) -> DataFrame:
    """Chosen factors and market columns in a date range; unknown factors are refused."""
    factors = list(factors)
    unknown = sorted(set(factors) - set(allowed))
    if unknown:
        raise ValueError(f"unknown factors: {unknown}")
    inside = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    left = scores.where(inside).select("trade_date", "symbol", *factors)
    right = market.where(inside).select("trade_date", "symbol", *market_columns)
    return left.join(right, ["trade_date", "symbol"])


def latest_snapshot(df: DataFrame, factor: str, keep: Iterable[str] = ()) -> DataFrame:
    """Rows of the last date that have a value, highest first."""
    last = df.agg(F.max("trade_date").alias("trade_date"))
    return (
        df.join(F.broadcast(last), "trade_date", "left_semi")
        .where(F.col(factor).isNotNull())
        .select("trade_date", "symbol", factor, *keep)
        .orderBy(F.desc(factor), "symbol")
    )


def load_symbols(bars: DataFrame, wanted: DataFrame, first, last) -> DataFrame:
    """Bars of a wanted symbol list inside a date range."""
    inside = F.col("trade_date").between(_as_date(first), _as_date(last))
    return bars.where(inside).join(wanted.select("symbol"), "symbol", "left_semi")


def _as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")
