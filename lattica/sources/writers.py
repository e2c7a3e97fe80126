"""Sinks: overwrite, partitioned staging, canonical panel, upsert, snapshots, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lattica.operators.merging import upsert
from lattica.schema import KEYS


def write_table(df: DataFrame, path: str) -> str:
    """Overwrite as parquet or CSV by suffix; the committer publishes whole jobs only."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported table format: {path}")
    return path


def write_by_year(df: DataFrame, path: str) -> str:
    """Yearly staging; only the years present in ``df`` are replaced."""
    staged = df.withColumn("year", F.year("trade_date"))
    # tasks are sized by bytes: a big year is split over many, small ones share one
    (
        staged.hint("rebalance", F.col("year"))
        .sortWithinPartitions("year", *KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("year")
        .parquet(path)
    )
    return path


def write_canonical(df: DataFrame, path: str, columns) -> str:
    """Fixed column order, ranged by symbol and sorted by key, zstd."""
    (
        df.select(*columns)
        .repartitionByRange("symbol", "trade_date")
        .sortWithinPartitions("symbol", "trade_date")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def upsert_years(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Merge bars into a yearly table, last write wins, touching only changed years.

    ``changes`` has ``priority`` and may have ``arrival`` (see ``upsert``). The years read
    are the years rewritten; the merged rows are staged beside the table first, under a
    name of their own, because a table cannot be overwritten while it is being read.
    """
    changes = changes.withColumn("year", F.year("trade_date"))
    years = [r.year for r in changes.select("year").distinct().collect()]  # calendar years
    if not years:
        return
    try:
        old = spark.read.parquet(path).where(F.col("year").isin(years))
        merged = upsert(old, changes, KEYS)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        merged = upsert(changes.limit(0), changes, KEYS)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    merged.hint("rebalance", F.col("year")).write.mode("overwrite").partitionBy("year").parquet(staging)
    (
        spark.read.parquet(staging)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def partition_manifest(df: DataFrame, partition: str, date: str = "trade_date", code: str = "symbol") -> DataFrame:
    """Rows, date span, codes present and null counts of each partition."""
    others = [c for c in df.columns if c != partition]
    return df.groupBy(partition).agg(
        F.count("*").alias("rows"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.countDistinct(code).alias("codes_present"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in others],
    )


def missing_codes(df: DataFrame, requested: DataFrame, partition: str, code: str = "symbol") -> DataFrame:
    """Requested codes that a partition does not hold."""
    return requested.join(df.select(partition, code).distinct(), [partition, code], "left_anti")


def manifest_rollup(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("partitions"),
        F.sum("rows").alias("rows"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.count_if(F.col("rows") == 0).alias("empty_partitions"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content digest: row count, hash sum and a schema digest.

    Hashes are summed as decimals and combined before the shuffle, so duplicates
    count and no row order is needed. A hash skips NULLs, so the places of a row's
    NULLs are hashed with its values.
    """
    columns = sorted(df.columns)
    layout = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns)
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*[F.isnull(c) for c in columns], *columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("content"),
        F.sha2(F.lit(layout), 256).alias("layout"),
    )


def same_content(a: DataFrame, b: DataFrame) -> bool:
    return fingerprint(a).first() == fingerprint(b).first()


def require_match(scores_manifest: DataFrame, market_manifest: DataFrame) -> None:
    """Scores may be used only with the panel version they were computed from."""
    left = scores_manifest.select("dataset_id").distinct().limit(2).collect()
    right = market_manifest.select("dataset_id").distinct().limit(2).collect()
    if len(left) != 1 or left != right:
        raise ValueError("scores and market come from different dataset versions")


def write_once(df: DataFrame, root: str, date: str, live_start: str | None = None) -> str:
    """Dated snapshot that is never revised: RECORDED, VERIFIED_EXISTING or an error."""
    if live_start is not None and date < live_start:
        return "BEFORE_LIVE_START"
    spark = df.sparkSession
    path = f"{root}/{date}"
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.write.mode("errorifexists").parquet(path)
        return "RECORDED"
    shape = lambda frame: {f.name: f.dataType for f in frame.schema.fields}
    if shape(existing) != shape(df) or not same_content(existing, df):
        raise RuntimeError(f"snapshot for {date} already exists and differs")
    return "VERIFIED_EXISTING"
