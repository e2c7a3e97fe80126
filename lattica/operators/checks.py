"""Guards on columns and keys. The only actions are five-row probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their row count (map-side combined)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, keys, what: str = "table") -> DataFrame:
    """Refuse duplicated keys; a merge that should be one-to-one stays one-to-one."""
    require_columns(df, keys)
    sample = duplicate_keys(df, keys).limit(5).collect()
    if sample:
        raise ValueError(f"duplicate keys {keys} in {what}: {[tuple(r) for r in sample]}")
    return df


def assert_empty(violations: DataFrame, message: str) -> None:
    sample = violations.limit(5).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")
