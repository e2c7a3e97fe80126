"""Spark helpers of the operators: staged tables, sizes, ranks without one-task windows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.session import scratch_path

_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, read many times."""
    path = scratch_path(df.sparkSession, name)
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def last_stays(spark: SparkSession) -> Iterator[None]:
    """Of the tables staged inside by this thread, all but the last are deleted at the end.

    For work whose last table is its whole result. The collection asked for then lets Spark
    remove the shuffle files of the plans that are gone too.
    """
    paths: list[str] = []
    token = _PATHS.set(paths)
    try:
        yield
    finally:
        _PATHS.reset(token)
        context = spark.sparkContext
        for name in paths[:-1]:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        context._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, for sizing partitions."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def partitions(spark: SparkSession, total: int, target: int) -> int:
    """How many partitions of about ``target`` bytes; at least the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // target), 1)


def ranked(df: DataFrame, group: list[str], order: list[str | Column], name: str, buckets: int) -> DataFrame:
    """Number the rows of each group 0, 1, .. without bringing a group to one task.

    Rows are dealt to ``buckets`` hash buckets of their group, numbered inside the bucket,
    and shifted by the counts of the buckets before. The group columns hold no nulls.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return inside.join(shift, keys).withColumn(name, F.col("_place") + F.col("_shift")).drop("_place", "_shift", "_bucket")
