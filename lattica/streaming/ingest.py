"""Bar files arriving over time, merged by priority into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.schema import BAR
from lattica.sources.versions import upsert_version


def bar_stream(spark: SparkSession, inbox: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(BAR).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)


def ingest_bars(spark: SparkSession, inbox: str, target: str, checkpoint: str) -> StreamingQuery:
    """Late or corrected bars replace older ones; replaying a batch changes nothing.

    A row's ``arrival`` is the time its file was written, kept with the row. Among rows of
    one priority the later file wins, in a batch and across batches, so files that are
    replayed or retried after a failure write the same table. A batch is one commit that
    carries its number: one that was logged before a failure is not merged again. A batch of
    nothing but replays makes no commit.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_version(batch, target, writer=(checkpoint, batch_id), stored_once=False)

    return (
        bar_stream(spark, inbox)
        .withColumn("arrival", F.unix_micros("_metadata.file_modification_time"))
        .where(F.col("trade_date").isNotNull() & F.col("symbol").isNotNull())
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
