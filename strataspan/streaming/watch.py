"""The change log as a stream: a folder of Parquet files that grows, read with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "lsn long, tag int, id long, version int, at long"


def watch(spark: SparkSession, folder: str, from_lsn: int = 0, files_per_batch: int = 100) -> DataFrame:
    """Records after from_lsn, as files arrive."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(folder).where(F.col("lsn") > from_lsn)


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch to `apply`, once each as long as it is idempotent by lsn; stops when all that is there was handed over."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_hour(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, tag, n: changes by the hour of their recording, final once the watermark has passed."""
    timed = stream.withColumn("t", F.timestamp_millis("at")).withWatermark("t", late)
    return timed.groupBy(F.window("t", "1 hour").alias("w"), "tag").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "tag", "n")


def degrees(stream: DataFrame) -> DataFrame:
    """node, degree, kept up to date over a stream of (start_id, delta): +1 for a relationship that comes, -1 for one that goes."""
    return stream.groupBy(F.col("start_id").alias("node")).agg(F.sum("delta").alias("degree"))
