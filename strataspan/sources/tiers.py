"""A tiered layout: version tables partitioned by tier, class and the week an id was minted, so a read of a depth prunes folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions.calendar import MILLIS
from strataspan.operators.admin import tiers
from strataspan.sources.changes import Folder

DEPTHS = {"hot": 1, "warm": 8, "all": None}


def write(v: DataFrame, path: str, reference_labels: list[str]) -> None:
    rows = tiers(v, reference_labels).withColumn("tier", F.lit("live"))
    rows.repartition("class", "week").sortWithinPartitions("id", "version").write.mode("overwrite").partitionBy("tier", "class", "week").parquet(path)


def read(spark: SparkSession, path: str, depth: str = "all", now: int | None = None, archived: bool = False) -> DataFrame:
    """depth: all; warm or hot: reference rows and the event rows of the last weeks before `now`. The filter is on partition columns."""
    t = spark.read.parquet(path)
    t = t if archived else t.where("tier = 'live'")
    weeks = DEPTHS[depth]
    if weeks is not None:
        first = (now if now is not None else 0) // (7 * MILLIS["day"]) - weeks + 1
        t = t.where((F.col("class") == "reference") | (F.col("week") >= first))
    return t.drop("tier", "class", "week")


def move(spark: SparkSession, path: str, target: str, ids: DataFrame, tier: str) -> None:
    """A copy of the layout in which the entities of `ids` are archived (tier archive) or restored (live)."""
    t = spark.read.parquet(path)
    hit = t.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    out = hit.withColumn("tier", F.when(F.col("_hit"), tier).otherwise(F.col("tier"))).drop("_hit")
    out.repartition("tier", "class", "week").write.mode("overwrite").partitionBy("tier", "class", "week").parquet(target)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """tier, class, week, rows, entities of each partition."""
    return spark.read.parquet(path).groupBy("tier", "class", "week").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("entities"))


def folders(spark: SparkSession, path: str) -> list[str]:
    return Folder(spark, path).names()


def compact_files(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite a version table as sorted files by id, a range each, so min and max of id prune them."""
    spark.read.parquet(path).repartitionByRange("id").sortWithinPartitions("id", "version").write.mode("overwrite").parquet(target)
