"""Housekeeping: compaction, retention, erasure, tiers, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import values as V
from strataspan.functions.calendar import MILLIS, decompose_id


def compact(v: DataFrame, keep_versions: int, keep_since: int) -> tuple[DataFrame, DataFrame]:
    """(v without the oldest history rows that fail both bounds, stubs: id, trimmed, last_version, low_pin).

    A history row stays if it is among the keep_versions newest of its history or was superseded at or after keep_since; the newest history
    row and the current one always stay. Pins below low_pin can't be answered for the entity any more.
    """
    back = Window.partitionBy("id", "is_current").orderBy(F.desc("version"))
    n = F.when(~F.col("is_current"), F.row_number().over(back))
    stays = F.col("is_current") | (F.col("_n") <= max(1, keep_versions)) | (F.greatest("tx_to", "deleted_at") >= keep_since)
    ranked = v.withColumn("_n", n)
    # what is trimmed is a prefix of the chain: nothing goes above a row that stays
    low = F.min(F.when(stays, F.col("version"))).over(Window.partitionBy("id"))
    marked = ranked.withColumn("_low", low)
    gone = marked.where(F.col("version") < F.col("_low"))
    kept = marked.where(F.col("version") >= F.col("_low"))
    stubs = gone.groupBy("id").agg(F.count(F.lit(1)).alias("trimmed"), F.max("version").alias("last_version"), F.max(F.greatest("tx_to", "tx_from")).alias("low_pin"))
    return kept.drop("_n", "_low"), stubs


def lowest_answered_pins(ids: DataFrame, stubs: DataFrame) -> DataFrame:
    return ids.join(stubs.select("id", "low_pin"), "id", "left").select("id", F.coalesce("low_pin", F.lit(0)).alias("low_pin"))


def purge_expired(nodes: DataFrame, rels: DataFrame, label: str, ended_before: int) -> tuple[DataFrame, DataFrame]:
    """Remove nodes of the label whose newest version ended before an instant, with their history and all their relationships. Ends of superseded rows don't count."""
    newest = nodes.where("not void").groupBy("id").agg(F.max_by(F.struct("e", F.array_contains("labels", label).alias("member")), "version").alias("t"))
    gone = newest.where(F.col("t.member") & (F.col("t.e") < ended_before)).select("id")
    return nodes.join(gone, "id", "left_anti"), without_ends(rels, gone)


def purge_expired_rels(rels: DataFrame, type_name: str, ended_before: int) -> DataFrame:
    """The relationships without those of the type whose newest version ended before an instant, with their history."""
    newest = rels.where((F.col("type") == type_name) & ~F.col("void")).groupBy("id").agg(F.max_by("e", "version").alias("e"))
    return rels.join(newest.where(F.col("e") < ended_before).select("id"), "id", "left_anti")


def without_ends(rels: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("start_id", "end_id"):
        rels = rels.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return rels


def erasure(nodes: DataFrame, rels: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, rels, receipt): every row of the nodes and of the relationships at them removed; receipt: kind, rows, entities."""
    hit = rels.join(ids.select(F.col("id").alias("start_id")), "start_id", "left_semi").select("id").union(rels.join(ids.select(F.col("id").alias("end_id")), "end_id", "left_semi").select("id")).distinct()
    count = lambda v, gone, kind: v.join(gone, "id", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("entities")).select(F.lit(kind).alias("kind"), "rows", "entities")
    receipt = count(nodes, ids.select("id"), "node").unionByName(count(rels, hit, "rel"))
    return nodes.join(ids.select("id"), "id", "left_anti"), rels.join(hit, "id", "left_anti"), receipt


def stored_sizes(v: DataFrame) -> DataFrame:
    """id, version, size: bytes of the row as JSON, a proxy for what it takes."""
    return v.select("id", "version", F.octet_length(F.to_json(F.struct(*v.columns))).alias("size"))


def untimed(v: DataFrame, unbounded: bool = True) -> DataFrame:
    """First versions without a start of their own (s 0) begin at minus infinity, or else when they were recorded."""
    first = (F.col("version") == 0) & (F.col("s") == 0)
    return v.withColumn("s", F.when(first, F.lit(V.NEG) if unbounded else F.col("tx_from")).otherwise(F.col("s")))


def tiers(v: DataFrame, reference_labels: list[str], week_ms: int = 7 * MILLIS["day"]) -> DataFrame:
    """v with the columns that a tiered layout partitions by: class (reference or event, by first label) and the week an id was minted."""
    reference = F.col("labels")[0].isin(*reference_labels) if reference_labels else F.lit(False)
    return v.withColumn("class", F.when(reference, "reference").otherwise("event")).withColumn("week", F.floor(decompose_id(F.col("id"))["created_at"] / week_ms))


def shard_of(shards: int = 32):
    """The shard of an id by its node bits."""
    return F.pmod(decompose_id(F.col("id"))["node"], F.lit(shards))
