"""Uniqueness and temporal constraints, as queries that find what violates them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.functions import values as V
from strataspan.plans import kernels as K


def unique_violations(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """key, n, first: values that several current nodes of the label share (the least id of them)."""
    k = V.eqkey(F.col("props")[key])
    rows = nodes.where("is_current").where(F.array_contains("labels", label)).select(k.alias("key"), "id").where("key is not null")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")


def owners(nodes: DataFrame, label: str, key: str, released: DataFrame | None = None) -> DataFrame:
    """key, owner: who held each value first over all history (by recording, then id). Released values have no owner."""
    k = V.eqkey(F.col("props")[key])
    rows = nodes.where(F.array_contains("labels", label)).select(k.alias("key"), "id", "tx_from").where("key is not null")
    out = rows.groupBy("key").agg(F.min_by("id", F.struct("tx_from", "id")).alias("owner"))
    return out if released is None else out.join(released.select("key"), "key", "left_anti")


def forever_violations(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """key, owner, id: others than its first holder that ever held a value."""
    k = V.eqkey(F.col("props")[key])
    rows = nodes.where(F.array_contains("labels", label)).select(k.alias("key"), "id").where("key is not null").distinct()
    return rows.join(owners(nodes, label, key), "key").where("id != owner")


def outside_endpoints(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """id, side: current relationships that hold where an end of theirs is not covered by one effective segment after another."""
    segs = K.segments(nodes)
    new = F.coalesce(F.col("from") > F.lag("to").over(K.chain().orderBy("from")), F.lit(True))
    runs = segs.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(K.chain().orderBy("from")))
    spans = runs.groupBy("id", "_run").agg(F.min("from").alias("a"), F.max("to").alias("b"))
    current = rels.where("is_current")
    out = []
    for side in ("start_id", "end_id"):
        held = current.join(spans.withColumnRenamed("id", side), side).where((F.col("a") <= F.col("s")) & (F.col("b") >= F.col("e"))).select("id")
        out.append(current.join(held, "id", "left_anti").select("id", F.lit(side).alias("side")))
    return out[0].unionByName(out[1])


def dry_run(graph, facts: DataFrame, label: str, key: str) -> DataFrame:
    """fact, reason: proposed nodes (fact, props) that would break the uniqueness of (label, key), among themselves or with current nodes."""
    k = V.eqkey(F.col("props")[key])
    proposed = facts.select("fact", k.alias("key")).where("key is not null")
    held = graph.node_versions.where("is_current").where(F.array_contains("labels", label)).select(k.alias("key")).distinct()
    taken = proposed.join(held, "key", "left_semi").select("fact", F.lit("taken").alias("reason"))
    twice = proposed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return taken.unionByName(proposed.join(twice, "key", "left_semi").select("fact", F.lit("repeated").alias("reason"))).distinct()
