"""Content hashes of versions and the chains they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import values as V


def canonical(kind: str) -> Column:
    """The text that is hashed: id, version, what the entity is (labels sorted), and its properties by key with their stored kinds; no times."""
    props = F.array_join(F.transform(F.array_sort(F.map_keys(F.coalesce("props", F.create_map().cast(V.PROPS)))), lambda k: F.concat_ws("=", k, F.coalesce(V.idxkey(F.col("props")[k]), F.to_json(F.col("props")[k])))), "&")
    who = [F.array_join(F.array_sort("labels"), ",")] if kind == "node" else [F.col("type"), F.col("start_id").cast("string"), F.col("end_id").cast("string")]
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("id", "version")], *who, F.coalesce(props, F.lit("")))


def content_hash(kind: str) -> Column:
    return F.sha2(canonical(kind).cast("binary"), 256)


def with_hashes(v: DataFrame, kind: str = "node") -> DataFrame:
    """v with hash, and prev_hash: that of the version before in the chain (empty for the first)."""
    return v.withColumn("hash", content_hash(kind)).withColumn("prev_hash", F.coalesce(F.lag("hash").over(Window.partitionBy("id").orderBy("version")), F.lit("")))


def verify_chains(v: DataFrame, kind: str = "node", stubs: DataFrame | None = None) -> DataFrame:
    """id, valid: whether every version's hash is that of its content, and every prev_hash that of a member of the chain (or of what
    compaction trimmed: stubs of id, hash)."""
    before = F.lag("hash").over(Window.partitionBy("id").orderBy("version"))
    odd = (F.col("prev_hash") != "") & ~F.coalesce(F.col("prev_hash") == before, F.lit(False))
    # nearly always a version's prev_hash is that of the version before; only the others are sought among all of the chain
    checked = v.select("id", "prev_hash", (F.col("hash") == content_hash(kind)).alias("_own"), odd.alias("_odd"))
    own = checked.groupBy("id").agg(F.min("_own").alias("_own"))
    known = v.select("id", F.col("hash").alias("prev_hash"))
    known = known if stubs is None else known.unionByName(stubs.select("id", F.col("hash").alias("prev_hash")))
    broken = checked.where("_odd").join(known, ["id", "prev_hash"], "left_anti").select("id").distinct().withColumn("_broken", F.lit(True))
    return own.join(broken, "id", "left").select("id", (F.col("_own") & F.col("_broken").isNull()).alias("valid"))


#: What a row tells about itself, by the names under which `resolve_property` finds it (with a prefix that no property has).
SHADOW = {
    "id": "id", "version": "version", "valid_from": "s", "valid_to": "e", "tx_from": "tx_from", "tx_to": "tx_to", "deleted_at": "deleted_at", "retracted": "retracted", "void": "void",
    "hash": "hash", "prev_hash": "prev_hash", "type": "type", "start_id": "start_id", "end_id": "end_id", "labels": "labels",
}


def resolve_property(df: DataFrame, key: str, prefix: str = "meta_") -> Column:
    """The property `key`, or for a prefixed key the row's own field; null where the row has no such field."""
    if key.startswith(prefix):
        field = SHADOW.get(key.removeprefix(prefix))
        return F.col(field) if field in df.columns else F.lit(None)
    return F.col("props")[key]
