"""The change log, deltas, merges, exports and backups: tables in folders that any Hadoop file system holds."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.operators.index import Indexes
from strataspan.sources.fixtures import numbered

# Tags of change records.
TAGS = {"node_put": 1, "node_delete": 3, "rel_put": 2, "rel_delete": 4}


def change_log(v: DataFrame, kind: str = "node") -> DataFrame:
    """lsn (from 1), tag, id, version, at of every version row and every delete, by (at, id, version); deletes after the row they end."""
    put, gone = TAGS[f"{kind}_put"], TAGS[f"{kind}_delete"]
    records = v.select(F.col("tx_from").alias("at"), "id", "version", F.lit(put).alias("tag")).unionByName(v.where("deleted_at > 0").select(F.col("deleted_at").alias("at"), "id", "version", F.lit(gone).alias("tag")))
    return numbered(records, ["at", "id", "version", "tag"], "lsn").select("lsn", "tag", "id", "version", "at")


def feed(log: DataFrame, after: int, limit: int | None = None) -> DataFrame:
    out = log.where(F.col("lsn") > after).orderBy("lsn")
    return out if limit is None else out.limit(limit)


def last_lsn(log: DataFrame) -> int:
    return log.agg(F.max("lsn")).first()[0] or 0


def events(log: DataFrame) -> DataFrame:
    """type (create, update, delete), id, at, priority (critical 0, high 1, normal 2), to be taken by (priority, lsn)."""
    kind = F.when(F.col("tag") >= 3, "delete").when(F.col("version") == 0, "create").otherwise("update")
    priority = F.when(kind == "delete", 0).when(kind == "create", 1).otherwise(2)
    return log.select("lsn", kind.alias("type"), "id", "at", priority.alias("priority"))


def delta_since(v: DataFrame, since: int) -> DataFrame:
    """Rows that were recorded, superseded or deleted after a transaction instant."""
    return v.where((F.col("tx_from") > since) | (F.col("tx_to") > since) | (F.col("deleted_at") > since))


def merge(v: DataFrame, incoming: DataFrame) -> DataFrame:
    """v with the rows of incoming, once each: of two copies of a version the one with the later stamps stays; twice is as once."""
    both = v.withColumn("_new", F.lit(0)).unionByName(incoming.select(*v.columns).withColumn("_new", F.lit(1)))
    newest = F.struct(F.greatest("tx_to", "deleted_at").alias("stamp"), F.col("_new"))
    columns = [c for c in v.columns if c not in ("id", "version")]
    best = both.groupBy("id", "version").agg(F.max_by(F.struct(*columns), newest).alias("w"))
    merged = best.select("id", "version", *[F.col("w")[c].alias(c) for c in columns])
    # a later current row takes the slot from an older one
    top = F.max(F.when(F.col("is_current"), F.col("version"))).over(Window.partitionBy("id"))
    return merged.withColumn("is_current", F.col("is_current") & (F.col("version") == top)).select(*v.columns)


class Folder:
    """Files of one folder, by Hadoop's file system API, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        p = self._path(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def write_text(self, name: str, text: str) -> None:
        """One small file, written by the driver through a single-row table."""
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}").first()[0]


def export(graph, path: str) -> None:
    """Both tables and a manifest. Rows are laid out by id, so readers prune by it."""
    graph.node_versions.repartitionByRange("id").sortWithinPartitions("id", "version").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.rel_versions.repartitionByRange("id").sortWithinPartitions("id", "version").write.mode("overwrite").parquet(f"{path}/rels")
    for kind, stubs in graph.stubs.items():
        stubs.write.mode("overwrite").parquet(f"{path}/stubs-{kind}")
    more = {"indexes": declared(graph.indexes), "watermark": graph.watermark, "stubs": sorted(graph.stubs), "applied_lsn": graph.applied_lsn}
    Folder(graph.spark, path).write_text("manifest", json.dumps({"now": graph.now, "tags": graph.tags, "voids": graph.has_voids, **more}))


def declared(x: Indexes) -> dict:
    """The declarations as JSON values; providers are code and stay behind."""
    pairs = lambda d: [[list(k) if isinstance(k, tuple) else k, v] for k, v in sorted(d.items())]
    return {"properties": pairs(x.properties), "composites": x.composites, "temporal": sorted(map(list, x.temporal)), "vectors": pairs(x.vectors), "frequent": x.frequent, "epoch": x.epoch}


def declare(d: dict) -> Indexes:
    tuples = lambda pairs: {tuple(k): v for k, v in pairs}
    return Indexes(
        properties=tuples(d["properties"]), composites={k: [tuple(c) for c in v] for k, v in d["composites"].items()},
        temporal={tuple(t) for t in d["temporal"]}, vectors=tuples(d["vectors"]), frequent=d["frequent"], epoch=d["epoch"],
    )


def load(spark: SparkSession, path: str):
    from strataspan.graph import Graph

    m = json.loads(Folder(spark, path).read_text("manifest"))
    g = Graph(spark, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/rels"), now=m["now"], has_voids=m["voids"])
    g.tags.update(m["tags"])
    g.indexes, g.watermark, g.applied_lsn = declare(m["indexes"]), m["watermark"], m["applied_lsn"]
    g.stubs = {kind: spark.read.parquet(f"{path}/stubs-{kind}") for kind in m["stubs"]}
    return g


def export_json(v: DataFrame, path: str) -> None:
    v.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


_BACKUP = re.compile(r"backup-(\d+)-(?:full|delta-(\d+))$")


def backup(graph, folder: str, since: int | None = None) -> int:
    """Write a full backup, or the delta after the transaction instant `since`; returns the instant it reaches. A delta carries which rows
    were removed for good (erasure, retention, compaction), so that they do not come back, but not what was updated in place."""
    name = f"backup-{graph.now}-" + ("full" if since is None else f"delta-{since}")
    pick = (lambda v: v) if since is None else (lambda v: delta_since(v, since))
    pick(graph.node_versions).write.parquet(f"{folder}/{name}/nodes")
    pick(graph.rel_versions).write.parquet(f"{folder}/{name}/rels")
    if since is not None:
        for kind, gone in graph.removed.items():
            gone.where(F.col("at") >= since).write.parquet(f"{folder}/{name}/removed-{kind}")
    state = {"tags": graph.tags, "voids": graph.has_voids, "indexes": declared(graph.indexes), "watermark": graph.watermark, "stubs": sorted(graph.stubs)}
    for kind, stubs in graph.stubs.items():
        stubs.write.parquet(f"{folder}/{name}/stubs-{kind}")
    Folder(graph.spark, f"{folder}/{name}").write_text("manifest", json.dumps(state))
    return graph.now


def backup_chain(spark: SparkSession, folder: str) -> list[str]:
    """The newest full backup and the deltas that follow it without a gap; a gap is refused before anything is read."""
    found = [(int(m[1]), None if m[2] is None else int(m[2]), n) for n in Folder(spark, folder).names() if (m := _BACKUP.match(n))]
    full = [x for x in found if x[1] is None]
    if not full:
        raise FileNotFoundError(f"no full backup in {folder}")
    at, _, name = max(full)
    chain = [name]
    for to, since, name in sorted(x for x in found if x[1] is not None and x[0] > at):
        if since > at:
            raise ValueError(f"{name} begins at {since}, but the chain reaches {at}")
        chain.append(name)
        at = to
    return chain


def without_removed(v: DataFrame, gone: DataFrame) -> DataFrame:
    """v without the rows that were recorded before a removal, up to the highest version that it took; a chain that began anew stays."""
    latest = gone.groupBy("id").agg(F.max("at").alias("_at"), F.max("up_to").alias("_up_to"))
    hit = (F.col("version") <= F.col("_up_to")) & (F.col("tx_from") <= F.col("_at"))
    return v.join(latest, "id", "left").where(F.col("_at").isNull() | ~hit).select(*v.columns)


def restore(spark: SparkSession, folder: str):
    """The graph of the newest backup chain, with its tags, declarations and lowest pins."""
    from strataspan.graph import Graph

    first, *rest = backup_chain(spark, folder)
    tables = {kind: spark.read.parquet(f"{folder}/{first}/{kind}s") for kind in ("node", "rel")}
    for name in rest:
        held = Folder(spark, f"{folder}/{name}").names()
        for kind, v in tables.items():
            if f"removed-{kind}" in held:
                v = without_removed(v, spark.read.parquet(f"{folder}/{name}/removed-{kind}"))
            tables[kind] = merge(v, spark.read.schema(v.schema).parquet(f"{folder}/{name}/{kind}s"))
    last = (rest or [first])[-1]
    m = json.loads(Folder(spark, f"{folder}/{last}").read_text("manifest"))
    g = Graph(spark, tables["node"], tables["rel"], now=int(_BACKUP.match(last)[1]), has_voids=m["voids"])
    g.tags.update(m["tags"])
    g.indexes, g.watermark = declare(m["indexes"]), m["watermark"]
    g.stubs = {kind: spark.read.parquet(f"{folder}/{last}/stubs-{kind}") for kind in m["stubs"]}
    return g
