"""What indexes are declared. None changes an answer but an elements index, which turns equality into list membership; physically
a declaration says how tables are laid out when they are written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.functions import values as V
from strataspan.plans import kernels as K


@dataclass
class Indexes:
    properties: dict[tuple[str, str, str], dict] = field(default_factory=dict)
    composites: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    temporal: set[tuple[str, str]] = field(default_factory=set)
    vectors: dict[tuple[str, str], dict] = field(default_factory=dict)
    frequent: dict[str, int] = field(default_factory=dict)
    providers: dict[str, object] = field(default_factory=dict)
    epoch: int = 0

    def create_property(self, kind: str, name: str, key: str, range_counts: bool = False, elements: bool = False) -> None:
        self.properties[kind, name, key] = {"range_counts": range_counts, "elements": elements}
        self.epoch += 1

    def delete_property(self, kind: str, name: str, key: str) -> None:
        self.properties.pop((kind, name, key), None)
        self.epoch += 1

    def has_property(self, kind: str, name: str, key: str) -> bool:
        return (kind, name, key) in self.properties

    def has_elements(self, kind: str, name: str | None, key: str) -> bool:
        return self.properties.get((kind, name, key), {}).get("elements", False)

    def create_composite(self, label: str, keys: list[str]) -> None:
        if not 2 <= len(set(keys)) == len(keys) <= 4:
            raise ValueError("a composite index has two to four different keys")
        self.composites.setdefault(label, []).append(tuple(keys))
        self.epoch += 1

    def delete_composite(self, label: str, keys: list[str]) -> None:
        self.composites[label] = [k for k in self.composites.get(label, []) if k != tuple(keys)]
        self.epoch += 1

    def create_temporal(self, kind: str, name: str) -> None:
        self.temporal.add((kind, name))
        self.epoch += 1

    def delete_temporal(self, kind: str, name: str) -> None:
        self.temporal.discard((kind, name))
        self.epoch += 1

    def create_high_frequency(self, label: str, bucket_ms: int) -> None:
        self.frequent[label] = bucket_ms
        self.epoch += 1

    def create_vector(self, label: str, key: str, dims: int, metric: str = "cosine") -> None:
        if metric not in ("cosine", "l2") or dims < 1:
            raise ValueError("metric cosine or l2, dims positive")
        self.vectors[label, key] = {"dims": dims, "metric": metric}
        self.epoch += 1

    def delete_vector(self, label: str, key: str) -> None:
        self.vectors.pop((label, key), None)
        self.epoch += 1


def envelopes(v: DataFrame) -> DataFrame:
    """id, env_from, env_to: the hull of each chain's intervals, by which a scan for an instant or interval can leave chains out."""
    return v.groupBy("id").agg(F.min("s").alias("env_from"), F.max("e").alias("env_to"))


def pruned(v: DataFrame, a: int, b: int) -> DataFrame:
    """v without the chains whose envelope does not meet [a, b): never changes what resolves there."""
    hull = v.withColumn("_from", F.min("s").over(K.chain())).withColumn("_to", F.max("e").over(K.chain()))
    return hull.where((F.col("_from") < b) & ((F.col("_to") == V.INF) | (F.col("_to") > a))).drop("_from", "_to")


def high_frequency(v: DataFrame, bucket_ms: int) -> DataFrame:
    """v with the time bucket of each version's start, to partition a table by."""
    return v.withColumn("bucket", F.floor(F.col("s") / bucket_ms))


def postings(rows: DataFrame, key: str) -> DataFrame:
    """key, rows: how many entities each index key lists; a list's elements each list it once."""
    v = F.col("props")[key]
    keys = F.coalesce(F.array_distinct(v["arr"]), F.array(V.idxkey(v)))
    return rows.select(F.explode(keys).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
