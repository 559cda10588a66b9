"""Planner statistics over current rows, or over every row recorded at a pin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.functions import values as V
from strataspan.plans import kernels as K
from strataspan.plans.opts import CURRENT, QueryOpts

CLASSES = ["Numeric", "NaN", "String", "Bool", "Other", "Missing"]
#: Relative error of a sketch of 2^14 registers.
NDV_ERROR = 0.0081


class Stats:
    def __init__(self, graph) -> None:
        self.graph = graph

    def _of(self, kind: str):
        return self.graph.nodes if kind == "node" else self.graph.rels

    def _rows(self, name: str, kind: str, pin: int = 0) -> DataFrame:
        e = self._of(kind)
        rows = e.versions.where("is_current") if not pin else K.any_version(e.versions, pin, self.graph.has_voids).drop("parts")
        return rows.where(e.member(name))

    def get(self) -> DataFrame:
        """nodes, rels, node_history, rel_history in one row."""
        n = self.graph.node_versions.agg(F.count_if("is_current").alias("nodes"), F.count_if(~F.col("is_current")).alias("node_history"))
        r = self.graph.rel_versions.agg(F.count_if("is_current").alias("rels"), F.count_if(~F.col("is_current")).alias("rel_history"))
        return n.crossJoin(r)  # one row each

    def label_counts(self) -> DataFrame:
        return self.graph.node_versions.where("is_current").select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def type_counts(self) -> DataFrame:
        return self.graph.rel_versions.where("is_current").groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def history_counts(self) -> DataFrame:
        """kind, n: rows that are not current."""
        rows = lambda v, kind: v.where("not is_current").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        return rows(self.graph.node_versions, "node").unionByName(rows(self.graph.rel_versions, "rel"))

    def rel_history_by_type(self) -> DataFrame:
        return self.graph.rel_versions.where("not is_current").groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def count_with_key(self, name: str, key: str, kind: str = "node") -> int:
        return self._rows(name, kind).where(V.idxkey(F.col("props")[key]).isNotNull()).count()

    def class_counts(self, name: str, key: str, kind: str = "node", pin: int = 0) -> DataFrame:
        c = V.cls(F.col("props")[key])
        return self._rows(name, kind, pin).agg(*[F.count_if(c == x).alias(x.lower()) for x in CLASSES])

    def property_stats(self, name: str, key: str, kind: str = "node") -> DataFrame:
        """ndv (approximate), min, max (numbers), min_s, max_s (strings), n: of indexable values."""
        v = F.col("props")[key]
        number, string = V.num(v), F.when(v["t"] == "s", v["s"])
        return self._rows(name, kind).agg(
            F.approx_count_distinct(V.idxkey(v), NDV_ERROR).alias("ndv"), F.min(number).alias("min"), F.max(number).alias("max"), F.min(string).alias("min_s"), F.max(string).alias("max_s"), F.count(V.idxkey(v)).alias("n")
        )

    def ndv(self, name: str, key: str, kind: str = "node") -> DataFrame:
        v = V.idxkey(F.col("props")[key])
        return self._rows(name, kind).agg(F.approx_count_distinct(v, NDV_ERROR).alias("ndv"), F.count(v).alias("n"))

    def ndv_sketch(self, name: str, key: str, kind: str = "node") -> DataFrame:
        """A sketch that `hll_union_agg` merges with others."""
        return self._rows(name, kind).agg(F.hll_sketch_agg(V.idxkey(F.col("props")[key]), 14).alias("sketch"))

    def bounds(self, name: str, key: str, kind: str = "node", opts: QueryOpts = CURRENT) -> DataFrame:
        """min, max of the numbers, the stored key of each bound (of equal ones the least), and the classes' counts."""
        v = F.col("props")[key]
        n, c = V.num(v), V.cls(v)
        return self._of(kind).by_name(name, opts).agg(
            F.min(n).alias("min"),
            F.max(n).alias("max"),
            F.min_by(V.idxkey(v), F.when(n.isNotNull(), F.struct(n.alias("n"), V.idxkey(v).alias("k")))).alias("min_key"),
            F.max_by(V.idxkey(v), F.when(n.isNotNull(), F.struct(n.alias("n"), V.idxkey(v).alias("k")))).alias("max_key"),
            *[F.count_if(c == x).alias(x.lower()) for x in CLASSES],
        )

    def value_stats(self, name: str, key: str, kind: str = "node", pin: int = 0) -> DataFrame:
        """distinct, rows, max_rows, max_value by stored width (ties: the least key). With a pin a member counts once a version. A value
        is counted where it lies before the counts are shuffled, so a hot one costs a row a task."""
        k = V.idxkey(F.col("props")[key])
        counts = self._rows(name, kind, pin).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is not null")
        return counts.agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"), F.max("n").alias("max_rows"), F.min_by("k", F.struct((-F.col("n")).alias("n"), "k")).alias("max_value"))

    def time_stats(self, kind: str = "node") -> DataFrame:
        """name, members, explicit_valid (with a start or an end of their own), last_ended: over all that were ever members."""
        v = self._of(kind).versions
        named = v.select("*", F.explode(F.array_distinct("labels")).alias("name")) if kind == "node" else v.withColumn("name", F.col("type"))
        claimed = (F.col("s") != V.NEG) | (F.col("e") != V.INF)
        by_id = named.groupBy("name", "id").agg(F.max("is_current").alias("now"), F.max(F.col("is_current") & claimed).alias("explicit"), F.max(F.greatest("tx_to", "deleted_at")).alias("ended"))
        return by_id.groupBy("name").agg(F.count_if("now").alias("members"), F.count_if("explicit").alias("explicit_valid"), F.max("ended").alias("last_ended"))
