"""Relationships: adjacency, degrees, and the effective rule that an edge holds only while both its ends do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.operators.entities import Entities
from strataspan.plans import kernels as K
from strataspan.plans.opts import CURRENT, QueryOpts, resolve


class Rels(Entities):
    def __init__(self, graph) -> None:
        super().__init__(graph, "rel")

    def _side(self, incoming: bool) -> tuple[str, str]:
        return ("end_id", "start_id") if incoming else ("start_id", "end_id")

    def adjacent(self, seeds: DataFrame, type_name: str | None = None, incoming: bool = False, opts: QueryOpts = CURRENT) -> DataFrame:
        """The relationships at each seed (`seed`), as declared, with the node at the other end (`other`)."""
        near, far = self._side(incoming)
        predicate = None if type_name is None else self.member(type_name)
        self.graph.answerable("rel", opts.tx_pin or opts.tx_at)
        rows = resolve(self.versions, opts, self.graph.now, predicate, self.graph.has_voids)
        return rows.join(seeds.select(F.col("id").alias("seed")).distinct(), rows[near] == F.col("seed")).withColumn("other", F.col(far))

    def outgoing(self, node_id: int, type_name: str | None = None, opts: QueryOpts = CURRENT) -> DataFrame:
        return self._of(node_id, type_name, False, opts)

    def incoming(self, node_id: int, type_name: str | None = None, opts: QueryOpts = CURRENT) -> DataFrame:
        return self._of(node_id, type_name, True, opts)

    def _of(self, node_id: int, type_name: str | None, incoming: bool, opts: QueryOpts) -> DataFrame:
        at = F.col(self._side(incoming)[0]) == node_id
        return self._resolve(opts, at if type_name is None else at & self.member(type_name))

    def for_nodes(self, ids: list[int], type_name: str | None = None, incoming: bool = False, pin: int | None = None, tx_at: int | None = None) -> DataFrame:
        """`adjacent` for a list of ids: current; as recorded by a pin whatever its validity; or recorded by tx_at and valid now."""
        return self.adjacent(self._ids(ids), type_name, incoming, QueryOpts(tx_pin=pin, tx_at=tx_at))

    def endpoints(self, node_id: int, type_name: str | None = None, incoming: bool = False, opts: QueryOpts = CURRENT) -> DataFrame:
        """(id, other) without the rows."""
        return self._of(node_id, type_name, incoming, opts).select("id", F.col(self._side(incoming)[1]).alias("other"))

    def degrees(self, type_name: str | None = None, incoming: bool = False) -> DataFrame:
        """node, degree of every node with a current relationship."""
        rows = self.versions.where("is_current")
        rows = rows if type_name is None else rows.where(self.member(type_name))
        return rows.groupBy(F.col(self._side(incoming)[0]).alias("node")).agg(F.count(F.lit(1)).alias("degree"))

    def degree_stats(self, type_name: str) -> DataFrame:
        """rels, starts, ends, max_out, max_out_node, max_in, max_in_node (the least node at each maximum)."""
        out, into = self.degrees(type_name), self.degrees(type_name, True)
        top = lambda d, name: d.agg(F.count(F.lit(1)).alias(f"{name}s"), F.sum("degree").alias("rels"), F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("m"))
        a, b = top(out, "start"), top(into, "end").drop("rels")
        return a.select("rels", "starts", F.col("m.degree").alias("max_out"), (-F.col("m.node")).alias("max_out_node")).crossJoin(
            b.select("ends", F.col("m.degree").alias("max_in"), (-F.col("m.node")).alias("max_in_node"))
        )  # one row each

    def masked(self, rels: DataFrame, t: int, pin: int = 0) -> DataFrame:
        """The relationships whose ends are both valid at t; an end in another graph (see `sessions.add_half_edges`) is not asked about."""
        nodes = K.at(self.graph.node_versions, t, pin).select("id")
        for side in ("start", "end"):
            foreign = F.coalesce(F.col("props")[f"{side}_foreign"].isNotNull(), F.lit(False))
            live = nodes.select(F.col("id").alias("_live"))
            rels = rels.join(live, F.col(f"{side}_id") == F.col("_live"), "left").where(foreign | F.col("_live").isNotNull()).drop("_live")
        return rels

    def effective_at(self, t: int, pin: int = 0) -> DataFrame:
        self.graph.answerable("rel", pin)
        self.graph.answerable("node", pin)
        return self.masked(K.at(self.versions, t, pin), t, pin)

    def two_hop(self, seeds: DataFrame, type_name: str) -> DataFrame:
        """seed, far: distinct nodes two current relationships of the type away."""
        edges = self.versions.where("is_current").where(self.member(type_name)).select("start_id", "end_id")
        first = edges.join(seeds.select(F.col("id").alias("start_id")), "start_id").select(F.col("start_id").alias("seed"), F.col("end_id").alias("mid"))
        return first.join(edges, first["mid"] == edges["start_id"]).select("seed", F.col("end_id").alias("far")).distinct()
