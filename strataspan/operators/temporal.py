"""Temporal doors: points, intervals, Allen relations, effective timelines, snapshots and differences."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.errors import InvalidTimeRange, OpenInterval
from strataspan.functions import values as V
from strataspan.functions.allen import relation
from strataspan.operators.integrity import content_hash
from strataspan.plans import kernels as K


def meets_window(window: list[tuple[int, int]]) -> Column:
    """Whether a segment meets one of the intervals (ascending, disjoint, half open)."""
    if any(a >= b for a, b in window) or any(p[1] > q[0] for p, q in zip(window, window[1:])):
        raise InvalidTimeRange("a window is of ascending, disjoint, non-empty intervals")
    out = F.lit(False)
    for a, b in window:
        out = out | K.meets(a, b, "from", "to")
    return out


class Temporal:
    def __init__(self, graph) -> None:
        self.graph = graph

    def _v(self, kind: str, pin: int = 0, ids: list[int] | None = None) -> DataFrame:
        """The version table, for a read at a pin of the ids (None: any); refused where the pin can't be answered any more."""
        self.graph.answerable(kind, pin, ids)
        return self.graph.node_versions if kind == "node" else self.graph.rel_versions

    def _end(self, a: int, b: int) -> int:
        if b and a >= b:
            raise InvalidTimeRange(f"[{a}, {b})")
        return b or self.graph.now + 1

    def at(self, t: int, pin: int = 0, kind: str = "node") -> DataFrame:
        """As declared: a relationship counts whether or not its ends are valid."""
        return K.at(self._v(kind, pin), t, pin)

    def at_by_ids(self, ids: list[int], t: int, pin: int = 0, kind: str = "node") -> DataFrame:
        """A row an id, in the list's order, null where there is nothing."""
        entities = self.graph.nodes if kind == "node" else self.graph.rels
        wanted = entities._ids(ids)
        rows = K.at(self._v(kind, pin, ids).join(wanted.select("id").distinct(), "id", "left_semi"), t, pin)
        return wanted.join(rows, "id", "left").orderBy("pos")

    def as_of(self, pin: int, kind: str = "node") -> DataFrame:
        return K.as_of(self._v(kind, pin), pin)

    def during(self, a: int, b: int, pin: int = 0, predicate: Column | None = None, kind: str = "node") -> DataFrame:
        return K.during(self._v(kind, pin), a, self._end(a, b), pin, predicate, self.graph.has_voids)

    def relating(self, a: int, b: int, relations: set[str], kind: str = "node") -> DataFrame:
        if not a or b and a >= b:
            raise InvalidTimeRange(f"[{a}, {b})")
        return K.relating(self._v(kind), a, b, relations, 0, self.graph.has_voids)

    def neighbours_at(self, node_id: int, t: int) -> DataFrame:
        """The distinct nodes at the other end of the relationships of a node, all valid at t."""
        edges = self.graph.rels.effective_at(t)
        near = edges.where(F.col("start_id") == node_id).select(F.col("end_id").alias("id")).union(edges.where(F.col("end_id") == node_id).select("start_id"))
        return K.at(self._v("node"), t).join(near.distinct(), "id", "left_semi")

    def rels_at_node(self, node_id: int, t: int, incoming: bool = False) -> DataFrame:
        return self.graph.rels.effective_at(t).where(F.col("end_id" if incoming else "start_id") == node_id)

    # effective timelines

    def effective(self, pin: int = 0, kind: str = "node", names: list[str] | None = None) -> DataFrame:
        """Segments (from, to, row); with names, those whose row carries one of the labels or types."""
        out = K.segments(self._v(kind, pin), pin)
        if names is None:
            return out
        return out.where(F.arrays_overlap("labels", F.array(*map(F.lit, names))) if kind == "node" else F.col("type").isin(*names))

    def timeline(self, id_: int, pin: int = 0, kind: str = "node", valid_from: int | None = None) -> DataFrame:
        segs = K.segments(self._v(kind, pin, [id_]).where(F.col("id") == id_), pin)
        return (segs if valid_from is None else segs.where(F.col("to") >= valid_from)).orderBy("from")

    def timelines_by_ids(self, ids: list[int], pin: int = 0, kind: str = "node") -> DataFrame:
        """The segments of each id of the list with its `pos`; an id without any has one row of nulls. The list chooses whole chains first."""
        entities = self.graph.nodes if kind == "node" else self.graph.rels
        wanted = entities._ids(ids)
        segs = K.segments(self._v(kind, pin, ids).join(wanted.select("id").distinct(), "id", "left_semi"), pin)
        return wanted.join(segs, "id", "left").orderBy("pos", "from")

    def timelines(self, id_: int, pins: list[int], kind: str = "node") -> DataFrame:
        """The timeline at each of the caller's pins, aligned by `pin_pos`."""
        out = [K.segments(self._v(kind, p, [id_]).where(F.col("id") == id_), p).withColumn("pin_pos", F.lit(i)) for i, p in enumerate(pins)]
        first, *rest = out
        for d in rest:
            first = first.unionByName(d)
        return first.orderBy("pin_pos", "from")

    def effective_from(self, names: list[str], pin: int, valid_from: int, kind: str = "node") -> DataFrame:
        """All segments of the names, of the entities of which one such segment ends at or after valid_from."""
        segs = self.effective(pin, kind, names)
        return segs.withColumn("_late", F.max(F.col("to") >= valid_from).over(K.chain())).where("_late").drop("_late")

    def effective_in(self, names: list[str], pin: int, window: list[tuple[int, int]], kind: str = "node") -> DataFrame:
        return self.effective(pin, kind, names).where(meets_window(window))

    def rels_effective_at_nodes(self, ids: list[int], direction: str = "both", types: list[str] | None = None, pin: int = 0, window: list[tuple[int, int]] | None = None) -> DataFrame:
        """Relationship segments at seed nodes; the seeds choose whole chains before anything is resolved."""
        ends = {"out": ["start_id"], "in": ["end_id"], "both": ["start_id", "end_id"]}[direction]
        v, seeds = self._v("rel", pin), self.graph.rels._ids(ids).select("id").distinct()
        v = v if types is None else v.where(F.col("type").isin(*types))
        hit = v.where(F.lit(False)).select("id")
        for end in ends:
            hit = hit.union(v.join(seeds.withColumnRenamed("id", end), end, "left_semi").select("id"))
        segs = K.segments(v.join(hit.distinct(), "id", "left_semi"), pin)
        return segs if window is None else segs.where(meets_window(window))

    def effective_page(self, pin: int, name: str, key: str, value: Any, after: int | None, limit: int, window: tuple[int, int] | None = None, kind: str = "node") -> tuple[DataFrame, int | None]:
        """(segments with the value, of the next `limit` ids; the id to go on after, None at the end)."""
        entities = self.graph.nodes if kind == "node" else self.graph.rels
        segs = K.segments(self._v(kind, pin), pin).where(entities.member(name) & entities.equals(name, key, value))
        segs = segs if window is None else segs.where(K.meets(window[0], window[1], "from", "to"))
        ids = segs.select("id").distinct()
        ids = ids if after is None else ids.where(F.col("id") > after)
        page = [r["id"] for r in ids.orderBy("id").limit(limit).collect()]
        if not page:
            return segs.where(F.lit(False)), None
        low = F.lit(True) if after is None else F.col("id") > after
        return segs.where(low & (F.col("id") <= page[-1])), page[-1] if len(page) == limit else None

    def effective_page_by_properties(self, name: str, values: dict[str, Any], pin: int, after: int | None, limit: int) -> tuple[DataFrame, int | None]:
        """A page of the nodes whose CURRENT row matches, each with its timeline (maybe empty: nulls)."""
        from strataspan.plans.opts import QueryOpts

        ids = self.graph.nodes.by_properties(name, values, QueryOpts(after=after, limit=limit)).select("id")
        last = ids.agg(F.max("id"), F.count(F.lit(1))).first()
        segs = K.segments(self._v("node", pin).join(ids, "id", "left_semi"), pin)
        return ids.join(segs, "id", "left"), last[0] if last[1] == limit else None

    def tuple_timelines(self, type_name: str, keys: list[str], tuples: list[tuple], pin: int = 0) -> DataFrame:
        """For each tuple (`pos`), the segments of the type's relationships whose row carries all the keys' values: a join on keys."""
        keyed = [(i, *map(V.key_of, t)) for i, t in enumerate(tuples)]
        names = [f"_k{i}" for i in range(len(keys))]
        wanted = self.graph.spark.createDataFrame(keyed, "pos int, " + ", ".join(f"{n} string" for n in names))
        segs = self.effective(pin, "rel", [type_name]).withColumns({n: V.eqkey(F.col("props")[k]) for n, k in zip(names, keys, strict=True)})
        return segs.join(wanted, names).drop(*names)

    # snapshots

    def snapshot(self, t: int) -> tuple[DataFrame, DataFrame]:
        return K.at(self._v("node"), t), self.graph.rels.effective_at(t)

    def diff(self, t1: int, t2: int, kind: str = "node") -> DataFrame:
        """id, change (created, updated, deleted) between two instants; updated where the content's hash differs."""
        if not t1 or not t2 or t1 >= t2:
            raise InvalidTimeRange(f"{t1}, {t2}")
        state = (lambda t: K.at(self._v("node"), t)) if kind == "node" else self.graph.rels.effective_at
        a, b = (state(t).select("id", content_hash(kind).alias(f"h{i}")) for i, t in enumerate((t1, t2)))
        change = F.when(F.col("h0").isNull(), "created").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "updated")
        return a.join(b, "id", "full").select("id", change.alias("change")).where(F.col("change").isNotNull())

    def interval(self, row) -> tuple[int, int]:
        if row["e"] == V.INF:
            raise OpenInterval(str(row["id"]))
        return row["s"], row["e"]

    def relate(self, x, y) -> str | None:
        return relation(*self.interval(x), *self.interval(y))

    # named pins

    def tag(self, name: str, at: int) -> None:
        if not name or len(name.encode()) > 256 or name not in self.graph.tags and len(self.graph.tags) >= 4096:
            raise ValueError("a tag has 1 to 256 bytes, and there are 4096 at most")
        self.graph.tags[name] = at

    def resolve_tag(self, name: str) -> int | None:
        return self.graph.tags.get(name)

    def remove_tag(self, name: str) -> None:
        self.graph.tags.pop(name, None)
