"""Transactions, ingest sessions, id minting, constraint registry and half edges: the driver-side state around set-based writes."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.errors import ConstraintViolation, UniqueViolation
from strataspan.functions.calendar import EPOCH_2026
from strataspan.plans.lineage import checkpointed
from strataspan.operators import constraints, writes


class Transaction:
    """Writes on a graph that become its state on commit, or leave no trace. Reads inside go through `graph` as everywhere.

    with Transaction(graph) as tx: tx.write(writes.update, changes)
    """

    def __init__(self, graph) -> None:
        self.graph = graph
        self._before: tuple | None = None
        self.start: int | None = None

    def __enter__(self) -> Transaction:
        g = self.graph
        self._before = (g.node_versions, g.rel_versions, g._now, g.epoch, g.has_voids, dict(g.tags))
        self.start = g.now
        return self

    def write(self, op, changes: DataFrame, kind: str = "node", tx: int | None = None, **more) -> None:
        self.graph.write(op, changes, tx, kind, **more)

    def created(self, kind: str = "node") -> DataFrame:
        """id of what the transaction added."""
        v = self.graph.node_versions if kind == "node" else self.graph.rel_versions
        return v.where((F.col("tx_from") > self.start) & (F.col("version") == 0)).select("id")

    def rollback(self) -> None:
        g = self.graph
        g.node_versions, g.rel_versions, g._now, g.epoch, g.has_voids, g.tags = self._before

    def __exit__(self, kind, error, trace) -> bool:
        if kind is not None:
            self.rollback()
        elif getattr(self.graph, "registry", None) is not None:
            try:
                self.graph.registry.enforce(self.graph)
            except Exception:
                self.rollback()
                raise
        return False


@dataclass
class Session:
    """An ingest session: writes are queued, checked when submitted, and applied in order by one committer; tokens count what is applied."""

    graph: object
    queue: list = field(default_factory=list)
    applied: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def add(self, op, changes: DataFrame, kind: str = "node") -> None:
        self.queue.append((op, changes, kind))

    @property
    def pending(self) -> int:
        return len(self.queue)

    def submit(self) -> int:
        with self._lock:
            ops = list(self.queue)
            with Transaction(self.graph) as tx:
                for op, changes, kind in ops:
                    tx.write(op, changes, kind)
            del self.queue[: len(ops)]  # what fails stays queued
            self.applied += 1
            return self.applied

    def wait_applied(self, token: int) -> None:
        if token > self.applied:
            raise ValueError(f"{token} was never submitted")


class IdMinter:
    """63-bit ids: 48 bits of microseconds since 2026, 5 of node, 10 of step; ascending, without a write."""

    def __init__(self, node: int = 0, clock=lambda: int(time.time() * 1_000_000)) -> None:
        if not 0 <= node < 32:
            raise ValueError("a node is 0 to 31")
        self.node, self.clock, self._last, self._step = node, clock, -1, 0
        self._lock = threading.Lock()

    def next_id(self) -> int:
        with self._lock:
            t = max(self.clock() - EPOCH_2026 * 1000, self._last)
            self._step = self._step + 1 if t == self._last else 0
            if self._step == 1024:
                t, self._step = t + 1, 0
            self._last = t
            return t << 15 | self.node << 10 | self._step

    def column(self, df: DataFrame, name: str = "id") -> DataFrame:
        """df with a minted id a row, from a reserved block of one microsecond a row: rows are numbered exactly, by their partitions' sizes, and later ids come after the block."""
        row = "_minted"
        held = checkpointed(df.withColumn(row, F.monotonically_increasing_id()))
        sizes = {r["p"]: r["n"] for r in held.groupBy(F.shiftright(row, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
        offsets, total = [], 0
        for p in range(max(sizes, default=0) + 1):
            offsets.append(total)
            total += sizes.get(p, 0)
        with self._lock:
            base = max(self.clock() - EPOCH_2026 * 1000, self._last + 1)
            self._last, self._step = base + total, 0
        number = F.array(*[F.lit(o).cast("bigint") for o in offsets])[F.shiftright(row, 33).cast("int")] + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
        return held.withColumn(name, F.shiftleft(F.lit(base).cast("bigint") + number, 15) + self.node * 1024).drop(row)


@dataclass
class Registry:
    """Declared constraints; `enforce` is what a commit runs."""

    unique: set[tuple[str, str]] = field(default_factory=set)
    forever: set[tuple[str, str]] = field(default_factory=set)
    within_endpoints: bool = False

    def create_unique(self, graph, label: str, key: str, forever: bool = False) -> None:
        found = (constraints.forever_violations if forever else constraints.unique_violations)(graph.node_versions, label, key)
        if not found.isEmpty():
            raise UniqueViolation(f"{label}.{key}: {found.first()['key']}")
        (self.forever if forever else self.unique).add((label, key))

    def drop_unique(self, label: str, key: str) -> None:
        self.unique.discard((label, key))
        self.forever.discard((label, key))

    def enforce(self, graph) -> None:
        for label, key in sorted(self.unique):
            if row := constraints.unique_violations(graph.node_versions, label, key).first():
                raise UniqueViolation(f"{label}.{key}: {row['key']}")
        for label, key in sorted(self.forever):
            if row := constraints.forever_violations(graph.node_versions, label, key).first():
                raise UniqueViolation(f"{label}.{key}: {row['key']} belongs to {row['owner']}")
        if self.within_endpoints and (row := constraints.outside_endpoints(graph.node_versions, graph.rel_versions).first()):
            raise ConstraintViolation(f"relationship {row['id']} is outside its {row['side']}")


def add_half_edges(rels: DataFrame, new: DataFrame, tx: int, side: str = "end") -> DataFrame:
    """Append relationships of which one end is a node of another graph: flagged, and never checked or masked against local nodes."""
    flagged = new.withColumn("props", F.map_concat("props", F.create_map(F.lit(f"{side}_foreign"), _true())))
    return writes.add(rels, flagged, tx)


def _true():
    from strataspan.functions import values as V

    return V.boolean(F.lit(True))
