"""A replica: version rows with log numbers are put into a graph's tables, each number once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.plans.lineage import checkpointed


class Replica:
    """`applied` is the highest number that was applied; records at or below it are skipped, so a batch that comes twice is as once.
    It has to be kept together with the tables (`changes.export` does, for a graph with `applied_lsn`)."""

    def __init__(self, graph) -> None:
        self.graph = graph

    @property
    def applied(self) -> int:
        return self.graph.applied_lsn

    @applied.setter
    def applied(self, lsn: int) -> None:
        if lsn < self.graph.applied_lsn:
            raise ValueError(f"{lsn} is below what was applied, {self.graph.applied_lsn}")
        self.graph.applied_lsn = lsn

    def apply(self, nodes: DataFrame | None = None, rels: DataFrame | None = None) -> int:
        """Put records (lsn and the columns of a version row) into the tables: of several records of a version the last counts, and it
        replaces the stored row whole. Both kinds share one sequence of numbers. Returns the number reached."""
        top, tables = self.applied, {}
        for kind, records in (("node", nodes), ("rel", rels)):
            if records is None:
                continue
            stored = getattr(self.graph, f"{kind}_versions")
            fresh = records.where(F.col("lsn") > self.applied)
            high = fresh.agg(F.max("lsn")).first()[0]
            if high is None:
                continue
            row = [c for c in stored.columns if c not in ("id", "version")]
            last = fresh.groupBy("id", "version").agg(F.max_by(F.struct(*row), "lsn").alias("r")).select("id", "version", *[F.col("r")[c].alias(c) for c in row])
            rest = stored.join(last.select("id", "version"), ["id", "version"], "left_anti")
            tables[kind], top = checkpointed(rest.select(*stored.columns).unionByName(last)), max(top, high)
        for kind, table in tables.items():  # all or none: nothing above changes the graph
            setattr(self.graph, f"{kind}_versions", table)
            stamp = table.agg(F.max(F.greatest("tx_from", "tx_to", "deleted_at"))).first()[0]
            self.graph.advance_clock(stamp or 0)
        self.applied = top
        return top

    def on_batch(self, kind: str = "node") -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of records of one kind (`watch.apply_changes`)."""
        return lambda df, _: self.apply(**{f"{kind}s": df}) and None
