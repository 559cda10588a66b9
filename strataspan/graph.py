"""The graph: two version tables, a clock, and the doors to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.errors import PinTooOld
from strataspan.operators import admin, constraints, integrity, writes
from strataspan.operators.entities import Entities
from strataspan.operators.index import Indexes
from strataspan.operators.rels import Rels
from strataspan.operators.stats import Stats
from strataspan.operators.temporal import Temporal
from strataspan.plans import kernels as K
from strataspan.plans.lineage import checkpointed
from strataspan.sources import changes, fixtures


class Graph:
    """A snapshot of the tables; a write replaces a table by the next one. has_voids False says that no row is void, which spares
    interval reads the search for void spans."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, rels: DataFrame | Callable[[], DataFrame] | None = None, now: int | None = None, has_voids: bool = True) -> None:
        self.spark = spark
        self.node_versions = nodes
        self._rels = rels
        self.has_voids = has_voids
        self.tags: dict[str, int] = {}
        self.indexes = Indexes()
        self.epoch = 0
        self._now = now
        #: What was removed for good, by kind: entities whose old pins can't be answered any more (id, low_pin), the highest such pin, and
        #: the rows that are gone (id, up_to: their highest version, at: the clock then).
        self.stubs: dict[str, DataFrame] = {}
        self.watermark = {"node": 0, "rel": 0}
        self.removed: dict[str, DataFrame] = {}
        self.applied_lsn = 0  # of a replica
        self.nodes, self.rels = Entities(self, "node"), Rels(self)
        self.temporal, self.stats = Temporal(self), Stats(self)

    @property
    def rel_versions(self) -> DataFrame:
        """The relationships; made when they are first asked for, where the graph was given a function."""
        if callable(self._rels):
            self._rels = self._rels()
        if self._rels is None:
            ends = {"type": F.lit(""), "start_id": F.lit(0).cast("bigint"), "end_id": F.lit(0).cast("bigint")}
            self._rels = self.node_versions.drop("labels").withColumns(ends).where(F.lit(False))
        return self._rels

    @rel_versions.setter
    def rel_versions(self, rels: DataFrame) -> None:
        self._rels = rels

    @property
    def now(self) -> int:
        """The clock: the last transaction instant, at least the latest in the tables."""
        if self._now is None:
            top = lambda v: v.agg(F.max(F.greatest("tx_from", "tx_to", "deleted_at"))).first()[0] or 0
            self._now = max(top(self.node_versions), top(self.rel_versions))
        return self._now

    def advance_clock(self, to: int) -> int:
        self._now = max(self.now, to)
        return self._now

    def _tick(self, tx: int | None) -> int:
        tx = self.now + 1 if tx is None else tx
        writes.check_clock(self.now, tx)
        self._now = tx
        self.epoch += 1
        return tx

    def answerable(self, kind: str, pin: int | None, ids: list[int] | None = None) -> None:
        """Refuse a pin (0 and None: all that is recorded) below what compaction and retention left: a read of given ids by their own lowest pins, any
        other by the highest of all, rather than answer it in part."""
        if not pin or pin >= self.watermark[kind]:
            return
        stubs = self.stubs.get(kind)
        if ids is not None and (stubs is None or stubs.where(F.col("id").isin([int(i) for i in ids]) & (F.col("low_pin") > pin)).isEmpty()):
            return
        raise PinTooOld(f"pin {pin} is below {self.watermark[kind]}")

    def _trim(self, kind: str, after: DataFrame) -> None:
        """Go on with `after`, and note the rows that it lacks."""
        name = f"{kind}_versions"
        keys = ["id", "version"]
        gone = getattr(self, name).select(*keys).join(after.select(*keys), keys, "left_anti")
        gone = checkpointed(gone.groupBy("id").agg(F.max("version").alias("up_to")).withColumn("at", F.lit(self.now).cast("bigint")))
        self.removed[kind] = gone if kind not in self.removed else self.removed[kind].unionByName(gone)
        setattr(self, name, after)

    def compact(self, keep_versions: int, keep_since: int, kind: str = "node") -> None:
        """Trim the oldest versions (`admin.compact`); reads at pins that needed them are refused from then on."""
        kept, stubs = admin.compact(getattr(self, f"{kind}_versions"), keep_versions, keep_since)
        found = stubs.select("id", "low_pin")
        found = found if kind not in self.stubs else found.unionByName(self.stubs[kind]).groupBy("id").agg(F.max("low_pin").alias("low_pin"))
        found = checkpointed(found)
        self._trim(kind, kept)
        self.stubs[kind] = found
        self.watermark[kind] = max(self.watermark[kind], found.agg(F.max("low_pin")).first()[0] or 0)

    def purge_expired(self, label: str, ended_before: int) -> None:
        """Remove the label's nodes that ended before an instant, and their relationships; scans at pins below that instant are refused."""
        nodes, rels = admin.purge_expired(self.node_versions, self.rel_versions, label, ended_before)
        for kind, after in (("rel", rels), ("node", nodes)):
            self._trim(kind, after)
            self.watermark[kind] = max(self.watermark[kind], ended_before)

    def purge_expired_rels(self, type_name: str, ended_before: int) -> None:
        self._trim("rel", admin.purge_expired_rels(self.rel_versions, type_name, ended_before))
        self.watermark["rel"] = max(self.watermark["rel"], ended_before)

    def erase(self, ids: DataFrame) -> DataFrame:
        """Remove every row of the nodes and of the relationships at them; the receipt (`admin.erasure`). Later backups carry the removal."""
        nodes, rels, receipt = admin.erasure(self.node_versions, self.rel_versions, ids)
        receipt = checkpointed(receipt)
        self._trim("rel", rels)
        self._trim("node", nodes)
        return receipt

    def write(self, op, changes_: DataFrame, tx: int | None = None, kind: str = "node", **more) -> None:
        """Apply one of the writes of `operators.writes` to a table at the next (or the given) transaction instant."""
        name = f"{kind}_versions"
        before = self._now, self.epoch
        stamp = self._tick(tx)
        try:
            after = op(getattr(self, name), changes_, stamp, **more)
            rels = writes.cascade(self.rel_versions, changes_, stamp, **more) if kind == "node" and op is writes.delete else None
        except Exception:
            self._now, self.epoch = before  # a refused write leaves the clock as it was
            raise
        if op in (writes.excise, writes.update_everywhere):
            self.has_voids = True
        setattr(self, name, after)
        if rels is not None:
            self.rel_versions = rels

    def compare_and_set(self, id_: int, key: str, expected, value=None, tx: int | None = None, kind: str = "node") -> bool:
        """Set or (value None) delete a property of a current row if it has the expected value (None: if it is absent); whether it was done."""
        name = f"{kind}_versions"
        before = self._now, self.epoch
        after, done = writes.compare_and_set(getattr(self, name), id_, key, expected, value, self._tick(tx))
        if done:
            setattr(self, name, after)
        else:
            self._now, self.epoch = before
        return done

    def batch(self, ops: list[tuple], tx: int | None = None) -> None:
        """Several writes, each (op, changes, kind), at ascending instants; all or none become the graph's tables."""
        before = (self.node_versions, self._rels, self._now, self.epoch, self.has_voids)
        try:
            for op, changed, kind in ops:
                self.write(op, changed, tx, kind)
                tx = None if tx is None else tx + 1
        except Exception:
            self.node_versions, self._rels, self._now, self.epoch, self.has_voids = before
            raise

    def add_rels(self, new: DataFrame, tx: int | None = None) -> None:
        """Add relationships; one with an end that is no current node is refused."""
        current = self.node_versions.where("is_current").select("id")
        for end in ("start_id", "end_id"):
            if not new.join(current.withColumnRenamed("id", end), end, "left_anti").isEmpty():
                from strataspan.errors import NotFound

                raise NotFound(f"a node of {end}")
        self.write(writes.add, new, tx, "rel")

    def commit(self, path: str) -> None:
        """Write the tables and go on from the files, so plans do not grow with the number of writes."""
        changes.export(self, f"{path}/epoch-{self.epoch}")
        self.node_versions = self.spark.read.parquet(f"{path}/epoch-{self.epoch}/nodes")
        self.rel_versions = self.spark.read.parquet(f"{path}/epoch-{self.epoch}/rels")

    def reset(self, allowed: bool = False) -> None:
        if not allowed:
            raise PermissionError("reset is not enabled")
        self.node_versions, self.rel_versions = self.node_versions.where(F.lit(False)), self.rel_versions.where(F.lit(False))
        self.tags.clear()
        self.stubs, self.removed, self.watermark = {}, {}, {"node": 0, "rel": 0}
        self.indexes = Indexes()

    @classmethod
    def star(cls, spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> Graph:
        rels = lambda: fixtures.star_rels(spark, sf_dir, types) if types else fixtures.star_rels(spark, sf_dir)
        return cls(spark, fixtures.star_nodes(spark, sf_dir), rels, now=2_000_000_000_000, has_voids=False)

    @classmethod
    def chains(cls, spark: SparkSession, sf_dir: str, variant: str = "b") -> Graph:
        return cls(spark, fixtures.chains(spark, sf_dir, variant), now=fixtures.probes(spark, sf_dir)["hi"] + 60_000, has_voids=variant == "d")


__all__ = ["Graph", "K", "admin", "constraints", "integrity"]
