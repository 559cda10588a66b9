"""What nodes and relationships have in common: scans, lookups, ranges, counts and chain navigation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from strataspan.errors import MixedNumericColumn, NotFound, TxPinUnsupported
from strataspan.functions import values as V
from strataspan.plans import kernels as K
from strataspan.plans.opts import CURRENT, QueryOpts, page, resolve


class Entities:
    """Reads over one version table. `member(name)` is the predicate of a label or a relationship type."""

    def __init__(self, graph, kind: str) -> None:
        self.graph, self.kind = graph, kind

    @property
    def versions(self) -> DataFrame:
        return self.graph.node_versions if self.kind == "node" else self.graph.rel_versions

    def member(self, name: str) -> Column:
        return F.array_contains("labels", name) if self.kind == "node" else F.col("type") == name

    def prop(self, key: str) -> Column:
        return F.col("props")[key]

    def equals(self, name: str | None, key: str, value: Any) -> Column:
        """Property equality; where an elements index is declared for (name, key), membership of a list too."""
        return V.equals(self.prop(key), value, self.graph.indexes.has_elements(self.kind, name, key))

    def _resolve(self, opts: QueryOpts, predicate: Column | None = None) -> DataFrame:
        self.graph.answerable(self.kind, opts.tx_pin or opts.tx_at)
        return page(resolve(self.versions, opts, self.graph.now, predicate, self.graph.has_voids), opts)

    def _ids(self, ids: list[int]) -> DataFrame:
        """A caller's own list of ids, with positions."""
        return self.graph.spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos int, id long")

    # scans

    def all(self, opts: QueryOpts = CURRENT) -> DataFrame:
        return self._resolve(opts)

    def by_name(self, name: str, opts: QueryOpts = CURRENT) -> DataFrame:
        return self._resolve(opts, self.member(name))

    def iterate(self, name: str | None = None, opts: QueryOpts = CURRENT) -> Iterator[Row]:
        """Rows by id, a partition at a time."""
        df = self.all(opts) if name is None else self.by_name(name, opts)
        return df.orderBy("id").toLocalIterator()

    def get(self, id_: int) -> Row:
        row = self.versions.where("is_current").where(F.col("id") == id_).first()
        if row is None:
            raise NotFound(f"{self.kind} {id_}")
        return row

    def get_by_ids(self, ids: list[int]) -> DataFrame:
        """Current rows by ascending id; an id without one is refused."""
        found = self.lend_by_ids(ids)
        missing = self._ids(ids).join(found.select("id"), "id", "left_anti").first()
        if missing:
            raise NotFound(f"{self.kind} {missing['id']}")
        return found.drop("pos").dropDuplicates(["id"]).orderBy("id")

    def lend_by_ids(self, ids: list[int]) -> DataFrame:
        """Current rows with the position of their id in the list; unknown ids are left out."""
        return self.versions.where("is_current").join(self._ids(ids), "id")

    def ordinals(self) -> DataFrame:
        """id and a dense number, from 0 by id, of every current row."""
        from strataspan.sources.fixtures import numbered

        return numbered(self.versions.where("is_current").select("id"), ["id"], "ordinal").withColumn("ordinal", F.col("ordinal") - 1)

    def max_ordinal(self) -> int:
        return self.count() - 1

    def by_ordinals(self, name: str, ordinals: list[int], opts: QueryOpts = CURRENT) -> DataFrame:
        wanted = self.graph.spark.createDataFrame([(int(o),) for o in ordinals], "ordinal long")
        return self.by_name(name, opts).join(self.ordinals().join(wanted, "ordinal"), "id", "left_semi")

    # equality

    def by_property(self, name: str, key: str, value: Any, opts: QueryOpts = CURRENT) -> DataFrame:
        return self._resolve(opts, self.member(name) & self.equals(name, key, value))

    def by_property_values(self, name: str, key: str, values: list[Any], opts: QueryOpts = CURRENT) -> DataFrame:
        """Each entity once that equals one of the values."""
        keys = [k for k in map(V.key_of, values) if k is not None]
        held = V.eqkey(self.prop(key)).isin(keys) if keys else F.lit(False)
        if keys and self.graph.indexes.has_elements(self.kind, name, key):
            held = held | F.arrays_overlap(self.prop(key)["arr"], F.array(*map(F.lit, keys)))
        return self._resolve(opts, self.member(name) & F.coalesce(held, F.lit(False)))

    def by_properties(self, name: str, values: dict[str, Any], opts: QueryOpts = CURRENT) -> DataFrame:
        predicate = self.member(name)
        for k, x in values.items():
            predicate = predicate & self.equals(name, k, x)
        return self._resolve(opts, predicate)

    def count_by_property(self, name: str, key: str, value: Any, opts: QueryOpts = CURRENT) -> tuple[int, bool]:
        return self.by_property(name, key, value, opts).count(), not opts.temporal

    # ranges and prefixes

    def in_range(self, name: str, key: str, low: float, high: float, include_low: bool = True, include_high: bool = True, opts: QueryOpts = CURRENT) -> DataFrame:
        return self._resolve(opts, self.member(name) & V.in_range(self.prop(key), low, high, include_low, include_high))

    def in_range_ordered(self, name: str, key: str, low: float, high: float, desc: bool = False, limit: int | None = None, opts: QueryOpts = CURRENT, include_low: bool = True, include_high: bool = True) -> DataFrame:
        """By value, ties by ascending id in both directions; a limit makes it a top list of each task, merged."""
        value = V.num(self.prop(key))
        out = self.in_range(name, key, low, high, include_low, include_high, opts).withColumn("value", value)
        out = out.orderBy(F.desc("value") if desc else F.asc("value"), F.asc("id"))
        return out if limit is None else out.limit(limit)

    def ids_in_range_ordered(self, name: str, key: str, low: float, high: float, desc: bool = False, limit: int | None = None, include_low: bool = True, include_high: bool = True) -> DataFrame:
        """(id, value) only, on current rows; only those columns are read."""
        return self.in_range_ordered(name, key, low, high, desc, limit, CURRENT, include_low, include_high).select("id", "value")

    def with_prefix(self, name: str, key: str, prefix: str, desc: bool = False, opts: QueryOpts = CURRENT, limit: int | None = None) -> DataFrame:
        value = self.prop(key)
        held = (value["t"] == "s") & value["s"].startswith(prefix)
        out = self._resolve(opts, self.member(name) & F.coalesce(held, F.lit(False))).withColumn("value", value["s"])
        out = out.orderBy(F.desc("value") if desc else F.asc("value"), F.asc("id"))
        return out if limit is None else out.limit(limit)

    def ids_with_prefix(self, name: str, key: str, prefix: str, desc: bool = False, limit: int | None = None) -> DataFrame:
        return self.with_prefix(name, key, prefix, desc, CURRENT, limit).select("id", "value")

    def range_cardinality(self, name: str, key: str, low: float, high: float, include_low: bool = True, include_high: bool = True, opts: QueryOpts = CURRENT) -> tuple[int, bool]:
        """(n, exact): of current rows; not exact where a temporal option is given."""
        if opts.temporal:
            return 0, False
        return self.in_range(name, key, low, high, include_low, include_high).count(), True

    def range_cardinality_at(self, name: str, key: str, low: float, high: float, opts: QueryOpts, include_low: bool = True, include_high: bool = True) -> tuple[int, bool]:
        """The count at a time; not exact without one, or with a NaN bound."""
        if not opts.temporal or low != low or high != high:
            return 0, False
        plain = QueryOpts(opts.valid_at, opts.during, opts.tx_at, opts.tx_pin)
        return self.in_range(name, key, low, high, include_low, include_high, plain).count(), True

    def any_version_in_range(self, name: str, key: str, low: float, high: float, pin: int = 0, include_low: bool = True, include_high: bool = True) -> DataFrame:
        """Every recorded row of an entity with the value in range."""
        rows = K.any_version(self.versions, pin, self.graph.has_voids).drop("parts")
        return rows.where(self.member(name) & V.in_range(self.prop(key), low, high, include_low, include_high))

    def in_range_any_version(self, name: str, key: str, low: float, high: float, pin: int = 0) -> DataFrame:
        """The newest such row of each entity."""
        return K._newest(self.any_version_in_range(name, key, low, high, pin))

    def range_cardinality_any_version(self, name: str, key: str, low: float, high: float, pin: int = 0) -> DataFrame:
        """entities, rows."""
        return self.any_version_in_range(name, key, low, high, pin).agg(F.count_distinct("id").alias("entities"), F.count(F.lit(1)).alias("rows"))

    # counts and timelines

    def count(self) -> int:
        return self.versions.where("is_current").count()

    def count_by_name(self, name: str, opts: QueryOpts = CURRENT) -> int:
        return self.by_name(name, opts).count()

    def count_timeline(self, name: str, pin: int = 0) -> DataFrame:
        return K.count_timeline(K.segments(self.versions, pin).where(self.member(name)))

    def valid_hull(self, name: str, pin: int = 0) -> DataFrame:
        """empty, from, to, open_end of all the members' segments."""
        segs = K.segments(self.versions, pin).where(self.member(name))
        return segs.agg((F.count(F.lit(1)) == 0).alias("empty"), F.min("from").alias("from"), F.max("to").alias("to"), F.coalesce(F.max(F.col("to") == V.INF), F.lit(False)).alias("open_end"))

    # columns

    def columns(self, names: list[str], keys: list[str], opts: QueryOpts = CURRENT) -> DataFrame:
        """id and each key's value (pv) of the members of all `names`."""
        predicate = F.lit(True)
        for n in names:
            predicate = predicate & self.member(n)
        return self._resolve(opts, predicate).select("id", *[self.prop(k).alias(k) for k in keys])

    def typed_columns(self, name: str, keys: list[str], opts: QueryOpts = CURRENT) -> DataFrame:
        """id and, for each key, one plain column of its family (integer, float, string or boolean), null where absent or of another
        kind (`<key>_other`). A column of both integers and floats is refused."""
        rows = self.columns([name], keys, opts)
        families = {"int": V.INTEGERS, "float": V.FLOATS, "str": ("s",), "bool": ("b",)}
        field = {"int": "l", "float": "d", "str": "s", "bool": "b"}
        counts = rows.agg(*[F.count_if(F.col(k)["t"].isin(*ts)).alias(f"{k}|{f}") for k in keys for f, ts in families.items()]).first()
        out = [F.col("id")]
        for k in keys:
            held = {f: counts[f"{k}|{f}"] for f in families}
            if held["int"] and held["float"]:
                raise MixedNumericColumn(k)
            f = max(held, key=held.get)
            of = F.col(k)["t"].isin(*families[f])
            out += [F.when(of, F.col(k)[field[f]]).alias(k), F.coalesce(~of, F.lit(False)).alias(f"{k}_other")]
        return rows.select(*out)

    def column_kind(self, name: str, key: str) -> str:
        """None, Numeric or String: what a column of the key would hold."""
        c = self.columns([name], [key]).agg(*[F.count_if(V.cls(F.col(key)) == x).alias(x) for x in ("Numeric", "String", "NaN", "Bool", "Other")]).first()
        if c["NaN"] or c["Bool"] or c["Other"] or bool(c["Numeric"]) == bool(c["String"]):
            return "None"
        return "Numeric" if c["Numeric"] else "String"

    # chains

    def history(self, id_: int | None = None) -> DataFrame:
        """Rows that are not current, by version."""
        rows = self.versions.where("not is_current")
        return rows if id_ is None else rows.where(F.col("id") == id_).orderBy("version")

    def has_history(self) -> DataFrame:
        """id, has_history of every entity."""
        return self.versions.groupBy("id").agg(F.coalesce(F.max(~F.col("is_current")), F.lit(False)).alias("has_history"))

    def latest_stamps(self) -> DataFrame:
        """id, tx_from, tx_to (or delete), deleted, of every entity."""
        return self.versions.groupBy("id").agg(F.max("tx_from").alias("tx_from"), F.max(F.greatest("tx_to", "deleted_at")).alias("tx_to"), (~F.max("is_current")).alias("deleted"))

    def neighbours_in_chain(self) -> DataFrame:
        """id, version, before, after: whether there is a row of exactly the version before (in history) and after."""
        w = Window.partitionBy("id").orderBy("version")
        before = (F.lag("version").over(w) == F.col("version") - 1) & ~F.lag("is_current").over(w)
        after = F.lead("version").over(w) == F.col("version") + 1
        return self.versions.select("id", "version", F.coalesce(before, F.lit(False)).alias("before"), F.coalesce(after, F.lit(False)).alias("after"))

    def version_before(self, id_: int, version: int) -> DataFrame:
        return self.versions.where((F.col("id") == id_) & (F.col("version") == version - 1) & ~F.col("is_current"))

    def version_after(self, id_: int, version: int) -> DataFrame:
        return self.versions.where((F.col("id") == id_) & (F.col("version") == version + 1))

    def any_version_by_ids(self, ids: list[int], pin: int = 0) -> DataFrame:
        """Every row recorded at the pin of each id, newest first."""
        rows = self.versions.join(self._ids(ids).select("id").distinct(), "id", "left_semi")
        return K.any_version(rows, pin, self.graph.has_voids).drop("parts").orderBy("id", F.desc("s"), F.desc("version"))

    # vectors

    def nearest(self, name: str, key: str, query: list[float], k: int, metric: str = "cosine", opts: QueryOpts = CURRENT) -> DataFrame:
        """The k nearest current vectors, ties by id. Temporal options first choose who is eligible, and the row that comes back is
        the one they resolve; the distance is that of the current vector. Each task keeps its own top k."""
        if opts.tx_pin is not None:
            raise TxPinUnsupported("a vector search cannot be pinned")
        current = self.versions.where("is_current").where(self.member(name)).where(F.size(self.prop(key)["vec"]) == len(query))
        far = V.distance(self.prop(key)["vec"], F.array(*[F.lit(float(x)).cast("float") for x in query]), metric)
        scored = current.withColumn("distance", far)
        if opts.temporal:
            plain = QueryOpts(opts.valid_at, opts.during, opts.tx_at)
            scored = self._resolve(plain, self.member(name)).join(scored.select("id", "distance"), "id")
        return scored.orderBy("distance", "id").limit(k)
