"""Writes as set operations: each takes a version table and a table of changes, and returns the new version table.

Nothing is changed in place: a write gives new rows and, where an older row loses the current slot or is deleted, a new copy of that row.
The graph's clock gives each write one transaction instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.errors import GraphError, InvalidTimeRange, NotFound, NothingToExcise
from strataspan.functions import values as V
from strataspan.plans import kernels as K
from strataspan.plans.lineage import checkpointed
from strataspan.sources.fixtures import versioned


def add(v: DataFrame, new: DataFrame, tx: int) -> DataFrame:
    """Append version 0 of new entities (id, labels or type and ends, props; s, e optional: valid always). An id whose chain was
    deleted goes on above its highest version."""
    given = {c: F.col(c) for c in ("s", "e") if c in new.columns}
    rows = versioned(new.drop("s", "e") if not given else new, tx_from=F.lit(tx), **given)
    last = v.join(new.select("id"), "id", "left_semi").groupBy("id").agg(F.max("version").alias("_last"))
    rows = rows.join(last, "id", "left").withColumn("version", (F.coalesce(F.col("_last") + 1, F.lit(0))).cast("int")).drop("_last")
    return v.unionByName(rows.select(*v.columns))


def add_if_absent(v: DataFrame, new: DataFrame, tx: int) -> DataFrame:
    return add(v, new.join(v.where("is_current").select("id"), "id", "left_anti"), tx)


def get_or_create(v: DataFrame, new: DataFrame, tx: int, label: str, key: str) -> DataFrame:
    """`add` of the nodes whose value under key no current node of the label holds; of equal new ones the least id counts."""
    k = V.eqkey(F.col("props")[key])
    held = v.where("is_current").where(F.array_contains("labels", label)).select(k.alias("_k")).distinct()
    fresh = new.withColumn("_k", k).join(held, "_k", "left_anti")
    first = fresh.groupBy("_k").agg(F.min("id").alias("id"))
    return add(v, fresh.join(first, ["_k", "id"], "left_semi").drop("_k"), tx)


def _checked(v: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes; refused if an id has no current row, or two changes."""
    held = v.where("is_current").select("id").withColumn("_held", F.lit(True))
    bad = changes.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).join(held, "id", "left").where(F.col("_held").isNull() | (F.col("_n") > 1)).first()
    if bad is not None:
        if bad["_held"] is None:
            raise NotFound(bad["id"])
        raise GraphError(f"{bad['id']} has {bad['_n']} changes in one write")
    return changes


def _advance(v: DataFrame, changes: DataFrame, tx: int, **columns: Column) -> DataFrame:
    """v with a new current version of each changed id, and its current row superseded at tx.

    The table is read once: it meets the changes by id, each current row that has one is copied, and the copy takes the new columns (made from the
    current row and the change) and the number above all versions of its chain.
    """
    more = [c for c in changes.columns if c != "id"]
    change = _checked(v, changes).select("id", F.struct(F.lit(True).alias("_hit"), *more).alias("_change"))
    hit = F.col("_change").isNotNull() & F.col("is_current")
    held = v.join(change, "id", "left").withColumn("_last", F.max("version").over(Window.partitionBy("id")))
    both = held.withColumn("_new", F.explode(F.when(hit, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    new = {"version": (F.col("_last") + 1).cast("int"), "tx_from": F.lit(tx).cast("bigint"), "tx_to": F.lit(0).cast("bigint"), "is_current": F.lit(True), **columns}
    old = {"tx_to": F.when(hit, F.lit(tx).cast("bigint")).otherwise(F.col("tx_to")), "is_current": F.col("is_current") & ~hit}
    wide = both.select("*", *(F.col(f"_change.{c}").alias(c) for c in more))
    return wide.select(*(F.when(F.col("_new"), new.get(c, F.col(c))).otherwise(old.get(c, F.col(c))).alias(c) for c in v.columns))


def patched(base: Column, patch: Column) -> Column:
    """Base properties with those of the patch; a patch's key with a null value deletes it."""
    kept = F.map_filter(F.coalesce(base, F.create_map().cast(V.PROPS)), lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, x: x.isNotNull()))


def update(v: DataFrame, changes: DataFrame, tx: int) -> DataFrame:
    """changes: id, patch (properties), and optionally valid_from, the new version's start (else tx)."""
    start = F.col("valid_from") if "valid_from" in changes.columns else F.lit(tx).cast("bigint")
    return _advance(v, changes, tx, props=patched(F.col("props"), F.col("patch")), s=start, e=F.lit(V.INF))


def update_in_place(v: DataFrame, changes: DataFrame, tx: int | None = None) -> DataFrame:
    """Rewrite current properties without a version; tx is not recorded."""
    rows = v.join(_checked(v, changes).select("id", "patch"), "id", "left")
    hit = F.col("is_current") & F.col("patch").isNotNull()
    return rows.withColumn("props", F.when(hit, patched(F.col("props"), F.col("patch"))).otherwise(F.col("props"))).select(*v.columns)


def replace_version(v: DataFrame, changes: DataFrame, tx: int) -> DataFrame:
    """changes: id, new_props, valid_from, valid_to: a new version of its own interval."""
    if not changes.where(F.col("valid_from") >= F.col("valid_to")).isEmpty():
        raise InvalidTimeRange("an interval must not be empty")
    return _advance(v, changes, tx, props=F.col("new_props"), s=F.col("valid_from"), e=F.col("valid_to"))


def close_version(v: DataFrame, changes: DataFrame, tx: int) -> DataFrame:
    """changes: id, at: a new version with the current one's start, ending at `at`."""
    outside = (F.col("at") <= F.col("s")) | (F.col("at") > F.col("e"))
    if not v.where("is_current").select("id", "s", "e").join(changes.select("id", "at"), "id").where(outside).isEmpty():
        raise InvalidTimeRange("a version is closed inside its interval")
    return _advance(v, changes, tx, e=F.col("at").cast("bigint"))


def compare_and_set(v: DataFrame, id_: int, key: str, expected, patch_value: Column | None, tx: int) -> tuple[DataFrame, bool]:
    """Set or (None) delete a property if its value equals `expected` (None: is absent); (table, done)."""
    row = v.where("is_current").where(F.col("id") == id_)
    held = F.col("props")[key]
    if row.where(held.isNull() if expected is None else V.equals(held, expected)).isEmpty():
        return v, False
    value = F.lit(None).cast(V.PV) if patch_value is None else patch_value
    return update(v, row.select("id", F.create_map(F.lit(key), value).alias("patch")), tx), True


def set_labels(v: DataFrame, ids: DataFrame, tx: int, add_label: str | None = None, remove_label: str | None = None) -> DataFrame:
    """A new version with a label more or less; a node keeps its last label (such ids are refused)."""
    labels = F.col("labels")
    if add_label:
        labels = F.array_union(labels, F.array(F.lit(add_label)))
    if remove_label:
        labels = F.array_except(labels, F.array(F.lit(remove_label)))
        if not v.where("is_current").join(ids.select("id"), "id", "left_semi").where(F.size(labels) == 0).isEmpty():
            from strataspan.errors import LastLabel

            raise LastLabel(remove_label)
    return _advance(v, ids.select("id"), tx, labels=labels, s=F.lit(tx).cast("bigint"), e=F.lit(V.INF))


def delete(v: DataFrame, ids: DataFrame, tx: int, retract: bool = False) -> DataFrame:
    """Make the current rows tombstones: an open or later end becomes tx. Retracted lives vanish at pins from tx on. An id without a current row is refused."""
    _checked(v, ids.select("id").distinct())
    held = v.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.col("_hit").isNotNull() & F.col("is_current")
    end = F.when(hit & (F.col("e") > tx), F.lit(tx)).otherwise(F.col("e"))
    stamp = lambda c: F.when(hit, F.lit(tx)).otherwise(F.col(c)).cast("bigint")
    kept = F.when(hit, F.col("e") <= tx).otherwise(F.col("kept"))
    # every new value is computed from the old row
    return held.select(
        *[
            {"e": end, "kept": kept, "tx_to": stamp("tx_to"), "deleted_at": stamp("deleted_at"), "retracted": F.col("retracted") | (hit & F.lit(retract)), "is_current": F.col("is_current") & ~hit}.get(c, F.col(c)).alias(c)
            for c in v.columns
        ]
    )


def cascade(rels: DataFrame, node_ids: DataFrame, tx: int, retract: bool = False) -> DataFrame:
    """Delete the current relationships at deleted nodes."""
    current = rels.where("is_current")
    at = lambda end: current.join(node_ids.select(F.col("id").alias(end)), end, "left_semi").select("id")
    return delete(rels, at("start_id").union(at("end_id")).distinct(), tx, retract)


def correct(v: DataFrame, changes: DataFrame, tx: int, void: bool = False, fill: bool = True) -> DataFrame:
    """Append-only correction of [valid_from, valid_to) of entities; changes: id, valid_from, valid_to, patch (not for void).

    The interval is cut where its winner changes; each piece repeats its winner with the patch (void: marks absence, without
    properties), gaps take the chain's most recent version as template (fill False: they stay gaps, and ended lives ended), and neighbouring
    pieces of one base are one. Where the end is closed a row repeats the winner at the end up to the next bound. Older rows stay as they are; of the new and the current rows the
    newest that is open takes the current slot, numbered highest.
    """
    if not changes.where(F.col("valid_from") >= F.col("valid_to")).isEmpty():
        raise InvalidTimeRange("an interval must not be empty")
    if not changes.groupBy("id").count().where("count > 1").isEmpty():
        raise GraphError("a write corrects one interval of an id; write the next one after it")
    if not changes.select("id").join(v.select("id"), "id", "left_anti").isEmpty():
        raise NotFound("an id that is corrected")
    wide = changes.select("id", F.col("valid_from").alias("_a"), F.col("valid_to").alias("_b"), *(["patch"] if "patch" in changes.columns else []))
    # only the chains that are corrected, materialised as every step below reads them
    touched = checkpointed(v.join(wide.select("id"), "id", "left_semi"))
    # the pre-correction chain without lives' ends: deletes are taken back
    plain = touched.withColumns({"deleted_at": F.lit(0).cast("bigint"), "retracted": F.lit(False)}) if fill else touched
    won = checkpointed(K.segments(plain, 0, keep_void=True).join(wide, "id"))
    inside = won.where(K.meets(F.col("_a"), F.col("_b"), "from", "to")).withColumns({"from": F.greatest("from", "_a"), "to": F.least("to", "_b")})
    template = touched.groupBy("id").agg(F.max_by(F.struct(*v.columns), F.struct("version")).alias("_t")).join(wide, "id")
    names = [c for c in v.columns if c != "id"]
    held = inside.select("id", "from", "to", F.struct(*names).alias("row"), F.lit(False).alias("gap"), *wide.columns[1:])
    order = K.chain().orderBy("from")
    before = held.select("id", "_a", "_b", F.coalesce(F.lag("to").over(order), F.col("_a")).alias("x"), F.col("from").alias("y"))
    after = template.join(held.groupBy("id").agg(F.max("to").alias("_last")), "id", "left").select("id", "_a", "_b", F.coalesce("_last", "_a").alias("x"), F.col("_b").alias("y"))
    gaps = before.unionByName(after).where("x < y").join(template.drop("_a", "_b"), "id").select("id", F.col("x").alias("from"), F.col("y").alias("to"), F.struct(*[F.col("_t")[c].alias(c) for c in names]).alias("row"), F.lit(True).alias("gap"), *wide.columns[1:])
    pieces = held.unionByName(gaps).withColumn("_void", F.lit(void))
    if void:
        covered = held.where(~F.col("row")["void"]).select("id").distinct()
        if not wide.join(covered, "id", "left_anti").isEmpty():
            raise NothingToExcise("nothing holds in the interval")
        pieces = pieces.where(~F.col("gap"))
    elif not fill:
        # a chain that tiles ceases to with the new rows, and its own bounds would show older rows where nothing held: voids stand there
        shape = K.classified(K.lives(plain)).groupBy("id").agg(F.max("_cascade").alias("_cascade"), F.min("s").alias("_low"), F.max("e").alias("_high"))
        pieces = pieces.withColumn("_void", F.col("gap") | F.col("row")["void"]).join(shape, "id")
        pieces = pieces.withColumns({"from": F.greatest("from", "_low"), "to": F.least("to", "_high")})
        pieces = pieces.where(~F.col("_void") | (~F.col("_cascade") & (F.col("from") < F.col("to")))).drop("_cascade", "_low", "_high")
    alike = F.struct(F.col("row")["version"], "_void")
    same = (F.lag(alike).over(order) == alike) & (F.lag("to").over(order) == F.col("from"))
    runs = pieces.withColumn("_run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order))
    merged = runs.groupBy("id", "_run").agg(F.min("from").alias("s"), F.max("to").alias("e"), F.first("row").alias("row"), F.first("_void").alias("void"), F.first(F.struct(*wide.columns[1:])).alias("w"))
    base = merged.select("id", "s", "e", F.col("row"), F.col("w")["patch"].alias("patch") if "patch" in wide.columns else F.lit(None).cast(V.PROPS).alias("patch"), "void")
    # the winner at the end of the interval goes on to the next bound of any row
    bounds = plain.select("id", F.explode(F.array("s", "e")).alias("x")).join(wide, "id").where(F.col("x") > F.col("_b")).groupBy("id").agg(F.min("x").alias("_next"))
    at_end = won.where((F.col("_b") != V.INF) & (F.col("from") <= F.col("_b")) & (F.col("to") > F.col("_b"))).join(bounds, "id", "left")
    resumed = at_end.select("id", F.col("_b").alias("s"), F.coalesce("_next", F.lit(V.INF)).alias("e"), F.struct(*names).alias("row"), F.lit(None).cast(V.PROPS).alias("patch"), F.col("void"))
    rows = base.unionByName(resumed)
    values = {
        "s": F.col("s"), "e": F.col("e"), "void": F.col("void"), "tx_from": F.lit(tx).cast("bigint"), "tx_to": F.lit(0).cast("bigint"), "deleted_at": F.lit(0).cast("bigint"),
        "retracted": F.lit(False), "kept": F.lit(False), "is_current": F.lit(False),
        "props": F.when(F.col("void"), F.lit(None)).when(F.col("patch").isNotNull(), patched(F.col("row")["props"], F.col("patch"))).otherwise(F.col("row")["props"]),
    }
    fresh = rows.select("id", *[values.get(c, F.col("row")[c]).alias(c) for c in names])
    last = touched.groupBy("id").agg(F.max("version").alias("_last"))
    # the newest open belief that is not void takes the slot; among the new rows it comes last
    slot = F.col("e") == V.INF
    by = K.chain().orderBy((slot & ~F.col("void")).cast("int"), "s")
    fresh = fresh.join(last, "id").withColumn("version", (F.col("_last") + F.row_number().over(by)).cast("int")).drop("_last")
    takes = F.max(slot & ~F.col("void")).over(K.chain())
    top = F.max("version").over(K.chain())
    fresh = fresh.withColumn("is_current", takes & (F.col("version") == top))
    fresh = checkpointed(fresh)
    moved = fresh.where("is_current").select("id", F.lit(True).alias("_moved"))
    rest = v.join(moved, "id", "left").withColumn("is_current", F.col("is_current") & F.col("_moved").isNull()).drop("_moved")
    return rest.unionByName(fresh.select(*v.columns))


def excise(v: DataFrame, changes: DataFrame, tx: int) -> DataFrame:
    """Void [valid_from, valid_to): absence without a delete."""
    return correct(v, changes.select("id", "valid_from", "valid_to"), tx, void=True)


def update_everywhere(v: DataFrame, changes: DataFrame, tx: int) -> DataFrame:
    """changes: id, patch. An update that claims no valid time: every segment of the entity takes the patch and keeps its bounds; where
    nothing held, nothing holds (in chains that tiled, void rows see to that)."""
    _checked(v, changes)
    whole = changes.select("id", "patch", F.lit(V.NEG).cast("bigint").alias("valid_from"), F.lit(V.INF).cast("bigint").alias("valid_to"))
    return correct(v, whole, tx, fill=False)


def check_clock(last: int, tx: int) -> None:
    if tx <= last:
        raise GraphError(f"transaction instant {tx} is not after {last}")
