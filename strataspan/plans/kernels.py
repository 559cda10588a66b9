"""Resolution of bitemporal version chains: what every temporal read is made of.

A version table V has a row a version of an entity: id, version, is_current, s, e (valid interval, half open, INF: open), tx_from, tx_to
(0: not superseded), deleted_at (0: none), retracted, void, kept (the delete left the valid end as it was), and whatever the entity
carries. All steps work by id, so a plan shuffles once, on id; the windows and the aggregation after it share that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strataspan.functions.allen import allen
from strataspan.functions.values import INF, NEG
from strataspan.plans.lineage import checkpointed


def chain() -> WindowSpec:
    """The window of one entity."""
    return Window.partitionBy("id")


_TEMP = ("_life", "_cascade", "_rank")


def covers(t: int | Column, s: str = "s", e: str = "e") -> Column:
    return (F.col(s) <= t) & ((F.col(e) == INF) | (F.col(e) > t))


def meets(a: int | Column, b: int | Column, s: str = "s", e: str = "e") -> Column:
    """Overlap with [a, b)."""
    return (F.col(s) < b) & ((F.col(e) == INF) | (F.col(e) > a))


def visible(v: DataFrame, pin: int) -> DataFrame:
    """What was recorded by the pin (0: everything), with later deletes undone. A later tx_to never hides a row."""
    if not pin:
        return v
    later = F.col("deleted_at") > pin
    wrote = later & (F.col("e") == F.col("deleted_at")) & ~F.col("kept")
    return v.where((F.col("tx_from") == 0) | (F.col("tx_from") <= pin)).withColumns(
        {
            "e": F.when(wrote, F.lit(INF)).otherwise(F.col("e")),
            "tx_to": F.when(later & (F.col("tx_to") > pin), F.lit(0)).otherwise(F.col("tx_to")),
            "retracted": F.col("retracted") & ~later,
            "deleted_at": F.when(later, F.lit(0)).otherwise(F.col("deleted_at")),
        }
    )


def lives(v: DataFrame) -> DataFrame:
    """Cut every row at the first delete of its chain at or after its recording, drop rows of a life that a retraction ended, and
    number the lives (`_life`). A chain's deletes are few; only they are gathered."""
    deaths = F.collect_list(F.when(F.col("deleted_at") > 0, F.struct("deleted_at", "retracted"))).over(chain())
    first = F.array_min(F.filter("_deaths", lambda d: d["deleted_at"] >= F.col("tx_from")))
    return (
        v.withColumn("_deaths", deaths)
        .withColumn("_death", first)
        .where(F.col("_death").isNull() | ~F.col("_death")["retracted"])
        .withColumn("_life", F.size(F.array_distinct(F.transform(F.filter("_deaths", lambda d: d["deleted_at"] < F.col("tx_from")), lambda d: d["deleted_at"]))))
        .withColumn("e", F.least("e", F.coalesce(F.col("_death")["deleted_at"], F.lit(INF))))
        .drop("_deaths", "_death")
    )


def classified(v: DataFrame) -> DataFrame:
    """`_cascade`: whether in write order a start falls, or of two rows with one start the later ends earlier."""
    order = chain().orderBy("_life", "version")
    fall = (F.col("s") < F.lag("s").over(order)) | ((F.col("s") == F.lag("s").over(order)) & (F.col("e") < F.lag("e").over(order)))
    return v.withColumn("_fall", F.coalesce(fall, F.lit(False))).withColumn("_cascade", F.max("_fall").over(chain())).drop("_fall")


def _replacing(v: DataFrame) -> DataFrame:
    """`_new`: whether the row was recorded when a lower version was superseded (not deleted), so it replaces older beliefs from its
    start on. A superseded row adds a mark at its tx_to, and rows meet the marks of their own recording in a window, without a join."""
    ended = (F.col("tx_to") > F.col("tx_from")) & (F.col("deleted_at") == 0)
    marks = F.array(F.struct(F.col("tx_from").alias("at"), F.lit(False).alias("mark")), F.struct(F.col("tx_to").alias("at"), F.lit(True).alias("mark")))
    both = v.withColumn("_m", F.explode(F.when(ended, marks).otherwise(F.slice(marks, 1, 1))))
    from_ = F.min(F.when(F.col("_m")["mark"], F.col("version"))).over(Window.partitionBy("id", F.col("_m")["at"]))
    return both.withColumn("_from", from_).where(~F.col("_m")["mark"]).withColumn("_new", F.coalesce(F.col("version") > F.col("_from"), F.lit(False))).drop("_m", "_from")


def _capped(v: DataFrame) -> DataFrame:
    """`_cap`: the least start, not before the row's own, of a newer replacing row.

    Nearly always that is the least start of all newer replacing rows, which one window finds; only in chains where some row has a newer
    replacing row with an earlier start are the chain's replacing rows gathered and searched.
    """
    marked = _replacing(v)
    newer = chain().orderBy("tx_from", "version").rowsBetween(1, Window.unboundedFollowing)
    marked = marked.withColumn("_least", F.min(F.when(F.col("_new") & F.col("_cascade"), F.col("s"))).over(newer))
    marked = marked.withColumn("_hard", F.coalesce(F.max(F.col("_least") < F.col("s")).over(chain()), F.lit(False)))
    all_ = F.collect_list(F.when(F.col("_hard") & F.col("_new"), F.struct("tx_from", "version", "s"))).over(chain())
    later = F.filter("_all", lambda q: ((q["tx_from"] > F.col("tx_from")) | ((q["tx_from"] == F.col("tx_from")) & (q["version"] > F.col("version")))) & (q["s"] >= F.col("s")))
    cap = F.when(F.col("_hard"), F.array_min(F.transform(later, lambda q: q["s"]))).otherwise(F.col("_least"))
    return marked.withColumn("_all", all_).withColumn("_cap", cap).drop("_new", "_least", "_hard", "_all")


def bounded(v: DataFrame, pin: int = 0) -> DataFrame:
    """V at a pin with final ends (`e`) and `_rank`: of the rows that cover an instant, the greatest rank wins.

    Tiling chains end open rows where the next start is; in cascade chains rows keep their own ends, cut by newer replacing rows.
    """
    rows = _capped(classified(lives(visible(v, pin))))
    following = F.lead("s").over(chain().orderBy("s", "version"))
    own = F.least("e", F.coalesce("_cap", F.lit(INF)))
    tile = F.when(F.col("e") == INF, F.coalesce("_next", F.lit(INF))).otherwise(F.col("e"))
    first = F.when(F.col("_cascade"), F.col("tx_from")).otherwise(F.col("s"))
    return (
        rows.withColumn("_next", following)
        .withColumn("e", F.when(F.col("_cascade"), own).otherwise(tile))
        .withColumn("_rank", F.struct(first.alias("a"), F.col("version").cast("bigint").alias("b")))
        .drop("_cap", "_next")
    )


def positional(v: DataFrame) -> DataFrame:
    """Open rows end where the next start (by start, version) is."""
    following = F.lead("s").over(chain().orderBy("s", "version"))
    return v.withColumn("e", F.when(F.col("e") == INF, F.coalesce(following, F.lit(INF))).otherwise(F.col("e")))


def _public(v: DataFrame) -> DataFrame:
    return v.drop(*_TEMP)


def _winner(v: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of each key's rows the one of the greatest rank."""
    columns = [c for c in v.columns if c not in (*keys, "_rank")]
    best = v.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col("_rank")).alias("w"))
    return best.select(*keys, *[F.col("w")[c].alias(c) for c in columns])


def at(v: DataFrame, t: int, pin: int = 0) -> DataFrame:
    """The version of each entity that is valid at t, as recorded by the pin; none where a void row wins.

    Filters that decide nothing about the winner belong after it; that on the interval is the scan's.
    """
    won = _winner(bounded(v, pin).where(covers(t)))
    return _public(won.where(~F.col("void")))


def segments(v: DataFrame, pin: int = 0, keep_void: bool = False) -> DataFrame:
    """`at` for all instants at once: from, to, and the row that is valid there.

    A row of a chain whose rows do not overlap is its own segment. In the others each row is cut at the chain's bounds inside it, each
    piece goes to the row of the greatest rank, and neighbouring pieces of one row are one segment again. Windows by id throughout: one
    shuffle, no join.
    """
    rows = bounded(v, pin).where(F.col("s") < F.col("e"))
    order = chain().orderBy("s", "e", "version")
    rows = rows.withColumn("_over", F.coalesce(F.col("e") > F.lead("s").over(order), F.lit(False))).withColumn("_mixed", F.max("_over").over(chain()))
    bound = lambda c: F.collect_set(F.when(F.col("_mixed"), F.col(c))).over(chain())
    rows = rows.withColumn("_cuts", F.array_sort(F.array_union(bound("s"), bound("e"))))
    inside = F.filter("_cuts", lambda c: (c >= F.col("s")) & (c <= F.col("e")))
    pieces = F.when(F.col("_mixed"), F.zip_with(inside, F.slice(inside, 2, 1 << 30), lambda a, b: F.struct(a.alias("from"), b.alias("to"))))
    whole = F.array(F.struct(F.col("s").alias("from"), F.col("e").alias("to")))
    rows = rows.withColumn("_p", F.explode(F.coalesce(pieces, whole))).withColumns({"from": F.col("_p")["from"], "to": F.col("_p")["to"]}).where(F.col("to").isNotNull())
    best = F.max("_rank").over(Window.partitionBy("id", "from"))
    won = rows.withColumn("_best", best).where(F.col("_rank") == F.col("_best"))
    by_time = chain().orderBy("from")
    new = (F.lag("_rank").over(by_time) != F.col("_rank")) | (F.lag("to").over(by_time) != F.col("from"))
    runs = won.withColumn("_first", F.coalesce(new, F.lit(True))).withColumn("_run", F.sum(F.col("_first").cast("int")).over(by_time))
    runs = runs.withColumn("to", F.max("to").over(Window.partitionBy("id", "_run"))).where("_first")
    out = runs.drop("_over", "_mixed", "_cuts", "_p", "_best", "_first", "_run")
    return _public(out if keep_void else out.where(~F.col("void")))


def _void_spans(v: DataFrame, pin: int) -> DataFrame:
    """id, mask: the spans that void rows win, for the entities that have void rows."""
    held = visible(v, pin).where("void").select("id").distinct()
    won = segments(v.join(held, "id", "left_semi"), pin, keep_void=True).where("void")
    return won.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("mask"))


def _parts(mask: Column, lo: Column, hi: Column) -> Column:
    """The parts of [lo, hi) outside the sorted, disjoint spans of the mask."""
    kind = "array<struct<from:bigint,to:bigint>>"
    start = F.struct(lo.alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.struct(acc["at"].alias("from"), F.least(m["from"], hi).alias("to"))
        out = F.when(gap["from"] < gap["to"], F.concat(acc["out"], F.array(gap))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], m["to"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.when(acc["at"] < hi, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), hi.alias("to"))))).otherwise(acc["out"])
    return F.aggregate(F.coalesce(mask, F.array().cast(kind)), start, step, rest)


def any_version(v: DataFrame, pin: int = 0, voids: bool = True) -> DataFrame:
    """Every row recorded by the pin that holds somewhere: positional bounds, outside what void rows win (`parts`)."""
    rows = positional(lives(visible(v, pin))).drop("_life").where(~F.col("void"))
    if voids:
        rows = rows.join(_void_spans(v, pin), "id", "left")
        return rows.withColumn("parts", _parts(F.col("mask"), F.col("s"), F.col("e"))).drop("mask").where(F.size("parts") > 0)
    return rows.withColumn("parts", F.array(F.struct(F.col("s").alias("from"), F.col("e").alias("to")))).where(F.col("s") < F.col("e"))


def during(v: DataFrame, a: int, b: int, pin: int = 0, predicate: Column | None = None, voids: bool = True) -> DataFrame:
    """The newest version of each entity that holds somewhere in [a, b) and meets the predicate, which is tested on every version."""
    rows = any_version(v, pin, voids).where(F.exists("parts", lambda p: (p["from"] < b) & ((p["to"] == INF) | (p["to"] > a))))
    rows = rows.where(predicate) if predicate is not None else rows
    return _newest(rows.drop("parts"))


def _newest(rows: DataFrame) -> DataFrame:
    return _winner(rows.withColumn("_rank", F.struct(F.col("s").alias("a"), F.col("version").cast("bigint").alias("b"))))


def relating(v: DataFrame, a: int, b: int, relations: set[str], pin: int = 0, voids: bool = True) -> DataFrame:
    """The newest version of each entity with a part whose Allen relation to [a, b) (b 0: open) is one of those given."""
    if not relations:
        return v.where(F.lit(False))
    end = F.lit(b or INF)
    hit = F.exists("parts", lambda p: F.coalesce(allen(p["from"], p["to"], F.lit(a), end).isin(*relations), F.lit(False)))
    return _newest(any_version(v, pin, voids).where(hit).drop("parts"))


def as_of(v: DataFrame, pin: int) -> DataFrame:
    """The newest record of each entity by the pin, or nothing where that record was superseded or deleted by then.

    Newest is by version. A live current row answers, unless a higher version was recorded at or after it and by the pin; higher
    versions of which one was superseded or deleted belong to an earlier life and never answer for it. Of the rows of one write the
    highest that is open at the pin answers. Windows by id only.
    """
    seen = (F.col("tx_from") > 0) & (F.col("tx_from") <= pin)
    live = F.col("is_current") & seen & (F.col("tx_to") == 0)
    ended = (F.col("tx_to") != 0) & (F.col("tx_to") >= F.col("tx_from"))
    end = F.when((F.col("deleted_at") > pin) & (F.col("e") == F.col("deleted_at")) & ~F.col("kept"), F.lit(INF)).otherwise(F.col("e"))
    over = lambda c: F.max(c).over(chain())
    rows = (
        v.where(~F.col("void"))
        .withColumn("_cur", over(F.when(live, F.struct("version", "tx_from"))))
        .withColumn("_old", over(F.col("_cur").isNotNull() & (F.col("version") > F.col("_cur")["version"]) & ended))
    )
    cur = F.col("_cur")
    above = (F.col("version") > cur["version"]) & ~F.col("_old")
    chosen = F.when(cur.isNotNull(), live | (above & seen & (F.col("tx_from") >= cur["tx_from"]))).otherwise(seen)
    sequence = F.when(cur.isNotNull(), live | above).otherwise(F.lit(True))
    rows = rows.withColumn("_top", over(F.when(chosen, F.struct("version", "tx_from"))))
    top = F.col("_top")
    run = sequence & (F.col("tx_from") == top["tx_from"]) & (F.col("version") <= top["version"])
    rows = rows.withColumn("_open", over(F.when(run & (end == INF), F.col("version"))))
    holder = F.when((F.col("version") < top["version"]) & ended, F.struct("version", "deleted_at"))
    rows = rows.withColumn("_holder", over(holder))
    died = cur.isNull() & (F.col("_holder")["deleted_at"] > top["tx_from"]) & (F.col("_holder")["deleted_at"] <= pin)
    gone = ((F.col("tx_to") != 0) & (F.col("tx_to") <= pin)) | ((F.col("deleted_at") != 0) & (F.col("deleted_at") <= pin))
    answer = rows.where((F.col("version") == F.coalesce("_open", top["version"])) & ~gone & ~F.coalesce(died, F.lit(False)))
    later_tx = F.col("tx_to") > pin
    return visible(answer.drop("_cur", "_old", "_top", "_open", "_holder"), pin).withColumn("tx_to", F.when(later_tx, F.lit(0)).otherwise(F.col("tx_to")))


def count_timeline(segs: DataFrame) -> DataFrame:
    """from, to, n: maximal stretches of valid time over which the same number of segments holds; stretches without any are left out.

    Starts and ends are first added up by instant, so what is ordered are distinct instants; those fall into ranges that are summed up
    apart, and the ranges' totals are few.
    """
    bounds = F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("d")), F.struct(F.col("to").alias("at"), F.lit(-1).alias("d")))
    deltas = segs.select(F.explode(bounds).alias("x")).select("x.at", "x.d").where(F.col("at") != INF)
    steps = running(checkpointed(deltas.groupBy("at").agg(F.sum("d").alias("d")).where("d != 0")), "at", "d")
    return steps.select(F.col("at").alias("from"), F.coalesce("next", F.lit(INF)).alias("to"), F.col("total").alias("n")).where("n != 0")


def running(df: DataFrame, order: str, value: str, ranges: int = 256) -> DataFrame:
    """df with `total`, the running sum of `value` by `order` (unique), and `next`, the following `order`, without one task for all rows.

    Rows fall into `ranges` equal ranges of their span; the ranges' totals (at most that many rows) are summed up and broadcast. df
    is read three times, so it should be cheap to read.
    """
    lo, hi = df.where(F.col(order) > NEG // 2).agg(F.min(order), F.max(order)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    width = (hi - lo) // ranges + 1
    # what begins at minus infinity is a range of its own
    part = F.when(F.col(order) < lo, F.lit(-1)).otherwise(F.expr(f"({order} - {lo}) div {width}").cast("int"))
    rows = df.withColumn("_part", part)
    by_part = Window.partitionBy(F.lit(0)).orderBy("_part")
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_sum"), F.min(order).alias("_low"))
    edges = totals.select("_part", F.coalesce(F.sum("_sum").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_low").over(by_part).alias("_after"))
    inside = Window.partitionBy("_part").orderBy(order)
    summed = rows.withColumn("_inside", F.sum(value).over(inside)).withColumn("_next", F.lead(order).over(inside))
    out = summed.join(F.broadcast(edges), "_part").withColumn("total", F.col("_inside") + F.col("_before")).withColumn("next", F.coalesce("_next", "_after"))
    return out.drop("_part", "_inside", "_before", "_next", "_after")
