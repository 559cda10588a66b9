"""Writes, options, change logs, backups and streams."""

import pytest
from pyspark.sql import functions as F

from strataspan import errors
from strataspan.functions import allen as A
from strataspan.functions import calendar as C
from strataspan.functions import values as V
from strataspan.graph import Graph
from strataspan.operators import admin, integrity, sessions, writes
from strataspan.plans import kernels as K
from strataspan.plans.opts import QueryOpts
from strataspan.sources import changes, fixtures
from strataspan.streaming import replica, watch


def people(spark, n=5):
    df = spark.range(1, n + 1).select("id", F.array(F.lit("Person")).alias("labels"), V.props(name=V.text(F.concat(F.lit("p"), F.col("id"))), age=V.integer(F.col("id") * 10)).alias("props"))
    return fixtures.versioned(df, s=F.lit(100))


def friends(spark):
    df = spark.createDataFrame([(11, 1, 2), (12, 2, 3), (13, 3, 3)], "id long, start_id long, end_id long")
    df = df.select("id", F.lit("KNOWS").alias("type"), "start_id", "end_id", V.props(w=V.real(F.lit(0.5))).alias("props"))
    return fixtures.versioned(df, s=F.lit(100))


@pytest.fixture
def graph(spark):
    return Graph(spark, people(spark), friends(spark), now=2000, has_voids=False)


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_update_and_history(graph, spark):
    graph.write(writes.update, ids(spark, 2).withColumn("patch", V.props(age=V.integer(F.lit(99)))))
    row = graph.nodes.get(2)
    assert row["version"] == 1 and row["props"]["age"]["l"] == 99 and row["props"]["name"]["s"] == "p2"
    old = graph.nodes.history(2).collect()
    assert [r["version"] for r in old] == [0] and old[0]["tx_to"] == row["tx_from"] == graph.now
    assert graph.nodes.by_property("Person", "age", 20, QueryOpts(tx_pin=1500)).count() == 1
    assert graph.nodes.by_property("Person", "age", 20.0).count() == 0


def test_patch_deletes_keys(graph, spark):
    patch = F.create_map(F.lit("age"), F.lit(None).cast(V.PV))
    graph.write(writes.update, ids(spark, 1).withColumn("patch", patch))
    assert set(graph.nodes.get(1)["props"]) == {"name"}


def test_delete_cascades_and_pins_go_back(graph, spark):
    graph.write(writes.delete, ids(spark, 3))
    with pytest.raises(errors.NotFound):
        graph.nodes.get(3)
    assert sorted(r["id"] for r in graph.rels.all().collect()) == [11]
    assert graph.temporal.at(500, pin=1500).count() == 5
    assert {r["id"] for r in graph.temporal.as_of(1500).collect()} == {1, 2, 3, 4, 5}
    assert {r["id"] for r in graph.temporal.as_of(graph.now).collect()} == {1, 2, 4, 5}


def test_retract_hides_the_life(graph, spark):
    graph.write(writes.delete, ids(spark, 4), retract=True)
    assert 4 not in {r["id"] for r in graph.temporal.at(500).collect()}
    assert 4 in {r["id"] for r in graph.temporal.at(500, pin=1500).collect()}


def test_correction_and_excise(graph, spark):
    span = ids(spark, 1).select("id", F.lit(300).cast("long").alias("valid_from"), F.lit(400).cast("long").alias("valid_to"))
    graph.write(writes.correct, span.withColumn("patch", V.props(age=V.integer(F.lit(1)))))
    line = [(r["from"], r["to"], r["props"]["age"]["l"]) for r in graph.temporal.timeline(1).collect()]
    assert line == [(100, 300, 10), (300, 400, 1), (400, V.INF, 10)]
    graph.write(writes.excise, span.withColumns({"valid_from": F.lit(350).cast("long"), "valid_to": F.lit(500).cast("long")}))
    line = [(r["from"], r["to"], r["props"]["age"]["l"]) for r in graph.temporal.timeline(1).collect()]
    assert line == [(100, 300, 10), (300, 350, 1), (500, V.INF, 10)]
    with pytest.raises(errors.NothingToExcise):
        writes.excise(graph.node_versions, span.withColumns({"valid_from": F.lit(1).cast("long"), "valid_to": F.lit(50).cast("long")}), graph.now + 1)


def test_labels_close_and_cas(graph, spark):
    graph.write(writes.set_labels, ids(spark, 1), add_label="Boss")
    assert graph.nodes.get(1)["labels"] == ["Person", "Boss"]
    with pytest.raises(errors.LastLabel):
        writes.set_labels(graph.node_versions, ids(spark, 2), graph.now + 1, remove_label="Person")
    graph.write(writes.close_version, ids(spark, 2).withColumn("at", F.lit(700).cast("long")))
    assert [(r["from"], r["to"]) for r in graph.temporal.timeline(2).collect()] == [(100, 700)]
    _, done = writes.compare_and_set(graph.node_versions, 3, "age", 31, V.integer(F.lit(1)), graph.now + 1)
    assert not done
    after, done = writes.compare_and_set(graph.node_versions, 3, "age", 30.0, V.integer(F.lit(1)), graph.now + 1)
    assert done and after.where("is_current and id = 3").first()["props"]["age"]["l"] == 1


def test_reimport_continues_the_chain(graph, spark):
    graph.write(writes.delete, ids(spark, 5))
    graph.write(writes.add, people(spark).where("id = 5").select("id", "labels", "props"))
    assert graph.nodes.get(5)["version"] == 1
    assert graph.nodes.latest_stamps().where("id = 5").first()["deleted"] is False


def test_get_or_create_and_absent(graph, spark):
    new = spark.createDataFrame([(50, "p1"), (51, "q"), (52, "q")], "id long, name string").select("id", F.array(F.lit("Person")).alias("labels"), V.props(name=V.text(F.col("name"))).alias("props"))
    after = writes.get_or_create(graph.node_versions, new, 3000, "Person", "name")
    assert sorted(r["id"] for r in after.where("id >= 50").collect()) == [51]
    assert writes.add_if_absent(graph.node_versions, people(spark).select("id", "labels", "props"), 3000).count() == 5


def test_opts_are_refused_when_planned(graph):
    with pytest.raises(errors.ConflictingTemporalOpts):
        graph.nodes.all(QueryOpts(tx_pin=1, valid_at=2))
    with pytest.raises(errors.InvalidTimeRange):
        graph.nodes.all(QueryOpts(during=(5, 5)))
    with pytest.raises(errors.InvalidTimeRange):
        graph.temporal.diff(5, 5)
    with pytest.raises(errors.TxPinUnsupported):
        graph.nodes.nearest("Person", "v", [1.0], 1, opts=QueryOpts(tx_pin=5))


def test_adjacency(graph, spark):
    assert [r["id"] for r in graph.rels.outgoing(3).collect()] == [13]
    assert sorted(r["id"] for r in graph.rels.incoming(3).collect()) == [12, 13]
    assert {(r["seed"], r["other"]) for r in graph.rels.for_nodes([1, 2, 9]).collect()} == {(1, 2), (2, 3)}
    assert {r["id"] for r in graph.temporal.neighbours_at(2, 500).collect()} == {1, 3}
    with pytest.raises(errors.NotFound):
        graph.add_rels(spark.createDataFrame([(20, 1, 99)], "id long, start_id long, end_id long").select("id", F.lit("KNOWS").alias("type"), "start_id", "end_id", V.props(w=V.real(F.lit(1.0))).alias("props")))


def test_batch_is_all_or_nothing(graph, spark):
    before = graph.node_versions
    with pytest.raises(errors.InvalidTimeRange):
        graph.batch([(writes.delete, ids(spark, 1), "node"), (writes.correct, ids(spark, 2).withColumns({"valid_from": F.lit(9).cast("long"), "valid_to": F.lit(9).cast("long")}), "node")])
    assert graph.node_versions is before and graph.now == 2000


def test_hash_chain(graph, spark):
    graph.write(writes.update, ids(spark, 2).withColumn("patch", V.props(age=V.integer(F.lit(1)))))
    v = integrity.with_hashes(graph.node_versions)
    assert integrity.verify_chains(v).where("not valid").isEmpty()
    assert [r["id"] for r in integrity.verify_chains(v.withColumn("prev_hash", F.when(F.col("id") == 2, "x").otherwise(F.col("prev_hash")))).where("not valid").collect()] == [2]


def test_export_and_backups(graph, spark, tmp_path):
    changes.export(graph, f"{tmp_path}/x")
    assert changes.load(spark, f"{tmp_path}/x").nodes.count() == 5
    changes.export_json(graph.node_versions, f"{tmp_path}/j")
    assert sorted(r["id"] for r in changes.load_json(spark, f"{tmp_path}/j", graph.node_versions).where("props['age'].l > 10").collect()) == [2, 3, 4, 5]
    a = changes.backup(graph, f"{tmp_path}/b")
    graph.write(writes.update, ids(spark, 2).withColumn("patch", V.props(age=V.integer(F.lit(1)))))
    b = changes.backup(graph, f"{tmp_path}/b", since=a)
    graph.write(writes.delete, ids(spark, 1))
    changes.backup(graph, f"{tmp_path}/b", since=b)
    back = changes.restore(spark, f"{tmp_path}/b")
    pick = ["id", "version", "is_current", "tx_from", "tx_to", "deleted_at"]
    assert sorted(back.node_versions.select(pick).collect()) == sorted(graph.node_versions.select(pick).collect())
    graph.write(writes.delete, ids(spark, 3))
    changes.backup(graph, f"{tmp_path}/b", since=graph.now - 1)
    graph.commit(f"{tmp_path}/c")
    assert graph.nodes.count() == 3


def test_removed_rows_stay_removed(graph, spark, tmp_path):
    graph.temporal.tag("t", 1500)
    graph.indexes.create_property("node", "Person", "age", elements=True)
    graph.indexes.create_composite("Person", ["name", "age"])
    a = changes.backup(graph, f"{tmp_path}/b")
    receipt = {r["kind"]: (r["rows"], r["entities"]) for r in graph.erase(ids(spark, 2)).collect()}
    assert receipt == {"node": (1, 1), "rel": (2, 2)}
    graph.write(writes.add, people(spark).where("id = 2").select("id", "labels", "props"))
    graph.write(writes.update, ids(spark, 3).withColumn("patch", V.props(age=V.integer(F.lit(1)))))
    changes.backup(graph, f"{tmp_path}/b", since=a)
    back = changes.restore(spark, f"{tmp_path}/b")
    pick = ["id", "version", "is_current", "tx_from", "tx_to"]
    assert sorted(back.node_versions.select(pick).collect()) == sorted(graph.node_versions.select(pick).collect())
    assert [r["id"] for r in back.rel_versions.collect()] == [13]
    assert back.tags == {"t": 1500} and back.indexes == graph.indexes


def test_pins_below_what_was_trimmed(graph, spark, tmp_path):
    for age in (1, 2, 3):
        graph.write(writes.update, ids(spark, 2).withColumn("patch", V.props(age=V.integer(F.lit(age)))))
    graph.compact(1, V.INF)
    low = admin.lowest_answered_pins(ids(spark, 1, 2), graph.stubs["node"]).collect()
    pins = {r["id"]: r["low_pin"] for r in low}
    assert pins[1] == 0 and pins[2] == graph.watermark["node"] > 1500
    changes.export(graph, f"{tmp_path}/x")
    for g in (graph, changes.load(spark, f"{tmp_path}/x")):
        for read in (lambda: g.temporal.at(500, 1500), lambda: g.temporal.as_of(1500), lambda: g.temporal.effective(1500), lambda: g.temporal.timeline(2, 1500), lambda: g.nodes.all(QueryOpts(tx_pin=1500)), lambda: g.rels.effective_at(500, 1500)):
            with pytest.raises(errors.PinTooOld):
                read()
        assert g.temporal.timeline(1, 1500).count() == 1 and g.temporal.timelines_by_ids([1, 9], 1500).count() == 2
        assert g.temporal.at(g.now, pins[2]).count() == 5 and g.temporal.at(g.now).count() == 5


def test_purged_pins(graph, spark):
    graph.write(writes.delete, ids(spark, 3))
    graph.purge_expired("Person", graph.now + 1)
    assert {r["id"] for r in graph.node_versions.collect()} == {1, 2, 4, 5} and [r["id"] for r in graph.rel_versions.collect()] == [11]
    with pytest.raises(errors.PinTooOld):
        graph.temporal.at(500, 1500)


def test_update_everywhere(graph, spark):
    span = ids(spark, 1).select("id", F.lit(300).cast("long").alias("valid_from"), F.lit(400).cast("long").alias("valid_to"))
    graph.write(writes.correct, span.withColumn("patch", V.props(name=V.text(F.lit("x")))))
    graph.write(writes.excise, span.withColumns({"valid_from": F.lit(350).cast("long"), "valid_to": F.lit(500).cast("long")}))
    graph.write(writes.update_everywhere, ids(spark, 1).withColumn("patch", V.props(age=V.integer(F.lit(7)))))
    line = [(r["from"], r["to"], r["props"]["name"]["s"], r["props"]["age"]["l"]) for r in graph.temporal.timeline(1).collect()]
    assert line == [(100, 300, "p1", 7), (300, 350, "x", 7), (500, V.INF, "p1", 7)]
    with pytest.raises(errors.NotFound):
        graph.write(writes.update_everywhere, ids(spark, 99).withColumn("patch", V.props(age=V.integer(F.lit(7)))))


def test_update_everywhere_keeps_gaps(graph, spark):
    """A chain that tiles: [100, 300), a closed version until 400, then nothing, [600, 700) and nothing; and one with a retracted life."""
    rows = [(1, 1, 300, 400, 3000, False), (1, 2, 600, 700, 4000, False), (2, 1, 300, 400, 3000, True)]
    more = spark.createDataFrame(rows, "id long, version int, s long, e long, tx_from long, void boolean")
    first = graph.node_versions.where("id <= 2")
    more = more.join(first.select("id", "labels", "props"), "id").withColumns({"is_current": F.lit(False), "tx_to": F.lit(0).cast("long"), "deleted_at": F.lit(0).cast("long"), "retracted": F.lit(False), "kept": F.lit(False)})
    g = Graph(spark, graph.node_versions.unionByName(more), now=5000, has_voids=True)
    g.write(writes.delete, ids(spark, 3), retract=True)
    g.write(writes.add, people(spark).where("id = 3").select("id", "labels", "props", F.lit(500).cast("long").alias("s"), F.lit(V.INF).alias("e")))
    line = lambda: sorted((r["id"], r["from"], r["to"]) for r in g.temporal.effective().where("id <= 3").collect())
    before, pin = line(), g.now
    assert before == [(1, 100, 300), (1, 300, 400), (1, 600, 700), (2, 100, 300), (3, 500, V.INF)]
    for age in (7, 8):
        g.write(writes.update_everywhere, ids(spark, 1, 2, 3).withColumn("patch", V.props(age=V.integer(F.lit(age)))))
        assert line() == before and {r["props"]["age"]["l"] for r in g.temporal.effective().where("id <= 3").collect()} == {age}
    assert g.temporal.at(450).where("id <= 2").isEmpty() and g.temporal.during(450, 500).where("id <= 2").isEmpty()
    assert sorted((r["id"], r["from"], r["to"]) for r in g.temporal.effective(pin).where("id <= 3").collect()) == before


def test_replica(graph, spark):
    copy = Graph(spark, graph.node_versions, graph.rel_versions, now=2000, has_voids=False)
    before = graph.now
    graph.write(writes.update, ids(spark, 2).withColumn("patch", V.props(age=V.integer(F.lit(9)))))
    changed = changes.delta_since(graph.node_versions, before).orderBy("version")
    records = changed.withColumn("lsn", F.col("version") + 5)
    r = replica.Replica(copy)
    assert r.apply(records) == 6 and r.apply(records.withColumn("props", F.lit(None).cast(V.PROPS))) == 6
    assert r.apply(rels=graph.rel_versions.limit(0).withColumn("lsn", F.lit(9))) == 6
    assert copy.nodes.get(2)["props"]["age"]["l"] == 9 and copy.node_versions.count() == 6 and copy.now == graph.now
    with pytest.raises(ValueError):
        r.applied = 3


def test_hashes_hold_no_times(graph, spark):
    one = lambda v: {r["id"]: r["hash"] for r in integrity.with_hashes(v).collect()}
    v = graph.node_versions
    assert one(v) == one(v.withColumns({"s": F.col("s") + 1, "tx_from": F.col("tx_from") + 1}))
    assert one(v) != one(v.withColumn("labels", F.array(F.lit("A"))))


def test_backup_gap_is_refused(graph, spark, tmp_path):
    changes.backup(graph, f"{tmp_path}")
    graph.write(writes.delete, ids(spark, 1))
    graph.write(writes.delete, ids(spark, 2))
    changes.backup(graph, f"{tmp_path}", since=graph.now - 1)
    with pytest.raises(ValueError, match="begins at"):
        changes.backup_chain(spark, f"{tmp_path}")


def test_watch(spark, sf, tmp_path):
    log = changes.change_log(fixtures.chains(spark, sf, "c"))
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    seen = []
    q = watch.apply_changes(watch.watch(spark, f"{tmp_path}/log", 10), lambda df, n: seen.append((df.count(), df.agg(F.min("lsn")).first()[0])), f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert sum(n for n, _ in seen) == log.count() - 10 and min(x for _, x in seen) == 11
    assert changes.last_lsn(log) == log.count()


def test_compaction_and_tiers(spark, sf):
    v = fixtures.chains(spark, sf, "a")
    kept, stubs = admin.compact(v, 3, V.INF)
    n = {r["id"]: r["n"] for r in v.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["id"]: r["n"] for r in kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} == {i: min(x, 4) for i, x in n.items()}
    assert sum(r["trimmed"] for r in stubs.collect()) == sum(max(0, x - 4) for x in n.values())
    assert admin.tiers(v, ["User"]).select("class").distinct().first()[0] == "reference"
    assert admin.stored_sizes(v).where("size < 10").isEmpty()


def test_tags_and_pages(graph):
    graph.temporal.tag("before", 1500)
    assert graph.temporal.resolve_tag("before") == 1500 and graph.temporal.resolve_tag("x") is None
    with pytest.raises(ValueError):
        graph.temporal.tag("", 1)
    segs, cursor = graph.temporal.effective_page(0, "Person", "age", 10, None, 1)
    assert [r["id"] for r in segs.collect()] == [1] and cursor == 1
    assert graph.temporal.effective_page(0, "Person", "age", 10, cursor, 1)[1] is None


def test_values():
    assert V.key_of(3) == V.key_of(3.0) == "n:3" and V.key_of(-0.0) == "n:0"
    assert V.key_of(float("nan")) is None and V.key_of(True) == "b:true" and V.key_of("3") == "s:3"
    assert V.key_of(2**53 + 1) != V.key_of(float(2**53))


@pytest.mark.parametrize("x", [0.1, 1.5, 1e-5, 123456.789, 1.25e10 + 0.5, 3e300, 7.0, -2.5, 1e18, 5e-324])
def test_number_keys_agree(spark, x):
    got = spark.range(1).select(V.eqkey(V.real(F.lit(x)))).first()[0]
    assert got == V.key_of(x)


def test_mixed_columns(spark):
    g = Graph(spark, fixtures.values_fixture(spark), now=10, has_voids=False)
    with pytest.raises(errors.MixedNumericColumn):
        g.nodes.typed_columns("V", ["x"])


def test_allen_sets():
    assert A.compose({"before"}, {"before"}) == {"before"}
    assert A.compose({"before"}, {"after"}) == set(A.RELATIONS)
    assert A.inverse_set({"meets", "during"}) == {"met-by", "contains"}
    assert A.from_bits(A.to_bits({"equals", "after"})) == {"equals", "after"}
    assert len(A.composition()) == 169
    for (r, s), xs in A.composition().items():
        assert A.inverse_set(xs) == A.compose({A.INVERSE[s]}, {A.INVERSE[r]})


def test_calendar(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.truncate(F.lit(-1), "day")) == -86_400_000
    assert one(C.truncate(F.lit(V.INF), "year")) == V.INF
    assert one(C.ceil(F.lit(1), "hour")) == 3_600_000 and one(C.ceil(F.lit(3_600_000), "hour")) == 3_600_000
    assert one(C.round_half_up(F.lit(1_800_000), "hour")) == 3_600_000 and one(C.round_half_up(F.lit(1_799_999), "hour")) == 0


def test_recurrence(spark):
    a, day = C.EPOCH_2026, 86_400_000
    assert C.expand(spark, C.Recurrence("monthly", month_day=0), a, a + 365 * day).count() == 12
    # a daily pattern has a mask, too; what has begun before is clipped, and nothing is empty
    got = C.expand(spark, C.Recurrence("daily", 0, 7_200_000, weekdays=(3, 4)), a + 3_600_000, a + 8 * day).orderBy("start").collect()
    assert [((r["start"] - a) // day, r["end"] - r["start"]) for r in got] == [(0, 3_600_000), (1, 7_200_000), (7, 7_200_000)]
    for bad in (C.Recurrence("weekly"), C.Recurrence("monthly", month_day=29), C.Recurrence("daily", 5, 5, weekdays=(0,)), C.Recurrence("yearly", month=13)):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(errors.InvalidTimeRange):
        C.expand(spark, C.Recurrence("monthly"), a, a)
    with pytest.raises(errors.InvalidTimeRange):
        C.expand(spark, C.Recurrence("monthly"), 0, C.MAX_SPAN + 1)


def test_plan_shuffles_once(spark, sf, tmp_path):
    """All windows of a timeline share one exchange by id, and no join is needed."""
    fixtures.chains(spark, sf).write.parquet(f"{tmp_path}/v")
    plan = K.segments(spark.read.parquet(f"{tmp_path}/v"))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    plan = K.segments(spark.read.parquet(f"{tmp_path}/v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_writes_refuse_what_they_cannot_apply(graph, spark):
    patch = V.props(age=V.integer(F.lit(7)))
    changes = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").withColumn("patch", patch)
    now = graph.now
    with pytest.raises(errors.NotFound):
        graph.write(writes.update, changes([3, 987654]))
    with pytest.raises(errors.GraphError):
        graph.write(writes.update, changes([3, 3]))
    with pytest.raises(errors.NotFound):
        graph.write(writes.delete, changes([987654]).select("id"))
    assert graph.now == now
    graph.write(writes.update_in_place, changes([3]))
    assert graph.compare_and_set(3, "age", 7, V.integer(F.lit(8))) and not graph.compare_and_set(3, "age", 7, V.integer(F.lit(9)))


def test_plans_of_many_writes_are_linear(graph, spark):
    start = writes.add(graph.node_versions, spark.createDataFrame([(424242, ["Person"])], "id long, labels array<string>").withColumn("props", V.props(age=V.integer(F.lit(0)))), graph.now + 1)
    v, scans = start.cache(), []
    for i in range(4):
        v = writes.update(v, spark.createDataFrame([(424242,)], "id long").withColumn("patch", V.props(age=V.integer(F.lit(i)))), graph.now + 2 + i)
        scans.append(v._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation"))
    assert scans == [1, 1, 1, 1] and v.where("id = 424242").count() == 5 and v.where("id = 424242 and is_current").first()["version"] == 4


def test_minted_ids_of_large_partitions_differ(spark):
    minter = sessions.IdMinter(node=3)
    df = spark.range(0, 300_000, 1, 3).select("id")
    a, b = minter.column(df, "x"), minter.column(df, "x")
    both = a.select("x").union(b.select("x"))
    assert both.distinct().count() == 600_000 and a.agg(F.max("x")).first()[0] < b.agg(F.min("x")).first()[0] < minter.next_id()
