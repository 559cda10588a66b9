import pytest
from pyspark.sql import functions as F

from strataspan import errors
from strataspan.functions import values as V
from strataspan.functions.calendar import decompose_id
from strataspan.graph import Graph
from strataspan.operators import writes
from strataspan.operators.sessions import IdMinter, Registry, Session, Transaction
from strataspan.sources import changes, fixtures, tiers
from strataspan.streaming.bus import AsyncEventBus, EventBus


@pytest.fixture
def graph(spark):
    df = spark.range(1, 4).select("id", F.array(F.lit("P")).alias("labels"), V.props(n=V.integer(F.col("id"))).alias("props"))
    return Graph(spark, fixtures.versioned(df, s=F.lit(5)), now=2000, has_voids=False)


def one(spark, id_, n):
    return spark.createDataFrame([(id_,)], "id long").withColumn("patch", V.props(n=V.integer(F.lit(n))))


def test_transaction(graph, spark):
    with Transaction(graph) as tx:
        tx.write(writes.update, one(spark, 1, 9))
    assert graph.nodes.get(1)["props"]["n"]["l"] == 9
    with pytest.raises(RuntimeError), Transaction(graph) as tx:
        tx.write(writes.update, one(spark, 1, 10))
        raise RuntimeError
    assert graph.nodes.get(1)["props"]["n"]["l"] == 9


def test_constraints_hold_at_commit(graph, spark):
    graph.registry = Registry()
    graph.registry.create_unique(graph, "P", "n")
    with pytest.raises(errors.UniqueViolation), Transaction(graph) as tx:
        tx.write(writes.update, one(spark, 1, 2))
    assert graph.nodes.get(1)["version"] == 0
    s = Session(graph)
    s.add(writes.update, one(spark, 1, 50))
    assert s.pending == 1 and s.submit() == 1
    s.wait_applied(1)
    assert graph.nodes.get(1)["props"]["n"]["l"] == 50
    with pytest.raises(errors.UniqueViolation):
        graph.registry.create_unique(Graph(spark, graph.node_versions.withColumn("props", V.props(n=V.integer(F.lit(1)))), now=1), "P", "n", forever=True)


def test_minted_ids(spark):
    m = IdMinter(node=3)
    ids = [m.next_id() for _ in range(3000)]
    assert ids == sorted(set(ids))
    row = spark.createDataFrame([(ids[0],)], "id long").select(*[c.alias(n) for n, c in decompose_id(F.col("id")).items()]).first()
    assert row["node"] == 3
    minted = m.column(spark.range(0, 1000, 1, 4).drop("id"))
    assert minted.select("id").distinct().count() == 1000


def test_buses(spark, sf):
    log = changes.change_log(fixtures.chains(spark, sf, "c")).limit(200).cache()
    seen, bus = [], EventBus()
    bus.on(lambda r: seen.append((r["priority"], r["lsn"])))
    bus.publish(log)
    assert len(seen) == 200 and seen == sorted(seen)
    late = AsyncEventBus()
    late.on(lambda r: seen.append(r["lsn"]), {"delete"})
    late.publish(log)
    late.drain()
    assert late.dropped == 0


def test_tiers(spark, sf, tmp_path):
    v = fixtures.chains(spark, sf, "a")
    tiers.write(v, f"{tmp_path}/t", [])
    assert tiers.read(spark, f"{tmp_path}/t").count() == v.count()
    tiers.move(spark, f"{tmp_path}/t", f"{tmp_path}/u", v.where("id = 3").select("id"), "archive")
    assert tiers.read(spark, f"{tmp_path}/u").where("id = 3").isEmpty()
    assert tiers.read(spark, f"{tmp_path}/u", archived=True).count() == v.count()
    assert "PartitionFilters: [isnotnull(tier" in tiers.read(spark, f"{tmp_path}/u")._jdf.queryExecution().executedPlan().toString()
    assert sum(r["rows"] for r in tiers.shards(spark, f"{tmp_path}/u").collect()) == v.count()
