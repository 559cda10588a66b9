"""Graph views of the driver tables: a star-schema graph, bitemporal chains from events, and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.functions import values as V
from strataspan.plans.lineage import checkpointed

DAY = 86_400_000
#: Node codes and relationship codes of the star-schema graph; an id is code * 10^12 + key.
CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}
REL_CODES = {"IN_REGION": 11, "IN_NATION_CUSTOMER": 12, "IN_NATION_SUPPLIER": 13, "PLACED": 14, "CONTAINS": 15, "SUPPLIED_BY": 16}
BIG = 1_000_000_000_000
#: Columns of a version row besides what the entity carries.
TIMES = ["s", "e", "tx_from", "tx_to", "deleted_at", "retracted", "void", "kept"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(name: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def versioned(df: DataFrame, **given: Column) -> DataFrame:
    """Fill in the version columns that are not given: version 0, current, recorded at 1000, valid always."""
    defaults = {
        "version": F.lit(0),
        "is_current": F.lit(True),
        "s": F.lit(V.NEG),
        "e": F.lit(V.INF),
        "tx_from": F.lit(1000),
        "tx_to": F.lit(0),
        "deleted_at": F.lit(0),
        "retracted": F.lit(False),
        "void": F.lit(False),
        "kept": F.lit(False),
    }
    kinds = {"version": "int", "is_current": "boolean", "retracted": "boolean", "void": "boolean", "kept": "boolean"}
    return df.withColumns({k: given.get(k, c).cast(kinds.get(k, "bigint")) for k, c in defaults.items()})


def node_id(label: str, key: str) -> Column:
    return F.col(key).cast("bigint") + CODES[label] * BIG


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders as nodes of one version each."""

    def nodes(table: str, label: str, key: str, labels: Column, values: dict[str, Column]) -> DataFrame:
        t = read(spark, sf_dir, table)
        return t.select(node_id(label, key).alias("id"), labels.alias("labels"), V.record(**values).alias("props"))

    one = lambda label: F.array(F.lit(label))
    c = F.col
    all_ = (
        nodes("region", "Region", "r_regionkey", one("Region"), {"name": V.text(c("r_name"))})
        .unionByName(nodes("nation", "Nation", "n_nationkey", one("Nation"), {"name": V.text(c("n_name"))}))
        .unionByName(nodes("customer", "Customer", "c_custkey", F.array(F.lit("Customer"), c("c_mktsegment")), {"name": V.text(c("c_name")), "acctbal": V.real(c("c_acctbal")), "segment": V.text(c("c_mktsegment"))}))
        .unionByName(nodes("supplier", "Supplier", "s_suppkey", one("Supplier"), {"name": V.text(c("s_name")), "acctbal": V.real(c("s_acctbal"))}))
        .unionByName(nodes("part", "Part", "p_partkey", one("Part"), {"name": V.text(c("p_name")), "brand": V.text(c("p_brand")), "type": V.text(c("p_type")), "size": V.integer(c("p_size"), "i32"), "price": V.real(c("p_retailprice"))}))
        .unionByName(nodes("orders", "Order", "o_orderkey", one("Order"), {"status": V.text(c("o_orderstatus")), "total": V.real(c("o_totalprice")), "priority": V.text(c("o_orderpriority"))}))
    )
    return versioned(all_)


#: Full-row order of lineitem: its keys repeat, so only all columns together number its rows.
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def numbered(df: DataFrame, by: list[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """df with `name`: the row's number, from 1, in the order of `by`: range partitions, sorted alone, plus the rows before each.

    Equal rows get their numbers in any order. The sorted partitions are materialised, as both their counts (`ranges` rows at most)
    and the rows are read, and both must see the same partitions.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = counts.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_first", "_before")


def star_rels(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ("IN_REGION", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY")) -> DataFrame:
    """The star schema's foreign keys as relationships. PLACED and CONTAINS are valid from the order date.

    Each table has a row number for ids, except that a key which is unique already numbers its rows.
    """
    out = []
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{V.PV}>"))

    def rel(t: DataFrame, kind: str, code: str, key: Column, start: Column, end: Column, props: Column = none, s: Column | None = None) -> DataFrame:
        out_ = t.select((key.cast("bigint") + REL_CODES[code] * BIG).alias("id"), F.lit(kind).alias("type"), start.alias("start_id"), end.alias("end_id"), props.alias("props"), (s if s is not None else F.lit(V.NEG)).alias("_s"))
        return versioned(out_, s=F.col("_s")).drop("_s")

    if "IN_REGION" in types:
        out.append(rel(read(spark, sf_dir, "nation"), "IN_REGION", "IN_REGION", F.col("n_nationkey"), node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey")))
    if "IN_NATION" in types:
        out.append(rel(read(spark, sf_dir, "customer"), "IN_NATION", "IN_NATION_CUSTOMER", F.col("c_custkey"), node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey")))
        out.append(rel(read(spark, sf_dir, "supplier"), "IN_NATION", "IN_NATION_SUPPLIER", F.col("s_suppkey"), node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey")))
    orders = read(spark, sf_dir, "orders")
    if "PLACED" in types:
        out.append(rel(orders, "PLACED", "PLACED", F.col("o_orderkey"), node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey"), s=_epoch("o_orderdate")))
    if "CONTAINS" in types:
        lines = numbered(read(spark, sf_dir, "lineitem").select(*LINE_ORDER), LINE_ORDER).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        values = V.record(quantity=V.real(F.col("l_quantity")), price=V.real(F.col("l_extendedprice")), flag=V.text(F.col("l_returnflag")))
        out.append(rel(lines, "CONTAINS", "CONTAINS", F.col("rn"), node_id("Order", "l_orderkey"), node_id("Part", "l_partkey"), values, _epoch("o_orderdate")))
    if "SUPPLIED_BY" in types:
        pairs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
        # the pair itself numbers the relationship, as far as suppliers are fewer than a million
        out.append(rel(pairs, "SUPPLIED_BY", "SUPPLIED_BY", F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"), node_id("Part", "l_partkey"), node_id("Supplier", "l_suppkey")))
    first, *more = out
    for d in more:
        first = first.unionByName(d)
    return first


def chains(spark: SparkSession, sf_dir: str, variant: str = "b") -> DataFrame:
    """Version chains from events, an entity a user. Variants: a plain rows; b with bounded corrections (event_id % 7 = 0); c = b with
    deletes (users % 10 = 0; % 20 = 0 retracted); d = b with void corrections (event_id % 11 = 0)."""
    ev = read(spark, sf_dir, "events")
    by_user = Window.partitionBy("id").orderBy("t", "event_id")
    e = ev.select(F.col("user_id").alias("id"), _epoch("ts").alias("t"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    e = e.withColumn("version", (F.row_number().over(by_user) - 1).cast("int")).withColumn("cor", (F.col("event_id") % 7 == 0) & (F.col("version") > 0))
    e = e.where(~F.col("cor")) if variant == "a" else e
    same = Window.partitionBy("id", "cor").orderBy("version")
    following = F.lead(F.col("t") + 30_000).over(same)
    last = ~F.col("cor") & following.isNull()
    dead = last & (F.col("id") % 10 == 0) if variant == "c" else F.lit(False)
    stamp = F.max(F.col("t") + 30_000).over(Window.partitionBy("id")) + 1
    void = F.col("cor") & (F.col("event_id") % 11 == 0) if variant == "d" else F.lit(False)
    e = e.withColumns({"last": last, "dead": dead, "void": void, "next": following}).withColumn("stamp", F.when(F.col("dead"), stamp))
    c = F.col
    rows = e.select(
        "id",
        F.array(F.lit("User"), c("event_type")).alias("labels"),
        F.when(~c("void"), V.record(event_type=V.text(c("event_type")), value=V.real(c("value")), k=V.integer(c("k")))).alias("props"),
        c("version").alias("_version"),
        c("last").alias("_last"),
        F.when(c("cor"), c("t") - DAY).otherwise(c("t")).alias("_s"),
        F.when(c("cor"), c("t") - DAY // 2).otherwise(F.coalesce("stamp", F.lit(V.INF))).alias("_e"),
        (c("t") + 30_000).alias("_tx"),
        F.when(c("cor"), F.lit(0)).otherwise(F.coalesce("stamp", "next", F.lit(0))).alias("_to"),
        F.coalesce("stamp", F.lit(0)).alias("_del"),
        (c("dead") & (c("id") % 20 == 0)).alias("_retracted"),
        c("void").alias("_void"),
    )
    return versioned(
        rows, version=c("_version"), is_current=c("_last") & (c("_del") == 0), s=c("_s"), e=c("_e"), tx_from=c("_tx"), tx_to=c("_to"), deleted_at=c("_del"), retracted=c("_retracted"), void=c("_void")
    ).drop("_version", "_last", "_s", "_e", "_tx", "_to", "_del", "_retracted", "_void")


def probes(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Probe instants: lo and hi of the events' times; pNN, NN hundredths of the way between them."""
    r = read(spark, sf_dir, "events").agg(F.min(_epoch("ts")), F.max(_epoch("ts"))).first()
    lo, hi = r[0], r[1]
    return {"lo": lo, "hi": hi} | {f"p{n}": lo + (hi - lo) * n // 100 for n in (10, 30, 50, 60, 70, 90)}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node a row of embeddings, labelled Vec and its cluster."""
    t = read(spark, sf_dir, "embeddings")
    return versioned(t.select(F.col("vec_id").alias("id"), F.array(F.lit("Vec"), F.concat(F.lit("c"), F.col("label").cast("string"))).alias("labels"), V.record(embedding=V.vector(F.col("embedding"))).alias("props")))


def values_fixture(spark: SparkSession) -> DataFrame:
    """One label, key x, in all kinds of stored values: for equality, order, classes and bounds."""
    rows = [
        ("i64", 3, None, None, None, None), ("f64", None, 3.0, None, None, None), ("f32", None, 0.10000000149011612, None, None, None), ("f64", None, 0.1, None, None, None),
        ("f64", None, -0.0, None, None, None), ("i64", 0, None, None, None, None), ("f64", None, float("nan"), None, None, None), ("f64", None, float("inf"), None, None, None),
        ("f64", None, float("-inf"), None, None, None), ("i64", 2**53 + 1, None, None, None, None), ("f64", None, float(2**53), None, None, None), ("s", None, None, "3", None, None),
        ("b", None, None, None, True, None), ("list", None, None, None, None, ["s:prod", "s:dev", "s:prod"]), ("map", None, None, None, None, None), ("tv", None, None, "date:2026-01-31", None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, t string, l long, d double, s string, b boolean, arr array<string>")
    value = F.when(F.col("t").isNotNull(), F.struct("t", "l", "d", F.col("s"), "b", F.lit(None).cast("decimal(20,0)").alias("u"), "arr", F.lit(None).cast("array<float>").alias("vec")))
    return versioned(df.select("id", F.array(F.lit("V")).alias("labels"), V.props(x=value).alias("props")))
