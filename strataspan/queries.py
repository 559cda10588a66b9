"""The catalogue: a query for each door that gives rows, over the graph views of the driver tables, and the SQL that checks it.

SQL sides are written from the rules, not from the plans: points by ranking, timelines by cut points and an interval join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.functions import allen as A
from strataspan.functions import calendar as C
from strataspan.functions import values as V
from strataspan.graph import Graph
from strataspan.operators import admin, constraints, integrity, writes
from strataspan.operators.index import envelopes, postings
from strataspan.operators.temporal import meets_window
from strataspan.plans import kernels as K
from strataspan.plans.opts import QueryOpts
from strataspan.sources import changes, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Fixed parts of the SQL side: the fixtures' definitions.
INF, NEG = "9223372036854775807", "(-9223372036854775808)"
EV = f"""
ev AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS t, event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS version FROM events),
lim AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
p AS (SELECT lo, hi, {", ".join(f"lo + (hi - lo) * {n} // 100 AS p{n}" for n in (10, 30, 50, 60, 70, 90))} FROM lim),
e0 AS (SELECT *, (event_id % 7 = 0 AND version > 0) AS cor FROM ev),
e1 AS (SELECT *, lead(t + 30000) OVER (PARTITION BY id, cor ORDER BY version) AS nxt, max(t + 30000) OVER (PARTITION BY id) + 1 AS stamp FROM e0),
e2 AS (SELECT *, (NOT cor AND nxt IS NULL) AS last FROM e1)"""


def chain_sql(variant: str = "b") -> str:
    """CTEs ending in v, the version table of a variant."""
    dead = "(last AND id % 10 = 0)" if variant == "c" else "false"
    void = "(cor AND event_id % 11 = 0)" if variant == "d" else "false"
    ev = EV.replace("FROM e0)", "FROM e0 WHERE NOT cor)") if variant == "a" else EV
    return f"""{ev},
v AS (SELECT id, event_type, value, k, version, last AND NOT {dead} AS is_current, t + 30000 AS tx_from,
             CASE WHEN cor THEN t - 86400000 ELSE t END AS s,
             CASE WHEN cor THEN t - 43200000 WHEN {dead} THEN stamp ELSE {INF} END AS e,
             CASE WHEN cor THEN 0 WHEN {dead} THEN stamp ELSE coalesce(nxt, 0) END AS tx_to,
             CASE WHEN {dead} THEN stamp ELSE 0 END AS deleted_at, ({dead} AND id % 20 = 0) AS retracted, {void} AS void
      FROM e2)"""


def visible_sql(pin: str) -> str:
    """vis: v as recorded by the pin, deletes after it undone, lives ended by a retraction left out, ends cut at deletes."""
    return f"""
vis0 AS (SELECT v.* REPLACE (CASE WHEN deleted_at > ({pin}) AND e = deleted_at THEN {INF} ELSE e END AS e,
                             CASE WHEN deleted_at > ({pin}) THEN 0 ELSE tx_to END AS tx_to,
                             (retracted AND deleted_at <= ({pin})) AS retracted,
                             CASE WHEN deleted_at > ({pin}) THEN 0 ELSE deleted_at END AS deleted_at)
         FROM v WHERE tx_from <= ({pin})),
death AS (SELECT a.id, a.version, min(b.deleted_at) AS died, bool_or(b.retracted) AS gone FROM vis0 a JOIN vis0 b ON a.id = b.id AND b.deleted_at > 0 AND b.deleted_at >= a.tx_from GROUP BY 1, 2),
vis AS (SELECT vis0.* REPLACE (least(e, coalesce(died, {INF})) AS e) FROM vis0 LEFT JOIN death USING (id, version) WHERE NOT coalesce(gone, false))"""


def own_sql(pin: str) -> str:
    """own: rows with the bounds by which points are resolved, and their rank r1, r2. A chain whose starts never fall back tiles: an open
    row ends at the next start, and the highest position wins. Otherwise newer replacing rows end older beliefs, and the newest wins."""
    return f"""{visible_sql(pin)},
rep AS (SELECT DISTINCT q.id, q.s, q.tx_from, q.version FROM vis q JOIN vis r ON q.id = r.id AND r.tx_to > r.tx_from AND r.deleted_at = 0 AND q.tx_from = r.tx_to AND q.version > r.version),
cap AS (SELECT a.id, a.version, min(q.s) AS cap FROM vis a JOIN rep q ON a.id = q.id AND q.s >= a.s AND (q.tx_from > a.tx_from OR (q.tx_from = a.tx_from AND q.version > a.version)) GROUP BY 1, 2),
falls AS (SELECT id, coalesce(s < lag(s) OVER w OR (s = lag(s) OVER w AND e < lag(e) OVER w), false) AS fall FROM vis WINDOW w AS (PARTITION BY id ORDER BY version)),
kind AS (SELECT id, bool_or(fall) AS cascade FROM falls GROUP BY id),
nexts AS (SELECT id, version, lead(s) OVER (PARTITION BY id ORDER BY s, version) AS next FROM vis),
own AS (SELECT vis.* REPLACE (CASE WHEN cascade THEN least(e, coalesce(cap, {INF})) WHEN e = {INF} THEN coalesce(next, {INF}) ELSE e END AS e),
               CASE WHEN cascade THEN tx_from ELSE s END AS r1, version AS r2
        FROM vis LEFT JOIN cap USING (id, version) JOIN kind USING (id) JOIN nexts USING (id, version))"""


def eff_sql(pin: str) -> str:
    """eff: effective segments (f, u) with their rows, void ones included."""
    return f"""{own_sql(pin)},
cut AS (SELECT id, x AS f, lead(x) OVER (PARTITION BY id ORDER BY x) AS u FROM (SELECT id, s AS x FROM own WHERE s < e UNION SELECT id, e FROM own WHERE s < e)),
piece AS (SELECT c.id, c.f, c.u, arg_max(o.version, (o.r1, o.r2)) AS version FROM cut c JOIN own o ON o.id = c.id AND o.s <= c.f AND o.e >= c.u AND o.s < o.e WHERE c.u IS NOT NULL GROUP BY 1, 2, 3),
mark AS (SELECT *, CASE WHEN lag(version) OVER w = version AND lag(u) OVER w = f THEN 0 ELSE 1 END AS new FROM piece WINDOW w AS (PARTITION BY id ORDER BY f)),
run AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY f) AS g FROM mark),
eff AS (SELECT r.id, min(f) AS f, max(u) AS u, any_value(r.version) AS version FROM run r GROUP BY r.id, g)"""


def at_sql(t: str, pin: str) -> str:
    """won: the row of each entity that is valid at t as recorded at the pin."""
    return f"""{own_sql(pin)},
won AS (SELECT * FROM (SELECT own.*, row_number() OVER (PARTITION BY id ORDER BY r1 DESC, r2 DESC) AS rn FROM own WHERE s <= ({t}) AND e > ({t}) AND s < e) WHERE rn = 1 AND NOT void)"""


P = lambda n: f"SELECT {n} FROM p"
HI = "SELECT hi + 60000 FROM p"
ROW = "id, version, event_type, round(value, 6) AS value, k"


def row(df: DataFrame, *more: str | Column) -> DataFrame:
    p = F.col("props")
    return df.select("id", "version", p["event_type"]["s"].alias("event_type"), F.round(p["value"]["d"], 6).alias("value"), p["k"]["l"].alias("k"), *more)


def _chain(spark: SparkSession, sf_dir: str, variant: str = "b") -> tuple[Graph, dict[str, int]]:
    p = fixtures.probes(spark, sf_dir)
    return Graph(spark, fixtures.chains(spark, sf_dir, variant), now=p["hi"] + 60_000, has_voids=variant == "d"), p


# points


@query(f"WITH {chain_sql()}, {at_sql(P('p60'), P('p70'))} SELECT {ROW} FROM won")
def node_at_tx(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.temporal.at(p["p60"], p["p70"]))


@query(f"WITH {chain_sql()}, {at_sql(P('p50'), HI)} SELECT {ROW} FROM won")
def nodes_at(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.temporal.at(p["p50"]))


@query(f"WITH {chain_sql('a')}, {at_sql(P('p60'), P('p70'))} SELECT {ROW} FROM won")
def node_at_tx_tiling(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "a")
    return row(g.temporal.at(p["p60"], p["p70"]))


@query(f"WITH {chain_sql('c')}, {at_sql(P('p70'), HI)} SELECT {ROW} FROM won")
def nodes_at_deleted(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "c")
    return row(g.temporal.at(p["p70"]))


@query(f"WITH {chain_sql('c')}, {at_sql(P('p90'), P('p90'))} SELECT {ROW} FROM won")
def nodes_at_before_delete(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "c")
    return row(g.temporal.at(p["p90"], p["p90"]))


@query(f"WITH {chain_sql('d')}, {at_sql(P('p50'), HI)} SELECT {ROW} FROM won")
def nodes_at_void(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "d")
    return row(g.temporal.at(p["p50"]))


AS_OF = f"""
cand AS (SELECT * FROM v WHERE NOT void AND tx_from > 0 AND tx_from <= (SELECT pin FROM q)),
top AS (SELECT id, max(version) AS version FROM cand GROUP BY id),
cur AS (SELECT id, version, tx_from FROM cand WHERE is_current AND tx_to = 0),
pick AS (SELECT t.id, CASE WHEN c.version IS NULL THEN t.version
                 ELSE coalesce((SELECT max(h.version) FROM cand h WHERE h.id = t.id AND h.version > c.version AND h.tx_from >= c.tx_from), c.version) END AS version, c.version AS cur
         FROM top t LEFT JOIN cur c USING (id)),
ans AS (SELECT v.* FROM v JOIN pick USING (id, version)
        WHERE NOT (v.tx_to <> 0 AND v.tx_to <= (SELECT pin FROM q)) AND NOT (v.deleted_at <> 0 AND v.deleted_at <= (SELECT pin FROM q))
          AND NOT (pick.cur IS NULL AND EXISTS (SELECT 1 FROM v h WHERE h.id = v.id AND h.version = (SELECT max(x.version) FROM v x WHERE x.id = v.id AND x.version < v.version AND x.tx_to <> 0 AND x.tx_to >= x.tx_from)
                                                AND h.deleted_at > v.tx_from AND h.deleted_at <= (SELECT pin FROM q))))"""


@query(f"WITH {chain_sql()}, q AS (SELECT p70 AS pin FROM p), {AS_OF} SELECT {ROW} FROM ans")
def nodes_as_of(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.temporal.as_of(p["p70"]))


@query(f"WITH {chain_sql('c')}, q AS (SELECT hi + 60000 AS pin FROM p), {AS_OF} SELECT {ROW} FROM ans")
def nodes_as_of_deleted(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "c")
    return row(g.temporal.as_of(p["hi"] + 60_000))


@query(f"WITH {chain_sql()}, {at_sql(P('p60'), P('p70'))}, want AS (SELECT unnest([3, 999999, 1, 7]) AS id, unnest([0, 1, 2, 3]) AS pos) SELECT pos, want.id, coalesce(version, -1) AS version FROM want LEFT JOIN won USING (id)")
def nodes_at_tx_by_ids(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return g.temporal.at_by_ids([3, 999999, 1, 7], p["p60"], p["p70"]).select("pos", "id", F.coalesce("version", F.lit(-1)).alias("version"))


# intervals


def dur_sql(a: str, b: str, pin: str, predicate: str = "true") -> str:
    """The newest row by positional bounds with a part outside void spans in [a, b)."""
    return f"""{eff_sql(pin)},
pos AS (SELECT vis.* REPLACE (CASE WHEN e = {INF} THEN coalesce(lead(s) OVER (PARTITION BY id ORDER BY s, version), {INF}) ELSE e END AS e) FROM vis),
vspan AS (SELECT eff.id, f, u FROM eff JOIN v USING (id, version) WHERE v.void),
lo AS (SELECT pos.*, greatest(s, ({a})) AS x, least(e, ({b})) AS y FROM pos WHERE NOT void AND {predicate}),
bound AS (SELECT id, version, x, y, x AS c FROM lo WHERE x < y UNION SELECT lo.id, lo.version, x, y, u FROM lo JOIN vspan m ON m.id = lo.id AND m.u >= x AND m.u < y WHERE x < y),
free AS (SELECT DISTINCT b.id, b.version FROM bound b WHERE NOT EXISTS (SELECT 1 FROM vspan m WHERE m.id = b.id AND m.f <= b.c AND m.u > b.c)),
dur AS (SELECT * FROM (SELECT pos.*, row_number() OVER (PARTITION BY pos.id ORDER BY s DESC, version DESC) AS rn FROM pos JOIN free USING (id, version)) WHERE rn = 1)"""


@query(f"WITH {chain_sql()}, {dur_sql(P('p30'), P('p50'), P('p70'))} SELECT {ROW} FROM dur")
def nodes_during_tx(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.temporal.during(p["p30"], p["p50"], p["p70"]))


@query(f"WITH {chain_sql('d')}, {dur_sql(P('p30'), P('p50'), HI)} SELECT {ROW} FROM dur")
def nodes_during_void(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "d")
    return row(g.temporal.during(p["p30"], p["p50"]))


@query(f"WITH {chain_sql()}, {dur_sql(P('p30'), P('p50'), HI, 'event_type = (SELECT max(event_type) FROM ev)')} SELECT {ROW} FROM dur")
def property_during(spark, sf_dir):
    """The predicate is tested on every version before the newest is chosen."""
    g, p = _chain(spark, sf_dir)
    top = fixtures.read(spark, sf_dir, "events").agg(F.max("event_type")).first()[0]
    return row(g.nodes.by_property("User", "event_type", top, QueryOpts(during=(p["p30"], p["p50"]))))


def _allen_sql(a: str, b: str) -> str:
    return f"""CASE WHEN s >= e THEN NULL WHEN e < ({a}) THEN 'before' WHEN s > ({b}) THEN 'after' WHEN e = ({a}) THEN 'meets' WHEN s = ({b}) THEN 'met-by'
      WHEN s = ({a}) AND e = ({b}) THEN 'equals' WHEN s = ({a}) AND e < ({b}) THEN 'starts' WHEN s = ({a}) THEN 'started-by' WHEN e = ({b}) AND s > ({a}) THEN 'finishes'
      WHEN e = ({b}) THEN 'finished-by' WHEN s > ({a}) AND e < ({b}) THEN 'during' WHEN s < ({a}) AND e > ({b}) THEN 'contains' WHEN s < ({a}) THEN 'overlaps' ELSE 'overlapped-by' END"""


def rel_sql(a: str, b: str, wanted: str) -> str:
    return f"""{visible_sql(HI)},
pos AS (SELECT vis.* REPLACE (CASE WHEN e = {INF} THEN coalesce(lead(s) OVER (PARTITION BY id ORDER BY s, version), {INF}) ELSE e END AS e) FROM vis),
hit AS (SELECT *, {_allen_sql(a, b)} AS relation FROM pos),
dur AS (SELECT * FROM (SELECT hit.*, row_number() OVER (PARTITION BY id ORDER BY s DESC, version DESC) AS rn FROM hit WHERE relation IN ({wanted})) WHERE rn = 1)"""


@query(f"WITH {chain_sql()}, {rel_sql(P('p30'), P('p50'), repr('during') + ', ' + repr('starts') + ', ' + repr('finishes'))} SELECT {ROW} FROM dur")
def nodes_relating_inside(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.temporal.relating(p["p30"], p["p50"], {"during", "starts", "finishes"}))


@query(f"WITH {chain_sql()}, {rel_sql(P('p30'), P('p50'), repr('overlaps') + ', ' + repr('overlapped-by'))} SELECT {ROW} FROM dur")
def nodes_relating_overlap(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.temporal.relating(p["p30"], p["p50"], {"overlaps", "overlapped-by"}))


@query(f"WITH {chain_sql('a')}, {visible_sql(HI)}, pos AS (SELECT vis.* REPLACE (coalesce(lead(s) OVER (PARTITION BY id ORDER BY s, version), {INF}) AS e) FROM vis), r AS (SELECT {_allen_sql(P('p30'), P('p50'))} AS relation FROM pos) SELECT relation, count(*) AS n FROM r GROUP BY 1")
def allen_matrix(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "a")
    rows = K.positional(g.node_versions)
    return rows.select(A.allen(F.col("s"), F.col("e"), F.lit(p["p30"]), F.lit(p["p50"])).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


SPANS6 = "sp AS (SELECT a.range AS s, b.range AS e FROM range(6) a, range(6) b WHERE a.range < b.range)"


@query(
    f"WITH {SPANS6}, r AS (SELECT x.s AS xs, x.e AS xe, y.s AS ys, y.e AS ye, {_allen_sql('y.s', 'y.e').replace('WHEN s ', 'WHEN x.s ').replace('WHEN e ', 'WHEN x.e ').replace('AND e ', 'AND x.e ').replace('AND s ', 'AND x.s ').replace('>= e', '>= x.e')} AS relation FROM sp x, sp y)"
    " SELECT DISTINCT a.relation AS first, b.relation AS second, c.relation AS composed FROM r a JOIN r b ON a.ys = b.xs AND a.ye = b.xe JOIN r c ON c.xs = a.xs AND c.xe = a.xe AND c.ys = b.ys AND c.ye = b.ye"
)
def allen_composition(spark, sf_dir):
    table = [(r, s, x) for (r, s), xs in A.composition().items() for x in xs]
    return spark.createDataFrame(table, "first string, second string, composed string")


# effective timelines

EFF_ROW = "eff.id, f AS valid_from, u AS valid_to, eff.version, v.event_type"


def seg(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "version", F.col("props")["event_type"]["s"].alias("event_type"))


def eff_query(variant: str, pin: str, where: str = "true") -> str:
    return f"WITH {chain_sql(variant)}, {eff_sql(pin)} SELECT {EFF_ROW} FROM eff JOIN v USING (id, version) WHERE NOT v.void AND {where}"


@query(eff_query("b", P("p70")))
def effective_timeline(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return seg(g.temporal.effective(p["p70"]))


@query(eff_query("a", HI))
def effective_timeline_tiling(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "a")
    return seg(g.temporal.effective())


@query(eff_query("c", HI))
def effective_timeline_deleted(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return seg(g.temporal.effective())


@query(eff_query("d", HI))
def effective_timeline_void(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "d")
    return seg(g.temporal.effective())


@query(eff_query("b", P("p70"), "eff.id = 3"))
def effective_timeline_one(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return seg(g.temporal.timeline(3, p["p70"]))


@query(eff_query("b", P("p70"), "eff.id = 3 AND u >= (SELECT p50 FROM p)"))
def effective_timeline_from(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return seg(g.temporal.timeline(3, p["p70"], valid_from=p["p50"]))


@query(eff_query("b", P("p70"), "((f < (SELECT p30 FROM p) AND u > (SELECT p10 FROM p)) OR (f < (SELECT p60 FROM p) AND u > (SELECT p50 FROM p)))"))
def effective_window(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return seg(g.temporal.effective(p["p70"]).where(meets_window([(p["p10"], p["p30"]), (p["p50"], p["p60"])])))


@query(f"WITH {chain_sql()}, {eff_sql(P('p70'))}, s AS (SELECT {EFF_ROW} FROM eff JOIN v USING (id, version) WHERE v.event_type = (SELECT min(event_type) FROM ev)) SELECT * FROM s WHERE id IN (SELECT id FROM s WHERE valid_to >= (SELECT p60 FROM p))")
def effective_by_labels_from(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    low = fixtures.read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return seg(g.temporal.effective_from([low], p["p70"], p["p60"]))


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS pin_pos, * FROM ({eff_query('b', P(n), 'eff.id = 5')})" for i, n in enumerate(("p30", "p70", "p90")))
    + ")"
)
def effective_many_pins(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    out = g.temporal.timelines(5, [p["p30"], p["p70"], p["p90"]])
    return out.select("pin_pos", "id", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "version", F.col("props")["event_type"]["s"].alias("event_type"))


@query(
    f"WITH {chain_sql()}, {eff_sql(P('p70'))}, s AS (SELECT {EFF_ROW} FROM eff JOIN v USING (id, version) WHERE v.k = 7), ids AS (SELECT DISTINCT id FROM s WHERE id > 2 ORDER BY id LIMIT 20) SELECT * FROM s WHERE id IN (SELECT id FROM ids)"
)
def effective_page(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return seg(g.temporal.effective_page(p["p70"], "User", "k", 7, after=2, limit=20)[0])


@query(
    f"WITH {chain_sql()}, {eff_sql(P('p70'))}, ids AS (SELECT id FROM v WHERE is_current AND event_type = (SELECT min(event_type) FROM ev) ORDER BY id LIMIT 10) SELECT ids.id, f AS valid_from, u AS valid_to, version FROM ids LEFT JOIN eff USING (id)"
)
def effective_page_by_values(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    low = fixtures.read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    out, _ = g.temporal.effective_page_by_properties("User", {"event_type": low}, p["p70"], None, 10)
    return out.select("id", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "version")


TIMELINE = "d AS (SELECT x, sum(d) AS d FROM (SELECT f AS x, 1 AS d FROM held UNION ALL SELECT u, -1 FROM held WHERE u < " + INF + ") GROUP BY x), c AS (SELECT x, sum(d) OVER (ORDER BY x) AS n FROM d WHERE d <> 0), m AS (SELECT x AS valid_from, coalesce(lead(x) OVER (ORDER BY x), " + INF + ") AS valid_to, CAST(n AS BIGINT) AS n FROM c) SELECT * FROM m WHERE n <> 0"


@query(f"WITH {chain_sql()}, {eff_sql(P('p70'))}, held AS (SELECT * FROM eff), {TIMELINE}")
def count_timeline(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return g.nodes.count_timeline("User", p["p70"]).select(F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "n")


@query(f"WITH {chain_sql('d')}, {eff_sql(HI)}, held AS (SELECT eff.* FROM eff JOIN v USING (id, version) WHERE NOT v.void AND v.event_type = (SELECT max(event_type) FROM ev)), {TIMELINE}")
def count_timeline_label(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "d")
    top = fixtures.read(spark, sf_dir, "events").agg(F.max("event_type")).first()[0]
    return g.nodes.count_timeline(top).select(F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "n")


@query(f"WITH {chain_sql('c')}, {eff_sql(HI)} SELECT count(*) = 0 AS empty, min(f) AS valid_from, max(u) AS valid_to, bool_or(u = {INF}) AS open_end FROM eff")
def valid_hull(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return g.nodes.valid_hull("User").select("empty", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "open_end")


# label and property lookups


@query(f"WITH {chain_sql()} SELECT {ROW} FROM v WHERE is_current AND event_type = (SELECT min(event_type) FROM ev)")
def by_label(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return row(g.nodes.by_name(fixtures.read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]))


@query(f"WITH {chain_sql()}, {at_sql(P('p50'), HI)} SELECT {ROW} FROM won WHERE event_type = (SELECT min(event_type) FROM ev)")
def by_label_at(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.nodes.by_name(fixtures.read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0], QueryOpts(valid_at=p["p50"])))


@query(f"WITH {chain_sql()}, {at_sql(HI, P('p50'))} SELECT {ROW} FROM won")
def nodes_tx_at_only(spark, sf_dir):
    """tx_at alone: what is valid now, as recorded then."""
    g, p = _chain(spark, sf_dir)
    return row(g.nodes.all(QueryOpts(tx_at=p["p50"])))


@query(f"WITH {chain_sql()}, {at_sql(P('p50'), P('p60'))} SELECT event_type, count(*) AS n FROM won GROUP BY 1")
def count_by_label_at(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    rows = g.nodes.all(QueryOpts(valid_at=p["p50"], tx_at=p["p60"]))
    return rows.groupBy(F.col("labels")[1].alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {chain_sql()} SELECT {ROW} FROM v WHERE is_current AND id > 5 ORDER BY id LIMIT 10")
def all_paged(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return row(g.nodes.all(QueryOpts(after=5, limit=10)))


@query("SELECT 3000000000000 + c_custkey AS id FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def by_property(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    low = fixtures.read(spark, sf_dir, "customer").agg(F.min("c_mktsegment")).first()[0]
    return g.nodes.by_property("Customer", "segment", low).select("id")


@query("SELECT 5000000000000 + p_partkey AS id, p_size AS size FROM part WHERE p_size IN (7, 21, 40)")
def by_property_values(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    return g.nodes.by_property_values("Part", "size", [7, 21.0, 40, "x"]).select("id", F.col("props")["size"]["l"].cast("int").alias("size"))


@query("SELECT 5000000000000 + p_partkey AS id FROM part WHERE p_size = 10 AND p_brand = (SELECT min(p_brand) FROM part)")
def by_properties(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    low = fixtures.read(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return g.nodes.by_properties("Part", {"size": 10, "brand": low}).select("id")


@query("SELECT 'three' AS name, unnest([0, 1]) AS id UNION ALL SELECT 'zero', unnest([4, 5]) UNION ALL SELECT 'big', 9 UNION ALL SELECT 'text', 11 UNION ALL SELECT 'elements', 13")
def value_equality(spark, sf_dir):
    """Property equality over all stored kinds: widths, signed zeros, no rounding past 2^53, and list membership by an elements index."""
    g = Graph(spark, fixtures.values_fixture(spark), now=10_000, has_voids=False)
    names = {"three": 3, "zero": 0, "big": 2**53 + 1, "nan": float("nan"), "text": "3"}
    found = [g.nodes.by_property("V", "x", v).select(F.lit(n).alias("name"), F.col("id").cast("int")) for n, v in names.items()]
    g.indexes.create_property("node", "V", "x", elements=True)
    found.append(g.nodes.by_property("V", "x", "dev").select(F.lit("elements").alias("name"), F.col("id").cast("int")))
    first, *rest = found
    for d in rest:
        first = first.unionByName(d)
    return first


@query("SELECT 10 AS numeric, 1 AS nan, 1 AS string, 1 AS bool, 3 AS other, 1 AS missing")
def value_classes(spark, sf_dir):
    g = Graph(spark, fixtures.values_fixture(spark), now=10_000, has_voids=False)
    c = g.stats.class_counts("V", "x")
    return c.select(*[F.col(x).cast("int").alias(x) for x in c.columns])


@query("SELECT 3000000000000 + c_custkey AS id, round(c_acctbal, 2) AS value FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000")
def range_scan(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    return g.nodes.in_range("Customer", "acctbal", 1000, 5000, True, False).select("id", F.round(F.col("props")["acctbal"]["d"], 2).alias("value"))


@query("SELECT 6000000000000 + o_orderkey AS id, round(o_totalprice, 2) AS value FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 ORDER BY o_totalprice, o_orderkey LIMIT 25")
def range_topk_asc(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    return g.nodes.ids_in_range_ordered("Order", "total", 1000, 200000, limit=25).select("id", F.round("value", 2).alias("value"))


@query("SELECT 6000000000000 + o_orderkey AS id, round(o_totalprice, 2) AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def range_topk_desc(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    return g.nodes.ids_in_range_ordered("Order", "total", 0, 1e12, desc=True, limit=25).select("id", F.round("value", 2).alias("value"))


@query("SELECT 5000000000000 + p_partkey AS id, p_name AS value FROM part WHERE starts_with(p_name, left((SELECT min(p_name) FROM part), 3)) ORDER BY p_name, p_partkey")
def prefix_scan(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    low = fixtures.read(spark, sf_dir, "part").agg(F.min("p_name")).first()[0][:3]
    return g.nodes.ids_with_prefix("Part", "name", low)


@query(f"WITH {chain_sql()}, {at_sql(P('p50'), P('p60'))} SELECT count(*) AS n FROM won WHERE value BETWEEN 10 AND 60")
def range_cardinality_at(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    rows = g.nodes.in_range("User", "value", 10, 60, opts=QueryOpts(valid_at=p["p50"], tx_at=p["p60"]))
    return rows.agg(F.count(F.lit(1)).alias("n"))


POS_HI = f"{visible_sql(P('p70'))}, pos AS (SELECT vis.* REPLACE (CASE WHEN e = {INF} THEN coalesce(lead(s) OVER (PARTITION BY id ORDER BY s, version), {INF}) ELSE e END AS e) FROM vis), anyv AS (SELECT * FROM pos WHERE s < e)"


@query(f"WITH {chain_sql()}, {POS_HI} SELECT count(DISTINCT id) AS entities, count(*) AS rows FROM anyv WHERE value BETWEEN 10 AND 60")
def range_cardinality_any_version(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return g.nodes.range_cardinality_any_version("User", "value", 10, 60, p["p70"])


@query(f"WITH {chain_sql()}, {POS_HI} SELECT {ROW} FROM (SELECT anyv.*, row_number() OVER (PARTITION BY id ORDER BY s DESC, version DESC) AS rn FROM anyv WHERE value BETWEEN 10 AND 60) WHERE rn = 1")
def range_any_version(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(g.nodes.in_range_any_version("User", "value", 10, 60, p["p70"]))


@query(f"WITH {chain_sql()}, {POS_HI} SELECT {ROW}, s AS valid_from, e AS valid_to FROM anyv")
def any_version_rows(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return row(K.any_version(g.node_versions, p["p70"], False), F.col("s").alias("valid_from"), F.col("e").alias("valid_to"))


@query("SELECT 3000000000000 + c_custkey AS id, c_mktsegment AS segment, false AS segment_other, round(c_acctbal, 2) AS acctbal, false AS acctbal_other FROM customer")
def typed_columns(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    return g.nodes.typed_columns("Customer", ["segment", "acctbal"]).withColumn("acctbal", F.round("acctbal", 2))


@query(f"WITH {chain_sql()} SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM v WHERE is_current")
def ordinals(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return g.nodes.ordinals()


# chains


@query(f"WITH {chain_sql('c')} SELECT {ROW}, tx_from, tx_to FROM v WHERE NOT is_current")
def history(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return row(g.nodes.history(), "tx_from", "tx_to")


@query(f"WITH {chain_sql('c')} SELECT id, bool_or(NOT is_current) AS has_history FROM v GROUP BY id")
def has_history(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return g.nodes.has_history()


@query(f"WITH {chain_sql('c')} SELECT id, max(tx_from) AS tx_from, max(greatest(tx_to, deleted_at)) AS tx_to, NOT bool_or(is_current) AS deleted FROM v GROUP BY id")
def latest_stamps(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return g.nodes.latest_stamps()


@query(f"WITH {chain_sql()} SELECT a.id, a.version, EXISTS (SELECT 1 FROM v b WHERE b.id = a.id AND b.version = a.version - 1 AND NOT b.is_current) AS before, EXISTS (SELECT 1 FROM v b WHERE b.id = a.id AND b.version = a.version + 1) AS after FROM v a")
def version_before_after(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return g.nodes.neighbours_in_chain()


@query(f"WITH {chain_sql()} SELECT id, min(s) AS env_from, max(e) AS env_to FROM v GROUP BY id")
def interval_envelopes(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return envelopes(g.node_versions)


# adjacency

LINES = "ln AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn, * FROM lineitem)"


@query("SELECT 14000000000000 + o_orderkey AS id, 3000000000000 + o_custkey AS seed, 6000000000000 + o_orderkey AS other FROM orders WHERE o_custkey IN (1, 2, 3, 7)")
def outgoing(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED",))
    return g.rels.for_nodes([3 * fixtures.BIG + k for k in (1, 2, 3, 7)], "PLACED").select("id", "seed", "other")


@query(f"WITH {LINES} SELECT 15000000000000 + rn AS id, 5000000000000 + l_partkey AS seed, 6000000000000 + l_orderkey AS other FROM ln WHERE l_partkey IN (1, 2)")
def incoming(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("CONTAINS",))
    return g.rels.for_nodes([5 * fixtures.BIG + 1, 5 * fixtures.BIG + 2], "CONTAINS", incoming=True).select("id", "seed", "other")


@query("SELECT 3000000000000 + o_custkey AS node, count(*) AS degree FROM orders GROUP BY 1")
def degrees(spark, sf_dir):
    return Graph.star(spark, sf_dir, ("PLACED",)).rels.degrees("PLACED")


@query(
    "WITH o AS (SELECT 3000000000000 + o_custkey AS n, count(*) AS c FROM orders GROUP BY 1), i AS (SELECT 6000000000000 + o_orderkey AS n, count(*) AS c FROM orders GROUP BY 1)"
    " SELECT (SELECT count(*) FROM orders) AS rels, (SELECT count(*) FROM o) AS starts, (SELECT count(*) FROM i) AS ends, (SELECT max(c) FROM o) AS max_out, (SELECT min(n) FROM o WHERE c = (SELECT max(c) FROM o)) AS max_out_node,"
    " (SELECT max(c) FROM i) AS max_in, (SELECT min(n) FROM i WHERE c = (SELECT max(c) FROM i)) AS max_in_node"
)
def degree_stats(spark, sf_dir):
    return Graph.star(spark, sf_dir, ("PLACED",)).rels.degree_stats("PLACED")


MID_ORDERS = "(SELECT min(epoch_ms(o_orderdate)) + (max(epoch_ms(o_orderdate)) - min(epoch_ms(o_orderdate))) // 2 FROM orders)"


def _mid(spark, sf_dir) -> int:
    r = fixtures.read(spark, sf_dir, "orders").agg(F.min(fixtures._epoch("o_orderdate")), F.max(fixtures._epoch("o_orderdate"))).first()
    return r[0] + (r[1] - r[0]) // 2


@query(f"SELECT 14000000000000 + o_orderkey AS id, 6000000000000 + o_orderkey AS other FROM orders WHERE o_custkey = 1 AND epoch_ms(o_orderdate) <= {MID_ORDERS}")
def outgoing_rels_at(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED",))
    return g.temporal.rels_at_node(3 * fixtures.BIG + 1, _mid(spark, sf_dir)).select("id", F.col("end_id").alias("other"))


@query(f"SELECT 6000000000000 + o_orderkey AS id FROM orders WHERE o_custkey = 1 AND epoch_ms(o_orderdate) <= {MID_ORDERS}")
def neighbors_at(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED",))
    return g.temporal.neighbours_at(3 * fixtures.BIG + 1, _mid(spark, sf_dir)).select("id")


@query("SELECT DISTINCT 3000000000000 + o_custkey AS seed, 5000000000000 + l_partkey AS far FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <= 20")
def two_hop(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED", "CONTAINS"))
    edges = g.rels.versions.withColumn("type", F.lit("ANY"))
    hop = Graph(spark, g.node_versions, edges, now=1, has_voids=False).rels
    return hop.two_hop(g.node_versions.where((F.col("id") >= 3 * fixtures.BIG) & (F.col("id") <= 3 * fixtures.BIG + 20)).select("id"), "ANY")


@query(f"SELECT 14000000000000 + o_orderkey AS id, 3000000000000 + o_custkey AS seed FROM orders WHERE o_custkey IN (1, 2) AND epoch_ms(o_orderdate) <= {MID_ORDERS}")
def outgoing_at_pin(spark, sf_dir):
    """Declared adjacency under a valid instant."""
    g = Graph.star(spark, sf_dir, ("PLACED",))
    seeds = g.rels._ids([3 * fixtures.BIG + 1, 3 * fixtures.BIG + 2])
    return g.rels.adjacent(seeds, "PLACED", opts=QueryOpts(valid_at=_mid(spark, sf_dir))).select("id", "seed")


@query(f"SELECT 'node' AS kind, CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS BIGINT) AS n UNION ALL SELECT 'rel', (SELECT count(*) FROM orders WHERE epoch_ms(o_orderdate) <= {MID_ORDERS}) + (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch_ms(o_orderdate) <= {MID_ORDERS})")
def snapshot_counts(spark, sf_dir):
    nodes, rels = Graph.star(spark, sf_dir, ("PLACED", "CONTAINS")).temporal.snapshot(_mid(spark, sf_dir))
    count = lambda d, kind: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(nodes, "node").unionByName(count(rels, "rel"))


def _diff_sql(variant: str) -> str:
    a = at_sql(P("p30"), HI)
    one = f"SELECT * FROM (WITH {chain_sql(variant)}, {a} SELECT id, version FROM won)"
    two = one.replace("SELECT p30 FROM p", "SELECT p70 FROM p")
    return f"WITH a AS ({one}), b AS ({two}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'created' WHEN b.id IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.version IS DISTINCT FROM b.version"


@query(_diff_sql("d"))
def diff(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "d")
    return g.temporal.diff(p["p30"], p["p70"])


@query(f"SELECT 14000000000000 + o_orderkey AS id, 'created' AS change FROM orders WHERE epoch_ms(o_orderdate) > {MID_ORDERS} - 86400000 AND epoch_ms(o_orderdate) <= {MID_ORDERS}")
def diff_rels(spark, sf_dir):
    t = _mid(spark, sf_dir)
    return Graph.star(spark, sf_dir, ("PLACED",)).temporal.diff(t - 86_400_000, t, "rel")


@query(f"WITH {LINES}, tup AS (SELECT 0 AS pos, 'A' AS flag, 10 AS qty UNION ALL SELECT 1, 'R', 20 UNION ALL SELECT 2, 'X', 1) SELECT pos, 15000000000000 + rn AS id, epoch_ms(o_orderdate) AS valid_from FROM ln JOIN tup ON l_returnflag = flag AND l_quantity = qty JOIN orders ON o_orderkey = l_orderkey")
def tuple_timelines(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("CONTAINS",))
    return g.temporal.tuple_timelines("CONTAINS", ["flag", "quantity"], [("A", 10), ("R", 20), ("X", 1)]).select("pos", "id", F.col("from").alias("valid_from"))


@query("SELECT 14000000000000 + o_orderkey AS id, epoch_ms(o_orderdate) AS valid_from FROM orders WHERE o_custkey IN (1, 5)")
def rels_effective_at_nodes(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED",))
    return g.temporal.rels_effective_at_nodes([3 * fixtures.BIG + 1, 3 * fixtures.BIG + 5], "out", ["PLACED"]).select("id", F.col("from").alias("valid_from"))


# statistics


@query("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1 UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders")
def label_counts(spark, sf_dir):
    return Graph.star(spark, sf_dir).stats.label_counts()


@query("SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def type_counts(spark, sf_dir):
    return Graph.star(spark, sf_dir).stats.type_counts()


@query("SELECT count(*) AS numeric, 0 AS nan, 0 AS string, 0 AS bool, 0 AS other, 0 AS missing FROM customer")
def class_counts(spark, sf_dir):
    return Graph.star(spark, sf_dir).stats.class_counts("Customer", "acctbal")


@query(f"WITH {chain_sql()}, {POS_HI} SELECT count(k) AS numeric, 0 AS nan, 0 AS string, 0 AS bool, 0 AS other, count(*) - count(k) AS missing FROM anyv")
def class_counts_at(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return g.stats.class_counts("User", "k", pin=p["p70"])


@query("SELECT round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, count(*) AS numeric FROM orders")
def property_bounds(spark, sf_dir):
    b = Graph.star(spark, sf_dir).stats.bounds("Order", "total")
    return b.select(F.round("min", 2).alias("min"), F.round("max", 2).alias("max"), "numeric")


VALUE_STATS = "SELECT count(*) AS distinct, CAST(sum(n) AS BIGINT) AS rows, max(n) AS max_rows, arg_min(x, (-n, x)) AS max_value FROM c"


@query(f"WITH c AS (SELECT 's:' || p_brand AS x, count(*) AS n FROM part GROUP BY 1) {VALUE_STATS}")
def property_value_stats(spark, sf_dir):
    return Graph.star(spark, sf_dir).stats.value_stats("Part", "brand")


@query(f"WITH {chain_sql()}, {POS_HI}, c AS (SELECT 'i64:' || k AS x, count(*) AS n FROM anyv WHERE k IS NOT NULL GROUP BY 1) {VALUE_STATS}")
def property_value_stats_at(spark, sf_dir):
    g, p = _chain(spark, sf_dir)
    return g.stats.value_stats("User", "k", pin=p["p70"])


@query()
def property_ndv(spark, sf_dir):
    return Graph.star(spark, sf_dir).stats.property_stats("Part", "name")


@query(f"WITH {chain_sql()} SELECT 'node' AS kind, count(*) AS n FROM v WHERE NOT is_current UNION ALL SELECT 'rel', 0")
def history_counts(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return g.stats.history_counts()


@query(
    f"WITH {chain_sql('c')}, l AS (SELECT 'User' AS name, v.* FROM v UNION ALL SELECT event_type, v.* FROM v), b AS (SELECT name, id, bool_or(is_current) AS now, max(greatest(tx_to, deleted_at)) AS ended FROM l GROUP BY 1, 2)"
    " SELECT name, count(*) FILTER (now) AS members, count(*) FILTER (now) AS explicit_valid, max(ended) AS last_ended FROM b GROUP BY 1"
)
def time_stats(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return g.stats.time_stats()


@query("SELECT 's:' || p_brand AS key, count(*) AS rows FROM part GROUP BY 1")
def index_postings(spark, sf_dir):
    g = Graph.star(spark, sf_dir)
    return postings(g.nodes.by_name("Part"), "brand")


# vectors


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in fixtures.read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


_QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id AS id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), {_QV}), 6) + 0.0 AS distance FROM embeddings ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), {_QV}), vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    g = Graph(spark, fixtures.vectors(spark, sf_dir), now=10_000, has_voids=False)
    return g.nodes.nearest("Vec", "embedding", _query_vector(spark, sf_dir), 10).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), {_QV}), 6) AS distance FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QV}), vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    g = Graph(spark, fixtures.vectors(spark, sf_dir), now=10_000, has_voids=False)
    return g.nodes.nearest("Vec", "embedding", _query_vector(spark, sf_dir), 10, "l2").select("id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), {_QV}), 6) AS distance FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QV}), vec_id LIMIT 10")
def knn_temporal(spark, sf_dir):
    """Only what is valid at the instant is eligible (vectors with an id divisible by 3 begin later)."""
    v = fixtures.vectors(spark, sf_dir).withColumn("s", F.when(F.col("id") % 3 == 0, F.lit(6_000).cast("bigint")).otherwise(F.col("s")))
    g = Graph(spark, v, now=10_000, has_voids=False)
    return g.nodes.nearest("Vec", "embedding", _query_vector(spark, sf_dir), 10, "l2", QueryOpts(valid_at=5_000)).select("id", F.round("distance", 6).alias("distance"))


# calendar and ids


@query("SELECT event_id, " + ", ".join(f"epoch_ms(date_trunc('{u}', ts)) AS {u}_floor" for u in ("hour", "day", "week", "month", "quarter", "year")) + ", CASE WHEN date_trunc('month', ts) = ts THEN epoch_ms(ts) ELSE epoch_ms(date_trunc('month', ts) + INTERVAL 1 MONTH) END AS month_ceil FROM events")
def truncate_instants(spark, sf_dir):
    t = F.col("t")
    ev = fixtures.read(spark, sf_dir, "events").select("event_id", fixtures._epoch("ts").alias("t"))
    return ev.select("event_id", *[C.truncate(t, u).alias(f"{u}_floor") for u in ("hour", "day", "week", "month", "quarter", "year")], C.ceil(t, "month").alias("month_ceil"))


def _recurrence_sql(days: str, a: int, b: int, start: int, end: int) -> str:
    """Each day of [a, b] that `days` (of d) chooses, clipped to [a, b)."""
    every = f"SELECT unnest(generate_series(date_trunc('day', make_timestamp({a}000)), make_timestamp({b}000), INTERVAL 1 DAY)) AS d"
    return f'SELECT * FROM (SELECT greatest(epoch_ms(d) + {start}, {a}) AS start, least(epoch_ms(d) + {end}, {b}) AS "end" FROM ({every}) WHERE {days}) WHERE start < "end"'


# half past nine of the first day: the occurrence that has begun counts from there
_SPAN = (C.EPOCH_2026 + 9 * 3_600_000 + 1_800_000, C.EPOCH_2026 + 700 * 86_400_000 + 10 * 3_600_000)


@query(_recurrence_sql("isodow(d) IN (1, 3, 4)", *_SPAN, 9 * 3_600_000, 17 * 3_600_000))
def recurrence_expand(spark, sf_dir):
    """Mondays, Wednesdays and Thursdays from nine to five."""
    return C.expand(spark, C.Recurrence("weekly", 9 * 3_600_000, 17 * 3_600_000, weekdays=(0, 2, 3)), *_SPAN)


@query(_recurrence_sql("d = last_day(d)", *_SPAN, 0, 86_400_000))
def recurrence_monthly(spark, sf_dir):
    """The last day of each month."""
    return C.expand(spark, C.Recurrence("monthly", month_day=0), *_SPAN)


@query(_recurrence_sql("month(d) = 2 AND day(d) = 28", *_SPAN, 3_600_000, 7_200_000))
def recurrence_yearly(spark, sf_dir):
    return C.expand(spark, C.Recurrence("yearly", 3_600_000, 7_200_000, month=2, month_day=28), *_SPAN)


@query("SELECT event_id, event_id * 1234567891 + 99 AS id, ((event_id * 1234567891 + 99) >> 15) // 1000 + 1767225600000 AS created_at, CAST(((event_id * 1234567891 + 99) >> 10) & 31 AS INTEGER) AS node, CAST((event_id * 1234567891 + 99) & 1023 AS INTEGER) AS sequence FROM events")
def decompose_ids(spark, sf_dir):
    ev = fixtures.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1234567891 + 99).alias("id"))
    return ev.select("event_id", "id", *[c.alias(n) for n, c in C.decompose_id(F.col("id")).items()])


# constraints and integrity


@query("SELECT 's:' || p_brand AS key, count(*) AS n, min(5000000000000 + p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return constraints.unique_violations(fixtures.star_nodes(spark, sf_dir), "Part", "brand")


@query(f"WITH {chain_sql()} SELECT 'n:' || k AS key, arg_min(id, (tx_from, id)) AS owner FROM v WHERE k IS NOT NULL GROUP BY 1")
def unique_owners(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    return constraints.owners(g.node_versions, "User", "k")


@query("SELECT 14000000000000 + o_orderkey AS id, 'end_id' AS side FROM orders WHERE o_orderkey % 2 = 0")
def rel_within_endpoints(spark, sf_dir):
    """Orders with an even key are made to end, while their relationships go on."""
    even = (F.col("id") >= 6 * fixtures.BIG) & (F.col("id") % 2 == 0)
    nodes = fixtures.star_nodes(spark, sf_dir).withColumn("e", F.when(even, F.lit(4_000_000_000_000).cast("bigint")).otherwise(F.col("e")))
    return constraints.outside_endpoints(nodes, fixtures.star_rels(spark, sf_dir, ("PLACED",)))


@query("SELECT 1 AS fact, 'repeated' AS reason UNION ALL SELECT 2, 'repeated' UNION ALL SELECT 3, 'taken'")
def dry_run_validate(spark, sf_dir):
    name = fixtures.read(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    facts = spark.createDataFrame([(1, "new"), (2, "new"), (3, name), (4, "other")], "fact int, name string").select("fact", V.props(name=V.text(F.col("name"))).alias("props"))
    return constraints.dry_run(Graph.star(spark, sf_dir), facts, "Region", "name")


@query(f"WITH {chain_sql()} SELECT id, id % 5 <> 0 AS valid FROM v GROUP BY id")
def verify_chain(spark, sf_dir):
    """Labels of chains with ids divisible by 5 are tampered with after hashing; other times are no content and change nothing."""
    g, _ = _chain(spark, sf_dir)
    v = integrity.with_hashes(g.node_versions).withColumn("s", F.col("s") + 1)
    return integrity.verify_chains(v.withColumn("labels", F.when((F.col("id") % 5 == 0) & (F.col("version") == 0), F.array(F.lit("Other"))).otherwise(F.col("labels"))))


# writes


@query(f"WITH {chain_sql('d')}, {eff_sql(HI)} SELECT id, f AS valid_from, u AS valid_to, 7 AS k FROM eff JOIN v USING (id, version) WHERE NOT v.void")
def update_everywhere(spark, sf_dir):
    """An update without a valid time of every chain: all segments take the value, and keep their bounds; voids stay."""
    g, _ = _chain(spark, sf_dir, "d")
    g.write(writes.update_everywhere, g.node_versions.where("is_current").select("id", V.props(k=V.integer(F.lit(7))).alias("patch")))
    return g.temporal.effective().select("id", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), F.col("props")["k"]["l"].alias("k"))


# a correction of [a, b) over single open segments, and what the timeline must be afterwards
_ONE = "one AS (SELECT 6000000000000 + o_orderkey AS id, epoch_ms(o_orderdate) AS d FROM orders)"


def _orders_valid_from(spark, sf_dir) -> DataFrame:
    orders = fixtures.read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 6 * fixtures.BIG).alias("id"), fixtures._epoch("o_orderdate").alias("_d"))
    return fixtures.star_nodes(spark, sf_dir).join(orders, "id").withColumn("s", F.col("_d")).drop("_d")


def _span(nodes: DataFrame, a: int, b: int) -> DataFrame:
    return nodes.select("id", (F.col("s") + a).alias("valid_from"), (F.col("s") + b).alias("valid_to"))


@query(f"WITH {_ONE} SELECT id, d AS valid_from, d + 100 AS valid_to, 'O' AS state FROM one UNION ALL SELECT id, d + 100, d + 200, 'patched' FROM one UNION ALL SELECT id, d + 200, {INF}, 'O' FROM one")
def set_interval(spark, sf_dir):
    nodes = _orders_valid_from(spark, sf_dir).withColumn("props", V.props(state=V.text(F.lit("O"))))
    change = _span(nodes, 100, 200).withColumn("patch", V.props(state=V.text(F.lit("patched"))))
    after = writes.correct(nodes, change, 5_000)
    return K.segments(after).select("id", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), F.col("props")["state"]["s"].alias("state"))


@query(f"WITH {_ONE} SELECT id, d AS valid_from, d + 100 AS valid_to FROM one UNION ALL SELECT id, d + 200, {INF} FROM one")
def excise(spark, sf_dir):
    nodes = _orders_valid_from(spark, sf_dir)
    after = writes.excise(nodes, _span(nodes, 100, 200), 5_000)
    return K.segments(after).select("id", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"))


@query(f"WITH {chain_sql()}, cur AS (SELECT * FROM v WHERE is_current), mx AS (SELECT id, max(version) AS m FROM v GROUP BY id) SELECT id, m + 1 AS version, k + 1000 AS k FROM cur JOIN mx USING (id)")
def update_nodes(spark, sf_dir):
    g, _ = _chain(spark, sf_dir)
    current = g.node_versions.where("is_current")
    patch = V.props(k=V.integer(F.col("props")["k"]["l"] + 1000))
    g.write(writes.update, current.select("id", patch.alias("patch")))
    return g.nodes.all().select("id", "version", F.col("props")["k"]["l"].alias("k"))


@query("SELECT 'node' AS kind, (SELECT count(*) FROM customer WHERE c_custkey > 10) AS n UNION ALL SELECT 'rel', (SELECT count(*) FROM orders WHERE o_custkey > 10)")
def delete_cascade(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED",))
    gone = g.node_versions.where((F.col("id") >= 3 * fixtures.BIG) & (F.col("id") <= 3 * fixtures.BIG + 10)).select("id")
    g.write(writes.delete, gone)
    count = lambda d, kind: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(g.nodes.by_name("Customer"), "node").unionByName(count(g.rels.all(), "rel"))


# change log, deltas, housekeeping


@query(
    f"WITH {chain_sql('c')}, r AS (SELECT tx_from AS \"at\", id, version, 1 AS tag FROM v UNION ALL SELECT deleted_at, id, version, 3 FROM v WHERE deleted_at > 0), l AS (SELECT row_number() OVER (ORDER BY \"at\", id, version, tag) AS lsn, tag, id, version, \"at\" FROM r) SELECT * FROM l WHERE lsn > 100 ORDER BY lsn LIMIT 500"
)
def change_feed(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return changes.feed(changes.change_log(g.node_versions), 100, 500)


@query(f"WITH {chain_sql('c')}, r AS (SELECT tx_from AS x, id, version, CASE WHEN version = 0 THEN 'create' ELSE 'update' END AS type FROM v UNION ALL SELECT deleted_at, id, version, 'delete' FROM v WHERE deleted_at > 0) SELECT type, CASE type WHEN 'delete' THEN 0 WHEN 'create' THEN 1 ELSE 2 END AS priority, count(*) AS n FROM r GROUP BY 1, 2")
def event_counts(spark, sf_dir):
    g, _ = _chain(spark, sf_dir, "c")
    return changes.events(changes.change_log(g.node_versions)).groupBy("type", "priority").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {chain_sql('c')} SELECT id, version FROM v WHERE tx_from > ({P('p90')}) OR tx_to > ({P('p90')}) OR deleted_at > ({P('p90')})")
def delta_since(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "c")
    return changes.delta_since(g.node_versions, p["p90"]).select("id", "version")


@query(f"WITH {chain_sql('c')} SELECT id, version, is_current, tx_to FROM v")
def import_merge(spark, sf_dir):
    """What was recorded by a pin, merged with the delta since then, twice, is everything again."""
    g, p = _chain(spark, sf_dir, "c")
    old = K.visible(g.node_versions, p["p50"]).withColumn("tx_to", F.when(F.col("tx_to") > p["p50"], F.lit(0)).otherwise(F.col("tx_to")))
    old = old.withColumn("is_current", (F.col("tx_to") == 0) & (F.col("deleted_at") == 0) & (F.col("e") == V.INF))
    delta = changes.delta_since(g.node_versions, p["p50"])
    return changes.merge(changes.merge(old, delta), delta).select("id", "version", "is_current", "tx_to")


@query(f"WITH {chain_sql('a')}, n AS (SELECT *, CASE WHEN NOT is_current THEN row_number() OVER (PARTITION BY id, is_current ORDER BY version DESC) END AS rn FROM v) SELECT id, version FROM n WHERE is_current OR rn <= 5 OR tx_to >= ({P('p90')})")
def compact_history(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "a")
    return admin.compact(g.node_versions, 5, p["p90"])[0].select("id", "version")


@query(f"WITH {chain_sql('c')} SELECT id, version FROM v WHERE id NOT IN (SELECT id FROM v GROUP BY id HAVING max_by(e, version) < ({HI}))")
def purge_expired(spark, sf_dir):
    g, p = _chain(spark, sf_dir, "c")
    return admin.purge_expired(g.node_versions, g.rel_versions, "User", p["hi"] + 60_000)[0].select("id", "version")


@query("SELECT 'node' AS kind, count(*) AS rows, count(*) AS entities FROM customer WHERE c_custkey <= 10 UNION ALL SELECT 'rel', count(*), count(*) FROM orders WHERE o_custkey <= 10")
def exact_erase(spark, sf_dir):
    g = Graph.star(spark, sf_dir, ("PLACED",))
    ids = g.node_versions.where((F.col("id") >= 3 * fixtures.BIG) & (F.col("id") <= 3 * fixtures.BIG + 10)).select("id")
    return admin.erasure(g.node_versions, g.rel_versions, ids)[2]

