"""Kernels on random chains against the rules, written out row by row in Python."""

import random

import pytest
from pyspark.sql import functions as F

from strataspan.functions.allen import relation
from strataspan.functions.values import INF
from strataspan.plans import kernels as K

SCHEMA = "id long, version int, is_current boolean, s long, e long, tx_from long, tx_to long, deleted_at long, retracted boolean, void boolean, kept boolean"


def chain(rng: random.Random, id_: int) -> list[dict]:
    """A chain as writers make it: updates that replace, corrections beside the current row, perhaps a delete."""
    rows, tx, slot, version = [], 10, None, 0
    for _ in range(rng.randint(1, 7)):
        tx += rng.randint(1, 5)
        start = rng.randint(0, 40)
        if slot is None or rng.random() < 0.6:
            if slot is not None:
                slot["tx_to"], slot["is_current"] = tx, False
                start = slot["s"] + rng.randint(0, 12)
            slot = dict(id=id_, version=version, is_current=True, s=start, e=INF, tx_from=tx, tx_to=0, deleted_at=0, retracted=False, void=False, kept=False)
            rows.append(slot)
        else:
            rows.append(dict(id=id_, version=version, is_current=False, s=start, e=start + rng.randint(1, 15), tx_from=tx, tx_to=0, deleted_at=0, retracted=False, void=rng.random() < 0.3, kept=False))
        version += 1
    if rng.random() < 0.3:
        tx += 3
        slot.update(tx_to=tx, deleted_at=tx, e=min(slot["e"], max(tx, slot["s"])), is_current=False, retracted=rng.random() < 0.5)
        slot["kept"] = slot["e"] != tx
    return rows


def bounds(rows: list[dict], pin: int) -> list[dict]:
    """(row, start, end, rank) of the rows by which points are resolved, by the rules alone."""
    seen = []
    for r in rows:
        if pin and r["tx_from"] > pin:
            continue
        r = dict(r)
        if pin and r["deleted_at"] > pin:
            if r["e"] == r["deleted_at"] and not r["kept"]:
                r["e"] = INF
            r.update(tx_to=0 if r["tx_to"] > pin else r["tx_to"], deleted_at=0, retracted=False)
        seen.append(r)
    deaths = [(r["deleted_at"], r["retracted"]) for r in seen if r["deleted_at"]]
    out = []
    for r in seen:
        after = sorted(d for d in deaths if d[0] >= r["tx_from"])
        if after and after[0][1]:
            continue
        out.append(dict(r, e=min(r["e"], after[0][0] if after else INF)))
    order = sorted(out, key=lambda r: r["version"])
    cascade = any(b["s"] < a["s"] or b["s"] == a["s"] and b["e"] < a["e"] for a, b in zip(order, order[1:]))
    if not cascade:
        order.sort(key=lambda r: (r["s"], r["version"]))
        return [dict(r, e=(order[i + 1]["s"] if i + 1 < len(order) else INF) if r["e"] == INF else r["e"], rank=(r["s"], r["version"])) for i, r in enumerate(order)]
    ended = [(r["tx_to"], r["version"]) for r in out if r["tx_to"] > r["tx_from"] and not r["deleted_at"]]
    new = [q for q in out if any(q["tx_from"] == t and q["version"] > v for t, v in ended)]
    for r in out:
        caps = [q["s"] for q in new if (q["tx_from"], q["version"]) > (r["tx_from"], r["version"]) and q["s"] >= r["s"]]
        r["e"], r["rank"] = min([r["e"], *caps]), (r["tx_from"], r["version"])
    return out


def winner(rows: list[dict], t: int):
    over = [r for r in rows if r["s"] <= t < r["e"] or r["e"] == INF and r["s"] <= t]
    best = max(over, key=lambda r: r["rank"], default=None)
    return None if best is None or best["void"] else best["version"]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    data = {i: chain(rng, i) for i in range(150)}
    return data, spark.createDataFrame([r for rows in data.values() for r in rows], SCHEMA).cache()


@pytest.mark.parametrize("pin", [0, 18, 25])
def test_points_and_segments(world, pin):
    data, v = world
    resolved = {i: bounds(rows, pin) for i, rows in data.items()}
    segs = {}
    for r in K.segments(v, pin).select("id", "from", "to", "version").collect():
        segs.setdefault(r["id"], []).append((r["from"], r["to"], r["version"]))
    for t in (0, 7, 19, 33, 60):
        got = {r["id"]: r["version"] for r in K.at(v, t, pin).select("id", "version").collect()}
        want = {i: w for i, rows in resolved.items() if (w := winner(rows, t)) is not None}
        assert got == want
    for i, rows in resolved.items():
        mine = sorted(segs.get(i, []))
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))
        assert all(not (a[1] == b[0] and a[2] == b[2]) for a, b in zip(mine, mine[1:]))
        for t in range(-2, 70):
            held = [s[2] for s in mine if s[0] <= t < s[1]]
            assert (held[0] if held else None) == winner(rows, t), (i, t)


def test_intervals_outside_voids(world):
    data, v = world
    a, b = 12, 20
    got = {r["id"]: r["version"] for r in K.during(v, a, b).select("id", "version").collect()}
    want = {}
    for i, rows in data.items():
        held = bounds(rows, 0)
        lived = [dict(r) for r in rows if any(x["version"] == r["version"] for x in held)]
        deaths = sorted(r["deleted_at"] for r in rows if r["deleted_at"])
        for r in lived:
            r["e"] = min([r["e"], *[d for d in deaths if d >= r["tx_from"]][:1]])
        lived.sort(key=lambda r: (r["s"], r["version"]))
        for k, r in enumerate(lived):
            if r["e"] == INF and k + 1 < len(lived):
                r["e"] = lived[k + 1]["s"]
        best = None
        for r in lived:
            free = [t for t in range(max(r["s"], a), min(r["e"], b)) if not any(x["void"] and x["s"] <= t < x["e"] and x["rank"] == max(y["rank"] for y in held if y["s"] <= t < y["e"]) for x in held)]
            if free and not r["void"]:
                best = max([best, r], key=lambda x: (x["s"], x["version"])) if best else r
        if best:
            want[i] = best["version"]
    assert got == want


def test_relations(world, spark):
    rows = [(a, b, c, d, relation(a, b, c, d)) for a in range(4) for b in range(5) for c in range(4) for d in range(5)]
    from strataspan.functions.allen import allen

    df = spark.createDataFrame(rows, "a int, b int, c int, d int, r string")
    assert df.where(~allen(F.col("a"), F.col("b"), F.col("c"), F.col("d")).eqNullSafe(F.col("r"))).isEmpty()


def test_count_timeline(world):
    data, v = world
    resolved = {i: bounds(rows, 0) for i, rows in data.items()}
    line = K.count_timeline(K.segments(v)).collect()
    for t in range(-1, 70):
        n = sum(winner(rows, t) is not None for rows in resolved.values())
        assert sum(r["n"] for r in line if r["from"] <= t < r["to"]) == n


def test_empty(spark):
    v = spark.createDataFrame([], SCHEMA)
    assert K.at(v, 1).isEmpty() and K.segments(v).isEmpty() and K.as_of(v, 5).isEmpty() and K.during(v, 1, 2).isEmpty()
    assert K.count_timeline(K.segments(v)).isEmpty()
