"""Allen's interval algebra over half-open integer intervals."""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thirteen relations, in the customary order, and their one- or two-letter symbols.
RELATIONS = ["before", "meets", "overlaps", "starts", "during", "finishes", "equals", "finished-by", "contains", "started-by", "overlapped-by", "met-by", "after"]
SYMBOLS = dict(zip(RELATIONS, ["b", "m", "o", "s", "d", "f", "e", "fi", "di", "si", "oi", "mi", "bi"], strict=True))
INVERSE = dict(zip(RELATIONS, reversed(RELATIONS), strict=True))


def relation(a: int, b: int, c: int, d: int) -> str | None:
    """Relation of [a, b) to [c, d); None if either is empty."""
    if a >= b or c >= d:
        return None
    if b < c:
        return "before"
    if d < a:
        return "after"
    if b == c:
        return "meets"
    if d == a:
        return "met-by"
    if a == c:
        return "equals" if b == d else "starts" if b < d else "started-by"
    if b == d:
        return "finishes" if a > c else "finished-by"
    if a > c and b < d:
        return "during"
    if a < c and b > d:
        return "contains"
    return "overlaps" if a < c else "overlapped-by"


def allen(a: Column, b: Column, c: Column, d: Column) -> Column:
    """`relation` as a column."""
    return (
        F.when((a >= b) | (c >= d), F.lit(None).cast("string"))
        .when(b < c, "before")
        .when(d < a, "after")
        .when(b == c, "meets")
        .when(d == a, "met-by")
        .when((a == c) & (b == d), "equals")
        .when(a == c, F.when(b < d, "starts").otherwise("started-by"))
        .when(b == d, F.when(a > c, "finishes").otherwise("finished-by"))
        .when((a > c) & (b < d), "during")
        .when((a < c) & (b > d), "contains")
        .when(a < c, "overlaps")
        .otherwise("overlapped-by")
    )


@cache
def composition() -> dict[tuple[str, str], frozenset[str]]:
    """(r, s) to the relations that x can have to z when x r y and y s z: found by trying all intervals on six points."""
    spans = list(combinations(range(6), 2))
    out: dict[tuple[str, str], set[str]] = {}
    for x in spans:
        for y in spans:
            for z in spans:
                out.setdefault((relation(*x, *y), relation(*y, *z)), set()).add(relation(*x, *z))
    return {k: frozenset(v) for k, v in out.items()}


def compose(first: set[str], second: set[str]) -> set[str]:
    table = composition()
    return set().union(*(table[r, s] for r in first for s in second)) if first and second else set()


def inverse_set(relations: set[str]) -> set[str]:
    return {INVERSE[r] for r in relations}


def to_bits(relations: set[str]) -> int:
    return reduce(lambda n, r: n | 1 << RELATIONS.index(r), relations, 0)


def from_bits(bits: int) -> set[str]:
    return {r for i, r in enumerate(RELATIONS) if bits >> i & 1}
