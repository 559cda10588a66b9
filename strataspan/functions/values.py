"""Property values: one struct type for all of them, and the keys, classes and orders that lookups use."""

from __future__ import annotations

import math
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = 9223372036854775807
NEG = -9223372036854775808

#: t: stored type (i, i8 .. i64, u .. u64, f32, f64, s, b, tv, list, map); the field that holds the value follows from it.
PV = "struct<t:string,l:bigint,d:double,s:string,b:boolean,u:decimal(20,0),arr:array<string>,vec:array<float>>"
PROPS = f"map<string,{PV}>"
_FIELDS = [("l", "bigint"), ("d", "double"), ("s", "string"), ("b", "boolean"), ("u", "decimal(20,0)"), ("arr", "array<string>"), ("vec", "array<float>")]
INTEGERS = ("i", "i8", "i16", "i32", "i64")
UNSIGNED = ("u", "u8", "u16", "u32", "u64")
FLOATS = ("f32", "f64")


def pv(t: str, field: str, value: Column) -> Column:
    """A value of stored type t; null where the value is null, so the key counts as absent."""
    made = F.struct(F.lit(t).alias("t"), *[(value if f == field else F.lit(None)).cast(kind).alias(f) for f, kind in _FIELDS])
    return F.when(value.isNotNull(), made)


def integer(c: Column, width: str = "i64") -> Column:
    return pv(width, "u" if width in UNSIGNED else "l", c)


def real(c: Column, width: str = "f64") -> Column:
    """A float32 keeps its width, and its value as the double it widens to."""
    return pv(width, "d", c)


def text(c: Column) -> Column:
    return pv("s", "s", c)


def boolean(c: Column) -> Column:
    return pv("b", "b", c)


def temporal(kind: str, iso: Column) -> Column:
    return pv("tv", "s", F.concat(F.lit(f"{kind}:"), iso))


def elements(keys: Column) -> Column:
    """A list, by the equality keys of its scalar elements."""
    return pv("list", "arr", keys)


def vector(c: Column) -> Column:
    return pv("list", "vec", c)


def props(**values: Column) -> Column:
    """A property map without the keys whose value is null."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def record(**values: Column) -> Column:
    """A property map of known keys. A key without a value maps to null, which every door takes for absent; unlike `props` it lets
    Catalyst replace a lookup by the value's own expression, so only the columns that a query asks for are read and made."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def number_key(d: Column) -> Column:
    """Equal for numbers of one exact value: integral doubles get their integer's digits, -0.0 is 0, NaN has no key."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e18)
    # doubles of 1e18 and more are integral; a decimal has all their digits up to 38
    big = F.abs(d) < 1e37
    return (
        F.when(F.isnan(d), F.lit(None))
        .when(whole, d.cast("bigint").cast("string"))
        .when(big & (F.abs(d) >= 1e18), d.cast("decimal(38,0)").cast("string"))
        .otherwise(d.cast("string"))
    )


def eqkey(v: Column) -> Column:
    """Key of property equality: a number equals every number of the same exact value in any width; NaN, lists and maps equal
    nothing (null); a string, boolean or temporal value equals itself only."""
    t = v["t"]
    return (
        F.when(t.isin(*INTEGERS), F.concat(F.lit("n:"), v["l"].cast("string")))
        .when(t.isin(*UNSIGNED), F.concat(F.lit("n:"), v["u"].cast("string")))
        .when(t.isin(*FLOATS), F.concat(F.lit("n:"), number_key(v["d"])))
        .when(t == "s", F.concat(F.lit("s:"), v["s"]))
        .when(t == "b", F.concat(F.lit("b:"), v["b"].cast("string")))
        .when(t == "tv", F.concat(F.lit("tv:"), v["s"]))
    )


def idxkey(v: Column) -> Column:
    """Key by stored width, as value statistics count; null where the value is not indexable."""
    t = v["t"]
    zero = F.when(v["d"] == 0, F.lit("0")).when(F.isnan(v["d"]), F.lit("nan")).otherwise(number_key(v["d"]))
    return (
        F.when(t.isin(*INTEGERS), F.concat(t, F.lit(":"), v["l"].cast("string")))
        .when(t.isin(*UNSIGNED), F.concat(t, F.lit(":"), v["u"].cast("string")))
        .when(t.isin(*FLOATS), F.concat(t, F.lit(":"), zero))
        .when(t == "s", F.concat(F.lit("s:"), v["s"]))
        .when(t == "b", F.concat(F.lit("b:"), v["b"].cast("string")))
        .when(t == "tv", F.concat(F.lit("tv:"), v["s"]))
    )


def num(v: Column) -> Column:
    """The double that numbers are ordered by; null for what is not a number, NaN included."""
    t = v["t"]
    d = F.when(t.isin(*INTEGERS), v["l"].cast("double")).when(t.isin(*UNSIGNED), v["u"].cast("double")).when(t.isin(*FLOATS), v["d"])
    return F.when(~F.isnan(d), d)


def cls(v: Column) -> Column:
    """Numeric, NaN, String, Bool, Other or Missing."""
    t = v["t"]
    return (
        F.when(v.isNull(), "Missing")
        .when(t.isin(*FLOATS) & F.isnan(v["d"]), "NaN")
        .when(t.isin(*INTEGERS, *UNSIGNED, *FLOATS), "Numeric")
        .when(t == "s", "String")
        .when(t == "b", "Bool")
        .otherwise("Other")
    )


def key_of(value: Any) -> str | None:
    """eqkey of a Python value."""
    if value is None or isinstance(value, (list, tuple, dict)):
        return None
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, int):
        return f"n:{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return None
        if math.isinf(value):
            return "n:Infinity" if value > 0 else "n:-Infinity"
        return f"n:{int(value)}" if value == int(value) and abs(value) < 1e37 else f"n:{_java_double(value)}"
    return f"s:{value}"


def _java_double(value: float) -> str:
    """The rendering that Spark gives a double, which keys of fractions have: the JVM's own, where there is one."""
    context = SparkContext._active_spark_context
    if context is not None:
        return context._jvm.java.lang.Double.toString(value)
    if 1e-3 <= abs(value) < 1e7:
        return repr(value)
    mantissa, _, exponent = f"{value!r}".partition("e")
    if not exponent:
        digits = f"{value:.17e}"
        for p in range(17):
            digits = f"{value:.{p}e}"
            if float(digits) == value:
                break
        mantissa, _, exponent = digits.partition("e")
    if "." not in mantissa:
        mantissa += ".0"
    return f"{mantissa}E{int(exponent)}"


def equals(v: Column, value: Any, as_elements: bool = False) -> Column:
    """Property equality with a literal; with `as_elements`, membership in a list as well."""
    key = key_of(value)
    if key is None:
        return F.lit(False)
    same = F.coalesce(eqkey(v) == key, F.lit(False))
    return same | F.coalesce(F.array_contains(v["arr"], key), F.lit(False)) if as_elements else same


def in_range(v: Column, low: float, high: float, include_low: bool = True, include_high: bool = True) -> Column:
    n = num(v)
    above = n >= low if include_low else n > low
    below = n <= high if include_high else n < high
    return F.coalesce(above & below, F.lit(False))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Cosine (1 - cos; 1 where a vector is zero) or L2 distance of two vectors, in double precision."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, z: s + z))
    if metric != "cosine":
        raise ValueError(f"metric {metric!r}: cosine or l2")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1 - dot(a, b) / norm)
