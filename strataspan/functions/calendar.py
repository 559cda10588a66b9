"""Calendar functions on instants (Unix milliseconds, UTC) and recurrence expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspan.errors import InvalidTimeRange

MILLIS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
UNITS = (*MILLIS, "week", "month", "quarter", "year")
#: Instants outside these bounds (the sentinels among them) have no calendar; they stay as they are.
LOWEST, HIGHEST = -62_135_596_800_000, 253_402_300_799_999
EPOCH_2026 = 1_767_225_600_000


def _timestamp(t: Column) -> Column:
    return F.timestamp_millis(t)


def _guard(t: Column, value: Column) -> Column:
    return F.when(t.between(LOWEST, HIGHEST), value).otherwise(t)


def truncate(t: Column, unit: str) -> Column:
    """Floor to the unit, before 1970 too; weeks begin on Monday."""
    if unit in MILLIS:
        n = MILLIS[unit]
        return _guard(t, t - F.pmod(t, F.lit(n)))
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r}: one of {', '.join(UNITS)}")
    return _guard(t, F.unix_millis(F.date_trunc(unit, _timestamp(t))))


def following(t: Column, unit: str) -> Column:
    """The start of the unit after the one that t lies in."""
    low = truncate(t, unit)
    if unit in MILLIS:
        return low + MILLIS[unit]
    if unit == "week":
        return low + 7 * MILLIS["day"]
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.unix_millis(F.add_months(_timestamp(low).cast("date"), months).cast("timestamp"))


def ceil(t: Column, unit: str) -> Column:
    low = truncate(t, unit)
    return _guard(t, F.when(low == t, t).otherwise(following(t, unit)))


def round_half_up(t: Column, unit: str) -> Column:
    low, high = truncate(t, unit), following(t, unit)
    return _guard(t, F.when(t - low < high - t, low).otherwise(high))


def decompose_id(c: Column) -> dict[str, Column]:
    """Parts of a 63-bit id: microseconds since 2026 (48 bits), node (5), step (10)."""
    return {
        "created_at": (F.shiftright(c, 15) / 1000).cast("bigint") + EPOCH_2026,
        "node": F.shiftright(c, 10).bitwiseAND(31).cast("int"),
        "sequence": c.bitwiseAND(1023).cast("int"),
    }


@dataclass(frozen=True)
class Recurrence:
    """Occurrences from `start` to `end` (milliseconds of the UTC day, the end exclusive) on each chosen day.

    kind daily or weekly: the days in `weekdays` (0 Monday .. 6 Sunday); monthly: month_day; yearly: month and month_day. month_day is
    1 to 28, or 0 for the last day of the month.
    """

    kind: str
    start: int = 0
    end: int = MILLIS["day"]
    weekdays: tuple[int, ...] = ()
    month: int = 1
    month_day: int = 1

    def validate(self) -> None:
        if self.kind not in ("daily", "weekly", "monthly", "yearly"):
            raise ValueError(f"kind {self.kind!r}")
        if not 0 <= self.start < self.end <= MILLIS["day"]:
            raise ValueError("start and end are ascending times of one day")
        if self.kind in ("daily", "weekly") and (not self.weekdays or not all(0 <= d <= 6 for d in self.weekdays)):
            raise ValueError("a daily or weekly pattern needs weekdays from 0 to 6")
        if self.kind in ("monthly", "yearly") and not 0 <= self.month_day <= 28:
            raise ValueError("month_day is 1 to 28, or 0 for the last day")
        if self.kind == "yearly" and not 1 <= self.month <= 12:
            raise ValueError("month is 1 to 12")


#: Fixed value: the longest span that is expanded, in milliseconds (1000 years of 365 days).
MAX_SPAN = 1000 * 365 * MILLIS["day"]


def expand(spark, pattern: Recurrence, a: int, b: int) -> DataFrame:
    """start, end of the occurrences in [a, b), clipped to it; one that began before a counts from a. Days are generated and chosen on
    the executors."""
    if a >= b:
        raise InvalidTimeRange(f"[{a}, {b})")
    if b - a > MAX_SPAN:
        raise InvalidTimeRange(f"[{a}, {b}) is longer than {MAX_SPAN} ms")
    pattern.validate()
    day = MILLIS["day"]
    days = spark.range(a // day, b // day + 1).select(F.col("id").alias("day"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    due = F.last_day("date") if pattern.month_day == 0 else F.date_add(F.trunc("date", "month"), pattern.month_day - 1)
    chosen = F.weekday("date").isin(*pattern.weekdays) if pattern.kind in ("daily", "weekly") else F.col("date") == due
    if pattern.kind == "yearly":
        chosen = chosen & (F.month("date") == pattern.month)
    start, end = F.col("day") * day + pattern.start, F.col("day") * day + pattern.end
    clipped = days.where(chosen).select(F.greatest(start, F.lit(a)).alias("start"), F.least(end, F.lit(b)).alias("end"))
    return clipped.where(F.col("start") < F.col("end"))
