"""When a read looks at: one set of options for all doors, and their resolution to a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from strataspan.errors import ConflictingTemporalOpts, InvalidTimeRange
from strataspan.plans import kernels as K


@dataclass(frozen=True)
class QueryOpts:
    """tx_pin: the record as of a transaction instant, alone. valid_at: the state at a valid instant; during: anything in [a, b); either as
    recorded at tx_at (None: all that is recorded). tx_at alone: valid now, as recorded then. after, limit: a page by id."""

    valid_at: int | None = None
    during: tuple[int, int] | None = None
    tx_at: int | None = None
    tx_pin: int | None = None
    after: int | None = None
    limit: int | None = None

    @property
    def temporal(self) -> bool:
        return any(x is not None for x in (self.valid_at, self.during, self.tx_at, self.tx_pin))

    def validate(self) -> None:
        others = [x for x in (self.valid_at, self.during, self.tx_at) if x is not None]
        if self.tx_pin is not None and others:
            raise ConflictingTemporalOpts("tx_pin goes with no other temporal option")
        if self.valid_at is not None and self.during is not None:
            raise ConflictingTemporalOpts("valid_at and during exclude each other")
        if self.during is not None and self.during[1] and self.during[0] >= self.during[1]:
            raise InvalidTimeRange(f"{self.during}: the start must be before the end")


CURRENT = QueryOpts()


def resolve(v: DataFrame, opts: QueryOpts, now: int, predicate: Column | None = None, voids: bool = True) -> DataFrame:
    """The versions that opts select. The predicate is tested on the resolved version; under `during`, on every version."""
    opts.validate()
    if opts.tx_pin is not None:
        out = K.as_of(v, opts.tx_pin)
    elif opts.valid_at is not None:
        out = K.at(v, opts.valid_at, opts.tx_at or 0)
    elif opts.during is not None:
        a, b = opts.during
        return K.during(v, a, b or now + 1, opts.tx_at or 0, predicate, voids)
    elif opts.tx_at is not None:
        out = K.at(v, now, opts.tx_at)
    else:
        out = v.where("is_current")
    return out if predicate is None else out.where(predicate)


def page(df: DataFrame, opts: QueryOpts) -> DataFrame:
    """The page of `opts` by id; without a limit the order is left to whoever collects."""
    out = df if opts.after is None else df.where(df["id"] > opts.after)
    return out if opts.limit is None else out.orderBy("id").limit(opts.limit)
