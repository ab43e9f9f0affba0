"""Column expressions over arrays whose cost stays near linear in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(values: Column) -> Column:
    """The array cut into about as many slices as each is long, in order; empty for an empty one."""

    def cut(v: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        count = F.ceil(F.size(v) / step).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count), lambda b: F.slice(v, b * step + 1, step))

    return let(values, cut)


def running(values: Column, kind: str = "sum") -> Column:
    """Running sums, or maxima for ``kind`` "max", of an array of longs without nulls.

    A fold that appends copies what it has at each step. Here no fold goes beyond a block,
    so n values cost n * sqrt(n) copies at most.
    """
    join = (lambda a, b: F.greatest(a, b)) if kind == "max" else (lambda a, b: a + b)
    empty = F.array().cast("array<bigint>")

    def scan(v: Column, start: Column) -> Column:
        first = F.struct(start.cast("bigint").alias("at"), empty.alias("out"))
        return F.aggregate(v, first, lambda s, x: let(join(s["at"], x), lambda now: F.struct(now.alias("at"), F.concat(s["out"], F.array(now)).alias("out"))), lambda s: s["out"])

    low = F.lit(-(1 << 62) if kind == "max" else 0)

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, low.cast("bigint"), join))
        starts = let(scan(totals, low), lambda t: F.concat(F.array(low.cast("bigint")), t))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(starts, F.lit(1), F.size(parts)).alias("start")), lambda z: scan(z["part"], z["start"])))

    return let(blocks(F.transform(values, lambda x: x.cast("bigint"))), whole)
