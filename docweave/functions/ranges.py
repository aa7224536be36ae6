"""Row ranges: arrays of closed [first, last] pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contiguous(indexes: Column) -> Column:
    """Sorted whole numbers as runs: a fold that lengthens the last run or begins another."""
    empty = F.array().cast("array<array<bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(last[0], x)))
        return F.when((F.size(acc) > 0) & (F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(2)) == x - 1), longer).otherwise(F.concat(acc, F.array(F.array(x, x))))

    return F.aggregate(F.array_sort(indexes.cast("array<bigint>")), empty, step)


def label(ranges: Column, unit: str = "") -> Column:
    """As "1-3, 5", each part with a unit behind it."""
    return F.array_join(F.transform(ranges, lambda r: F.concat(F.when(r[0] == r[1], r[0].cast("string")).otherwise(F.concat_ws("-", r[0].cast("string"), r[1].cast("string"))), F.lit(unit))), ", ")


def valid(ranges: Column) -> Column:
    return F.forall(ranges, lambda r: (F.size(r) == 2) & (F.get(r, F.lit(0)) <= F.get(r, F.lit(1))))


def within(ranges: Column, low: Column, high: Column) -> Column:
    return F.forall(ranges, lambda r: (r[0] >= low) & (r[1] <= high))


def selected(index: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (index >= r[0]) & (index <= r[1]))


def overlap(a: Column, b: Column) -> Column:
    return (a[0] <= b[1]) & (b[0] <= a[1])


def first_start(ranges: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(ranges, lambda r: r[0])), F.lit(0))
