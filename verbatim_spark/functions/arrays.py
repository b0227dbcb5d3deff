"""Array expressions whose cost stays in proportion to the array, for rows that
may hold very long ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array that are handled together.
_PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body's own lambdas
    name it again and again."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Inclusive running totals (or maxima, ...) of an array of bigints, part by part,
    since a fold that appends to an array copies it at each step."""
    none = F.array().cast("array<bigint>")

    def step(acc, x):
        at = F.when(acc["at"].isNull(), x).otherwise(combine(acc["at"], x))
        return let(at, lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))

    def part(acc, each):
        told = F.aggregate(each, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(told, lambda t: F.struct(t["at"].alias("at"), F.concat(acc["out"], F.array(t["out"])).alias("out")))

    start = F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(parts_of(values), start, part, lambda acc: F.flatten(acc["out"]))


def parts_of(items: Column, size: int = _PART) -> Column:
    """An array cut into arrays of ``size`` elements."""

    def cut(x):
        count = F.ceil(F.size(x) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(x, i * size + 1, F.lit(size)))

    return let(items, cut)


def fold_parts(items: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """An ordered fold that appends to an array or changes its last element, part by
    part: of each part's result all but the last element is set aside, so arrays
    that are copied at each step stay short. ``step`` takes (array, item)."""
    start = F.struct(F.array(none).alias("done"), none.alias("open"))

    def outer(acc, each):
        return let(F.aggregate(each, acc["open"], step), lambda x: F.struct(
            F.concat(acc["done"], F.array(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))))).alias("done"), F.slice(x, F.greatest(F.size(x), F.lit(1)), F.lit(1)).alias("open")
        ))

    return F.aggregate(parts_of(items), start, outer, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))
