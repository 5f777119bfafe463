"""Helpers for higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times.

    Inside a lambda an expression is evaluated again for every element; a bound
    value is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(items: Column) -> Column:
    """0-based positions of an array."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>"))


def running_sums(values: Column) -> Column:
    """Sum of the values of an array up to and with each of them.

    Sums are taken inside blocks and over the blocks before, and no list is copied while it grows. Blocks of the cube root of twice
    the size make both parts of the work equal: it grows with the power 4/3 of the size.
    """
    zero = F.lit(0).cast("bigint")

    def total(items: Column) -> Column:
        return F.aggregate(items, zero, lambda acc, x: acc + x)

    def summed(values: Column, block: Column) -> Column:
        last = F.floor((F.size(values) - 1) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, block))
        return let(blocks, lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda part, b: let(
            total(F.slice(sums, F.lit(1), b)), lambda start: F.transform(part, lambda _, i: start + total(F.slice(part, F.lit(1), i + 1))))))))
    return F.when(F.size(values) > 0, let(F.transform(values, lambda v: v.cast("bigint")), lambda vs: let(
        F.ceil(F.cbrt(2.0 * F.size(vs))).cast("int"), lambda block: summed(vs, block)))).otherwise(F.array().cast("array<bigint>"))
