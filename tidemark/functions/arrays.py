"""Column expressions over arrays of doubles; nothing is exploded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def running(x: Column) -> Column:
    """The sums of all values up to each, in chunks of about the root of their number: no long array is copied at every step."""

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0.0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))

    def chunked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))

        def placed(c: Column) -> Column:
            before = sums(F.transform(c, total))
            return let(before, lambda b: F.flatten(F.transform(c, lambda part, k: F.transform(F.slice(sums(part), 2, F.size(part)), lambda s: s + F.get(b, k)))))

        return let(chunks, placed)

    return F.when(F.size(x) == 0, F.array().cast("array<double>")).otherwise(let(x, chunked))


def variance(x: Column) -> Column:
    """Of the population."""
    return let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.nullif(F.size(x), F.lit(0)))


def deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def difference(x: Column) -> Column:
    """The differences of neighbours; empty if there are none."""
    n = F.size(x)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(1))), F.slice(x, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: b - a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v))))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def rounded(x: Column, digits: int = 6) -> Column:
    """Without negative zeros."""
    return F.transform(x, lambda v: F.round(v, digits) + F.lit(0.0))


def r6(value) -> Column:
    """A result to six digits: null for what is not a number, no negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(finite(value), F.round(value, 6) + F.lit(0.0))
