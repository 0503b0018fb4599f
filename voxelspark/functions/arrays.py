"""Arithmetic on one array column, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times.

    A column used inside a lambda is otherwise evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def squares(a: Column, centre: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - centre) * (v - centre))


def variance(a: Column, ddof: int = 0) -> Column:
    return let(mean(a), lambda m: F.try_divide(squares(a, m), F.size(a) - ddof))


def std(a: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(a, ddof))


def first_position(a: Column, test: Callable[[Column], Column]) -> Column:
    """0-based index of the first element that passes, or -1."""
    return (F.array_position(F.transform(a, test), True) - 1).cast("int")


def diff(a: Column) -> Column:
    """Consecutive differences (empty for fewer than two elements)."""
    return F.slice(F.transform(a, lambda v, i: v - F.get(a, F.greatest(i - 1, F.lit(0)))), F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def percentile(a: Column, p: float) -> Column:
    """Linear-interpolation percentile of one array."""
    return let(F.array_sort(a), lambda s: let((F.size(s) - 1) * F.lit(p), lambda h: _lerp(s, h)))


def _lerp(s: Column, h: Column) -> Column:
    lo, hi = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
    return lo + (hi - lo) * (h - F.floor(h))


def trapezoid(a: Column, dx: float) -> Column:
    return F.lit(dx) * (total(a) - (F.get(a, F.lit(0)) + F.get(a, F.size(a) - 1)) / 2)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length; NULL for a constant one."""

    def body(ms: Column) -> Column:
        ma, mb = ms["a"], ms["b"]
        cross = total(F.zip_with(a, b, lambda p, q: (p - ma) * (q - mb)))
        scale = F.sqrt(squares(a, ma) * squares(b, mb))
        return let(scale, lambda s: F.when(s > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cross / s))))

    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), body)


def vector_mean(a: Column) -> Column:
    """Aggregate: element-wise mean of an array column, without exploding it."""
    return vector_to_array(Summarizer.mean(array_to_vector(a)))


def vector_sum(a: Column) -> Column:
    """Aggregate: element-wise sum of an array column, without exploding it."""
    return vector_to_array(Summarizer.sum(array_to_vector(a)))
