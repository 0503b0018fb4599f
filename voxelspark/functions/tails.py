"""Tail probabilities as column expressions; neither Spark nor SQL has erf or Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Published coefficients of a Chebyshev fit of the complementary error function,
# relative error below 1.2e-7 everywhere.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
EXACT_T_DF = 1000  # beyond, the t tail is taken from a normal with a matched argument
EXACT_PAIRS = 50


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    z = z.cast("double")

    def upper(x: Column) -> Column:
        t = 1.0 / (1.0 + x / 2.0)
        poly = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            poly = poly * t + c
        return t * F.exp(poly - x * x) / 2.0

    tail = _let(F.abs(z) / math.sqrt(2.0), upper)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by its finite cosine series."""
    t, df = t.cast("double"), df.cast("int")
    c2 = df / (df + t * t)

    def series(n: Column, first: Column) -> Column:
        """Sum of the terms whose ratio is cos^2 (2j + first) / (2j + first + 1)."""
        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

        def step(s: Column, j: Column) -> Column:
            ratio = c2 * (2 * j + first) / (2 * j + first + 1)
            return F.struct((s["term"] * ratio).alias("term"), (s["total"] + s["term"]).alias("total"))

        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step)["total"]

    angle = F.atan(F.abs(t) / F.sqrt(df))
    even = F.sin(angle) * series(F.floor(df / 2).cast("int"), F.lit(1))
    odd = (angle + F.sin(angle) * F.cos(angle) * series(F.floor((df - 1) / 2).cast("int"), F.lit(2))) * (2.0 / math.pi)
    exact = F.greatest(F.lit(0.0), 1.0 - F.when(df % 2 == 0, even).otherwise(odd))
    z = (8.0 * df + 1.0) / (8.0 * df + 3.0) * F.sqrt(df * F.log1p(t * t / df))
    known = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(known, F.when(df <= EXACT_T_DF, exact).otherwise(2.0 * normal_sf(z)))


def student_critical(df: Column, p: float = 0.05) -> Column:
    """The t whose two-sided tail is ``p``, by bisection."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1e3).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        def halve(mid: Column) -> Column:
            out = student_p(mid, df) > p
            return F.struct(F.when(out, mid).otherwise(s["lo"]).alias("lo"), F.when(out, s["hi"]).otherwise(mid).alias("hi"))

        return _let((s["lo"] + s["hi"]) / 2.0, halve)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)
    return F.when(df > 0, (found["lo"] + found["hi"]) / 2.0)


def wilcoxon_p(w: Column, n: Column, ties: Column, zeros: Column) -> Column:
    """Two-sided p of W = min(W+, W-) over ``n`` non-zero pairs; ``ties`` is the sum of t^3 - t.

    Exact for up to 50 pairs without ties or zeros (the counts of rank sums, one rank after the
    other), else normal with tie correction.
    """
    n = n.cast("int")
    last = (n * (n + 1) / 2).cast("int")
    one = F.transform(F.sequence(F.lit(0), last), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def add(ways: Column, r: Column) -> Column:
        return F.transform(ways, lambda v, s: v + F.coalesce(F.when(s >= r, F.get(ways, s - r)), F.lit(0.0)))

    ways = F.aggregate(F.sequence(F.lit(1), n), one, add)
    below = F.aggregate(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda s, v: s + v)
    exact = F.least(F.lit(1.0), 2.0 * below / F.pow(F.lit(2.0), n))
    m = n.cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48.0
    rough = F.when(var <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * normal_sf(F.abs(w - m * (m + 1) / 4.0) / F.sqrt(var))))
    known = w.isNotNull() & n.isNotNull()
    return F.when(n == 0, 1.0).when(known & (n <= EXACT_PAIRS) & (ties == 0) & (zeros == 0), exact).when(known, rough)
