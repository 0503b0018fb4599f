"""Ranks, quantiles and seeded choices that never sort a whole group in one task.

A plain ``row_number() over (partition by k order by v)`` or ``percentile`` sends a
whole group to one task.  Here equal values are counted first (so a hot value is one
row after the map side), the distinct values are split into ranges at approximate
quantiles, and only the small per-range totals are accumulated per group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

ROWS_PER_RANGE = 2_000_000
MIN_RANGES, MAX_RANGES = 8, 4096
SORTED_ROWS = 100_000  # of a group that one task may order
SUBRANGES = 4096  # of each range, where a table needs more than MAX_RANGES
_BEFORE = (W.unboundedPreceding, -1)


def _window(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def _range_number(value: str, bounds: Sequence[float]) -> Column:
    """How many sorted bounds lie below the value, by a coarse and a fine look-up."""
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [list(bounds[i : i + width]) for i in range(0, len(bounds), width)]
    below = lambda b: b < F.col(value)
    coarse = F.size(F.filter(F.lit([b[0] for b in blocks]), below))
    fine = F.size(F.filter(F.element_at(F.array(*[F.lit(b) for b in blocks]), coarse), below))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)


@dataclass(frozen=True)
class ValueTable:
    """The distinct values of each group with their measures, once on disk, cut into ranges of near equal size.

    Many questions about one order share it: percentiles, sums below a value, ranks of other values.
    """

    rows: DataFrame
    keys: list[str]
    value: str
    names: list[str]
    bounds: list[float]
    finer: DataFrame | None  # bounds within each range, for tables of more than MAX_RANGES ranges

    def numbered(self, df: DataFrame) -> DataFrame:
        """``df`` (with a column called like the value) with the range of each row."""
        return _numbered(df, self.value, self.bounds, self.finer)


def _numbered(df: DataFrame, value: str, bounds: Sequence[float], finer: DataFrame | None) -> DataFrame:
    df = df.withColumn("_range", _range_number(value, bounds) if bounds else F.lit(0))
    if finer is None:
        return df
    # One row per range, at most MAX_RANGES of them.
    inner = F.size(F.filter("_inner", lambda b: b < F.col(value)))
    joined = df.join(F.broadcast(finer), "_range", "left")
    return joined.withColumn("_range", F.col("_range").cast("long") * SUBRANGES + F.coalesce(inner, F.lit(0))).drop("_inner")


def value_table(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column], rows_per_range: int = ROWS_PER_RANGE) -> ValueTable:
    """Count equal values first, then cut the distinct ones into ranges.

    The number of ranges follows the number of distinct values. Up to MAX_RANGES bounds reach the driver; a table that
    needs more ranges cuts each of them again, by bounds that stay in a table.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    distinct = cut_lineage(known.groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()]))
    wanted = max(MIN_RANGES, math.ceil(distinct.count() / rows_per_range))
    ranges = min(MAX_RANGES, wanted)
    probs = [i / ranges for i in range(1, ranges)]
    bounds = distinct.select(F.percentile_approx(value, F.lit(probs), 10 * ranges)).first()[0] or []
    bounds = sorted({float(b) for b in bounds})
    finer = None
    if wanted > ranges:
        parts = min(SUBRANGES, math.ceil(wanted / ranges))
        inner = F.percentile_approx(F.col(value).cast("double"), F.lit([i / parts for i in range(1, parts)]), 10 * parts)
        finer = cut_lineage(_numbered(distinct, value, bounds, None).groupBy("_range").agg(F.array_distinct(inner).alias("_inner")))
    return ValueTable(_numbered(distinct, value, bounds, finer), keys, value, list(measures), bounds, finer)


def running(table: ValueTable, extra: DataFrame | None = None) -> DataFrame:
    """Per value: each measure, its sum below (``<m>_before``) and in all (``<m>_total``).

    ``extra`` has further values to be placed in the order, with the measures they add (usually zeros) and any marks.
    """
    keys, value, names = table.keys, table.value, table.names
    rows = table.rows if extra is None else table.rows.unionByName(table.numbered(extra), allowMissingColumns=True)
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in names])
    group = _window(keys)
    below = group.orderBy("_range").rowsBetween(*_BEFORE)
    offsets = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_{n}_off") for n in names],
        *[F.sum(n).over(group).alias(f"{n}_total") for n in names],
    )
    order = W.partitionBy(*keys, "_range").orderBy(value)
    inside = order.rowsBetween(*_BEFORE) if extra is None else order.rangeBetween(W.unboundedPreceding, 0)
    joined = rows.join(offsets, [*keys, "_range"])
    marks = [c for c in rows.columns if c not in {*keys, value, "_range", *names}]
    before = {n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}
    if extra is not None:  # rows of one value share the sums: what is at the value itself isn't below it
        same = W.partitionBy(*keys, "_range", value)
        joined = joined.withColumns({f"_{n}_at": F.sum(n).over(same) for n in names})
        before = {n: before[n] - F.col(f"_{n}_at") for n in names}
        names_out = [F.col(f"_{n}_at").alias(n) for n in names]
    else:
        names_out = [F.col(n) for n in names]
    return joined.select(
        *keys, value, "_range", *marks, *names_out,
        *[(F.col(f"_{n}_off") + before[n]).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names],
    )


def value_prefix(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Mapping[str, Column],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per distinct ``value``: each measure, its sum below (``<m>_before``) and in all (``<m>_total``).

    ``measures`` are sum-like aggregates (``F.count``, ``F.sum``).  The result keeps the range
    number ``_range`` for further steps along the same order.
    """
    return running(value_table(df, keys, value, measures, rows_per_range))


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "mid_rank") -> DataFrame:
    """Average 1-based rank of each distinct value within its group."""
    table = value_prefix(df, keys, value, {"n": F.count(F.lit(1))})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    return table.select(*keys, value, "n", rank.alias(out))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolation percentiles, one column per entry of ``probs`` (fractions in [0, 1])."""
    return percentiles_of(value_prefix(df, keys, value, {"n": F.count(F.lit(1))}), keys, value, probs)


def percentiles_of(table: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """``exact_percentiles`` from a ``running`` table with the measure ``n``."""
    last = F.col("n_total") - 1
    start, end = F.col("n_before"), F.col("n_before") + F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col(value)))

    picks = []
    for name, p in probs.items():
        picks += [
            at(F.floor(last * p)).alias(f"_{name}_lo"),
            at(F.ceil(last * p)).alias(f"_{name}_hi"),
        ]
    picked = table.groupBy(*keys).agg(F.max("n_total").alias("n_total"), *picks)
    cols = []
    for name, p in probs.items():
        pos = last * p
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, F.col("n_total").alias("n"), *cols)


def suffix_min(table: DataFrame, keys: Sequence[str], value: str, term: str, out: str) -> DataFrame:
    """Minimum of ``term`` over all values at or above each row of a ``value_prefix`` table."""
    keys = list(keys)
    mins = table.groupBy(*keys, "_range").agg(F.min(term).alias("_m"))
    above = _window(keys).orderBy(F.desc("_range")).rowsBetween(*_BEFORE)
    mins = mins.select(*keys, "_range", F.min("_m").over(above).alias("_later"))
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)
    return (
        table.join(mins, [*keys, "_range"])
        .withColumn(out, F.least(F.min(term).over(inside), F.coalesce("_later", F.lit(float("inf")))))
        .drop("_later")
    )


def bh_adjusted(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Step-up adjusted value per distinct ``p``: columns keys, ``p``, ``n``, ``p_bh``."""
    table = value_prefix(df, keys, p, {"n": F.count(F.lit(1))})
    table = table.withColumn("_term", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n")))
    table = suffix_min(table, keys, p, "_term", "_adj")
    return table.select(*keys, p, "n", F.col("n_total").alias("n_tests"), F.least(F.col("_adj"), F.lit(1.0)).alias("p_bh"))


def seeded_key(seed: Column | int | str, ident: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), ident.cast("string")))


def _slice_offsets(rows: DataFrame, by: Sequence[str], piece: str) -> DataFrame:
    """Rows before each slice of a group, and in it."""
    counts = rows.groupBy(*by, piece).agg(F.count(F.lit(1)).alias("_ch_c"))
    before = _window(by).orderBy(piece).rowsBetween(*_BEFORE)
    return counts.select(*by, piece, "_ch_c", F.coalesce(F.sum("_ch_c").over(before), F.lit(0)).alias("_ch_o"))


def choose(df: DataFrame, groups: Sequence[str], ident: str, n: Column | int, seed: Column | int = 42, largest: int | None = None) -> DataFrame:
    """Exactly ``n`` rows per group in the order of a seeded hash of ``ident``.

    The hash is uniform, so its hex digits cut each group into even slices.  Slice counts
    decide which of 256 slices are taken whole; the one that is cut is divided by two more
    digits, so a group of any size is ordered in pieces of 1/65536.  ``n`` may be a column
    that is constant within a group.  Groups known to have at most ``largest`` rows, no more than SORTED_ROWS, are
    ordered whole.
    """
    groups = list(groups)
    if groups and largest is not None and largest <= SORTED_ROWS:
        named = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*groups, ident)])
        rows = df.where(named).withColumns({"_ch_n": n if isinstance(n, Column) else F.lit(n), "_ch_h": seeded_key(seed, F.col(ident))})
        return rows.withColumn("_ch_r", F.row_number().over(W.partitionBy(*groups).orderBy("_ch_h", ident))).where("_ch_r <= _ch_n").select(*df.columns)
    rows = df.withColumn("_ch_n", (n if isinstance(n, Column) else F.lit(n)).cast("long"))
    rows = rows.withColumn("_ch_h", seeded_key(seed, F.col(ident)))
    rows = rows.withColumns({"_ch_s": F.substring("_ch_h", 1, 2), "_ch_s2": F.substring("_ch_h", 3, 2)})
    first = _slice_offsets(rows, groups, "_ch_s")
    rows = rows.join(first, [*groups, "_ch_s"]).where(F.col("_ch_o") < F.col("_ch_n"))
    rows = rows.withColumn("_ch_left", F.col("_ch_n") - F.col("_ch_o")).withColumn("_ch_cut", F.col("_ch_c") > F.col("_ch_left")).drop("_ch_c", "_ch_o")
    second = _slice_offsets(rows.where("_ch_cut"), [*groups, "_ch_s"], "_ch_s2").drop("_ch_c")
    rows = rows.join(second, [*groups, "_ch_s", "_ch_s2"], "left").where("NOT _ch_cut OR _ch_o < _ch_left")
    inside = W.partitionBy(*groups, "_ch_s", "_ch_s2").orderBy("_ch_h", ident)
    rows = rows.withColumn("_ch_r", F.coalesce("_ch_o", F.lit(0)) + F.row_number().over(inside))
    return rows.where("NOT _ch_cut OR _ch_r <= _ch_left").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  Spark keeps only ``k`` rows per task before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(_window(keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(out) <= k)
