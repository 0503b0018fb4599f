"""Column-wise normalisation and clean-up of feature tables, one aggregate per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

BROADCAST_BYTES = 64_000_000  # as text, an upper bound of what a task holds of a table of numbers
FLOAT_MAX = 3.4028234663852886e38  # largest 32-bit float


def with_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Column], of: DataFrame | None = None) -> DataFrame:
    """Join per-key aggregates (of ``df`` or of another table) back to the rows of ``df``.

    The small side has one row per key; adaptive execution broadcasts it when its measured
    size allows and otherwise splits a skewed key.
    """
    source = df if of is None else of
    if not keys:
        named = source.agg(*stats)
        one = named.select(F.struct(*named.columns)).scalar()
        return df.withColumn("_all", one).select(*df.columns, "_all.*")
    return df.join(source.groupBy(*keys).agg(*stats), list(keys), "left")


def attach(df: DataFrame, row: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per key; without keys the single row is added as constants."""
    if keys:
        return df.join(row, list(keys))
    one = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_all", one).select(*df.columns, "_all.*")


def attach_wide(df: DataFrame, row: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join one row per key to ``df`` without moving the rows of ``df``, which may hold whole series.

    ``row`` is written once and measured. Up to ``limit`` bytes it travels to the tasks as it is; a larger one goes in
    several passes, each with a share of the keys that fits and the rows of ``df`` that belong to them.
    """
    keys = list(keys)
    if not keys:
        return attach(df, row, keys)
    row = cut_lineage(row)
    size = row.select(F.sum(F.length(F.to_json(F.struct(*row.columns))))).first()[0] or 0
    parts = max(1, -(-int(size) // limit))
    if parts == 1:
        return df.join(F.broadcast(row), keys)
    share = F.pmod(F.xxhash64(*keys), F.lit(parts))
    out = None
    for i in range(parts):
        own = df.where(share == i).join(F.broadcast(row.where(share == i)), keys)
        out = own if out is None else out.unionByName(own)
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by ``by`` in as many tasks as the session shuffles into: adaptive execution would merge groups by their bytes, however long they take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def zmap(df: DataFrame, keys: Sequence[str], value: str, mask: Column, out: str) -> DataFrame:
    """(v - mean) / (sd + 1e-6) with mean and sd over the masked rows, applied to every row."""
    inside = F.when(mask, F.col(value))
    stats = [F.avg(inside).alias("_mu"), (F.stddev_pop(inside) + 1e-6).alias("_sd")]
    return with_stats(df, keys, stats).withColumn(out, (F.col(value) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


def robust_clip(df: DataFrame, keys: Sequence[str], cols: Sequence[str], limit: float = 6.0, fit: Column | None = None) -> DataFrame:
    """Clip each column to ``limit`` standard deviations around its mean (fitted on ``fit`` rows)."""
    stats = []
    for c in cols:
        v = F.col(c) if fit is None else F.when(fit, F.col(c))
        stats += [F.avg(v).alias(f"_{c}_mu"), (F.stddev_pop(v) + 1e-6).alias(f"_{c}_sd")]
    out = with_stats(df, keys, stats)
    for c in cols:
        mu, sd = F.col(f"_{c}_mu"), F.col(f"_{c}_sd")
        z = F.least(F.lit(limit), F.greatest(F.lit(-limit), (F.col(c) - mu) / sd))
        out = out.withColumn(c, z * sd + mu).drop(f"_{c}_mu", f"_{c}_sd")
    return out


def clean_numbers(df: DataFrame, keys: Sequence[str], cols: Sequence[str], limit: float = 1e6) -> DataFrame:
    """Replace non-finite entries of the matrix of each key.

    With any NaN present, NaN becomes 0 and infinities the largest 32-bit float; otherwise
    infinities, if any, make the whole matrix be clipped to ``limit``.
    """
    has_nan, has_inf = F.lit(False), F.lit(False)
    for c in cols:
        has_nan = has_nan | F.isnan(c)
        has_inf = has_inf | (F.abs(c) == float("inf"))
    out = with_stats(df, keys, [F.bool_or(has_nan).alias("_nan"), F.bool_or(has_inf).alias("_inf")])
    for c in cols:
        v = F.col(c)
        filled = F.when(F.isnan(v), 0.0).otherwise(F.least(F.lit(FLOAT_MAX), F.greatest(F.lit(-FLOAT_MAX), v)))
        clipped = F.least(F.lit(limit), F.greatest(F.lit(-limit), v))
        out = out.withColumn(c, F.when(F.col("_nan"), filled).when(F.col("_inf"), clipped).otherwise(v))
    return out.drop("_nan", "_inf")


def standardise(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fit: Column | None = None) -> DataFrame:
    """Zero mean and unit population variance, fitted on the ``fit`` rows; constant columns only shift."""
    stats = []
    for c in cols:
        v = F.col(c) if fit is None else F.when(fit, F.col(c))
        stats += [F.avg(v).alias(f"_{c}_mu"), F.stddev_pop(v).alias(f"_{c}_sd")]
    out = with_stats(df, keys, stats)
    for c in cols:
        sd = F.when(F.col(f"_{c}_sd") > 0, F.col(f"_{c}_sd")).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - F.col(f"_{c}_mu")) / sd).drop(f"_{c}_mu", f"_{c}_sd")
    return out


def varying_columns(df: DataFrame, cols: Sequence[str], threshold: float = 1e-8) -> list[str]:
    """Columns whose population variance exceeds ``threshold`` (one small action)."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


def suppress_outside(probs: Column, outside: Column, classes: Sequence[int], factor: float = 0.05) -> Column:
    """Scale the given class probabilities of voxels outside a region and renormalise the row."""
    scaled = F.transform(probs, lambda p, i: F.when(i.isin(list(classes)), p * factor).otherwise(p))
    total = F.aggregate(scaled, F.lit(0.0), lambda s, p: s + p)
    return F.when(outside, F.transform(scaled, lambda p: p / (total + 1e-8))).otherwise(probs)


def argmax_label(probs: Column) -> Column:
    """1-based position of the first largest entry."""
    return F.array_position(probs, F.array_max(probs)).cast("int")


def joint_probability(channels: Sequence[str]) -> Column:
    """Mean of the channels that are present."""
    values = F.filter(F.array(*channels), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))
