"""Per-voxel time-series transforms and features as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from ..operators.columns import attach_wide


# ---- row normalisation ---------------------------------------------------------------------


def zscore_eps(ts: Column) -> Column:
    """(v - mean) / (sd + 1e-6)."""
    return A.let(
        F.struct(A.mean(ts).alias("m"), (A.std(ts) + 1e-6).alias("s")),
        lambda p: F.transform(ts, lambda v: (v - p["m"]) / p["s"]),
    )


def zscore_nan(ts: Column) -> Column:
    """Like ``zscore_eps`` with NaN left out of mean and sd."""
    known = F.filter(ts, lambda v: ~F.isnan(v))
    return A.let(
        F.struct(A.mean(known).alias("m"), (A.std(known) + 1e-6).alias("s")),
        lambda p: F.transform(ts, lambda v: (v - p["m"]) / p["s"]),
    )


def zscore_unit(ts: Column) -> Column:
    """sd 0 is replaced by 1."""
    return A.let(
        F.struct(A.mean(ts).alias("m"), A.std(ts).alias("s")),
        lambda p: F.transform(ts, lambda v: (v - p["m"]) / F.when(p["s"] == 0, 1.0).otherwise(p["s"])),
    )


def zscore_flat(ts: Column) -> Column:
    """A row with sd of at most 1e-12 becomes all zeros."""
    return A.let(
        F.struct(A.mean(ts).alias("m"), A.std(ts).alias("s")),
        lambda p: F.transform(ts, lambda v: F.when(p["s"] > 1e-12, (v - p["m"]) / p["s"]).otherwise(0.0)),
    )


# ---- filters -------------------------------------------------------------------------------


def detrend(ts: Column) -> Column:
    """Residual of the least-squares line."""

    def body(p: Column) -> Column:
        return F.transform(ts, lambda v, i: v - p["m"] - p["b"] * (i - p["c"]))

    centre = (F.size(ts) - 1) / 2.0
    stats = F.struct(A.mean(ts).alias("m"), trend_slope(ts, 1.0).alias("b"), centre.alias("c"))
    return A.let(stats, body)


def trend_slope(ts: Column, step: float) -> Column:
    """Least-squares slope over t = 0, step, 2 step, ..."""
    n = F.size(ts)
    centre = (n - 1) / 2.0
    spread = n * (n * n - 1) / 12.0
    return F.try_divide(A.let(centre, lambda c: A.total(F.transform(ts, lambda v, i: v * (i - c)))), spread * step)


def _weights(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    s = sum(w)
    return [v / s for v in w]


def _mirrored(j: Column, n: Column, repeat_edge: bool) -> Column:
    if repeat_edge:
        m = F.pmod(j, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    m = F.pmod(j, F.greatest(2 * n - 2, F.lit(1)))
    return F.when(m < n, m).otherwise(2 * n - 2 - m)


def gaussian(ts: Column, sigma: float, radius: int, repeat_edge: bool) -> Column:
    """Normalised Gaussian along time.

    ``repeat_edge``: d c b a | a b c d | d c b a, otherwise d c b | a b c d | c b a.
    """
    n = F.size(ts)
    w = _weights(sigma, radius)

    def at(i: Column) -> Column:
        terms = [F.get(ts, _mirrored(i + k, n, repeat_edge).cast("int")) * w[k + radius] for k in range(-radius, radius + 1)]
        return sum(terms[1:], terms[0])

    return F.transform(ts, lambda _, i: at(i))


def gaussian_samples(ts: Column, sigma: float) -> Column:
    """Sigma in samples, truncated at four sigma, edge value repeated."""
    return gaussian(ts, sigma, int(4.0 * sigma + 0.5), True)


def gaussian_seconds(ts: Column, sigma_sec: float = 3.0, tr: float = 1.8) -> Column:
    """Sigma in seconds, truncated at three sigma, mirrored without repeating the edge."""
    sigma = sigma_sec / tr
    return gaussian(ts, sigma, max(1, math.ceil(3.0 * sigma)), False)


# ---- feature sets --------------------------------------------------------------------------

# Output column names, in the order users expect.
FEATURES_A = ["std", "dip_min", "t_min", "t_min_sec", "slope_down", "slope_up", "auc_neg", "auc_pos", "t_rise", "corr_tpl"]
FEATURES_B = ["dip_min", "t_min", "slope_down", "slope_up", "auc_neg", "auc_pos", "t_rise", "std", "corr_tpl", "t_min_sec"]


def features_a(ts: Column, ref: Column, tr: float) -> Column:
    """Ten features of the mean-centred series; ``ref`` is the reference series."""
    size = F.size(ts)

    def with_dip(p: Column) -> Column:
        n, dip, t = p["n"], p["dip"], p["t"]
        left = size - 1 - t
        recovery = A.first_position(F.slice(n, t + 1, size), lambda v: v > 0.5 * dip)
        rise = F.when(left > 0, A.let(recovery, lambda j: F.when(j >= 0, j * tr).otherwise((size - t) * tr))).otherwise(0.0)
        return F.struct(
            p["sd"].alias("std"),
            dip.alias("dip_min"),
            t.cast("double").alias("t_min"),
            (t * tr).alias("t_min_sec"),
            F.when(t > 0, dip / (t * tr)).otherwise(0.0).alias("slope_down"),
            F.when(left > 0, -dip / (left * tr)).otherwise(0.0).alias("slope_up"),
            A.total(F.filter(n, lambda v: v < 0)).alias("auc_neg"),
            A.total(F.filter(n, lambda v: v > 0)).alias("auc_pos"),
            rise.alias("t_rise"),
            F.when(p["sd"] > 1e-9, F.coalesce(A.pearson(ts, ref), F.lit(0.0))).otherwise(0.0).alias("corr_tpl"),
        )

    def with_centred(n: Column) -> Column:
        dip = F.array_min(n)
        return A.let(
            F.struct(
                n.alias("n"),
                dip.alias("dip"),
                (F.array_position(n, dip) - 1).cast("int").alias("t"),
                F.sqrt(A.squares(n, F.lit(0.0)) / size).alias("sd"),
            ),
            with_dip,
        )

    centred = A.let(A.mean(ts), lambda m: F.transform(ts, lambda v: v - m))
    return A.let(centred, with_centred)


def features_b(ts: Column, dt: float, template: Column | None = None, baseline_pct: float = 20.0) -> Column:
    """Ten features of the series relative to its own low percentile."""
    size = F.size(ts)
    clean = F.transform(ts, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    reach = F.greatest(F.lit(1), F.floor(size / 20).cast("int"))

    def finish(p: Column) -> Column:
        n, m = p["n"], p["m"]
        left = F.greatest(m - reach, F.lit(0))
        right = F.least(m + reach, size - 1)
        low, at_l, at_r = F.get(n, m), F.get(n, left), F.get(n, right)
        back = A.first_position(F.slice(n, m + 1, size), lambda v: v >= 0)
        corr = F.lit(0.0)
        if template is not None:
            corr = A.total(F.zip_with(zscore_nan(n), template, lambda a, b: a * b)) / size
        return F.struct(
            low.alias("dip_min"),
            m.cast("double").alias("t_min"),
            ((low - at_l) / (m - left + 1e-6)).alias("slope_down"),
            ((at_r - low) / (right - m + 1e-6)).alias("slope_up"),
            A.trapezoid(F.transform(n, lambda v: F.least(v, F.lit(0.0))), dt).alias("auc_neg"),
            A.trapezoid(F.transform(n, lambda v: F.greatest(v, F.lit(0.0))), dt).alias("auc_pos"),
            A.let(back, lambda j: F.when(j >= 0, j * dt).otherwise(0.0)).alias("t_rise"),
            A.std(n).alias("std"),
            corr.alias("corr_tpl"),
            (m * dt).alias("t_min_sec"),
        )

    def with_clean(c: Column) -> Column:
        relative = A.let(A.percentile(c, baseline_pct / 100.0) + 1e-6, lambda s: F.transform(c, lambda v: (v - s) / s))
        return A.let(
            relative,
            lambda n: A.let(F.struct(n.alias("n"), (F.array_position(n, F.array_min(n)) - 1).cast("int").alias("m")), finish),
        )

    return A.let(clean, with_clean)


def normalised_template(template: Column) -> Column:
    return zscore_nan(template)


# ---- representations -----------------------------------------------------------------------


def ts_raw(ts: Column) -> Column:
    return ts


def ts_normalized(ts: Column) -> Column:
    return zscore_eps(ts)


def ts_preprocessed(ts: Column) -> Column:
    """Detrend, smooth with sigma 1, normalise."""
    return A.let(detrend(ts), lambda d: A.let(gaussian_samples(d, 1.0), zscore_eps))


def reference_series(df: DataFrame, keys: list[str], ts: str = "ts", wm: str | None = "wm") -> DataFrame:
    """Mean series of the white-matter voxels, or of all voxels where a key has none."""
    whole = A.vector_mean(F.col(ts)).alias("_all")
    if wm is None:
        return df.groupBy(*keys).agg(whole).withColumnRenamed("_all", "ref")
    parts = df.groupBy(*keys, F.col(wm).alias("_wm")).agg(A.vector_sum(F.col(ts)).alias("s"), F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy(*keys).agg(
        F.max(F.when(F.col("_wm"), F.struct("s", "n"))).alias("w"),
        F.max(F.when(~F.col("_wm"), F.struct("s", "n"))).alias("o"),
    )
    both = F.when(
        F.col("o").isNotNull(), F.transform(F.col("o.s"), lambda v: v / F.col("o.n"))
    )
    return parts.select(*keys, F.coalesce(F.transform(F.col("w.s"), lambda v: v / F.col("w.n")), both).alias("ref"))


def bold_feature_table(df: DataFrame, keys: list[str], tr: float = 1.8, presmooth: float = 0.0, wm: str | None = "wm") -> DataFrame:
    """The ten features of set A as columns, against each key's reference series."""
    ref = reference_series(df, keys, wm=wm)
    x = gaussian_samples(F.col("ts"), presmooth) if presmooth > 0 else F.col("ts")
    rows = attach_wide(df, ref, keys).withColumn("f", A.let(x, lambda s: features_a(s, F.col("ref"), tr)))
    return rows.select(*[c for c in df.columns if c not in ("ts", "wm", "label")], "f.*")


def templated_feature_table(df: DataFrame, keys: list[str], tr: float = 1.8) -> DataFrame:
    """The ten features of set B as columns, against each key's normalised mean series."""
    template = reference_series(df, keys, wm=None).select(*keys, normalised_template(F.col("ref")).alias("_tpl"))
    rows = attach_wide(df, template, keys).withColumn("f", features_b(F.col("ts"), tr, F.col("_tpl")))
    return rows.select(*[c for c in df.columns if c != "ts"], "f.*")


def _array_representation(fn: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("ts", fn(F.col("ts")))


REPRESENTATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ts_raw": _array_representation(ts_raw),
    "ts_normalized": _array_representation(ts_normalized),
    "ts_preprocessed": _array_representation(ts_preprocessed),
    "bold_features": lambda df: bold_feature_table(df, ["patient"], presmooth=0.5),
    "bold_features_10": lambda df: bold_feature_table(df, ["patient"]),
    "bold_features_17": lambda df: bold_feature_table(df, ["patient"]),
    "full_17": lambda df: bold_feature_table(df, ["patient"]),
}


def representation(name: str) -> Callable[[DataFrame], DataFrame]:
    """A transform by name, for ``df.transform(representation(name))``."""
    if name not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {name!r}; known: {sorted(REPRESENTATIONS)}")
    return REPRESENTATIONS[name]
