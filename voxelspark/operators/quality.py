"""Quality control of series: noise, motion, spikes, drift, ghost bands, voxel labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays as A, series as TS, spectrum
from ..session import cut_lineage
from .columns import attach, with_stats
from .ranking import exact_percentiles, top_k

# Limits of the automatic voxel labels.
TSNR_BAD, TSNR_GOOD, DVARS_BAD, DVARS_GOOD = 0.10, 0.66, 0.90, 0.33
SPIKES_BAD, DRIFT_BAD, DRIFT_GOOD = 3, 5.0, 1.0
HEAD_RADIUS_MM = 50.0
FD_LIMIT_MM = 0.5


def previous_frame(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], chunk: int = 4096) -> DataFrame:
    """Values of ``cols`` in the preceding frame as ``prev_<c>``; frames are numbered without gaps.

    Long recordings are cut into chunks; the last frame of a chunk is copied into the next
    one, so a single recording spreads over many tasks.
    """
    first, second = F.floor(F.col(t) / chunk), F.floor((F.col(t) + 1) / chunk)
    copies = df.withColumn("_chunk", F.explode(F.array_distinct(F.array(first, second))))
    w = W.partitionBy(*keys, "_chunk").orderBy(t)
    out = copies.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})
    return out.where(F.floor(F.col(t) / chunk) == F.col("_chunk")).drop("_chunk")


def frame_differences(long: DataFrame, voxel: Sequence[str], t: str = "t", value: str = "value") -> DataFrame:
    """Difference to the previous frame of each voxel (the first frame drops out)."""
    w = W.partitionBy(*voxel).orderBy(t)
    out = long.withColumn("diff", F.col(value) - F.lag(value).over(w))
    return out.where(F.col("diff").isNotNull())


# ---- per-recording measures ----------------------------------------------------------------


def tsnr(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Mean and median over voxels of mean / sample sd, voxels with sd above 1e-8 only."""
    voxel = df.select(*keys, A.mean(F.col(ts)).alias("_m"), A.std(F.col(ts), 1).alias("_s")).where("_s > 1e-8")
    voxel = voxel.select(*keys, (F.col("_m") / F.col("_s")).alias("_r"))
    mean = voxel.groupBy(*keys).agg(F.avg("_r").alias("tsnr_mean"))
    return mean.join(exact_percentiles(voxel, keys, "_r", {"tsnr_median": 0.5}).drop("n"), list(keys))


def dvars(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Root mean square frame difference over voxels, one row per key and frame (from 1)."""
    squared = F.transform(A.diff(F.col(ts)), lambda d: d * d)
    frames = df.groupBy(*keys).agg(A.vector_mean(squared).alias("_d"))
    out = frames.select(*keys, F.posexplode("_d").alias("t", "_v"))
    return out.select(*keys, (F.col("t") + 1).alias("t"), F.sqrt("_v").alias("dvars"))


def dvars_summary(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and maximum DVARS and the number of frames with z above 3."""
    frames = with_stats(frames, keys, [F.avg("dvars").alias("_m"), F.stddev_pop("dvars").alias("_s")])
    spike = (F.col("_s") > 0) & ((F.col("dvars") - F.col("_m")) / F.col("_s") > 3.0)
    return frames.groupBy(*keys).agg(
        F.avg("dvars").alias("dvars_mean"), F.max("dvars").alias("dvars_max"), F.count_if(spike).alias("n_spikes_z3")
    )


def global_signal(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    means = df.groupBy(*keys).agg(A.vector_mean(F.col(ts)).alias("_g"), F.count(F.lit(1)).alias("n_voxels"))
    return means.select(*keys, "n_voxels", F.posexplode("_g").alias("t", "signal"))


def drift(signal: DataFrame, keys: Sequence[str], tr: float = 1.8) -> DataFrame:
    """Linear drift of the global signal in percent of the intercept per minute."""
    t = F.col("t") * tr
    out = signal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_volumes"),
        F.regr_slope("signal", t).alias("_b"),
        F.regr_intercept("signal", t).alias("_a"),
        F.avg("signal").alias("_m"),
        F.stddev_pop("signal").alias("_s"),
    )
    base = F.when(F.col("_a") != 0, F.col("_a")).otherwise(F.col("_m"))
    ok = (F.col("n_volumes") >= 3) & (F.col("_s") > 0)
    return out.select(*keys, "n_volumes", F.when(ok, F.try_divide(100.0 * F.col("_b"), base) * 60.0).alias("drift_pct_per_min"))


def displacement(motion: DataFrame, keys: Sequence[str], t: str = "t", radius: float = HEAD_RADIUS_MM) -> DataFrame:
    """Framewise displacement from three translations (mm) and three rotations (radians)."""
    cols = ["tx", "ty", "tz", "rx", "ry", "rz"]
    df = previous_frame(motion, keys, t, cols).where("prev_tx IS NOT NULL")
    fd = F.lit(0.0)
    for c in cols:
        step = F.abs(F.col(c) - F.col(f"prev_{c}"))
        fd = fd + (step * radius if c.startswith("r") else step)
    return df.select(*keys, t, fd.alias("fd"))


def displacement_summary(fd: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fd.groupBy(*keys).agg(
        F.avg("fd").alias("fd_mean"),
        F.max("fd").alias("fd_max"),
        (100.0 * F.avg((F.col("fd") > FD_LIMIT_MM).cast("double"))).alias("fd_pct"),
    )


def centroid_displacement(long: DataFrame, keys: Sequence[str], spacing: Sequence[float], value: str = "value") -> DataFrame:
    """Movement in mm of the intensity centroid; a frame without signal keeps the last centroid."""
    keys = list(keys)
    frames = long.groupBy(*keys, "t").agg(
        F.sum(value).alias("_w"), *[F.sum(F.col(a) * F.col(value)).alias(f"_{a}") for a in "xyz"]
    )
    order = W.partitionBy(*keys).orderBy("t")
    for a, s in zip("xyz", spacing):
        raw = F.when(F.col("_w") > 0, F.col(f"_{a}") / F.col("_w") * s)
        frames = frames.withColumn(f"c{a}", F.coalesce(F.last(raw, True).over(order), F.lit(0.0)))
    d = F.lit(0.0)
    for a in "xyz":
        step = F.col(f"c{a}") - F.lag(f"c{a}").over(order)
        d = d + step * step
    return frames.withColumn("fd", F.sqrt(d)).where("fd IS NOT NULL").select(*keys, "t", "fd")


def quality_record(df: DataFrame, keys: Sequence[str], fd: DataFrame, tr: float = 1.8) -> DataFrame:
    """One rounded quality record per recording from its healthy-tissue series."""
    keys = list(keys)
    signal = cut_lineage(global_signal(df, keys))
    voxels = signal.groupBy(*keys).agg(F.max("n_voxels").alias("n_voxels_healthy"))
    parts = [
        displacement_summary(fd, keys),
        dvars_summary(cut_lineage(dvars(df, keys)), keys),
        drift(signal, keys, tr),
        voxels,
    ]
    out = tsnr(df, keys)
    for p in parts:
        out = out.join(p, keys, "left")
    digits = {"tsnr_mean": 3, "tsnr_median": 3, "fd_mean": 4, "fd_max": 4, "fd_pct": 2, "dvars_mean": 4, "dvars_max": 4, "drift_pct_per_min": 4}
    return out.withColumns({c: F.bround(c, d) for c, d in digits.items()}).withColumn("tr_sec", F.lit(tr))


# ---- per-voxel features and labels ---------------------------------------------------------

# Output column names, in the order users expect.
VOXEL_FEATURES = [
    "tsnr", "dvars_rms", "n_spikes_z3", "low_freq_power_ratio", "drift_pct_per_min", "mean_amplitude_norm", "variance_detrended",
]


def voxel_features(df: DataFrame, keys: Sequence[str], ts: str = "ts", tr: float = 1.8, cut_hz: float = 0.10) -> DataFrame:
    """Seven quality features per voxel; all zero for fewer than four frames."""
    x = F.col(ts)
    n = F.size(x)
    base = df.withColumns({"_m": A.mean(x), "_low": spectrum.low_power_ratio(x, tr, cut_hz)})
    base = base.withColumns({"_s": F.sqrt(A.squares(x, F.col("_m")) / n), "_b": TS.trend_slope(x, tr)})
    m, s, b, g = (F.col(c) for c in ("_m", "_s", "_b", "_g"))
    safe = F.when(s > 1e-9, s).otherwise(1.0)
    spread = n * (n * n - 1) / 12.0 * tr * tr
    values = {
        "tsnr": F.when(s > 1e-9, m / s).otherwise(0.0),
        "dvars_rms": A.let(A.diff(x), lambda d: F.sqrt(A.squares(d, F.lit(0.0)) / F.size(d))),
        "n_spikes_z3": F.size(F.filter(x, lambda v: F.abs((v - m) / safe) > 3.0)).cast("double"),
        "low_freq_power_ratio": F.col("_low"),
        "drift_pct_per_min": b / F.when(F.abs(m) < 1e-6, 1.0).otherwise(m) * 100.0 * 60.0,
        "variance_detrended": s * s - b * b * spread / n,
    }
    keep = [c for c in df.columns if c != ts]
    # The series are read for the last time here: only numbers meet the key's mean.
    rows = base.select(*keep, m, (n < 4).alias("_short"), *[F.when(n < 4, 0.0).otherwise(v).alias(c) for c, v in values.items()])
    level = F.when(F.col("_short"), 0.0).otherwise((m - g) / F.greatest(F.abs(g), F.lit(1e-6)))
    rows = with_stats(rows, keys, [F.avg("_m").alias("_g")]).withColumn("mean_amplitude_norm", level)
    return rows.select(*keep, *VOXEL_FEATURES)


def auto_labels(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 good, 0 bad, -1 undecided from percentiles of the features; good wins over bad."""
    keys = list(keys)
    t = exact_percentiles(features, keys, "tsnr", {"_t_bad": TSNR_BAD, "_t_good": TSNR_GOOD}).drop("n")
    d = exact_percentiles(features, keys, "dvars_rms", {"_d_bad": DVARS_BAD, "_d_good": DVARS_GOOD}).drop("n")
    df = attach(attach(features, t, keys), d, keys)
    drift_abs, spikes = F.abs("drift_pct_per_min"), F.col("n_spikes_z3")
    noisy = (F.col("dvars_rms") >= F.col("_d_bad")) | (spikes >= SPIKES_BAD) | (drift_abs > DRIFT_BAD)
    bad = (F.col("tsnr") <= F.col("_t_bad")) & noisy
    calm = (F.col("dvars_rms") <= F.col("_d_good")) & (spikes == 0) & (drift_abs < DRIFT_GOOD)
    good = (F.col("tsnr") >= F.col("_t_good")) & calm
    return df.withColumn("quality", F.when(good, 1).when(bad, 0).otherwise(-1)).drop("_t_bad", "_t_good", "_d_bad", "_d_good")


# ---- ghost bands ---------------------------------------------------------------------------


def axis_profile(df: DataFrame, keys: Sequence[str], axis: str, value: str) -> DataFrame:
    """Mean per slice along an axis, with the detection threshold mean + 2 sd of the profile."""
    profile = df.groupBy(*keys, axis).agg(F.avg(value).alias("profile"))
    stats = [F.avg("profile").alias("profile_mean"), F.stddev_pop("profile").alias("_sd")]
    profile = with_stats(profile, keys, stats)
    return profile.withColumn("threshold", F.col("profile_mean") + 2.0 * F.col("_sd")).withColumnRenamed("_sd", "profile_std")


def scan_bands(profile: DataFrame, keys: Sequence[str], axis: str, half_width: int = 2) -> DataFrame:
    """Slices whose neighbourhood peak passes the threshold, skipping two half widths after a hit.

    The scan is sequential, so each profile (as long as one volume axis) becomes one array.
    """
    rows = profile.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(axis).alias("i"), F.col("profile").alias("v")))).alias("_p"),
        F.max("threshold").alias("threshold"),
        F.max("profile_mean").alias("profile_mean"),
    )
    values = F.transform("_p", lambda e: e["v"])
    rows = rows.select(*keys, "threshold", "profile_mean", values.alias("_v"))
    size = F.size("_v")
    start = F.struct(
        F.lit(half_width).alias("next"), F.array().cast("array<struct<band:int,peak_ratio:double>>").alias("hits")
    )

    def peak(i: Column) -> Column:
        return F.array_max(F.slice("_v", i - half_width + 1, F.lit(2 * half_width + 1)))

    def step(s: Column, i: Column) -> Column:
        hit = (i >= s["next"]) & (peak(i) > F.col("threshold"))
        ratio = F.bround(peak(i) / (F.col("profile_mean") + 1e-9), 4)
        found = F.struct(i.cast("int").alias("band"), ratio.alias("peak_ratio"))
        return F.struct(
            F.when(hit, i + 2 * half_width).otherwise(s["next"]).cast("int").alias("next"),
            F.when(hit, F.concat(s["hits"], F.array(found))).otherwise(s["hits"]).alias("hits"),
        )

    positions = F.when(size > 2 * half_width, F.sequence(F.lit(half_width), size - half_width - 1)).otherwise(
        F.array().cast("array<int>")
    )
    scanned = F.aggregate(positions, start, step)["hits"]
    return rows.select(*keys, "threshold", "profile_mean", F.inline(scanned))


def top_bands(bands: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    return top_k(bands, keys, [F.desc("peak_ratio"), F.desc("band")], n)


def ghost_report(df: DataFrame, keys: Sequence[str], axis: str, value: str, half_width: int = 3, n_top: int = 5) -> DataFrame:
    """Per key: profile statistics, and the bands with their peak ratios.

    Bands stand in scan order; only when more than ``n_top`` were found are they cut to the strongest, by
    falling ratio.
    """
    keys = list(keys)
    profile = cut_lineage(axis_profile(df, keys, axis, value))
    stats = profile.groupBy(*keys).agg(
        F.max("profile_mean").alias("profile_mean"), F.max("profile_std").alias("profile_std"), F.max("threshold").alias("threshold")
    )
    found = scan_bands(profile, keys, axis, half_width).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "peak_ratio"))).alias("_b"))
    falling = F.reverse(F.array_sort(F.transform("_b", lambda b: F.struct(b["peak_ratio"].alias("peak_ratio"), b["band"].alias("band")))))
    cut = F.transform(F.slice(falling, 1, n_top), lambda b: F.struct(b["band"].alias("band"), b["peak_ratio"].alias("peak_ratio")))
    found = found.withColumn("_b", F.when(F.size("_b") > n_top, cut).otherwise(F.col("_b")))
    lists = found.select(*keys, F.size("_b").cast("long").alias("n_bands"), F.col("_b.band").alias("band_indices"), F.col("_b.peak_ratio").alias("band_peak_ratios"))
    return stats.join(lists, keys, "left").withColumn("n_bands", F.coalesce("n_bands", F.lit(0).cast("long")))
