"""Region flags and training masks on a voxel table with boolean columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .columns import with_stats
from .grid import AXES
from .ranking import exact_percentiles
from .spatial import box_dilated_words, eroded_words, l1_within, line_words, with_words

# Parcellation label ids per tissue.
GM_LABELS = [3, 8, 10, 11, 12, 13, 17, 18, 26, 28, 42, 47, 49, 50, 51, 52, 53, 54, 58, 60]
WM_LABELS = [2, 7, 16, 41, 46]
CSF_LABELS = [4, 5, 14, 15, 24, 43, 44]

# Accepted names of each mask.
MASK_ALIASES = {
    "necro": ["necro", "nec", "necrosis"],
    "edema": ["edema", "ed", "edema_mask"],
    "enh": ["enh", "enhancing", "et"],
}

# Accepted names of the tumour core.
CORE_PARTS = {
    "necrosis": ["necro"],
    "necro": ["necro"],
    "enhancing": ["enh"],
    "enhancing_only": ["enh"],
    "enhancing_plus_necrosis": ["enh", "necro"],
}


def tissue(parc: Column) -> Column:
    return (
        F.when(parc.isin(GM_LABELS), "gm").when(parc.isin(WM_LABELS), "wm").when(parc.isin(CSF_LABELS), "csf")
    )


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def region_flags(df: DataFrame, seg: str, healthy: Column | None = None, csf: Column | None = None) -> DataFrame:
    """necro, enh, edema, tumor, csf, healthy from a label column and the ``brain`` flag."""
    brain, lab = F.col("brain"), F.col(seg)
    df = df.withColumns({n: (lab == k) & brain for n, k in (("necro", 1), ("edema", 2), ("enh", 3))})
    df = df.withColumn("tumor", F.col("necro") | F.col("enh") | F.col("edema"))
    from_label = (lab == 4) & brain
    df = df.withColumn("csf", from_label if csf is None else F.coalesce(csf & brain, from_label))
    base = brain & ~F.col("tumor")
    base = base if healthy is None else F.coalesce(healthy & brain, base)
    return df.withColumn("healthy", base & ~F.col("csf"))


def rename_masks(df: DataFrame) -> DataFrame:
    """Bring mask columns to their standard names; a standard name that exists wins."""
    for name, aliases in MASK_ALIASES.items():
        found = next((a for a in aliases if a in df.columns), None)
        if found is None:
            raise KeyError(f"no column for mask {name}; accepted: {aliases}")
        if found != name:
            df = df.withColumnRenamed(found, name)
    return df


def tumour_core(positive: str) -> Column:
    parts = CORE_PARTS.get(positive.lower().strip())
    if parts is None:
        raise ValueError(f"unknown positive definition {positive!r}")
    out = F.col(parts[0])
    for p in parts[1:]:
        out = out | F.col(p)
    return out


def train_masks(
    df: DataFrame,
    keys: Sequence[str],
    positive: str,
    negative: str = "healthy_strict",
    margin_steps: int = 2,
    controlled_steps: int = 12,
    band_steps: int = 14,
    include_edema: bool = True,
    parc: str | None = None,
    exclude_csf: bool = True,
) -> DataFrame:
    """All training and test masks of every patient.

    One city-block distance pass with the largest radius serves the margin, the controlled
    band and the test band.  The distance is taken over the whole volume, not only the brain.
    """
    if negative not in ("healthy_strict", "healthy_controlled"):
        raise ValueError(f"unknown negative definition {negative!r}")
    if margin_steps < 0 or band_steps < 0:
        raise ValueError("steps must be >= 0")
    if negative == "healthy_controlled" and controlled_steps <= margin_steps:
        raise ValueError("controlled_steps must exceed margin_steps")
    keys = list(keys)
    brain = F.col("brain")
    df = df.withColumns({c: F.col(c) & brain for c in ("enh", "necro", "edema")})
    df = df.withColumn("core", tumour_core(positive)).withColumn("edema", F.col("edema") & ~F.col("core"))
    reach = max(margin_steps, band_steps, controlled_steps if negative == "healthy_controlled" else 0)
    near = l1_within(df.where("core").select(*keys, *AXES), keys, reach)
    df = df.join(near, [*keys, *AXES], "left")
    within = lambda n: is_true(F.col("l1") <= n) & brain
    df = df.withColumn("margin", within(margin_steps))
    df = df.withColumn("ring", F.col("margin") & ~F.col("core"))
    df = df.withColumn("healthy_candidate", brain & ~(F.col("enh") | F.col("necro")) & ~F.col("edema"))
    strict = F.col("healthy_candidate") & ~F.col("margin")
    if negative == "healthy_controlled":
        band = strict & within(controlled_steps)
        df = with_stats(df.withColumn("_band", band), keys, [F.bool_or("_band").alias("_any")])
        df = df.withColumn("healthy_train", F.when(F.col("_any"), F.col("_band")).otherwise(strict)).drop("_band", "_any")
    else:
        df = df.withColumn("healthy_train", strict)
    if parc is not None:
        kind = tissue(F.col(parc))
        df = df.withColumns({t: is_true(kind == t) & brain for t in ("gm", "wm", "csf")})
        if exclude_csf:
            df = df.withColumn("healthy_train", F.col("healthy_train") & ~F.col("csf"))
        df = df.withColumns({f"healthy_train_{t}": F.col("healthy_train") & F.col(t) for t in ("gm", "wm")})
    df = df.withColumn("train", F.col("healthy_train") | F.col("core"))
    df = df.withColumn("band", within(band_steps) & ~F.col("core"))
    region = F.col("band") | F.col("edema") if include_edema else F.col("band")
    return df.withColumn("test_region", region & brain).drop("l1")


def consensus(
    df: DataFrame, keys: Sequence[str], segs: Sequence[str], parc: str | None = None, margin_steps: int = 1, edema_steps: int = 5
) -> DataFrame:
    """Union of several segmentations with dilated core and edema and the band between them."""
    keys = list(keys)
    core, edema = F.lit(False), F.lit(False)
    for s in segs:
        core = core | is_true(F.col(s).isin(1, 3))
        edema = edema | is_true(F.col(s) == 2)
    csf = F.lit(False) if parc is None else is_true(F.col(parc).isin(CSF_LABELS))
    df = df.withColumn("csf", csf)
    df = df.withColumns({"core": core & ~csf, "edema": (core | edema) & ~csf})
    for src, n, out in (("core", margin_steps, "core_plus"), ("edema", edema_steps, "edema_plus")):
        near = l1_within(df.where(src).select(*keys, *AXES), keys, n).select(*keys, *AXES, F.lit(True).alias("_near"))
        df = df.join(near, [*keys, *AXES], "left").withColumn(out, is_true(F.col("_near")) & ~F.col("csf")).drop("_near")
    return df.withColumn("between", F.col("edema_plus") & ~F.col("core_plus"))


def consensus_counts(masks: DataFrame, keys: Sequence[str], segs: Sequence[str]) -> DataFrame:
    flags = ["core", "core_plus", "edema", "edema_plus", "between", "csf"]
    cols = [F.count_if(F.col(f)).alias(f) for f in flags]
    for s in segs:
        cols += [F.count_if(F.col(s).isin(1, 3)).alias(f"{s}_core"), F.count_if(F.col(s) == 2).alias(f"{s}_edema")]
    return masks.groupBy(*keys).agg(*cols)


def vessel_exclusion(df: DataFrame, keys: Sequence[str], metric: str, percentile: float = 99.0) -> tuple[DataFrame, DataFrame]:
    """Flag voxels at or above a high percentile of ``metric`` among positive in-brain values.

    Returns the voxel table with ``excluded`` and ``keep``, and one row of statistics per key.
    """
    v = F.col(metric)
    finite = F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    df = df.withColumn(metric, F.when(F.col("brain"), finite).otherwise(0.0))
    used = df.where(F.col("brain") & (F.col(metric) > 0))
    cuts = exact_percentiles(used, keys, metric, {"threshold": percentile / 100, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    df = df.join(cuts.select(*keys, "threshold"), list(keys), "left")
    df = df.withColumn("excluded", is_true(F.col(metric) >= F.col("threshold")) & F.col("brain"))
    df = df.withColumn("keep", F.col("brain") & ~F.col("excluded"))
    pos = F.when(F.col("brain") & (F.col(metric) > 0), F.col(metric))
    counts = df.groupBy(*keys).agg(
        F.count_if("brain").alias("voxels_total"),
        F.count_if("keep").alias("voxels_keep"),
        F.count_if("excluded").alias("voxels_removed"),
        F.min(pos).alias("min"),
        F.max(pos).alias("max"),
    )
    counts = counts.withColumn("fraction_removed", F.coalesce(F.col("voxels_removed") / F.nullif("voxels_total", F.lit(0)), F.lit(0.0)))
    return df, counts.join(cuts.drop("n"), list(keys), "left")


def enhancement(df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5, wm: str | None = None) -> DataFrame:
    """Voxels at or above ``factor`` times the median of the reference tissue.

    Adds ``median_reference``, ``threshold``, ``norm_kind`` and ``enh``; a missing or
    non-positive median gives an empty mask.
    """
    keys = list(keys)
    if wm is not None:
        df = with_stats(df, keys, [F.bool_or(wm).alias("_has_wm")])
        ref = F.col("brain") & (~F.col("_has_wm") | F.col(wm))
        kind = F.when(F.col("_has_wm"), "median_wm").otherwise("median_brain")
    else:
        ref, kind = F.col("brain"), F.lit("median_brain")
    med = exact_percentiles(df.where(ref), keys, value, {"median_reference": 0.5}).drop("n")
    df = df.withColumn("norm_kind", kind).join(med, keys, "left")
    df = df.withColumn("threshold", F.when(F.col("median_reference") > 0, F.col("median_reference") * factor))
    return df.withColumn("enh", is_true(F.col(value) >= F.col("threshold")) & F.col("brain")).drop("_has_wm")


def guided_seeds(df: DataFrame, keys: Sequence[str], eroded: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Class per seed voxel; a tumour class whose eroded seed is empty falls back to its full mask.

    ``df`` holds one flag per class; ``eroded`` the eroded voxel set of each class.  A later
    class of ``order`` overrides an earlier one.
    """
    keys = list(keys)
    for c in order:
        seed = eroded[c].select(*keys, *AXES, F.lit(True).alias("_s")).distinct()
        df = df.join(seed, [*keys, *AXES], "left").withColumn(f"seed_{c}", is_true(F.col("_s")) & F.col("brain")).drop("_s")
    df = with_stats(df, keys, [F.bool_or(f"seed_{c}").alias(f"_any_{c}") for c in order])
    healthy_seed = F.col("seed_gm") | F.col("seed_wm")
    label = F.lit(None).cast("int")
    for i, c in enumerate(order):
        flag = F.col(f"seed_{c}")
        if c not in ("gm", "wm"):
            flag = F.when(F.col(f"_any_{c}"), flag).otherwise(F.col(c) & F.col("brain") & ~healthy_seed)
        label = F.when(flag, F.lit(i)).otherwise(label)
    return df.withColumn("seed_class", label).drop(*[f"_any_{c}" for c in order])


# Accepted region-of-interest names.
ROI_TUMOR = ["tumor"]
ROI_EDEMA = ["edema", "flair_minus_ce"]
ROI_BOTH = ["tumor_plus_edema", "tumor+edema", "tumor_edema"]


def roi(name: str | Column) -> Column:
    """Tumour, edema or both inside the brain and outside CSF; any other name means the whole brain."""
    name = name if isinstance(name, Column) else F.lit(name)
    key = F.lower(F.trim(F.coalesce(name, F.lit("brain"))))
    region = (
        F.when(key.isin(ROI_TUMOR), F.col("tumor"))
        .when(key.isin(ROI_EDEMA), F.col("edema"))
        .when(key.isin(ROI_BOTH), F.col("tumor") | F.col("edema"))
        .otherwise(F.lit(True))
    )
    return region & F.col("brain") & ~F.col("csf")


def csf_mask(given: Column | None, pve: Column | None, threshold: float = 0.7) -> Column:
    """A given mask inside the brain, else the partial-volume map above ``threshold``, else empty."""
    picks = []
    if given is not None:
        picks.append(given & F.col("brain"))
    if pve is not None:
        picks.append((pve > threshold) & F.col("brain"))
    return F.coalesce(*picks, F.lit(False))


def restrict_map(value: Column, mask: Column) -> Column:
    return F.when(mask, value).otherwise(F.lit(0.0))


def healthy_and_csf(df: DataFrame, keys: Sequence[str], seg: str, csf_pve: str, threshold: float = 0.7) -> DataFrame:
    """Healthy brain without segmented voxels, and CSF opened with a 3x3x3 cube inside it."""
    keys = list(keys)
    df = df.withColumn("healthy", F.col("brain") & ~is_true(F.col(seg) >= 0.5))
    bright = eroded_words(line_words(df, keys, {"_csf": F.col(csf_pve) > threshold}), keys, ["_csf"], 26)
    df = with_words(df, box_dilated_words(bright, keys, ["_csf"]), keys, ["_csf"])
    return df.withColumn("csf", F.col("_csf") & F.col("healthy")).drop("_csf")


def tissue_table(df: DataFrame) -> DataFrame:
    """Precomputed tissue maps: clipped partial volumes, parenchyma, healthy brain and CSF."""
    gm, wm = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c in ("gm_pve", "wm_pve"))
    df = df.withColumns({"gm_pve": gm, "wm_pve": wm})
    parenchyma = F.col("gm_pve") + F.col("wm_pve") >= 0.3
    df = df.withColumn("parenchyma", parenchyma)
    df = df.withColumn("brain_healthy", F.coalesce("brain_healthy", "parenchyma"))
    return df.withColumn("csf", F.coalesce(F.col("csf_given"), F.col("csf_pve") >= 0.5))


def extended_brain(df: DataFrame, seg: str, brain: str = "brain") -> DataFrame:
    """The brain flag with every segmented voxel added."""
    return df.withColumn(brain, F.col(brain) | (F.coalesce(seg, F.lit(0)) > 0))


def label_map(df: DataFrame, clusters: DataFrame, keys: Sequence[str], cluster: str = "cluster", out: str = "label") -> DataFrame:
    """Cluster numbers of a region from 1 on, 0 outside; ``clusters`` lists the region's voxels by ``flat_idx``."""
    rows = df.join(clusters.select(*keys, "flat_idx", F.col(cluster).alias("_c")), [*keys, "flat_idx"], "left")
    return rows.withColumn(out, F.coalesce(F.col("_c") + 1, F.lit(0))).drop("_c")


def flag_counts(df: DataFrame, keys: Sequence[str], flags: Mapping[str, str]) -> DataFrame:
    """Voxels of each flag per key; ``flags`` maps a flag to the name of its count."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c)).alias(n) for c, n in flags.items()])


def flag_means(df: DataFrame, keys: Sequence[str], value: str, flags: Mapping[str, str]) -> DataFrame:
    """Mean of ``value`` over the voxels of each flag per key, NULL where there are none."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(c), F.col(value))).alias(n) for c, n in flags.items()])
