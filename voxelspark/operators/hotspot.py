"""Hotspot detection, statistics, ranking and phenotyping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, series as TS, tails
from ..session import cut_lineage
from .columns import attach
from .evaluation import adjust_p
from .grid import AXES, Grid
from .ranking import ValueTable, percentiles_of, running, top_k, value_table
from .spatial import connected_components, euclidean_distance, surface_area

# Default limits of the detector and of the phenotype rule.
MIN_CLUSTER_VOXELS = 150
MIN_CORE_DISTANCE_MM = 5.0
MAX_CLUSTERS = 3
PERCENTILES = (90, 95)
MIN_SIGNIFICANT_MM3 = 100.0
INTRA_COHERENT = 0.30
MULTIFOCAL_SPHERICITY = 0.35
COMPACT_SPHERICITY = 0.40

# Probabilities count in this part of one, so sums don't depend on the order of the rows; means tie
# when they agree to ``TIE`` of one.
UNIT, TIE = 1e12, 1e9

# Channel column and its tissue name, in tie-breaking order.
CHANNELS = {"p_nec": "necrosis", "p_enh": "enhancing", "p_mix": "enhancing_plus_necrosis"}


def units(v: Column | str, scale: float = UNIT) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) * scale + 0.5)


def in_units(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Probabilities as whole numbers of units, again as a part of one."""
    return rows.withColumns({c: units(c).cast("double") / UNIT for c in columns if c in rows.columns})


def exact_mean(v: str) -> Column:
    return F.sum(units(v).cast("decimal(20,0)")).cast("double") / (F.lit(UNIT) * F.count(v))


def value_order(region: DataFrame, keys: Sequence[str], p: str) -> ValueTable:
    """The one order of a region's values from which thresholds, backgrounds and ranks are read."""
    v = F.col(p)
    return value_table(region, keys, p, {"n": F.count(F.lit(1)), "s": F.sum(v), "q": F.sum(v * v)})


def thresholds(order: ValueTable, percentiles: Sequence[int]) -> DataFrame:
    """keys, pct, threshold and the background below it (``bg_mean``, ``bg_std`` of at least 1e-9)."""
    keys, p = order.keys, order.value
    table = cut_lineage(running(order))
    cuts = percentiles_of(table, keys, p, {f"t{q}": q / 100 for q in percentiles})
    rows = F.array(*[F.struct(F.lit(q).alias("pct"), F.col(f"t{q}").alias("threshold")) for q in percentiles])
    cuts = cut_lineage(cuts.select(*keys, F.inline(rows)))
    cold = attach(table.select(*keys, p, "n", "s"), cuts.groupBy(*keys).agg(F.collect_list(F.struct("pct", "threshold")).alias("_cuts")), keys)
    # Two passes over the distinct values: the mean below each threshold, then the spread around it.
    cold = cold.select(*keys, p, "n", "s", F.inline("_cuts")).where(F.col(p) < F.col("threshold"))
    means = cold.groupBy(*keys, "pct").agg(F.sum("n").alias("_n"), (F.sum("s") / F.sum("n")).alias("bg_mean"))
    spread = attach(cold, means.drop("_n"), [*keys, "pct"]).groupBy(*keys, "pct").agg(F.sqrt(F.sum(F.col("n") * (F.col(p) - F.col("bg_mean")) * (F.col(p) - F.col("bg_mean"))) / F.sum("n")).alias("_sd"))
    out = cuts.join(means.drop("_n"), [*keys, "pct"], "left").join(spread, [*keys, "pct"], "left")
    return out.select(
        *keys, "pct", "threshold", F.coalesce("bg_mean", F.lit(0.0)).alias("bg_mean"), F.greatest(F.coalesce("_sd", F.lit(1.0)), F.lit(1e-9)).alias("bg_std")
    )


def dominant_channel(means: dict[str, str]) -> Column:
    """Name of the channel with the largest mean; the first wins ties, ``unknown`` without any."""
    best = F.greatest(*[units(m, TIE) for m in means])
    out = F.when(best.isNull(), "unknown")
    for m, name in means.items():
        out = out.when(units(m, TIE) == best, name)
    return out


def cluster_statistics(rows: DataFrame, keys: Sequence[str], p: str, channels: dict[str, str] = CHANNELS) -> DataFrame:
    """One row per cluster of labelled voxels (columns ``cid``, ``dist``, ``edema``)."""
    by = [*keys, "pct", "cid"]
    means = {f"mean_{c}": name for c, name in channels.items()}
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size_voxels"),
        exact_mean(p).alias("mean_prob"),
        F.max(p).alias("max_prob"),
        F.min("dist").alias("min_dist_mm"),
        F.bool_or("edema").alias("in_edema"),
        F.bool_or(~F.col("edema")).alias("in_ring"),
        *[exact_mean(c).alias(f"mean_{c}") for c in channels],
    )
    return out.withColumn("dominant_class", dominant_channel(means))


def percentile_of_score(order: ValueTable, queries: DataFrame, query: str) -> DataFrame:
    """``queries`` with ``pct_rank``: mean of the strict and weak percentile rank of each queried value in the order."""
    keys, p = order.keys, order.value
    asked = queries.select(*keys, F.col(query).alias(p)).distinct()
    zeros = {n: F.lit(0).cast(order.rows.schema[n].dataType) for n in order.names}
    table = running(order, asked.withColumns({**zeros, "_asked": F.lit(True)})).where("_asked")
    both = F.when(F.col("n") > 0, 1).otherwise(0)
    rank = 50.0 * (2 * F.col("n_before") + F.col("n") + both) / F.col("n_total")
    table = table.select(*keys, F.col(p).alias(query), rank.alias("pct_rank"))
    return queries.join(table, [*keys, query])


def labelled_hotspots(
    region: DataFrame, core: DataFrame | None, cuts: DataFrame, keys: Sequence[str], grid: Grid, spacing: tuple[float, float, float], p: str, connectivity: int = 18
) -> DataFrame:
    """The region voxels at or above each percentile's threshold, with component and distance to the core."""
    keys = list(keys)
    levels = cuts.groupBy(*keys).agg(F.collect_list(F.struct("pct", "threshold")).alias("_cuts"))
    above = F.filter("_cuts", lambda c: F.col(p) >= c["threshold"])
    hot = cut_lineage(attach(region, levels, keys).select(*region.columns, F.inline(above)))
    parts = connected_components(hot, [*keys, "pct"], grid, connectivity).select(*keys, "pct", "flat_idx", "cid")
    hot = hot.join(parts, [*keys, "pct", "flat_idx"])
    if core is None:
        return hot.withColumn("dist", F.lit(None).cast("double"))
    dist = euclidean_distance(hot, core, keys, spacing)
    return hot.join(dist, [*keys, *AXES], "left")


def detect_clusters(
    region: DataFrame,
    core: DataFrame | None,
    keys: Sequence[str],
    grid: Grid,
    spacing: tuple[float, float, float],
    p: str = "p",
    percentiles: Sequence[int] = PERCENTILES,
    min_voxels: int = MIN_CLUSTER_VOXELS,
    min_dist_mm: float = MIN_CORE_DISTANCE_MM,
    alpha: float = 0.05,
) -> DataFrame:
    """Clusters that pass the size and distance filters, with statistics, corrected p and score.

    ``region`` holds the test-region voxels inside the brain with ``p``, the channel columns
    and the ``edema`` flag.  Without a core every distance counts as 0 in the score.
    """
    keys = list(keys)
    by = [*keys, "pct"]
    region = in_units(region, [p, *CHANNELS])
    order = value_order(region, keys, p)
    cuts = cut_lineage(thresholds(order, percentiles))
    clusters = cluster_statistics(labelled_hotspots(region, core, cuts, keys, grid, spacing, p), keys, p)
    near = F.col("min_dist_mm") < min_dist_mm
    clusters = clusters.where((F.col("size_voxels") >= min_voxels) & ~F.coalesce(near, F.lit(False)))
    clusters = clusters.join(cuts.drop("threshold"), by)
    z = (F.col("mean_prob") - F.col("bg_mean")) / (F.col("bg_std") / F.sqrt("size_voxels"))
    clusters = clusters.withColumns(
        {
            "z": z,
            "volume_ml": F.bround(F.col("size_voxels") * F.lit(spacing[0] * spacing[1] * spacing[2] / 1000.0), 3),
            "score": F.col("mean_prob") * F.col("size_voxels") / (F.coalesce("min_dist_mm", F.lit(0.0)) + 1.0),
        }
    )
    clusters = cut_lineage(clusters.withColumn("p_raw", tails.normal_sf(F.col("z"))))
    clusters = percentile_of_score(order, clusters, "mean_prob").withColumnRenamed("pct_rank", "pct_rank_in_test")
    return adjust_p(clusters, by, "p_raw", alpha).withColumnsRenamed({"p_bh": "p_bh_adj", "reject": "sig_fdr"})


def rank_clusters(clusters: DataFrame, keys: Sequence[str], k: int = MAX_CLUSTERS) -> DataFrame:
    """Best ``k`` clusters by score per key and percentile."""
    order = [F.desc_nulls_last("score"), F.asc("cid")]
    return top_k(clusters, [*keys, "pct"], order, k)


def overlay(rank: Column, train_pos: Column, train_neg: Column) -> Column:
    """Hotspot rank over training positives (4) over training negatives (5)."""
    return F.coalesce(rank, F.when(train_pos, 4), F.when(train_neg, 5), F.lit(0)).cast("int")


# ---- coherence and phenotype ---------------------------------------------------------------


def coherence(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Mean pairwise correlation of the series of each group, and the mean normalised series.

    With z the normalised rows, the sum over pairs of z_i.z_j is (|sum z|^2 - sum |z|^2) / 2,
    so no pair of voxels is ever formed and a group of any size is a plain aggregate.
    """
    z = df.withColumn("_z", TS.zscore_flat(F.col(ts)))
    z = z.withColumn("_zz", A.squares(F.col("_z"), F.lit(0.0)))
    out = z.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), A.vector_sum(F.col("_z")).alias("_s"), F.sum("_zz").alias("_q"), F.max(F.size("_z")).alias("_t")
    )
    n, t = F.col("n"), F.col("_t")
    r = (A.squares(F.col("_s"), F.lit(0.0)) - F.col("_q")) / (t * n * (n - 1))
    mean = F.transform("_s", lambda v: v / F.col("n"))
    return out.select(*keys, "n", F.when((n >= 2) & (t >= 3), r).alias("r_intra"), mean.alias("mean_ts"))


def component_sizes(labels: DataFrame, keys: Sequence[str], grid: Grid, min_mm3: float = MIN_SIGNIFICANT_MM3) -> DataFrame:
    """Voxels, volume and significance of each component."""
    out = labels.groupBy(*keys, "cid").agg(F.count(F.lit(1)).alias("n_voxels"))
    out = out.withColumn("volume_mm3", F.col("n_voxels") * grid.voxel_volume())
    return out.withColumn("significant", F.col("volume_mm3") >= min_mm3)


def component_summary(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, total, largest component and the volumes in descending order."""
    largest = F.max(F.struct(F.col("n_voxels"), (-F.col("cid")).alias("c")))
    out = sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_components"),
        F.count_if("significant").alias("n_significant"),
        F.sum("volume_mm3").alias("total_mm3"),
        F.max("volume_mm3").alias("_max"),
        (-largest["c"]).alias("largest_cid"),
        F.sort_array(F.collect_list(F.bround("volume_mm3", 1)), False).alias("volumes_mm3"),
    )
    return out.withColumn("largest_fraction", F.col("_max") / F.col("total_mm3")).drop("_max")


def phenotype_of(n_components: Column, n_significant: Column, sphericity: Column, r_intra: Column) -> Column:
    many = (n_significant >= 2) & (sphericity.isNull() | (sphericity < MULTIFOCAL_SPHERICITY))
    dense = (sphericity.isNull() | (sphericity >= COMPACT_SPHERICITY)) & (r_intra.isNull() | (r_intra >= INTRA_COHERENT))
    return (
        F.when(F.coalesce(n_components, F.lit(0)) == 0, "empty")
        .when(n_significant == 0, "subthreshold")
        .when(many, "multifocal")
        .when((n_significant >= 1) & dense, "compact")
        .otherwise("diffuse")
    )


def phenotype(
    subjects: DataFrame, hotspot: DataFrame, series: DataFrame, keys: Sequence[str], grid: Grid, min_mm3: float = MIN_SIGNIFICANT_MM3
) -> DataFrame:
    """Phenotype of each subject's hotspot from its components and their series.

    ``hotspot`` lists voxels, ``series`` the stored series by ``flat_idx``.
    """
    keys = list(keys)
    labels = cut_lineage(connected_components(hotspot, keys, grid, 26))
    sizes = component_sizes(labels, keys, grid, min_mm3)
    summary = cut_lineage(component_summary(sizes, keys))
    biggest = labels.join(summary.select(*keys, F.col("largest_cid").alias("cid")), [*keys, "cid"], "left_semi")
    shape = surface_area(biggest, keys, grid).select(*keys, "sphericity")

    members = labels.join(sizes.where("significant").select(*keys, "cid"), [*keys, "cid"], "left_semi")
    members = members.select(*keys, "cid", "flat_idx").join(series.select(*keys, "flat_idx", "ts"), [*keys, "flat_idx"])
    within = cut_lineage(coherence(members, [*keys, "cid"]))
    intra = within.groupBy(*keys).agg(
        F.when(F.count("r_intra") == F.count(F.lit(1)), F.avg("r_intra")).alias("r_intra_mean"), F.sum("n").alias("n_voxels_used")
    )
    inter = coherence(within, keys, "mean_ts").select(*keys, F.col("r_intra").alias("r_inter_mean"))
    out = subjects.select(*keys).distinct()
    for part in (summary, shape, intra, inter):
        out = out.join(part, keys, "left")
    found = F.col("n_voxels_used").isNotNull()
    kind = phenotype_of(F.col("n_components"), F.col("n_significant"), F.col("sphericity"), F.col("r_intra_mean"))
    kind = F.when((F.col("n_significant") > 0) & ~found, "empty").otherwise(kind)
    rounded = {c: F.bround(c, 4) for c in ("r_intra_mean", "r_inter_mean", "largest_fraction", "sphericity")}
    out = out.withColumn("phenotype", kind).withColumns(rounded).withColumn("total_mm3", F.bround("total_mm3", 1))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_components", "n_significant", "n_voxels_used", "total_mm3")})
