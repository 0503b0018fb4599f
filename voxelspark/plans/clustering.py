"""Unsupervised and seed-guided voxel clustering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import series as TS
from ..operators import columns as C, keyed as K, masks as M, spatial as S
from ..operators.grid import AXES, Grid, scaled_coordinates
from ..session import cut_lineage

CLASSES = ["gm", "wm", "necro", "enh", "edema"]


def feature_columns(df: DataFrame, tr: float = 1.8) -> DataFrame:
    """The ten relative features of each voxel as ``f_*`` columns."""
    rows = df.withColumn("_f", TS.features_b(F.col("ts"), tr))
    return rows.select(*[c for c in df.columns if c != "ts"], *[F.col(f"_f.{c}").alias(f"f_{c}") for c in TS.FEATURES_B])


def reduce_and_cluster(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], k: int, algo: str, seed: int, restarts: int, clip: float, pca_cap: int
) -> DataFrame:
    """Clip, drop the constant columns of each key, project and cluster; every step takes all keys at once."""
    df = cut_lineage(C.robust_clip(df, keys, cols, clip) if clip > 0 else df)
    table = cut_lineage(K.projections(df, keys, cols, pca_cap))
    rows = cut_lineage(K.projected(df, keys, cols, table, "_z"))
    ident = [a for a in AXES if a in df.columns] or list(cols)
    out = K.cluster_keys(rows, keys, "_z", ident, k, algo, seed, restarts)
    return out.select(*df.columns, *[F.get("_z", F.lit(i)).alias(f"pc{i + 1}") for i in range(min(pca_cap, len(cols)))], "cluster")


def bold_clustering(
    df: DataFrame, keys: Sequence[str], grid: Grid, k: int = 4, algo: str = "gmm", seed: int = 42, restarts: int = 1,
    clip: float = 6.0, coord_weight: float = 0.2, pca_cap: int = 10,
) -> DataFrame:
    """Clusters from series features and weighted coordinates; adds ``cluster`` and ``pc*``."""
    feats = [f"f_{c}" for c in TS.FEATURES_B]
    rows = C.standardise(cut_lineage(feature_columns(df)), keys, feats)
    cols = list(feats)
    if coord_weight > 0:
        rows = rows.select("*", *scaled_coordinates(grid, coord_weight))
        cols += [f"{a}_norm" for a in AXES]
    return reduce_and_cluster(rows, cols, keys, k, algo, seed, restarts, clip, pca_cap)


def multimodal_clustering(
    df: DataFrame, keys: Sequence[str], grid: Grid, maps: Sequence[str], k: int = 4, algo: str = "gmm", seed: int = 42,
    restarts: int = 1, clip: float = 6.0, coord_weight: float = 0.2, pca_cap: int = 10,
) -> DataFrame:
    """Like ``bold_clustering`` with normalised structural maps; needs a ``brain`` flag."""
    feats = [f"f_{c}" for c in TS.FEATURES_B]
    rows = cut_lineage(feature_columns(df))
    for m in maps:
        rows = C.zmap(rows, keys, m, F.col("brain"), f"z_{m}")
    cols = [*feats, *[f"z_{m}" for m in maps]]
    rows = C.standardise(cut_lineage(rows), keys, cols).select("*", *scaled_coordinates(grid, coord_weight))
    cols += [f"{a}_norm" for a in AXES]
    return reduce_and_cluster(rows, cols, keys, k, algo, seed, restarts, clip, pca_cap)


def seed_table(df: DataFrame, keys: Sequence[str], erosion: int, threshold: float = 0.7) -> DataFrame:
    """Seed class per voxel from partial volumes and region flags."""
    base = F.col("healthy") & ~F.col("tumor")
    df = df.withColumns({t: M.is_true(F.col(f"{t}_pve") >= threshold) & base for t in ("gm", "wm")})
    df = cut_lineage(df)
    eroded = {c: S.erode(df.where(c), keys, erosion) for c in CLASSES}
    return M.guided_seeds(df, keys, eroded, CLASSES)


def guided_seeds(df: DataFrame, keys: list[str], erosion: int) -> DataFrame:
    """``seed_table``; keys with fewer than two seed classes are tried again without erosion, then refused."""
    rows = cut_lineage(seed_table(df, keys, erosion))

    def poor(table: DataFrame) -> DataFrame:
        return table.groupBy(*keys).agg(F.count_distinct("seed_class").alias("_c")).where("_c < 2").select(*keys)

    again = cut_lineage(poor(rows))
    if again.isEmpty():
        return rows
    if erosion > 0:
        second = cut_lineage(seed_table(df.join(again, keys, "left_semi"), keys, 0))
        rows = cut_lineage(rows.join(again, keys, "left_anti").unionByName(second))
    left = poor(rows).limit(5).collect()
    if left:
        raise ValueError(f"fewer than two seed classes for {[tuple(r) for r in left]}")
    return rows


def guided_clustering(
    df: DataFrame, keys: Sequence[str], grid: Grid, maps: Sequence[str] = (), erosion: int = 1, clip: float = 6.0, pca_cap: int = 10,
    outside_steps: int = 2,
) -> DataFrame:
    """Tissue class probabilities from eroded seeds by multinomial regression, one model per key.

    ``df`` has series, region flags (``masks.region_flags``) and partial volumes. Clipping, the variance filter,
    scaling and the projection are fitted on the seed voxels, in this order, and applied to all.
    """
    keys = list(keys)
    rows = feature_columns(guided_seeds(df, keys, erosion))
    for m in maps:
        rows = C.zmap(rows, keys, m, F.col("brain"), f"z_{m}")
    dist = S.signed_distance(rows.where("brain"), rows.where("tumor"), keys, grid, 0.25)
    rows = cut_lineage(rows.where("brain AND NOT csf").join(dist, [*keys, *AXES], "left"))
    cols = [*[f"f_{c}" for c in TS.FEATURES_B], *[f"z_{m}" for m in maps], "signed_dist"]
    rows = rows.fillna(0.0, ["signed_dist"])
    trained = F.col("seed_class").isNotNull()
    rows = cut_lineage(C.robust_clip(rows, keys, cols, clip, fit=trained) if clip > 0 else rows)
    near = S.dilate(rows.where("tumor"), keys, max(1, outside_steps)).withColumn("_near", F.lit(True))

    seeds = cut_lineage(rows.where(trained))
    table = cut_lineage(K.projections(seeds, keys, cols, pca_cap, scale=True))
    seeds = K.projected(seeds, keys, cols, table, "_z")
    scored = K.logistic_keys(seeds, K.projected(rows, keys, cols, table, "_z"), keys, "_z", AXES, "seed_class", len(CLASSES))
    scored = cut_lineage(scored.drop("_z")).join(near, [*keys, *AXES], "left")
    probs = C.suppress_outside(F.col("probs"), F.col("_near").isNull(), [CLASSES.index(c) for c in ("necro", "enh", "edema")])
    scored = scored.withColumn("probs", probs).drop("_near")
    return scored.withColumns(
        {"class_label": C.argmax_label(F.col("probs")), "p_healthy": F.get("probs", F.lit(0)) + F.get("probs", F.lit(1))}
    )


MODES: dict[str, Callable[..., DataFrame]] = {
    "bold": bold_clustering,
    "multi": multimodal_clustering,
    "guided": guided_clustering,
    "guided_iter": guided_clustering,
    "guided_iterative": guided_clustering,
}


def cluster(mode: str | None, *args, **options) -> DataFrame:
    """Clustering by mode name in any case; without one, by series."""
    name = (mode or "bold").lower().strip()
    if name not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(MODES)}")
    return MODES[name](*args, **options)
