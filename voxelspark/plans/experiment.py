"""A full supervised analysis of a cohort: masks, folds, classifiers, maps, metrics, hotspots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import columns as C, evaluation as E, forests as FR, hotspot as H, keyed as K, masks as M, sampling as P
from ..operators.grid import AXES, Grid
from ..session import cut_lineage


CLASSIFIERS = {"rf": "p_rf", "svm": "p_svm", "lr": "p_lr"}
TASK_VOXELS = 100_000  # of a volume whose models a single task fits and applies
TASK_KEYS = 8  # such volumes a task, about, where there are more of them than ``SPREAD``
SPREAD = 200


@dataclass(frozen=True)
class Fits:
    """How the models of a key and fold are fitted."""

    trees: int = 500
    seed: int = 42
    depth: int | None = None
    scale: bool = True
    svm_folds: int = 3


def _splits(
    pools: DataFrame, keys: list[str], grid: Grid, spacing: Sequence[float], folds: int, seed: int, n_per_class: int | None, block_mm: float, buffer_mm: float, gm_fraction: float | None
) -> DataFrame:
    """Training and validation voxels of every key and fold."""
    by = [*keys, "fold"]
    split = P.adaptive_split(
        P.with_folds(pools, folds, seed), by, grid, spacing, block_mm, buffer_mm, F.col("fold_seed"), n_per_class=n_per_class, gm_fraction=gm_fraction, copies="fold"
    )
    return cut_lineage(split.where("role IS NOT NULL").select(*by, "flat_idx", "role", "target"))


def _shares(voxels: DataFrame, split: DataFrame, keys: list[str], grid: Grid, features: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None, int]:
    """``split`` of the keys that one task fits and applies, of the others, and the number of the former (None: no such key)."""
    dims = (grid.nx, grid.ny, grid.nz)
    fixed = not any(isinstance(v, str) for v in dims)  # sizes may be columns
    if not keys or (fixed and np.prod(dims) > TASK_VOXELS):
        return None, split, 0
    rows = split.groupBy(*keys, "fold").agg(F.count_if(F.col("role") == "train").alias("_n"))
    sizes = rows.groupBy(*keys).agg((F.max("_n") * len(features) <= FR.BOX_CELLS).alias("_few"))
    if not fixed:
        held = voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
        sizes = sizes.join(held, keys).select(*keys, (F.col("_few") & (F.col("_v") <= TASK_VOXELS)).alias("_few"))
    sizes = cut_lineage(sizes)
    facts = sizes.agg(F.count_if("_few").alias("few"), F.count_if(~F.col("_few")).alias("many")).first()
    if not facts["many"]:
        return split, None, facts["few"]
    if not facts["few"]:
        return None, split, 0
    return split.join(sizes.where("_few"), keys, "left_semi"), split.join(sizes.where("NOT _few"), keys, "left_semi"), facts["few"]


def _fitted(x: np.ndarray, at: np.ndarray, y: np.ndarray, dealt: np.ndarray, fits: Fits) -> np.ndarray:
    """(3, rows): class-1 probabilities of all rows ``x`` by the classifiers trained on the rows ``at``."""
    own = x[at]
    if fits.scale:
        known = ~np.isnan(own)
        n = np.maximum(known.sum(0), 1)
        mean = np.where(known, own, 0.0).sum(0) / n
        sd = np.sqrt((np.where(known, own - mean, 0.0) ** 2).sum(0) / n)
        least, most = np.where(known, own, np.inf).min(0), np.where(known, own, -np.inf).max(0)
        flat = ~(most > least)  # the mean of equal values may differ from them in its last digit
        mean, sd = np.where(flat & known.any(0), least, mean), np.where(flat | ~(sd > 0), 1.0, sd)
        x = (x - mean) / sd
        own = x[at]
    return np.stack([
        FR.whole_forest(own, y, x, fits.trees, fits.seed, fits.depth), K.whole_svm(own, y, dealt, x, fits.svm_folds), K.whole_logistic(own, y, x)
    ])


def _few_rows(voxels: DataFrame, features: Sequence[str], split: DataFrame, keys: list[str], n: int, fits: Fits, ensemble: bool) -> DataFrame:
    """Keys of few rows: a key's voxels and its splits meet in one task, which fits and applies the models of all folds.

    The result is that of ``_many_rows``, or with ``ensemble`` one row per voxel: mean, deviation and number of the folds'
    probabilities of each classifier.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*split.schema.fields, *voxels.schema.fields]}
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    left = voxels.where(F.lit(n > 0)).select(*keys, *AXES, "flat_idx", *x)
    dealt = F.xxhash64(F.lit("calibration"), "flat_idx").alias("_c")  # the order of rows and their folds are those of ``keyed``
    right = split.select(*keys, "fold", F.col("flat_idx").alias("_i"), "role", "target", F.xxhash64("flat_idx").alias("_h"), dealt)
    width, named = len(features), list(CLASSIFIERS.values())
    # Voxels of keys without a split come too, so there are at least as many tasks as in any shuffle.
    size = max(int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(FR.TASKS, max(min(n, SPREAD), n // TASK_KEYS)))
    head = [*keys, "flat_idx"] if ensemble else [*keys, *AXES, "flat_idx"]
    heads = ", ".join(f"{c} {kinds[c]}" for c in head)
    if ensemble:
        schema = f"{heads}, " + ", ".join(f"{c}_mean double, {c}_std double, {c}_n long" for c in named)
    else:
        schema = f"{heads}, fold {kinds['fold']}, role string, target {kinds['target']}, " + ", ".join(f"{c} double" for c in named)

    def fitted(voxel: pa.Table, chosen: pa.Table) -> pa.Table:
        values = np.stack([voxel[f"_x{i}"].to_numpy() for i in range(width)], 1) if voxel.num_rows else np.zeros((0, width))
        index = voxel["flat_idx"].to_numpy()
        order = index.argsort()
        chosen = chosen.sort_by([("fold", "ascending"), ("_h", "ascending")])
        fold, i = chosen["fold"].to_numpy(), chosen["_i"].to_numpy()
        at = order[np.minimum(np.searchsorted(index, i, sorter=order), max(len(index) - 1, 0))] if len(index) else i[:0]
        role, target, c = (chosen[v].to_numpy(zero_copy_only=False) for v in ("role", "target", "_c"))
        here = index[at] == i if len(index) else np.zeros(len(i), bool)
        made, scores = [], []
        for f in np.unique(fold):
            train = np.flatnonzero((fold == f) & here & (role == "train"))
            if len(train):
                p = _fitted(values, at[train], target[train].astype(float), c[train], fits)
                if ensemble:
                    scores.append(p)
                else:
                    used = np.flatnonzero((fold == f) & here)
                    label, part = np.full(len(index), -1), np.full(len(index), -1)
                    label[at[used]], part[at[used]] = target[used], role[used] == "val"
                    columns = [pa.array(np.full(len(index), f), pa.int32()), pa.array(["train", "val"]).take(pa.array(part, mask=part < 0)), pa.array(label, pa.int32(), mask=label < 0)]
                    made.append(pa.table([*(voxel[v] for v in head), *columns, *(pa.array(v, from_pandas=True) for v in p)], names=arrow.names))
        if scores:
            every = np.stack(scores)
            known = ~np.isnan(every)
            count = known.sum(0)
            with np.errstate(invalid="ignore"):
                mean = np.where(known, every, 0.0).sum(0) / count
                std = np.sqrt(np.where(known, (every - mean) ** 2, 0.0).sum(0) / count)
            columns = [pa.array(v[k], from_pandas=True) for k in range(len(named)) for v in (mean, std, count)]
            made.append(pa.table([*(voxel[v] for v in head), *columns], names=arrow.names))
        return pa.concat_tables([t.cast(arrow) for t in made]) if made else arrow.empty_table()

    arrow = to_arrow_schema(voxels.sparkSession.createDataFrame([], schema).schema)
    pair = left.repartition(size, *keys).groupBy(*keys).cogroup(right.repartition(size, *keys).groupBy(*keys))
    return pair.applyInArrow(fitted, schema)


def _many_rows(voxels: DataFrame, features: Sequence[str], split: DataFrame, keys: list[str], fits: Fits) -> DataFrame:
    """keys, fold, voxel, role, target and each classifier's probability; rows of a key are spread over tasks."""
    by = [*keys, "fold"]
    listed = split.select(*by).distinct()
    rows = voxels.join(listed, keys) if keys else voxels.crossJoin(F.broadcast(listed))
    rows = cut_lineage(rows.join(split, [*by, "flat_idx"], "left"))
    if fits.scale:
        rows = C.standardise(rows, by, features, fit=F.col("role") == "train")
    rows = cut_lineage(rows.select(*by, *AXES, "flat_idx", "role", "target", F.array(*[F.col(c).cast("double") for c in features]).alias("_x")))
    train, ident = cut_lineage(rows.where("role = 'train'")), ["flat_idx"]
    probs = FR.forest_keys(train, rows, by, "_x", ident, "target", fits.trees, fits.seed, fits.depth, out="p_rf")
    probs = cut_lineage(K.svm_keys(train, probs, by, "_x", ident, "target", fits.svm_folds, out="p_svm"))
    probs = K.logistic_keys(K.balanced_weight(train, by, "target"), probs, by, "_x", ident, "target", 2, weight="weight", binary=True)
    return cut_lineage(probs.withColumn("p_lr", F.get("probs", F.lit(1))).drop("probs", "_x"))


def fold_probabilities(
    voxels: DataFrame, features: Sequence[str], pools: DataFrame, keys: Sequence[str], grid: Grid, spacing: Sequence[float],
    folds: int = 3, seed: int = 42, n_per_class: int | None = 20000, trees: int = 500, depth: int | None = None,
    block_mm: float = 18.0, buffer_mm: float = 4.0, scale: bool = True, svm_folds: int = 3, gm_fraction: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Probability maps and validation scores (long, one row per classifier) of every key and fold.

    Every key and fold is a model of its own, so a patient's maps do not depend on the others; the splits, scalings and
    models of all of them are made together. Keys that cannot be split have no maps.
    """
    keys = list(keys)
    by, fits = [*keys, "fold"], Fits(trees, seed, depth, scale, svm_folds)
    split = _splits(pools, keys, grid, spacing, folds, seed, n_per_class, block_mm, buffer_mm, gm_fraction)
    few, many, n = _shares(voxels, split, keys, grid, features)
    parts = [] if few is None else [cut_lineage(_few_rows(voxels, features, few, keys, n, fits, ensemble=False))]
    probs = reduce(DataFrame.unionByName, parts + ([] if many is None else [_many_rows(voxels, features, many, keys, fits)]))
    val = E.unpivot(probs.where("role = 'val'"), [*by, "flat_idx", "target"], CLASSIFIERS)
    return cut_lineage(E.unpivot(probs, [*by, *AXES, "flat_idx"], CLASSIFIERS, value="p")), cut_lineage(val)


def ensemble_maps(
    voxels: DataFrame, features: Sequence[str], pools: DataFrame, keys: Sequence[str], grid: Grid, spacing: Sequence[float],
    folds: int = 3, seed: int = 42, n_per_class: int | None = 20000, trees: int = 500, depth: int | None = None,
    block_mm: float = 18.0, buffer_mm: float = 4.0, scale: bool = True, svm_folds: int = 3, gm_fraction: float | None = None,
) -> DataFrame:
    """``evaluation.ensemble`` of the maps of ``fold_probabilities``, without writing the folds' maps of keys of few rows."""
    keys, fits = list(keys), Fits(trees, seed, depth, scale, svm_folds)
    split = _splits(pools, keys, grid, spacing, folds, seed, n_per_class, block_mm, buffer_mm, gm_fraction)
    few, many, n = _shares(voxels, split, keys, grid, features)
    parts = []
    if few is not None:
        wide = _few_rows(voxels, features, few, keys, n, fits, ensemble=True)
        rows = [F.struct(F.lit(k).alias("clf"), F.col(f"{c}_mean").alias("p_mean"), F.col(f"{c}_std").alias("p_std"), F.col(f"{c}_n").alias("n_folds")) for k, c in CLASSIFIERS.items()]
        parts.append(wide.select(*keys, "flat_idx", F.inline(F.array(*rows))).select(*keys, "clf", "flat_idx", "p_mean", "p_std", "n_folds"))
    if many is not None:
        maps = E.unpivot(_many_rows(voxels, features, many, keys, fits), [*keys, "flat_idx"], CLASSIFIERS, value="p")
        parts.append(E.ensemble(maps, [*keys, "clf", "flat_idx"]))
    return reduce(DataFrame.unionByName, parts)


def comparison_report(maps: DataFrame, scores: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Per key: fold metrics, tests, pooled curves and ensemble maps from the long tables."""
    keys = list(keys)
    metrics = cut_lineage(E.validation_metrics(scores, [*keys, "clf", "fold"], "target", "score"))
    wide = scores.groupBy(*keys, "fold", "flat_idx", "target").agg(
        *[F.max(F.when(F.col("clf") == c, F.col("score"))).alias(c) for c in ("rf", "svm", "lr")]
    )
    pooled = E.delong(cut_lineage(wide), keys, {c: c for c in ("rf", "svm", "lr")}, E.CLASSIFIER_PAIRS, "target")
    return {
        "metrics": metrics,
        "tests": E.metric_tests(E.metric_pairs(metrics, keys), keys),
        "delong": E.adjust_p(cut_lineage(E.with_normal_p(pooled)), keys, "p_two_sided"),
        "calibration": E.calibration_bins(scores, [*keys, "clf"], "target", "score"),
        "decision_curve": E.decision_curve(scores, [*keys, "clf"], "target", "score"),
        "ensemble": E.ensemble(maps, [*keys, "clf", *AXES, "flat_idx"]),
    }


def hotspots_of_ensemble(
    ensemble: DataFrame, masks: DataFrame, keys: Sequence[str], grid: Grid, spacing: tuple[float, float, float], clf: str = "rf", **limits
) -> DataFrame:
    """Ranked hotspots of the ensemble map inside the test region."""
    keys = list(keys)
    p = ensemble.where(F.col("clf") == clf).select(*keys, "flat_idx", F.col("p_mean").alias("p"))
    channels = [c for c in H.CHANNELS if c in masks.columns]
    columns = [*keys, *AXES, "flat_idx", "edema", "core", "test_region", *channels]
    rows = cut_lineage(masks.select(*columns).join(p, [*keys, "flat_idx"]))
    clusters = H.detect_clusters(rows.where("test_region"), rows.where("core"), keys, grid, spacing, **limits)
    return H.rank_clusters(clusters, keys)


def training_pools(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Core voxels against healthy training voxels with their tissue flags."""
    out = masks.where("core OR healthy_train").withColumn("target", F.col("core").cast("int"))
    tissues = [c for c in ("gm", "wm") if c in masks.columns]
    return out.select(*keys, *AXES, "flat_idx", "target", *tissues)


def analysis_masks(voxels: DataFrame, keys: Sequence[str], positive: str = "enhancing_plus_necrosis", **options) -> DataFrame:
    return M.train_masks(M.region_flags(voxels, "seg"), keys, positive, **options)


def supervised_hotspots(
    voxels: DataFrame, features: Sequence[str], pools: DataFrame, masks: DataFrame, keys: Sequence[str], grid: Grid, spacing: tuple[float, float, float],
    clf: str = "rf", min_voxels: int = H.MIN_CLUSTER_VOXELS, min_dist_mm: float = H.MIN_CORE_DISTANCE_MM, **options,
) -> tuple[DataFrame, DataFrame]:
    """Fold models, their ensemble maps, and the ranked hotspots of one classifier's map."""
    ensemble = cut_lineage(ensemble_maps(voxels, features, pools, keys, grid, spacing, **options))
    return ensemble, hotspots_of_ensemble(ensemble, masks, keys, grid, spacing, clf, min_voxels=min_voxels, min_dist_mm=min_dist_mm)


DETECTORS = {"probability": supervised_hotspots}


def detector(name: str):
    """Hotspot detector by name in any case."""
    key = name.lower().strip()
    if key not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {sorted(DETECTORS)}")
    return DETECTORS[key]
