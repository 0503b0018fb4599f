"""Readers for voxel, series, mask, map and metric tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators import masks as M, spatial as S
from ..operators.columns import with_stats, zmap
from ..operators.grid import AXES
from ..operators.ranking import value_prefix
from ..session import cut_lineage

# Stored series per source name, and the branch names.
SERIES_FILES = {
    "in_t1": "BOLD_inT1",
    "brain_in_t1": "BOLD_brain_inT1",
    "brain_in_t1_spatial": "BOLD_brain_inT1_spatial_smooth",
    "brain_in_t1_spatiotemporal": "BOLD_brain_inT1_spatiotemporal_smooth",
    "preprocessed": "BOLD_brain_inT1_spatiotemporal_smooth",
    "spatiotemporal": "BOLD_brain_inT1_spatiotemporal_smooth",
    "st_preprocessed": "BOLD_brain_inT1_spatiotemporal_smooth",
}
BRANCHES = ["nomcst", "mcst"]
METADATA_SUFFIXES = [".json", ".bval", ".bvec"]
TISSUE_ORDER = ["necrosis", "enhancing", "enhancing_plus_necrosis"]
METRIC_FIELDS = ["val_auc_mean", "val_auc_std", "val_ap_mean", "val_ap_std", "val_brier_mean", "val_brier_std"]


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail early when a table lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def series_path(root: Column, source: Column, folder: Column | None = None, branch: Column | None = None) -> Column:
    """Storage path of a series: explicit folder, else a named branch, else the default folder."""
    files = F.create_map(*[F.lit(v) for pair in SERIES_FILES.items() for v in pair])
    name = F.element_at(files, source)
    base = F.concat(root, F.lit("/PREPROCESSING/bold"))
    if branch is not None:
        known = F.lower(F.trim(branch))
        base = F.when(known.isin(BRANCHES), F.concat(base, F.lit("/branch_"), known)).otherwise(base)
    if folder is not None:
        base = F.coalesce(F.nullif(F.trim(folder), F.lit("")), base)
    return F.concat(base, F.lit("/"), name)


def brain_series(series: DataFrame, brain: DataFrame, keys: Sequence[str], value: str = "mask") -> DataFrame:
    """Series of the voxels inside the brain mask (value above 0)."""
    require(series, [*keys, "flat_idx", "ts"])
    inside = require(brain, [*keys, "flat_idx", value]).where(F.col(value) > 0)
    return series.join(inside.select(*keys, "flat_idx"), [*keys, "flat_idx"], "left_semi")


def segmentation_masks(df: DataFrame, keys: Sequence[str], seg: str, erosion: int = 1, healthy: Column | None = None, csf: Column | None = None) -> DataFrame:
    """Region flags and eroded seeds of each tumour part."""
    keys = list(keys)
    df = M.region_flags(df, seg, healthy, csf)
    seeds = {f"seed_{part}": F.col(part) for part in ("necro", "enh", "edema")}
    if erosion <= 0:
        return df.withColumns(seeds)
    df = cut_lineage(df)
    if erosion == 1:
        return S.with_words(df, S.eroded_words(S.line_words(df, keys, seeds), keys, list(seeds), 6), keys, list(seeds))
    out = df
    for name, part in seeds.items():
        seed = S.erode(df.where(part), keys, erosion).select(*keys, *AXES, F.lit(True).alias("_s"))
        out = out.join(seed, [*keys, *AXES], "left").withColumn(name, M.is_true(F.col("_s"))).drop("_s")
    return out


def optional_labels(voxels: DataFrame, labels: DataFrame | None, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Labels by voxel; NULL for a whole key without a label table, 0 for its missing voxels."""
    keys = list(keys)
    if labels is None:
        return voxels.withColumn(out, F.lit(None).cast("int"))
    have = labels.select(*keys).distinct().withColumn("_have", F.lit(True))
    rows = labels.select(*keys, "flat_idx", F.col(value).alias("_v"))
    joined = voxels.join(have, keys, "left").join(rows, [*keys, "flat_idx"], "left")
    return joined.withColumn(out, F.when(F.col("_have"), F.coalesce("_v", F.lit(0)))).drop("_have", "_v")


def first_available(df: DataFrame, keys: Sequence[str], candidates: Sequence[str], out: str) -> DataFrame:
    """The first candidate column that has any value for the key, taken whole."""
    df = with_stats(df, keys, [F.bool_or(F.col(c).isNotNull()).alias(f"_has_{c}") for c in candidates])
    pick = F.coalesce(*[F.when(F.col(f"_has_{c}"), F.struct(F.col(c).alias("v"))) for c in candidates])
    return df.withColumn(out, pick["v"]).drop(*[f"_has_{c}" for c in candidates])


def structural_contrast(df: DataFrame, keys: Sequence[str], candidates: Sequence[str], out: str) -> DataFrame:
    """First stored contrast as a z-map over the brain; NULL where a key has none."""
    df = first_available(df, keys, candidates, "_contrast")
    return zmap(df, keys, "_contrast", F.col("brain"), out).drop("_contrast")


def mask_ladder(df: DataFrame, keys: Sequence[str], candidates: Sequence[str], fallback: str | None, out: str) -> DataFrame:
    """First stored mask of a key as booleans, else the fallback column, else NULL."""
    df = first_available(df, keys, candidates, "_mask")
    last = F.col(fallback) if fallback else F.lit(None).cast("boolean")
    return df.withColumn(out, F.coalesce(F.col("_mask") > 0, last)).drop("_mask")


def run_maps(maps: DataFrame, brain: DataFrame, keys: Sequence[str], run: str = "run", p: str = "p") -> DataFrame:
    """Maps of all runs; a run whose voxel count differs from the grid becomes NULL as a whole."""
    keys = list(keys)
    size = brain.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    length = maps.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("_len"))
    ok = length.join(size, keys).select(*keys, run, (F.col("_len") == F.col("_size")).alias("complete"))
    out = maps.join(ok, [*keys, run])
    return out.withColumn(p, F.when(F.col("complete"), F.col(p)))


def patient_info(subjects: DataFrame, info: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Stored patient fields with defaults for absent ones."""
    out = subjects.join(info, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def read_run_metrics(spark: SparkSession, json_path: str, csv_path: str) -> DataFrame:
    """Run metrics from JSON, else from the first CSV row of the run, by tissue priority."""
    fields = ", ".join(f"{c} double" for c in METRIC_FIELDS)
    js = spark.read.schema(f"run_name string, positive string, classifier string, {fields}").json(json_path)
    csv = spark.read.schema(f"run_name string, row_no int, {fields}").csv(csv_path, header=True)
    first = csv.groupBy("run_name").agg(F.min(F.struct("row_no", *METRIC_FIELDS)).alias("c"))
    both = js.join(first, "run_name", "full")
    known = F.col("positive").isNotNull() | F.col("classifier").isNotNull() | F.col("c").isNull()
    out = both.select(
        "run_name",
        F.coalesce("positive", "run_name").alias("positive"),
        F.coalesce("classifier", F.lit("unknown")).alias("classifier"),
        *[F.when(known, F.col(m)).otherwise(F.col(f"c.{m}")).alias(m) for m in METRIC_FIELDS],
    )
    rank = F.coalesce(F.array_position(F.lit(TISSUE_ORDER), F.col("positive")), F.lit(0))
    return out.withColumn("priority", F.when(rank > 0, rank - 1).otherwise(999))


def concat_parts(parts: DataFrame, keys: Sequence[str], part: str, t: str, value: str) -> DataFrame:
    """Parts joined on the time axis: each part starts where the ones before it end; 32-bit values."""
    keys = list(keys)
    lengths = parts.groupBy(*keys, part).agg((F.max(t) + 1).alias("_n"))
    starts = value_prefix(lengths, keys, part, {"_f": F.sum("_n")}).select(*keys, part, F.col("_f_before").alias("_start"))
    out = parts.join(starts, [*keys, part])
    return out.withColumn(t, (F.col(t) + F.col("_start")).cast("long")).withColumn(value, F.col(value).cast("float")).drop("_start")


def series_groups(files: DataFrame, size: int = 50, name: str = "name") -> DataFrame:
    """Series numbers that have exactly ``size`` files."""
    number = F.regexp_extract(name, r"MR\D*(\d{4,})", 1)
    groups = files.withColumn("series", number).where("series <> ''").groupBy("series")
    return groups.agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") == size)


def file_chunks(files: DataFrame, size: int, skip: Sequence[str] = METADATA_SUFFIXES, name: str = "name") -> DataFrame:
    """Distinct data files in name order, cut into groups of ``size``."""
    keep = F.lit(True)
    for s in skip:
        keep = keep & ~F.lower(F.col(name)).endswith(s)
    kept = files.where(keep).select(name).distinct()
    return global_positions(kept, name).withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))


def global_positions(df: DataFrame, column: str) -> DataFrame:
    """0-based position of each row in the order of ``column`` (values are distinct).

    Rows are range-partitioned, sorted inside their partition and written once, so their
    numbers stay fixed; only one count per partition is accumulated.
    """
    numbered = df.repartitionByRange(column).sortWithinPartitions(column)
    numbered = cut_lineage(numbered.withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    out = numbered.withColumn("_part", part).join(offsets, "_part")
    return out.withColumn("pos", F.col("_start") + row).drop("_part", "_id", "_start")
