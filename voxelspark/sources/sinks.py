"""Writers and audits: maps, labels, summaries, rankings, split cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns of the run summary, in order.
SUMMARY_HEADER = [
    "trial", "patient", "representation", "method", "fold_id", "fold_seed", "bold_branch", "bold_source",
    "sampling_raw", "sampling_mode_requested", "sampling_mode_effective", "split_source", "n_per_class", "holdout_frac",
    "patch_half_width", "grid_block_mm", "grid_buffer_mm", "n_train_samples", "n_val_samples", "val_auc", "val_ap",
    "val_bal_acc@0p5", "val_brier", "val_mean_prob_pos", "val_mean_prob_neg", "edema_n_voxels", "edema_mean_prob",
    "edema_std_prob", "edema_pct_tumor_like_0.5", "edema_pct_healthy_like_0.5", "created_at", "run_dir",
]
ALLOWED_LABELS = [0, 1, 2, 3]
MIN_VOXELS_PER_LABEL = 50


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet with one folder per value of ``by``.

    The rows of a folder meet first, so the number of files follows the folders, not folders times tasks. Adaptive
    execution splits a large folder over several tasks.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def summary_rows(df: DataFrame) -> DataFrame:
    """The fixed summary columns as text: missing ones empty, extra ones dropped."""
    picks = []
    for c in SUMMARY_HEADER:
        value = F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")
        picks.append(F.coalesce(value, F.lit("")).alias(c))
    return df.select(*picks)


def append_summary(df: DataFrame, path: str) -> None:
    summary_rows(df).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in SUMMARY_HEADER)
    return spark.read.schema(schema).option("header", True).csv(path).fillna("")


def write_ranking(ranking: DataFrame, counts: DataFrame, path: str) -> None:
    """Ranking tables as CSV and cluster counts as JSON, one folder per percentile."""
    ranking.write.mode("overwrite").partitionBy("pct").option("header", True).csv(f"{path}/ranking")
    counts.write.mode("overwrite").partitionBy("pct").json(f"{path}/summary")


def split_key(fields: dict[str, Column]) -> Column:
    """SHA-1 of the canonical JSON (sorted keys, no blanks) of a split definition."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha1(F.to_json(ordered, {"ignoreNullFields": "false"}))


def missing_splits(wanted: DataFrame, stored: DataFrame, key: str = "split_key") -> DataFrame:
    """Definitions that have no stored split yet."""
    return wanted.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def cached_split(spark: SparkSession, path: str, key: str, compute) -> DataFrame:
    """Load the stored split of ``key``, else compute and store it."""
    folder, done = f"{path}/split_key={key}", f"{path}_done/split_key={key}"
    try:
        spark.read.parquet(done)  # written last, so a broken attempt is computed again
    except AnalysisException:
        compute().write.mode("overwrite").parquet(folder)
        spark.range(1).write.mode("overwrite").parquet(done)
    return spark.read.parquet(folder)


def label_audit(df: DataFrame, keys: Sequence[str], label: str, expected: DataFrame | None = None) -> DataFrame:
    """Per key: voxel count of each label, whether all labels are known and frequent enough.

    With ``expected`` (keys and ``n_expected``) the voxel total is compared as well.
    """
    lab = F.col(label)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.bool_and(lab.isin(ALLOWED_LABELS)).alias("labels_ok"),
        *[F.count_if(lab == v).alias(f"label_{v}") for v in ALLOWED_LABELS],
    )
    enough = F.lit(True)
    for v in ALLOWED_LABELS[1:]:
        enough = enough & (F.col(f"label_{v}") >= MIN_VOXELS_PER_LABEL)
    out = out.withColumn("enough_voxels", enough)
    if expected is None:
        return out
    out = out.join(expected, list(keys), "left")
    return out.withColumn("shape_match", F.coalesce(F.col("n_voxels") == F.col("n_expected"), F.lit(False)))
