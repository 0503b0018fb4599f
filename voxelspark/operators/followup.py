"""Progression of enhancement over follow-up visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .masks import is_true


def new_enhancement(df: DataFrame, keys: Sequence[str], baseline: int, visit: str = "visit") -> DataFrame:
    """Follow-up rows with ``is_new``: enhancing now but not at the baseline visit."""
    keys = list(keys)
    at_start = df.where((F.col(visit) == baseline) & F.col("enh")).select(*keys, "flat_idx", F.lit(True).alias("_was"))
    later = df.where(F.col(visit) > baseline).join(at_start, [*keys, "flat_idx"], "left")
    return later.withColumn("is_new", F.col("enh") & ~is_true(F.col("_was"))).drop("_was")


def progression(df: DataFrame, hotspot: DataFrame, keys: Sequence[str], baseline: int, visit: str = "visit") -> DataFrame:
    """Counts, fractions and overlap of new enhancement with the hotspot, per visit.

    ``df`` has one row per visit and voxel with the ``enh`` flag; ``hotspot`` lists voxels.
    """
    keys = list(keys)
    rows = new_enhancement(df, keys, baseline, visit)
    marks = hotspot.select(*keys, "flat_idx", F.lit(True).alias("_hot"))
    size = hotspot.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hotspot"))
    rows = rows.where("enh").join(marks, [*keys, "flat_idx"], "left")
    counts = rows.groupBy(*keys, visit).agg(
        F.count(F.lit(1)).alias("n_enh"),
        F.count_if("is_new").alias("n_new"),
        F.count_if(F.col("is_new") & is_true(F.col("_hot"))).alias("overlap"),
    )
    visits = df.where(F.col(visit) > baseline).groupBy(*keys, visit).agg(F.count(F.lit(1)).alias("_n"))
    out = visits.join(counts, [*keys, visit], "left").join(size, keys, "left").drop("_n")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_enh", "n_new", "overlap", "n_hotspot")})
    comparable = (F.col("n_new") > 0) & (F.col("n_hotspot") > 0)
    return out.withColumns(
        {
            "fraction_new": F.bround(F.col("n_new") / F.nullif("n_enh", F.lit(0)), 4),
            "fraction_predicted": F.when(comparable, F.bround(F.col("overlap") / F.col("n_new"), 4)),
            "dice": F.when(comparable, F.bround(2 * F.col("overlap") / (F.col("n_new") + F.col("n_hotspot")), 4)),
        }
    )
