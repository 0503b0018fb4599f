"""Registered queries: readers, writers, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import masks as M, sampling as P
from ..session import checkpoint_dir, cut_lineage
from ..sources import sinks, tables as T
from ..operators import hotspot as H
from .hotspots import _clusters, _hq
from .morphology import KEYS, TUMOUR
from .registry import query
from .scoring import _METRICS, _metric_rows
from .splits import _POOL, pools
from .voxels import _SEG4, _vm, _vq, masks_table

V = "patient:i flat_idx:i"


def _folder(spark, name: str) -> str:
    """A fresh folder beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s1_brain_series",
    "patient:i flat_idx:i first_value:d6 n_frames:i",
    fx.with_views("SELECT patient, flat_idx, ts[1] AS first_value, len(ts) AS n_frames FROM series WHERE label<7", "series"),
)
def brain_series(spark, sf):
    s = fx.series(spark, sf)
    brain = s.select("patient", "flat_idx", F.expr("CAST(label < 7 AS INT)").alias("mask"))
    return T.brain_series(s, brain, KEYS).select("patient", "flat_idx", F.col("ts")[0].alias("first_value"), F.size("ts").alias("n_frames"))


_SRC = "['in_t1','brain_in_t1','brain_in_t1_spatial','brain_in_t1_spatiotemporal','preprocessed','spatiotemporal','st_preprocessed']"
_FILE = "['BOLD_inT1','BOLD_brain_inT1','BOLD_brain_inT1_spatial_smooth'] || list_transform([1,2,3,4], lambda i: 'BOLD_brain_inT1_spatiotemporal_smooth')"


@query(
    "s2_series_path",
    "c_custkey:i path",
    f"SELECT c_custkey, CASE WHEN c_nationkey%5=0 THEN '/other/dir' WHEN c_nationkey%3=0 THEN c_name||'/PREPROCESSING/bold/branch_nomcst' ELSE c_name||'/PREPROCESSING/bold' END || '/' || ({_FILE})[c_custkey%7+1] AS path FROM customer",
)
def series_path(spark, sf):
    """Stored series of every request: folder, then branch, then default; seven names for four files."""
    c = fx.table(spark, sf, "customer")
    source = F.element_at(F.lit(list(T.SERIES_FILES)), (F.col("c_custkey") % 7 + 1).cast("int"))
    folder = F.expr("CASE WHEN c_nationkey%5=0 THEN '/other/dir' ELSE ' ' END")
    branch = F.expr("CASE WHEN c_nationkey%3=0 THEN ' NoMCST ' WHEN c_nationkey%2=0 THEN 'unknown' END")
    return c.select("c_custkey", T.series_path(F.col("c_name"), source, folder, branch).alias("path"))


_ER = {
    p: f"SELECT a.patient, a.flat_idx FROM vm a JOIN vm b ON a.patient=b.patient AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)<=1 WHERE a.seg_a={k} AND a.brain AND b.seg_a={k} AND b.brain GROUP BY 1,2 HAVING COUNT(*)=7"
    for p, k in (("necro", 1), ("edema", 2), ("enh", 3))
}


@_vq(
    "s3_segmentation_masks",
    f"{V} necro:b enh:b edema:b tumor:b healthy:b csf:b seed_necro:b seed_enh:b seed_edema:b",
    "SELECT v.patient, v.flat_idx, s=1 AND brain AS necro, s=3 AND brain AS enh, s=2 AND brain AS edema, s IN (1,2,3) AND brain AS tumor, s=4 AND brain AS csf, "
    "brain AND NOT (s IN (1,2,3)) AND s<>4 AS healthy, "
    + ", ".join(f"EXISTS (SELECT 1 FROM er_{p} e WHERE e.patient=v.patient AND e.flat_idx=v.flat_idx) AS seed_{p}" for p in _ER)
    + f" FROM (SELECT *, {_SEG4} AS s FROM vm) v",
    **{f"er_{p}": q for p, q in _ER.items()},
)
def segmentation_masks(spark, sf):
    return T.segmentation_masks(_vm(spark, sf).withColumn("s", F.expr(_SEG4)), KEYS, "s")


@_vq(
    "s4_optional_parcellation",
    f"{V} label:i",
    "SELECT patient, flat_idx, CASE WHEN patient%2=0 THEN CASE WHEN n>1 THEN parc ELSE 0 END END AS label FROM vm",
)
def optional_parcellation(spark, sf):
    """Every second patient has a parcellation, and it misses some voxels."""
    vm = _vm(spark, sf)
    return T.optional_labels(vm.drop("parc"), vm.where("patient % 2 = 0 AND n > 1"), KEYS, "parc", "label")


_CAND = {"c1": "CASE WHEN patient%3=0 THEN p_nec*10 END", "c2": "CASE WHEN patient%3<2 THEN p_enh*7 END"}
_C = {"cd": f"SELECT *, CASE WHEN patient%3=0 THEN {_CAND['c1']} ELSE {_CAND['c2']} END AS c FROM vm"}


@_vq(
    "s5_structural_contrast",
    f"{V} z:d6",
    "SELECT patient, flat_idx, (c-AVG(CASE WHEN brain THEN c END) OVER w)/(stddev_pop(CASE WHEN brain THEN c END) OVER w+1e-6) AS z FROM cd WINDOW w AS (PARTITION BY patient)",
    **_C,
)
def structural_contrast(spark, sf):
    df = _vm(spark, sf).withColumns({n: F.expr(e) for n, e in _CAND.items()})
    return T.structural_contrast(df, KEYS, ["c1", "c2"], "z")


@_vq(
    "s6_tissue_maps",
    f"{V} gm_pve:d6 wm_pve:d6 parenchyma:b brain_healthy:b csf:b",
    "SELECT patient, flat_idx, g AS gm_pve, w AS wm_pve, g+w>=0.3 AS parenchyma, COALESCE(CASE WHEN patient%2=0 THEN brain END, g+w>=0.3) AS brain_healthy, "
    "COALESCE(CASE WHEN patient%3=0 THEN n>4 END, p_mix>=0.5) AS csf FROM (SELECT *, LEAST(1.0, GREATEST(0.0, p_nec*2-0.5)) AS g, LEAST(1.0, GREATEST(0.0, p_enh*2-1.0)) AS w FROM vm)",
)
def tissue_maps(spark, sf):
    df = _vm(spark, sf).withColumns(
        {
            "gm_pve": F.expr("p_nec*2-0.5D"),
            "wm_pve": F.expr("p_enh*2-1.0D"),
            "csf_pve": F.col("p_mix"),
            "brain_healthy": F.expr("CASE WHEN patient%2=0 THEN brain END"),
            "csf_given": F.expr("CASE WHEN patient%3=0 THEN n>4 END"),
        }
    )
    return M.tissue_table(df)


_RUNS = (
    "SELECT clf||'_'||fold AS run_name, CASE clf WHEN 'rf' THEN 'necrosis' WHEN 'svm' THEN 'enhancing' ELSE 'other' END AS positive, clf, fold, val_auc FROM met"
)


@query(
    "s7_run_metrics",
    "run_name positive classifier val_auc_mean:d6 val_auc_std:d6 priority:i",
    fx.with_views(
        "SELECT run_name, CASE WHEN fold<2 THEN positive ELSE run_name END AS positive, CASE WHEN fold<2 THEN clf ELSE 'unknown' END AS classifier, val_auc AS val_auc_mean, "
        "CASE WHEN fold<2 THEN NULL ELSE 0.5 END AS val_auc_std, CASE WHEN fold<2 AND clf='rf' THEN 0 WHEN fold<2 AND clf='svm' THEN 1 ELSE 999 END AS priority FROM rn",
        "scored",
        extra={**_METRICS, "rn": _RUNS},
    ),
)
def run_metrics(spark, sf):
    """Metrics stored as JSON for some runs and as CSV for all, read back with the JSON first."""
    kind = F.expr("CASE clf WHEN 'rf' THEN 'necrosis' WHEN 'svm' THEN 'enhancing' ELSE 'other' END")
    runs = _metric_rows(spark, sf).select(F.concat_ws("_", "clf", "fold").alias("run_name"), kind.alias("positive"), F.col("clf").alias("classifier"), "fold", "val_auc")
    runs, path = cut_lineage(runs), _folder(spark, "metrics")
    named = runs.withColumnRenamed("val_auc", "val_auc_mean")
    named.where("fold < 2").drop("fold").write.json(f"{path}/json")
    rows = named.select("run_name", F.explode(F.lit([0, 1])).alias("row_no"), (F.col("val_auc_mean") + F.col("row_no")).alias("val_auc_mean"), F.lit(0.5).alias("val_auc_std"))
    rows = rows.select("run_name", "row_no", *[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in T.METRIC_FIELDS])
    rows.write.option("header", True).csv(f"{path}/csv")
    return T.read_run_metrics(spark, f"{path}/json", f"{path}/csv")


_PARTS = "SELECT patient, voxel, t//10 AS part, t%10 AS t, value FROM events_long"


@query(
    "s8_time_concat",
    "patient:i voxel:i t:i value:d4",
    fx.with_views(
        "SELECT patient, voxel, t+start AS t, CAST(value AS FLOAT) AS value FROM pt JOIN (SELECT patient, part, COALESCE(SUM(n) OVER (PARTITION BY patient ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start "
        "FROM (SELECT patient, part, MAX(t)+1 AS n FROM pt GROUP BY 1,2)) USING (patient, part)",
        "events_long",
        extra={"pt": _PARTS},
    ),
)
def time_concat(spark, sf):
    parts = fx.events_long(spark, sf).selectExpr("patient", "voxel", "t div 10 AS part", "t % 10 AS t", "value")
    return T.concat_parts(parts, KEYS, "part", "t", "value")


@query(
    "s9_series_groups",
    "series n_files:i",
    fx.with_views(r"SELECT regexp_extract(name, 'MR\D*(\d{4,})', 1) AS series, COUNT(*) AS n_files FROM files WHERE name LIKE '%.dcm' GROUP BY 1 HAVING COUNT(*)=52", "files"),
)
def series_groups(spark, sf):
    """Series with exactly 52 image files."""
    return T.series_groups(fx.files(spark, sf).where("name LIKE '%.dcm'"), 52)


@query(
    "s10_file_chunks",
    "name pos:i chunk:i",
    fx.with_views("SELECT name, r AS pos, r//50 AS chunk FROM (SELECT name, ROW_NUMBER() OVER (ORDER BY name)-1 AS r FROM (SELECT DISTINCT name FROM files WHERE name NOT LIKE '%.json'))", "files"),
)
def file_chunks(spark, sf):
    files = fx.files(spark, sf)
    return T.file_chunks(files.unionByName(files), 50)


@_vq("s11_map_sink", "patient:i fold:i n:i total:d4", "SELECT patient, 0 AS fold, COUNT(*) AS n, SUM(p) AS total FROM vm GROUP BY 1")
def map_sink(spark, sf):
    """Probability, mask and label maps written by patient and fold and read back."""
    path = _folder(spark, "maps")
    maps = masks_table(spark, sf).select("patient", F.lit(0).alias("fold"), "flat_idx", "p", "core", F.col("seg_a").alias("label"))
    sinks.write_partitioned(maps, path, ["patient", "fold"])
    return spark.read.parquet(path).groupBy("patient", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


@query(
    "s12_run_summary",
    "trial patient fold_id val_auc notes n_cols:i",
    fx.with_views(
        "SELECT 't1' AS trial, clf AS patient, CAST(fold AS VARCHAR) AS fold_id, CAST(ROUND(val_auc*1000) AS BIGINT)||'.5' AS val_auc, '' AS notes, 32 AS n_cols FROM auc",
        "scored",
        extra=_METRICS,
    ),
)
def run_summary(spark, sf):
    """One summary row per fold, appended in two batches to the fixed columns."""
    path = _folder(spark, "summary")
    auc = F.concat(F.round(F.col("val_auc") * 1000).cast("long").cast("string"), F.lit(".5"))
    rows = _metric_rows(spark, sf).select(F.lit("t1").alias("trial"), F.col("clf").alias("patient"), F.col("fold").alias("fold_id"), auc.alias("val_auc"), F.lit("x").alias("unused"))
    rows = cut_lineage(rows)
    for part in ("fold_id < 2", "fold_id >= 2"):
        sinks.append_summary(rows.where(part), path)
    back = sinks.read_summary(spark, path)
    return back.select("trial", "patient", "fold_id", "val_auc", F.col("run_dir").alias("notes"), F.lit(len(back.columns)).alias("n_cols"))


@_vq(
    "s13_cluster_outputs",
    "patient:i label:i n:i",
    f"SELECT patient, CASE WHEN {TUMOUR} THEN flat_idx%4+1 ELSE 0 END AS label, COUNT(*) AS n FROM vm GROUP BY 1,2",
)
def cluster_outputs(spark, sf):
    """Label map written beside a one-row settings table that is appended to."""
    path = _folder(spark, "clusters")
    labels = cut_lineage(_vm(spark, sf).select("patient", "flat_idx", F.expr(f"CASE WHEN {TUMOUR} THEN flat_idx%4+1 ELSE 0 END").alias("label")))
    sinks.write_partitioned(labels, f"{path}/labels", ["patient"])
    settings = labels.groupBy("patient").agg(F.count(F.lit(1)).alias("n_vox"), F.lit("bold").alias("mode"))
    settings.write.mode("append").parquet(f"{path}/settings")
    return spark.read.parquet(f"{path}/labels").groupBy("patient", "label").agg(F.count(F.lit(1)).alias("n"))


@_hq("s14_ranking_files", "patient:i pct:i rank_:i size_voxels:i", f"SELECT * FROM rk WHERE rank_<={H.MAX_CLUSTERS}")
def ranking_files(spark, sf):
    """Rankings as CSV and counts as JSON per percentile, read back."""
    path = _folder(spark, "ranking")
    ranked = cut_lineage(H.rank_clusters(_clusters(spark, sf), KEYS).select("patient", "pct", "rank", "cid", "size_voxels", "score"))
    counts = ranked.groupBy("patient", "pct").agg(F.count(F.lit(1)).alias("n_clusters"))
    sinks.write_ranking(ranked, counts, path)
    back = spark.read.option("header", True).csv(f"{path}/ranking")
    return back.withColumnRenamed("rank", "rank_")


@query(
    "s15_split_cache_keys",
    "c_custkey:i split_key",
    "SELECT MIN(c_custkey) AS c_custkey, split_key FROM (SELECT c_custkey, c_nationkey, sha1('{\"block_mm\":'||CAST(c_nationkey AS VARCHAR)||'.5,\"mode\":\"grid_block\",\"seed\":'||CAST(c_custkey%10 AS VARCHAR)||',\"segment\":\"'||c_mktsegment||'\"}') AS split_key FROM customer) "
    "GROUP BY split_key HAVING SUM(CASE WHEN c_custkey%4=0 THEN 1 ELSE 0 END)=0",
)
def split_cache_keys(spark, sf):
    """Content keys of all split definitions that are not stored yet."""
    spec = fx.table(spark, sf, "customer").withColumn(
        "split_key",
        sinks.split_key(
            {
                "mode": F.lit("grid_block"),
                "seed": F.col("c_custkey") % 10,
                "segment": F.col("c_mktsegment"),
                "block_mm": F.col("c_nationkey") + F.lit(0.5),
            }
        ),
    )
    wanted = spec.groupBy("split_key").agg(F.min("c_custkey").alias("c_custkey"))
    return sinks.missing_splits(wanted, spec.where("c_custkey % 4 = 0"))


@query(
    "s15_split_cache",
    "patient:i target:i n:i source",
    fx.with_views(
        "SELECT p.patient, target, LEAST(30, np, nn) AS n, source FROM (SELECT DISTINCT patient, target FROM pool) p JOIN (SELECT patient, COUNT(CASE WHEN target=1 THEN 1 END) AS np, "
        "COUNT(CASE WHEN target=0 THEN 1 END) AS nn FROM pool GROUP BY 1) c ON c.patient=p.patient, (SELECT unnest(['fresh','cached']) AS source)",
        "vm",
        extra=_POOL,
    ),
)
def split_cache(spark, sf):
    """A split computed once and loaded the second time."""
    path = _folder(spark, "splits")
    df = pools(spark, sf)
    first = sinks.cached_split(spark, path, "k1", lambda: P.balanced(df, KEYS, 30, 42))
    again = sinks.cached_split(spark, path, "k1", lambda: df.where("false"))
    both = first.withColumn("source", F.lit("fresh")).unionByName(again.withColumn("source", F.lit("cached")))
    return both.groupBy("patient", "target", "source").agg(F.count(F.lit(1)).alias("n"))


@_vq(
    "s17_label_audit",
    "patient:i n_voxels:i labels_ok:b label_0:i label_1:i label_2:i label_3:i enough_voxels:b shape_match:b",
    "SELECT patient, COUNT(*) AS n_voxels, bool_and(l IN (0,1,2,3)) AS labels_ok, COUNT(CASE WHEN l=0 THEN 1 END) AS label_0, COUNT(CASE WHEN l=1 THEN 1 END) AS label_1, COUNT(CASE WHEN l=2 THEN 1 END) AS label_2, "
    "COUNT(CASE WHEN l=3 THEN 1 END) AS label_3, COUNT(CASE WHEN l=1 THEN 1 END)>=50 AND COUNT(CASE WHEN l=2 THEN 1 END)>=50 AND COUNT(CASE WHEN l=3 THEN 1 END)>=50 AS enough_voxels, COUNT(*)=4000 AS shape_match "
    "FROM (SELECT patient, CASE WHEN patient%3=1 AND n>9 THEN 7 WHEN n=1 THEN 1 ELSE seg_a END AS l FROM vm) GROUP BY 1",
)
def label_audit(spark, sf):
    vm = _vm(spark, sf)
    expected = vm.select("patient").distinct().withColumn("n_expected", F.lit(fx.NX * fx.NY * fx.NZ))
    labels = vm.withColumn("l", F.expr("CASE WHEN patient%3=1 AND n>9 THEN 7 WHEN n=1 THEN 1 ELSE seg_a END"))
    return sinks.label_audit(labels, KEYS, "l", expected)


@_vq(
    "s18_mask_ladder",
    f"{V} region:b core_stored:b",
    "SELECT patient, flat_idx, CASE patient%3 WHEN 0 THEN n>3 WHEN 1 THEN n>5 ELSE seg_a=2 END AS region, CASE WHEN patient%2=0 THEN seg_a=1 END AS core_stored FROM vm",
)
def mask_ladder(spark, sf):
    """First stored test region, else edema; first stored core, else none."""
    df = _vm(spark, sf).withColumns(
        {
            "m1": F.expr("CASE WHEN patient%3=0 THEN CAST(n>3 AS INT) END"),
            "m2": F.expr("CASE WHEN patient%3<2 THEN CAST(n>5 AS INT) END"),
            "k1": F.expr("CASE WHEN patient%2=0 THEN CAST(seg_a=1 AS INT) END"),
            "edema": F.expr("seg_a=2"),
        }
    )
    df = T.mask_ladder(df, KEYS, ["m1", "m2"], "edema", "region")
    return T.mask_ladder(df, KEYS, ["k1"], None, "core_stored")


@_vq(
    "s19_run_maps",
    "patient:i run n:i p_sum:d4 age:i",
    "SELECT patient, run, COUNT(*) AS n, SUM(CASE WHEN run='run_002' AND patient%2=1 THEN NULL ELSE p END) AS p_sum, CASE WHEN patient%2=0 THEN 50+patient ELSE -1 END AS age FROM "
    "(SELECT patient, 'run_001' AS run, p_nec AS p FROM vm UNION ALL SELECT patient, 'run_002', p_enh FROM vm WHERE patient%2=0 OR flat_idx%2=0) GROUP BY 1,2",
)
def run_maps(spark, sf):
    """Maps of all runs; incomplete ones are NULL, patient fields have defaults."""
    vm = _vm(spark, sf)
    maps = vm.select("patient", "flat_idx", F.lit("run_001").alias("run"), F.col("p_nec").alias("p")).unionByName(
        vm.where("patient%2=0 OR flat_idx%2=0").select("patient", "flat_idx", F.lit("run_002").alias("run"), F.col("p_enh").alias("p"))
    )
    sums = T.run_maps(maps, vm, KEYS).groupBy("patient", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum"))
    info = vm.where("patient % 2 = 0").select("patient", (F.col("patient") + 50).alias("age")).distinct()
    return T.patient_info(sums, info, KEYS, {"age": -1})
