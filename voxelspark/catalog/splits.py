"""Registered queries: seeded samples and spatial splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import grid as G, ranking as R, sampling as P
from ..session import cut_lineage
from .morphology import GRID, KEYS, SPACING
from .registry import query
from .timeseries import _VQ, auto_labels
from .voxels import _TM, masks_table

_POOL = {
    **_TM,
    "pool": "SELECT patient, flat_idx, x, y, z, CASE WHEN core THEN 1 ELSE 0 END AS target, healthy_train_gm AS gm, healthy_train_wm AS wm FROM tm WHERE core OR healthy_train",
}


def pools(spark, sf):
    """Tumour core against healthy training voxels."""
    return pools_of(masks_table(spark, sf))


def pools_of(masks):
    df = masks.where("core OR healthy_train")
    out = df.select("patient", "flat_idx", *G.AXES, F.col("core").cast("int").alias("target"), "healthy_train_gm", "healthy_train_wm")
    return cut_lineage(out.withColumnsRenamed({"healthy_train_gm": "gm", "healthy_train_wm": "wm"}))


def _sq(name: str, cols: str, body: str, **extra: str):
    return query(name, cols, fx.with_views(body, "vm", extra={**_POOL, **extra}))


def _order(by: str, seed: object = 42, ident: str = "flat_idx") -> str:
    return f"ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY md5('{seed}:'||{ident}), {ident})"


@query(
    "k5_seeded_choice",
    "fold:i id:i",
    fx.with_views(f"SELECT fold, id FROM (SELECT *, {_order('fold', 7, 'id')} AS r FROM scored) WHERE r<=500", "scored"),
)
def seeded_choice(spark, sf):
    """500 samples per fold by seeded hash."""
    return R.choose(fx.scored(spark, sf), ["fold"], "id", 500, 7)


@query(
    "k3_stable_order",
    "patient:i flat_idx:i pos:i",
    fx.with_views("SELECT patient, flat_idx, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY flat_idx)-1 AS pos FROM vm WHERE brain", "vm"),
)
def stable_order(spark, sf):
    """Position of each voxel in index order within its patient."""
    vm = fx.vox_mask(spark, sf).where("brain").select("patient", "flat_idx")
    return R.value_prefix(vm, KEYS, "flat_idx", {"n": F.count(F.lit(1))}).withColumn("pos", F.col("n_before"))


_N = "COUNT(CASE WHEN target=1 THEN 1 END) OVER (PARTITION BY {k}) AS np, COUNT(CASE WHEN target=0 THEN 1 END) OVER (PARTITION BY {k}) AS nn"


@_sq(
    "t1_balanced_sample",
    "patient:i flat_idx:i target:i",
    f"SELECT * FROM (SELECT *, {_N.format(k='patient')}, {_order('patient, target')} AS r FROM pool) WHERE r<=LEAST(60, np, nn)",
)
def balanced(spark, sf):
    return P.balanced(pools(spark, sf), KEYS, 60, 42)


@_sq(
    "t1_balanced_sample_all",
    "patient:i flat_idx:i target:i",
    f"SELECT * FROM (SELECT *, {_N.format(k='patient')}, {_order('patient, target')} AS r FROM pool) WHERE r<=LEAST(np, nn)",
)
def balanced_all(spark, sf):
    return P.balanced(pools(spark, sf), KEYS, None, 42)


_STRAT = {
    "ng": "SELECT *, CASE WHEN gm AND NOT wm THEN 'gm' WHEN wm AND NOT gm THEN 'wm' END AS kind FROM pool WHERE target=0",
    "nk": "SELECT patient, COUNT(CASE WHEN kind='gm' THEN 1 END) AS g, COUNT(CASE WHEN kind='wm' THEN 1 END) AS w, CAST(FLOOR({n}) AS BIGINT) AS n FROM ng GROUP BY 1",
    "nq": "SELECT *, LEAST(tg, g) AS pg, LEAST(n-tg, w) AS pw FROM (SELECT *, CAST(round_even(n*(1.0::DOUBLE/3.0::DOUBLE), 0) AS BIGINT) AS tg FROM nk)",
    "nr": "SELECT patient, CASE WHEN w-pw>=n-pg-pw THEN pg WHEN g-pg>=n-pg-pw THEN n-pw END AS qg, CASE WHEN w-pw>=n-pg-pw THEN n-pg WHEN g-pg>=n-pg-pw THEN pw END AS qw FROM nq",
}
_STRAT_BODY = (
    f"SELECT patient, flat_idx, kind FROM (SELECT ng.*, qg, qw, {_order('ng.patient, kind', 42, 'ng.flat_idx')} AS r FROM ng JOIN nr ON nr.patient=ng.patient WHERE kind IS NOT NULL) "
    "WHERE r<=CASE WHEN kind='gm' THEN qg ELSE qw END"
)


def _stratified(spark, sf, n):
    neg = pools(spark, sf).where("target = 0")
    sizes = neg.groupBy("patient").agg(F.count_if("gm").alias("g"), F.count_if("wm").alias("w"))
    neg = neg.join(sizes.select("patient", F.floor(F.expr(n)).alias("n")), "patient")
    return P.stratified_negatives(neg, KEYS, "n", 42).withColumn("kind", F.when(F.col("gm"), "gm").otherwise("wm"))


def _strat_sql(n: str) -> dict[str, str]:
    own = n.replace("g", "COUNT(CASE WHEN kind='gm' THEN 1 END)").replace("w", "COUNT(CASE WHEN kind='wm' THEN 1 END)")
    return {k: v.replace("{n}", own) for k, v in _STRAT.items()}


@_sq("t2_stratified_negatives", "patient:i flat_idx:i kind", _STRAT_BODY, **_strat_sql("(g+w)/5"))
def stratified(spark, sf):
    """A third of the negatives from grey matter."""
    return _stratified(spark, sf, "(g+w)/5")


@_sq("t2_stratified_backfill", "patient:i flat_idx:i kind", _STRAT_BODY, **_strat_sql("(g+w)*9/10"))
def stratified_backfill(spark, sf):
    """More than white matter can give, so grey matter fills the gap."""
    return _stratified(spark, sf, "(g+w)*9/10")


_FOLDS = {"pf": "SELECT pool.*, fold, 42+fold AS fold_seed FROM pool, (SELECT unnest(generate_series(0, 2)) AS fold)"}


@_sq(
    "t3_voxel_random",
    "patient:i fold:i flat_idx:i target:i role",
    "SELECT *, 'train' AS role FROM (SELECT *, "
    + _N.format(k="patient, fold")
    + ", ROW_NUMBER() OVER (PARTITION BY patient, fold, target ORDER BY md5(fold_seed||':'||flat_idx), flat_idx) AS r FROM pf) WHERE r<=LEAST(50, np, nn)",
    **_FOLDS,
)
def voxel_random(spark, sf):
    folds = P.with_folds(pools(spark, sf), 3)
    return P.voxel_random(folds, ["patient", "fold"], 50, F.col("fold_seed"))


@_sq("t8_fold_seeds", "patient:i fold:i fold_seed:i n:i", "SELECT patient, fold, fold_seed, COUNT(*) AS n FROM pf GROUP BY 1,2,3", **_FOLDS)
def fold_seeds(spark, sf):
    return P.with_folds(pools(spark, sf), 3).groupBy("patient", "fold", "fold_seed").agg(F.count(F.lit(1)).alias("n"))


def _finish_sql(role_table: str, keys: str, n: int, seed: str) -> dict[str, str]:
    pool = lambda r, t: f"COUNT(CASE WHEN role='{r}' AND target={t} THEN 1 END)"
    return {
        "fs": f"SELECT {keys}, {pool('train', 1)} AS t1, {pool('train', 0)} AS t0, {pool('val', 1)} AS v1, {pool('val', 0)} AS v0 FROM {role_table} GROUP BY {keys}",
        "sp": f"SELECT * FROM (SELECT rl.*, t1, t0, v1, v0, ROW_NUMBER() OVER (PARTITION BY {keys}, role, target ORDER BY md5({seed}||':'||flat_idx), flat_idx) AS r FROM {role_table} rl "
        f"JOIN fs USING ({keys}) WHERE role IS NOT NULL AND t1>0 AND t0>0 AND v1>0 AND v0>0) WHERE r<=CASE WHEN role='train' THEN LEAST({n}, t1, t0) ELSE LEAST(v1, v0) END",
    }


_GB = {
    **_FOLDS,
    "pc": "SELECT *, (x//4)*100000000+(y//4)*10000+z//3 AS cell, x%4>=1 AND x%4<3 AND y%4>=1 AND y%4<3 AS inn FROM pf",
    "cc": "SELECT patient, fold, fold_seed, cell FROM pc GROUP BY 1,2,3,4 HAVING COUNT(DISTINCT target)=2",
    "vc": "SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY patient, fold) AS c, ROW_NUMBER() OVER (PARTITION BY patient, fold ORDER BY md5(fold_seed||':'||cell), cell) AS cr FROM cc) "
    "WHERE c>=2 AND cr<=LEAST(GREATEST(1, round_even(c*0.25::DOUBLE, 0)), c-1)",
    "rl": "SELECT pc.*, CASE WHEN vc.cell IS NULL THEN 'train' WHEN inn THEN 'val' END AS role FROM pc LEFT JOIN vc ON vc.patient=pc.patient AND vc.fold=pc.fold AND vc.cell=pc.cell",
    **_finish_sql("rl", "patient, fold", 40, "fold_seed"),
}


def _blocked(spark, sf):
    folds = P.with_folds(pools(spark, sf), 3)
    return P.grid_block(folds, ["patient", "fold"], SPACING, 8.0, 2.0, F.col("fold_seed"), 0.25, 40)


@_sq("t4_grid_block_split", "patient:i fold:i flat_idx:i target:i role", "SELECT * FROM sp", **_GB)
def grid_block(spark, sf):
    """Validation cells of 8 mm with a 2 mm buffer, three independent folds."""
    return _blocked(spark, sf)


@_sq(
    "s16_split_audit",
    "patient:i fold:i role target:i n:i first_idx:i last_idx:i",
    "SELECT patient, fold, role, target, COUNT(*) AS n, MIN(flat_idx) AS first_idx, MAX(flat_idx) AS last_idx FROM sp GROUP BY 1,2,3,4",
    **_GB,
)
def split_audit(spark, sf):
    return P.split_audit(_blocked(spark, sf), ["patient", "fold"])


_PH = {
    "ce": "SELECT * FROM (SELECT *, " + _N.format(k="patient") + f", {_order('patient, target', '42:0')} AS r FROM pool)"
    " WHERE r<=CASE WHEN target=1 THEN GREATEST(1, round_even(np*0.1::DOUBLE, 0)) ELSE LEAST(GREATEST(1, round_even(np*0.1::DOUBLE, 0)), nn) END",
    "rl": "SELECT pool.*, CASE WHEN EXISTS (SELECT 1 FROM ce WHERE ce.patient=pool.patient AND abs(ce.x-pool.x)<=1 AND abs(ce.y-pool.y)<=1 AND abs(ce.z-pool.z)<=1) THEN 'val' ELSE 'train' END AS role FROM pool",
    **_finish_sql("rl", "patient", 50, "'42:0'"),
}


@_sq("t5_patch_holdout", "patient:i flat_idx:i target:i role", "SELECT * FROM sp", **_PH)
def patch_holdout(spark, sf):
    """Seeded cubes of both classes are held out."""
    return P.patch_holdout(pools(spark, sf), KEYS, GRID, 0.1, 1, 42, 50)


@query(
    "t6_cube_half_width",
    "p_partkey:i half_width:i",
    "SELECT p_partkey, GREATEST(1, CAST(FLOOR(GREATEST(1, round_even(CAST(p_size*0.1 AS DOUBLE)*10.0/((1.0+p_partkey%3+2.0+2.5)/3.0::DOUBLE), 0))/2) AS INT)) AS half_width FROM part",
)
def cube_half_width(spark, sf):
    part = fx.table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size*0.1 AS DOUBLE) AS cm", "1.0D+p_partkey%3 AS vx")
    return part.select("p_partkey", G.cube_half_width("cm", ("vx", 2.0, 2.5)).alias("half_width"))


def _py_steps(block: float, buffer: float):
    steps = [max(1, round(block / v)) for v in SPACING]
    return steps, [min(max(0, round(buffer / v)), max(0, s // 2 - 1)) for s, v in zip(steps, SPACING)]


def _ladder_sql(blocks, buffers) -> dict[str, str]:
    rows = []
    for b, bm in enumerate(blocks):
        for u, um in enumerate(buffers):
            s, f = _py_steps(bm, um)
            rows.append(f"({b},{u},{bm}::DOUBLE,{um}::DOUBLE,{s[0]},{s[1]},{s[2]},{f[0]},{f[1]},{f[2]})")
    return {
        "cand": f"SELECT * FROM (VALUES {', '.join(rows)}) c(b,u,block_mm,buffer_mm,sx,sy,sz,bx,by_,bz)",
        "lc": "SELECT pool.*, cand.*, (pool.x//sx)*100000000+(pool.y//sy)*10000+pool.z//sz AS cell, pool.x%sx>=bx AND pool.x%sx<sx-bx AND pool.y%sy>=by_ AND pool.y%sy<sy-by_ AND pool.z%sz>=bz AND pool.z%sz<sz-bz AS inn FROM pool, cand",
        "lcc": "SELECT patient, b, u, cell FROM lc GROUP BY 1,2,3,4 HAVING COUNT(DISTINCT target)=2",
        "lvc": "SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY patient, b, u) AS c, ROW_NUMBER() OVER (PARTITION BY patient, b, u ORDER BY md5('42:'||cell), cell) AS cr FROM lcc) WHERE c>=2 AND cr<=LEAST(GREATEST(1, round_even(c*0.1::DOUBLE, 0)), c-1)",
        "lf": "SELECT lc.patient, lc.b, lc.u, block_mm, buffer_mm FROM lc LEFT JOIN lvc ON lvc.patient=lc.patient AND lvc.b=lc.b AND lvc.u=lc.u AND lvc.cell=lc.cell GROUP BY 1,2,3,4,5 "
        + "HAVING "
        + " AND ".join(f"COUNT(CASE WHEN lvc.cell IS {c} AND target={t} THEN 1 END)>0" for c in ("NULL", "NOT NULL AND inn") for t in (0, 1)),
    }


@_sq(
    "t7_adaptive_ladder",
    "patient:i block_mm:d3 buffer_mm:d3",
    "SELECT patient, block_mm, buffer_mm FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY b, u) AS r FROM lf) WHERE r=1",
    **_ladder_sql([30.0, *P.BLOCK_MM], [6.0, *P.BUFFER_MM]),
)
def ladder(spark, sf):
    """First feasible of 36 block and buffer sizes per patient, from one grouped pass."""
    return P.grid_ladder(pools(spark, sf), KEYS, SPACING, 30.0, 6.0)


_T7 = {
    **_ladder_sql([30.0, *P.BLOCK_MM], [6.0, *P.BUFFER_MM]),
    "best": "SELECT patient, b, u, block_mm, buffer_mm FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY b, u) AS r FROM lf) WHERE r=1",
    "rl": "SELECT lc.*, CASE WHEN lvc.cell IS NULL THEN 'train' WHEN inn THEN 'val' END AS role FROM lc JOIN best USING (patient, b, u) "
    "LEFT JOIN lvc ON lvc.patient=lc.patient AND lvc.b=lc.b AND lvc.u=lc.u AND lvc.cell=lc.cell",
    **_finish_sql("rl", "patient", 40, "'42'"),
}


@_sq(
    "t7_adaptive_split",
    "patient:i mode block_mm:d3 buffer_mm:d3 role target:i n:i",
    "SELECT patient, 'grid_block' AS mode, block_mm, buffer_mm, role, target, COUNT(*) AS n FROM sp GROUP BY ALL "
    "UNION ALL SELECT patient, CASE WHEN COUNT(DISTINCT target)<2 THEN 'empty_class' ELSE 'infeasible' END, NULL, NULL, NULL, NULL, 1 FROM pool WHERE patient NOT IN (SELECT patient FROM best) GROUP BY 1",
    **_T7,
)
def adaptive_split(spark, sf):
    """The split that follows from the ladder."""
    split = P.adaptive_split(pools(spark, sf), KEYS, GRID, SPACING, 30.0, 6.0, n_per_class=40)
    return split.groupBy("patient", "mode", "block_mm", "buffer_mm", "role", "target").agg(F.count(F.lit(1)).alias("n"))


def _loo(body: str):
    return fx.with_views(body, "slong", extra=_VQ)


@query(
    "t9_leave_one_out_split",
    "patient:i n_test:i n_train:i n_train_good:i n_train_bad:i",
    _loo(
        "SELECT h.patient, MAX(h.n) AS n_test, COUNT(al.quality) AS n_train, COUNT(CASE WHEN al.quality=1 THEN 1 END) AS n_train_good, COUNT(CASE WHEN al.quality=0 THEN 1 END) AS n_train_bad "
        "FROM (SELECT patient, COUNT(*) AS n FROM al GROUP BY 1) h LEFT JOIN al ON al.patient<>h.patient AND al.quality<>-1 GROUP BY 1"
    ),
)
def leave_one_out(spark, sf):
    """Sizes of every leave-one-patient-out split without repeating a row per patient."""
    return P.leave_one_out_counts(auto_labels(spark, sf), "patient", "quality")


@query(
    "j13_leave_one_out_rows",
    "held:i patient:i flat_idx:i quality:i",
    _loo("SELECT h.held, al.patient, flat_idx, quality FROM al, (SELECT DISTINCT patient AS held FROM al) h WHERE patient<>held AND quality<>-1"),
)
def leave_one_out_rows(spark, sf):
    """Training rows of every held-out patient."""
    return P.leave_one_out_training(cut_lineage(auto_labels(spark, sf)), "patient", "quality")


_SPEC = (
    "[CASE WHEN c_nationkey%2=0 THEN 'necrosis' ELSE 'enhancing' END, 'enhancing_plus_necrosis']",
    "['ts_raw', 'bold_features', 'fft']",
    "[c_custkey%5, c_custkey%5+1]",
)


@query(
    "j15_parameter_grid",
    "c_custkey:i positive representation seed:i negative",
    f"SELECT c_custkey, positive, representation, seed, 'healthy_strict' AS negative FROM (SELECT c_custkey, unnest({_SPEC[0]}) AS positive, r FROM "
    f"(SELECT *, unnest({_SPEC[1]}) AS r FROM customer)) a(c_custkey, positive, representation) JOIN (SELECT c_custkey, unnest({_SPEC[2]}) AS seed FROM customer) USING (c_custkey)",
)
def parameter_grid(spark, sf):
    """All combinations of the list-valued settings of each experiment row."""
    spec = fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.expr("array(CASE WHEN c_nationkey%2=0 THEN 'necrosis' ELSE 'enhancing' END, 'enhancing_plus_necrosis')").alias("positive"),
        F.expr("array('ts_raw', 'bold_features', 'fft')").alias("representation"),
        F.expr("array(c_custkey%5, c_custkey%5+1)").alias("seed"),
        F.expr("array('healthy_strict')").alias("negative"),
    )
    return G.expand_lists(spec, ["positive", "representation", "seed", "negative"])
