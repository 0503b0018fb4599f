"""Registered queries: grid arithmetic, masks, joins and set operations on voxel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import columns as C, grid as G, masks as M, spatial as S
from ..session import cut_lineage
from .morphology import CORE, GRID, KEYS, SPACING, TUMOUR
from .registry import query
from .scoring import student_p_sql

V = "patient:i flat_idx:i"
GM, WM, CSF = (", ".join(map(str, v)) for v in (M.GM_LABELS, M.WM_LABELS, M.CSF_LABELS))


def _vm(spark, sf):
    return fx.vox_mask(spark, sf)


def _vq(name: str, cols: str, body: str, **extra: str):
    return query(name, cols, fx.with_views(body, "vm", extra=extra))


@_vq(
    "p1_tissue_groups",
    f"{V} tissue",
    f"SELECT patient, flat_idx, CASE WHEN parc IN ({GM}) THEN 'gm' WHEN parc IN ({WM}) THEN 'wm' WHEN parc IN ({CSF}) THEN 'csf' END AS tissue FROM vm",
)
def tissue_groups(spark, sf):
    return _vm(spark, sf).withColumn("tissue", M.tissue(F.col("parc")))


_SEG4 = "CASE WHEN seg_a=0 AND (x+y)%9=0 THEN 4 ELSE seg_a END"
_GIVEN = "CASE WHEN patient%2=0 THEN n>=3 END"


@_vq(
    "p2_region_flags",
    f"{V} necro:b enh:b edema:b tumor:b csf:b healthy:b",
    "SELECT patient, flat_idx, s=1 AND brain AS necro, s=3 AND brain AS enh, s=2 AND brain AS edema, s IN (1,2,3) AND brain AS tumor, "
    "s=4 AND brain AS csf, COALESCE(h AND brain, brain AND NOT (s IN (1,2,3) AND brain)) AND NOT (s=4 AND brain) AS healthy FROM "
    f"(SELECT *, {_SEG4} AS s, {_GIVEN} AS h FROM vm)",
)
def region_flags(spark, sf):
    df = _vm(spark, sf).withColumns({"s": F.expr(_SEG4), "h": F.expr(_GIVEN)})
    return M.region_flags(df, "s", healthy=F.col("h"))


def _parts(df):
    return df.withColumns({"necro": F.expr("seg_a=1"), "enh": F.expr("seg_a=3"), "edema": F.expr("seg_a IN (2,3)")})


@_vq(
    "p3_tumour_core",
    f"{V} core_nec:b core_enh:b core_both:b edema_left:b",
    "SELECT patient, flat_idx, seg_a=1 AND brain AS core_nec, seg_a=3 AND brain AS core_enh, seg_a IN (1,3) AND brain AS core_both, "
    "seg_a IN (2,3) AND brain AND NOT (seg_a IN (1,3) AND brain) AS edema_left FROM vm",
)
def tumour_core(spark, sf):
    df = _parts(_vm(spark, sf))
    df = df.withColumns({c: F.col(c) & F.col("brain") for c in ("necro", "enh", "edema")})
    both = M.tumour_core("enhancing_plus_necrosis")
    return df.withColumns(
        {
            "core_nec": M.tumour_core("Necrosis"),
            "core_enh": M.tumour_core("enhancing_only"),
            "core_both": both,
            "edema_left": F.col("edema") & ~both,
        }
    )


def _masks_sql(margin: int, band: int, controlled: int | None) -> dict[str, str]:
    strict = "brain AND NOT core AND NOT edema AND NOT margin"
    healthy = strict
    if controlled is not None:
        inner = f"({strict} AND COALESCE(d<={controlled}, FALSE))"
        healthy = f"CASE WHEN bool_or({inner}) OVER (PARTITION BY patient) THEN {inner} ELSE {strict} END"
    return {
        "cv": f"SELECT patient, x, y, z FROM vm WHERE {CORE}",
        "nd": "SELECT v.patient, v.flat_idx, MIN(abs(v.x-c.x)+abs(v.y-c.y)+abs(v.z-c.z)) AS d FROM vm v JOIN cv c ON c.patient=v.patient GROUP BY 1,2",
        "t0": f"SELECT vm.*, d, {CORE} AS core, seg_a=2 AND brain AS edema, COALESCE(d<={margin}, FALSE) AND brain AS margin, "
        f"COALESCE(d<={band}, FALSE) AND brain AND NOT ({CORE}) AS band FROM vm LEFT JOIN nd USING (patient, flat_idx)",
        "t1": f"SELECT *, brain AND NOT core AND NOT edema AS healthy_candidate, margin AND NOT core AS ring, (band OR edema) AND brain AS test_region, "
        f"{healthy} AS h0 FROM t0",
        "tm": f"SELECT *, h0 AND NOT (parc IN ({CSF}) AND brain) AS healthy_train, h0 AND parc IN ({GM}) AND brain AS healthy_train_gm, "
        f"h0 AND parc IN ({WM}) AND brain AS healthy_train_wm FROM t1",
    }


def masks_table(spark, sf, **kw):
    df = cut_lineage(_vm(spark, sf)).withColumns({"necro": F.expr("seg_a=1"), "enh": F.expr("seg_a=3"), "edema": F.expr("seg_a=2")})
    options = dict(positive="enhancing_plus_necrosis", band_steps=7, parc="parc")
    return M.train_masks(df, KEYS, **{**options, **kw})


_TM = _masks_sql(2, 7, None)


@_vq("p4_margin_and_ring", f"{V} margin:b ring:b", "SELECT * FROM tm", **_TM)
def margin(spark, sf):
    return masks_table(spark, sf)


@_vq("p5_healthy_pools", f"{V} healthy_candidate:b strict:b", "SELECT *, h0 AS strict FROM tm", **_TM)
def healthy_pools(spark, sf):
    return masks_table(spark, sf, exclude_csf=False).withColumn("strict", F.col("healthy_train"))


@_vq("p6_healthy_controlled", f"{V} controlled:b", "SELECT *, h0 AS controlled FROM tm", **_masks_sql(2, 7, 6))
def healthy_controlled(spark, sf):
    df = masks_table(spark, sf, negative="healthy_controlled", controlled_steps=6, exclude_csf=False)
    return df.withColumn("controlled", F.col("healthy_train"))


@_vq("p6_healthy_controlled_fallback", f"{V} controlled:b", "SELECT *, h0 AS controlled FROM tm", **_masks_sql(2, 7, 3))
def healthy_controlled_fallback(spark, sf):
    """The band of three steps lies in the edema, so the strict pool is used."""
    df = masks_table(spark, sf, negative="healthy_controlled", controlled_steps=3, exclude_csf=False)
    return df.withColumn("controlled", F.col("healthy_train"))


@_vq("p7_tissue_split_pools", f"{V} healthy_train:b healthy_train_gm:b healthy_train_wm:b", "SELECT * FROM tm", **_TM)
def tissue_split(spark, sf):
    return masks_table(spark, sf)


@_vq("p8_test_region", f"{V} band:b test_region:b", "SELECT * FROM tm", **_TM)
def test_region(spark, sf):
    return masks_table(spark, sf)


_MM = "SELECT p_partkey, p_size*0.5 AS mm, 1.0+(p_partkey%3)*0.5 AS vx, 1.0+(p_partkey%4)*0.5 AS vy, 2.0+(p_partkey%2)*0.5 AS vz FROM part"


def _mm(spark, sf):
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        "p_size*0.5D AS mm",
        "1.0D+(p_partkey%3)*0.5D AS vx",
        "1.0D+(p_partkey%4)*0.5D AS vy",
        "2.0D+(p_partkey%2)*0.5D AS vz",
    )


@query(
    "p9_mm_to_iterations",
    "p_partkey:i n:i sx:i sy:i sz:i buf_x:i buf_y:i buf_z:i",
    "SELECT p_partkey, GREATEST(1, round_even(mm/((vx+vy+vz)/3.0), 0)) AS n, sx, sy, sz, "
    + ", ".join(f"LEAST(GREATEST(0, round_even(mm/4.0/v{a}, 0)), GREATEST(0, floor(s{a}/2.0)-1)) AS buf_{a}" for a in "xyz")
    + " FROM (SELECT *, "
    + ", ".join(f"GREATEST(1, round_even(mm/v{a}, 0)) AS s{a}" for a in "xyz")
    + " FROM (SELECT p_partkey, CAST(mm AS DOUBLE) AS mm, CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy, CAST(vz AS DOUBLE) AS vz FROM ("
    + _MM
    + ")))",
)
def mm_to_iterations(spark, sf):
    sizes = ("vx", "vy", "vz")
    return _mm(spark, sf).select("p_partkey", G.mm_to_iterations("mm", sizes).alias("n"), *G.mm_to_steps("mm", F.col("mm") / 4, sizes)).withColumnsRenamed(
        {f"b{a}": f"buf_{a}" for a in G.AXES}
    )


_CONS = {
    "c0": f"SELECT *, seg_a IN (1,3) OR seg_b IN (1,3) AS c, seg_a IN (1,2,3) OR seg_b IN (1,2,3) AS e, parc IN ({CSF}) AS csf FROM vm",
    "c1": "SELECT *, c AND NOT csf AS core, e AND NOT csf AS edema FROM c0",
    "c2": "SELECT v.patient, v.flat_idx, MIN(CASE WHEN s.core THEN abs(v.x-s.x)+abs(v.y-s.y)+abs(v.z-s.z) END) AS dc, "
    "MIN(abs(v.x-s.x)+abs(v.y-s.y)+abs(v.z-s.z)) AS de FROM c1 v JOIN c1 s ON s.patient=v.patient AND s.edema GROUP BY 1,2",
    "c3": "SELECT c1.*, COALESCE(dc<=1,FALSE) AND NOT csf AS core_plus, COALESCE(de<=5,FALSE) AND NOT csf AS edema_plus FROM c1 LEFT JOIN c2 USING (patient, flat_idx)",
    "c4": "SELECT *, edema_plus AND NOT core_plus AS btw FROM c3",
}


@_vq(
    "p10_consensus_masks",
    f"{V} core:b edema:b core_plus:b edema_plus:b between_:b",
    "SELECT *, btw AS between_ FROM c4",
    **_CONS,
)
def consensus(spark, sf):
    return M.consensus(cut_lineage(_vm(spark, sf)), KEYS, ["seg_a", "seg_b"], "parc").withColumnRenamed("between", "between_")


@_vq(
    "p10_consensus_counts",
    "patient:i core:i core_plus:i edema:i edema_plus:i between_:i csf:i seg_a_core:i seg_a_edema:i seg_b_core:i seg_b_edema:i",
    "SELECT patient, "
    + ", ".join(f"COUNT(CASE WHEN {c} THEN 1 END) AS {n}" for c, n in [
        ("core", "core"), ("core_plus", "core_plus"), ("edema", "edema"), ("edema_plus", "edema_plus"), ("btw", "between_"), ("csf", "csf"),
        ("seg_a IN (1,3)", "seg_a_core"), ("seg_a=2", "seg_a_edema"), ("seg_b IN (1,3)", "seg_b_core"), ("seg_b=2", "seg_b_edema")])
    + " FROM c4 GROUP BY 1",
    **_CONS,
)
def consensus_counts(spark, sf):
    segs = ["seg_a", "seg_b"]
    masks = M.consensus(cut_lineage(_vm(spark, sf)), KEYS, segs, "parc")
    return M.consensus_counts(masks, KEYS, segs).withColumnRenamed("between", "between_")


@_vq(
    "p11_masked_zmap",
    f"{V} z:d6",
    "SELECT patient, flat_idx, (p_nec-AVG(CASE WHEN brain THEN p_nec END) OVER (PARTITION BY patient))/(stddev_pop(CASE WHEN brain THEN p_nec END) OVER (PARTITION BY patient)+1e-6) AS z FROM vm",
)
def zmap(spark, sf):
    return C.zmap(_vm(spark, sf), KEYS, "p_nec", F.col("brain"), "z")


_DIRTY = {
    "a": "CASE WHEN {m}%5=0 AND o_orderkey%97=0 THEN CAST('NaN' AS DOUBLE) WHEN {m}%5<2 AND o_orderkey%101=0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END",
    "b": "CASE WHEN {m}%5=2 AND o_orderkey%89=0 THEN CAST('-Infinity' AS DOUBLE) ELSE o_totalprice*10 END",
}


@query(
    "p13_number_cleanup",
    "id:i m:i a:d3 b:d3",
    "SELECT id, m, "
    + ", ".join(
        f"CASE WHEN has_nan THEN CASE WHEN isnan({c}) THEN 0 ELSE LEAST(3.4028234663852886e38, GREATEST(-3.4028234663852886e38, {c})) END "
        f"WHEN has_inf THEN LEAST(1e6, GREATEST(-1e6, {c})) ELSE {c} END AS {c}"
        for c in "ab"
    )
    + " FROM (SELECT *, bool_or(isnan(a) OR isnan(b)) OVER (PARTITION BY m) AS has_nan, bool_or(isinf(a) OR isinf(b)) OVER (PARTITION BY m) AS has_inf "
    f"FROM (SELECT o_orderkey AS id, o_custkey%5 AS m, {_DIRTY['a'].format(m='o_custkey')} AS a, {_DIRTY['b'].format(m='o_custkey')} AS b FROM orders))",
)
def number_cleanup(spark, sf):
    df = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey%5 AS m", *[f"{e.format(m='o_custkey')} AS {c}" for c, e in _DIRTY.items()]
    )
    return C.clean_numbers(df, ["m"], ["a", "b"])


@_vq(
    "p14_robust_clip",
    f"{V} p_nec:d6 p_enh:d6",
    "SELECT patient, flat_idx, "
    + ", ".join(
        f"LEAST(1.5, GREATEST(-1.5, ({c}-AVG({c}) OVER w)/(stddev_pop({c}) OVER w+1e-6)))*(stddev_pop({c}) OVER w+1e-6)+AVG({c}) OVER w AS {c}"
        for c in ("p_nec", "p_enh")
    )
    + " FROM vm WINDOW w AS (PARTITION BY patient)",
)
def robust_clip(spark, sf):
    return C.robust_clip(_vm(spark, sf), KEYS, ["p_nec", "p_enh"], limit=1.5)


@_vq(
    "l1_standard_scaler",
    f"{V} p_nec:d6 p_mix:d6",
    "SELECT patient, flat_idx, "
    + ", ".join(
        f"({c}-AVG(CASE WHEN brain THEN {c} END) OVER w)/stddev_pop(CASE WHEN brain THEN {c} END) OVER w AS {c}" for c in ("p_nec", "p_mix")
    )
    + " FROM vm WINDOW w AS (PARTITION BY patient)",
)
def scaler(spark, sf):
    """Fitted on the brain voxels, applied to all."""
    return C.standardise(_vm(spark, sf), KEYS, ["p_nec", "p_mix"], fit=F.col("brain"))


@_vq(
    "p15_scaled_coordinates",
    f"{V} x_norm:d6 y_norm:d6 z_norm:d6",
    "SELECT patient, flat_idx, x/20.0*0.2 AS x_norm, y/20.0*0.2 AS y_norm, z/10.0*0.2 AS z_norm FROM vm",
)
def scaled_coordinates(spark, sf):
    return _vm(spark, sf).select("patient", "flat_idx", *G.scaled_coordinates(GRID))


_CHANNELS = {
    "p_nec": "CASE WHEN n%3<>0 THEN p_nec END",
    "p_enh": "CASE WHEN n%4<>0 THEN p_enh END",
    "p_mix": "CASE WHEN n%5<>0 AND n%3<>0 THEN p_mix END",
}


@_vq(
    "p16_joint_probability",
    f"{V} joint:d9",
    "SELECT patient, flat_idx, list_avg(list_filter([a,b,c], lambda v: v IS NOT NULL)) AS joint FROM (SELECT patient, flat_idx, "
    + ", ".join(f"{e} AS {n}" for n, e in zip("abc", _CHANNELS.values()))
    + " FROM vm)",
)
def joint(spark, sf):
    """Mean of the channels present at each voxel."""
    df = _vm(spark, sf).withColumns({n: F.expr(e) for n, e in _CHANNELS.items()})
    return df.withColumn("joint", C.joint_probability(list(_CHANNELS)))


@_vq(
    "p17_activity_score",
    f"{V} activity:d6",
    "SELECT patient, flat_idx, CASE WHEN test_region THEN p_enh/(p_enh+p_nec+1e-9) ELSE 0 END AS activity FROM tm",
    **_TM,
)
def activity(spark, sf):
    df = masks_table(spark, sf)
    score = F.col("p_enh") / (F.col("p_enh") + F.col("p_nec") + 1e-9)
    return df.withColumn("activity", M.restrict_map(score, F.col("test_region")))


@_vq(
    "p18_restricted_maps",
    f"{V} in_edema:d6 in_region:d6",
    "SELECT patient, flat_idx, CASE WHEN edema THEN p ELSE 0 END AS in_edema, CASE WHEN test_region THEN p ELSE 0 END AS in_region FROM tm",
    **_TM,
)
def restricted_maps(spark, sf):
    df = masks_table(spark, sf)
    return df.withColumns({"in_edema": M.restrict_map(F.col("p"), F.col("edema")), "in_region": M.restrict_map(F.col("p"), F.col("test_region"))})


@query(
    "p24_temporal_mean",
    "patient:i voxel:i mean:d6 masked:d6",
    fx.with_views(
        "SELECT patient, voxel, AVG(value) AS mean, CASE WHEN voxel%2=0 THEN AVG(value) ELSE 0 END AS masked FROM events_long GROUP BY 1,2", "events_long"
    ),
)
def temporal_mean(spark, sf):
    means = fx.events_long(spark, sf).groupBy("patient", "voxel").agg(F.avg("value").alias("mean"))
    return means.withColumn("masked", M.restrict_map(F.col("mean"), F.col("voxel") % 2 == 0))


_AFF = [f"(s_suppkey%{m})*{s}" for m, s in [(3, 0.25), (4, 0.5), (5, 0.1), (7, 1.0), (2, 0.5), (5, 0.3), (3, 0.2), (9, 1.0), (4, 0.4), (7, 0.1), (6, 0.5), (8, 1.0)]]


@query(
    "p25_voxel_size",
    "s_suppkey:i vx:d6 vy:d6 vz:d6 ml:d9",
    "SELECT *, vx*vy*vz/1000 AS ml FROM (SELECT s_suppkey, "
    + ", ".join(f"sqrt(pow({_AFF[i]},2)+pow({_AFF[4+i]},2)+pow({_AFF[8+i]},2)) AS v{a}" for i, a in enumerate("xyz"))
    + " FROM supplier)",
)
def voxel_size(spark, sf):
    """Column norms of one affine per scanner row."""
    df = fx.table(spark, sf, "supplier").select("s_suppkey", *[F.expr(e).cast("double").alias(f"a{i}") for i, e in enumerate(_AFF)])
    df = df.select("s_suppkey", *G.voxel_size([f"a{i}" for i in range(12)]))
    return df.withColumn("ml", G.Grid(1, 1, 1, "vx", "vy", "vz").voxel_volume() / 1000)


_PV = "[p_nec/7.0, p_enh/11.0, p_mix/3.0, p_nec*p_enh/13.0, p_enh*p_mix/17.0]"


@_vq(
    "p26_outside_suppression",
    f"{V} q0:d9 q1:d9 q2:d9 q4:d9",
    "SELECT patient, flat_idx, q[1] AS q0, q[2] AS q1, q[3] AS q2, q[5] AS q4 FROM (SELECT patient, flat_idx, CASE WHEN NOT test_region THEN "
    "list_transform(s, lambda v: v/(list_sum(s)+1e-8)) ELSE pv END AS q FROM (SELECT *, list_transform(pv, lambda v, i: CASE WHEN i>=3 THEN v*0.05 ELSE v END) AS s "
    f"FROM (SELECT *, {_PV} AS pv FROM tm)))",
    **_TM,
)
def outside_suppression(spark, sf):
    df = masks_table(spark, sf).withColumn("pv", F.expr(f"array({_PV[1:-1]})"))
    df = df.withColumn("q", C.suppress_outside(F.col("pv"), ~F.col("test_region"), [2, 3, 4]))
    return df.select("patient", "flat_idx", *[F.col("q")[i].alias(f"q{i}") for i in (0, 1, 2, 4)])


@_vq(
    "p27_argmax_class",
    f"{V} label:i p_healthy:d6",
    f"SELECT patient, flat_idx, list_position(pv, list_max(pv)) AS label, pv[1]+pv[2] AS p_healthy FROM (SELECT *, {_PV} AS pv FROM vm)",
)
def argmax_class(spark, sf):
    df = _vm(spark, sf).withColumn("pv", F.expr(f"array({_PV[1:-1]})"))
    return df.withColumns({"label": C.argmax_label(F.col("pv")), "p_healthy": F.col("pv")[0] + F.col("pv")[1]})


_TEXT = "CONCAT('GRID_block:Block_mm=', CAST(o_custkey%30 AS VARCHAR(9)), '.5:flag: buffer_mm = ', CAST(o_orderkey%7 AS VARCHAR(9)))"


@query(
    "p28_parse_sampling",
    "o_orderkey:i mode block_mm:d6 buffer_mm:d6",
    "SELECT o_orderkey, 'grid_block' AS mode, o_custkey%30+0.5 AS block_mm, o_orderkey%7 AS buffer_mm FROM orders",
)
def parse_sampling(spark, sf):
    df = fx.table(spark, sf, "orders").select("o_orderkey", F.expr(_TEXT).alias("text"))
    df = df.select("o_orderkey", *G.parse_sampling("text"))
    return df.select("o_orderkey", "mode", F.col("options")["block_mm"].alias("block_mm"), F.col("options")["buffer_mm"].alias("buffer_mm"))


@_vq("p29_mask_names", f"{V} necro:b edema:b enh:b", "SELECT patient, flat_idx, seg_a=1 AS necro, seg_a=2 AS edema, seg_a=3 AS enh FROM vm")
def mask_names(spark, sf):
    df = _vm(spark, sf).withColumns({"nec": F.expr("seg_a=1"), "edema_mask": F.expr("seg_a=2"), "et": F.expr("seg_a=3")})
    return M.rename_masks(df)


@_vq("p30_extended_brain", f"{V} brain:b", "SELECT patient, flat_idx, brain OR COALESCE(s,0)>0 AS brain FROM (SELECT *, CASE WHEN n%7=0 THEN 2 WHEN n%5=0 THEN NULL ELSE seg_a END AS s FROM vm)")
def extended_brain(spark, sf):
    df = _vm(spark, sf).withColumn("s", F.expr("CASE WHEN n%7=0 THEN 2 WHEN n%5=0 THEN NULL ELSE seg_a END"))
    return M.extended_brain(df, "s")


@_vq("p33_flat_index", f"{V} x:i y:i z:i back:i marked:b", "SELECT patient, flat_idx, x, y, z, flat_idx AS back, flat_idx%7=0 AS marked FROM vm")
def flat_index(spark, sf):
    """Index to coordinates and back, and an index list turned into a mask."""
    vm = _vm(spark, sf)
    df = vm.select("patient", "flat_idx", *GRID.coords()).withColumn("back", GRID.flat_index())
    listed = vm.where("flat_idx % 7 = 0").select("patient", "flat_idx", F.lit(True).alias("_m"))
    return df.join(listed, ["patient", "flat_idx"], "left").withColumn("marked", M.is_true(F.col("_m")))


@_vq(
    "p34_roi_label_map",
    f"{V} label:i",
    f"SELECT patient, flat_idx, CASE WHEN {TUMOUR} THEN flat_idx%4+1 ELSE 0 END AS label FROM vm",
)
def roi_label_map(spark, sf):
    vm = _vm(spark, sf)
    clusters = vm.where(TUMOUR).select("patient", "flat_idx", (F.col("flat_idx") % 4).alias("cluster"))
    return M.label_map(vm, clusters, KEYS)


@_vq(
    "p35_roi_choice",
    f"{V} roi:b",
    "SELECT patient, flat_idx, CASE patient%4 WHEN 0 THEN TRUE WHEN 1 THEN s IN (1,2,3) WHEN 2 THEN s=2 ELSE s IN (1,2,3) END AND brain AND s<>4 AS roi "
    f"FROM (SELECT *, {_SEG4} AS s FROM vm)",
)
def roi_choice(spark, sf):
    df = M.region_flags(_vm(spark, sf).withColumn("s", F.expr(_SEG4)), "s")
    name = F.expr("CASE patient%4 WHEN 0 THEN 'other' WHEN 1 THEN 'Tumor' WHEN 2 THEN 'flair_minus_ce' ELSE 'tumor+edema' END")
    return df.withColumn("roi", M.roi(name))


@_vq(
    "p22_csf_precedence",
    f"{V} csf:b",
    "SELECT patient, flat_idx, COALESCE(CASE WHEN patient%3=0 THEN n>4 END AND brain, CASE WHEN patient%3<2 THEN p_mix END > 0.7 AND brain, FALSE) AS csf FROM vm",
)
def csf_precedence(spark, sf):
    given, pve = F.expr("CASE WHEN patient%3=0 THEN n>4 END"), F.expr("CASE WHEN patient%3<2 THEN p_mix END")
    return _vm(spark, sf).withColumn("csf", M.csf_mask(given, pve))


_OPEN = {
    "b0": "SELECT patient, x, y, z FROM vm WHERE p_mix > 0.3",
    "b1": "SELECT a.patient, a.x, a.y, a.z FROM b0 a JOIN b0 b ON a.patient=b.patient AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND abs(a.z-b.z)<=1 GROUP BY 1,2,3,4 HAVING COUNT(*)=27",
    "b2": "SELECT DISTINCT v.patient, v.flat_idx FROM vm v JOIN b1 b ON v.patient=b.patient AND abs(v.x-b.x)<=1 AND abs(v.y-b.y)<=1 AND abs(v.z-b.z)<=1",
}


@_vq(
    "p23_healthy_and_csf",
    f"{V} healthy:b csf:b",
    "SELECT vm.patient, vm.flat_idx, brain AND NOT seg_a>0 AS healthy, b2.flat_idx IS NOT NULL AND brain AND NOT seg_a>0 AS csf FROM vm LEFT JOIN b2 USING (patient, flat_idx)",
    **_OPEN,
)
def healthy_and_csf(spark, sf):
    return M.healthy_and_csf(cut_lineage(_vm(spark, sf)), KEYS, "seg_a", "p_mix", threshold=0.3)


_SEED_FLAGS = {
    "gm": "p_nec>=0.3 AND brain AND NOT seg_a>0",
    "wm": "p_enh>=0.3 AND brain AND NOT seg_a>0",
    "necro": "seg_a=1 AND brain",
    "enh": "seg_a=3 AND brain",
    "edema": "seg_a=2 AND brain",
}


def _seed_sql() -> dict[str, str]:
    out = {}
    for c, e in _SEED_FLAGS.items():
        out[f"f_{c}"] = f"SELECT patient, x, y, z, flat_idx FROM vm WHERE {e}"
        out[f"e_{c}"] = (
            f"SELECT a.patient, a.flat_idx FROM f_{c} a JOIN f_{c} b ON a.patient=b.patient AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)<=1 "
            "GROUP BY 1,2 HAVING COUNT(*)=7"
        )
    out["sd"] = (
        "SELECT vm.patient, vm.flat_idx, "
        + ", ".join(f"(e_{c}.flat_idx IS NOT NULL) AS s_{c}, ({e}) AS r_{c}" for c, e in _SEED_FLAGS.items())
        + " FROM vm "
        + " ".join(f"LEFT JOIN e_{c} ON e_{c}.patient=vm.patient AND e_{c}.flat_idx=vm.flat_idx" for c in _SEED_FLAGS)
    )
    return out


_FALL = "CASE WHEN bool_or(s_{c}) OVER (PARTITION BY patient) THEN s_{c} ELSE r_{c} AND NOT (s_gm OR s_wm) END"


@_vq(
    "p31_guided_seeds",
    f"{V} seed_class:i",
    "SELECT patient, flat_idx, CASE WHEN "
    + " WHEN ".join(f"{_FALL.format(c=c)} THEN {i}" for i, c in ((4, "edema"), (3, "enh"), (2, "necro")))
    + " WHEN s_wm THEN 1 WHEN s_gm THEN 0 END AS seed_class FROM sd",
    **_seed_sql(),
)
def guided_seeds(spark, sf):
    """Eroded seeds per class with the fallback for empty tumour seeds."""
    df = cut_lineage(_vm(spark, sf).withColumns({c: F.expr(e) for c, e in _SEED_FLAGS.items()}))
    eroded = {c: S.erode(df.where(c), KEYS, 1) for c in _SEED_FLAGS}
    return M.guided_seeds(df, KEYS, eroded, list(_SEED_FLAGS))


_FU = {
    "fv": "SELECT f.patient, f.visit, vm.flat_idx, f.v, vm.brain, vm.parc IN (2,41) AS wm, vm.p FROM followup f JOIN vm USING (patient, x, y, z)",
    "md": "SELECT patient, visit, quantile_cont(CASE WHEN brain AND wm THEN v END, 0.5) AS med FROM fv GROUP BY 1,2",
    "en": "SELECT fv.*, med, med*1.5 AS threshold, v>=med*1.5 AND brain AS enh FROM fv JOIN md USING (patient, visit)",
}
FOLLOWUP_SQL = _FU


def followup_table(spark, sf):
    vm = _vm(spark, sf).select("patient", *G.AXES, "flat_idx", "brain", "p", F.col("parc").isin(2, 41).alias("wm"))
    return fx.followup(spark, sf).join(vm, ["patient", *G.AXES])


@query(
    "p21_enhancement_mask",
    "patient:i visit:i flat_idx:i threshold:d6 norm_kind enh:b",
    fx.with_views("SELECT *, 'median_wm' AS norm_kind FROM en", "vm", "followup", extra=_FU),
)
def enhancement(spark, sf):
    """Voxels at or above 1.5 times the white-matter median of each visit."""
    return M.enhancement(cut_lineage(followup_table(spark, sf)), ["patient", "visit"], "v", wm="wm")


# ---- joins ---------------------------------------------------------------------------------


@_vq("j1_feature_gather", f"{V} p:d6 p_nec:d6", "SELECT a.patient, a.flat_idx, p, p_nec FROM (SELECT DISTINCT patient, flat_idx*3%5000 AS flat_idx FROM vm) a JOIN vm b ON a.patient=b.patient AND a.flat_idx=b.flat_idx")
def feature_gather(spark, sf):
    """Feature rows of a list of indices, some of which do not exist."""
    vm = _vm(spark, sf)
    wanted = vm.select("patient", (F.col("flat_idx") * 3 % 5000).alias("flat_idx")).distinct()
    return G.gather(vm, wanted, KEYS)


@_vq("j2_mask_restriction", f"{V} p:d6", f"SELECT * FROM vm WHERE {TUMOUR}")
def mask_restriction(spark, sf):
    vm = _vm(spark, sf)
    return G.restrict(vm, vm.where(TUMOUR), KEYS)


@_vq("j3_membership", f"{V} parc:i", "SELECT * FROM vm WHERE parc IN (SELECT label FROM (SELECT DISTINCT parc AS label FROM vm WHERE parc%2=0))")
def membership(spark, sf):
    """Voxels whose label is in a derived set of labels."""
    vm = _vm(spark, sf)
    return G.members(vm, vm.where("parc % 2 = 0"), "parc")


_SHIFT = [0.9, 0.1, 0.0, 0.7, 0.0, 1.1, 0.0, -0.6, 0.0, 0.0, 1.0, 1.2]
_AT = [f"(x*{_SHIFT[4*r]}+y*{_SHIFT[4*r+1]}+z*{_SHIFT[4*r+2]}+({_SHIFT[4*r+3]}))" for r in range(3)]
_ATD = [f"(x*{_SHIFT[4*r]}::DOUBLE+y*{_SHIFT[4*r+1]}::DOUBLE+z*{_SHIFT[4*r+2]}::DOUBLE+({_SHIFT[4*r+3]}::DOUBLE))" for r in range(3)]


@_vq(
    "j4_resample_nearest",
    f"{V} seg:i",
    "SELECT t.patient, t.flat_idx, COALESCE(s.seg_a, 0) AS seg FROM (SELECT *, "
    + ", ".join(f"CAST(floor({_ATD[r]}+0.5) AS INT) AS s{a}" for r, a in enumerate("xyz"))
    + " FROM vm) t LEFT JOIN vm s ON s.patient=t.patient AND s.x=t.sx AND s.y=t.sy AND s.z=t.sz",
)
def resample_nearest(spark, sf):
    vm = _vm(spark, sf)
    return G.resample_nearest(vm.select("patient", "flat_idx", *G.AXES), vm, KEYS, _SHIFT, "seg_a", "seg")


@_vq(
    "j5_resample_linear",
    "patient:i x:i y:i z:i p:d9",
    "SELECT t.patient, t.x, t.y, t.z, SUM((CASE WHEN i=1 THEN px-floor(px) ELSE 1-(px-floor(px)) END)*(CASE WHEN j=1 THEN py-floor(py) ELSE 1-(py-floor(py)) END)"
    "*(CASE WHEN k=1 THEN pz-floor(pz) ELSE 1-(pz-floor(pz)) END)*COALESCE(s.p,0)) AS p FROM (SELECT patient, x, y, z, "
    + ", ".join(f"{_ATD[r]} AS p{a}" for r, a in enumerate("xyz"))
    + " FROM vm) t, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), (SELECT unnest([0,1]) AS k) LEFT JOIN vm s ON s.patient=t.patient "
    "AND s.x=floor(px)+i AND s.y=floor(py)+j AND s.z=floor(pz)+k GROUP BY 1,2,3,4",
)
def resample_linear(spark, sf):
    vm = _vm(spark, sf)
    return G.resample_linear(vm, vm, KEYS, _SHIFT, "p", "p")


@_vq(
    "j6_neighbour_counts",
    "patient:i x:i y:i z:i neighbours:i",
    "SELECT a.patient, a.x, a.y, a.z, COUNT(b.x)-1 AS neighbours FROM m a JOIN m b ON a.patient=b.patient AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND abs(a.z-b.z)<=1 "
    "AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)<=2 GROUP BY 1,2,3,4",
    m=f"SELECT patient, x, y, z FROM vm WHERE {TUMOUR}",
)
def neighbours(spark, sf):
    return S.neighbour_counts(_vm(spark, sf).where(TUMOUR), KEYS, 18)


@_vq(
    "j7_cube_expansion",
    "patient:i x:i y:i z:i",
    "SELECT DISTINCT c.patient, c.x+i AS x, c.y+j AS y, c.z+k AS z FROM (SELECT * FROM vm WHERE p>0.75) c, (SELECT unnest(generate_series(-2,2)) AS i), "
    "(SELECT unnest(generate_series(-2,2)) AS j), (SELECT unnest(generate_series(-2,2)) AS k) WHERE c.x+i BETWEEN 0 AND 19 AND c.y+j BETWEEN 0 AND 19 AND c.z+k BETWEEN 0 AND 9",
)
def cubes(spark, sf):
    return G.expand_cubes(_vm(spark, sf).where("p > 0.75"), KEYS, 2, GRID)


@_vq(
    "j16_common_cells",
    "patient:i cell:i n_pos:i n_neg:i",
    "SELECT patient, cell, COUNT(CASE WHEN y1 THEN 1 END) AS n_pos, COUNT(CASE WHEN NOT y1 THEN 1 END) AS n_neg FROM (SELECT patient, "
    f"(x//4)*100000000+(y//4)*10000+z//4 AS cell, {TUMOUR} AS y1 FROM vm) GROUP BY 1,2 HAVING n_pos>0 AND n_neg>0",
)
def common_cells(spark, sf):
    df = _vm(spark, sf).select("patient", G.cell_key([4, 4, 4]).alias("cell"), F.expr(f"CAST({TUMOUR} AS INT)").alias("target"))
    return G.common_cells(df, KEYS)


@_vq("m10_cell_key", f"{V} cell:i", "SELECT patient, flat_idx, (x//4)*100000000+(y//3)*10000+z//5 AS cell FROM vm")
def cell_key(spark, sf):
    return _vm(spark, sf).withColumn("cell", G.cell_key([4, 3, 5]))


@_vq("m11_cell_core", f"{V} inner_:b", "SELECT patient, flat_idx, x%5>=1 AND x%5<4 AND y%6>=2 AND y%6<4 AND z%4>=1 AND z%4<3 AS inner_ FROM vm")
def cell_core(spark, sf):
    return _vm(spark, sf).withColumn("inner_", G.in_cell_core([5, 6, 4], [1, 2, 1]))


@_vq(
    "m12_grid_thinning",
    V,
    "SELECT patient, flat_idx FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY md5('7:'||flat_idx), flat_idx) AS k FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY patient, x//3, y//3, z//3 ORDER BY md5('7:'||flat_idx), flat_idx) AS r FROM vm WHERE brain) WHERE r=1) WHERE k<=40",
)
def thinning(spark, sf):
    """One seeded voxel per cell of three voxels, at most 40 of them per patient."""
    from ..operators.sampling import thin

    pool = _vm(spark, sf).where("brain").select("patient", F.lit(1).alias("target"), "flat_idx", *G.AXES)
    return thin(pool, KEYS, 3, 7, max_keep=40)


# ---- sets and counts -----------------------------------------------------------------------


@_vq(
    "u1_mask_union",
    "patient:i x:i y:i z:i seg_a:b seg_b:b",
    "SELECT patient, x, y, z, seg_a IN (1,3) AS seg_a, seg_b IN (1,3) AS seg_b FROM vm WHERE seg_a IN (1,3) OR seg_b IN (1,3)",
)
def mask_union(spark, sf):
    vm = _vm(spark, sf)
    return G.union_masks({s: vm.where(F.col(s).isin(1, 3)) for s in ("seg_a", "seg_b")}, KEYS)


@_vq(
    "u2_cell_intersection",
    "patient:i cell:i",
    f"SELECT patient, (x//4)*100000000+(y//4)*10000+z//4 AS cell FROM vm WHERE {TUMOUR} INTERSECT SELECT patient, (x//4)*100000000+(y//4)*10000+z//4 FROM vm WHERE p>0.7",
)
def cell_intersection(spark, sf):
    vm = _vm(spark, sf).withColumn("cell", G.cell_key([4, 4, 4]))
    return G.shared_cells(vm.where(TUMOUR), vm.where("p > 0.7"), KEYS)


@_vq("u3_mask_difference", V, "SELECT patient, flat_idx FROM vm WHERE seg_b>0 EXCEPT SELECT patient, flat_idx FROM vm WHERE seg_a>0")
def mask_difference(spark, sf):
    vm = _vm(spark, sf)
    return vm.where("seg_b > 0").join(vm.where("seg_a > 0"), ["patient", "flat_idx"], "left_anti")


@query(
    "u4_fold_concat",
    "run id:i score:d6",
    fx.with_views("SELECT 'a' AS run, id, s_rf AS score FROM scored WHERE fold<2 UNION ALL SELECT 'b', id, s_lr FROM scored WHERE fold>=1", "scored"),
)
def fold_concat(spark, sf):
    s = fx.scored(spark, sf)
    a = s.where("fold < 2").select(F.lit("a").alias("run"), "id", F.col("s_rf").alias("score"))
    return a.unionByName(s.where("fold >= 1").select(F.lit("b").alias("run"), "id", F.col("s_lr").alias("score")))


@_vq(
    "a1_mask_counts",
    "patient:i n_brain:i n_core:i n_edema:i n_region:i n_healthy:i",
    "SELECT patient, COUNT(CASE WHEN brain THEN 1 END) AS n_brain, COUNT(CASE WHEN core THEN 1 END) AS n_core, COUNT(CASE WHEN edema THEN 1 END) AS n_edema, "
    "COUNT(CASE WHEN test_region THEN 1 END) AS n_region, COUNT(CASE WHEN healthy_train THEN 1 END) AS n_healthy FROM tm GROUP BY 1",
    **_TM,
)
def mask_counts(spark, sf):
    names = {"brain": "n_brain", "core": "n_core", "edema": "n_edema", "test_region": "n_region", "healthy_train": "n_healthy"}
    return M.flag_counts(masks_table(spark, sf), KEYS, names)


@_vq(
    "a3_edema_statistics",
    "patient:i n:i mean_prob:d6 std_prob:d6 pct_ge_30:d6 pct_ge_50:d6 pct_ge_70:d6",
    "SELECT patient, COUNT(*) AS n, AVG(p) AS mean_prob, stddev_pop(p) AS std_prob, "
    + ", ".join(f"100.0*AVG(CAST(p>={c} AS INT)) AS pct_ge_{int(c*100)}" for c in (0.3, 0.5, 0.7))
    + " FROM vm WHERE seg_a=2 AND brain GROUP BY 1",
)
def edema_statistics(spark, sf):
    from ..operators.evaluation import region_statistics

    return region_statistics(_vm(spark, sf).where("seg_a = 2 AND brain"), KEYS, "p", [0.3, 0.5, 0.7])


@_vq(
    "a7_region_means",
    "patient:i p_core:d6 p_edema:d6 p_region:d6 p_healthy:d6",
    "SELECT patient, AVG(CASE WHEN core THEN p END) AS p_core, AVG(CASE WHEN edema THEN p END) AS p_edema, AVG(CASE WHEN test_region THEN p END) AS p_region, "
    "AVG(CASE WHEN healthy_train THEN p END) AS p_healthy FROM tm GROUP BY 1",
    **_TM,
)
def region_means(spark, sf):
    names = {"core": "p_core", "edema": "p_edema", "test_region": "p_region", "healthy_train": "p_healthy"}
    return M.flag_means(masks_table(spark, sf), KEYS, "p", names)


@_vq(
    "e13_map_agreement",
    "patient:i n_voxels:i pearson_r:d6 pearson_p:d6 spearman_rho:d6 spearman_p:d6 mean_abs_diff:d6 rms_diff:d6",
    "SELECT *, " + ", ".join(student_p_sql(f"(abs({r})*sqrt((n_voxels-2)/(1-{r}*{r})))", "(n_voxels-2)") + f" AS {p}" for r, p in (("pearson_r", "pearson_p"), ("spearman_rho", "spearman_p"))) + " FROM ("
    "SELECT patient, COUNT(*) AS n_voxels, corr(p_nec, p_enh) AS pearson_r, corr(ra, rb) AS spearman_rho, AVG(abs(p_nec-p_enh)) AS mean_abs_diff, "
    "sqrt(AVG((p_nec-p_enh)*(p_nec-p_enh))) AS rms_diff FROM (SELECT *, "
    + ", ".join(
        f"rank() OVER (PARTITION BY patient ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY patient, {c})-1)/2.0 AS {r}" for c, r in (("p_nec", "ra"), ("p_enh", "rb"))
    )
    + " FROM tm WHERE test_region) GROUP BY 1)",
    **_TM,
)
def map_agreement(spark, sf):
    from ..operators.evaluation import map_agreement as agree

    return agree(masks_table(spark, sf).where("test_region"), KEYS, "p_nec", "p_enh")


@_vq(
    "e14_hotspot_dice",
    "patient:i pct:i threshold_a:d6 threshold_b:d6 n_a:i n_b:i dice:d6",
    "SELECT patient, pct, MAX(ta) AS threshold_a, MAX(tb) AS threshold_b, COUNT(CASE WHEN p_mix>=ta THEN 1 END) AS n_a, COUNT(CASE WHEN p_enh>=tb THEN 1 END) AS n_b, "
    "2.0*COUNT(CASE WHEN p_mix>=ta AND p_enh>=tb THEN 1 END)/(COUNT(CASE WHEN p_mix>=ta THEN 1 END)+COUNT(CASE WHEN p_enh>=tb THEN 1 END)) AS dice FROM "
    "(SELECT patient, p_mix, p_enh FROM tm WHERE test_region) JOIN (SELECT patient, 90 AS pct, quantile_cont(p_mix,0.9) AS ta, quantile_cont(p_enh,0.9) AS tb FROM tm WHERE test_region GROUP BY 1 "
    "UNION ALL SELECT patient, 95, quantile_cont(p_mix,0.95), quantile_cont(p_enh,0.95) FROM tm WHERE test_region GROUP BY 1) USING (patient) GROUP BY 1,2",
    **_TM,
)
def dice(spark, sf):
    from ..operators.evaluation import hotspot_dice

    return hotspot_dice(masks_table(spark, sf).where("test_region"), KEYS, "p_mix", "p_enh")
