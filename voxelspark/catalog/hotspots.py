"""Registered queries: hotspot detection, ranking, phenotype, follow-up."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import followup as FU, hotspot as H, masks as M, spatial as S
from ..session import cut_lineage
from .morphology import CORE, GRID, KEYS, SPACING, SUPRA, _components_sql, recursive
from .registry import query
from .scoring import adjusted_sql, normal_p_sql
from .voxels import FOLLOWUP_SQL, _TM, followup_table, masks_table

BY = "patient:i pct:i"
MIN_VOXELS, MIN_DIST = 3, 2.0

_HOT = {
    **_TM,
    "rg": "SELECT * FROM tm WHERE test_region",
    "cut_": "SELECT patient, 90 AS pct, quantile_cont(p, 0.90) AS threshold FROM rg GROUP BY 1 UNION ALL SELECT patient, 95, quantile_cont(p, 0.95) FROM rg GROUP BY 1",
    "rw": "SELECT rg.*, pct, threshold, p>=threshold AS hot FROM rg JOIN cut_ USING (patient)",
    "s": "SELECT * FROM rw WHERE hot",
    "edge": "SELECT a.patient, a.pct, a.flat_idx AS u, b.flat_idx AS v FROM s a JOIN s b ON a.patient=b.patient AND a.pct=b.pct AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND abs(a.z-b.z)<=1 "
    "AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)<=2",
    "walk": "SELECT patient, pct, u AS root, v AS node FROM edge UNION SELECT w.patient, w.pct, w.root, e.v FROM walk w JOIN edge e ON e.patient=w.patient AND e.pct=w.pct AND e.u=w.node",
    "comp": "SELECT patient, pct, node AS flat_idx, MIN(root) AS cid FROM walk GROUP BY 1,2,3",
    "ds": "SELECT s.patient, s.pct, s.flat_idx, sqrt(MIN(4.0*(s.x-c.x)*(s.x-c.x)+4.0*(s.y-c.y)*(s.y-c.y)+6.25*(s.z-c.z)*(s.z-c.z))) AS dist FROM s JOIN cv c ON c.patient=s.patient GROUP BY 1,2,3",
    "cl": "SELECT s.patient, s.pct, cid, COUNT(*) AS size_voxels, AVG(p) AS mean_prob, MAX(p) AS max_prob, MIN(dist) AS min_dist_mm, bool_or(edema) AS in_edema, bool_or(NOT edema) AS in_ring, "
    "AVG(p_nec) AS mean_p_nec, AVG(p_enh) AS mean_p_enh, AVG(p_mix) AS mean_p_mix FROM s JOIN comp USING (patient, pct, flat_idx) JOIN ds USING (patient, pct, flat_idx) GROUP BY 1,2,3",
    "bg": "SELECT patient, pct, COALESCE(AVG(CASE WHEN NOT hot THEN p END),0) AS bg_mean, GREATEST(COALESCE(stddev_pop(CASE WHEN NOT hot THEN p END),1),1e-9) AS bg_std FROM rw GROUP BY 1,2",
    "ok": f"SELECT cl.*, bg_mean, bg_std, (mean_prob-bg_mean)/(bg_std/sqrt(size_voxels)) AS z, mean_prob*size_voxels/(min_dist_mm+1) AS score FROM cl JOIN bg USING (patient, pct) WHERE size_voxels>={MIN_VOXELS} AND min_dist_mm>={MIN_DIST}",
    "pr": "SELECT ok.patient, ok.pct, ok.cid, 50.0*(COUNT(CASE WHEN rw.p<mean_prob THEN 1 END)+COUNT(CASE WHEN rw.p<=mean_prob THEN 1 END)+CASE WHEN COUNT(CASE WHEN rw.p=mean_prob THEN 1 END)>0 THEN 1 ELSE 0 END)/COUNT(*) AS pct_rank "
    "FROM ok JOIN rw ON rw.patient=ok.patient AND rw.pct=ok.pct GROUP BY 1,2,3",
    "dc": "SELECT *, CASE WHEN mean_p_nec>=mean_p_enh AND mean_p_nec>=mean_p_mix THEN 'necrosis' WHEN mean_p_enh>=mean_p_mix THEN 'enhancing' ELSE 'enhancing_plus_necrosis' END AS dominant_class FROM cl",
    "rk": "SELECT ok.*, ROW_NUMBER() OVER (PARTITION BY patient, pct ORDER BY score DESC, cid) AS rank_ FROM ok",
}


# Probabilities in whole units and exact sums, so that no row order shows in a mean, a tie or a rank; thresholds as
# lower + (upper - lower) * part, which is the value itself where both neighbours are equal.
_UNITS = "floor({c}*1e12+0.5)"
_MEAN = "CAST(SUM(CAST(" + _UNITS + " AS BIGINT)) AS DOUBLE)/(1e12*COUNT({c}))"
_TIE = "floor(mean_{c}*1e9+0.5)"
_EXACT = {
    **_HOT,
    "rg": "SELECT * REPLACE (" + ", ".join(f"{_UNITS.format(c=c)}/1e12 AS {c}" for c in ("p", *H.CHANNELS)) + ") FROM tm WHERE test_region",
    "cut_": "SELECT patient, pct, v[CAST(floor(pos) AS BIGINT)+1]+(v[CAST(ceil(pos) AS BIGINT)+1]-v[CAST(floor(pos) AS BIGINT)+1])*(pos-floor(pos)) AS threshold FROM "
    "(SELECT patient, pct, v, (len(v)-1)*(pct/100.0::DOUBLE) AS pos FROM (SELECT patient, list_sort(list(p)) AS v FROM rg GROUP BY 1), (SELECT unnest([90, 95]) AS pct))",
    "cl": f"SELECT s.patient, s.pct, cid, COUNT(*) AS size_voxels, {_MEAN.format(c='p')} AS mean_prob, MAX(p) AS max_prob, MIN(dist) AS min_dist_mm, bool_or(edema) AS in_edema, bool_or(NOT edema) AS in_ring, "
    + ", ".join(f"{_MEAN.format(c=c)} AS mean_{c}" for c in H.CHANNELS)
    + " FROM s JOIN comp USING (patient, pct, flat_idx) JOIN ds USING (patient, pct, flat_idx) GROUP BY 1,2,3",
    # a patient without a core keeps its hotspots, without a distance
    "ds": _HOT["ds"].replace("FROM s JOIN cv", "FROM s LEFT JOIN cv"),
    "ok": f"SELECT cl.*, bg_mean, bg_std, (mean_prob-bg_mean)/(bg_std/sqrt(size_voxels)) AS z, mean_prob*size_voxels/(COALESCE(min_dist_mm,0)+1) AS score FROM cl JOIN bg USING (patient, pct) "
    f"WHERE size_voxels>={MIN_VOXELS} AND COALESCE(min_dist_mm>={MIN_DIST}, TRUE)",
    "dc": "SELECT *, CASE WHEN {n}>={e} AND {n}>={m} THEN 'necrosis' WHEN {e}>={m} THEN 'enhancing' ELSE 'enhancing_plus_necrosis' END AS dominant_class FROM cl".format(
        n=_TIE.format(c="p_nec"), e=_TIE.format(c="p_enh"), m=_TIE.format(c="p_mix")
    ),
}


def _hq(name: str, cols: str, body: str, **extra: str):
    return query(name, cols, recursive(fx.with_views(body, "vm", extra={**_EXACT, **extra})))


def _region(spark, sf):
    return cut_lineage(masks_table(spark, sf).select(*KEYS, *"xyz", "flat_idx", "p", *H.CHANNELS, "edema", "core", "test_region"))


def _labelled(spark, sf):
    return _hot_voxels(_region(spark, sf))


def _hot_voxels(vm):
    region = H.in_units(vm.where("test_region"), ["p", *H.CHANNELS])
    cuts = cut_lineage(H.thresholds(H.value_order(region, KEYS, "p"), H.PERCENTILES))
    return H.labelled_hotspots(region, vm.where("core"), cuts, KEYS, GRID, SPACING, "p")


def _clusters(spark, sf):
    vm = _region(spark, sf)
    return H.detect_clusters(vm.where("test_region"), vm.where("core"), KEYS, GRID, SPACING, min_voxels=MIN_VOXELS, min_dist_mm=MIN_DIST)


@_hq(
    "a8_cluster_statistics",
    f"{BY} cid:i size_voxels:i mean_prob:d6 max_prob:d6 in_edema:b in_ring:b",
    "SELECT * FROM cl",
)
def cluster_statistics(spark, sf):
    return H.cluster_statistics(_labelled(spark, sf), KEYS, "p")


@_hq("a9_dominant_channel", f"{BY} cid:i mean_p_nec:d9 mean_p_enh:d9 mean_p_mix:d9 dominant_class", "SELECT * FROM dc")
def dominant_channel(spark, sf):
    return H.cluster_statistics(_labelled(spark, sf), KEYS, "p")


@query("a10_background_statistics", f"{BY} bg_mean:d6 bg_std:d6", recursive(fx.with_views("SELECT * FROM bg", "vm", extra=_HOT)))
def background(spark, sf):
    return H.thresholds(H.value_order(_region(spark, sf).where("test_region"), KEYS, "p"), H.PERCENTILES)


@_hq("j8_cluster_core_distance", f"{BY} cid:i min_dist_mm:d6", "SELECT * FROM cl")
def core_distance(spark, sf):
    hot = _labelled(spark, sf)
    return hot.groupBy("patient", "pct", "cid").agg(F.min("dist").alias("min_dist_mm"))


@_hq("w5_percentile_of_score", f"{BY} cid:i pct_rank:d4", "SELECT * FROM pr")
def percentile_of_score(spark, sf):
    return _clusters(spark, sf).withColumnRenamed("pct_rank_in_test", "pct_rank")


@_hq("e17_cluster_z_test", f"{BY} cid:i z:d5", "SELECT * FROM ok")
def z_test(spark, sf):
    return _clusters(spark, sf)


@_hq(
    "e18_detect_clusters",
    f"{BY} cid:i size_voxels:i volume_ml:d3 mean_prob:d6 max_prob:d6 min_dist_mm:d6 pct_rank:d2 dominant_class in_edema:b in_ring:b score:d6",
    "SELECT ok.*, round_even(size_voxels*0.01, 3) AS volume_ml, pct_rank, dominant_class FROM ok JOIN pr USING (patient, pct, cid) JOIN (SELECT patient, pct, cid, dominant_class FROM dc) USING (patient, pct, cid)",
)
def detect_clusters(spark, sf):
    """All clusters that pass the filters."""
    return _clusters(spark, sf).withColumnRenamed("pct_rank_in_test", "pct_rank")


@_hq(
    "e18_detect_clusters_p_values",
    f"{BY} cid:i p_raw:d6 p_bh_adj:d6 sig_fdr:b",
    "SELECT *, p_bh AS p_bh_adj, p_bh<=0.05 AS sig_fdr FROM (" + adjusted_sql("pz", "p_raw", "patient, pct") + ")",
    pz=f"SELECT *, CASE WHEN z>=0 THEN {normal_p_sql('z')}/2 ELSE 1-{normal_p_sql('z')}/2 END AS p_raw FROM ok",
)
def detect_clusters_p(spark, sf):
    return _clusters(spark, sf)


@_hq("k1_hotspot_top3", f"{BY} rank_:i cid:i score:d6", f"SELECT * FROM rk WHERE rank_<={H.MAX_CLUSTERS}")
def top3(spark, sf):
    return H.rank_clusters(_clusters(spark, sf), KEYS).withColumnRenamed("rank", "rank_")


@_hq(
    "e19_hotspot_ranking",
    f"{BY} rank_:i cid:i size_voxels:i mean_prob:d6 min_dist_mm:d6 score:d6",
    f"SELECT * FROM rk WHERE rank_<={H.MAX_CLUSTERS}",
)
def hotspot_ranking(spark, sf):
    """Flagship: ranked hotspots of every patient at the 90th and 95th percentile."""
    return H.rank_clusters(_clusters(spark, sf), KEYS).withColumnRenamed("rank", "rank_")


_POS, _NEG = "core AND flat_idx%2=0", "healthy_train AND flat_idx%3=0"


@_hq(
    "p19_overlay_labels",
    "patient:i flat_idx:i overlay:i",
    f"SELECT tm.patient, tm.flat_idx, COALESCE(r.rank_, CASE WHEN {_POS} THEN 4 WHEN {_NEG} THEN 5 ELSE 0 END) AS overlay FROM tm LEFT JOIN "
    "(SELECT comp.patient, comp.flat_idx, rank_ FROM comp JOIN rk USING (patient, pct, cid) WHERE comp.pct=90 AND rank_<=3) r USING (patient, flat_idx)",
)
def overlay(spark, sf):
    """Ranked hotspots over training voxels, one label per voxel."""
    vm = cut_lineage(masks_table(spark, sf))
    region, core = vm.where("test_region"), vm.where("core")
    hot = _hot_voxels(vm)
    clusters = H.detect_clusters(region, core, KEYS, GRID, SPACING, min_voxels=MIN_VOXELS, min_dist_mm=MIN_DIST)
    ranks = H.rank_clusters(clusters, KEYS).where("pct = 90").select("patient", "cid", "rank")
    marked = hot.where("pct = 90").join(ranks, ["patient", "cid"]).select("patient", "flat_idx", "rank")
    out = vm.join(marked, ["patient", "flat_idx"], "left")
    return out.withColumn("overlay", H.overlay(F.col("rank"), F.expr(_POS), F.expr(_NEG)))


# ---- components, series, phenotype ---------------------------------------------------------

_SZ = {
    **_components_sql(3),
    "sz": "SELECT patient, cid, COUNT(*) AS n_voxels, COUNT(*)*10.0 AS volume_mm3 FROM comp GROUP BY 1,2",
    "sm": "SELECT patient, COUNT(*) AS n_components, COUNT(CASE WHEN volume_mm3>=30 THEN 1 END) AS n_significant, SUM(volume_mm3) AS total_mm3, MAX(volume_mm3)/SUM(volume_mm3) AS largest_fraction, "
    "arg_max(cid, n_voxels*1000000-cid) AS largest_cid FROM sz GROUP BY 1",
}


def _sizes(spark, sf):
    labels = S.connected_components(fx.vox_mask(spark, sf).where(SUPRA), KEYS, GRID, 26)
    return H.component_sizes(labels, KEYS, GRID, 30.0)


@query(
    "a2_component_sizes",
    "patient:i n_components:i n_significant:i total_mm3:d6 largest_fraction:d6 largest_cid:i",
    recursive(fx.with_views("SELECT * FROM sm", "vm", extra=_SZ)),
)
def component_sizes(spark, sf):
    return H.component_summary(_sizes(spark, sf), KEYS)


@query(
    "k4_sorted_volumes",
    "patient:i pos:i volume:d6",
    recursive(fx.with_views("SELECT patient, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY volume_mm3 DESC)-1 AS pos, volume_mm3 AS volume FROM sz", "vm", extra=_SZ)),
)
def sorted_volumes(spark, sf):
    summary = H.component_summary(_sizes(spark, sf), KEYS)
    return summary.select("patient", F.posexplode("volumes_mm3").alias("pos", "volume"))


# series live on a 5x5x5 grid per patient; half of the voxels form the hotspot
_SPOT = "(label < 6 AND (flat_idx*7)%10 < 6)"
_PHENO = {
    "hs": f"SELECT patient, x, y, z, flat_idx FROM series WHERE {_SPOT} AND patient%3<>1",
    "edge": "SELECT a.patient, a.flat_idx AS u, b.flat_idx AS v FROM hs a JOIN hs b ON a.patient=b.patient AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND abs(a.z-b.z)<=1",
    "walk": "SELECT patient, u AS root, v AS node FROM edge UNION SELECT w.patient, w.root, e.v FROM walk w JOIN edge e ON e.patient=w.patient AND e.u=w.node",
    "comp": "SELECT patient, node AS flat_idx, MIN(root) AS cid FROM walk GROUP BY 1,2",
    "sz": "SELECT patient, cid, COUNT(*) AS n_voxels, COUNT(*)*10.0 AS volume_mm3 FROM comp GROUP BY 1,2",
    "sm": "SELECT patient, COUNT(*) AS n_components, COUNT(CASE WHEN volume_mm3>=20 THEN 1 END) AS n_significant, SUM(volume_mm3) AS total_mm3, MAX(volume_mm3)/SUM(volume_mm3) AS largest_fraction, "
    "arg_max(cid, n_voxels*1000000-cid) AS largest_cid FROM sz GROUP BY 1",
    "zs": "SELECT slong.patient, slong.flat_idx, cid, t, (v-AVG(v) OVER w)/stddev_pop(v) OVER w AS zv FROM slong JOIN comp USING (patient, flat_idx) JOIN sz USING (patient, cid) WHERE volume_mm3>=20 WINDOW w AS (PARTITION BY slong.patient, slong.flat_idx)",
    "ct": "SELECT patient, cid, t, SUM(zv) AS s, SUM(zv*zv) AS q, COUNT(*) AS n, AVG(zv) AS m FROM zs GROUP BY 1,2,3",
    "ci": "SELECT patient, cid, (SUM(s*s)-SUM(q))/(64.0*MAX(n)*(MAX(n)-1)) AS r, MAX(n) AS n FROM ct GROUP BY 1,2",
    "pc": "SELECT a.patient, a.cid AS c1, b.cid AS c2, corr(a.m, b.m) AS r FROM ct a JOIN ct b ON a.patient=b.patient AND a.t=b.t AND a.cid<b.cid GROUP BY 1,2,3",
    "big": "SELECT hs.* FROM hs JOIN comp USING (patient, flat_idx) JOIN sm ON sm.patient=hs.patient AND largest_cid=cid",
    "fc": "SELECT a.patient, a.flat_idx, COUNT(CASE WHEN b.x<>a.x THEN 1 END) AS fx, COUNT(CASE WHEN b.y<>a.y THEN 1 END) AS fy, COUNT(CASE WHEN b.z<>a.z THEN 1 END) AS fz FROM big a LEFT JOIN big b "
    "ON a.patient=b.patient AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1 GROUP BY 1,2",
    "sh": f"SELECT patient, {math.pi ** (1 / 3)!r}::DOUBLE*pow(60.0::DOUBLE*COUNT(*), 2.0::DOUBLE/3.0::DOUBLE)/SUM((2-fx)*5.0+(2-fy)*5.0+(2-fz)*4.0) AS sphericity FROM fc GROUP BY 1",
    "ph": "SELECT p.patient, COALESCE(n_components,0) AS n_components, COALESCE(n_significant,0) AS n_significant, COALESCE(total_mm3,0) AS total_mm3, largest_fraction, sphericity, r_intra_mean, r_inter_mean, "
    "COALESCE(nv,0) AS n_voxels_used FROM (SELECT DISTINCT patient FROM series) p LEFT JOIN sm USING (patient) LEFT JOIN sh USING (patient) LEFT JOIN "
    "(SELECT patient, AVG(r) AS r_intra_mean, SUM(n) AS nv FROM ci GROUP BY 1) i USING (patient) LEFT JOIN (SELECT patient, AVG(r) AS r_inter_mean FROM pc GROUP BY 1) j USING (patient)",
}
_SGRID = type(GRID)(5, 5, 5, fx.VX, fx.VY, fx.VZ)


def _spot(spark, sf):
    return fx.series(spark, sf).where(f"{_SPOT} AND patient%3<>1")


def _pq(name: str, cols: str, body: str):
    return query(name, cols, recursive(fx.with_views(body, "slong", extra=_PHENO)))


@_pq(
    "f14_phenotype",
    "patient:i phenotype n_components:i n_significant:i total_mm3:d1 n_voxels_used:i largest_fraction:d4 sphericity:d4 r_intra_mean:d4 r_inter_mean:d4",
    "SELECT *, CASE WHEN n_components=0 THEN 'empty' WHEN n_significant=0 THEN 'subthreshold' WHEN n_significant>=2 AND COALESCE(sphericity<0.35, TRUE) THEN 'multifocal' "
    "WHEN COALESCE(sphericity>=0.40, TRUE) AND COALESCE(r_intra_mean>=0.30, TRUE) THEN 'compact' ELSE 'diffuse' END AS phenotype FROM ph",
)
def phenotype(spark, sf):
    """Phenotype of each patient's hotspot; every third patient has none."""
    return H.phenotype(fx.series(spark, sf), _spot(spark, sf), fx.series(spark, sf), KEYS, _SGRID, 20.0)


@_pq("j9_hotspot_series_lookup", "patient:i flat_idx:i cid:i first_value:d6", "SELECT c.patient, c.flat_idx, cid, ts[1] AS first_value FROM comp c JOIN series s ON s.patient=c.patient AND s.flat_idx=c.flat_idx")
def series_lookup(spark, sf):
    labels = S.connected_components(_spot(spark, sf), KEYS, _SGRID, 26)
    series = fx.series(spark, sf).select("patient", "flat_idx", F.get("ts", F.lit(0)).alias("first_value"))
    return labels.join(series, ["patient", "flat_idx"])


@_pq("j11_component_pair_correlation", "patient:i r_inter_mean:d6", "SELECT patient, AVG(r) AS r_inter_mean FROM pc GROUP BY 1")
def component_pairs(spark, sf):
    """Mean correlation over all pairs of component mean series, without forming pairs."""
    labels = cut_lineage(S.connected_components(_spot(spark, sf), KEYS, _SGRID, 26))
    large = H.component_sizes(labels, KEYS, _SGRID, 20.0).where("significant").select("patient", "cid")
    members = labels.join(large, ["patient", "cid"], "left_semi").select("patient", "cid", "flat_idx")
    members = members.join(fx.series(spark, sf).select("patient", "flat_idx", "ts"), ["patient", "flat_idx"])
    means = H.coherence(members, ["patient", "cid"])
    pairs = H.coherence(means, ["patient"], "mean_ts").where("r_intra IS NOT NULL")
    return pairs.withColumnRenamed("r_intra", "r_inter_mean")


# ---- follow-up -----------------------------------------------------------------------------

_PROG = {
    **FOLLOWUP_SQL,
    "hp": "SELECT patient, flat_idx FROM vm WHERE p>=0.62 AND brain",
    "nh": "SELECT patient, COUNT(*) AS n_hotspot FROM hp GROUP BY 1",
    "bl": "SELECT patient, flat_idx FROM en WHERE visit=1995 AND enh",
    "pg": "SELECT en.patient, en.visit, COUNT(CASE WHEN enh THEN 1 END) AS n_enh, COUNT(CASE WHEN enh AND bl.flat_idx IS NULL THEN 1 END) AS n_new, "
    "COUNT(CASE WHEN enh AND bl.flat_idx IS NULL AND hp.flat_idx IS NOT NULL THEN 1 END) AS overlap FROM en LEFT JOIN bl ON bl.patient=en.patient AND bl.flat_idx=en.flat_idx "
    "LEFT JOIN hp ON hp.patient=en.patient AND hp.flat_idx=en.flat_idx WHERE visit>1995 GROUP BY 1,2",
}
_PROG_COLS = "patient:i visit:i n_enh:i n_new:i overlap:i fraction_new:d4 fraction_predicted:d4 dice:d4"
_PROG_BODY = (
    "SELECT pg.*, round_even(n_new/CAST(NULLIF(n_enh,0) AS DOUBLE),4) AS fraction_new, CASE WHEN n_new>0 AND n_hotspot>0 THEN round_even(overlap/CAST(n_new AS DOUBLE),4) END AS fraction_predicted, "
    "CASE WHEN n_new>0 AND n_hotspot>0 THEN round_even(2.0*overlap/CAST(n_new+n_hotspot AS DOUBLE),4) END AS dice FROM pg LEFT JOIN nh USING (patient)"
)


def _progression(spark, sf):
    enh = cut_lineage(M.enhancement(cut_lineage(followup_table(spark, sf)), ["patient", "visit"], "v", wm="wm"))
    return FU.progression(enh, fx.vox_mask(spark, sf).where(SUPRA), KEYS, 1995)


@query("e21_followup_progression", _PROG_COLS, fx.with_views(_PROG_BODY, "vm", "followup", extra=_PROG))
def progression(spark, sf):
    """New enhancement against the hotspot at every visit after the baseline."""
    return _progression(spark, sf)


@query("a20_followup_record", "patient:i visit:i n_enh:i n_new:i fraction_new:d4", fx.with_views(_PROG_BODY, "vm", "followup", extra=_PROG))
def followup_record(spark, sf):
    return _progression(spark, sf)


@query(
    "u3_new_enhancement",
    "patient:i visit:i flat_idx:i",
    fx.with_views(
        "SELECT en.patient, en.visit, en.flat_idx FROM en LEFT JOIN bl ON bl.patient=en.patient AND bl.flat_idx=en.flat_idx WHERE visit>1995 AND enh AND bl.flat_idx IS NULL",
        "vm",
        "followup",
        extra=_PROG,
    ),
)
def new_enhancement(spark, sf):
    enh = cut_lineage(M.enhancement(cut_lineage(followup_table(spark, sf)), ["patient", "visit"], "v", wm="wm"))
    return FU.new_enhancement(enh, KEYS, 1995).where("is_new")
