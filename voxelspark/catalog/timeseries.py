"""Registered queries: series transforms, features, spectra, smoothing and quality control."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import arrays as A, series as TS, spectrum
from ..operators import masks as M, quality as Q, spatial as S
from ..session import cut_lineage
from .registry import query
from .voxels import FOLLOWUP_SQL  # noqa: F401  (shared view used by the hotspot area)

TR = 1.8
K = ["patient"]
IDS = "patient:i flat_idx:i"
# two checks per array: plain sum would hide reordering, so a weighted sum is compared
_W = "list_sum(list_transform({a}, lambda v, i: v*((i*7)%11+1)))"


def _series(spark, sf):
    return fx.series(spark, sf)


def _check(df, col="ts", out="ws"):
    return df.withColumn(out, A.total(F.transform(col, lambda v, i: v * (((i + 1) * 7) % 11 + 1))))


def _sq(name, cols, body, **extra):
    return query(name, cols, fx.with_views(body, "slong", extra=extra))


def _ws(expr: str, table: str = "slong") -> str:
    return f"SELECT patient, flat_idx, SUM({expr}*(((t+1)*7)%11+1)) AS ws FROM {table} GROUP BY 1,2"


@_sq("f1_ts_raw", f"{IDS} ws:d6", _ws("v"))
def ts_raw(spark, sf):
    return _check(_series(spark, sf).transform(TS.representation("ts_raw")))


_Z = {
    "zs": "SELECT *, AVG(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM slong WINDOW w AS (PARTITION BY patient, flat_idx)",
}


@_sq("f2_ts_normalized", f"{IDS} ws:d6", _ws("(v-m)/(s+1e-6)", "zs"), **_Z)
def ts_normalized(spark, sf):
    return _check(_series(spark, sf).transform(TS.representation("ts_normalized")))


@query(
    "p12_row_zscores",
    f"{IDS} eps:d6 unit:d6 nan_:d6 flat:d6",
    fx.with_views(
        "SELECT patient, flat_idx, SUM(CASE WHEN s>0 THEN (v-m)/(s+1e-6) ELSE 0 END*w) AS eps, SUM((v-m)/CASE WHEN s=0 THEN 1 ELSE s END*w) AS unit, "
        "SUM(CASE WHEN t<>5 THEN (v-m5)/(s5+1e-6)*w END) AS nan_, SUM(CASE WHEN s>1e-12 THEN (v-m)/s ELSE 0 END*w) AS flat FROM "
        "(SELECT *, ((t+1)*7)%11+1 AS w, AVG(v) OVER p AS m, stddev_pop(v) OVER p AS s, AVG(CASE WHEN t<>5 THEN v END) OVER p AS m5, "
        "stddev_pop(CASE WHEN t<>5 THEN v END) OVER p AS s5 FROM sl WINDOW p AS (PARTITION BY patient, flat_idx)) GROUP BY 1,2",
        "slong",
        extra={"sl": "SELECT patient, flat_idx, t, CASE WHEN flat_idx%10=0 THEN 7.0::DOUBLE ELSE v END AS v FROM slong"},
    ),
)
def row_zscores(spark, sf):
    """Four row normalisations; every tenth row is constant and one frame is NaN for the third."""
    df = _series(spark, sf)
    df = df.withColumn("ts", F.transform("ts", lambda v: F.when(F.col("flat_idx") % 10 == 0, 7.0).otherwise(v)))
    holed = F.transform("ts", lambda v, i: F.when(i == 5, float("nan")).otherwise(v))
    for name, fn, col in (
        ("eps", TS.zscore_eps, F.col("ts")),
        ("unit", TS.zscore_unit, F.col("ts")),
        ("nan_", TS.zscore_nan, holed),
        ("flat", TS.zscore_flat, F.col("ts")),
    ):
        df = df.withColumn("_z", F.transform(fn(col), lambda v: F.nanvl(v, F.lit(0.0))))
        df = _check(df, "_z", name)
    return df


_DT = {
    "lin": "SELECT patient, flat_idx, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM slong GROUP BY 1,2",
    "dt": "SELECT patient, flat_idx, t, v - a - b*t AS v FROM slong JOIN lin USING (patient, flat_idx)",
}


@_sq("f3_detrend", f"{IDS} ws:d6", _ws("v", "dt"), **_DT)
def detrend(spark, sf):
    return _check(_series(spark, sf).withColumn("ts", TS.detrend(F.col("ts"))))


def _kernel(sigma: float, radius: int) -> str:
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({k-radius}, {v/sum(w)!r}::DOUBLE)" for k, v in enumerate(w)) + ") q(k, w)"


def _conv(source: str, kernel: str, repeat: bool) -> str:
    if repeat:
        j = "CASE WHEN t+k<0 THEN -1-(t+k) WHEN t+k>63 THEN 127-(t+k) ELSE t+k END"
    else:
        j = "CASE WHEN t+k<0 THEN -(t+k) WHEN t+k>63 THEN 126-(t+k) ELSE t+k END"
    return (
        f"SELECT o.patient, o.flat_idx, o.t, SUM(o.w*s.v) AS v FROM (SELECT patient, flat_idx, t, w, {j} AS j FROM {source}, {kernel}) o "
        f"JOIN {source} s ON s.patient=o.patient AND s.flat_idx=o.flat_idx AND s.t=o.j GROUP BY 1,2,3"
    )


_G05 = {"k05": _kernel(0.5, 2), "g05": _conv("slong", "k05", True)}


@_sq("f4_temporal_gaussian_half", f"{IDS} ws:d6", _ws("v", "g05"), **_G05)
def gaussian_half(spark, sf):
    return _check(_series(spark, sf).withColumn("ts", TS.gaussian_samples(F.col("ts"), 0.5)))


@_sq("f4_temporal_gaussian_one", f"{IDS} ws:d6", _ws("v", "g1"), k1=_kernel(1.0, 4), g1=_conv("slong", "k1", True))
def gaussian_one(spark, sf):
    return _check(_series(spark, sf).withColumn("ts", TS.gaussian_samples(F.col("ts"), 1.0)))


@_sq(
    "f5_ts_preprocessed",
    f"{IDS} ws:d5",
    _ws("(v-m)/(s+1e-6)", "pz"),
    **_DT,
    k1=_kernel(1.0, 4),
    pg=_conv("dt", "k1", True),
    pz="SELECT *, AVG(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM pg WINDOW w AS (PARTITION BY patient, flat_idx)",
)
def ts_preprocessed(spark, sf):
    return _check(_series(spark, sf).transform(TS.representation("ts_preprocessed")))


_G3 = {"k3": _kernel(3.0 / TR, 5), "g3": _conv("slong", "k3", False)}


@_sq("f6_temporal_gaussian_seconds", f"{IDS} ws:d6", _ws("v", "g3"), **_G3)
def gaussian_seconds(spark, sf):
    return _check(_series(spark, sf).withColumn("ts", TS.gaussian_seconds(F.col("ts"), 3.0, TR)))


_REF = "SELECT patient, t, COALESCE(AVG(CASE WHEN wm THEN v END), AVG(v)) AS r FROM slong GROUP BY 1,2"


@_sq("a18_reference_series", "patient:i t:i r:d6", "SELECT * FROM ref", ref=_REF)
def reference(spark, sf):
    """White-matter mean series without exploding the frames."""
    ref = TS.reference_series(_series(spark, sf), K)
    return ref.select("patient", F.posexplode("ref").alias("t", "r"))


def _features_a_sql(source: str) -> dict[str, str]:
    return {
        "ref": _REF,
        "fc": f"SELECT s.patient, s.flat_idx, s.t, s.v, r.r, s.v-AVG(s.v) OVER w AS n, AVG(s.v) OVER w AS m FROM {source} s JOIN ref r ON r.patient=s.patient AND r.t=s.t WINDOW w AS (PARTITION BY s.patient, s.flat_idx)",
        "fm": "SELECT patient, flat_idx, MIN(n) AS dip, arg_min(t, n) AS tm, sqrt(AVG(n*n)) AS sd, corr(v, r) AS cr, SUM(LEAST(n,0)) AS an, SUM(GREATEST(n,0)) AS ap FROM fc GROUP BY 1,2",
        "fr": "SELECT fc.patient, fc.flat_idx, MIN(fc.t-tm) AS j FROM fc JOIN fm USING (patient, flat_idx) WHERE fc.t>=tm AND n>0.5*dip GROUP BY 1,2",
        "fa": "SELECT fm.patient, fm.flat_idx, sd AS std, dip AS dip_min, tm AS t_min, tm*1.8 AS t_min_sec, CASE WHEN tm>0 THEN dip/(tm*1.8) ELSE 0 END AS slope_down, "
        "CASE WHEN tm<63 THEN -dip/((63-tm)*1.8) ELSE 0 END AS slope_up, an AS auc_neg, ap AS auc_pos, "
        "CASE WHEN tm<63 THEN COALESCE(j*1.8, (64-tm)*1.8) ELSE 0 END AS t_rise, CASE WHEN sd>1e-9 THEN cr ELSE 0 END AS corr_tpl FROM fm LEFT JOIN fr USING (patient, flat_idx)",
    }


FA_COLS = f"{IDS} " + " ".join(f"{c}:d6" for c in TS.FEATURES_A)


@_sq("f7_bold_features_a", FA_COLS, "SELECT * FROM fa", **_features_a_sql("slong"))
def features_a(spark, sf):
    """Ten mean-centred features per voxel."""
    return TS.bold_feature_table(_series(spark, sf), K, TR)


@_sq("f8_representation_bold_features", FA_COLS, "SELECT * FROM fa", **_G05, **_features_a_sql("g05"))
def representation_smooth(spark, sf):
    """The representation that smooths before the features."""
    return _series(spark, sf).transform(TS.representation("bold_features"))


@_sq("x1_representation_registry", FA_COLS, "SELECT * FROM fa", **_features_a_sql("slong"))
def representation_alias(spark, sf):
    """Extractors by name; the longer names give the same ten features."""
    return _series(spark, sf).transform(TS.representation("full_17"))


_FB = {
    "b0": "SELECT patient, flat_idx, quantile_cont(v, 0.2) + 1e-6 AS s0 FROM slong GROUP BY 1,2",
    "b1": "SELECT patient, flat_idx, t, (v-s0)/s0 AS n FROM slong JOIN b0 USING (patient, flat_idx)",
    "b2": "SELECT patient, flat_idx, MIN(n) AS lo, arg_min(t, n) AS m, stddev_pop(n) AS sd, 1.8*(SUM(LEAST(n,0))-SUM(CASE WHEN t IN (0,63) THEN LEAST(n,0) ELSE 0 END)/2) AS an, "
    "1.8*(SUM(GREATEST(n,0))-SUM(CASE WHEN t IN (0,63) THEN GREATEST(n,0) ELSE 0 END)/2) AS ap FROM b1 GROUP BY 1,2",
    "b3": "SELECT b2.*, GREATEST(m-3,0) AS l, LEAST(m+3,63) AS r FROM b2",
    "b4": "SELECT b3.patient, b3.flat_idx, MIN(CASE WHEN t>=m AND n>=0 THEN t-m END) AS j, MAX(CASE WHEN t=l THEN n END) AS nl, MAX(CASE WHEN t=r THEN n END) AS nr FROM b3 JOIN b1 USING (patient, flat_idx) GROUP BY 1,2",
    "b5": "SELECT patient, t, AVG(v) AS r FROM slong GROUP BY 1,2",
    "b6": "SELECT patient, AVG(r) AS rm, stddev_pop(r)+1e-6 AS rs FROM b5 GROUP BY 1",
    "b7": "SELECT b1.patient, b1.flat_idx, SUM((n-nm)/(ns+1e-6)*(b5.r-rm)/rs)/64 AS cr FROM (SELECT *, AVG(n) OVER w AS nm, stddev_pop(n) OVER w AS ns FROM b1 WINDOW w AS (PARTITION BY patient, flat_idx)) b1 "
    "JOIN b5 USING (patient, t) JOIN b6 USING (patient) GROUP BY 1,2",
    "fb": "SELECT patient, flat_idx, lo AS dip_min, m AS t_min, (lo-nl)/(m-l+1e-6) AS slope_down, (nr-lo)/(r-m+1e-6) AS slope_up, an AS auc_neg, ap AS auc_pos, "
    "COALESCE(j*1.8, 0) AS t_rise, sd AS std, cr AS corr_tpl, m*1.8 AS t_min_sec FROM b3 JOIN b4 USING (patient, flat_idx) JOIN b7 USING (patient, flat_idx)",
}
FB_COLS = f"{IDS} " + " ".join(f"{c}:d6" for c in TS.FEATURES_B)


def features_b_table(spark, sf):
    return TS.templated_feature_table(_series(spark, sf), K, TR).drop("wm")


@_sq("f9_bold_features_b", FB_COLS, "SELECT * FROM fb", **_FB)
def features_b(spark, sf):
    """Ten features relative to the 20th percentile, with a template."""
    return features_b_table(spark, sf)


@_sq("f10_zscored_series", f"{IDS} ws:d6", _ws("(v-m)/CASE WHEN s=0 THEN 1 ELSE s END", "zs"), **_Z)
def zscored_series(spark, sf):
    return _check(_series(spark, sf).withColumn("ts", TS.zscore_unit(F.col("ts"))))


_DFT = {
    "basis": "SELECT t, k, cos(2*pi()*k*t/64) AS c, sin(2*pi()*k*t/64) AS s FROM (SELECT unnest(generate_series(0,63)) AS t), (SELECT unnest(generate_series(0,32)) AS k)",
    "cen": "SELECT patient, flat_idx, t, v-AVG(v) OVER (PARTITION BY patient, flat_idx) AS v FROM slong",
    "pw": "SELECT patient, flat_idx, k, k/(64*1.8) AS f, pow(SUM(v*c),2)+pow(SUM(v*s),2) AS p FROM cen JOIN basis USING (t) GROUP BY 1,2,3",
    "bd": "SELECT *, (p+1e-12)/SUM(p+1e-12) OVER (PARTITION BY patient, flat_idx) AS q, COUNT(*) OVER (PARTITION BY patient, flat_idx) AS nb FROM pw WHERE f>=0.01 AND f<=0.10",
    "sp": "SELECT bd.patient, bd.flat_idx, SUM(p) AS power_low, SUM(p)/(MAX(tot)+1e-12) AS power_ratio, arg_max(f, p) AS peak_freq, -SUM(q*ln(q))/ln(MAX(nb)) AS entropy, "
    "regr_slope(ln(p+1e-12), ln(f+1e-12)) AS slope FROM bd JOIN (SELECT patient, flat_idx, SUM(p) AS tot FROM pw WHERE k>=1 GROUP BY 1,2) USING (patient, flat_idx) GROUP BY 1,2",
}


@_sq("f11_low_band_spectrum", f"{IDS} power_low:d4 power_ratio:d6 peak_freq:d6 entropy:d6 slope:d5", "SELECT * FROM sp", **_DFT)
def low_band(spark, sf):
    """Five low-band spectral features per voxel."""
    return _series(spark, sf).select("patient", "flat_idx", spectrum.low_band_features(F.col("ts"), TR).alias("f")).select("patient", "flat_idx", "f.*")


_VQ = {
    **_DFT,
    "q1": "SELECT patient, flat_idx, AVG(v) AS m, stddev_pop(v) AS s, regr_slope(v, t*1.8) AS b, regr_syy(v, t*1.8)/64 AS vv, regr_sxx(v, t*1.8)/64 AS tt FROM slong GROUP BY 1,2",
    "q2": "SELECT patient, flat_idx, sqrt(AVG(d*d)) AS dv FROM (SELECT *, v-LAG(v) OVER (PARTITION BY patient, flat_idx ORDER BY t) AS d FROM slong) GROUP BY 1,2",
    "q3": "SELECT slong.patient, slong.flat_idx, COUNT(CASE WHEN abs((v-m)/s)>3 THEN 1 END) AS sp FROM slong JOIN q1 USING (patient, flat_idx) GROUP BY 1,2",
    "q4": "SELECT patient, flat_idx, SUM(CASE WHEN k>0 AND f<=0.10 THEN p END)/(SUM(p)+1e-12) AS lo FROM pw GROUP BY 1,2",
    "vf": "SELECT patient, flat_idx, CASE WHEN s>1e-9 THEN m/s ELSE 0 END AS tsnr, dv AS dvars_rms, sp AS n_spikes_z3, lo AS low_freq_power_ratio, b/m*6000 AS drift_pct_per_min, "
    "(m-AVG(m) OVER (PARTITION BY patient))/abs(AVG(m) OVER (PARTITION BY patient)) AS mean_amplitude_norm, vv-b*b*tt AS variance_detrended "
    "FROM q1 JOIN q2 USING (patient, flat_idx) JOIN q3 USING (patient, flat_idx) JOIN q4 USING (patient, flat_idx)",
    "al": "SELECT vf.*, CASE WHEN tsnr>=tg AND dvars_rms<=dg AND n_spikes_z3=0 AND abs(drift_pct_per_min)<1 THEN 1 "
    "WHEN tsnr<=tb AND (dvars_rms>=db OR n_spikes_z3>=3 OR abs(drift_pct_per_min)>5) THEN 0 ELSE -1 END AS quality FROM vf JOIN (SELECT patient, quantile_cont(tsnr,0.10) AS tb, "
    "quantile_cont(tsnr,0.66) AS tg, quantile_cont(dvars_rms,0.90) AS db, quantile_cont(dvars_rms,0.33) AS dg FROM vf GROUP BY 1) USING (patient)",
}


def quality_features(spark, sf):
    return Q.voxel_features(_series(spark, sf), K, tr=TR)


@_sq("f12_voxel_quality_features", f"{IDS} " + " ".join(f"{c}:d5" for c in Q.VOXEL_FEATURES), "SELECT * FROM vf", **_VQ)
def voxel_features(spark, sf):
    return quality_features(spark, sf)


@_sq("p32_quality_auto_labels", f"{IDS} quality:i", "SELECT * FROM al", **_VQ)
def auto_labels(spark, sf):
    return Q.auto_labels(cut_lineage(quality_features(spark, sf)), K)


@_sq(
    "f13_component_correlation",
    "patient:i label:i n:i r_mean:d6",
    "SELECT patient, label, MAX(n) AS n, (SUM(zs*zs)-SUM(zz))/(64.0*MAX(n)*(MAX(n)-1)) AS r_mean FROM (SELECT patient, label, t, SUM((v-m)/s) AS zs, SUM(pow((v-m)/s,2)) AS zz, COUNT(*) AS n FROM zs GROUP BY 1,2,3) GROUP BY 1,2 HAVING MAX(n)>1",
    **_Z,
)
def component_correlation(spark, sf):
    """Mean pairwise correlation of each group of voxels from sums alone."""
    from ..operators.hotspot import coherence

    return coherence(_series(spark, sf), ["patient", "label"]).where("n > 1").withColumnRenamed("r_intra", "r_mean")


@_sq(
    "f15_template_normalise",
    "patient:i t:i z:d6",
    "SELECT patient, t, (r-AVG(r) OVER (PARTITION BY patient))/(stddev_pop(r) OVER (PARTITION BY patient)+1e-6) AS z FROM (SELECT patient, t, AVG(v) AS r FROM slong GROUP BY 1,2)",
)
def template(spark, sf):
    ref = TS.reference_series(_series(spark, sf), K, wm=None)
    return ref.select("patient", F.posexplode(TS.normalised_template(F.col("ref"))).alias("t", "z"))


@_sq(
    "f16_smoothing_chain",
    f"{IDS} ws:d6",
    _ws("v", "g3"),
    ks="SELECT * FROM (VALUES "
    + ", ".join(f"({d}, {math.exp(-0.5 * (d / (2.5 / 2.3548 / 2.0)) ** 2)!r}::DOUBLE, {math.exp(-0.5 * (d / (2.5 / 2.3548 / 2.5)) ** 2)!r}::DOUBLE)" for d in range(-2, 3))
    + ") k(d, wxy, wz)",
    sm="SELECT a.patient, a.flat_idx, b.t, SUM(kx.wxy*ky.wxy*kz.wz*b.v)/SUM(kx.wxy*ky.wxy*kz.wz) AS v FROM series a JOIN slong b ON a.patient=b.patient "
    "AND abs(a.x-b.x)<=2 AND abs(a.y-b.y)<=2 AND abs(a.z-b.z)<=2 JOIN ks kx ON kx.d=b.x-a.x JOIN ks ky ON ky.d=b.y-a.y JOIN ks kz ON kz.d=b.z-a.z GROUP BY 1,2,3",
    k3=_kernel(3.0 / TR, 5),
    g3=_conv("sm", "k3", False),
)
def smoothing_chain(spark, sf):
    """Spatial smoothing of whole series, then temporal smoothing."""
    df = _series(spark, sf)
    smoothed = S.gaussian_smooth(df, K, (fx.VX, fx.VY, fx.VZ), "ts", block=4)
    out = smoothed.withColumn("flat_idx", F.expr("CAST(x*25+y*5+z AS BIGINT)"))
    return _check(out.withColumn("ts", TS.gaussian_seconds(F.col("ts"), 3.0, TR)))


# ---- vessel exclusion and quality ----------------------------------------------------------

_VX = {
    "mt": "SELECT patient, flat_idx, label<8 AS brain, CASE WHEN label<8 THEN stddev_pop(v) ELSE 0 END AS tstd FROM slong GROUP BY patient, flat_idx, label",
    "th": "SELECT patient, quantile_cont(tstd, 0.9) AS threshold, quantile_cont(tstd,0.5) AS p50, quantile_cont(tstd,0.95) AS p95, quantile_cont(tstd,0.99) AS p99, MIN(tstd) AS mn, MAX(tstd) AS mx FROM mt WHERE brain AND tstd>0 GROUP BY 1",
}


def _vessels(spark, sf):
    df = _series(spark, sf).withColumns({"brain": F.expr("label < 8"), "tstd": A.std(F.col("ts"))})
    return M.vessel_exclusion(df.select("patient", "flat_idx", "brain", "ts", "tstd"), K, "tstd", 90.0)


@_sq(
    "p20_vessel_exclusion",
    f"{IDS} tstd:d6 excluded:b keep:b kept_sum:d6",
    "SELECT mt.*, tstd>=threshold AND brain AS excluded, brain AND NOT (tstd>=threshold) AS keep, CASE WHEN brain AND NOT (tstd>=threshold) THEN sv ELSE 0 END AS kept_sum "
    "FROM mt JOIN th USING (patient) JOIN (SELECT patient, flat_idx, SUM(v) AS sv FROM slong GROUP BY 1,2) USING (patient, flat_idx)",
    **_VX,
)
def vessels(spark, sf):
    """Voxels of the highest temporal deviation, their series zeroed."""
    df, _ = _vessels(spark, sf)
    cleaned = F.transform("ts", lambda v: F.when(F.col("keep"), v).otherwise(0.0))
    return df.withColumn("kept_sum", A.total(cleaned))


@_sq(
    "p20_vessel_statistics",
    "patient:i threshold:d6 voxels_total:i voxels_keep:i voxels_removed:i fraction_removed:d6 p50:d6 p95:d6 p99:d6 mn:d6 mx:d6",
    "SELECT patient, MAX(threshold) AS threshold, COUNT(CASE WHEN brain THEN 1 END) AS voxels_total, COUNT(CASE WHEN brain AND tstd<threshold THEN 1 END) AS voxels_keep, "
    "COUNT(CASE WHEN brain AND tstd>=threshold THEN 1 END) AS voxels_removed, COUNT(CASE WHEN brain AND tstd>=threshold THEN 1 END)/CAST(COUNT(CASE WHEN brain THEN 1 END) AS DOUBLE) AS fraction_removed, "
    "MAX(p50) AS p50, MAX(p95) AS p95, MAX(p99) AS p99, MAX(mn) AS mn, MAX(mx) AS mx FROM mt JOIN th USING (patient) GROUP BY 1",
    **_VX,
)
def vessel_statistics(spark, sf):
    return _vessels(spark, sf)[1].withColumnsRenamed({"min": "mn", "max": "mx"})


@_sq(
    "a11_patient_tsnr",
    "patient:i tsnr_mean:d6 tsnr_median:d6",
    "SELECT patient, AVG(r) AS tsnr_mean, quantile_cont(r, 0.5) AS tsnr_median FROM (SELECT patient, flat_idx, AVG(v)/stddev_samp(v) AS r FROM slong GROUP BY 1,2 HAVING stddev_samp(v)>1e-8) GROUP BY 1",
)
def patient_tsnr(spark, sf):
    return Q.tsnr(_series(spark, sf), K)


_DV = {
    "dd": "SELECT patient, t, v-LAG(v) OVER (PARTITION BY patient, flat_idx ORDER BY t) AS d FROM slong",
    "dv": "SELECT patient, t, sqrt(AVG(d*d)) AS dvars FROM dd WHERE d IS NOT NULL GROUP BY 1,2",
}


@_sq("a12_dvars", "patient:i t:i dvars:d6", "SELECT * FROM dv", **_DV)
def dvars(spark, sf):
    return Q.dvars(_series(spark, sf), K)


_SPK = (
    "SELECT patient, AVG(dvars) AS dvars_mean, MAX(dvars) AS dvars_max, COUNT(CASE WHEN z>3 THEN 1 END) AS n_spikes_z3 FROM "
    "(SELECT *, (dvars-AVG(dvars) OVER (PARTITION BY patient))/stddev_pop(dvars) OVER (PARTITION BY patient) AS z FROM dv) GROUP BY 1"
)


@_sq("a13_spikes", "patient:i dvars_mean:d6 dvars_max:d6 n_spikes_z3:i", _SPK, **_DV)
def spikes(spark, sf):
    return Q.dvars_summary(Q.dvars(_series(spark, sf), K), K)


_DRIFT = (
    "SELECT patient, 6000.0*regr_slope(g, t*1.8)/regr_intercept(g, t*1.8) AS drift_pct_per_min, COUNT(*) AS n_volumes FROM (SELECT patient, t, AVG(v) AS g FROM slong GROUP BY 1,2) GROUP BY 1"
)


@_sq("a14_drift", "patient:i n_volumes:i drift_pct_per_min:d6", _DRIFT)
def drift(spark, sf):
    return Q.drift(Q.global_signal(_series(spark, sf), K), K, TR)


_FD = {
    "fd": "SELECT patient, t, abs(tx-LAG(tx) OVER w)+abs(ty-LAG(ty) OVER w)+abs(tz-LAG(tz) OVER w)+50*(abs(rx-LAG(rx) OVER w)+abs(ry-LAG(ry) OVER w)+abs(rz-LAG(rz) OVER w)) AS fd "
    "FROM motion WINDOW w AS (PARTITION BY patient ORDER BY t)"
}


@query("a15_framewise_displacement", "patient:i t:i fd:d6", fx.with_views("SELECT * FROM fd WHERE fd IS NOT NULL", "motion", extra=_FD))
def displacement(spark, sf):
    """Framewise displacement; long recordings are cut into chunks."""
    return Q.displacement(fx.motion(spark, sf), K)


@query(
    "a15_displacement_summary",
    "patient:i fd_mean:d6 fd_max:d6 fd_pct:d6",
    fx.with_views(
        "SELECT patient, AVG(fd) AS fd_mean, MAX(fd) AS fd_max, 100.0*AVG(CAST(fd>0.5 AS INT)) AS fd_pct FROM fd WHERE fd IS NOT NULL GROUP BY 1", "motion", extra=_FD
    ),
)
def displacement_summary(spark, sf):
    return Q.displacement_summary(Q.displacement(fx.motion(spark, sf), K), K)


_EV = "SELECT *, voxel%10 AS x, voxel%7 AS y, voxel%4 AS z, CASE WHEN t%9=4 THEN 0 ELSE value END AS w FROM events_long"


@query(
    "a16_centroid_displacement",
    "patient:i t:i fd:d6",
    fx.with_views(
        "SELECT patient, t, fd FROM (SELECT *, sqrt(pow(cx-LAG(cx) OVER o,2)+pow(cy-LAG(cy) OVER o,2)+pow(cz-LAG(cz) OVER o,2)) AS fd FROM "
        "(SELECT patient, t, COALESCE(LAST_VALUE(a IGNORE NULLS) OVER o2,0) AS cx, COALESCE(LAST_VALUE(b IGNORE NULLS) OVER o2,0) AS cy, COALESCE(LAST_VALUE(c IGNORE NULLS) OVER o2,0) AS cz FROM "
        "(SELECT patient, t, CASE WHEN SUM(w)>0 THEN SUM(x*w)/SUM(w)*2.0 END AS a, CASE WHEN SUM(w)>0 THEN SUM(y*w)/SUM(w)*2.0 END AS b, CASE WHEN SUM(w)>0 THEN SUM(z*w)/SUM(w)*2.5 END AS c FROM ev GROUP BY 1,2) "
        "WINDOW o2 AS (PARTITION BY patient ORDER BY t ROWS UNBOUNDED PRECEDING)) WINDOW o AS (PARTITION BY patient ORDER BY t)) WHERE fd IS NOT NULL",
        "events_long",
        extra={"ev": _EV},
    ),
)
def centroid(spark, sf):
    """Centroid movement; frames without signal keep the last centroid."""
    ev = fx.events_long(spark, sf).selectExpr("*", "voxel%10 AS x", "voxel%7 AS y", "voxel%4 AS z", "CASE WHEN t%9=4 THEN 0 ELSE value END AS w")
    return Q.centroid_displacement(ev, K, (2.0, 2.0, 2.5), "w")


@query(
    "w6_frame_difference",
    "patient:i voxel:i t:i diff:d6",
    fx.with_views(
        "SELECT * FROM (SELECT patient, voxel, t, value-LAG(value) OVER (PARTITION BY patient, voxel ORDER BY t) AS diff FROM events_long) WHERE diff IS NOT NULL",
        "events_long",
    ),
)
def frame_difference(spark, sf):
    return Q.frame_differences(fx.events_long(spark, sf), ["patient", "voxel"])


@_sq(
    "e20_quality_record",
    "patient:i tsnr_mean:d3 tsnr_median:d3 fd_mean:d4 dvars_mean:d4 dvars_max:d4 n_spikes_z3:i drift_pct_per_min:d4 n_volumes:i n_voxels_healthy:i",
    "SELECT * FROM (SELECT patient, AVG(r) AS tsnr_mean, quantile_cont(r, 0.5) AS tsnr_median, COUNT(*) AS n_voxels_healthy FROM (SELECT patient, flat_idx, AVG(v)/stddev_samp(v) AS r FROM slong GROUP BY 1,2) GROUP BY 1) "
    f"JOIN ({_SPK}) USING (patient) JOIN ({_DRIFT}) USING (patient) LEFT JOIN (SELECT patient, AVG(fd) AS fd_mean FROM fd WHERE fd IS NOT NULL GROUP BY 1) USING (patient)",
    **_DV,
    motion=fx.SQL["motion"],
    **_FD,
)
def quality_record(spark, sf):
    """One rounded record per patient."""
    return Q.quality_record(_series(spark, sf), K, Q.displacement(fx.motion(spark, sf), K), TR)


# ---- ghost bands ---------------------------------------------------------------------------

_PROF = {
    "pf": "SELECT patient, y, AVG(p) AS profile FROM vm GROUP BY 1,2",
    "ps": "SELECT patient, AVG(profile) AS profile_mean, AVG(profile)+2*stddev_pop(profile) AS threshold, stddev_pop(profile) AS profile_std FROM pf GROUP BY 1",
    "pk": "SELECT pf.patient, pf.y, MAX(pf.profile) OVER (PARTITION BY pf.patient ORDER BY pf.y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak, "
    "COUNT(*) OVER (PARTITION BY pf.patient) AS ny, ROW_NUMBER() OVER (PARTITION BY pf.patient ORDER BY pf.y)-1 AS i FROM pf",
    "hit": "SELECT pk.patient, i, round_even(peak/(profile_mean+1e-9),4) AS peak_ratio FROM pk JOIN ps USING (patient) WHERE peak>threshold AND i>=2 AND i<ny-2",
    "scan": "SELECT patient, MIN(i) AS i FROM hit GROUP BY 1 UNION ALL SELECT s.patient, (SELECT MIN(h.i) FROM hit h WHERE h.patient=s.patient AND h.i>=s.i+4) FROM scan s "
    "WHERE EXISTS (SELECT 1 FROM hit h WHERE h.patient=s.patient AND h.i>=s.i+4)",
    "band": "SELECT s.patient, s.i AS band, h.peak_ratio, threshold, profile_mean FROM scan s JOIN hit h ON h.patient=s.patient AND h.i=s.i JOIN ps ON ps.patient=s.patient",
}


def _recursive(body: str) -> str:
    return fx.with_views(body, "vm", extra=_PROF).replace("WITH ", "WITH RECURSIVE ", 1)


@query("a17_axis_profile", "patient:i y:i profile:d6 threshold:d6", fx.with_views("SELECT * FROM pf JOIN ps USING (patient)", "vm", extra={k: _PROF[k] for k in ("pf", "ps")}))
def axis_profile(spark, sf):
    return Q.axis_profile(fx.vox_mask(spark, sf), K, "y", "p")


@query("w7_greedy_band_scan", "patient:i band:i peak_ratio:d4", _recursive("SELECT * FROM band"))
def band_scan(spark, sf):
    return Q.scan_bands(Q.axis_profile(fx.vox_mask(spark, sf), K, "y", "p"), K, "y")


@query(
    "k2_top_bands",
    "patient:i rank_:i band:i peak_ratio:d4",
    _recursive("SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY peak_ratio DESC, band DESC) AS rank_ FROM band) WHERE rank_<=1"),
)
def top_bands(spark, sf):
    bands = Q.scan_bands(Q.axis_profile(fx.vox_mask(spark, sf), K, "y", "p"), K, "y")
    return Q.top_bands(bands, K, 1).withColumnRenamed("rank", "rank_")


_PROF3 = {
    **_PROF,
    "pk": _PROF["pk"].replace("2 PRECEDING AND 2 FOLLOWING", "1 PRECEDING AND 1 FOLLOWING"),
    "hit": _PROF["hit"].replace("i>=2 AND i<ny-2", "i>=1 AND i<ny-1"),
    "scan": _PROF["scan"].replace("s.i+4", "s.i+2"),
    "bo": "SELECT *, COUNT(*) OVER (PARTITION BY patient) AS n, ROW_NUMBER() OVER (PARTITION BY patient ORDER BY peak_ratio DESC, band DESC) AS strong FROM band",
    "bl": "SELECT patient, COUNT(*) AS n_bands, string_agg(CAST(band AS VARCHAR), ',' ORDER BY CASE WHEN n>{n} THEN strong ELSE band END) AS bands, "
    "string_agg(CAST(CAST(round(peak_ratio*10000) AS BIGINT) AS VARCHAR), ',' ORDER BY CASE WHEN n>{n} THEN strong ELSE band END) AS ratios FROM bo WHERE n<={n} OR strong<={n} GROUP BY 1",
}


def _ghost(n: int) -> str:
    extra = {k: v.replace("{n}", str(n)) for k, v in _PROF3.items()}
    body = "SELECT ps.*, COALESCE(n_bands, 0) AS n_bands, bands, ratios FROM ps LEFT JOIN bl USING (patient)"
    return fx.with_views(body, "vm", extra=extra).replace("WITH ", "WITH RECURSIVE ", 1)


_GHOST = "patient:i profile_mean:d6 profile_std:d6 threshold:d6 n_bands:i bands ratios"


def _ghost_rows(spark, sf, n):
    report = Q.ghost_report(fx.vox_mask(spark, sf), K, "y", "p", half_width=1, n_top=n)
    whole = F.transform("band_peak_ratios", lambda r: F.round(r * 10000).cast("long").cast("string"))
    return report.withColumns({"bands": F.array_join("band_indices", ","), "ratios": F.array_join(whole, ",")})


@query("e22_ghost_report", _GHOST, _ghost(5))
def ghost_report(spark, sf):
    """Bands in scan order with their peak ratios."""
    return _ghost_rows(spark, sf, 5)


@query("e22_ghost_report_strongest", _GHOST, _ghost(1))
def ghost_report_strongest(spark, sf):
    """More bands than wanted: the strongest, by falling ratio."""
    return _ghost_rows(spark, sf, 1)
