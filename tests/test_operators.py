"""Brute-force checks on small data, properties and degenerate cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.functions import arrays as A, series as TS, spectrum, tails
from voxelspark.operators import evaluation as E, followup as FU, grid as G, hotspot as H, learning as L
from voxelspark.operators import masks as M, quality as Q, ranking as R, sampling as P, spatial as S
from voxelspark.plans import clustering as PC
from voxelspark.sources import sinks, tables as T

KEYS = ["patient"]


def voxels(spark, points, patient=0):
    rows = [(patient, int(x), int(y), int(z)) for x, y, z in points]
    return spark.createDataFrame(rows, "patient int, x int, y int, z int")


def as_set(df):
    return {(r["x"], r["y"], r["z"]) for r in df.select("x", "y", "z").collect()}


def blob(seed, shape, share):
    return np.argwhere(np.random.default_rng(seed).random(shape) < share)


# ---- spatial -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 4])
def test_dilation_is_a_city_block_ball(spark, n):
    core = blob(1, (6, 6, 6), 0.05)
    want = {
        (x + i, y + j, z + k)
        for x, y, z in core
        for i in range(-n, n + 1)
        for j in range(-n, n + 1)
        for k in range(-n, n + 1)
        if abs(i) + abs(j) + abs(k) <= n
    }
    assert as_set(S.dilate(voxels(spark, core), KEYS, n)) == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_erosion_is_the_dual_of_dilation(spark, n):
    mask = {tuple(p) for p in blob(2, (9, 9, 9), 0.93)}
    ball = [(i, j, k) for i in range(-n, n + 1) for j in range(-n, n + 1) for k in range(-n, n + 1) if abs(i) + abs(j) + abs(k) <= n]
    want = {p for p in mask if all((p[0] + i, p[1] + j, p[2] + k) in mask for i, j, k in ball)}
    assert as_set(S.erode(voxels(spark, mask), KEYS, n)) == want


def test_distance_crosses_chunks(spark):
    src = np.array([[0, 0, 0], [70, 40, 3], [33, 65, 20]])
    tgt = np.random.default_rng(3).integers(0, 80, (200, 3))
    sp = np.array([2.0, 1.0, 2.5])
    got = {
        (r["x"], r["y"], r["z"]): r["dist"]
        for r in S.euclidean_distance(voxels(spark, tgt), voxels(spark, src), KEYS, tuple(sp)).collect()
    }
    for p in tgt:
        assert got[tuple(p)] == pytest.approx(np.sqrt((((p - src) * sp) ** 2).sum(axis=1)).min())


def test_distance_without_sources_is_null(spark):
    tgt = voxels(spark, [(1, 1, 1)]).unionByName(voxels(spark, [(2, 2, 2)], patient=1))
    rows = {r["patient"]: r["dist"] for r in S.euclidean_distance(tgt, voxels(spark, [(1, 1, 3)]), KEYS, (1, 1, 1)).collect()}
    assert rows[0] == pytest.approx(2.0) and rows[1] is None


@pytest.mark.parametrize("kind,share", [(6, 0.35), (18, 0.2), (26, 0.12)])
def test_components_match_flood_fill_across_blocks(spark, kind, share):
    mask = {tuple(int(v) for v in p) for p in blob(4, (17, 17, 17), share)}
    grid, steps = G.Grid(17, 17, 17), G.offsets(kind)
    want, seen = {}, set()
    for p in sorted(mask):
        if p in seen:
            continue
        stack, group = [p], []
        seen.add(p)
        while stack:
            q = stack.pop()
            group.append(q)
            for o in steps:
                n = (q[0] + o[0], q[1] + o[1], q[2] + o[2])
                if n in mask and n not in seen:
                    seen.add(n)
                    stack.append(n)
        low = min(x * 289 + y * 17 + z for x, y, z in group)
        want.update({q: low for q in group})
    shuffled = voxels(spark, mask).orderBy(F.rand(1)).repartition(5)
    got = {(r["x"], r["y"], r["z"]): r["cid"] for r in S.connected_components(shuffled, KEYS, grid, kind, block=5).collect()}
    assert got == want


def test_long_chain_of_components(spark):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(60)] + [(1, 5, 9)], "patient int, u long, v long")
    labels = S.merge_graph(links, KEYS).collect()
    assert {r["label"] for r in labels if r["patient"] == 0} == {0}
    assert {r["node"]: r["label"] for r in labels if r["patient"] == 1} == {5: 5, 9: 5}


def test_cube_surface(spark):
    cube = [(i, j, k) for i in range(3) for j in range(3) for k in range(3)]
    row = S.surface_area(voxels(spark, cube), KEYS, G.Grid(3, 3, 3, 1.0, 2.0, 3.0)).first()
    assert row["area_mm2"] == pytest.approx(2 * 9 * (2 * 3 + 1 * 3 + 1 * 2))


# ---- ranking -------------------------------------------------------------------------------


def test_prefix_with_a_hot_value_and_many_ranges(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full(400, 0.5), rng.random(600).round(2)])
    df = spark.createDataFrame([(0, float(x)) for x in v], "patient int, v double")
    table = R.value_prefix(df, KEYS, "v", {"n": F.count(F.lit(1))}, rows_per_range=3).collect()
    assert len({r["_range"] for r in table}) > 10
    for r in table:
        assert r["n_before"] == (v < r["v"]).sum() and r["n"] == (v == r["v"]).sum() and r["n_total"] == len(v)


def test_percentiles_equal_numpy(spark):
    v = np.random.default_rng(6).normal(size=501)
    df = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(v)], "patient int, v double")
    for r in R.exact_percentiles(df, KEYS, "v", {"a": 0.0, "b": 0.33, "c": 0.9, "d": 1.0}).collect():
        own = v[np.arange(501) % 3 == r["patient"]]
        assert [r[c] for c in "abcd"] == pytest.approx(np.percentile(own, [0, 33, 90, 100]))


@pytest.mark.parametrize("n", [1, 37, 999, 5000])
def test_choose_takes_the_first_by_hash(spark, n):
    df = spark.range(3000).withColumn("g", (F.col("id") % 10 == 0).cast("int"))
    got = {r["id"] for r in R.choose(df, ["g"], "id", n, 9).collect()}
    keyed = df.withColumn("h", F.md5(F.concat(F.lit("9:"), F.col("id").cast("string")))).collect()
    want = set()
    for g in (0, 1):
        want |= {r["id"] for r in sorted((r for r in keyed if r["g"] == g), key=lambda r: r["h"])[:n]}
    assert got == want


def test_bh_is_monotone_and_matches_the_loop(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {r["i"]: r["p_bh"] for r in E.adjust_p(df, [], "p").collect()}
    order, low, want = sorted(range(7), key=lambda i: p[i]), 1.0, {}
    for pos in range(6, -1, -1):
        low = min(low, p[order[pos]] * 7 / (pos + 1))
        want[order[pos]] = low
    assert got == pytest.approx(want)


# ---- evaluation ----------------------------------------------------------------------------


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = np.random.default_rng(7)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 12, 200) / 11
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    auc = E.ranked_metrics(E.score_table(df, []), []).first()["val_auc"]
    assert auc == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.2, 0.1), (1, 0.4, 0.3)], "y int, a double, b double")
    assert E.ranked_metrics(E.score_table(df, [], "y", "a"), [], "a").first()["val_auc"] is None
    assert E.delong(df, [], {"a": "a", "b": "b"}, [("a", "b")]).first()["z"] is None


def test_identical_scores_have_no_delong_z(spark):
    df = spark.createDataFrame([(i % 2, i / 10, i / 10) for i in range(10)], "y int, a double, b double")
    assert E.delong(df, [], {"a": "a", "b": "b"}, [("a", "b")]).first()["z"] is None


def test_signed_rank_without_differences(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0)], "g int, a double, b double")
    row = E.with_wilcoxon_p(E.wilcoxon(df, ["g"])).first()
    assert row["p_two_sided"] == 1.0 and row["w"] is None and row["median_diff"] == 0.0
    assert E.cohen_dz(df, ["g"]).first()["magnitude"] == "zero-variance"


def test_tails_against_tables(spark):
    lit = lambda v: F.lit(v).cast("double")
    row = spark.range(1).select(
        tails.normal_sf(lit(1.959964)).alias("z"), tails.normal_sf(lit(-1.0)).alias("low"), tails.normal_sf(lit(9.0)).alias("far"),
        tails.student_p(lit(2.228139), F.lit(10)).alias("t10"), tails.student_p(lit(12.706205), F.lit(1)).alias("t1"),
        tails.student_p(lit(2.093024), F.lit(19)).alias("t19"), tails.student_p(lit(1.961), F.lit(5000)).alias("many"),
        tails.student_critical(F.lit(10)).alias("c10"), tails.student_p(lit(float("nan")), F.lit(3)).alias("nan"),
        tails.wilcoxon_p(lit(8), F.lit(10), F.lit(0), F.lit(0)).alias("w"), tails.wilcoxon_p(lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("w0"),
        tails.wilcoxon_p(lit(8), F.lit(10), F.lit(6), F.lit(0)).alias("tied"),
    ).first()
    assert row["z"] == pytest.approx(0.025, rel=1e-6) and row["low"] == pytest.approx(0.8413447, abs=1e-6) and row["far"] == pytest.approx(1.128588e-19, rel=1e-5)
    assert [row[c] for c in ("t10", "t1", "t19")] == pytest.approx([0.05] * 3, abs=1e-6) and row["many"] == pytest.approx(0.04993, abs=1e-5)
    assert row["c10"] == pytest.approx(2.228139, abs=1e-5) and row["nan"] is None
    assert row["w"] == pytest.approx(0.048828125) and row["w0"] == 1.0 and row["tied"] == pytest.approx(0.0468, abs=5e-3)


def test_dice_is_symmetric(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in rng.random((300, 2))], "patient int, a double, b double")
    one = [r["dice"] for r in E.hotspot_dice(df, KEYS, "a", "b").orderBy("pct").collect()]
    two = [r["dice"] for r in E.hotspot_dice(df, KEYS, "b", "a").orderBy("pct").collect()]
    assert one == two


# ---- series --------------------------------------------------------------------------------


def series(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "i int, ts array<double>")


@pytest.mark.parametrize("repeat,mode", [(True, "symmetric"), (False, "reflect")])
def test_gaussian_edges_with_short_series(spark, repeat, mode):
    x = np.random.default_rng(9).normal(size=(3, 4))
    w = S.gaussian_kernel(1.5, 3)
    got = series(spark, x).select(TS.gaussian(F.col("ts"), 1.5, 3, repeat)).collect()
    for row, want in zip(got, x):
        assert row[0] == pytest.approx(np.convolve(np.pad(want, 3, mode=mode), w, "valid"))


def test_detrend_and_slope(spark):
    x = np.random.default_rng(10).normal(size=(4, 31)).cumsum(axis=1)
    t = np.arange(31)
    for row, v in zip(series(spark, x).select(TS.detrend(F.col("ts")), TS.trend_slope(F.col("ts"), 2.0)).collect(), x):
        b, a = np.polyfit(t, v, 1)
        assert row[0] == pytest.approx(v - a - b * t, abs=1e-9)
        assert row[1] == pytest.approx(b / 2.0)


def test_spectrum_of_a_sine(spark):
    t = np.arange(100) * 2.0
    got = series(spark, [np.sin(2 * np.pi * 0.05 * t)]).select(spectrum.low_band_features(F.col("ts"), 2.0)).first()[0]
    assert got["peak_freq"] == pytest.approx(0.05) and got["power_ratio"] == pytest.approx(1.0)


def test_empty_band_is_an_error(spark):
    with pytest.raises(Exception, match="low band"):
        series(spark, [[1, 2, 3, 4]]).select(spectrum.low_band_features(F.col("ts"), 0.1)).collect()


def test_flat_rows(spark):
    row = series(spark, [[5, 5, 5, 5]]).select(TS.zscore_flat(F.col("ts")), TS.zscore_unit(F.col("ts")), TS.zscore_eps(F.col("ts"))).first()
    assert all(v == 0.0 for part in row for v in part)


def test_features_of_an_early_dip(spark):
    df = series(spark, [[0.0, 4.0, 4.0, 4.0]])
    f = df.select(TS.features_a(F.col("ts"), F.col("ts"), 2.0)).first()[0]
    assert f["t_min"] == 0 and f["slope_down"] == 0 and f["t_rise"] == 2.0 and f["corr_tpl"] == pytest.approx(1.0)


def test_coherence_equals_the_mean_over_pairs(spark):
    x = np.random.default_rng(11).normal(size=(6, 20))
    x[3] = 1.0
    z = np.array([(r - r.mean()) / r.std() if r.std() > 1e-12 else r * 0 for r in x])
    want = np.mean([(z[i] @ z[j]) / 20 for i in range(6) for j in range(i)])
    assert H.coherence(series(spark, x).withColumn("g", F.lit(1)), ["g"]).first()["r_intra"] == pytest.approx(want)


def test_previous_frame_across_chunks(spark):
    df = spark.range(50).select(F.lit(0).alias("patient"), F.col("id").alias("t"), (F.col("id") * 3).alias("v"))
    rows = Q.previous_frame(df, KEYS, "t", ["v"], chunk=7).collect()
    assert len(rows) == 50
    assert all(r["prev_v"] == (r["v"] - 3 if r["t"] else None) for r in rows)


def test_short_series_have_zero_quality_features(spark):
    df = series(spark, [[1, 2, 3]]).withColumn("patient", F.lit(0))
    row = Q.voxel_features(df, KEYS).first()
    assert all(row[c] == 0.0 for c in Q.VOXEL_FEATURES)


# ---- masks, splits, models, files ----------------------------------------------------------


def test_enhancement_with_non_positive_median(spark):
    df = spark.createDataFrame([(0, i, 0.0, True) for i in range(5)], "patient int, flat_idx long, v double, brain boolean")
    assert M.enhancement(df, KEYS, "v").where("enh").count() == 0


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        M.tumour_core("liver")
    with pytest.raises(ValueError):
        L.classifier_name("tree")
    with pytest.raises(ValueError):
        TS.representation("wavelet")


def pool(spark, n_pos, n_neg):
    rows = [(0, i, i, 0, 0, 1) for i in range(n_pos)] + [(0, 100 + i, i, 9, 9, 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "patient int, flat_idx long, x int, y int, z int, target int")


def test_patch_holdout_has_no_leak(spark):
    grid = G.Grid(40, 10, 10)
    split = P.patch_holdout(pool(spark, 40, 40), KEYS, grid, 0.1, 1, n_per_class=10)
    rows = split.collect()
    assert {r["role"] for r in rows} == {"train", "val"}
    assert len({r["flat_idx"] for r in rows}) == len(rows)


def test_infeasible_keys_say_why(spark):
    assert P.balanced(pool(spark, 0, 5), KEYS, 3, 1).count() == 0
    rows = P.adaptive_split(pool(spark, 0, 5), KEYS, G.Grid(40, 10, 10), (2.0, 2.0, 2.0)).collect()
    assert [(r["mode"], r["role"], r["flat_idx"]) for r in rows] == [("empty_class", None, None)]


def test_thinning_keeps_one_voxel_per_cell(spark):
    rows = P.thin(pool(spark, 40, 40), KEYS, 4, 1, max_keep=3).collect()
    assert len({(r["target"], r["x"] // 4, r["y"] // 4, r["z"] // 4) for r in rows}) == len(rows)
    assert max(sum(r["target"] == c for r in rows) for c in (0, 1)) <= 3


def test_more_than_a_thousand_options(spark):
    text = "Mode:" + ":".join(f"k{i}={i}" for i in range(1500))
    row = spark.createDataFrame([(text,)], "t string").select(*G.parse_sampling("t")).first()
    assert row["mode"] == "mode" and len(row["options"]) == 1500 and row["options"]["k1499"] == 1499.0


def test_ranges_of_ranges_give_the_same_order(spark, monkeypatch):
    """With few ranges allowed each is cut again; sums below, and the place of values that are not in the table, stay."""
    monkeypatch.setattr(R, "MIN_RANGES", 2)
    monkeypatch.setattr(R, "MAX_RANGES", 4)
    rng = np.random.default_rng(6)
    rows = [(int(p), float(v)) for p, v in zip(rng.integers(0, 2, 300), rng.integers(0, 90, 300))]
    df = spark.createDataFrame(rows, "patient int, v double")
    table = R.value_table(df, KEYS, "v", {"n": F.count(F.lit(1))}, rows_per_range=5)
    assert table.finer is not None and table.rows.select("_range").distinct().count() > 8
    for r in R.running(table).collect():
        own = [v for p, v in rows if p == r["patient"]]
        assert (r["n"], r["n_before"], r["n_total"]) == (own.count(r["v"]), sum(v < r["v"] for v in own), len(own))
    asked = spark.createDataFrame([(p, q, 0, True) for p in (0, 1) for q in (-1.0, 10.0, 10.5, 500.0)], "patient int, v double, n long, asked boolean")
    for r in R.running(table, asked).where("asked").collect():
        own = [v for p, v in rows if p == r["patient"]]
        assert (r["n"], r["n_before"]) == (own.count(r["v"]), sum(v < r["v"] for v in own))


def test_silhouette_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x, k = rng.normal(size=(60, 2)) + 1000, rng.integers(0, 3, 60)
    k[:1] = 7
    df = spark.createDataFrame([(i, int(k[i]), *map(float, x[i])) for i in range(60)], "id int, k int, a double, b double")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for r in L.silhouette(df, ["a", "b"], "k", "id").collect():
        i = r["id"]
        if (k == k[i]).sum() == 1:
            assert r["silhouette"] == 0.0
            continue
        a = d[i, k == k[i]].sum() / ((k == k[i]).sum() - 1)
        b = min(d[i, k == c].mean() for c in set(k) - {k[i]})
        assert r["silhouette"] == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_euclidean_silhouette_of_all_rows(spark):
    rng = np.random.default_rng(5)
    k = rng.integers(0, 4, 150)
    x = rng.normal(size=(150, 2)) + 6.0 * np.c_[k, k % 2]  # far clusters are skipped
    k[:1] = 7
    df = spark.createDataFrame([(i, None if k[i] == 3 else str(k[i]), *map(float, x[i])) for i in range(150)], "id int, k string, a double, b double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = L.euclidean_silhouette(df, ["a", "b"], "k", "id", block_rows=20).collect()
    assert len(got) == 150
    for r in got:
        i = r["id"]
        if k[i] == 7:
            assert r["silhouette"] == 0.0
            continue
        a = d[i, k == k[i]].sum() / ((k == k[i]).sum() - 1)
        b = min(d[i, k == c].mean() for c in set(k.tolist()) - {k[i]})
        assert r["silhouette"] == pytest.approx((b - a) / max(a, b))
    one = df.where("k = '0'")
    assert {r["silhouette"] for r in L.euclidean_silhouette(one, ["a", "b"], "k", "id").collect()} == {0.0}


def test_clusters_of_a_patient_do_not_depend_on_others(spark):
    rng = np.random.default_rng(8)
    table = lambda p, shift: [(p, i, float(v), float(w)) for i, (v, w) in enumerate(rng.normal(size=(30, 2)) + shift)]
    first, others = table(0, 0), [table(1, 5), table(1, -50)]
    got = []
    for other in others:
        df = spark.createDataFrame(first + other, "patient int, id int, a double, b double")
        out = PC.reduce_and_cluster(df, ["a", "b"], KEYS, 2, "kmeans", 1, 1, 6.0, 2)
        assert out.count() == 60
        got.append(sorted((r["id"], r["cluster"], round(r["pc1"], 9)) for r in out.where("patient = 0").collect()))
    assert got[0] == got[1]


def test_calibration_folds_hold_both_classes(spark):
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(20)], "flat_idx long, target int")
    rows = L.stratified_folds(df, 2, "flat_idx").groupBy("_f", "target").count().collect()
    assert sorted((r["_f"], r["target"], r["count"]) for r in rows) == [(0, 0, 8), (0, 1, 2), (1, 0, 8), (1, 1, 2)]


def test_ladder_falls_back_to_cubes(spark):
    split = P.adaptive_split(pool(spark, 30, 30), KEYS, G.Grid(40, 10, 10), (2.0, 2.0, 2.0), n_per_class=5)
    assert {r["mode"] for r in split.select("mode").distinct().collect()} == {"patch_holdout"}


def test_class_proximity_equals_pairs(spark):
    rng = np.random.default_rng(12)
    leaf, k = rng.integers(0, 3, (40, 5)), rng.integers(0, 2, 40)
    df = spark.createDataFrame([(i, int(k[i]), [int(v) for v in leaf[i]]) for i in range(40)], "id int, k int, leaves array<int>")
    prox = (leaf[:, None, :] == leaf[None, :, :]).mean(axis=2)
    for limit in (1_000, 0):  # by look-up, and by a salted join
        got = {(r["id"], r["k"]): r["proximity"] for r in L.class_proximity(df, "id", "k", limit=limit).collect()}
        for i in range(40):
            for c in (0, 1):
                assert got.get((i, c), 0.0) == pytest.approx(prox[i, k == c].mean())
    with pytest.raises(ValueError, match="anchors"):
        big = spark.range(L.MAX_ANCHORS + 5).select("id", F.array(F.lit(1)).alias("leaves"))
        L.anchor_proximity(big, big, "id")


def test_separable_classes_are_learned(spark):
    rng = np.random.default_rng(13)
    rows = [(i, i % 2, float(rng.normal() + 4 * (i % 2)), float(rng.normal())) for i in range(120)]
    df = L.assemble(spark.createDataFrame(rows, "flat_idx long, target int, a double, b double"), ["a", "b"])
    scored = L.compare_classifiers(df, df, trees=5, depth=4)
    long = E.unpivot(scored, ["target"], {"rf": "p_rf", "svm": "p_svm", "lr": "p_lr"})
    for r in E.ranked_metrics(E.score_table(long, ["clf"], "target"), ["clf"]).collect():
        assert r["val_auc"] > 0.95


def test_summary_and_split_cache(spark, tmp_path):
    df = spark.createDataFrame([("t", 1.5, "drop me")], "trial string, val_auc double, other string")
    sinks.append_summary(df, str(tmp_path / "s"))
    sinks.append_summary(df, str(tmp_path / "s"))
    back = sinks.read_summary(spark, str(tmp_path / "s"))
    assert back.columns == sinks.SUMMARY_HEADER and back.count() == 2
    assert back.first()["val_auc"] == "1.5" and back.first()["run_dir"] == ""
    first = sinks.cached_split(spark, str(tmp_path / "c"), "k", lambda: spark.range(4))
    again = sinks.cached_split(spark, str(tmp_path / "c"), "k", lambda: spark.range(9))
    assert first.count() == again.count() == 4


def test_global_positions(spark):
    names = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("name"))
    rows = sorted((r["name"], r["pos"]) for r in T.global_positions(names, "name").collect())
    assert [p for _, p in rows] == list(range(500))


def test_progression_without_new_enhancement(spark):
    rows = [(0, 0, 1, True), (0, 1, 1, True), (0, 1, 2, False)]
    df = spark.createDataFrame(rows, "patient int, visit int, flat_idx long, enh boolean")
    row = FU.progression(df, df.where("flat_idx = 2"), KEYS, 0).first()
    assert (row["n_enh"], row["n_new"], row["overlap"], row["dice"]) == (1, 0, 0, None)


def test_phenotype_rule(spark):
    df = spark.createDataFrame(
        [(0, 0, None, None), (1, 0, 0.5, None), (3, 2, 0.2, 0.9), (1, 1, 0.5, 0.4), (1, 1, 0.5, 0.1)],
        "n int, s int, sph double, r double",
    )
    got = [r[0] for r in df.select(H.phenotype_of(*[F.col(c) for c in ("n", "s", "sph", "r")])).collect()]
    assert got == ["empty", "subthreshold", "multifocal", "compact", "diffuse"]


def test_array_percentile_and_trapezoid(spark):
    x = np.random.default_rng(14).normal(size=(2, 9))
    for row, v in zip(series(spark, x).select(A.percentile(F.col("ts"), 0.2), A.trapezoid(F.col("ts"), 1.5)).collect(), x):
        assert row[0] == pytest.approx(np.percentile(v, 20)) and row[1] == pytest.approx(np.trapezoid(v, dx=1.5))


def test_cluster_means_do_not_depend_on_the_order_of_the_rows(spark):
    """Sums of 0.1, 0.2, ... differ by order as doubles; equal means of two channels tie, and the first one wins."""
    values = [0.1, 0.7, 0.2, 0.3, 0.6, 0.05, 0.15] * 3
    rows = [(c, 90, 1, v, v, values[-1 - i], 0.0, 1.0, True) for c, own in enumerate((values, values[::-1], sorted(values))) for i, v in enumerate(own)]
    names = "patient int, pct int, cid int, p double, p_nec double, p_enh double, p_mix double, dist double, edema boolean"
    out = H.cluster_statistics(spark.createDataFrame(rows, names).coalesce(1), ["patient"], "p").collect()
    assert {r["mean_prob"] for r in out} == {0.3} and {r["mean_p_enh"] for r in out} == {0.3}
    assert {r["dominant_class"] for r in out} == {"necrosis"}
    same = spark.createDataFrame([(0, 90, 1, 0.1, 0.0, 0.0, 0.0, None, True)] * 3, names)
    assert H.cluster_statistics(H.in_units(same, ["p"]), ["patient"], "p").first()["mean_prob"] == 0.1


def test_hotspot_sql_keeps_patients_without_a_core(spark, tmp_path):
    """Patients of a few voxels: some have no core, and their hotspots no distance."""
    import duckdb

    from parity import compare
    from voxelspark import catalog

    path = str(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    own = "SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet'"
    few = f"SELECT * REPLACE ((100+l_orderkey//20)*3750+l_orderkey%20 AS l_orderkey) FROM ({own}) WHERE l_orderkey<2000"
    con.sql(f"COPY ({few}) TO '{path}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    queries, sql = catalog.load()
    name = "j8_cluster_core_distance"
    assert compare(queries[name](spark, str(tmp_path)), con, sql[name]) is None
    assert queries[name](spark, str(tmp_path)).where("min_dist_mm IS NULL").count() > 0


# ---- work that follows the input ------------------------------------------------------------


def _near(p, kind):
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return {(p[0] + i, p[1] + j, p[2] + k) for i, j, k in steps if kind == 26 or abs(i) + abs(j) + abs(k) <= 1}


def _counted(spark, df):
    """``df`` behind a step that counts the rows it is asked for, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def passed(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return df.mapInPandas(passed, df.schema), seen


def _made(plan) -> int:
    """Rows that all generators of an executed plan made."""
    own = plan.metrics().get("numOutputRows").get().value() if plan.nodeName() == "Generate" else 0
    return own + sum(_made(plan.children().apply(i)) for i in range(plan.children().size()))


def _solid(spark, nx=70, ny=6, nz=6, at=-35):
    points = [(x, y, z) for x in range(at, at + nx) for y in range(ny) for z in range(nz)]
    return spark.createDataFrame([(1, *p) for p in points], "patient int, x int, y int, z int"), set(points)


def test_words_of_lines_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    solid, points = _solid(spark)
    kept = {p for p in points if rng.random() < 0.93}
    mask = spark.createDataFrame([(1, *p) for p in kept], solid.schema)
    as_points = lambda d: {(r["x"], r["y"], r["z"]) for r in d.collect()}
    for kind, erode in ((6, lambda m: S.erode(m, ["patient"], 1)), (26, lambda m: S.box_erode(m, ["patient"]))):
        want = {p for p in kept if _near(p, kind) <= kept}
        assert want and as_points(erode(mask)) == want
    assert as_points(S.box_dilate(mask, ["patient"])) == set().union(*[_near(p, 26) for p in kept])


def test_opening_makes_a_few_rows_per_line_not_26_per_voxel(spark):
    df, points = _solid(spark)
    df = df.withColumns({"brain": F.lit(True), "seg": F.lit(0), "pve": F.expr("CASE WHEN x <> 3 THEN 0.9D ELSE 0.1D END")})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = M.healthy_and_csf(df, ["patient"], "seg", "pve")
        rows = out.collect()
        assert _made(out._jdf.queryExecution().executedPlan()) < 3 * len(points)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == len(points) and all(r["csf"] == (r["x"] != 3) for r in rows)


def test_segmentation_masks_read_their_input_once(spark):
    df, points = _solid(spark)
    df, seen = _counted(spark, df.withColumns({"brain": F.lit(True), "s": F.expr("CASE WHEN x < 0 THEN 1 WHEN x < 20 THEN 2 ELSE 3 END")}))
    part = {p: 1 if p[0] < 0 else 2 if p[0] < 20 else 3 for p in points}
    for steps in (1, 2):
        rows = T.segmentation_masks(df, ["patient"], "s", steps).collect()
        assert len(rows) == len(points) and seen.value == steps * len(points)
        for r in rows:
            p = (r["x"], r["y"], r["z"])
            inner = _near(p, 6) if steps == 1 else set().union(*[_near(q, 6) for q in _near(p, 6)])
            held = all(part.get(q) == part[p] for q in inner)
            assert [r["seed_necro"], r["seed_edema"], r["seed_enh"]] == [held and part[p] == k for k in (1, 2, 3)]


def test_signed_distance_reads_its_input_once(spark):
    rng = np.random.default_rng(8)
    points = sorted({tuple(int(v) for v in rng.integers(-40, 40, 3)) for _ in range(300)})
    df = spark.createDataFrame([(1, *p) for p in points], "patient int, x int, y int, z int")
    targets, asked = _counted(spark, df)
    inside = [p for p in points if sum(v * v for v in p) < 900]
    mask, held = _counted(spark, spark.createDataFrame([(1, *p) for p in inside], df.schema))
    volume = G.Grid(200, 200, 200, 1.0, 1.0, 1.0)
    rows = S.signed_distance(targets, mask, ["patient"], volume).collect()
    assert (asked.value, held.value, len(rows)) == (len(points), len(inside), len(points))
    for r in rows:
        p = (r["x"], r["y"], r["z"])
        if p not in set(inside):
            assert abs(r["signed_dist"] - min(sum((a - b) ** 2 for a, b in zip(p, q)) for q in inside) ** 0.5) < 1e-9


def test_partitioned_writer_makes_files_by_folder_not_by_task(spark, tmp_path):
    df = spark.range(800).selectExpr("CAST(id % 5 AS INT) AS patient", "id").repartition(8)
    sinks.write_partitioned(df, str(tmp_path / "labels"), ["patient"])
    assert len(list((tmp_path / "labels").glob("patient=*/*.parquet"))) == 5
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 800


def test_euclidean_silhouette_compares_each_pair_of_blocks_once_in_its_own_task(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, int(c) if c else None, *(rng.normal(3.0 * (c == 3), 1, 2).tolist())) for i, c in enumerate([9, *rng.integers(0, 4, 149)])]
    df = spark.createDataFrame(rows, "id int, k int, a double, b double")
    compared = spark.sparkContext.accumulator(0)
    plain = L.distance_sums

    def seen(a, b):
        compared.add(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(L, "distance_sums", seen)
    got = {r["id"]: r["silhouette"] for r in L.euclidean_silhouette(df, ["a", "b"], "k", "id", block_rows=10).collect()}
    assert len(got) == len(rows)
    assert 0.3 * len(rows) ** 2 < compared.value < 0.65 * len(rows) ** 2
    v, k = np.array([r[2:] for r in rows]), [r[1] for r in rows]
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    for i, c in enumerate(k):
        mean = {o: d[i, [p == o for p in k]].sum() / max(1, k.count(o) - (o == c)) for o in set(k)}
        b = min(m for o, m in mean.items() if o != c)
        assert got[i] == pytest.approx(0.0 if k.count(c) == 1 else (b - mean[c]) / max(b, mean[c]))
