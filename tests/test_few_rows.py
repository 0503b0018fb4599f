"""Keys of few rows: one task fits and applies all models of a key, with the results of the ways for keys of any size."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import evaluation as E, forests as FR, keyed as K
from voxelspark.operators.grid import Grid
from voxelspark.plans import experiment as X

GRID, SPACING = Grid(10, 10, 5, 2.0, 2.0, 2.5), (2.0, 2.0, 2.5)
KEYS, FEATURES = ["patient"], ["a", "b", "c"]


def walked(x, y, rows, trees, seed, depth, min_leaf):
    """The forest as a table of trees, and walks down them."""
    m = FR.Forest(trees, seed, depth, min_leaf, local=FR.LOCAL_ROWS)
    state = K.settled(m, x, y, np.ones(len(y)))
    table = pickle.loads(m.whole(state, m.below_all(state, m.pieces(state, x, y)))["model"])
    return np.mean([table["value"][FR.place(table, rows, np.array([t]))[0]] for t in range(trees)], axis=0)


@pytest.mark.parametrize("n, d, depth, min_leaf, cells", [(150, 4, None, 1, 10**6), (300, 4, 5, 3, 10**6), (900, 2, None, 1, 30_000), (200, 16, None, 1, 10**6), (40, 1, None, 1, 10**6), (5, 3, 0, 1, 10**6)])
def test_leaves_as_boxes_give_the_forest_of_the_trees(monkeypatch, n, d, depth, min_leaf, cells):
    """Mixed leaves come from a depth, from least sizes, and from equal rows of both classes."""
    monkeypatch.setattr(FR, "TOGETHER", cells)
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, d)), 1 if d < 3 else 9)
    y = (rng.random(n) < 0.4).astype(float)
    y[:2] = 0, 1
    rows = rng.normal(size=(5000, d))
    rows[0], rows[1], rows[2] = np.nan, np.inf, -np.inf
    got = FR.whole_forest(x, y, rows, 30, 3, depth, min_leaf)
    assert np.allclose(got, walked(x, y, rows, 30, 3, depth, min_leaf), rtol=0, atol=1e-12)


def test_a_class_alone_gives_its_share_everywhere():
    x = np.random.default_rng(1).normal(size=(20, 2))
    assert (FR.whole_forest(x, np.ones(20), x, 7) == 1).all() and (FR.whole_forest(x, np.zeros(20), x, 7) == 0).all()


def test_machines_and_regressions_of_a_task_are_those_of_jobs(spark):
    rng = np.random.default_rng(4)
    data = [(p, i, rng.normal(size=3).tolist()) for p in ("a", "b") for i in range(70)]
    rows = spark.createDataFrame([(p, i, v, int(v[0] + rng.normal() > 0)) for p, i, v in data], "patient string, i int, x array<double>, target int")
    out = K.svm_keys(rows, rows, ["patient"], "x", ["i"], out="p_svm")
    out = K.logistic_keys(K.balanced_weight(rows, ["patient"], "target"), out, ["patient"], "x", ["i"], "target", 2, weight="weight", binary=True)
    out = out.withColumn("_c", F.xxhash64(F.lit("calibration"), "i")).withColumn("_h", F.xxhash64("i")).orderBy("_h").collect()
    for p in ("a", "b"):
        own = [r for r in out if r["patient"] == p]
        x, y, c = np.array([r["x"] for r in own]), np.array([r["target"] for r in own], float), np.array([r["_c"] for r in own])
        assert np.allclose(K.whole_svm(x, y, c, x), [r["p_svm"] for r in own], atol=1e-9)
        assert np.allclose(K.whole_logistic(x, y, x), [r["probs"][1] for r in own], atol=1e-9)
    assert (K.whole_svm(x[:2], np.array([0.0, 1.0]), c[:2], x) == 0.5).all()  # one row of each class: nothing is left aside


@pytest.fixture(scope="module")
def cohort(spark):
    """Three volumes of noise with a bright cube and their splits; a fourth has one class, a fifth no voxels in the pools."""
    rng, voxels, pools = np.random.default_rng(7), [], []
    for p in range(5):
        for i in range(500):
            x, y, z = i // 50, i // 5 % 10, i % 5
            core = 3 <= x < 7 and 3 <= y < 7
            v = rng.normal(size=3) + core * np.array([1.0, 0.5, 0.0])
            voxels.append((p, x, y, z, i, *map(float, v)))
            if p < 3 or (p == 3 and not core):
                pools.append((p, i, x, y, z, int(core)))
    voxels = spark.createDataFrame(voxels, "patient int, x int, y int, z int, flat_idx long, a double, b double, c double").withColumn("flat", F.lit(0.1))
    pools = spark.createDataFrame(pools, "patient int, flat_idx long, x int, y int, z int, target int")
    return voxels, X._splits(pools, KEYS, GRID, SPACING, 2, 42, 40, 8.0, 2.0, None)


@pytest.mark.parametrize("scale", [False, True])
def test_few_rows_take_another_way_to_the_same_maps(cohort, scale):
    """Scaled rows may differ in their last digits, and with them the forests' bootstrap samples."""
    voxels, split = cohort
    fits, made = X.Fits(20, scale=scale), []
    for rows in (X._few_rows(voxels, FEATURES, split, KEYS, 3, fits, ensemble=False), X._many_rows(voxels, FEATURES, split, KEYS, fits)):
        made.append({tuple(r[c] for c in (*KEYS, "fold", *"xyz", "flat_idx", "role", "target")): (r["p_rf"], r["p_svm"], r["p_lr"]) for r in rows.collect()})
    few, many = made
    assert len(few) == 3 * 2 * 500 and few.keys() == many.keys()
    for k, v in few.items():
        assert np.allclose(v[1:], many[k][1:], atol=1e-7) and abs(v[0] - many[k][0]) < (1.0 if scale else 1e-12)


def test_keys_of_both_kinds_meet_in_one_table(cohort, monkeypatch):
    voxels, split = cohort
    split = split.where("patient > 0 OR role = 'val' OR flat_idx % 3 > 0")  # the first volume has fewer training rows
    most = {r["patient"]: r["n"] for r in split.where("role = 'train'").groupBy("patient", "fold").count().groupBy("patient").agg(F.max("count").alias("n")).collect()}
    assert most[0] < min(most[1], most[2])
    monkeypatch.setattr(X, "_splits", lambda *a: split)
    monkeypatch.setattr(FR, "BOX_CELLS", most[0] * len(FEATURES))
    given = (voxels, FEATURES, None, KEYS, GRID, SPACING)
    maps, scores = X.fold_probabilities(*given, folds=2, trees=20, scale=False)
    by = ["patient", "clf", "flat_idx"]
    got, want = X.ensemble_maps(*given, folds=2, trees=20, scale=False), E.ensemble(maps, by)
    assert got.columns == want.columns and got.schema["n_folds"].dataType == want.schema["n_folds"].dataType
    got, want = ({tuple(r[c] for c in by): (r["p_mean"], r["p_std"], r["n_folds"]) for r in d.collect()} for d in (got, want))
    assert len(want) == 3 * 3 * 500 and got.keys() == want.keys() and all(np.allclose(got[k], v, atol=1e-9) for k, v in want.items())
    assert scores.count() == 3 * split.where("role = 'val'").count()


def test_no_split_gives_no_maps_and_few_splits_no_fewer_tasks(spark, cohort, monkeypatch):
    voxels, split = cohort
    monkeypatch.setattr(X, "_splits", lambda *a: split.where("false"))
    given = (voxels, FEATURES, None, KEYS, GRID, SPACING)
    none = X.ensemble_maps(*given)
    assert none.count() == 0 and none.columns == ["patient", "clf", "flat_idx", "p_mean", "p_std", "n_folds"]
    assert all(d.count() == 0 for d in X.fold_probabilities(*given))
    one = X._few_rows(voxels, FEATURES, split.where("patient = 1"), KEYS, 1, X.Fits(trees=3), ensemble=True)
    assert one.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) and {r["patient"] for r in one.collect()} == {1}


def test_maps_of_few_rows_take_no_job_for_a_model(spark, cohort):
    """Splits apart, the maps of all keys, folds and classifiers are a handful of jobs; they were dozens, and trees were written and read."""
    voxels, split = cohort
    spark.sparkContext.setJobGroup("maps", "maps")
    few, many, n = X._shares(voxels, split, KEYS, GRID, FEATURES)
    rows = X._few_rows(voxels, [*FEATURES, "flat"], few, KEYS, n, X.Fits(trees=20), ensemble=True).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("maps"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many is None and n == 3 and len(rows) == 3 * 500 and jobs <= 10
