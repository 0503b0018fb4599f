"""Leave-one-group-out forests: trees shared by all groups are those that each group would grow alone."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from voxelspark.operators import leave_out as LO, learning as L


def table(seed, n, groups, kinds):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, kinds, (n, 5)).astype(np.uint8)
    y = (code[:, 0].astype(int) + code[:, 1] + rng.integers(0, 1 + kinds // 2, n) > 1.2 * kinds).astype(float)
    return code, y, rng.integers(0, groups, n), rng.poisson(1.0, n).astype(float)


@pytest.mark.parametrize("n, groups, kinds, depth, min_leaf, steps", [(400, 25, 64, None, 1, 4), (300, 10, 4, None, 1, 4), (500, 60, 64, 4, 1, 4), (300, 20, 8, None, 3, 4), (300, 20, 64, None, 1, 256), (40, 60, 64, None, 1, 4)])
def test_shared_trees_are_those_of_each_group_alone(monkeypatch, n, groups, kinds, depth, min_leaf, steps):
    monkeypatch.setattr(LO, "RATIO_STEPS", steps)
    code, y, g, times = table(n + groups, n, groups, kinds)
    every = np.arange(groups)
    asked = np.random.default_rng(1).integers(0, kinds, (200, 5)).astype(np.uint8)
    shared = LO.family(code, y, g, times, every, groups, (1, 2), depth, min_leaf)
    for held in every:
        rest = g != held
        alone = LO.family(code[rest], y[rest], g[rest], times[rest], np.array([held]), groups, (1, 2), depth, min_leaf)
        of = np.full(len(asked), held)
        assert not len(alone["leave"])
        assert (LO.values(shared, asked, of) == LO.values(alone, asked, of)).all()


def test_grown_leaves_hold_one_class_and_empty_tables_give_a_leaf():
    code, y, g, times = table(5, 300, 20, 64)
    trees = LO.family(code, y, g, np.ones(300), np.array([20]), 21, (1, 2))  # a group without rows
    assert (LO.values(trees, code, np.full(300, 20)) == y).all()
    none = LO.family(code, y, g, np.zeros(300), np.arange(20), 20, (1, 2))
    assert (LO.values(none, code, g) == 0).all()


def test_nodes_grow_with_the_rows_and_not_with_rows_times_groups():
    nodes = []
    for n, groups in ((2_000, 250), (8_000, 1_000)):
        code, y, g, times = table(7, n, groups, 64)
        nodes.append(len(LO.family(code, y, g, times, np.arange(groups), groups, (1, 2))["feature"]))
    assert nodes[1] < 6 * nodes[0]  # 4 times the rows; trees of each group on its own would have 16 times the nodes


def cohort(spark, flipped=None):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        x = rng.normal(size=(50, 4))
        y = (x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=50) > 0).astype(int)
        kept = np.where(np.arange(50) % 5 == 0, -1, y if g != flipped else 1 - y)
        rows += [(g, i, a.tolist(), int(b), int(c)) for i, (a, b, c) in enumerate(zip(x, kept, y))]
    rows.append((None, 0, [0.0] * 4, 1, 1))
    return spark.createDataFrame(rows, "g int, id int, z array<double>, quality int, truth int").withColumn("features", array_to_vector("z"))


@pytest.mark.parametrize("fold_rows", [0, LO.FOLD_ROWS])  # folds of three groups, and of one
def test_shared_forests_follow_forests_of_each_group(spark, monkeypatch, fold_rows):
    monkeypatch.setattr(LO, "FOLD_ROWS", fold_rows)
    plain = {}
    shared = {(r["g"], r["id"]): r["p"] for r in L.leave_one_out_forest(cohort(spark), "g", "quality", trees=60).collect()}
    turned = {(r["g"], r["id"]): r["p"] for r in L.leave_one_out_forest(cohort(spark, 4), "g", "quality", trees=60).collect()}
    monkeypatch.setattr(LO, "TASK_ROWS", 0)
    for r in L.leave_one_out_forest(cohort(spark), "g", "quality", trees=60).collect():
        plain[r["g"], r["id"]] = (r["p"], r["truth"])
    assert len(shared) == 600 and shared.keys() == plain.keys()
    a, (b, truth) = np.array([shared[k] for k in plain]), np.array(list(plain.values())).T
    assert np.corrcoef(a, b)[0, 1] > 0.95 and ((a > 0.5) == truth).mean() > ((b > 0.5) == truth).mean() - 0.02
    same = [shared[k] == turned[k] for k in shared if k[0] == 4]
    other = [shared[k] == turned[k] for k in shared if k[0] != 4]
    assert all(same) and not all(other)  # a group's labels enter all forests but its own


def test_groups_without_training_rows_of_both_classes(spark):
    df = cohort(spark).where("g < 10")
    none = df.selectExpr("g", "id", "features", "-1 AS quality")
    assert L.leave_one_out_forest(none, "g", "quality", trees=5).count() == 0
    one = df.selectExpr("g", "id", "features", "CASE WHEN g = 9 THEN quality WHEN quality = -1 THEN -1 ELSE 1 END AS quality")
    assert {r["g"] for r in L.leave_one_out_forest(one, "g", "quality", trees=5).collect()} == set(range(9))


def test_probabilities_stay_within_one_when_shares_of_the_trees_differ(spark):
    rows = [(g, i, [float(i % 2) * 9], i % 2) for g in range(15) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, id int, z array<double>, quality int").withColumn("features", array_to_vector("z"))
    out = L.leave_one_out_forest(df, "g", "quality", trees=300).collect()  # 15 folds, 13 shares of 23 or 24 trees
    assert len(out) == 300 and all(r["p"] == r["quality"] for r in out)
