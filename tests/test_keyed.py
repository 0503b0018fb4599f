"""Fits of many keys at once against plain NumPy, and blocks against whole keys."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from voxelspark.operators import forests as FR, keyed as K, learning as L

KEYS = ["patient"]


def table(spark, groups):
    rows = [(p, i, [float(v) for v in x], int(y)) for p, (xs, ys) in groups.items() for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "patient string, id int, z array<double>, y int")


def blobs(seed, n=90, k=3, d=2, gap=12.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    return rng.normal(size=(n, d)) + gap * np.eye(k, d)[y] * (1 + y[:, None]), y


@pytest.fixture(scope="module")
def cohort(spark):
    return {"a": blobs(1), "b": blobs(2, 400), None: blobs(3, 60), "": blobs(4, 50)}


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("algo", ["kmeans", "gmm"])
@pytest.mark.parametrize("block_rows", [20_000, 64])
def test_planted_clusters_of_every_key_are_found(spark, cohort, monkeypatch, algo, block_rows):
    """The second size makes every key advance by rounds over several blocks."""
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    out = K.cluster_keys(table(spark, cohort), KEYS, "z", ["id"], 3, algo).collect()
    assert len(out) == sum(len(y) for _, y in cohort.values())
    for p, (_, y) in cohort.items():
        own = {r["id"]: r["cluster"] for r in out if r["patient"] == p}
        assert same_partition([own[i] for i in range(len(y))], y.tolist())


def test_centres_rest_and_jobs_do_not_follow_keys(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)
    rounds = []
    plain = K.KMeans.step
    monkeypatch.setattr(K.KMeans, "step", lambda self, s, t: rounds.append(1) or plain(self, s, t))
    many = {f"p{i}": blobs(i, 80, gap=2.0) for i in range(12)}
    packed = K.blocks(table(spark, many), KEYS, "z", ["id"])
    assert packed.where("_blocks > 1").count() > 20
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("keyed", "keyed")
    models = K.fit(packed, KEYS, K.KMeans(3, 1, starts=4)).collect()
    jobs = len(tracker.getJobIdsForGroup("keyed"))
    spark.sparkContext.setJobGroup("", "")
    assert len(models) == 12 and jobs < 12 + 3 * max(r["rounds"] for r in models)
    for r in models:
        x, c = many[r["patient"]][0], np.array(r["centres"])
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        for j in range(3):
            assert np.allclose(x[label == j].mean(0), c[j])


def test_restart_with_the_best_index_is_kept(spark):
    x, _ = blobs(5, 120, 4, 3, gap=1.0)
    df = table(spark, {"a": (x, np.zeros(120, int))})

    def index(c):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        n = np.bincount(label, minlength=4)
        inside = ((x - np.array([x[label == j].mean(0) for j in range(4)])[label]) ** 2).sum()
        total = ((x - x.mean(0)) ** 2).sum()
        return (total - inside) * (120 - (n > 0).sum()) / (inside * ((n > 0).sum() - 1))

    packed = K.blocks(df, KEYS, "z", ["id"])
    kept = K.fit(packed, KEYS, K.KMeans(4, 42, 1, 5)).first()
    each = [K.fit(packed, KEYS, K.KMeans(4, 42 + r, 1, 1)).first() for r in range(5)]
    best = max(index(np.array(r["centres"])) for r in each)
    assert kept["quality"] == pytest.approx(best) and index(np.array(kept["centres"])) == pytest.approx(best)


@pytest.mark.parametrize("block_rows", [20_000, 50])
def test_regression_reaches_its_optimum_in_every_key(spark, monkeypatch, block_rows):
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    groups = {p: blobs(s, 160, 4, 3, gap=0.8) for p, s in (("a", 6), ("b", 7))}
    groups["two"] = (groups["a"][0], groups["a"][1] % 2 * 3)  # classes 1 and 2 are absent
    df = table(spark, groups)
    models = {r["patient"]: r for r in K.fit(K.blocks(df, KEYS, "z", ["id"], "y"), KEYS, K.Logistic(4)).collect()}
    probs = {(r["patient"], r["id"]): r["probs"] for r in K.logistic_keys(df, df, KEYS, "z", ["id"], "y", 4).collect()}
    for p, (x, y) in groups.items():
        b, here = np.array(models[p]["coefficients"]), np.array(models[p]["present"])
        z = np.where(here, np.c_[x, np.ones(len(x))] @ b.T, -np.inf)
        e = np.exp(z - z.max(1, keepdims=True))
        share = e / e.sum(1, keepdims=True)
        grad = (share - np.eye(4)[y]).T @ np.c_[x, np.ones(len(x))]
        grad[:, :-1] += b[:, :-1]
        assert np.abs(grad[here]).max() < 1e-5
        got = np.array([probs[p, i] for i in range(len(x))])
        assert np.allclose(got, share, atol=1e-9) and np.allclose(got[:, ~here], 0)


def test_support_vectors_reach_their_optimum(spark):
    x, y = blobs(9, 200, 2, 3, gap=0.7)
    df = K.balanced_weight(table(spark, {"a": (x, y), "b": (x + 1, 1 - y)}), KEYS, "y")
    for r in K.fit(K.blocks(df, KEYS, "z", ["id"], "y", "weight"), KEYS, K.SquaredHinge()).collect():
        xs, ys = (x, y) if r["patient"] == "a" else (x + 1, 1 - y)
        w, side, x1 = np.array(r["coefficients"][0]), 2 * ys - 1, np.c_[xs, np.ones(200)]
        weight = 200 / (2 * np.bincount(ys)[ys])
        grad = w - 2 * (weight * side * np.maximum(1 - side * (x1 @ w), 0)) @ x1
        assert np.abs(grad).max() < 1e-4
    p = {(r["patient"], r["id"]): r["p"] for r in K.svm_keys(df, df, KEYS, "z", ["id"], "y").collect()}
    assert all(0 <= v <= 1 for v in p.values())
    a = np.array([p["a", i] for i in range(200)])
    assert np.mean((a > 0.5) == y) > 0.6


def test_projections_by_key(spark):
    rng = np.random.default_rng(10)
    data = {p: rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3)) + 50 for p in range(3)}
    data[1][:, 2] = 5.0  # constant in one key only
    df = spark.createDataFrame([(p, i, *map(float, r)) for p, x in data.items() for i, r in enumerate(x)], "patient int, id int, a double, b double, c double")
    got = K.projected(df, KEYS, ["a", "b", "c"], K.projections(df, KEYS, ["a", "b", "c"], 2, fit=F.col("id") < 30, scale=True)).collect()
    for p, x in data.items():
        own = np.array([r["z"] for r in sorted((r for r in got if r["patient"] == p), key=lambda r: r["id"])])
        seen = x[:30, :2] if p == 1 else x[:30]
        unit = (seen - seen.mean(0)) / seen.std(0)
        full = ((x[:, : unit.shape[1]]) - seen.mean(0)) / seen.std(0)
        v = np.linalg.svd(unit, full_matrices=False)[2][:2]
        assert np.allclose(np.abs(own), np.abs(full @ v.T), atol=1e-8)


def test_waves_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 30)
    monkeypatch.setattr(K, "STATE_BYTES", 20_000)
    out = K.cluster_keys(table(spark, {f"p{i}": blobs(i, 70) for i in range(5)}), KEYS, "z", ["id"], 3, "kmeans")
    assert out.count() == 350 and out.where("cluster is null").count() == 0
    assert K.cluster_keys(table(spark, {}), KEYS, "z", ["id"], 3, "kmeans").count() == 0


def test_kmeans_rests_however_many_rounds_it_takes():
    """One cloud without clusters rests late; the kept start is a fixed point also beyond ``max_iter``."""
    x = np.random.default_rng(0).normal(size=(600, 3))
    m = K.KMeans(3, seed=1, starts=4, restarts=2, max_iter=2)
    state = m.begin(x)
    while not m.finished(state):
        state = m.step(state, m.stats(state, x, np.zeros(600), np.ones(600)))
    centres = np.array(m.model(state)["centres"])
    label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    assert state["rounds"] > 3 and np.allclose(centres, [x[label == k].mean(0) for k in range(3)])


# ---- forests and perceptrons ---------------------------------------------------------------


def noisy(seed, n=240, d=4, bad=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = ((x[:, 0] * x[:, 1] > 0) & (rng.random(n) < 2 * bad)).astype(int)
    return x, y


@pytest.mark.parametrize("block_rows", [20_000, 100])
def test_forests_of_all_keys_learn_what_one_column_alone_does_not_tell(spark, monkeypatch, block_rows):
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    groups = {"a": noisy(1), "b": noisy(2), "c": (noisy(3)[0], 1 - noisy(3)[1])}
    held = {p: noisy(10 + i) for i, p in enumerate(groups)}
    held["c"] = (held["c"][0], 1 - held["c"][1])
    df, test = table(spark, groups), table(spark, held)
    packed = K.blocks(df, KEYS, "z", ["id"], "y")
    models = FR.grow(packed, KEYS, trees=40, seed=3)
    assert models.count() == 3
    out = FR.scored(test, models, KEYS, "z", ["id"]).collect()
    assert len(out) == 3 * 240 and out[0].asDict().keys() == {"patient", "id", "z", "y", "p"}
    for p in groups:
        got = np.array([(r["p"] > 0.5) == r["y"] for r in out if r["patient"] == p])
        assert got.mean() > 0.8
    share = {r["patient"]: np.array(r["importance"]) for r in FR.importances(models, KEYS).collect()}
    assert all(v.sum() == pytest.approx(1.0) and v[:2].sum() > v[2:].sum() for v in share.values())
    leaves = FR.scored(test, models, KEYS, "z", ["id"], "leaves", leaves=True)
    assert {len(r["leaves"]) for r in leaves.collect()} == {40}


def test_full_trees_separate_their_bootstrap_rows():
    """One tree on distinct rows: every row that its sample holds ends in a pure leaf of its class."""
    x, y = noisy(5, 150)
    m = FR.Forest(trees=6, seed=1)
    state = m.begin(x)
    while not m.finished(state):
        state = m.step(state, m.stats(state, x, y.astype(float), np.ones(150)))
    node = FR.place(state["t"], x, np.arange(6))
    for t in range(6):
        held = m.drawn(t, x) > 0
        wrong = (state["t"]["value"][node[t]] > 0.5) != (y == 1)
        # bins may join a few neighbours; they separate nearly all rows
        assert wrong[held].mean() < 0.03


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x, y = rng.integers(0, 6, (40, 1)).astype(float), rng.integers(0, 2, 40)
        m = FR.Forest(trees=1, seed=int(rng.integers(1000)), depth=1)
        state = m.begin(x)
        while not m.finished(state):
            state = m.step(state, m.stats(state, x, y.astype(float), np.ones(40)))
        n = m.drawn(0, x)
        total = np.array([n[y == c].sum() for c in (0, 1)])
        if (total == 0).any() or len(np.unique(x[n > 0])) < 2:
            continue
        w = n * (total.sum() / (2 * total))[y]

        def gini(keep):
            h = np.array([w[keep & (y == c)].sum() for c in (0, 1)])
            return (h * h).sum() / max(h.sum(), 1e-300)

        cuts = [v for v in np.unique(x)[:-1] if n[x[:, 0] <= v].sum() and n[x[:, 0] > v].sum()]
        best = max(gini(x[:, 0] <= v) + gini(x[:, 0] > v) for v in cuts)
        got = state["t"]["threshold"][0]
        assert state["t"]["feature"][0] == 0 and gini(x[:, 0] <= got) + gini(x[:, 0] > got) == pytest.approx(best)


def test_classes_are_balanced_in_every_bootstrap_sample():
    """With one row in ten positive, trees weigh both classes alike; the root's share is a half in each of them."""
    x, y = np.random.default_rng(7).normal(size=(300, 3)), np.zeros(300, int)
    y[:30] = 1
    m = FR.Forest(trees=20, seed=2, depth=0)
    state = m.begin(x)
    while not m.finished(state):
        state = m.step(state, m.stats(state, x, y.astype(float), np.ones(300)))
    assert np.allclose(state["t"]["value"], 0.5)
    assert len(np.unique(state["weights"][:, 1])) > 5  # weights follow the sample, not the table


@pytest.mark.parametrize("local", [60, 100_000])
def test_trees_of_several_blocks_grow_on_in_the_tasks_of_their_nodes(spark, monkeypatch, local):
    """The driver's part ends at nodes of ``LOCAL_ROWS`` rows; whole trees still separate the rows, with leaves of one class."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 100)
    monkeypatch.setattr(FR, "LOCAL_ROWS", local)
    monkeypatch.setattr(FR, "SHARD_NODES", 240 * 16)
    df = table(spark, {"a": noisy(1), None: noisy(2)})
    tops = []
    whole = FR._Tops.model
    monkeypatch.setattr(FR._Tops, "model", lambda self, state: tops.append(len(state["t"]["feature"])) or whole(self, state))
    models = FR.grow(K.blocks(df, KEYS, "z", ["id"], "y"), KEYS, trees=40, seed=3)
    rows = models.collect()
    assert len(rows) == 6 and len(tops) == 2
    assert all(t < sum(r["nodes"] for r in rows) / 4 for t in tops) and (local > 60 or min(tops) > 40)
    out = FR.scored(df, models, KEYS, "z", ["id"]).collect()
    assert len(out) == 480 and np.mean([(r["p"] > 0.5) == r["y"] for r in out]) > 0.99
    share = {r["patient"]: np.array(r["importance"]) for r in FR.importances(models, KEYS).collect()}
    assert all(v.sum() == pytest.approx(1.0) and v[:2].sum() > v[2:].sum() for v in share.values())
    leaves = FR.scored(df, models, KEYS, "z", ["id"], "leaves", leaves=True)
    assert {len(r["leaves"]) for r in leaves.collect()} == {40}


def test_a_tree_grown_in_a_task_splits_like_one_grown_from_histograms():
    """With all features at every node, both ways give the same partition of the rows."""
    x, y = noisy(5, 300)
    x = x[:, :1]
    m = FR.Forest(trees=4, seed=1, min_leaf=2)
    state = m.begin(x)
    while not m.finished(state):
        state = m.step(state, m.stats(state, x, y.astype(float), np.ones(300)))
    near = FR.Forest(trees=4, seed=1, min_leaf=2, local=10_000)
    top = near.begin(x)
    while not near.finished(top):
        top = near.step(top, near.stats(top, x, y.astype(float), np.ones(300)))
    assert len(top["t"]["feature"]) == 4
    rest = {n: near.below(top, n, code, label, times) for n, code, label, times in near.pieces(top, x, y.astype(float))}
    trees = FR._joined(top["t"], rest, top["edges"])
    a, b = FR.place(state["t"], x, np.arange(4)), FR.place(trees, x, np.arange(4))
    assert np.allclose(state["t"]["value"][a], trees["value"][b])
    assert all(same_partition(p.tolist(), q.tolist()) for p, q in zip(a, b))


def test_leave_one_out_forests(spark):
    rows = [(g, i, [float(v) for v in x], int(y)) for g in range(3) for i, (x, y) in enumerate(zip(*noisy(20 + g, 120)))]
    df = spark.createDataFrame(rows, "g int, id int, z array<double>, quality int")
    df = df.withColumn("features", array_to_vector("z"))
    out = L.leave_one_out_forest(df, "g", "quality", trees=30).collect()
    assert len(out) == 360 and np.mean([(r["p"] > 0.5) == r["quality"] for r in out]) > 0.75
    one = df.withColumn("quality", F.when(F.col("g") == 0, F.col("quality")).otherwise(1))
    assert {r["g"] for r in L.leave_one_out_forest(one, "g", "quality", trees=5).collect()} == {1, 2}


def plain_perceptron(x, y, m):
    """The same training in plain NumPy, on the whole table."""
    state = m.begin(x)
    p = [v.copy() for v in state["p"]]
    first, second, t, best, idle = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0, (-1, None, 0), 0
    aside = np.zeros(len(y), bool)
    for c in (0, 1):
        aside[np.flatnonzero(y == c)[9::10]] = True
    for epoch in range(m.epochs):
        order = np.random.default_rng([m.seed, epoch]).permutation(np.flatnonzero(~aside))
        for rows in np.array_split(order, state["steps"]):
            h1 = np.maximum(x[rows] @ p[0] + p[1], 0)
            h2 = np.maximum(h1 @ p[2] + p[3], 0)
            d = 1 / (1 + np.exp(-(h2 @ p[4] + p[5]))) - y[rows, None]
            d2 = (d @ p[4].T) * (h2 > 0)
            d1 = (d2 @ p[2].T) * (h1 > 0)
            g = [x[rows].T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ d, d.sum(0)]
            t += 1
            for i in range(6):
                gi = (g[i] + (m.alpha * p[i] if i % 2 == 0 else 0)) / len(rows)
                first[i] = 0.9 * first[i] + 0.1 * gi
                second[i] = 0.999 * second[i] + 0.001 * gi * gi
                p[i] = p[i] - m.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * first[i] / (np.sqrt(second[i]) + 1e-8)
        z = np.maximum(np.maximum(x[aside] @ p[0] + p[1], 0) @ p[2] + p[3], 0) @ p[4] + p[5]
        score = float(((z[:, 0] > 0) == (y[aside] == 1)).mean())
        idle = 0 if score > best[0] + m.tol else idle + 1
        if score > best[0]:
            best = (score, [v.copy() for v in p], epoch + 1)
        if idle > m.patience:
            break
    return best, epoch + 1


def test_perceptron_equals_plain_training(spark, monkeypatch):
    x, y = noisy(30, 400, 3)
    df = table(spark, {"a": (x, y)})
    packed = K.blocks(df, KEYS, "z", ["id"], "y")
    m = K.Perceptron(seed=5, batch=40, epochs=40, rate=0.01)
    row = K.fit(packed, KEYS, m).first()
    held = packed.first()
    (score, p, at), epochs = plain_perceptron(np.frombuffer(held["x"]).reshape(400, 3), np.frombuffer(held["y"]), m)
    assert (row["score"], row["best_epoch"], row["epochs"]) == (pytest.approx(score), at, epochs)
    assert np.allclose(np.array(row["weights"][0]).reshape(32, 3).T, p[0]) and np.allclose(row["biases"][2], p[5])
    out = K.perceptron_scored(df, K.fit(packed, KEYS, m), KEYS, "z").collect()
    z = np.maximum(np.maximum(x @ p[0] + p[1], 0) @ p[2] + p[3], 0) @ p[4] + p[5]
    assert np.allclose([r["p"] for r in sorted(out, key=lambda r: r["id"])], 1 / (1 + np.exp(-z[:, 0])))
    monkeypatch.setattr(K, "BLOCK_ROWS", 150)
    several = K.fit(K.blocks(df, KEYS, "z", ["id"], "y"), KEYS, K.Perceptron(seed=5, batch=40, epochs=4, rate=0.01)).first()
    assert several["epochs"] == 4 and several["score"] > 0.4


def test_a_perceptron_of_several_blocks_takes_a_round_an_epoch(spark, monkeypatch):
    """The number of jobs follows the epochs, not the batches, and the rule is learnt from all blocks."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(1200, 4))
    df = table(spark, {"a": (x, (x[:, 0] + x[:, 1] > 0).astype(int))})
    monkeypatch.setattr(K, "BLOCK_ROWS", 300)
    rounds = []
    step = K.Perceptron.step
    monkeypatch.setattr(K.Perceptron, "step", lambda self, state, total: rounds.append(1) or step(self, state, total))
    row = K.fit(K.blocks(df, KEYS, "z", ["id"], "y"), KEYS, K.Perceptron(seed=5, batch=16, epochs=12, rate=0.01)).first()
    assert row["epochs"] <= 12 and len(rounds) == row["epochs"] + 1 and row["score"] > 0.93


def test_trees_grown_together_are_those_grown_alone(monkeypatch):
    """All small nodes of a shard share the passes over a level; the trees are the same as one by one."""
    x, y = noisy(8, 200)
    m = FR.Forest(trees=12, seed=4, depth=7, min_leaf=2, local=10_000)
    state = m.begin(x)
    while not m.finished(state):
        state = m.step(state, m.stats(state, x, y.astype(float), np.ones(200)))
    alone = {n: m.below(state, n, code, label, times) for n, code, label, times in m.pieces(state, x, y.astype(float))}
    passes = []
    best = FR._best_splits
    monkeypatch.setattr(FR, "_best_splits", lambda *a: passes.append(1) or best(*a))
    together = m.below_all(state, m.pieces(state, x, y.astype(float)))
    assert len(passes) <= 7 * 2 and alone.keys() == together.keys() and len(alone) == 12
    for n, tree in alone.items():
        assert tree["deepest"] == together[n]["deepest"] and all(np.array_equal(tree[k], together[n][k]) for k in ("feature", "bin", "left", "value", "gains"))
    few = 200 * 4 * 3
    monkeypatch.setattr(FR, "TOGETHER", few)
    again = m.below_all(state, m.pieces(state, x, y.astype(float)))
    assert all(np.array_equal(tree["value"], again[n]["value"]) for n, tree in alone.items())


def test_kmeans_makes_many_rounds_of_a_job_and_the_same_ones(spark):
    x = np.random.default_rng(3).random((6000, 2))
    parts = np.array_split(x, 7)
    for max_iter in (300, 9):
        method = K.KMeans(5, seed=1, starts=2, restarts=2, max_iter=max_iter)
        plain, jumping, jobs = method.begin(x), method.begin(x), 0
        while not plain["done"]:
            plain = method.step(plain, sum(method.stats(plain, p, None, None) for p in parts))
        while not jumping["done"]:
            jumping = jumping | {"room": 8_000, "blocks": len(parts)}
            made = [method.parts(jumping, p, None, None) for p in parts]
            assert all(len(raw) < 4 * 8_000 / len(parts) + 2_000 for _, raw in made)
            jumping, jobs = method.leap(jumping, sum(m for m, _ in made), [raw for _, raw in made]), jobs + 1
        assert jumping["rounds"] == plain["rounds"] > 1.5 * jobs and jumping["best"] == plain["best"]
        assert np.allclose(jumping["c"], plain["c"], rtol=1e-9) and np.allclose(jumping["cost"], plain["cost"], rtol=1e-9)


def test_kmeans_jobs_are_fewer_than_rounds(spark):
    x = np.random.default_rng(4).random((4000, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    packed = K.blocks(df, [], "x", ["id"], block_rows=500)
    spark.sparkContext.setJobGroup("rounds", "k-means")
    try:
        model = K.fit(packed, [], K.KMeans(4, starts=1)).first()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model["rounds"] > 20 and jobs < model["rounds"]


def test_machines_of_a_table_of_pairs_of_copies_have_all_folds(spark):
    x = np.random.default_rng(6).normal(size=(60, 2))
    rows = [(v.tolist(), int(v[0] > 0)) for v in x for _ in range(2)]
    df = spark.createDataFrame(rows, "x array<double>, target int")
    models = K.svm_models(df, [], "x", ["x"], "target", folds=2)
    assert len(models.first()["_parts"]) == 2
    assert K.svm_scored(df, models, [], "x").where("(p > 0.5) = (target = 1)").count() > 110
