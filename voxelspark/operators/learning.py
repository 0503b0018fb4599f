"""Voxel classifiers, forests, proximities and clustering on ``pyspark.ml``.

A training table has a ``features`` vector and ``target`` (1 or 0).  Fitted classifiers
add the positive-class probability with ``predict``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    LogisticRegression,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..session import cut_lineage
from . import forests as FR, keyed as K, leave_out as LO
from .columns import standardise
from .ranking import value_prefix
from .sampling import without_group

# Accepted classifier names.
CLASSIFIER_NAMES = {
    "rf": ["rf", "random_forest", "randomforest"],
    "logreg": ["logreg", "logistic", "logistic_regression", "lr"],
    "svm": ["svm", "svc", "svm_linear", "linear_svm"],
    "mlp": ["mlp"],
}
MAX_ANCHORS = 2000
LOOKUP_ROWS = 200_000  # of (tree, leaf, class), 16 bytes each in a task; they pass through the driver
TREE_STEP = 1 << 40
GROUPS = 24  # of blocks whose pairs are compared, where there are as many blocks
GROUP_VALUES = 1_000_000  # in the blocks of a group
SALTS = 16  # into which the rows of a leaf are dealt, over all trees


def classifier_name(name: str) -> str:
    key = str(name).lower().strip()
    for standard, accepted in CLASSIFIER_NAMES.items():
        if key in accepted:
            return standard
    raise ValueError(f"unknown classifier {name!r}")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def balanced_weights(df: DataFrame, target: str = "target", out: str = "weight") -> DataFrame:
    """n / (k n_c) as a column; only the class counts come to the driver."""
    counts = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for c, n in counts.items():
        weight = F.when(F.col(target) == c, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn(out, weight)


def positive_probability(df: DataFrame, out: str = "p") -> DataFrame:
    p = vector_to_array("probability")[1]
    return df.withColumn(out, p).drop("probability", "rawPrediction", "prediction")


@dataclass
class Fitted:
    """A fitted classifier: its name, the Spark models behind it and how to score with them."""

    name: str
    models: list = field(repr=False)
    score: Callable[[DataFrame], DataFrame] = field(repr=False)

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        return self.score(df).withColumnRenamed("_p", out)


def with_array(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", vector_to_array("features"))


def train_forest(df: DataFrame, seed: int = 42, trees: int = 500, depth: int | None = None, min_leaf: int = 1) -> Fitted:
    """Random forest with classes balanced in every bootstrap sample; ``models`` holds the table of its trees."""
    models = cut_lineage(FR.grow(K.blocks(with_array(df), [], "_x", ["_x"], "target"), [], trees, seed, depth, min_leaf))
    return Fitted("rf", [models], lambda d: FR.scored(with_array(d), models, [], "_x", ["_x"], "_p").drop("_x"))


def feature_importances(fitted: Fitted) -> list[float]:
    """Mean share of the impurity that each feature took away in a forest."""
    return FR.importances(fitted.models[0]).first()["importance"]


def train_logistic(df: DataFrame, c: float = 1.0, max_iter: int = 2000) -> Fitted:
    weighted = balanced_weights(df)
    total = weighted.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(
        labelCol="target", weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    model = lr.fit(weighted)
    return Fitted("logreg", [model], lambda d: positive_probability(model.transform(d), "_p"))


def stratified_folds(df: DataFrame, folds: int, ident: str, target: str = "target", out: str = "_f") -> DataFrame:
    """Fold number by seeded order within each class, so every fold holds all classes that have as many rows."""
    df = cut_lineage(df.withColumn("_h", F.xxhash64(F.lit("calibration"), ident)))
    ranks = value_prefix(df, [target], "_h", {"n": F.max(F.lit(1))})
    fold = (F.col("n_before") % folds).cast("int").alias(out)
    return df.join(ranks.select(target, "_h", fold), [target, "_h"]).drop("_h")


def train_svm(df: DataFrame, c: float = 1.0, folds: int = 2) -> Fitted:
    """Linear support vectors (squared hinge) per stratified calibration fold, classes balanced inside the fold, with a
    sigmoid fitted on the held-out margins; probabilities are averaged."""
    models = cut_lineage(K.svm_models(with_array(df), [], "_x", ["_x"], "target", folds, c))
    return Fitted("svm", [models], lambda d: K.svm_scored(with_array(d), models, [], "_x", "_p").drop("_x"))


def train_perceptron(df: DataFrame, seed: int = 42, **options) -> Fitted:
    """Two hidden layers of 32 and 16 rectified units, Adam, early stopping; scale the features before.

    ``models`` holds the weights with the number of epochs and the best one.
    """
    method = K.Perceptron(seed=seed, **options)
    models = cut_lineage(K.fit(K.blocks(with_array(df), [], "_x", ["_x"], "target"), [], method))
    return Fitted("mlp", [models], lambda d: K.perceptron_scored(with_array(d), models, [], "_x", len(method.hidden), "_p").drop("_x"))


def train(name: str, df: DataFrame, seed: int = 42, **options) -> Fitted:
    """Classifier by any accepted name."""
    kind = classifier_name(name)
    if kind == "rf":
        return train_forest(df, seed, **options)
    if kind == "logreg":
        return train_logistic(df, **options)
    if kind == "svm":
        return train_svm(df, **options)
    return train_perceptron(df, seed=seed, **options)


def compare_classifiers(
    train_df: DataFrame, score_df: DataFrame, seed: int = 42, trees: int = 500, depth: int | None = None, svm_folds: int = 3
) -> DataFrame:
    """Forest, SVM and logistic regression on the same sample; ``score_df`` with p_rf, p_svm, p_lr."""
    train_df = cut_lineage(train_df)
    out = train_forest(train_df, seed, trees, depth).predict(score_df, "p_rf")
    out = train_svm(train_df, folds=svm_folds).predict(out, "p_svm")
    return train_logistic(train_df).predict(out, "p_lr")


def leave_one_out_forest(df: DataFrame, group: str, label: str, seed: int = 42, trees: int = 300, depth: int | None = None) -> DataFrame:
    """Probability of each row from the forest trained on all other groups; the forests of all groups grow together.

    Groups whose training rows hold a single class give no rows. Trees share what the groups have in common
    (``leave_out``); above ``leave_out.TASK_ROWS`` labelled rows each group has a table of its own.
    """
    df = cut_lineage(with_array(df))
    shared = LO.scored(df, group, "_x", label, trees, seed, depth)
    if shared is not None:
        return shared.drop("_x")
    rows = without_group(df.where(F.col(label) != -1), group, df, "_held")
    fit_for = rows.groupBy("_held").agg(F.count_distinct(label).alias("_c")).where("_c > 1").select("_held")
    packed = K.blocks(rows.join(fit_for, "_held", "left_semi"), ["_held"], "_x", [group, "_x"], label)
    models = cut_lineage(FR.grow(packed, ["_held"], trees, seed, depth))
    return FR.scored(df.withColumn("_held", F.col(group)), models, ["_held"], "_x", ["_x"], "p").drop("_held", "_x")


# ---- forest proximity ----------------------------------------------------------------------


def leaf_table(fitted: Fitted, df: DataFrame, out: str = "leaves") -> DataFrame:
    """Leaf number of each tree per row."""
    return FR.scored(with_array(df), fitted.models[0], [], "_x", ["_x"], out, leaves=True).drop("_x")


def class_proximity(df: DataFrame, ident: str, klass: str, leaves: str = "leaves", limit: int = LOOKUP_ROWS) -> DataFrame:
    """Mean proximity of each row to all rows of each class (itself included), where it isn't zero.

    The mean needs only the class counts of the row's leaves, so no pair of rows is formed. Counts are added up per task
    first. A table of at most ``limit`` (tree, leaf, class) entries then travels to the rows, which look their leaves up;
    a larger one is met by the leaves in a join, salted where trees are few (a leaf's rows are at most one in as many
    as there are trees).
    """
    sizes = df.groupBy(klass).agg(F.count(F.lit(1)).alias("_size"))
    counts = df.select(klass, F.posexplode(F.col(leaves).cast("array<long>")).alias("tree", "leaf")).groupBy("tree", "leaf", klass).agg(F.count(F.lit(1)).alias("_n"))
    shares = cut_lineage(counts.join(sizes, klass).select("tree", "leaf", klass, (F.col("_n") / F.col("_size")).alias("share")))
    if shares.count() <= limit:
        return _looked_up(df, shares, ident, klass, leaves)
    trees = df.agg(F.max(F.size(leaves))).first()[0]
    salts = max(1, SALTS // max(1, trees))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    entries = shares.groupBy("tree", "leaf").agg(F.collect_list(F.struct(klass, "share")).alias("_s")).select("*", salt)
    long = df.select(ident, F.size(leaves).alias("_t"), F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int").alias("_salt"), F.posexplode(F.col(leaves).cast("array<long>")).alias("tree", "leaf"))
    hits = long.join(entries, ["tree", "leaf", "_salt"]).select(ident, "_t", F.inline("_s"))
    return hits.groupBy(ident, klass).agg((F.sum("share") / F.max("_t")).alias("proximity"))


def _looked_up(df: DataFrame, shares: DataFrame, ident: str, klass: str, leaves: str) -> DataFrame:
    table = shares.toPandas()
    names = [r[0] for r in shares.select(klass).distinct().collect()]
    place = {name: i for i, name in enumerate(names)}
    keys = table["tree"].to_numpy(np.int64) * TREE_STEP + table["leaf"].to_numpy(np.int64)
    known, at = np.unique(keys, return_inverse=True)
    share = np.zeros((len(known) + 1, len(names)))  # the last row stands for a leaf without training rows
    share[at, [place[k] for k in table[klass]]] = table["share"]

    @F.pandas_udf("array<double>")
    def means(col: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(col), 1000):
            own = np.stack(col.iloc[a : a + 1000].to_numpy()).astype(np.int64)
            own = own + np.arange(own.shape[1]) * TREE_STEP
            i = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            i = np.where(known[i] == own, i, len(known)) if len(known) else np.zeros_like(own)
            out += list(share[i].mean(1))
        return pd.Series(out)

    kind = df.schema[klass].dataType
    listed = F.array(*[F.lit(n).cast(kind) for n in names])
    pairs = F.arrays_zip(listed.alias("k"), means(F.col(leaves).cast("array<long>")).alias("v"))
    rows = df.select(ident, F.explode(pairs).alias("_p")).select(ident, F.col("_p.k").alias(klass), F.col("_p.v").alias("proximity"))
    return rows.where("proximity > 0")


def anchor_proximity(df: DataFrame, anchors: DataFrame, ident: str, leaves: str = "leaves", out: str = "proximity") -> DataFrame:
    """Proximity of each row to each anchor as one array, in the order of the anchors' ids.

    Anchors are a sample of at most ``MAX_ANCHORS`` rows (checked), so they travel to the tasks.
    """
    rows = anchors.select(ident, leaves).orderBy(ident).limit(MAX_ANCHORS + 1).collect()
    if len(rows) > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors; draw a sample first")
    table = np.array([r[leaves] for r in rows])

    @F.pandas_udf("array<double>")
    def compare(col: pd.Series) -> pd.Series:
        own = np.stack(col.to_numpy())
        near = np.zeros((len(own), len(table)))
        for t in range(table.shape[1]):  # one tree at a time: rows x anchors, never rows x anchors x trees
            near += own[:, t, None] == table[None, :, t]
        return pd.Series(list(near / table.shape[1]))

    return df.withColumn(out, compare(leaves))


# ---- clustering ----------------------------------------------------------------------------


def principal_components(df: DataFrame, cols: Sequence[str], cap: int = 10, fit: Column | None = None) -> tuple[DataFrame, list[str], list[float]]:
    """Centred projection on at most ``cap`` components; returns table, component columns, variance shares.

    Mean and components come from the ``fit`` rows only.
    """
    rows = df if fit is None else df.where(fit)
    n = rows.count()
    k = max(1, min(cap, len(cols), n - 1))
    means = rows.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centre = lambda d: assemble(d.withColumns({f"_c{i}": F.col(c) - means[c] for i, c in enumerate(cols)}), [f"_c{i}" for i in range(len(cols))], "_v")
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(centre(rows))
    names = [f"pc{i + 1}" for i in range(k)]
    arr = vector_to_array("_pc")
    out = model.transform(centre(df)).select(*df.columns, *[arr[i].alias(n) for i, n in enumerate(names)])
    return out, names, [float(v) for v in model.explainedVariance]


def fit_clusters(df: DataFrame, cols: Sequence[str], k: int, algo: str = "gmm", seed: int = 42, restarts: int = 1, starts: int | None = None) -> DataFrame:
    """Column ``cluster``; of several restarts the one with the highest Calinski-Harabasz index wins.

    Each restart is the best of ``starts`` fits, 10 for k-means and 3 for mixtures unless given; all of them advance together.
    """
    rows = cut_lineage(df.withColumn("_z", F.array(*[F.col(c).cast("double") for c in cols])))
    out = cut_lineage(K.cluster_keys(rows, [], "_z", list(cols), k, algo, seed, restarts, starts))
    if restarts > 1 and out.select("cluster").distinct().count() < 2:
        raise RuntimeError(f"{algo} gave no valid clustering")
    return out.drop("_z")


def cluster_profile(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Size, centroid and population variances of each cluster: one row per cluster."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("centre"),
        F.array(*[F.var_pop(c) for c in cols]).alias("variance"),
    )


def cluster_indices(df: DataFrame, cols: Sequence[str], cluster: str) -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin from per-cluster aggregates (k rows reach the driver)."""
    rows = cluster_profile(df, cols, cluster).collect()
    k, n = len(rows), sum(r["n"] for r in rows)
    if k < 2 or k >= n:
        return {"calinski_harabasz": math.nan, "davies_bouldin": math.nan}
    size = np.array([r["n"] for r in rows], dtype=float)
    centre = np.array([r["centre"] for r in rows])
    within = (size[:, None] * np.array([r["variance"] for r in rows])).sum()
    middle = (size[:, None] * centre).sum(axis=0) / n
    between = (size[:, None] * (centre - middle) ** 2).sum()
    ch = between * (n - k) / (within * (k - 1)) if within > 0 else 1.0

    own = F.lit(None).cast("double")
    for r in rows:
        d = sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cols, r["centre"])), F.lit(0.0))
        own = F.when(F.col(cluster) == r[cluster], F.sqrt(d)).otherwise(own)
    spread = {r[cluster]: r["s"] for r in df.groupBy(cluster).agg(F.avg(own).alias("s")).collect()}
    s = np.array([spread[r[cluster]] for r in rows])
    worst = np.zeros(k)
    for i, j in itertools.combinations(range(k), 2):
        gap = float(np.sqrt(((centre[i] - centre[j]) ** 2).sum()))
        ratio = (s[i] + s[j]) / gap if gap > 0 else 0.0
        worst[i], worst[j] = max(worst[i], ratio), max(worst[j], ratio)
    return {"calinski_harabasz": float(ch), "davies_bouldin": float(worst.mean())}


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str, ident: str) -> DataFrame:
    """Silhouette of every row with squared Euclidean distances.

    The mean squared distance to a cluster follows from its size, column means and mean squared norm, so each
    row needs one comparison per cluster and no other row; one record per cluster reaches the driver.
    """
    middle = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shifted = df.select(ident, cluster, *[(F.col(c) - F.lit(middle[c])).alias(c) for c in cols])
    norm = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    groups = shifted.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("centre"), F.avg(norm).alias("norm")).collect()
    own, n_own, other = F.lit(None).cast("double"), F.lit(None).cast("long"), []
    for g in groups:
        mean = norm + g["norm"] - 2.0 * sum((F.col(c) * v for c, v in zip(cols, g["centre"])), F.lit(0.0))
        here = F.col(cluster).eqNullSafe(F.lit(g[cluster]))
        own = F.when(here, mean * g["n"] / max(1, g["n"] - 1)).otherwise(own)
        n_own = F.when(here, F.lit(g["n"])).otherwise(n_own)
        other.append(F.when(~here, mean))
    rows = shifted.withColumns({"_a": F.greatest(own, F.lit(0.0)), "_b": F.greatest(F.array_min(F.array(*other)), F.lit(0.0)), "_n": n_own})
    wide = F.greatest("_a", "_b")
    value = F.when((F.col("_n") <= 1) | F.lit(len(groups) < 2) | (wide == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / wide)
    return rows.select(ident, cluster, value.alias("silhouette"))


def distance_sums(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the Euclidean distances of each row of ``a`` to all of ``b``, and of each row of ``b`` to all of ``a``."""
    step = max(1, 65_536 // len(b))  # half a megabyte at a time stays in the cache
    rows, columns, bt = np.empty(len(a)), np.zeros(len(b)), np.ascontiguousarray(b.T)
    total, part = np.empty((2, step, len(b)))
    for i in range(0, len(a), step):
        own = a[i : i + step]
        d, e = total[: len(own)], part[: len(own)]
        d[:] = 0.0
        for j, line in enumerate(bt):
            np.subtract(own[:, j, None], line, out=e)
            np.multiply(e, e, out=e)
            np.add(d, e, out=d)
        np.sqrt(d, out=d)
        rows[i : i + step] = d.sum(1)
        columns += d.sum(0)
    return rows, columns


def euclidean_silhouette(df: DataFrame, cols: Sequence[str], cluster: str, ident: str, block_rows: int = 2_000) -> DataFrame:
    """Silhouette of every row with Euclidean distances, from exact distance sums.

    Rows are packed into blocks of one cluster each. The mean distance of a row to a cluster lies between the distance
    to its centre and the root of the mean squared distance; a cluster whose lower bound is above the least upper bound
    of every row of a block can't be the nearest one and is skipped. Blocks are dealt into groups, a task compares the
    blocks of two groups, and the distances of two blocks are added up for the rows of both at once.
    """
    kind = df.schema[cluster].dataType
    rows = df.select(F.col(ident).alias("_id"), F.col(cluster).alias("_c"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    packed = cut_lineage(K.row_blocks(rows, ["_c"], "_v", ["_id"], block_rows).drop("_key"))
    profile = cluster_profile(df, cols, cluster).collect()
    names = [r[cluster] for r in profile]
    size = np.array([r["n"] for r in profile], float)
    centre = np.array([r["centre"] for r in profile]).reshape(len(profile), -1)
    spread = np.array([r["variance"] for r in profile]).reshape(len(profile), -1).sum(1)

    @F.pandas_udf("array<int>")
    def wanted(x: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for raw, c in zip(x, own):
            v = np.frombuffer(raw).reshape(-1, len(cols))
            gap = ((v[:, None] - centre) ** 2).sum(2)
            low, high = np.sqrt(gap) * (1 - 1e-9), np.sqrt(gap + spread) * (1 + 1e-9)
            high[:, c] = np.inf
            near = (low <= high.min(1, keepdims=True)).any(0)
            near[c] = True
            out.append(np.flatnonzero(near).astype(np.int32))
        return pd.Series(out)

    number = F.create_map(*[v for i, n in enumerate(names) if n is not None for v in (F.lit(n).cast(kind), F.lit(i))]) if any(n is not None for n in names) else None
    nulls = F.lit(names.index(None) if None in names else None).cast("int")
    index = F.when(F.col("_c").isNull(), nulls).otherwise(F.element_at(number, F.col("_c"))) if number is not None else nulls
    packed = cut_lineage(packed.withColumn("_i", index.cast("int")))
    groups = int(max(1, min(packed.count(), GROUPS), -(-size.sum() * len(cols) // GROUP_VALUES)))
    group = F.pmod(F.xxhash64("_i", "_block"), F.lit(groups)).cast("int").alias("_g")
    asked = packed.select("_i", "_block", "x", wanted("x", "_i").alias("_w"), group)
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: F.struct(F.least("_g", h).alias("_lo"), F.greatest("_g", h).alias("_hi"))))
    dealt = asked.select("*", cells.alias("_cell")).select("_i", "_block", "x", "_w", "_g", "_cell._lo", "_cell._hi")

    def compared(table: pa.Table) -> pa.Table:
        rows, sums = table.to_pylist(), {}
        for r in rows:
            r["x"] = np.frombuffer(r["x"]).reshape(-1, len(cols))
        for i, r in enumerate(rows):
            for s in rows[i:]:
                if r["_lo"] < r["_hi"] and r["_g"] == s["_g"]:
                    continue  # two blocks of one group meet in the group's own cell
                there, back = s["_i"] in r["_w"], s is not r and r["_i"] in s["_w"]
                if there or back:
                    first, second = distance_sums(r["x"], s["x"])
                    for wants, own, other, part in ((there, r, s, first), (back, s, r, second)):
                        if wants:
                            at = (own["_i"], own["_block"], other["_i"])
                            sums[at] = sums[at] + part if at in sums else part
        names = ("_i", "_block", "_j")
        made = {n: pa.array([at[k] for at in sums], pa.int32()) for k, n in enumerate(names)}
        return pa.table(made | {"_s": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    cells = groups * (groups + 1) // 2  # a partition each, which adaptive execution leaves as they are
    pairs = dealt.repartition(cells, "_lo", "_hi").groupBy("_lo", "_hi").applyInArrow(compared, "_i int, _block int, _j int, _s array<double>")
    total = pairs.groupBy("_i", "_block", "_j").agg(A.vector_sum(F.col("_s")).alias("_s"))
    count = F.element_at(F.array(*[F.lit(v) for v in size]), F.col("_j") + 1)
    own = F.col("_i") == F.col("_j")
    mean = F.transform("_s", lambda s: s / F.when(own, F.greatest(count - 1, F.lit(1.0))).otherwise(count))
    far = total.select("_i", "_block", own.alias("_own"), mean.alias("_m")).groupBy("_i", "_block").agg(
        F.max(F.when(F.col("_own"), F.col("_m"))).alias("_a"), F.collect_list(F.when(~F.col("_own"), F.col("_m"))).alias("_o")
    )
    joined = packed.select("_i", "_block", "_rows").join(far, ["_i", "_block"])
    each = joined.select("_i", F.posexplode("_rows").alias("_k", "_r"), "_a", "_o")
    a, b = F.get("_a", F.col("_k")), F.array_min(F.transform("_o", lambda o: F.get(o, F.col("_k"))))
    alone = (F.element_at(F.array(*[F.lit(v) for v in size]), F.col("_i") + 1) <= 1) | F.lit(len(names) < 2)
    each = each.select("_r._id", "_r._c", alone.alias("_alone"), a.alias("_a"), b.alias("_b"))
    wide = F.greatest("_a", "_b")
    value = F.when(F.col("_alone") | (wide == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / wide)
    return each.select(F.col("_id").alias(ident), F.col("_c").alias(cluster), value.alias("silhouette"))


def multinomial(df: DataFrame, label: str, c: float = 1.0, max_iter: int = 500):
    """Multinomial logistic regression with an L2 penalty of 1/C."""
    n = df.count()
    return LogisticRegression(
        labelCol=label, family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    ).fit(df)


def class_probabilities(df: DataFrame) -> Column:
    return vector_to_array("probability")


def scaled(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), fit: Column | None = None) -> DataFrame:
    return standardise(df, keys, cols, fit)
