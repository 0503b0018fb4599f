"""Registered queries: classifiers, forests, proximities, clustering."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window as W, functions as F

from .. import fixtures as fx
from ..functions import series as TS
from ..operators import columns as C, evaluation as E, learning as L, quality as Q
from ..operators.grid import Grid
from ..operators.ranking import choose
from ..plans import clustering as PC, experiment as PX
from ..session import cut_lineage
from .hotspots import MIN_DIST, MIN_VOXELS
from .morphology import GRID, KEYS, SPACING
from .registry import query
from .splits import _POOL, pools_of
from .timeseries import _VQ, auto_labels
from .voxels import masks_table

SGRID = Grid(5, 5, 5, fx.VX, fx.VY, fx.VZ)
_BY_TARGET = "SELECT CAST(label<5 AS INT) AS target, COUNT(*) AS n, COUNT(*) AS in_range, true AS learnt FROM series GROUP BY 1"


def samples(spark, sf, target=None):
    """Normalised series as features, half of the labels as target unless given, every fourth voxel for validation."""
    target = F.expr("CAST(label < 5 AS INT)") if target is None else target
    df = fx.series(spark, sf)
    return cut_lineage(
        df.select(
            "patient", "flat_idx", target.alias("target"), F.expr("flat_idx % 4 = 0").alias("val"), array_to_vector(TS.ts_normalized(F.col("ts"))).alias("features")
        )
    )


def _judged(p, floor, on="NOT val"):
    """Per target: rows, probabilities within 0 and 1, and whether the AUC on the training (or other) rows reaches ``floor``."""
    p = cut_lineage(p.select("target", "val", "p"))
    auc = E.ranked_metrics(E.score_table(p.where(on), [], "target", "p"), [], "p").first()["val_auc"]
    rows = p.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").between(0, 1)).alias("in_range"))
    return rows.withColumn("learnt", F.lit(auc >= floor))


def _fq(name: str):
    return query(name, "target:i n:i in_range:i learnt:b", fx.with_views(_BY_TARGET, "series"))


def _scored(spark, sf, name, **options):
    df = samples(spark, sf)
    return L.train(name, df.where("NOT val"), **options).predict(df)


@_fq("l2_random_forest")
def forest(spark, sf):
    """The full forest separates its own training rows."""
    return _judged(_scored(spark, sf, "Random_Forest"), 0.99)


@query(
    "l3_positive_probability",
    "target:i n:i in_range:i above:b",
    fx.with_views("SELECT CAST(label<5 AS INT) AS target, COUNT(*) AS n, COUNT(*) AS in_range, label<5 AS above FROM series WHERE flat_idx%4<>0 GROUP BY 1, 4", "series"),
)
def probability(spark, sf):
    """The column of class 1: on training rows its mean is above a half for positives and below for negatives."""
    p = _scored(spark, sf, "rf").where("NOT val")
    in_range = F.count_if(F.col("p").between(0, 1)).alias("in_range")
    return p.groupBy("target").agg(F.count(F.lit(1)).alias("n"), in_range, (F.avg("p") > 0.5).alias("above"))


@query("l4_feature_importance", "n:i total:d6 negative:i", "SELECT 64 AS n, 1.0 AS total, 0 AS negative FROM (SELECT COUNT(*) FROM embeddings)")
def importance(spark, sf):
    """One importance per frame; they are not negative and sum to one."""
    df = samples(spark, sf)
    fitted = L.train_forest(df.where("NOT val"))
    values = [float(v) for v in L.feature_importances(fitted)]
    rows = spark.createDataFrame([(v,) for v in values], "importance double")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


@query(
    "l5_calibrated_svm",
    "target:i n:i in_range:i learnt:b",
    fx.with_views("SELECT CAST(ts[4]+ts[12]>200 AS INT) AS target, COUNT(*) AS n, COUNT(*) AS in_range, true AS learnt FROM series GROUP BY 1", "series"),
)
def svm(spark, sf):
    """The machine finds a rule of two frames and tells it on voxels that it was not trained on.

    On the table's labels, which have nothing to do with the series, only a small sample reaches any score above a half.
    """
    df = samples(spark, sf, (F.col("ts")[3] + F.col("ts")[11] > 200).cast("int"))
    return _judged(L.train("linear_svm", df.where("NOT val")).predict(df), 0.85, "val")


@query("l6_logistic_regression", "n:i in_range:i optimal:b", fx.with_views("SELECT COUNT(*) AS n, COUNT(*) AS in_range, true AS optimal FROM series WHERE flat_idx%4<>0", "series"))
def logistic(spark, sf):
    """The gradient of the balanced, penalised loss vanishes at the fitted weights."""
    df = samples(spark, sf).where("NOT val")
    fitted = L.train("logistic", df)
    w = [float(v) for v in fitted.models[0].coefficients]
    rows = cut_lineage(L.balanced_weights(fitted.predict(df)).withColumn("x", vector_to_array("features")))
    pull = [F.sum(F.col("weight") * (F.col("p") - F.col("target")) * F.col("x")[i]) for i in range(len(w))]
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").between(0, 1)).alias("in_range"), F.sum("weight").alias("total"), F.array(*pull).alias("g")).first()
    steepest = max(abs(g + v) for g, v in zip(r["g"], w)) / r["total"]
    return spark.createDataFrame([(r["n"], r["in_range"], bool(steepest < 1e-4))], "n long, in_range long, optimal boolean")


@query(
    "l8_perceptron",
    "target:i n:i in_range:i learnt:b",
    fx.with_views("SELECT CAST(ts[4]+ts[12]>200 AS INT) AS target, COUNT(*) AS n, COUNT(*) AS in_range, true AS learnt FROM series GROUP BY 1", "series"),
)
def perceptron(spark, sf):
    """The perceptron finds a rule of two frames and tells it on voxels that it was not trained on.

    The table's labels have nothing to do with the series, so a network that stops early rightly learns nothing from them.
    """
    names = [f"t{i}" for i in range(64)]
    df = fx.series(spark, sf).select(
        "patient", "flat_idx", (F.col("ts")[3] + F.col("ts")[11] > 200).cast("int").alias("target"), F.expr("flat_idx % 4 = 0").alias("val"), *[F.col("ts")[i].alias(n) for i, n in enumerate(names)]
    )
    df = cut_lineage(L.assemble(C.standardise(df, [], names, fit=~F.col("val")), names))
    return _judged(L.train("mlp", df.where("NOT val"), batch=16).predict(df), 0.85, "val")


@query("l9_three_classifiers", "clf valid:b", "SELECT unnest(['rf', 'svm', 'lr']) AS clf, true AS valid FROM (SELECT COUNT(*) FROM embeddings)")
def three_classifiers(spark, sf):
    """Three classifiers on one sample; their metrics on the same validation voxels are defined and within 0 and 1."""
    df = samples(spark, sf)
    p = L.compare_classifiers(df.where("NOT val"), df.where("val"))
    long = E.unpivot(p, ["patient", "flat_idx", "target"], {"rf": "p_rf", "svm": "p_svm", "lr": "p_lr"})
    metrics = E.validation_metrics(cut_lineage(long), ["clf"], "target", "score")
    within = [F.coalesce(F.col(m).between(0, 1), F.lit(False)) for m in ("val_auc", "val_ap", "val_brier", "val_bal_acc")]
    return metrics.select("clf", (within[0] & within[1] & within[2] & within[3]).alias("valid"))


_NAMES = ", ".join(f"('{name.upper()} ', '{standard}')" for standard, accepted in L.CLASSIFIER_NAMES.items() for name in accepted)


@query("x2_classifier_registry", "name clf n:i", f"SELECT name, clf, n FROM (VALUES {_NAMES}) t(name, clf), (SELECT COUNT(*) AS n FROM embeddings)")
def classifier_registry(spark, sf):
    """Every accepted name, in any case and with blanks, leads to its classifier, which fits the same sample."""
    df = samples(spark, sf)
    n = {}
    for name in ("rf", "logreg", "svm", "mlp"):
        n[name] = L.train(name, df.where("NOT val")).predict(df).where("p BETWEEN 0 AND 1").count()
    rows = [(f"{name.upper()} ", L.classifier_name(f"{name.upper()} ")) for accepted in L.CLASSIFIER_NAMES.values() for name in accepted]
    return spark.createDataFrame([(name, kind, n[kind]) for name, kind in rows], "name string, clf string, n long")


@query(
    "l10_leave_one_out_forest",
    "patient:i n:i in_range:i",
    fx.with_views("SELECT patient, COUNT(*) AS n, COUNT(*) AS in_range FROM al GROUP BY 1", "slong", extra=_VQ),
)
def leave_one_out(spark, sf):
    """Quality forest of each held-out patient: every voxel of the patient gets a probability."""
    df = L.assemble(auto_labels(spark, sf), Q.VOXEL_FEATURES)
    scored = cut_lineage(L.leave_one_out_forest(df, "patient", "quality"))
    return scored.groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").between(0, 1)).alias("in_range"))


# ---- proximity -----------------------------------------------------------------------------

_LEAF_SQL = {
    "lf": "SELECT flat_idx+patient*1000 AS id, label%2 AS k, [floor(ts[1]/2), floor(ts[9]/3), floor(ts[17]/4), floor(ts[33]/5)] AS lv FROM series",
    "pp": "SELECT a.id, b.id AS other, b.k, (CAST(a.lv[1]=b.lv[1] AS INT)+CAST(a.lv[2]=b.lv[2] AS INT)+CAST(a.lv[3]=b.lv[3] AS INT)+CAST(a.lv[4]=b.lv[4] AS INT))/4.0 AS pr FROM lf a, lf b",
}


def _leaves(spark, sf):
    pick = [F.floor(F.col("ts")[i] / d) for i, d in ((0, 2), (8, 3), (16, 4), (32, 5))]
    return fx.series(spark, sf).select((F.col("flat_idx") + F.col("patient") * 1000).alias("id"), (F.col("label") % 2).alias("k"), F.array(*pick).alias("leaves"))


@query(
    "j10_class_proximity",
    "id:i k:i proximity:d6",
    fx.with_views("SELECT id, k, AVG(pr) AS proximity FROM pp GROUP BY 1,2 HAVING SUM(pr)>0", "series", extra=_LEAF_SQL),
)
def class_proximity(spark, sf):
    """Mean proximity to each class on a given leaf table, without pairs."""
    return L.class_proximity(_leaves(spark, sf), "id", "k")


@query(
    "j10_anchor_proximity",
    "id:i ws:d6",
    fx.with_views(
        "SELECT p.id, SUM(pr*(pos*7%11+1)) AS ws FROM pp p JOIN (SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS pos FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY md5('42:'||id), id) AS r FROM lf) WHERE r<=50) a ON a.id=p.other GROUP BY 1",
        "series",
        extra=_LEAF_SQL,
    ),
)
def anchor_proximity(spark, sf):
    """Proximity rows against a seeded sample of 50 anchors."""
    leaves = cut_lineage(_leaves(spark, sf))
    near = L.anchor_proximity(leaves, choose(leaves, [], "id", 50), "id")
    weighted = F.transform("proximity", lambda v, i: v * (((i + 1) * 7) % 11 + 1))
    return near.withColumn("ws", F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v))


@query(
    "j10_forest_proximity",
    "target:i klass:i n:i in_range:i nearer:b",
    fx.with_views("SELECT a.target, b.klass, n, n AS in_range, a.target=b.klass AS nearer FROM (SELECT CAST(label<5 AS INT) AS target, COUNT(*) AS n FROM series WHERE flat_idx%4<>0 GROUP BY 1) a, (SELECT unnest([0, 1]) AS klass) b", "series"),
)
def forest_proximity(spark, sf):
    """Class proximity from the leaves of a full forest: training rows are nearer to their own class."""
    df = samples(spark, sf).where("NOT val").withColumn("id", F.col("flat_idx") + F.col("patient") * 1000)
    fitted = L.train_forest(df)
    leaves = cut_lineage(L.leaf_table(fitted, df).select("id", "target", "leaves"))
    near = L.class_proximity(leaves, "id", "target").withColumnRenamed("target", "klass")
    pairs = leaves.select("id", "target").join(spark.createDataFrame([(0,), (1,)], "klass int"), F.lit(True)).join(near, ["id", "klass"], "left")
    rows = pairs.fillna(0.0, ["proximity"]).groupBy("target", "klass").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("proximity").between(0, 1)).alias("in_range"), F.avg("proximity").alias("m"))
    best = rows.groupBy("target").agg(F.max("m").alias("top"))
    return rows.join(best, "target").withColumn("nearer", F.col("m") == F.col("top"))


# ---- clustering ----------------------------------------------------------------------------

DIMS = ["a", "b", "c"]


def _points(spark, sf):
    df = fx.series(spark, sf)
    return df.select((F.col("flat_idx") + F.col("patient") * 1000).alias("id"), "label", *[F.col("ts")[i].alias(n) for i, n in ((0, "a"), (20, "b"), (40, "c"))])


_PTS = {"pt": "SELECT flat_idx+patient*1000 AS id, label, ts[1] AS a, ts[21] AS b, ts[41] AS c FROM series"}


@query(
    "l11_variance_threshold",
    "column_name",
    fx.with_views(
        " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM pt2 HAVING var_pop({c})>1e-8" for c in ("a", "b", "c", "k", "tiny")),
        "series",
        extra={**_PTS, "pt2": "SELECT *, 3.0::DOUBLE AS k, a*1e-6::DOUBLE AS tiny FROM pt"},
    ),
)
def variance_threshold(spark, sf):
    """Columns kept out of five, two of them nearly constant."""
    df = _points(spark, sf).withColumns({"k": F.lit(3.0), "tiny": F.col("a") * 1e-6})
    kept = C.varying_columns(df, ["a", "b", "c", "k", "tiny"])
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


@query(
    "l12_principal_components",
    "component:i share_fits:b uncorrelated:b falling:b",
    "SELECT unnest([0, 1, 2]) AS component, true AS share_fits, true AS uncorrelated, true AS falling FROM (SELECT COUNT(*) FROM embeddings)",
)
def principal_components(spark, sf):
    """Components are uncorrelated, fall in variance, and their variances have the reported shares."""
    df, names, shares = L.principal_components(cut_lineage(_points(spark, sf)), DIMS)
    cov = df.agg(*[F.covar_samp(a, b).alias(f"{a}_{b}") for a in names for b in names]).first()
    spread = [cov[f"{a}_{a}"] for a in names]
    total = sum(spread)
    rows = [
        (i, abs(spread[i] / total - shares[i]) < 1e-9, all(abs(cov[f"{a}_{b}"]) < 1e-9 * total for b in names if b != a), i == 0 or spread[i] <= spread[i - 1])
        for i, a in enumerate(names)
    ]
    return spark.createDataFrame(rows, "component int, share_fits boolean, uncorrelated boolean, falling boolean")


@query(
    "l12_total_variance",
    "total:d4 share:d6",
    fx.with_views("SELECT var_samp(a)+var_samp(b)+var_samp(c) AS total, 1.0 AS share FROM pt", "series", extra=_PTS),
)
def total_variance(spark, sf):
    """All components together keep the whole variance."""
    df, names, shares = L.principal_components(cut_lineage(_points(spark, sf)), DIMS)
    total = sum((F.var_samp(n) for n in names), F.lit(0.0))
    return df.agg(total.alias("total")).withColumn("share", F.lit(sum(shares)))


@query(
    "l15_cluster_indices",
    "calinski_harabasz:d6 davies_bouldin:d6",
    fx.with_views(
        "SELECT (SELECT SUM(n*(pow(ca-ga,2)+pow(cb-gb,2)+pow(cc-gc,2)))/(COUNT(*)-1) FROM ce, (SELECT AVG(a) AS ga, AVG(b) AS gb, AVG(c) AS gc FROM pt)) / "
        "(SELECT SUM(d*d)/(COUNT(*)-(SELECT COUNT(*) FROM ce)) FROM di) AS calinski_harabasz, (SELECT AVG(w) FROM (SELECT p.label, MAX((p.s+q.s)/sqrt(pow(p.ca-q.ca,2)+pow(p.cb-q.cb,2)+pow(p.cc-q.cc,2))) AS w "
        "FROM sp p JOIN sp q ON p.label<>q.label GROUP BY 1)) AS davies_bouldin",
        "series",
        extra={
            **_PTS,
            "ce": "SELECT label, COUNT(*) AS n, AVG(a) AS ca, AVG(b) AS cb, AVG(c) AS cc FROM pt GROUP BY 1",
            "di": "SELECT pt.label, sqrt(pow(a-ca,2)+pow(b-cb,2)+pow(c-cc,2)) AS d FROM pt JOIN ce ON ce.label=pt.label",
            "sp": "SELECT ce.*, (SELECT AVG(d) FROM di WHERE di.label=ce.label) AS s FROM ce",
        },
    ),
)
def cluster_indices(spark, sf):
    df = cut_lineage(_points(spark, sf))
    v = L.cluster_indices(df, DIMS, "label")
    return spark.createDataFrame([v])


@query(
    "l15_silhouette",
    "id:i label:i silhouette:d6",
    fx.with_views(
        "SELECT id, label, CASE WHEN MAX(CASE WHEN l2=label THEN n END)<=1 THEN 0 ELSE (MIN(CASE WHEN l2<>label THEN s/n END)-MAX(CASE WHEN l2=label THEN s/(n-1) END))"
        "/GREATEST(MIN(CASE WHEN l2<>label THEN s/n END), MAX(CASE WHEN l2=label THEN s/(n-1) END)) END AS silhouette FROM "
        "(SELECT p.id, p.label, q.label AS l2, SUM(pow(p.a-q.a,2)+pow(p.b-q.b,2)+pow(p.c-q.c,2)) AS s, COUNT(*) AS n FROM pt p, pt q GROUP BY 1,2,3) GROUP BY 1,2",
        "series",
        extra=_PTS,
    ),
)
def silhouette(spark, sf):
    return L.silhouette(_points(spark, sf), DIMS, "label", "id")


@query(
    "l15_euclidean_silhouette",
    "id:i label:i silhouette:d6",
    fx.with_views(
        "SELECT id, label, CASE WHEN MAX(CASE WHEN l2=label THEN n END)<=1 THEN 0 ELSE (MIN(CASE WHEN l2<>label THEN s/n END)-MAX(CASE WHEN l2=label THEN s/(n-1) END))"
        "/GREATEST(MIN(CASE WHEN l2<>label THEN s/n END), MAX(CASE WHEN l2=label THEN s/(n-1) END)) END AS silhouette FROM "
        "(SELECT p.id, p.label, q.label AS l2, SUM(sqrt(pow(p.a-q.a,2)+pow(p.b-q.b,2)+pow(p.c-q.c,2))) AS s, COUNT(*) AS n FROM pt p, pt q GROUP BY 1,2,3) GROUP BY 1,2",
        "series",
        extra=_PTS,
    ),
)
def euclidean_silhouette(spark, sf):
    return L.euclidean_silhouette(cut_lineage(_points(spark, sf)), DIMS, "label", "id")


_ALL = "SELECT COUNT(*) AS n, 0 AS misplaced, {k} AS clusters FROM embeddings"


def _nearest(df):
    """Rows, rows that are not at the nearest cluster mean, and clusters."""
    df = cut_lineage(df)
    centres = [(r["cluster"], r["centre"]) for r in L.cluster_profile(df, DIMS, "cluster").collect()]
    far = lambda c: sum(((F.col(d) - v) * (F.col(d) - v) for d, v in zip(DIMS, c)), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col("cluster") == k, far(c)) for k, c in centres])
    least = F.least(*[far(c) for _, c in centres])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(own > least + 1e-9).alias("misplaced"), F.count_distinct("cluster").alias("clusters"))


@query("l13_kmeans", "n:i misplaced:i clusters:i", _ALL.format(k=3))
def kmeans(spark, sf):
    """Every row is at its nearest cluster mean."""
    return _nearest(L.fit_clusters(_points(spark, sf), DIMS, 3, "kmeans"))


@query("l13_gaussian_mixture", "n:i named:i clusters:i", "SELECT COUNT(*) AS n, COUNT(*) AS named, 3 AS clusters FROM embeddings")
def mixture(spark, sf):
    """Every row has one of the three components, none of which is empty."""
    df = L.fit_clusters(_points(spark, sf), DIMS, 3, "gmm")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster").between(0, 2)).alias("named"), F.count_distinct("cluster").alias("clusters"))


@query("l14_restart_selection", "n:i clusters:i best:b", "SELECT COUNT(*) AS n, 4 AS clusters, true AS best FROM embeddings")
def restarts(spark, sf):
    """The kept restart has the largest index of all restarts."""
    df = cut_lineage(_points(spark, sf))
    index = lambda d: L.cluster_indices(d, DIMS, "cluster")["calinski_harabasz"]
    kept = cut_lineage(L.fit_clusters(df, DIMS, 4, "kmeans", restarts=3, starts=1))
    each = [index(L.fit_clusters(df, DIMS, 4, "kmeans", seed=42 + r, starts=1)) for r in range(3)]
    best = bool(index(kept) >= max(each) - 1e-6)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters")).withColumn("best", F.lit(best))


_R2 = "((x-2)*(x-2)+(y-2)*(y-2)+(z-2)*(z-2))"


def _clinical(spark, sf):
    """Series with a small tumour, partial volumes and two structural maps."""
    from ..operators import masks as M

    df = fx.series(spark, sf)
    df = df.withColumns(
        {
            "brain": F.lit(True),
            "seg": F.expr(f"CASE WHEN {_R2}<=1 THEN 1 WHEN {_R2}<=2 THEN 3 WHEN {_R2}<=4 THEN 2 ELSE 0 END"),
            "gm_pve": F.expr("CASE WHEN x<2 THEN 0.9D ELSE 0.1D END"),
            "wm_pve": F.expr("CASE WHEN x>2 THEN 0.9D ELSE 0.1D END"),
            "t1": F.get("ts", F.lit(3)),
            "t2": F.get("ts", F.lit(7)),
        }
    )
    return cut_lineage(M.region_flags(df.drop("label", "wm"), "seg"))


_PER_PATIENT = "SELECT patient, COUNT(*) AS n, {k} AS clusters, 0 AS misplaced FROM series GROUP BY 1"


def _clusters_of(df):
    """Per patient: rows, clusters, and rows that are not at the nearest of the patient's own cluster means."""
    df = cut_lineage(df)
    parts = F.array(*[F.coalesce(c, F.lit(0.0)) for c in df.columns if c.startswith("pc")])
    rows = df.select("patient", "cluster", parts.alias("z"))
    size = len([c for c in df.columns if c.startswith("pc")])
    means = rows.groupBy("patient", "cluster").agg(F.array(*[F.avg(F.col("z")[i]) for i in range(size)]).alias("m"))
    means = means.groupBy("patient").agg(F.collect_list(F.struct("cluster", "m")).alias("_m"))
    gap = lambda m: F.aggregate(F.zip_with("z", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    far = F.transform("_m", lambda e: F.struct(e["cluster"].alias("cluster"), gap(e["m"]).alias("d")))
    rows = rows.join(means, "patient").select("patient", "cluster", far.alias("far"))
    own = F.filter("far", lambda e: e["cluster"] == F.col("cluster"))[0]["d"]
    off = own > F.array_min(F.transform("far", lambda e: e["d"])) + 1e-9
    return rows.groupBy("patient").agg(F.count("cluster").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(off).alias("misplaced"))


@query("l16_bold_clustering", "patient:i n:i clusters:i misplaced:i", fx.with_views(_PER_PATIENT.format(k=4), "series"))
def bold_clustering(spark, sf):
    """Every voxel of every patient has one of the patient's own clusters."""
    return _clusters_of(PC.cluster(" BOLD", fx.series(spark, sf).drop("label", "wm"), KEYS, SGRID, algo="kmeans"))


@query("l17_multimodal_clustering", "patient:i n:i clusters:i misplaced:i", fx.with_views(_PER_PATIENT.format(k=3), "series"))
def multimodal_clustering(spark, sf):
    return _clusters_of(PC.cluster("multi", _clinical(spark, sf), KEYS, SGRID, ["t1", "t2"], k=3, algo="kmeans"))


@query(
    "l18_guided_clustering",
    "patient:i n:i sums:i labels:i healthy:i",
    fx.with_views("SELECT patient, COUNT(*) AS n, COUNT(*) AS sums, COUNT(*) AS labels, COUNT(*) AS healthy FROM series GROUP BY 1", "series"),
)
def guided_clustering(spark, sf):
    """Each voxel's probabilities sum to one, its label is their largest, and p_healthy adds the first two."""
    out = PC.cluster("guided_iter", _clinical(spark, sf), KEYS, SGRID, maps=["t1", "t2"])
    total = F.aggregate("probs", F.lit(0.0), lambda s, v: s + v)
    top = F.get("probs", F.col("class_label") - 1) == F.array_max("probs")
    both = F.abs(F.col("p_healthy") - F.get("probs", F.lit(0)) - F.get("probs", F.lit(1))) < 1e-12
    return out.groupBy("patient").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-6).alias("sums"), F.count_if(top).alias("labels"), F.count_if(both).alias("healthy")
    )


@query(
    "x3_detector_dispatch",
    "patient:i maps:i in_range:i rank_breaks:i",
    fx.with_views("SELECT patient, 3*COUNT(*) AS maps, 3*COUNT(*) AS in_range, 0 AS rank_breaks FROM vm WHERE brain AND patient IN (SELECT patient FROM pool GROUP BY 1 HAVING COUNT(DISTINCT target)=2) GROUP BY 1", "vm", extra=_POOL),
)
def full_experiment(spark, sf):
    """The supervised analysis by the detector's name: own folds and models per patient, ensemble maps, ranked hotspots."""
    masks = cut_lineage(masks_table(spark, sf))
    voxels = masks.where("brain").select("patient", *"xyz", "flat_idx", "p_nec", "p_enh", "p_mix", F.col("n").cast("double").alias("n"))
    run = PX.detector("Probability ")
    ensemble, ranked = run(voxels, ["p_nec", "p_enh", "p_mix", "n"], pools_of(masks), masks, KEYS, GRID, SPACING, block_mm=8.0, buffer_mm=2.0, min_voxels=MIN_VOXELS, min_dist_mm=MIN_DIST)
    order = W.partitionBy("patient", "pct").orderBy("rank")
    falls = F.coalesce(F.col("score") > F.lag("score").over(order), F.lit(False)) | (F.col("rank") != F.row_number().over(order))
    breaks = ranked.withColumn("_x", falls).groupBy("patient").agg(F.count_if("_x").alias("rank_breaks"))
    maps = ensemble.groupBy("patient").agg(F.count(F.lit(1)).alias("maps"), F.count_if(F.col("p_mean").between(0, 1)).alias("in_range"))
    return maps.join(breaks, "patient", "left").fillna(0, ["rank_breaks"])
