"""Classifier scores, paired statistics, agreement, calibration and decision curves.

Everything that needs an order works on the table of distinct values with class counts
(``ranking.value_prefix``), so ties cost nothing and no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tails
from ..session import cut_lineage
from .columns import attach, with_stats
from .ranking import bh_adjusted, exact_percentiles, mid_ranks, value_prefix

# Compared metrics, classifier pairs and effect-size limits.
METRICS = ["val_auc", "val_ap", "val_brier", "val_bal_acc"]
CLASSIFIER_PAIRS = [("rf", "svm"), ("rf", "lr"), ("svm", "lr")]
CLIFF_LIMITS = [(0.147, "negligible"), (0.33, "small"), (0.474, "medium")]
COHEN_LIMITS = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]
Z_95 = 1.959964


def unpivot(df: DataFrame, ids: Sequence[str], values: dict[str, str], name: str = "clf", value: str = "score") -> DataFrame:
    """Long form: ``values`` maps the name to the column holding it."""
    items = F.array(*[F.struct(F.lit(n).alias(name), F.col(c).cast("double").alias(value)) for n, c in values.items()])
    return df.select(*ids, F.inline(items))


def score_table(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Distinct scores with positive and negative counts, running counts and totals."""
    return value_prefix(df, keys, score, {"pos": F.sum(F.col(y)), "neg": F.sum(1 - F.col(y))})


def ranked_metrics(table: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """AUC (ties count half) and average precision from a score table; NULL with one class."""
    n_pos, n_neg = F.col("pos_total"), F.col("neg_total")
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    tp, fp = n_pos - F.col("pos_before"), n_neg - F.col("neg_before")
    step = F.col("pos") * tp / (tp + fp)
    out = table.groupBy(*keys).agg(
        F.max(n_pos).alias("n_pos"), F.max(n_neg).alias("n_neg"), F.sum(wins).alias("_w"), F.sum(step).alias("_ap")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *keys,
        "n_pos",
        "n_neg",
        F.when(both, F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("val_auc"),
        F.when(both, F.col("_ap") / F.col("n_pos")).alias("val_ap"),
    )


def threshold_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Balanced accuracy, accuracy, sensitivity, specificity, Brier score and class mean scores."""
    pos, neg, hit = F.col(y) == 1, F.col(y) == 0, F.col(score) >= cut
    out = df.groupBy(*keys).agg(
        F.count_if(pos).alias("_p"),
        F.count_if(neg).alias("_n"),
        F.count_if(pos & hit).alias("_tp"),
        F.count_if(neg & ~hit).alias("_tn"),
        F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("_brier"),
        F.avg(F.when(pos, F.col(score))).alias("_mp"),
        F.avg(F.when(neg, F.col(score))).alias("_mn"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    sens, spec = F.col("_tp") / F.nullif("_p", F.lit(0)), F.col("_tn") / F.nullif("_n", F.lit(0))
    return out.select(
        *keys,
        F.when(both, (sens + spec) / 2).alias("val_bal_acc"),
        F.when(both, F.col("_brier")).alias("val_brier"),
        F.when(both, F.col("_mp")).alias("val_mean_prob_pos"),
        F.when(both, F.col("_mn")).alias("val_mean_prob_neg"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        ((F.col("_tp") + F.col("_tn")) / (F.col("_p") + F.col("_n"))).alias("accuracy"),
    )


def validation_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    ranked = ranked_metrics(score_table(df, keys, y, score), keys, score)
    return ranked.join(threshold_metrics(df, keys, y, score), list(keys))


# ---- DeLong --------------------------------------------------------------------------------


def delong(df: DataFrame, keys: Sequence[str], scores: dict[str, str], pairs: Sequence[tuple[str, str]], y: str = "y") -> DataFrame:
    """Comparison of correlated AUCs for each pair of score columns, one row per key and pair.

    The placement value of a sample depends only on its score, so it is computed on the
    distinct scores and joined back once per classifier; covariances are then aggregates.
    """
    keys = list(keys)
    df = samples = df.select(*keys, y, *scores.values())
    for name, col in scores.items():
        table = score_table(samples, keys, y, col)
        below = F.try_divide(F.col("neg_before") + F.col("neg") / 2, F.col("neg_total"))
        above = 1 - F.try_divide(F.col("pos_before") + F.col("pos") / 2, F.col("pos_total"))
        table = table.select(*keys, col, below.alias("_v1"), above.alias("_v0"))
        df = df.join(table, [*keys, col]).withColumn(f"_{name}", F.when(F.col(y) == 1, F.col("_v1")).otherwise(F.col("_v0")))
        df = df.drop("_v1", "_v0")
    pos, neg = F.col(y) == 1, F.col(y) == 0
    stats = [F.count_if(pos).alias("m"), F.count_if(neg).alias("n")]

    def cov(a: str, b: str, which: Column) -> Column:
        return F.covar_samp(F.when(which, F.col(f"_{a}")), F.when(which, F.col(f"_{b}")))

    for a in scores:
        stats.append(F.avg(F.when(pos, F.col(f"_{a}"))).alias(f"auc_{a}"))
    combos = {(a, a) for a in scores} | set(pairs)
    for a, b in sorted(combos):
        stats += [cov(a, b, pos).alias(f"p_{a}_{b}"), cov(a, b, neg).alias(f"n_{a}_{b}")]
    wide = df.groupBy(*keys).agg(*stats)

    def joint(a: str, b: str) -> Column:
        return F.try_divide(F.col(f"p_{a}_{b}"), F.col("m")) + F.try_divide(F.col(f"n_{a}_{b}"), F.col("n"))

    rows = F.array(
        *[
            F.struct(
                F.lit(f"{a}_vs_{b}").alias("pair"),
                F.col(f"auc_{a}").alias("auc_a"),
                F.col(f"auc_{b}").alias("auc_b"),
                joint(a, a).alias("var_a"),
                joint(b, b).alias("var_b"),
                joint(a, b).alias("cov_ab"),
            )
            for a, b in pairs
        ]
    )
    out = wide.select(*keys, F.col("m").alias("n_pos"), F.col("n").alias("n_neg"), F.inline(rows))
    out = out.withColumn("var_diff", F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"))
    out = out.withColumn("auc_diff", F.col("auc_a") - F.col("auc_b"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("var_diff") > 0)
    sd = F.sqrt("var_diff")
    out = out.withColumns(
        {
            "z": F.when(ok, F.col("auc_diff") / sd),
            "ci95_low": F.when(ok, F.col("auc_diff") - Z_95 * sd),
            "ci95_high": F.when(ok, F.col("auc_diff") + Z_95 * sd),
        }
    )
    blank = ["auc_a", "auc_b", "auc_diff", "var_a", "var_b", "cov_ab", "var_diff"]
    return out.withColumns({c: F.when(ok, F.col(c)) for c in blank})


def with_normal_p(df: DataFrame, z: str = "z", out: str = "p_two_sided") -> DataFrame:
    return df.withColumn(out, 2 * tails.normal_sf(F.abs(z)))


# ---- paired tests and effect sizes ---------------------------------------------------------


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def paired_t(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Mean difference, sample sd, t and degrees of freedom over finite pairs."""
    d = F.when(_finite(a) & _finite(b), F.col(a) - F.col(b))
    out = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    enough = F.col("n") >= 2
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_diff", "sd_diff")})
    t = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))
    return out.withColumn("df", F.greatest(F.col("n") - 1, F.lit(0))).withColumn("t", t)


def with_t_interval(df: DataFrame) -> DataFrame:
    half = tails.student_critical(F.col("df")) * F.col("sd_diff") / F.sqrt("n")
    df = df.withColumn("p_two_sided", tails.student_p(F.col("t"), F.col("df"))).withColumn("_half", half)
    ends = {"ci95_low": F.col("mean_diff") - F.col("_half"), "ci95_high": F.col("mean_diff") + F.col("_half")}
    return df.withColumns(ends).drop("_half")


def wilcoxon(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Signed-rank W over non-zero differences, counts for its p value and the median difference."""
    keys = list(keys)
    diffs = df.where(_finite(a) & _finite(b)).select(*keys, (F.col(a) - F.col(b)).alias("_d"))
    size = diffs.withColumn("_m", F.abs("_d")).where("_d <> 0")
    table = value_prefix(size, keys, "_m", {"n": F.count(F.lit(1)), "up": F.count_if(F.col("_d") > 0)})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    sums = table.groupBy(*keys).agg(
        F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum((F.col("n") - F.col("up")) * rank).alias("w_minus"),
        F.sum(F.col("n")).alias("n_used"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    counts = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_d") == 0).alias("zeros"))
    median = exact_percentiles(diffs, keys, "_d", {"median_diff": 0.5}).drop("n")
    out = counts.join(sums, keys, "left").join(median, keys, "left")
    return out.withColumn("w", F.least("w_plus", "w_minus")).withColumn("n_used", F.coalesce("n_used", F.lit(0)))


def with_wilcoxon_p(df: DataFrame) -> DataFrame:
    p = tails.wilcoxon_p(F.col("w"), F.col("n_used"), F.col("ties"), F.col("zeros"))
    return df.withColumn("p_two_sided", F.when(F.col("n") < 2, F.lit(None)).otherwise(F.coalesce(p, F.lit(1.0))))


def _magnitude(value: Column, limits: Sequence[tuple[float, str]]) -> Column:
    out = F.when(value.isNull(), "undefined")
    for limit, name in limits:
        out = out.when(F.abs(value) < limit, name)
    return out.otherwise("large")


def cliffs_delta(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(pairs a > b minus pairs a < b) / all pairs, from running counts instead of pairs."""
    long = unpivot(df, keys, {"a": a, "b": b}).where(_finite("score"))
    table = value_prefix(
        long, keys, "score", {"na": F.count_if(F.col("clf") == "a"), "nb": F.count_if(F.col("clf") == "b")}
    )
    above = F.col("nb_total") - F.col("nb_before") - F.col("nb")
    out = table.groupBy(*keys).agg(
        F.sum(F.col("na") * (F.col("nb_before") - above)).alias("_s"),
        F.max("na_total").alias("n_a"),
        F.max("nb_total").alias("n_b"),
    )
    delta = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("_s") / (F.col("n_a") * F.col("n_b")))
    out = out.withColumn("delta", delta)
    return out.withColumn("magnitude", _magnitude(F.col("delta"), CLIFF_LIMITS)).drop("_s")


def cohen_dz(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    out = paired_t(df, keys, a, b)
    dz = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff"))
    zero = (F.col("n") >= 2) & (F.col("sd_diff") == 0)
    name = F.when(zero, "zero-variance").otherwise(_magnitude(F.col("d_z"), COHEN_LIMITS))
    return out.withColumn("d_z", dz).withColumn("magnitude", name).select(*keys, "n", "d_z", "magnitude")


# ---- multiple testing ----------------------------------------------------------------------


def bonferroni(p: Column, n_tests: Column | int) -> Column:
    return F.least(F.lit(1.0), p * n_tests)


def adjust_p(df: DataFrame, keys: Sequence[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Bonferroni and step-up adjusted p per row, with the reject flag; NULL or NaN counts as 1."""
    keys = list(keys)
    df = df.withColumn("_p", F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0)))
    table = bh_adjusted(df, keys, "_p").drop("n")
    out = df.join(table, [*keys, "_p"])
    out = out.withColumn("p_bonferroni", bonferroni(F.col("_p"), F.col("n_tests")))
    return out.withColumn("reject", F.col("p_bh") <= alpha).drop("_p")


# ---- metric tables -------------------------------------------------------------------------


def metric_pairs(metrics: DataFrame, keys: Sequence[str], fold: str = "fold", names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Per fold, pair of classifiers and metric: values a and b and their difference.

    ``metrics`` has one row per key, fold and ``clf``.
    """
    long = unpivot(metrics, [*keys, fold, "clf"], {m: m for m in names}, "metric", "value")
    wide = long.groupBy(*keys, fold, "metric").agg(
        *[F.max(F.when(F.col("clf") == c, F.col("value"))).alias(c) for c in sorted({c for p in CLASSIFIER_PAIRS for c in p})]
    )
    rows = F.array(
        *[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in CLASSIFIER_PAIRS]
    )
    return wide.select(*keys, fold, "metric", F.inline(rows)).withColumn("diff", F.col("a") - F.col("b"))


def metric_tests(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The full test matrix: paired t, signed rank, effect sizes and corrected p values."""
    by = [*keys, "pair", "metric"]
    pairs = cut_lineage(pairs)
    t = with_t_interval(paired_t(pairs, by)).withColumnRenamed("p_two_sided", "p_t")
    w = with_wilcoxon_p(wilcoxon(pairs, by)).select(*by, "w", "median_diff", F.col("p_two_sided").alias("p_wilcoxon"))
    c = cliffs_delta(pairs, by).select(*by, "delta", F.col("magnitude").alias("delta_magnitude"))
    d = cohen_dz(pairs, by).select(*by, "d_z", F.col("magnitude").alias("dz_magnitude"))
    tests = t.join(w, by).join(c, by).join(d, by)
    return adjust_p(cut_lineage(tests), keys, "p_wilcoxon")


def fold_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample sd and median over the finite values of each key."""
    known = df.where(_finite(value))
    base = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return base.join(exact_percentiles(known, keys, value, {"median": 0.5}).drop("n"), list(keys))


# ---- agreement of two maps -----------------------------------------------------------------


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs by its t; a perfect one has p 0."""
    df = n - 2
    t = F.abs(r) * F.sqrt(df / (1.0 - r * r))
    return F.when(F.abs(r) >= 1.0, 0.0).otherwise(tails.student_p(t, df))


def map_agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation with their p values, mean absolute and root mean square difference."""
    keys = list(keys)
    ranked = df = cut_lineage(df.select(*keys, a, b))
    for c in (a, b):
        ranks = mid_ranks(df, keys, c, f"_r_{c}").drop("n")
        ranked = ranked.join(ranks, [*keys, c])
    d = F.col(a) - F.col(b)
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.corr(a, b).alias("pearson_r"),
        F.corr(f"_r_{a}", f"_r_{b}").alias("spearman_rho"),
        F.avg(F.abs(d)).alias("mean_abs_diff"),
        F.sqrt(F.avg(d * d)).alias("rms_diff"),
        F.stddev_pop(a).alias("_sa"),
        F.stddev_pop(b).alias("_sb"),
    )
    enough = F.col("n_voxels") >= 3
    spread = enough & (F.col("_sa") >= 1e-12) & (F.col("_sb") >= 1e-12)
    out = out.withColumns({c: F.when(spread, F.col(c)) for c in ("pearson_r", "spearman_rho")})
    out = out.withColumns({p: correlation_p(F.col(c), F.col("n_voxels")) for c, p in (("pearson_r", "pearson_p"), ("spearman_rho", "spearman_p"))})
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_abs_diff", "rms_diff")}).drop("_sa", "_sb")


def hotspot_dice(df: DataFrame, keys: Sequence[str], a: str, b: str, percentiles: Sequence[int] = (90, 95)) -> DataFrame:
    """Overlap of the voxels above each map's own percentile, one row per key and percentile."""
    keys = list(keys)
    df = cut_lineage(df.select(*keys, a, b))
    cuts = None
    for c, tag in ((a, "a"), (b, "b")):
        part = exact_percentiles(df, keys, c, {f"{tag}{p}": p / 100 for p in percentiles}).drop("n")
        cuts = part if cuts is None else cuts.join(part, keys)
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("pct"), F.col(f"a{p}").alias("threshold_a"), F.col(f"b{p}").alias("threshold_b"))
            for p in percentiles
        ]
    )
    cuts = cuts.select(*keys, rows.alias("_cuts"))
    rows_in = attach(df, cuts, keys).select(*keys, a, b, F.inline("_cuts"))
    above_a, above_b = F.col(a) >= F.col("threshold_a"), F.col(b) >= F.col("threshold_b")
    out = rows_in.groupBy(*keys, "pct").agg(
        F.max("threshold_a").alias("threshold_a"),
        F.max("threshold_b").alias("threshold_b"),
        F.count_if(above_a).alias("n_a"),
        F.count_if(above_b).alias("n_b"),
        F.count_if(above_a & above_b).alias("n_both"),
    )
    return out.withColumn("dice", 2 * F.col("n_both") / F.nullif(F.col("n_a") + F.col("n_b"), F.lit(0)))


# ---- calibration and decision curves -------------------------------------------------------


def calibration_bins(
    df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", n_bins: int = 10, strategy: str = "quantile"
) -> DataFrame:
    """Mean score, positive share and count per non-empty bin."""
    keys = list(keys)
    df = df.where(_finite(score) & F.col(y).isNotNull())
    if strategy == "quantile":
        cuts = exact_percentiles(df, keys, score, {f"q{i}": i / n_bins for i in range(n_bins + 1)})
        edges = F.array_distinct(F.array(*[f"q{i}" for i in range(n_bins + 1)]))
        cuts = cuts.select(*keys, edges.alias("_e"))
        inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
        df = attach(df, cuts, keys).withColumn("_inner", inner)
    else:
        df = df.withColumn("_inner", F.lit([i / n_bins for i in range(1, n_bins)]))
    bin_no = F.size(F.filter("_inner", lambda e: e <= F.col(score)))
    return (
        df.withColumn("bin", bin_no)
        .groupBy(*keys, "bin")
        .agg(F.avg(score).alias("mean_pred"), F.avg(y).alias("fraction_pos"), F.count(F.lit(1)).alias("n"))
    )


def calibration_error(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("mean_pred") - F.col("fraction_pos"))
    return bins.groupBy(*keys).agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n")
    )


def decision_curve(
    df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Net benefit at each threshold.

    Each sample is counted once under the number of thresholds it reaches; the cumulative
    counts of those few classes give every threshold, so samples and thresholds are never paired.
    """
    keys = list(keys)
    cuts = sorted(thresholds) if thresholds is not None else [0.01 + 0.01 * i for i in range(98)]
    reached = F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(score)))
    df = df.where(_finite(score) & F.col(y).isNotNull())
    counts = df.groupBy(*keys, reached.alias("_k")).agg(F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_c"))
    maps = counts.groupBy(*keys).agg(
        F.collect_list(F.struct("_k", "_p", "_c")).alias("_l"), F.sum("_p").alias("_pos"), F.sum("_c").alias("n")
    )
    points = F.lit([float(c) for c in cuts])
    grid = maps.select(*keys, "_l", "_pos", "n", F.posexplode(points).alias("_i", "threshold"))

    def at_or_above(field: str) -> Column:
        return F.aggregate("_l", F.lit(0).cast("long"), lambda s, e: s + F.when(e["_k"] > F.col("_i"), e[field]).otherwise(0))

    grid = grid.withColumn("tp", at_or_above("_p")).withColumn("fp", at_or_above("_c") - F.col("tp"))
    odds = F.col("threshold") / (1 - F.col("threshold"))
    prevalence = F.col("_pos") / F.col("n")
    return grid.select(
        *keys,
        "threshold",
        "n",
        prevalence.alias("prevalence"),
        F.when(F.col("threshold") >= 1, 0.0).otherwise(F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"),
        F.when(F.col("threshold") >= 1, 0.0).otherwise(prevalence - (1 - prevalence) * odds).alias("treat_all"),
        F.lit(0.0).alias("treat_none"),
    )


# ---- fold ensembles ------------------------------------------------------------------------


def ensemble(probs: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Mean and population sd of each voxel over the folds that predicted it."""
    return probs.groupBy(*keys).agg(F.avg(p).alias("p_mean"), F.stddev_pop(p).alias("p_std"), F.count(p).alias("n_folds"))


def region_statistics(df: DataFrame, keys: Sequence[str], p: str, cuts: Sequence[float]) -> DataFrame:
    """Count, mean, population sd and percentage at or above each cut."""
    shares = [(100.0 * F.avg((F.col(p) >= c).cast("double"))).alias(f"pct_ge_{int(c * 100)}") for c in cuts]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_prob"), F.stddev_pop(p).alias("std_prob"), *shares)


def class_weights(df: DataFrame, keys: Sequence[str], y: str = "y", out: str = "weight") -> DataFrame:
    """n / (2 n_c) per row."""
    df = with_stats(df, keys, [F.count_if(F.col(y) == 1).alias("_n1"), F.count(F.lit(1)).alias("_n")])
    own = F.when(F.col(y) == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1"))
    return df.withColumn(out, F.col("_n") / (2.0 * own)).drop("_n1", "_n")


def run_summary(metrics: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Folds, mean and population deviation of each metric per key, undefined folds left out; ``values`` names the outputs."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    aggregates = [f(known(c)).alias(f"{n}_{suffix}") for c, n in values.items() for f, suffix in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), *aggregates)
