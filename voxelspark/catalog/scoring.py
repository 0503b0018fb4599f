"""Registered queries: ranks, scores, paired statistics, agreement, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import tails
from ..operators import evaluation as E, ranking as R
from ..session import cut_lineage
from .morphology import recursive
from .registry import query

SCORES = {"rf": "s_rf", "svm": "s_svm", "lr": "s_lr"}
_LONG = (
    "SELECT id, fold, y, 'rf' AS clf, s_rf AS score FROM scored UNION ALL SELECT id, fold, y, 'svm', s_svm FROM scored "
    "UNION ALL SELECT id, fold, y, 'lr', s_lr FROM scored"
)
_L = {"long": _LONG}


def _long(spark, sf):
    return E.unpivot(fx.scored(spark, sf), ["id", "fold", "y"], SCORES)


def _scored(body: str, **extra: str) -> str:
    return fx.with_views(body, "scored", extra={**_L, **extra})


@query(
    "w1_mid_rank",
    "id:i clf mid_rank:d6",
    _scored(
        "SELECT id, clf, rank() OVER (PARTITION BY clf ORDER BY score) + (COUNT(*) OVER (PARTITION BY clf, score) - 1) / 2.0 AS mid_rank FROM long"
    ),
)
def mid_rank(spark, sf):
    """Average rank of every sample per classifier."""
    long = _long(spark, sf)
    return long.join(R.mid_ranks(long, ["clf"], "score"), ["clf", "score"])


_P = "SELECT fold, id, (id*7919 % 9973 + 1)/CAST(9974 AS DOUBLE) AS p FROM scored"
_BH = (
    "SELECT fold, id, p, n, LEAST(1.0, MIN(p*n/rn) OVER (PARTITION BY fold ORDER BY p DESC, rn DESC ROWS UNBOUNDED PRECEDING)) AS p_row, "
    "LEAST(1.0, p*n) AS p_bonferroni FROM (SELECT *, COUNT(*) OVER (PARTITION BY fold) AS n, "
    "ROW_NUMBER() OVER (PARTITION BY fold ORDER BY p, id) AS rn FROM pv)"
)


def _pvalues(spark, sf):
    return fx.scored(spark, sf).select("fold", "id", F.expr("(id*7919 % 9973 + 1)/CAST(9974 AS DOUBLE)").alias("p"))


@query(
    "w2_bh_step_up",
    "fold:i id:i p_bh:d6",
    fx.with_views(f"SELECT fold, id, MIN(p_row) OVER (PARTITION BY fold, p) AS p_bh FROM ({_BH})", "scored", extra={"pv": _P}),
)
def bh(spark, sf):
    """Step-up adjusted p values per fold."""
    return E.adjust_p(_pvalues(spark, sf), ["fold"], "p")


@query(
    "w3_bh_reject",
    "fold:i n_tests:i n_reject:i",
    fx.with_views(
        f"SELECT fold, MAX(n) AS n_tests, COUNT(CASE WHEN p_bh <= 0.3 THEN 1 END) AS n_reject FROM (SELECT fold, n, "
        f"MIN(p_row) OVER (PARTITION BY fold, p) AS p_bh FROM ({_BH})) GROUP BY 1",
        "scored",
        extra={"pv": "SELECT fold, id, p*p*(CASE WHEN fold<2 THEN 0.0001 ELSE 1.0 END) AS p FROM (" + _P + ")"},
    ),
)
def bh_reject(spark, sf):
    """Number of rejected tests per fold."""
    p = _pvalues(spark, sf).withColumn("p", F.expr("p*p*(CASE WHEN fold<2 THEN 0.0001D ELSE 1.0D END)"))
    adjusted = E.adjust_p(p, ["fold"], "p", alpha=0.3)
    return adjusted.groupBy("fold").agg(F.max("n_tests").alias("n_tests"), F.count_if("reject").alias("n_reject"))


@query(
    "w4_bonferroni",
    "fold:i id:i p_bonferroni:d6",
    fx.with_views("SELECT fold, id, LEAST(1.0, p*COUNT(*) OVER (PARTITION BY fold)) AS p_bonferroni FROM pv", "scored", extra={"pv": _P}),
)
def bonferroni(spark, sf):
    return E.adjust_p(_pvalues(spark, sf), ["fold"], "p")


_AUC = (
    "SELECT {k}, SUM(CASE WHEN y=1 THEN r END) AS sr, SUM(y) AS m, SUM(1-y) AS n FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) "
    "+ (COUNT(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS r FROM long) GROUP BY {k}"
)


@query(
    "e1_roc_auc",
    "clf fold:i val_auc:d6",
    _scored(f"SELECT clf, fold, (sr - m*(m+1)/2.0)/(m*n) AS val_auc FROM ({_AUC.format(k='clf, fold')})"),
)
def roc_auc(spark, sf):
    return E.ranked_metrics(E.score_table(_long(spark, sf), ["clf", "fold"]), ["clf", "fold"])


_AP = (
    "SELECT {k}, SUM(pos * cp / (cp + cn)) / MAX(tot) AS val_ap FROM (SELECT *, SUM(pos) OVER (PARTITION BY {k} ORDER BY score DESC) AS cp, "
    "SUM(neg) OVER (PARTITION BY {k} ORDER BY score DESC) AS cn, SUM(pos) OVER (PARTITION BY {k}) AS tot FROM "
    "(SELECT {k}, score, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1-y) AS DOUBLE) AS neg FROM long GROUP BY {k}, score)) GROUP BY {k}"
)


@query("e2_average_precision", "clf fold:i val_ap:d6", _scored(_AP.format(k="clf, fold")))
def average_precision(spark, sf):
    return E.ranked_metrics(E.score_table(_long(spark, sf), ["clf", "fold"]), ["clf", "fold"])


_CUT = (
    "SELECT {k}, (AVG(CASE WHEN y=1 THEN CAST(score>=0.5 AS INT) END)+AVG(CASE WHEN y=0 THEN CAST(score<0.5 AS INT) END))/2 AS val_bal_acc, "
    "AVG((score-y)*(score-y)) AS val_brier, AVG(CASE WHEN y=1 THEN score END) AS val_mean_prob_pos, AVG(CASE WHEN y=0 THEN score END) AS val_mean_prob_neg, "
    "AVG(CASE WHEN y=1 THEN CAST(score>=0.5 AS INT) END) AS sensitivity, AVG(CASE WHEN y=0 THEN CAST(score<0.5 AS INT) END) AS specificity, "
    "AVG(CAST((score>=0.5) = (y=1) AS INT)) AS accuracy FROM long GROUP BY {k}"
)


@query(
    "e3_threshold_metrics",
    "clf fold:i val_bal_acc:d6 val_brier:d6 val_mean_prob_pos:d6 val_mean_prob_neg:d6",
    _scored(_CUT.format(k="clf, fold")),
)
def threshold_metrics(spark, sf):
    return E.threshold_metrics(_long(spark, sf), ["clf", "fold"])


@query("e4_sensitivity_specificity", "clf fold:i sensitivity:d6 specificity:d6", _scored(_CUT.format(k="clf, fold")))
def sensitivity(spark, sf):
    return E.threshold_metrics(_long(spark, sf), ["clf", "fold"])


@query("e5_accuracy", "clf fold:i accuracy:d6", _scored(_CUT.format(k="clf, fold")))
def accuracy(spark, sf):
    return E.threshold_metrics(_long(spark, sf), ["clf", "fold"])


def _placement(c: str) -> str:
    mid = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {p2}{c}) - 1)/2.0"
    every = f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1)/2.0"
    own = mid.format(p="y", p2="y, ", c=c)
    return (
        f"CASE WHEN y=1 THEN (({every}) - ({own}))/SUM(1-y) OVER () ELSE 1.0 - (({every}) - ({own}))/SUM(y) OVER () END AS v_{c}"
    )


def normal_p_sql(z: str) -> str:
    """Two-sided normal p in SQL, by the same published fit."""
    t = f"(1.0::DOUBLE/(1.0+abs({z})/sqrt(2.0)/2.0))"
    poly = f"{tails.ERFC[-1]!r}::DOUBLE"
    for c in reversed(tails.ERFC[:-1]):
        poly = f"({poly}*{t}+({c!r}))"
    return f"({t}*exp({poly}-({z})*({z})/2.0))"


def student_p_sql(t: str, df: str) -> str:
    """Two-sided t p in SQL: closed coefficients of the cosine series, normal beyond the exact range."""
    th, c2 = f"atan(abs({t})/sqrt({df}))", f"({df}/({df}+({t})*({t})))"
    even = f"sin({th})*list_sum(list_transform(range(0, CAST({df} AS BIGINT)//2), lambda j: exp(lgamma(j+0.5)-lgamma(j+1))/sqrt(pi())*pow({c2}, j)))"
    odd = f"2/pi()*({th}+sin({th})*cos({th})*COALESCE(list_sum(list_transform(range(0, (CAST({df} AS BIGINT)-1)//2), lambda j: exp(lgamma(j+1)-lgamma(j+1.5))*sqrt(pi())/2*pow({c2}, j))), 0))"
    z = f"((8.0*{df}+1)/(8.0*{df}+3)*sqrt({df}*ln(1+({t})*({t})/{df})))"
    return f"CASE WHEN {df}<={tails.EXACT_T_DF} THEN GREATEST(0.0, 1-CASE WHEN CAST({df} AS BIGINT)%2=0 THEN {even} ELSE {odd} END) ELSE {normal_p_sql(z)} END"


_WAYS = (
    "SELECT 0 AS r, list_transform(range(0, 1276), lambda s: CASE WHEN s=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c UNION ALL "
    "SELECT r+1, list_transform(range(1, 1277), lambda i: c[i]+CASE WHEN i>r+1 THEN c[i-r-1] ELSE 0 END) FROM ways WHERE r<50"
)


def wilcoxon_p_sql(table: str, cols: str) -> str:
    """``table`` has w, n_used, ties and zeros; adds p_w. Needs the recursive table ``ways``."""
    var = "(n_used*(n_used+1.0)*(2.0*n_used+1)/24.0-ties/48.0)"
    rough = f"CASE WHEN {var}<=0 THEN 1.0 ELSE LEAST(1.0, {normal_p_sql(f'((w-n_used*(n_used+1.0)/4.0)/sqrt({var}))')}) END"
    return (
        f"SELECT {cols}, w, CASE WHEN n_used=0 THEN 1.0 WHEN n_used<=50 AND ties=0 AND zeros=0 THEN LEAST(1.0, 2*list_sum(c[1:CAST(floor(w) AS BIGINT)+1])/pow(2.0, n_used)) ELSE {rough} END AS p_w "
        f"FROM {table} LEFT JOIN ways ON r=LEAST(n_used, 50)"
    )


def adjusted_sql(table: str, p: str, by: str = "") -> str:
    """Bonferroni and step-up adjusted p of each row of ``table``."""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT *, LEAST(1.0, {p}*m) AS p_bonferroni, LEAST(1.0, MIN(q) OVER ({part}ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh FROM "
        f"(SELECT *, {p}*m/rk AS q FROM (SELECT *, COUNT(*) OVER ({part}) AS m, ROW_NUMBER() OVER ({part}ORDER BY {p}) AS rk FROM {table}))"
    )


def _delong_sql() -> str:
    parts = []
    for a, b in E.CLASSIFIER_PAIRS:
        va, vb = f"v_{SCORES[a]}", f"v_{SCORES[b]}"

        def cov(p, q, y):
            return f"covar_samp(CASE WHEN y={y} THEN {p} END, CASE WHEN y={y} THEN {q} END)"

        parts.append(
            f"SELECT '{a}_vs_{b}' AS pair, SUM(y) AS n_pos, SUM(1-y) AS n_neg, AVG(CASE WHEN y=1 THEN {va} END) AS auc_a, "
            f"AVG(CASE WHEN y=1 THEN {vb} END) AS auc_b, {cov(va, va, 1)}/SUM(y) + {cov(va, va, 0)}/SUM(1-y) AS var_a, "
            f"{cov(vb, vb, 1)}/SUM(y) + {cov(vb, vb, 0)}/SUM(1-y) AS var_b, {cov(va, vb, 1)}/SUM(y) + {cov(va, vb, 0)}/SUM(1-y) AS cov_ab FROM pl"
        )
    return (
        "SELECT *, (auc_a-auc_b)/sqrt(var_a+var_b-2*cov_ab) AS z, auc_a-auc_b AS auc_diff, "
        "(auc_a-auc_b)-1.959964*sqrt(var_a+var_b-2*cov_ab) AS ci95_low, (auc_a-auc_b)+1.959964*sqrt(var_a+var_b-2*cov_ab) AS ci95_high "
        "FROM (" + " UNION ALL ".join(parts) + ")"
    )


_PL = f"SELECT y, {', '.join(_placement(c) for c in SCORES.values())} FROM scored"
_DELONG_COLS = "pair n_pos:i n_neg:i auc_a:d6 auc_b:d6 auc_diff:d6 var_a:d9 var_b:d9 cov_ab:d9 z:d4 ci95_low:d6 ci95_high:d6"


@query("e6_delong", _DELONG_COLS, fx.with_views(_delong_sql(), "scored", extra={"pl": _PL}))
def delong(spark, sf):
    """Pairwise comparison of correlated AUCs."""
    return E.delong(fx.scored(spark, sf), [], SCORES, E.CLASSIFIER_PAIRS)


_PD = {"pl": _PL, "dl": _delong_sql(), "dp": f"SELECT *, {normal_p_sql('z')} AS p_two_sided FROM dl"}


@query("e6_delong_p_values", "pair z:d4 p_two_sided:d6", fx.with_views("SELECT * FROM dp", "scored", extra=_PD))
def delong_p(spark, sf):
    return E.with_normal_p(E.delong(fx.scored(spark, sf), [], SCORES, E.CLASSIFIER_PAIRS))


@query(
    "e12_pooled_delong_corrected",
    "pair z:d4 p_two_sided:d6 p_bonferroni:d6 p_bh:d6",
    fx.with_views(adjusted_sql("dp", "p_two_sided"), "scored", extra=_PD),
)
def pooled_delong(spark, sf):
    """Comparison over all folds together with corrected p values."""
    tests = E.with_normal_p(E.delong(fx.scored(spark, sf), [], SCORES, E.CLASSIFIER_PAIRS))
    return E.adjust_p(cut_lineage(tests), [], "p_two_sided")


_PAIR_KEY = "(unit % 3)"


def _pairs(spark, sf):
    return fx.pairs(spark, sf).withColumn("grp", F.expr(_PAIR_KEY))


_D = {"d": f"SELECT unit % 3 AS grp, a, b, a-b AS d FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL"}


@query(
    "e7_paired_t",
    "grp:i n:i mean_diff:d4 sd_diff:d4 t:d6 df:i",
    fx.with_views(
        "SELECT grp, COUNT(*) AS n, AVG(d) AS mean_diff, stddev_samp(d) AS sd_diff, AVG(d)/(stddev_samp(d)/sqrt(COUNT(*))) AS t, COUNT(*)-1 AS df FROM d GROUP BY 1",
        "pairs",
        extra=_D,
    ),
)
def paired_t(spark, sf):
    return E.paired_t(_pairs(spark, sf), ["grp"])


_T = "SELECT grp, COUNT(*)-1 AS df, AVG(d) AS mid, AVG(d)/(stddev_samp(d)/sqrt(COUNT(*))) AS t FROM d GROUP BY 1"


@query(
    "e7_paired_t_interval",
    "grp:i p_two_sided:d6 mid:d4 p_at_low:d6 p_at_high:d6",
    fx.with_views(f"SELECT grp, {student_p_sql('t', 'df')} AS p_two_sided, mid, 0.05 AS p_at_low, 0.05 AS p_at_high FROM tt", "pairs", extra={**_D, "tt": _T}),
)
def paired_t_interval(spark, sf):
    """p of the mean difference; the interval is judged by the p values at its ends, which must be 5 %."""
    df = E.with_t_interval(E.paired_t(_pairs(spark, sf), ["grp"]))
    end = lambda c: tails.student_p((F.col("mean_diff") - F.col(c)) / (F.col("sd_diff") / F.sqrt("n")), F.col("df"))
    return df.withColumns({"mid": (F.col("ci95_low") + F.col("ci95_high")) / 2, "p_at_low": end("ci95_low"), "p_at_high": end("ci95_high")})


@query(
    "e8_wilcoxon",
    "grp:i n:i w:d4 median_diff:d4",
    fx.with_views(
        "SELECT grp, MAX(n) AS n, LEAST(SUM(CASE WHEN d>0 THEN r ELSE 0 END), SUM(CASE WHEN d<0 THEN r ELSE 0 END)) AS w, MAX(med) AS median_diff FROM "
        "(SELECT *, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY grp, abs(d))-1)/2.0 AS r, "
        "COUNT(*) OVER (PARTITION BY grp) AS n, quantile_cont(d, 0.5) OVER (PARTITION BY grp) AS med FROM d WHERE d <> 0) GROUP BY 1",
        "pairs",
        extra=_D,
    ),
)
def wilcoxon(spark, sf):
    return E.wilcoxon(_pairs(spark, sf), ["grp"])


_W = {
    "wr": "SELECT *, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY grp, abs(d))-1)/2.0 AS r, COUNT(*) OVER (PARTITION BY grp, abs(d)) AS k FROM d WHERE d<>0",
    "wz": "SELECT grp, COUNT(CASE WHEN d=0 THEN 1 END) AS zeros FROM d GROUP BY 1",
    "ws": "SELECT grp, COUNT(*) AS n_used, LEAST(SUM(CASE WHEN d>0 THEN r ELSE 0 END), SUM(CASE WHEN d<0 THEN r ELSE 0 END)) AS w, SUM(k*k-1) AS ties, MAX(zeros) AS zeros FROM wr JOIN wz USING (grp) GROUP BY 1",
    "ways": _WAYS,
}


@query("e8_wilcoxon_p", "grp:i w:d4 p_two_sided:d6", recursive(fx.with_views(f"SELECT grp, w, p_w AS p_two_sided FROM ({wilcoxon_p_sql('ws', 'grp')})", "pairs", extra={**_D, **_W})))
def wilcoxon_p(spark, sf):
    return E.with_wilcoxon_p(E.wilcoxon(_pairs(spark, sf), ["grp"]))


_CLIFF = (
    "SELECT grp, SUM(CASE WHEN p.a>q.b THEN 1.0 WHEN p.a<q.b THEN -1.0 ELSE 0.0 END)/COUNT(*) AS delta FROM d p JOIN d q USING (grp) GROUP BY grp"
)


@query(
    "e9_cliffs_delta",
    "grp:i delta:d6 magnitude",
    fx.with_views(
        f"SELECT *, CASE WHEN abs(delta)<0.147 THEN 'negligible' WHEN abs(delta)<0.33 THEN 'small' WHEN abs(delta)<0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM ({_CLIFF})",
        "pairs",
        extra=_D,
    ),
)
def cliff(spark, sf):
    return E.cliffs_delta(_pairs(spark, sf), ["grp"])


@query(
    "j12_sign_comparison",
    "delta:d6 n_a:i n_b:i",
    fx.with_views(
        "SELECT SUM(sgn)/(MAX(na)*MAX(nb)) AS delta, MAX(na) AS n_a, MAX(nb) AS n_b FROM (SELECT CAST(nl AS DOUBLE) - CAST(ng AS DOUBLE) AS sgn, na, nb FROM "
        "(SELECT v, g, COUNT(CASE WHEN g='b' THEN 1 END) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
        "- COUNT(CASE WHEN g='b' THEN 1 END) OVER (PARTITION BY v) AS nl, COUNT(CASE WHEN g='b' THEN 1 END) OVER () "
        "- COUNT(CASE WHEN g='b' THEN 1 END) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ng, "
        "COUNT(CASE WHEN g='a' THEN 1 END) OVER () AS na, COUNT(CASE WHEN g='b' THEN 1 END) OVER () AS nb FROM "
        "(SELECT s_svm AS v, 'a' AS g FROM scored UNION ALL SELECT s_lr, 'b' FROM scored)) WHERE g='a')",
        "scored",
    ),
)
def sign_comparison(spark, sf):
    """All-pairs sign comparison of two whole score columns by running counts."""
    return E.cliffs_delta(fx.scored(spark, sf), [], "s_svm", "s_lr")


@query(
    "e10_cohen_dz",
    "grp:i n:i d_z:d6 magnitude",
    fx.with_views(
        "SELECT *, CASE WHEN abs(d_z)<0.2 THEN 'negligible' WHEN abs(d_z)<0.5 THEN 'small' WHEN abs(d_z)<0.8 THEN 'medium' ELSE 'large' END AS magnitude "
        "FROM (SELECT grp, COUNT(*) AS n, AVG(d)/stddev_samp(d) AS d_z FROM d GROUP BY 1)",
        "pairs",
        extra=_D,
    ),
)
def cohen(spark, sf):
    return E.cohen_dz(_pairs(spark, sf), ["grp"])


_METRICS = {
    **_L,
    "auc": f"SELECT clf, fold, (sr - m*(m+1)/2.0)/(m*n) AS val_auc FROM ({_AUC.format(k='clf, fold')})",
    "ap": _AP.format(k="clf, fold"),
    "cut": _CUT.format(k="clf, fold"),
    "met": "SELECT * FROM auc JOIN ap USING (clf, fold) JOIN cut USING (clf, fold)",
    "ml": " UNION ALL ".join(f"SELECT clf, fold, '{m}' AS metric, {m} AS v FROM met" for m in E.METRICS),
    "mp": " UNION ALL ".join(
        f"SELECT '{a}_vs_{b}' AS pair, p.fold, p.metric, p.v AS a, q.v AS b, p.v-q.v AS diff FROM ml p JOIN ml q USING (fold, metric) "
        f"WHERE p.clf='{a}' AND q.clf='{b}'"
        for a, b in E.CLASSIFIER_PAIRS
    ),
}


def _metric_rows(spark, sf):
    return E.validation_metrics(_long(spark, sf), ["clf", "fold"])


@query("e23_metric_differences", "pair fold:i metric a:d6 b:d6 diff:d6", fx.with_views("SELECT * FROM mp", "scored", extra=_METRICS))
def metric_differences(spark, sf):
    return E.metric_pairs(_metric_rows(spark, sf), [])


@query(
    "e11_metric_test_matrix",
    "pair metric n:i mean_diff:d6 t:d4 delta:d6 w:d4",
    fx.with_views(
        "SELECT pair, metric, COUNT(*) AS n, AVG(diff) AS mean_diff, AVG(diff)/(stddev_samp(diff)/sqrt(COUNT(*))) AS t, MAX(dl) AS delta, "
        "LEAST(SUM(CASE WHEN diff>0 THEN r ELSE 0 END), SUM(CASE WHEN diff<0 THEN r ELSE 0 END)) AS w FROM (SELECT m.*, "
        "rank() OVER (PARTITION BY pair, metric ORDER BY abs(diff)) AS r, (SELECT AVG(CASE WHEN p.a>q.b THEN 1.0 WHEN p.a<q.b THEN -1.0 ELSE 0.0 END) "
        "FROM mp p, mp q WHERE p.pair=m.pair AND q.pair=m.pair AND p.metric=m.metric AND q.metric=m.metric) AS dl FROM mp m) GROUP BY 1,2",
        "scored",
        extra=_METRICS,
    ),
)
def metric_tests(spark, sf):
    """Paired tests and effect sizes of three classifier pairs on four metrics."""
    return E.metric_tests(E.metric_pairs(_metric_rows(spark, sf), []))


def _size_sql(v: str, limits) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'undefined' " + " ".join(f"WHEN abs({v})<{x} THEN '{n}'" for x, n in limits) + " ELSE 'large' END"


_TESTS = {
    **_METRICS,
    "mr": "SELECT *, rank() OVER (PARTITION BY pair, metric ORDER BY abs(diff)) + (COUNT(*) OVER (PARTITION BY pair, metric, abs(diff))-1)/2.0 AS r, COUNT(*) OVER (PARTITION BY pair, metric, abs(diff)) AS k FROM mp WHERE diff<>0",
    "mz": "SELECT pair, metric, COUNT(CASE WHEN diff=0 THEN 1 END) AS zeros, COUNT(*)-1 AS df, AVG(diff)/(stddev_samp(diff)/sqrt(COUNT(*))) AS t, AVG(diff)/stddev_samp(diff) AS dz FROM mp GROUP BY 1,2",
    "ms": "SELECT pair, metric, COUNT(*) AS n_used, LEAST(SUM(CASE WHEN diff>0 THEN r ELSE 0 END), SUM(CASE WHEN diff<0 THEN r ELSE 0 END)) AS w, SUM(k*k-1) AS ties, MAX(zeros) AS zeros FROM mr JOIN mz USING (pair, metric) GROUP BY 1,2",
    "md": "SELECT p.pair, p.metric, AVG(CASE WHEN p.a>q.b THEN 1.0 WHEN p.a<q.b THEN -1.0 ELSE 0.0 END) AS delta FROM mp p JOIN mp q ON p.pair=q.pair AND p.metric=q.metric GROUP BY 1,2",
    "ways": _WAYS,
    "mw": wilcoxon_p_sql("ms", "pair, metric"),
    "mt": f"SELECT pair, metric, p_w AS p_wilcoxon, {student_p_sql('t', 'df')} AS p_t, {_size_sql('dz', E.COHEN_LIMITS)} AS dz_magnitude, {_size_sql('delta', E.CLIFF_LIMITS)} AS delta_magnitude "
    "FROM mz JOIN mw USING (pair, metric) JOIN md USING (pair, metric)",
}


@query(
    "e11_metric_test_p_values",
    "pair metric p_t:d6 p_wilcoxon:d6 p_bonferroni:d6 p_bh:d6 dz_magnitude delta_magnitude",
    recursive(fx.with_views(adjusted_sql("mt", "p_wilcoxon"), "scored", extra=_TESTS)),
)
def metric_test_p(spark, sf):
    return E.metric_tests(E.metric_pairs(_metric_rows(spark, sf), []))


@query(
    "a6_classifier_summary",
    "clf metric n:i mean:d6 std:d6 median:d6",
    fx.with_views(
        "SELECT clf, metric, COUNT(*) AS n, AVG(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.5) AS median FROM ml GROUP BY 1,2",
        "scored",
        extra=_METRICS,
    ),
)
def classifier_summary(spark, sf):
    long = E.unpivot(_metric_rows(spark, sf), ["clf", "fold"], {m: m for m in E.METRICS}, "metric", "value")
    return E.fold_summary(long, ["clf", "metric"], "value")


@query(
    "a5_run_aggregate",
    "clf n_folds:i auc_mean:d6 auc_std:d6 brier_mean:d6 brier_std:d6",
    fx.with_views(
        "SELECT clf, COUNT(*) AS n_folds, AVG(val_auc) AS auc_mean, stddev_pop(val_auc) AS auc_std, AVG(val_brier) AS brier_mean, stddev_pop(val_brier) AS brier_std FROM met GROUP BY 1",
        "scored",
        extra=_METRICS,
    ),
)
def run_aggregate(spark, sf):
    """Mean and population sd of the fold metrics, undefined folds left out."""
    return E.run_summary(_metric_rows(spark, sf), ["clf"], {"val_auc": "auc", "val_brier": "brier"})


_EDGES = {
    **_L,
    "edges": "SELECT clf, list_sort(list_distinct(quantile_cont(score, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM long GROUP BY 1",
    "bins": "SELECT clf, bin, AVG(score) AS mean_pred, AVG(y) AS fraction_pos, COUNT(*) AS n FROM (SELECT l.*, "
    "len(list_filter(e[2:len(e)-1], lambda v: v <= l.score)) AS bin FROM long l JOIN edges USING (clf)) GROUP BY 1,2",
}


@query("e15_calibration_bins", "clf bin:i mean_pred:d6 fraction_pos:d6 n:i", fx.with_views("SELECT * FROM bins", "scored", extra=_EDGES))
def calibration(spark, sf):
    return E.calibration_bins(_long(spark, sf), ["clf"])


@query(
    "e15_calibration_error",
    "clf ece:d6 mce:d6 n:i",
    fx.with_views(
        "SELECT clf, SUM(abs(mean_pred-fraction_pos)*n)/SUM(n) AS ece, MAX(abs(mean_pred-fraction_pos)) AS mce, SUM(n) AS n FROM bins GROUP BY 1",
        "scored",
        extra=_EDGES,
    ),
)
def calibration_error(spark, sf):
    return E.calibration_error(E.calibration_bins(_long(spark, sf), ["clf"]), ["clf"])


@query(
    "e15_calibration_uniform",
    "clf bin:i mean_pred:d6 fraction_pos:d6 n:i",
    _scored(
        "SELECT clf, bin, AVG(score) AS mean_pred, AVG(y) AS fraction_pos, COUNT(*) AS n FROM (SELECT *, "
        "len(list_filter([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9], lambda v: CAST(v AS DOUBLE) <= score)) AS bin FROM long) GROUP BY 1,2"
    ),
)
def calibration_uniform(spark, sf):
    return E.calibration_bins(_long(spark, sf), ["clf"], strategy="uniform")


_CURVE = (
    "SELECT clf, t AS threshold, COUNT(CASE WHEN score>=t AND y=1 THEN 1 END)/CAST(COUNT(*) AS DOUBLE) - "
    "COUNT(CASE WHEN score>=t AND y=0 THEN 1 END)/CAST(COUNT(*) AS DOUBLE)*(t/(1-t)) AS net_benefit, "
    "AVG(y) - (1-AVG(y))*(t/(1-t)) AS treat_all, 0.0 AS treat_none, AVG(y) AS prevalence, COUNT(*) AS n FROM long, "
    "(SELECT CAST(0.01 AS DOUBLE) + CAST(0.01 AS DOUBLE)*i AS t FROM (SELECT unnest(generate_series(0, 97)) AS i)) GROUP BY 1,2"
)


@query("e16_decision_curve", "clf threshold:d6 net_benefit:d6 treat_all:d6 treat_none:d6 prevalence:d6 n:i", _scored(_CURVE))
def decision_curve(spark, sf):
    return E.decision_curve(_long(spark, sf), ["clf"])


@query(
    "j14_threshold_counts",
    "clf fold:i threshold:d6 net_benefit:d6",
    _scored(_CURVE.replace("SELECT clf,", "SELECT clf, fold,").replace("GROUP BY 1,2", "GROUP BY 1,2,3")),
)
def threshold_counts(spark, sf):
    """Net benefit per fold: every threshold from one pass over the samples."""
    return E.decision_curve(_long(spark, sf), ["clf", "fold"])


@query(
    "a4_fold_ensemble",
    "bucket:i p_mean:d6 p_std:d6 n_folds:i",
    fx.with_views(
        "SELECT id // 4 AS bucket, AVG(s_rf) AS p_mean, stddev_pop(s_rf) AS p_std, COUNT(*) AS n_folds FROM scored GROUP BY 1", "scored"
    ),
)
def fold_ensemble(spark, sf):
    """Four folds of one voxel share a bucket; mean and sd over them."""
    folds = fx.scored(spark, sf).withColumn("bucket", F.expr("id div 4"))
    return E.ensemble(folds, ["bucket"], "s_rf")


@query(
    "l7_class_weights",
    "id:i fold:i weight:d6",
    fx.with_views(
        "SELECT id, fold, COUNT(*) OVER (PARTITION BY fold)/(2.0*COUNT(*) OVER (PARTITION BY fold, y)) AS weight FROM scored", "scored"
    ),
)
def class_weights(spark, sf):
    return E.class_weights(fx.scored(spark, sf), ["fold"])


@query(
    "a19_exact_percentiles",
    "clf fold:i n:i p05:d6 p50:d6 p95:d6",
    _scored(
        "SELECT clf, fold, COUNT(*) AS n, quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95 FROM long GROUP BY 1,2"
    ),
)
def percentiles(spark, sf):
    return R.exact_percentiles(_long(spark, sf), ["clf", "fold"], "score", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
