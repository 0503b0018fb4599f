"""Association-rule URL filter: FP-growth mines token sets that go with a bad label; rules match by an inverted index.

Given host/path rules decide first (the longest that fits); every other URL is judged by the mined rules.
Each labelled page is one transaction of URL tokens plus an item for a bad label. Rules kept: token sets
whose share of bad pages (confidence) and number of pages (support) are high enough and whose odds beat those of all
labelled pages ``odds`` times; sets of any length count. A rule is posted under its rarest token, so common tokens such as ``com`` have few postings.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no tokens (allow unless a
rule fits); pages with repeated ids get one row each; a label row without
quality and toxic says nothing; without labelled pages, or with bad ones only, no rule is mined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, broadcast_if_small, stored

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BAD = "label:bad"


def host_path(url: Column) -> tuple[Column, Column]:
    """The A-Z-lower-cased host after the first ``://``, and the path before ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and their dashed parts, path words with digits folded, query names."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    words = F.transform(F.split(F.regexp_replace(ascii_lower(path), r"[0-9]+", "0"), r"[/._-]+"), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(labels, parts, words, names), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, support: float = 0.005, least: int = 10, confidence: float = 0.6, odds: float = 1.5) -> DataFrame:
    """rule (array of tokens), pages, confidence. ``labelled`` has tokens and bad (boolean)."""
    n, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    schema = "rule array<string>, pages long, confidence double"
    if bad in (0, n):
        return labelled.sparkSession.createDataFrame([], schema)
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    sets = stored(FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, (least - 0.5) / n))).fit(baskets).freqItemsets, "itemsets")
    plain = sets.where(~F.array_contains("items", BAD)).select(F.sort_array("items").alias("rule"), F.col("freq").alias("pages"))
    with_bad = sets.where(F.array_contains("items", BAD)).select(F.sort_array(F.array_remove("items", BAD)).alias("rule"), F.col("freq").alias("_bad"))
    sure = F.col("_bad") / F.col("pages")
    least_sure = max(confidence, odds * bad / (n - bad + odds * bad))  # below 1 whatever the base rate
    kept = plain.join(with_bad, "rule").withColumn("confidence", sure).where(F.col("confidence") >= least_sure)
    return kept.select("rule", "pages", "confidence")


def inverted_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """token, rule: every rule under the rarest of its tokens among ``urls`` (with a tokens column)."""
    heads = rules.select("rule", F.explode("rule").alias("token"))
    counts = urls.select(F.explode("tokens").alias("token")).join(broadcast_if_small(heads.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    return heads.join(counts, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", label_id: str = "doc_id", rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """One row per page: host, path, the given rule, the verdict, and the mined rule that blocked it."""
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(id_col), "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("_given", given_rule(F.col("host"), F.col("path"), rules))
    urls = urls.withColumns({"_u1": F.xxhash64("url"), "_u2": F.hash("url")})
    bad = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(F.coalesce(F.greatest(1 - F.col("quality"), F.col("toxic")), 1 - F.col("quality"), F.col("toxic"))).alias("_bad"))
    labelled = urls.select(F.col(id_col).alias("_id"), "tokens").join(bad.where("_bad IS NOT NULL"), "_id").select("tokens", (F.col("_bad") > 0).alias("bad"))
    mined = stored(mine(stored(labelled, "labelled"), **mining), "rules")
    posted = broadcast_if_small(stored(inverted_index(mined, urls), "postings"))
    seen = urls.select("_u1", "_u2", F.col("tokens").alias("_tokens"), F.explode("tokens").alias("token")).join(posted, "token").where(F.size(F.array_except("rule", "_tokens")) == 0)
    blocked = seen.groupBy("_u1", "_u2").agg(F.min(F.array_join("rule", " ")).alias("mined_rule"))
    rows = urls.drop("tokens", "url").join(blocked, ["_u1", "_u2"], "left")
    verdict = F.coalesce(F.col("_given.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", F.col("_given.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
