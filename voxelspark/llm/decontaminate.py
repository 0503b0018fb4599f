"""Benchmark decontamination in DataFrame functions: a hash set of test n-grams probed with every text window.

Item windows (``width`` words, or the whole item when shorter) form the build side of a hash join; the
probe compares the whole n-gram, so a hash hit is verified by the join itself. The build side is
broadcast only after its rows were counted; a larger one is joined by shuffling.

Defined cases: null and empty texts have no words and no hits; empty items have no window; a null
item_id joins but is left out of the id list; repeated rows get one result each; an empty benchmark leaves
every text clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, broadcast_if_small, fresh, let, stored, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def windows(words: Column, width: Column | int) -> Column:
    """Array of the space-joined windows of ``width`` words (empty for shorter texts)."""
    width = F.lit(width) if isinstance(width, int) else width
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return let(words, lambda w: F.when(F.size(w) >= width, grams(w)).otherwise(F.array().cast("array<string>")))


def item_windows(items: DataFrame, id_col: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """gram, size and the ids of the items that hold it."""
    w = items.select(F.col(id_col).cast("string").alias("_item"), words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    w = w.withColumn("size", F.least(F.size("_w"), F.lit(width)))
    grams = w.select("_item", "size", F.explode(windows(F.col("_w"), F.col("size"))).alias("gram")).distinct()
    return grams.groupBy("gram", "size").agg(F.collect_set("_item").alias("items"))


def hits(docs: DataFrame, grams: DataFrame, text: str = "text") -> DataFrame:
    """Per distinct hit text: its key, the positions of its hit words and the ids of the items.

    ``grams`` is the stored table of ``item_windows``; its sizes are 1 to the window width.
    """
    sizes = [r[0] for r in grams.select("size").distinct().collect()]
    if not sizes:
        sizes = [1]
    build = broadcast_if_small(grams)
    tagged = lambda w, k: F.transform(windows(w, k), lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
    per_row = let(words_of(F.col(text)), lambda w: F.concat(*[tagged(w, k) for k in sizes]))
    found = docs.select(*text_key(F.col(text)), F.explode(per_row).alias("_g")).select("_t1", "_t2", "_g.*").join(build, "gram")
    spans = found.groupBy("_t1", "_t2").agg(F.collect_set(F.struct("at", "size")).alias("_s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return spans.select("_t1", "_t2", F.array_distinct(F.flatten(F.transform("_s", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))).alias("covered"), "items")


def score(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """One row per input row: words, hit words, item ids with occurring windows."""
    grams = stored(item_windows(items, item_id, text, width), "grams")
    found = hits(docs, grams, text)
    base = docs.select(F.col(id_col), *text_key(F.col(text)), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    rows = base.join(found, ["_t1", "_t2"], "left")
    n_hit = F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    ids = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    return rows.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = 10, mode: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="spans"``) with the hit words cut out of the text."""
    grams = stored(item_windows(items, item_id, text, width), "grams")
    cov, k1, k2 = (fresh(docs, c) for c in ("_covered", "_k1", "_k2"))
    found = stored(hits(docs, grams, text), "hits").select(F.col("_t1").alias(k1), F.col("_t2").alias(k2), F.col("covered").alias(cov))
    found = broadcast_if_small(found)
    same = (F.xxhash64(docs[text]) == found[k1]) & (F.hash(docs[text]) == found[k2])
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    pieces = F.regexp_extract_all(docs[text], F.lit(f"({OTHER}(?:[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|$))"), F.lit(1))
    left = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), found[cov]), lambda i: F.get(p, i)), "")
    clean = F.when(found[cov].isNull(), docs[text]).otherwise(let(pieces, left))
    return docs.join(found, same, "left").select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])
