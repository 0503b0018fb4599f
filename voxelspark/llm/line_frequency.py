"""Cross-document line frequency as a quality rule, in DataFrame functions only.

Every text gives word, symbol and repetition counts from array functions of its own row. For the
cross-document part the distinct lines of a text are hashed, the distinct texts per host that hold
a line are counted, lines above the limit count as removed, and a text that loses too much is rejected.

Defined cases: a null or empty text has no words and fails; a null host counts as the host ''; copies
of a text are one document in the line counts, so copies alone don't make a line frequent; repeated
rows get the same verdict each; columns other than the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, let, stored, text_key

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
LIMIT = 10  # distinct texts of a host that may hold a line
SHARE = 0.1  # of a host's distinct texts, where that is fewer
FEWEST = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words which the array holds at least twice.

    Windows are hashed, sorted with their positions, and neighbours compared: n log n in the length.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda s, v: s + v)

    def twice(order: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(order, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(let(order, twice), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return F.when(F.size(w) >= width, let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, width))), count)).otherwise(F.lit(0))

    return let(words, windows)


def base_counts(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, as long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    both = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    return [
        both.alias("_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """host, text key, line hash and words of every distinct normalised line of every distinct text."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))
    rows = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), *text_key(F.col(text)), F.explode(F.array_distinct(hashed)).alias("_l"))
    return rows.select("host", "_t1", "_t2", "_l.*").distinct()


def frequent_lines(lines: DataFrame, limit: int, share: float = SHARE) -> DataFrame:
    """host, line: held by more than ``limit`` distinct texts of the host, or on a small host by more than ``share`` of
    them (and more than ``FEWEST``). The limit is never above ``limit``, whatever the size of a host."""
    totals = lines.select("host", "_t1", "_t2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > FEWEST)
    return counts.join(totals, "host").where(F.col("_docs") > F.least(F.lit(limit), F.greatest(F.lit(FEWEST), F.col("_all") * share))).select("host", "line")


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, share: float = SHARE, keep_share: float = 0.3, keep_words: int = 10) -> DataFrame:
    """One row per input row: counts, ``base_failed``, words in frequent lines and the verdict ``kept``.

    A text is kept if it passes the base rules and, without its frequent lines, still has ``keep_words``
    words and ``keep_share`` of the words of its distinct lines.
    """
    lines = stored(line_table(docs, text, host), "lines")
    common = frequent_lines(lines, limit, share).withColumn("_hit", F.lit(True))
    lost = lines.join(common, ["host", "line"], "left").groupBy("host", "_t1", "_t2").agg(
        F.sum("words").alias("_line_words"), F.sum(F.when(F.col("_hit"), F.col("words")).otherwise(0)).alias("_lost")
    ).where("_lost > 0")
    base = docs.select(F.col(id_col), F.coalesce(F.col(host), F.lit("")).alias("host"), *text_key(F.col(text)), *base_counts(F.col(text)))
    rows = base.join(lost, ["host", "_t1", "_t2"], "left")
    n, rep = F.col("_words.n").cast("long"), F.col("_words.r").cast("long")
    gone = F.coalesce("_lost", F.lit(0))
    left = F.coalesce(F.col("_line_words"), F.lit(0)) - gone
    failed = (n < 10) | (100 * rep > 20 * n)
    depleted = (gone > 0) & ((left < keep_words) | (left < keep_share * F.col("_line_words")))
    return rows.select(
        id_col, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & ~F.coalesce(depleted, F.lit(False))).alias("kept"), gone.cast("long").alias("n_frequent_words"),
    )


def strip(docs: DataFrame, text: str = "text", host: str = "source", limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """``docs`` with the frequent lines cut out of ``text``; other columns stay."""
    lines = stored(line_table(docs, text, host), "lines")
    h, k1, k2, cut = (fresh(docs, c) for c in ("_host", "_k1", "_k2", "_cut"))
    common = lines.join(frequent_lines(lines, limit, share), ["host", "line"]).groupBy("host", "_t1", "_t2").agg(F.collect_set("line").alias("_lines"))
    common = stored(common, "cut").toDF(h, k1, k2, cut)
    same = (F.coalesce(docs[host], F.lit("")) == common[h]) & (F.xxhash64(docs[text]) == common[k1]) & (F.hash(docs[text]) == common[k2])
    norm = lambda x: F.xxhash64(F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09\x0B-\x0D]+", " ")))
    left = F.array_join(F.filter(F.split(docs[text], "\n"), lambda x: ~F.array_contains(common[cut], norm(x))), "\n")
    clean = F.when(common[cut].isNull(), docs[text]).otherwise(left)
    return docs.join(common, same, "left").select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])
