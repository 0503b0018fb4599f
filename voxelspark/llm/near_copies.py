"""Near copies by word-set similarity: ball hashing of several short fingerprints proposes pairs, exact Jaccard decides.

A text is the set of its ``SHINGLE``-word windows. It has ``TABLES`` fingerprints of ``BITS`` bits; a bit is one bit of
the least of all window hashes under its own permutation, so it differs with probability (1 - J) / 2, a tenth at Jaccard
0.8. Fingerprints within ``RADIUS`` bits meet as in ``simhash``: each emits all variants within half the radius, sent by
their first bits. At Jaccard 0.8 one table finds 0.46 of the pairs and all seven 0.987; at 0.85 all but 1 in 5,000.
A random pair meets with a chance of 1e-9, and the number of rows a set sends follows the logarithm of the number of
sets only.

Sets are first compared with two others a table at most, the least and the largest of those that come first at the
variants it meets others at, in rounds: each set with its first candidate outside its group, then four, then the rest;
sets linked meanwhile need none. That joins nearly all groups at a cost in proportion to the sets. Then all other pairs
that meet are compared: sets that meet, directly or through others, are a crowd, and in a crowd of several groups
every two sets of different groups within ``RADIUS`` bits in a table are compared, block against block, so no task holds
more than two blocks and no pair becomes a row. So a crowd of near copies costs little more than its size, and only a crowd of texts that
are not copies, just below the limit, costs the square of it. Only pairs with a Jaccard similarity of ``JACCARD`` or more, counted on
their windows, are linked; a group is a connected part of the links.

Defined cases: texts below ``SHINGLE`` words are one window; null, empty and blank texts are one group; equal sets
are one group without comparison; ids of any type pass untouched, also null; repeated rows leave one; extra columns
stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from voxelspark.operators.spatial import merge_graph

from .common import broadcast_if_small, map_texts, parts_of, stored
from .simhash import flips, forest, keep_first, meetings

BITS = 48
TABLES = 7
RADIUS = 4
SHINGLE = 5
JACCARD = 0.8
SEED = 42
SLICE_SETS = 250_000  # sets that a slice of the variants gets, about
SLICE_VARIANTS = 200_000  # variants made at a time, about
BLOCK_SETS = 512  # of a crowd, of about BLOCK_BYTES of windows at most
BLOCK_BYTES = 8_000_000
PRINTS = [f"f{i}" for i in range(TABLES)]
TURNS = np.random.default_rng(SEED).integers(0, 2**63, TABLES * BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word windows; words as in op10."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k, digest = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """One bit of the least hash under each permutation, as ``TABLES`` numbers of ``BITS`` bits."""
    least = np.full(len(TURNS), np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[a : a + 1024, None] * TURNS).min(0), out=least)
    bits = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).reshape(TABLES, BITS)
    return (bits << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def prefix_bits(n: int) -> int:
    """So many that a slice gets about ``SLICE_SETS`` of ``n`` sets."""
    t = 3
    while n * len(flips(t, RADIUS // 2)) / 2**t > SLICE_SETS and t < 24:
        t += 1
    return t


def variants(fps: np.ndarray, prefix: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants whose first ``t`` bits are ``prefix``, and the index of the fingerprint of each."""
    low, half = BITS - t, RADIUS // 2
    used = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix))
    base = (fps & np.uint64((1 << low) - 1)) | np.uint64(prefix << low)
    values, owners = [], []
    for k in range(half + 1):
        at = np.flatnonzero(used == k)
        masks = np.array(flips(low, half - k), np.uint64)
        values.append((base[at][:, None] ^ masks).ravel())
        owners.append(np.repeat(at, len(masks)))
    return np.concatenate(values), np.concatenate(owners)


def slice_heads(fps: np.ndarray, nodes: np.ndarray, prefix: int, t: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(node, least, largest): of the first nodes of all variants at which a node meets others in the slice, the least and the largest;
    and (node, least node of its part), a spanning forest of all meetings in the slice."""
    order = np.lexsort((nodes, fps))
    fps, nodes = fps[order], nodes[order]
    distinct, first, group = np.unique(fps, return_index=True, return_inverse=True)
    same = np.flatnonzero(np.arange(len(fps)) != first[group])  # sets with the fingerprint of another one meet that one
    twin = nodes[first[group[same]]]
    rank = np.argsort(nodes[first], kind="stable")  # one order of nodes in all slices and tables
    distinct, heads = distinct[rank], nodes[first][rank]
    found, todo = [np.zeros(0, np.int64)], [(prefix, t)]
    while todo:
        p, bits = todo.pop()
        used = np.bitwise_count((distinct >> np.uint64(BITS - bits)) ^ np.uint64(p))
        count = sum(int((used == k).sum()) * len(flips(BITS - bits, RADIUS // 2 - k)) for k in range(RADIUS // 2 + 1))
        if count > 4 * SLICE_VARIANTS and bits < 40:
            todo += [(p * 8 + i, bits + 3) for i in range(8)]
            continue
        own = np.flatnonzero(used <= RADIUS // 2)
        x, y = meetings(*variants(distinct[own], p, bits))
        x, y = own[x], own[y]
        near = np.bitwise_count(distinct[x] ^ distinct[y]) <= RADIUS
        found.append(np.unique(y[near] * len(distinct) + x[near]))
    pair = np.unique(np.concatenate(found))
    y, x = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    starts = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1]))) if len(y) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(y)) - 1 if len(y) else starts
    label = forest(len(heads), x, y)
    child = np.flatnonzero(label != np.arange(len(heads)))
    first_two = np.concatenate([nodes[same], heads[y[starts]]]), np.concatenate([twin, heads[x[starts]]]), np.concatenate([twin, heads[x[ends]]])
    return first_two, (np.concatenate([nodes[same], heads[child]]), np.concatenate([twin, heads[label[child]]]))


def met_sets(sets: DataFrame) -> DataFrame:
    """k, v, low, high: two partners of v in table k; rows with k = -1 are a forest of all meetings, from v to low.

    ``sets`` has node and the fingerprints of every distinct set.
    """
    t = prefix_bits(sets.count())
    masks = np.array(flips(t, RADIUS // 2), np.int64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.iloc[at : at + 5000]
                for k, name in enumerate(PRINTS):
                    fp = part[name].to_numpy()
                    slices = ((fp >> (BITS - t))[:, None] ^ masks) | (k << t)
                    yield pd.DataFrame({"slice": slices.ravel().astype(np.int32), "fp": np.repeat(fp, len(masks)), "node": np.repeat(part["node"].to_numpy(), len(masks))})

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["slice"].iloc[0])
        (v, low, high), (child, root) = slice_heads(rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy(), at & (1 << t) - 1, t)
        heads = pd.DataFrame({"k": np.full(len(v), at >> t, np.int32), "v": v, "low": low, "high": high})
        return pd.concat([heads, pd.DataFrame({"k": np.full(len(child), -1, np.int32), "v": child, "low": root, "high": root})])

    return sets.select("node", *PRINTS).mapInPandas(send, "slice int, fp long, node long").groupBy("slice").applyInPandas(meet, "k int, v long, low long, high long")


def candidates(met: DataFrame) -> DataFrame:
    """u, v: distinct pairs of nodes that meet, those compared first.

    In every table a set is paired with the least and the largest of the sets that come first where it meets others: all
    its partners where these are few, and at most two a table in a crowd, whose other pairs are left to ``rest_links``.
    """
    heads = met.where("k >= 0").groupBy("k", "v").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return heads.select(F.explode(F.array("low", "high")).alias("u"), "v").distinct()


def links_between(group: np.ndarray, fps: np.ndarray, windows: list[np.ndarray], left: np.ndarray, right: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Links that join the groups of the sets ``left`` and ``right``: of all pairs of different groups within ``RADIUS`` bits
    in a table, one per group and set that has a partner of the similarity."""
    group, found = group.copy(), []
    size = np.array([len(w) for w in windows])
    flat = np.concatenate([windows[i] for i in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for x in left:
        near = (np.bitwise_count(fps[right] ^ fps[x]) <= RADIUS).any(1) & (group[right] != group[x])
        if not near.any():
            continue
        start, end = np.searchsorted(flat, windows[x], "left"), np.searchsorted(flat, windows[x], "right")
        n = end - start
        both = np.bincount(owner[np.repeat(end - n.cumsum(), n) + np.arange(n.sum())], minlength=len(right))
        good = right[near & (both >= jaccard * (size[x] + size[right] - both))]
        for y in good:
            if group[y] != group[x]:
                found.append((int(x), int(y)))
                group[group == group[y]] = group[x]
    return found


def rest_links(met: DataFrame, merged: DataFrame | None, sets: DataFrame, windows: DataFrame, jaccard: float) -> DataFrame:
    """u, v: links between different groups of ``merged`` from all pairs that meet.

    A crowd of two was compared already, and one of a single group needs nothing. Others are dealt into blocks; a task compares two of them.
    """
    crowds = merge_graph(met.where("k = -1").select(F.col("low").alias("u"), "v"), [])
    if crowds is None:
        return met.select(F.col("low").alias("u"), "v").limit(0)
    named = crowds.withColumnRenamed("label", "crowd")
    named = named.withColumn("group", F.col("node")) if merged is None else named.join(merged, "node", "left").select("node", "crowd", F.coalesce("label", "node").alias("group"))
    named = stored(named.join(windows.select("node", F.length("windows").alias("bytes")), "node"), "crowds")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    open_ = named.groupBy("crowd").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n"), F.min("group").alias("a"), F.max("group").alias("b")).where("n > 2 AND a <> b")
    rows = named.join(open_.select("crowd", "blocks"), "crowd").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.join(sets.select("node", *PRINTS), "node").join(windows, "node").select("node", "crowd", "group", "block", *PRINTS, "windows", other)
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        block, node = table["block"].to_numpy(), table["node"].to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        fps = np.stack([table[c].to_numpy() for c in PRINTS], 1).view(np.uint64)
        held = [np.frombuffer(w, np.uint64) for w in table["windows"].to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = links_between(table["group"].to_numpy(), fps, held, left, right, jaccard) if len(left) and len(right) else []
        return pa.table({"u": pa.array([node[min(p)] for p in found], pa.int64()), "v": pa.array([node[max(p)] for p in found], pa.int64())})

    return rows.groupBy("crowd", "i", "j").applyInArrow(compare, "u long, v long")


def once_per_task(texts: DataFrame) -> DataFrame:
    """``texts`` (node, text) without the copies that a task has passed on already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in parts_of(whole)):
            new = []
            for i, node in enumerate(batch["node"].to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    return texts.mapInArrow(run, "node long, text string")


def window_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and the sorted window hashes of its text, as bytes."""

    def make(batch: list[str]) -> tuple[None, list]:
        return None, [[shingles(t, width).tobytes() for t in batch]]

    return map_texts(texts, F.col("node"), F.col("text"), make, "windows binary").withColumnRenamed("key", "node")


def verified(pairs: DataFrame, windows: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (u, v) whose windows have at least the given Jaccard similarity."""

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["_u"], batch["_v"]):  # views of the batch, no copies
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) if s.as_buffer() else np.zeros(0, np.uint64) for s in (x, y))
                least, most = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if least >= jaccard * most else 0
                keep.append(both >= jaccard * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: windows.select(F.col("node").alias(c), F.col("windows").alias(f"_{c}"))
    joined = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "_u", "_v")
    return joined.mapInArrow(near, "u long, v long")


def linked(pairs: DataFrame, windows: DataFrame, jaccard: float) -> tuple[DataFrame | None, DataFrame | None]:
    """The links, and node and label (the least node of its group) of all sets with a link; None without links.

    Round by round some open pairs of each set are compared; a pair is open while its sets are in different groups and
    it wasn't compared. The rounds end when no pair is open, so each pair is either compared or within a group.
    """
    links, merged, most, open_ = None, None, 1, pairs
    while not open_.isEmpty():
        turn = open_.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("u")))
        turn = stored(turn, "turn")
        found = stored(verified(turn.where(F.col("_r") <= most).select("u", "v"), windows, jaccard), "links")
        links = found if links is None else links.unionByName(found)
        merged = merged if found.isEmpty() else merge_graph(links, [])
        rest = turn.where(F.col("_r") > most).select("u", "v")
        if merged is not None:
            name = lambda c: merged.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
            rest = rest.join(name("u"), "u", "left").join(name("v"), "v", "left")
            rest = rest.where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v")
        open_, most = stored(rest, "open"), 4 * most
    return links, merged


def marked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """_id, _h (a hash of the text), node (a hash of the set) and the fingerprints of every row."""

    def make(batch: list[str]) -> tuple[None, list]:
        nodes, fps = [], np.empty((len(batch), TABLES), np.uint64)
        for i, t in enumerate(batch):
            h = shingles(t, width)
            nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
            fps[i] = fingerprints(h)
        return None, [np.array(nodes, np.uint64).view(np.int64), *fps.view(np.int64).T.copy()]

    return map_texts(docs, F.col(id_col), F.col(text), make, ", ".join(["node long", *[f"{c} long" for c in PRINTS]]), [F.xxhash64(text).alias("_h")]).withColumnRenamed("key", "_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """root, _id and _h of every row."""
    marks = stored(marked(docs, id_col, text, width), "marks")
    sets = stored(marks.groupBy("node").agg(F.min_by(F.struct("_h", *PRINTS), "_h").alias("_s")).select("node", "_s.*"), "sets")
    met = stored(met_sets(sets), "met")
    pairs = stored(candidates(met), "pairs")
    used = met.where("k = -1").select(F.explode(F.array("low", "v")).alias("node")).distinct()
    wanted = stored(sets.join(used, "node", "left_semi").select("node", "_h"), "wanted")
    held = docs.select(F.xxhash64(text).alias("_h"), F.col(text).cast("string").alias("text")).join(broadcast_if_small(wanted), "_h")
    texts = once_per_task(held.select("node", "text")).groupBy("node").agg(F.any_value("text").alias("text"))
    windows = stored(window_sets(texts, width), "windows")
    links, merged = linked(pairs, windows, jaccard)
    more = stored(rest_links(met, merged, sets, windows, jaccard), "more")
    if not more.isEmpty():
        merged = merge_graph(more if links is None else links.unionByName(more), [])
    rows = marks.select("node", "_id", "_h")
    if merged is None:
        return rows.select(F.col("node").alias("root"), "_id", "_h")
    return rows.join(merged, "node", "left").select(F.coalesce("label", "node").alias("root"), "_id", "_h")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """One row of each group of near copies: smallest id (null last), then smallest text hash; of equal rows any one."""
    return keep_first(docs, groups(docs, id_col, text, width, jaccard), id_col, text)
