"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a value within half the radius of both. Every distinct
fingerprint therefore emits all such variants, variants meet by shuffling, and fingerprints that meet are
linked. To keep the shuffle small a variant is sent by its first ``t`` bits only: the sender flips bits
there, the receiver flips the rest, so each variant is made once, in the slice that owns its prefix.
Fingerprints that meet at one variant all lie within ``radius`` of each other, so each is linked to the
smallest of them, and a slice returns a spanning forest of its links instead of its pairs. Components of
the forest are merged with checkpoints.

Defined cases: null and empty texts have fingerprint zero; a null id never is a component's smallest unless
all are null; repeated rows keep one result each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxelspark.operators.spatial import merge_graph

from .common import broadcast_if_small, fresh, map_texts, stored

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
SLICE_VARIANTS = 1_000_000  # a slice is split by further bits beyond this


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingle hashes, as an unsigned 64-bit number."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    ones, n, digest = np.zeros(BITS, np.int64), len(words) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        spans = zip(starts[at : min(n, at + 65_536)].tolist(), ends[at + k - 1 :].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, _h (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def make(texts: list[str]) -> tuple[None, list]:
        return None, [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, F.col(id_col), F.col(text), make, "fp long", [F.xxhash64(text).alias("_h")]).withColumnRenamed("key", id_col)


def flips(bits: int, most: int) -> list[int]:
    """All masks over the low ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def prefix_bits(n: int, half: int) -> int:
    """So many that a slice gets about ``SLICE_VARIANTS`` variants of ``n`` fingerprints."""
    return int(np.clip(np.ceil(np.log2(max(1, n) * len(flips(BITS, half)) / SLICE_VARIANTS + 1)), 3, 24))


def variants(fps: np.ndarray, prefix: int, t: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants with the given first ``t`` bits, and the index of the fingerprint of each."""
    low = BITS - t
    used = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix))
    base = (fps & np.uint64((1 << low) - 1)) | np.uint64(prefix << low)
    values, owners = [], []
    for k in range(half + 1):
        at = np.flatnonzero(used == k)
        masks = np.array(flips(low, half - k), np.uint64)
        values.append((base[at][:, None] ^ masks).ravel())
        owners.append(np.repeat(at, len(masks)))
    return np.concatenate(values), np.concatenate(owners)


def meetings(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest owner, owner) of the owners that share a value."""
    room = np.uint64(max(1, int(len(values)).bit_length()))
    code = ((values * np.uint64(0x9E3779B97F4A7C15)) >> room << room) | np.arange(len(values), dtype=np.uint64)
    code.sort()
    same = (code[1:] >> room) == (code[:-1] >> room)
    inside = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(code) else np.zeros(0, bool)
    at = (code[inside] & np.uint64((1 << int(room)) - 1)).astype(np.int64)
    order = at[np.lexsort((owners[at], values[at]))]  # the shortened hash may join different values: compare whole ones
    v, o = values[order], owners[order]
    first = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
    keep = o[head] != o
    return o[head][keep], o[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def slice_links(fps: np.ndarray, prefix: int, t: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one slice as (fingerprint, smaller fingerprint of its component); large slices are split by more bits."""
    half, todo, a, b = radius // 2, [(prefix, t)], [], []
    sizes = [len(flips(BITS - t, half - k)) for k in range(half + 1)]
    while todo:
        p, bits = todo.pop()
        used = np.bitwise_count((fps >> np.uint64(BITS - bits)) ^ np.uint64(p))
        count = sum(int((used == k).sum()) * (sizes[k] if bits == t else len(flips(BITS - bits, half - k))) for k in range(half + 1))
        if count > 4 * SLICE_VARIANTS and bits < 40:
            todo += [(p * 8 + i, bits + 3) for i in range(8)]
            continue
        own = np.flatnonzero(used <= half)
        x, y = meetings(*variants(fps[own], p, bits, half))
        near = np.bitwise_count(fps[own][x] ^ fps[own][y]) <= radius
        a.append(own[x[near]])
        b.append(own[y[near]])
    label = forest(len(fps), np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: a spanning forest, per slice, of the distinct fingerprints (column fp) within ``radius`` bits.

    ``radius`` must be even: half of it is the ball of each fingerprint.
    """
    half = radius // 2
    t = prefix_bits(fps.count(), half)
    masks = np.array(flips(t, half), np.int64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            prefix = (fp.view(np.uint64) >> np.uint64(BITS - t)).astype(np.int64)
            yield pd.DataFrame({"slice": (prefix[:, None] ^ masks).ravel(), "fp": np.repeat(fp, len(masks))})

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = slice_links(np.sort(rows["fp"].to_numpy().view(np.uint64)), int(rows["slice"].iloc[0]), t, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return fps.mapInPandas(send, "slice long, fp long").groupBy("slice").applyInPandas(meet, "u long, v long").distinct()


def _rooted(docs: DataFrame, id_col: str, text: str, radius: int, shingle: int) -> DataFrame:
    """id, _h, fp of every row with the root fingerprint and the smallest id of its component."""
    own = stored(fingerprints(docs, id_col, text, shingle), "fingerprints")
    groups = stored(own.groupBy("fp").agg(F.min(id_col).alias("_least")), "groups")
    merged = merge_graph(links(groups.select("fp"), radius), [])
    if merged is None:
        named = groups.select("fp", F.col("fp").alias("root"), F.col("_least").alias("component_id"))
    else:
        roots = groups.join(merged.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", F.coalesce("label", "fp").alias("root"))
        roots = stored(roots, "roots")
        named = roots.join(roots.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("fp", "root", "component_id")
    return own.join(named, "fp")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id of the component)."""
    rows = _rooted(docs, id_col, text, radius, shingle)
    return rows.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``rows`` (root, _id, _h): smallest id (null last), then smallest text hash."""
    rows = stored(rows, "rooted")
    first = F.min_by(F.struct("_id", "_h"), F.struct(F.col("_id").isNull(), "_id", "_h"))
    kept = stored(rows.groupBy("root").agg(first.alias("_k")).select("_k.*"), "kept")
    both = rows["_id"].eqNullSafe(kept["_id"]) & (rows["_h"] == kept["_h"])
    gone = broadcast_if_small(stored(rows.join(kept, both, "left_anti").select("_id", "_h").distinct(), "gone"))
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text]) == gone["_h"]), "left_anti")
    repeated = rows.join(kept, both, "left_semi").count() > kept.count()
    h = fresh(docs, "_h")
    return out.withColumn(h, F.xxhash64(text)).dropDuplicates([id_col, h]).drop(h) if repeated else out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component: smallest id (null last), then smallest text hash; of equal rows any one."""
    return keep_first(docs, _rooted(docs, id_col, text, radius, shingle).select("root", F.col(id_col).alias("_id"), "_h"), id_col, text)
