"""SimHash components, suffix sorting and removal of repeated bytes: brute force and degenerate cases."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from voxelspark.llm import simhash, suffix_dedup, suffix_sort


def plain_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def least_in_component(fps, ids, radius):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = collections.defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least[r] is None else least[r] if d is None else min(d, least[r])
    return [least[root(i)] for i in range(len(fps))]


def test_components_against_brute_force(docs, empty):
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    want = list(zip(ids, [f"{f:016x}" for f in fps], least_in_component(fps, ids, 4)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, simhash.components(docs).collect()), key=key) == sorted(want, key=key)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(w[2] for w in want))
    assert simhash.components(empty).count() == 0 == simhash.deduplicate(empty).count()


@pytest.mark.parametrize("limit", [50, 4_000_000])
def test_ball_links_of_planted_fingerprints(spark, monkeypatch, limit):
    """Chains of near fingerprints, a dense ball around one centre, and strangers; also with slices split."""
    monkeypatch.setattr(simhash, "SLICE_VARIANTS", limit)
    monkeypatch.setattr(simhash, "prefix_bits", lambda n, half: 4)
    rng = np.random.default_rng(3)
    bits = lambda k: sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    fps = [int(x) for x in rng.integers(0, 2**63, 20)]
    centre = fps[0]
    fps += [centre ^ bits(rng.integers(1, 6)) for _ in range(25)]
    for _ in range(8):
        fps.append(fps[-1] ^ bits(4))
    fps = sorted(set(fps))
    a, b = [], []
    for prefix in range(16):
        u, v = simhash.slice_links(np.array([f for f in fps if ((f >> 60) ^ prefix).bit_count() <= 2], np.uint64), prefix, 4, 4)
        a += u.tolist()
        b += v.tolist()
    index = {f: i for i, f in enumerate(fps)}
    label = simhash.forest(len(fps), np.array([index[x] for x in a]), np.array([index[x] for x in b]))
    assert [fps[i] for i in label] == least_in_component(fps, fps, 4)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, letters = rng.integers(1, 60), rng.integers(2, 6)
        body = np.repeat(rng.integers(1, letters, 12), rng.integers(1, 9, 12)) if trial % 4 == 0 else rng.integers(1, letters, n)
        text = np.append(body, 0).astype(np.int16)
        cap, whole = int(rng.integers(2, 12)), text.tolist()
        blocks = list(suffix_sort.suffix_array(text, cap, memory=int(rng.integers(1, 40))))
        order = [p for block, _ in blocks for p in block.tolist()][::-1]
        shared = [x for _, prefix in blocks for x in prefix.tolist()][::-1]
        assert sorted([*order, len(body)]) == list(range(len(text)))
        keys = [whole[i : i + cap] for i in order]
        assert keys == sorted(keys)
        for k, (x, y) in enumerate(zip(keys, keys[1:])):
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert shared[k] == same


@pytest.mark.parametrize("block,names", [(4_000_000, 600_000), (700, 40)])
def test_repeated_bytes_against_brute_force(docs, empty, monkeypatch, block, names):
    """One block and shard, then many of both."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "RANGE_NAMES", names)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", min(block, 1_000_000) // 2)
    df = docs.where("length(text) < 5000 OR text IS NULL") if block < 1000 else docs
    first = {}
    rows = df.collect()
    for r in rows:
        b, d = (r["text"] or "").encode(), suffix_dedup.NO_ID if r["doc_id"] is None else r["doc_id"]
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for r in rows:
        b, d = (r["text"] or "").encode(), suffix_dedup.NO_ID if r["doc_id"] is None else r["doc_id"]
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = sum(bool(gone[i] and not (i and gone[i - 1])) for i in range(len(b)))
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.append((r["doc_id"], len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sum(w[2] for w in want) > 1000
    assert sorted(map(tuple, suffix_dedup.score(df).collect()), key=key) == sorted(want, key=key)
    assert suffix_dedup.score(empty).count() == 0


def test_removal_keeps_columns(docs):
    left = suffix_dedup.remove(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert left.where("text IS NULL").count() == docs.where("text IS NULL").count()
