"""Forests of many keys at once, grown level by level from histograms.

Trees grow on features cut into bins. A round takes open nodes of all trees of a key of several blocks, adds up
(feature, bin, class) histograms of the rows in them, one per block (``keyed.fit``), and splits each node at its best
bin. Only nodes of more than ``LOCAL_ROWS`` rows are split that way, so the driver holds the tops of the trees alone; the
rows of every smaller node meet in one task, as bytes of their bins, and that task grows the rest of the tree. A key of
one block needs no rounds. Trees are dealt into shards of bounded size. Every tree has its own bootstrap counts and class
weights, those that balance the classes of its bootstrap sample. A node looks at a random subset of the features, and at
the next ones if none of them splits it.

A key of few training cells needs no table of trees: ``whole_forest`` grows all of its trees at once and keeps their
leaves, boxes of bins, which then count the leaves that a row lies in, 64 of them in a word.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..session import cut_lineage
from . import keyed as K

BINS = 64
SHARD_TREES = 64
SHARD_NODES = 4_000_000  # about as many nodes as a shard's trees may have
LOCAL_ROWS = 100_000  # of a node whose rest a single task grows
TASKS = 2_000
CELLS = 1_000_000  # numbers of one round's histograms
ROW_TREES = 4_000_000  # rows times trees that are placed at a time
CODE_BITS = (BINS - 1).bit_length()
TOGETHER = 1_000_000  # bins of nodes that are grown together
BOX_CELLS = 16_000  # training rows times features up to which boxes are quicker than walks down the trees
BOX_WORDS = 65_536  # words times rows that are met at a time


def place(trees: dict, x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Node of every row in each of the trees ``which``: (trees, rows)."""
    out = np.empty((len(which), len(x)), np.int64)
    step = max(1, ROW_TREES // max(1, len(x)))
    feature, threshold, left = trees["feature"], trees["threshold"], trees["left"]
    for a in range(0, len(which), step):
        node = np.repeat(np.asarray(trees["root"][which[a : a + step]], np.int64), len(x))
        going = np.flatnonzero(feature[node] >= 0)
        while len(going):
            at = node[going]
            right = ~(x[going % len(x), feature[at]] <= threshold[at])  # NaN goes right, as in its bin
            at = left[at] + right
            node[going] = at
            going = going[feature[at] >= 0]
        out[a : a + step] = node.reshape(-1, len(x))
    return out


def binned(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1).astype(np.uint8)


def _sorted_by(slot: np.ndarray) -> np.ndarray:
    """Stable order of rows by a small number."""
    shift = max(1, int(len(slot)).bit_length())
    return np.sort((slot.astype(np.int64) << shift) | np.arange(len(slot))) & ((1 << shift) - 1)


def _best_splits(code: np.ndarray, row: np.ndarray, slot: np.ndarray, n: int, features: np.ndarray, ones: np.ndarray, zeros: np.ndarray, weights: np.ndarray, min_leaf: int):
    """Best gain of each of ``n`` nodes (rows ``row`` sorted by ``slot``) over its features, with feature, bin and counts below."""
    gain, f, b, below = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2))
    whole = np.stack([np.bincount(slot, weights=v, minlength=n) for v in (zeros, ones)], 1)
    start = whole.cumsum(0) - whole
    purity = lambda h: (h * h).sum(1) / np.maximum(h.sum(1), 1e-300)
    base = purity(whole * weights)
    for j in range(features.shape[1]):
        key = slot * 256 + code[row, features[slot, j]]
        order = _sorted_by(key)
        key = key[order]
        at = np.flatnonzero((key[1:] != key[:-1]) & (key[1:] >> 8 == key[:-1] >> 8))  # between two bins of a node
        if not len(at):
            continue
        own = key[at] >> 8
        under = np.stack([zeros[order].cumsum()[at], ones[order].cumsum()[at]], 1) - start[own]
        above = whole[own] - under
        got = purity(under * weights[own]) + purity(above * weights[own]) - base[own]
        got = np.where((under.sum(1) >= min_leaf) & (above.sum(1) >= min_leaf), got, -np.inf)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        most = np.maximum.reduceat(got, first)
        hit = np.flatnonzero(got == np.repeat(most, np.diff(np.r_[first, len(own)])))
        nodes, i = np.unique(own[hit], return_index=True)
        pick = hit[i][most > gain[nodes]]
        node = own[pick]
        gain[node], f[node], b[node], below[node] = got[pick], features[node, j], key[at[pick]] & 255, under[pick]
    return gain, f, b, below, whole


def grown(code: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, seed: Sequence[int], level: int = 0, depth: int | None = None, min_leaf: int = 1) -> dict:
    """The tree below one node, node 0, from the bins of its rows; every level is split at once. Cuts are numbers of bins."""
    return grown_together([(code, y, times, weights, seed, level)], depth, min_leaf)[0]


def grown_together(parts: Sequence[tuple], depth: int | None = None, min_leaf: int = 1) -> list[dict]:
    """The trees below several nodes (bins, labels, counts, class weights, seed and level of each): a level of all of them at once."""
    code = np.concatenate([p[0] for p in parts])
    d = code.shape[1]
    m = max(1, int(np.sqrt(d)))
    rngs = [np.random.default_rng(list(p[4])) for p in parts]
    begun = np.array([p[5] for p in parts])
    class_weights = np.array([p[3] for p in parts], float)
    y, times = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    zeros, ones = times * (y == 0.0), times * (y == 1.0)
    slot = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    row = np.arange(len(y))
    share = lambda h, w: (h * w)[:, 1] / np.maximum((h * w).sum(1), 1e-300)

    def leaves(sides: np.ndarray, tree: np.ndarray) -> dict:
        return {"tree": tree, "feature": np.full(len(sides), -1), "bin": np.zeros(len(sides), np.int64), "left": np.zeros(len(sides), np.int64), "value": share(sides, class_weights[tree])}

    def open_nodes(sides: np.ndarray, tree: np.ndarray, level: int) -> np.ndarray:
        return np.flatnonzero((sides > 0).all(1) & (True if depth is None else begun[tree] + level < depth))

    root = np.stack([np.bincount(slot, weights=v, minlength=len(parts)) for v in (zeros, ones)], 1)
    levels = [leaves(root, np.arange(len(parts)))]
    made, gains, level, deepest = len(parts), np.zeros((len(parts), d)), 0, begun.copy()
    place_of = open_nodes(root, levels[0]["tree"], 0)  # open nodes in the last level
    child = np.full(len(parts), -1)
    child[place_of] = np.arange(len(place_of))
    slot = child[slot]
    row, slot = row[slot >= 0], slot[slot >= 0]
    while len(place_of):
        n, last = len(place_of), levels[-1]
        tree = last["tree"][place_of]
        count = np.bincount(tree, minlength=len(parts))
        order = np.concatenate([rngs[t].random((count[t], d)) for t in np.flatnonzero(count)]).argsort(1)
        weights = class_weights[tree]
        gain, f, b, below, whole = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2)), np.zeros((n, 2))
        asked = np.arange(n)
        for a in range(0, d, m):
            number = np.full(n, -1)
            number[asked] = np.arange(len(asked))
            inside = number[slot] >= 0
            r, s = row[inside], number[slot[inside]]
            gain[asked], f[asked], b[asked], below[asked], whole[asked] = _best_splits(code, r, s, len(asked), order[asked, a : a + m], ones[r], zeros[r], weights[asked], min_leaf)
            asked = np.flatnonzero(~(gain > -1e-9))  # no feature of the subset splits the node: the next ones are asked
            if not len(asked):
                break
        split = np.flatnonzero(gain > -1e-9)
        if not len(split):
            break
        np.add.at(gains, (tree[split], f[split]), np.maximum(gain[split], 0.0))
        at = place_of[split]
        last["feature"][at], last["bin"][at] = f[split], b[split]
        last["left"][at] = made + 2 * np.arange(len(split))
        sides = np.stack([below[split], whole[split] - below[split]], 1).reshape(-1, 2)
        levels.append(leaves(sides, np.repeat(tree[split], 2)))
        made, level = made + len(sides), level + 1
        deepest[tree[split]] = begun[tree[split]] + level
        place_of = open_nodes(sides, levels[-1]["tree"], level)
        number, child = np.full(n, -1), np.full(len(sides), -1)
        number[split], child[place_of] = np.arange(len(split)), np.arange(len(place_of))
        inside = number[slot] >= 0
        row, slot = row[inside], slot[inside]
        slot = child[2 * number[slot] + (code[row, f[slot]] > b[slot])]
        row, slot = row[slot >= 0], slot[slot >= 0]
        again = _sorted_by(slot)
        row, slot = row[again], slot[again]
    every = {k: np.concatenate([v[k] for v in levels]) for k in levels[0]}
    order = every["tree"].argsort(kind="stable")  # tree by tree, each level by level
    start = np.searchsorted(every["tree"][order], np.arange(len(parts) + 1))
    rank = np.empty(made, np.int64)
    rank[order] = np.arange(made) - start[every["tree"][order]]
    every["left"] = np.where(every["feature"] >= 0, rank[every["left"]], 0)
    names = ("feature", "bin", "left", "value")
    return [{k: every[k][order[start[t] : start[t + 1]]] for k in names} | {"gains": gains[t], "deepest": int(deepest[t])} for t in range(len(parts))]


def _joined(top: dict, rest: dict[int, dict], edges: np.ndarray) -> dict:
    """Trees whose nodes ``rest`` are replaced by the trees grown below them."""
    t = {k: np.array(v) for k, v in top.items()}
    size, added = len(t["feature"]), {k: [t[k]] for k in ("feature", "threshold", "left", "value")}
    for node, sub in sorted(rest.items()):
        cut = np.where(sub["feature"] >= 0, edges[sub["feature"], sub["bin"]], 0.0)
        below = {"feature": sub["feature"], "threshold": cut, "left": sub["left"] + size - 1, "value": sub["value"]}
        for k, v in below.items():  # its node 0 takes the place of the open node
            t[k][node] = v[0]
            added[k].append(v[1:])
        size += len(cut) - 1
    kinds = {"feature": np.int16, "threshold": np.float64, "left": np.int32, "value": np.float64}
    return {"root": t["root"]} | {k: np.concatenate(v).astype(kinds[k]) for k, v in added.items()}


@dataclass
class Forest(K.Method):
    """Balanced random forest. A shard's trees lie in common arrays; children of a node are ``left`` and ``left + 1``."""

    trees: int = SHARD_TREES
    seed: int = 42
    depth: int | None = None
    min_leaf: int = 1
    bins: int = BINS
    first: int = 0  # number of its first tree
    local: int = 0  # nodes of at most as many bootstrap rows are left to ``grown``

    schema = "model binary, importance array<double>, nodes long, deepest int, rounds int"

    def begin(self, x: np.ndarray) -> dict:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="inverted_cdf"))[: self.bins - 1] if len(x) > self.bins else (np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in x.T]
        full = np.full((x.shape[1], self.bins - 1), np.inf)
        for row, e in zip(full, edges):
            row[: len(e)] = e
        t = self.trees
        arrays = {"root": np.arange(t), "feature": np.full(t, -1), "threshold": np.zeros(t), "left": np.zeros(t, np.int64), "value": np.zeros(t), "tree": np.arange(t), "level": np.zeros(t, np.int64), "tried": np.zeros(t, np.int64)}
        return {"edges": full, "t": arrays, "open": np.zeros(0, np.int64), "group": None, "weights": None, "gain": np.zeros((t, x.shape[1])), "rounds": 0, "done": False, "batch": 0, "rest": np.zeros(0, np.int64)}

    def drawn(self, tree: int, x: np.ndarray) -> np.ndarray:
        """How often the tree's bootstrap sample holds each row of a block."""
        salt = zlib.crc32(np.ascontiguousarray(x[:64]).tobytes())
        return np.random.default_rng([self.seed, self.first + int(tree), salt]).poisson(1.0, len(x))

    def features_of(self, state: dict, nodes: np.ndarray) -> np.ndarray:
        """The features that each open node looks at now: (nodes, features)."""
        d = state["edges"].shape[0]
        m = max(1, int(np.sqrt(d)))
        t = state["t"]
        out = np.empty((len(nodes), m), np.int64)
        for i, n in enumerate(nodes.tolist()):
            order = np.random.default_rng([self.seed, 1, n]).permutation(d)
            out[i] = np.resize(order[t["tried"][n] : t["tried"][n] + m], m)
        return out

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        label = y.astype(np.int64)
        if state["weights"] is None:
            return np.concatenate([np.bincount(label, weights=self.drawn(t, x), minlength=2) for t in range(self.trees)])
        group, chosen = state["group"], state["chosen"]
        code = binned(state["edges"], x).astype(np.int64)
        slot = np.full(len(state["t"]["feature"]), -1)
        slot[group] = np.arange(len(group))
        m, width = chosen.shape[1], self.bins * 2
        out = np.zeros(len(group) * m * width)
        used = np.unique(state["t"]["tree"][group])
        step = max(1, ROW_TREES // max(1, len(x)))
        for a in range(0, len(used), step):
            which = used[a : a + step]
            at = slot[place(state["t"], x, which)]
            times = np.stack([self.drawn(t, x) for t in which])
            tree, row = np.nonzero((at >= 0) & (times > 0))
            s, n = at[tree, row], times[tree, row].astype(float)
            for j in range(m):
                cell = ((s * m + j) * self.bins + code[row, chosen[s, j]]) * 2 + label[row]
                out += np.bincount(cell, weights=n, minlength=len(out))
        return out

    def _grouped(self, state: dict) -> dict:
        """The open nodes of the next round, as many as ``CELLS`` allows."""
        if not len(state["open"]):
            return state | {"done": True}
        m = max(1, int(np.sqrt(state["edges"].shape[0])))
        most = max(1, CELLS // (m * self.bins * 2))
        group = state["open"][:most]
        return state | {"group": group, "open": state["open"][most:], "chosen": self.features_of(state, group)}

    def step(self, state: dict, total: np.ndarray) -> dict:
        t = state["t"]
        if state["weights"] is None:
            counts = total.reshape(self.trees, 2)
            weights = counts.sum(1, keepdims=True) / (2 * np.maximum(counts, 1))
            share = (counts * weights)[:, 1] / np.maximum((counts * weights).sum(1), 1e-300)
            alive = np.flatnonzero((counts > 0).all(1)) if self.depth != 0 else np.zeros(0, np.int64)
            small = counts[alive].sum(1) <= self.local
            return self._grouped(state | {"weights": weights, "t": t | {"value": share}, "open": alive[~small], "rest": alive[small]})
        group, chosen = state["group"], state["chosen"]
        m = chosen.shape[1]
        raw = total.reshape(len(group), m, self.bins, 2)
        cut = raw * state["weights"][t["tree"][group]][:, None, None, :]
        below, n_below = cut.cumsum(2), raw.sum(3).cumsum(2)
        whole, n_whole = below[:, :, -1:], n_below[:, :, -1:]
        above, n_above = whole - below, n_whole - n_below
        purity = lambda h: (h * h).sum(3) / np.maximum(h.sum(3), 1e-300)
        gain = purity(below) + purity(above) - purity(whole)
        fits = (n_below >= self.min_leaf) & (n_above >= self.min_leaf)
        gain = np.where(fits, gain, -np.inf).reshape(len(group), -1)
        best = gain.argmax(1)
        at = np.arange(len(group))
        ok = np.isfinite(gain[at, best]) & (gain[at, best] > -1e-9)
        split, j, b = group[ok], best[ok] // self.bins, best[ok] % self.bins
        f = chosen[ok, j]
        t = {k: v.copy() for k, v in t.items()}
        first = len(t["feature"])
        t["feature"][split], t["threshold"][split] = f, state["edges"][f, b]
        t["left"][split] = first + 2 * np.arange(len(split))
        sides = np.stack([below[ok, j, b], above[ok, j, b]], 1).reshape(-1, 2)
        level = np.repeat(t["level"][split] + 1, 2)
        new = {"root": np.zeros(0, np.int64), "feature": np.full(len(sides), -1), "threshold": np.zeros(len(sides)), "left": np.zeros(len(sides), np.int64), "value": sides[:, 1] / np.maximum(sides.sum(1), 1e-300), "tree": np.repeat(t["tree"][split], 2), "level": level, "tried": np.zeros(len(sides), np.int64)}
        gains = state["gain"].copy()
        np.add.at(gains, (t["tree"][split], f), np.maximum(gain[at, best][ok], 0.0))
        again = group[~ok]  # no feature of the subset splits the node: the next ones are asked
        t["tried"][again] += m
        again = again[t["tried"][again] < state["edges"].shape[0]]
        t = {k: np.concatenate([t[k], new[k]]) for k in t}
        impure = (sides > 0).all(1) & ((level < self.depth) if self.depth is not None else True)
        size = np.stack([n_below[ok, j, b], n_above[ok, j, b]], 1).ravel()
        fresh, small = first + np.flatnonzero(impure & (size > self.local)), first + np.flatnonzero(impure & (size <= self.local))
        return self._grouped(state | {"t": t, "open": np.concatenate([state["open"], again, fresh]), "rest": np.concatenate([state["rest"], small]), "gain": gains, "rounds": state["rounds"] + 1})

    def model(self, state: dict) -> dict:
        return self.whole(state, {})

    def whole(self, state: dict, rest: dict[int, dict]) -> dict:
        """The model once the trees below the nodes ``rest`` are grown."""
        t, gain = _joined(state["t"], rest, state["edges"]), state["gain"].copy()
        for node, sub in rest.items():
            gain[state["t"]["tree"][node]] += sub["gains"]
        total = gain.sum(1, keepdims=True)
        share = gain / np.where(total > 0, total, 1.0)
        deepest = max([int(state["t"]["level"].max()), *[s["deepest"] for s in rest.values()]])
        return {"model": pickle.dumps(t), "importance": share.sum(0).tolist(), "nodes": len(t["feature"]), "deepest": deepest, "rounds": state["rounds"]}

    def pieces(self, state: dict, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per node of ``rest``: bins, labels and bootstrap counts of the rows of a block in it."""
        code, t = binned(state["edges"], x), state["t"]
        for tree in np.unique(t["tree"][state["rest"]]):
            times = self.drawn(tree, x)
            node = np.where(times > 0, place(t, x, np.array([tree]))[0], -1)
            for n in state["rest"][t["tree"][state["rest"]] == tree]:
                held = node == n
                if held.any():
                    yield int(n), code[held], y[held], times[held]

    def below(self, state: dict, node: int, code: np.ndarray, y: np.ndarray, times: np.ndarray) -> dict:
        tree, level = int(state["t"]["tree"][node]), int(state["t"]["level"][node])
        return grown(code, y, times, state["weights"][tree], [self.seed, 2, self.first + tree, node], level, self.depth, self.min_leaf)

    def below_all(self, state: dict, pieces: Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, dict]:
        """``below`` of all ``pieces``; as many as ``TOGETHER`` bins hold grow together, so that small nodes share the work of a level."""
        out, nodes, parts, cells = {}, [], [], 0
        for node, code, label, times in pieces:
            if parts and cells + code.size > TOGETHER:
                out |= zip(nodes, grown_together(parts, self.depth, self.min_leaf))
                nodes, parts, cells = [], [], 0
            tree, level = int(state["t"]["tree"][node]), int(state["t"]["level"][node])
            nodes.append(node)
            parts.append((code, label, times, state["weights"][tree], [self.seed, 2, self.first + tree, node], level))
            cells += code.size
        return out | dict(zip(nodes, grown_together(parts, self.depth, self.min_leaf))) if parts else out

    def state_bytes(self, width: int) -> int:
        return 8 * CELLS


class _Tops(Forest):
    """The parts of the trees above the nodes of at most ``local`` rows."""

    schema = "top binary"

    def model(self, state: dict) -> dict:
        return {"top": pickle.dumps({k: state[k] for k in ("t", "rest", "weights", "edges", "gain", "rounds")})}


def _part(state: dict, a: int, b: int) -> dict:
    """The state of trees ``a`` to ``b`` alone, as if they were the first ones."""
    t = state["t"]
    keep = np.flatnonzero((t["tree"] >= a) & (t["tree"] < b))
    number = np.zeros(len(t["tree"]), np.int64)
    number[keep] = np.arange(len(keep))
    own = {k: t[k][keep] for k in ("feature", "threshold", "value", "level")}
    own |= {"root": number[t["root"][a:b]], "left": number[t["left"][keep]], "tree": t["tree"][keep] - a}
    rest = state["rest"][np.isin(state["rest"], keep)]
    return state | {"t": own, "rest": number[rest], "weights": state["weights"][a:b], "gain": state["gain"][a:b]}


def grow(packed: DataFrame, keys: Sequence[str], trees: int = 500, seed: int = 42, depth: int | None = None, min_leaf: int = 1) -> DataFrame:
    """keys, _shard and the trees of each shard, for ``keyed.blocks`` of a training table with labels 0 and 1."""
    keys = list(keys)
    sizes = packed.groupBy("_key").agg(F.sum("n").alias("n"), F.max("_blocks").alias("b"))
    facts = sizes.agg(F.max("n").alias("n"), F.count_if(F.col("b") == 1).alias("small"), F.count_if(F.col("b") > 1).alias("large")).first()
    each = min(SHARD_TREES, max(1, SHARD_NODES // max(1, facts["n"] or 1)))
    shards = max(1, -(-trees // each))
    ends = [trees * i // shards for i in range(shards + 1)]
    by = [*keys, "_shard"]
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_shard int", Forest.schema])
    names = [*by, *[c.split()[0] for c in Forest.schema.split(", ")]]

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(packed.sparkSession.createDataFrame([], schema).schema)

    local = LOCAL_ROWS

    def one(a: int, b: int) -> Forest:
        return Forest(b - a, seed, depth, min_leaf, first=a, local=local)

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K._each(batches):
            x, y, w = K._unpacked(row)
            own = one(ends[row["_shard"]], ends[row["_shard"] + 1])
            state = own.begin(x)
            while not own.finished(state):
                state = own.step(state, own.stats(state, x, y, w))
            model = own.whole(state, own.below_all(state, own.pieces(state, x, y)))
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in by} | model], schema=arrow).select(names)

    dealt = F.explode(F.lit(list(range(shards)))).alias("_shard")
    spread = lambda n: min(TASKS, max(1, n))
    parts = []
    if facts["small"] or not facts["large"]:
        rows = packed.where("_blocks = 1").select(*keys, "_key", "x", "y", "w", dealt)
        parts.append(rows.repartition(spread(facts["small"] * shards), "_key", "_shard").mapInArrow(alone, schema))
    if facts["large"]:
        large = cut_lineage(packed.where("_blocks > 1").repartition(spread(4 * facts["large"] * -(-facts["n"] // K.BLOCK_ROWS)), "_key", "_block"))
        tops = K.fit(large, keys, _Tops(trees, seed, depth, min_leaf, local=local)).select(K._key(keys).alias("_key"), "top")
        parts.append(_rests(large, tops, keys, ends, one, schema, arrow, names, facts["large"] * trees))
    models = cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    return models.withColumn("_trees", F.lit(trees))


def _rests(large: DataFrame, tops: DataFrame, keys: list[str], ends: list[int], one, schema: str, arrow: pa.Schema, names: list[str], trees: int) -> DataFrame:
    """The shards of keys of several blocks: rows go to the task of their node, and trees grown there to their shard."""
    at = np.array(ends)
    forest = one(0, ends[-1])
    kinds = {f.name: f.dataType.simpleString() for f in large.schema.fields}
    fields = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_key string, _shard int, node int"])
    by = [*keys, "_key", "_shard", "node"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K._each(batches):
            state = pickle.loads(row["top"])
            x, y, _ = K._unpacked(row)
            for node, code, label, times in forest.pieces(state, x, y):
                tree = int(state["t"]["tree"][node])
                head = (tree, int(state["t"]["level"][node]), state["weights"][tree])
                made = {k: row[k] for k in keys} | {"_key": row["_key"], "_shard": int(np.searchsorted(at, tree, "right") - 1), "node": node, "head": pickle.dumps(head)}
                made |= {"block": row["_block"], "code": code.tobytes(), "y": label.astype(np.uint8).tobytes(), "times": times.astype(np.uint8).tobytes()}
                yield pa.RecordBatch.from_pylist([made], schema=piece).select(piece.names)

    def below(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        tree, level, weights = pickle.loads(table["head"][0].as_py())
        code, y, times = [np.concatenate([np.frombuffer(v.as_py(), np.uint8) for v in table[c]]) for c in ("code", "y", "times")]
        node = table["node"][0].as_py()
        sub = grown(code.reshape(len(y), -1), y, times.astype(float), weights, [forest.seed, 2, tree, node], level, forest.depth, forest.min_leaf)
        return table.slice(0, 1).select(by).append_column("sub", pa.array([pickle.dumps(sub)], pa.binary()))

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        shard = table["_shard"][0].as_py()
        a, b = ends[shard], ends[shard + 1]
        subs, top = {}, None
        for i in range(table.num_rows):
            raw, node = table["sub"][i].as_py(), table["node"][i].as_py()
            if node < 0:
                top = pickle.loads(raw)
            else:
                subs[node] = pickle.loads(raw)
        state = _part(top, a, b)
        # rest holds the shard's nodes in the order of the whole forest
        own = top["rest"][np.isin(top["t"]["tree"][top["rest"]], np.arange(a, b))]
        model = one(a, b).whole(state, {int(n): subs[int(o)] for n, o in zip(state["rest"], own)})
        made = {k: table[k][0].as_py() for k in [*keys, "_shard"]} | model
        return pa.Table.from_pylist([made], schema=arrow).select(names)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = large.sparkSession
    full = f"{fields}, head binary, block int, code binary, y binary, times binary"
    piece = to_arrow_schema(spark.createDataFrame([], full).schema)
    dealt = large.join(F.broadcast(tops), "_key").select(*keys, "_key", "_block", "x", "y", "w", "top").mapInArrow(rows, full)
    subs = cut_lineage(dealt.repartition(min(TASKS, max(8, trees)), *by).groupBy(*by).applyInArrow(below, f"{fields}, sub binary"))
    heads = large.where("_block = 0").join(tops, "_key").select(*keys, "_key", F.explode(F.lit(list(range(len(ends) - 1)))).alias("_shard"), F.lit(-1).alias("node"), F.col("top").alias("sub"))
    both = subs.unionByName(heads)
    return both.repartition(min(TASKS, max(8, trees // 8)), *keys, "_key", "_shard").groupBy(*keys, "_key", "_shard").applyInArrow(whole, schema)


def scored(df: DataFrame, models: DataFrame, keys: Sequence[str], x: str, ident: Sequence[str], out: str = "p", leaves: bool = False) -> DataFrame:
    """Column ``out``: mean of the trees' class-1 shares, or with ``leaves`` the leaf of every tree as an array.

    Rows of keys without a model are left out.
    """
    keys = list(keys)
    held = cut_lineage(K.row_blocks(df, keys, x, ident))
    pairs = models.select(K._key(keys).alias("_key"), "_shard", "_trees", "model")
    facts = pairs.agg(F.count(F.lit(1)).alias("n"), F.max("_shard").alias("s")).first()
    shards = list(range((facts["s"] or 0) + 1))
    blocks = held.select("_key", F.explode(F.lit(shards)).alias("_shard"), "_block", "n", "x")
    both = pairs.withColumns({"_block": F.lit(-1), "n": F.lit(0).cast("long"), "x": F.lit(None).cast("binary")}).unionByName(blocks, allowMissingColumns=True)
    # A shard's trees come once, before the blocks that they place.
    both = both.repartition(min(TASKS, max(1, facts["n"])), "_key", "_shard").sortWithinPartitions("_key", "_shard", "_block")
    kind = "array<int>" if leaves else "array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by, trees = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = (row["_key"][0].as_py(), row["_shard"][0].as_py())
                if row["_block"][0].as_py() < 0:
                    held_by, trees, total = key, pickle.loads(row["model"][0].as_py()), row["_trees"]
                elif key == held_by:
                    rows = np.frombuffer(row["x"][0].as_py()).reshape(row["n"][0].as_py(), -1)
                    if leaves:
                        made = place(trees, rows, np.arange(len(trees["root"]))).T.astype(np.int32).ravel()
                    else:
                        made = np.zeros(len(rows))
                        for t in range(len(trees["root"])):
                            made += trees["value"][place(trees, rows, np.array([t]))[0]]
                    yield pa.RecordBatch.from_arrays([row["_key"], row["_block"], row["_shard"], total, pa.array([made], pa.list_(pa.int32() if leaves else pa.float64()))], ["_key", "_block", "_shard", "_trees", "v"])

    parts = both.select("_key", "_shard", "_block", "n", "x", "_trees", "model").mapInArrow(run, f"_key string, _block int, _shard int, _trees int, v {kind}")
    if leaves:
        # Shards side by side: each holds ``len(v) / n`` leaves a row.
        whole = parts.groupBy("_key", "_block").agg(F.array_sort(F.collect_list(F.struct("_shard", "v"))).alias("_s"))
        joined = held.select("_key", "_block", "n", "_rows").join(whole, ["_key", "_block"])
        row = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.flatten(F.transform("_s", lambda s: F.slice(s["v"], (i * (F.size(s["v"]) / F.col("n")) + 1).cast("int"), (F.size(s["v"]) / F.col("n")).cast("int")))))
    else:
        whole = parts.groupBy("_key", "_block").agg(A.vector_sum(F.col("v")).alias("_v"), F.max("_trees").alias("_t"))
        joined = held.select("_key", "_block", "_rows").join(whole, ["_key", "_block"])
        row = F.transform("_v", lambda v: v / F.col("_t"))
    return joined.withColumn("_v", row).select(F.explode(F.arrays_zip("_rows", "_v")).alias("_r")).select("_r._rows.*", F.col("_r._v").alias(out))


def importances(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys and the mean share of the impurity that each feature took away."""
    return models.groupBy(*keys).agg(A.vector_sum(F.col("importance")).alias("_i"), F.max("_trees").alias("_t")).select(*keys, F.transform("_i", lambda v: v / F.col("_t")).alias("importance"))


# ---- forests of few rows -------------------------------------------------------------------


class _Orders:
    """The features in the order in which the nodes of each tree look at them; the same for all keys of a task."""

    kept: dict[tuple, "_Orders"] = {}

    def __init__(self, seed: int, first: int, last: int, d: int):
        self.seed, self.trees, self.d = seed, range(first, last), d
        self.table = np.zeros((len(self.trees), 0, d), np.int64)

    @classmethod
    def of(cls, *key: int) -> "_Orders":
        if key not in cls.kept:
            cls.kept.clear()
            cls.kept[key] = cls(*key)
        return cls.kept[key]

    def taken(self, tree: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The order of the node ``number`` of each tree."""
        if len(number) and number.max() >= self.table.shape[1]:
            n = max(64, 2 * int(number.max()))
            self.table = np.stack([np.random.default_rng([self.seed, 2, t, t]).random((n, self.d)).argsort(1) for t in self.trees])
        return self.table[tree, number]


def _packed_splits(flat: np.ndarray, base: np.ndarray, slot: np.ndarray, load: np.ndarray, held: np.ndarray, features: np.ndarray, whole: np.ndarray, weights: np.ndarray, min_leaf: int):
    """``_best_splits`` of nodes with counts ``whole``. A row's ``load`` is the last part of what is sorted, and ``held`` tells
    what it holds: its count, and in the upper half its count of ones."""
    n, m = features.shape
    few, low = (m - 1).bit_length(), (len(held) - 1).bit_length()
    shift, kind = low + CODE_BITS, np.uint32 if (n << few + low + CODE_BITS) < 1 << 32 else np.int64
    keys, head, wanted = np.empty((m, len(slot)), kind), (slot << few + shift) | load, np.ascontiguousarray(features.T)
    for j in range(m):
        keys[j] = head + (flat.take(base + wanted[j].take(slot)) << low) + (j << shift)
    keys = keys.ravel()
    keys.sort()
    total = held.take(keys & kind(len(held) - 1)).cumsum()
    keys >>= low
    step = keys[1:] ^ keys[:-1]
    at = np.flatnonzero((step > 0) & (step < 1 << CODE_BITS))  # between two bins of a node
    gain, f, b, below = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2))
    if not len(at):
        return gain, f, b, below
    part = keys.take(at)
    asked = (part >> CODE_BITS).astype(np.int64)
    own = asked >> few
    sizes = whole.sum(1).astype(np.int64) | whole[:, 1].astype(np.int64) << 32
    start = ((sizes.cumsum() - sizes) * m)[:, None] + sizes[:, None] * np.arange(1 << few)
    under = total.take(at) - start.ravel().take(asked)
    u1 = under >> 32
    u0 = ((under & 0xFFFFFFFF) - u1).astype(float)
    u1 = u1.astype(float)
    w0, w1 = np.ascontiguousarray(weights.T).take(own, 1)
    a0, a1 = np.ascontiguousarray(whole.T).take(own, 1)
    a0 -= u0
    a1 -= u1
    purity = lambda zeros, ones: (zeros * zeros + ones * ones) / np.maximum(zeros + ones, 1e-300)
    got = purity(u0 * w0, u1 * w1) + purity(a0 * w0, a1 * w1) - purity(*(whole * weights).T).take(own)
    if min_leaf > 1:
        got[(u0 + u1 < min_leaf) | (a0 + a1 < min_leaf)] = -np.inf
    new = np.flatnonzero(own[1:] != own[:-1]) + 1
    first = np.r_[0, new]
    most = np.maximum.reduceat(got, first)
    hit = np.flatnonzero(got == most.repeat(np.diff(np.r_[first, len(own)])))
    node = own.take(hit)
    once = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1]
    hit, node = hit[once], node[once]
    gain[node], f[node], b[node] = got[hit], features[node, asked[hit] & (1 << few) - 1], part[hit] & kind((1 << CODE_BITS) - 1)
    below[node, 0], below[node, 1] = u0[hit], u1[hit]
    return gain, f, b, below


def leaf_boxes(code: np.ndarray, y: np.ndarray, times: np.ndarray, orders: _Orders, depth: int | None = None, min_leaf: int = 1) -> list[np.ndarray]:
    """Tree, lowest and highest bins, and class-1 share of the leaves of the trees with bootstrap counts ``times``."""
    trees, d = len(times), code.shape[1]
    m = max(1, int(np.sqrt(d)))
    flat, one = code.astype(np.int64).ravel(), y.astype(np.int64)
    whole = np.stack([times @ (1 - one), times @ one], 1).astype(float)
    class_weights = whole.sum(1, keepdims=True) / (2 * np.maximum(whole, 1))
    tree, low, high = np.arange(trees), np.zeros((trees, d), np.uint8), np.full((trees, d), 255, np.uint8)
    at = np.flatnonzero(times)
    slot, row = np.divmod(at, len(one))
    base, load = row * d, times.ravel()[at] << 1 | one[row]
    held = np.arange(1 << int(load.max(initial=1)).bit_length())
    held = held >> 1 | (held >> 1) * (held & 1) << 32
    taken, leaves, level = np.zeros(trees, np.int64), [], 0

    def ended(at: np.ndarray) -> None:
        h = whole[at] * class_weights[tree[at]]
        leaves.append((tree[at], low[at], high[at], h[:, 1] / np.maximum(h.sum(1), 1e-300)))

    while len(tree):
        going = (whole > 0).all(1) & (depth is None or level < depth)
        ended(~going)
        inside = np.flatnonzero(going.take(slot))
        slot, base, load = (going.cumsum() - 1).take(slot.take(inside)), base.take(inside), load.take(inside)
        tree, low, high, whole = tree[going], low[going], high[going], whole[going]
        n, weights = len(tree), class_weights[tree]
        count = np.bincount(tree, minlength=trees)
        features = orders.taken(tree, taken[tree] + np.arange(n) - (count.cumsum() - count)[tree])
        taken += count
        gain, f, b, below = _packed_splits(flat, base, slot, load, held, features[:, :m], whole, weights, min_leaf)
        for a in range(m, d, m):  # nodes that no feature of the subset splits ask the next ones
            asked = ~(gain > -1e-9)
            if not asked.any():
                break
            inside = np.flatnonzero(asked.take(slot))
            got = _packed_splits(flat, base.take(inside), (asked.cumsum() - 1).take(slot.take(inside)), load.take(inside), held, features[asked, a : a + m], whole[asked], weights[asked], min_leaf)
            for old, new in zip((gain, f, b, below), got):
                old[asked] = new
        split = gain > -1e-9
        ended(~split)
        if not split.all():
            inside = np.flatnonzero(split.take(slot))
            slot, base, load = slot.take(inside), base.take(inside), load.take(inside)
        slot = 2 * (split.cumsum() - 1).take(slot) + (flat.take(base + f.take(slot)) > b.take(slot))
        f, b, below = f[split], b[split], below[split]
        whole = np.stack([below, whole[split] - below], 1).reshape(-1, 2)
        tree, low, high = tree[split].repeat(2), low[split].repeat(2, 0), high[split].repeat(2, 0)
        left = 2 * np.arange(len(f))
        high[left, f], low[left + 1, f] = b, b + 1
        level += 1
    return [np.concatenate(v) for v in zip(*leaves)]


def _box_words(word: np.ndarray, bit: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(features, words, bins): the bits of the boxes that hold a bin of a feature."""
    d, words = low.shape[1], int(word.max()) + 1
    out = np.zeros((d, words * (BINS + 1)), np.uint64)
    bit, at = np.uint64(1) << bit.astype(np.uint64), word * (BINS + 1)
    for f in range(d):
        np.add.at(out[f], at + low[:, f], bit)
        np.subtract.at(out[f], at + np.minimum(high[:, f].astype(np.int64) + 1, BINS), bit)
    return out.reshape(d, words, -1).cumsum(2, dtype=np.uint64)


def box_sums(leaves: Sequence[np.ndarray], code: np.ndarray) -> np.ndarray:
    """For each row of bins the sum of the shares of the leaves that it lies in, one of each tree."""
    tree, low, high, share = leaves
    out, code = np.zeros(len(code)), np.ascontiguousarray(code.T).astype(np.intp)

    def met(words: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
        step = min(2_048, max(1, out.size))
        each = max(1, BOX_WORDS // step)
        for i in range(0, out.size, step):
            rows = slice(i, i + step)
            for w in range(0, words.shape[1], each):
                own = slice(w, w + each)
                v = words[0, own].take(code[0, rows], 1)
                for f in range(1, len(words)):
                    v &= words[f, own].take(code[f, rows], 1)
                yield rows, own, v

    pure = np.flatnonzero(share == 1.0)
    if len(pure):  # a leaf of ones counts one: the leaves of all trees share words
        number = np.arange(len(pure))
        for rows, _, v in met(_box_words(number // 64, number % 64, low[pure], high[pure])):
            out[rows] += np.bitwise_count(v).sum(0, dtype=np.int64)
    mixed = np.flatnonzero((share > 0.0) & (share < 1.0))
    if len(mixed):  # of a word of one tree at most one bit is met: its place tells the leaf
        mixed = mixed[tree[mixed].argsort(kind="stable")]
        t = tree[mixed]
        begun = np.r_[True, t[1:] != t[:-1]]
        place_in = np.arange(len(t)) - np.flatnonzero(begun)[begun.cumsum() - 1]
        word, bit = (place_in % 64 == 0).cumsum() - 1, place_in % 64
        shares = np.zeros((word[-1] + 1, 65))
        shares[word, bit + 1] = share[mixed]
        for rows, own, v in met(_box_words(word, bit, low[mixed], high[mixed])):
            at = np.maximum((v.astype(float).view(np.int64) >> 52) - 1022, 0)  # 0 without a bit, else its place and one
            out[rows] += np.take_along_axis(shares[own], at, 1).sum(0)
    return out


def whole_forest(x: np.ndarray, y: np.ndarray, rows: np.ndarray, trees: int = 500, seed: int = 42, depth: int | None = None, min_leaf: int = 1) -> np.ndarray:
    """Class-1 probability of ``rows`` by the forest on ``x`` and ``y``, with the trees of a ``Forest``."""
    m = Forest(trees, seed, depth, min_leaf)
    edges = m.begin(x)["edges"]
    code, out, each = binned(edges, x), np.zeros(len(rows)), max(1, TOGETHER // max(1, x.size))
    at = binned(edges, rows)
    for a in range(0, trees, each):
        b = min(trees, a + each)
        times = np.stack([m.drawn(t, x) for t in range(a, b)])
        out += box_sums(leaf_boxes(code, y, times, _Orders.of(seed, a, b, x.shape[1]), depth, min_leaf), at)
    return out / trees


def forest_keys(train: DataFrame, df: DataFrame, keys: Sequence[str], x: str, ident: Sequence[str], label: str = "target", trees: int = 500, seed: int = 42, depth: int | None = None, min_leaf: int = 1, out: str = "p") -> DataFrame:
    """Class-1 probability of every row of ``df`` by its own key's forest on ``train``."""
    models = grow(K.blocks(train, keys, x, ident, label), keys, trees, seed, depth, min_leaf)
    return scored(df, models, keys, x, ident, out)
