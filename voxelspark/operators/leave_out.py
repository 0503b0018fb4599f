"""Leave-one-group-out forests of all groups together.

The forests of two held-out groups see the same rows but for those of the two groups. A row's bootstrap counts and the
random features at a place in a tree are the same whichever group is left out. So a tree is grown once for all groups: a node keeps the
histograms of all of its rows, and for each group with rows in it the best split is judged again without them. Groups
that find the same split stay together; the others leave for a variant of the node, shared by those that agree, and grow
on from there. A group without rows in a node needs no look at it. Each group ends with exactly the trees that its own
training rows give; ``tests`` grow them one by one and compare.

Nothing of a held-out group enters its forest: groups are dealt into folds, and a fold's bin edges come from rows of the
other folds; as long as the rows are few, of all other groups or nearly all. Class weights balance the bootstrap sample without the group; their ratio is rounded to steps of 1/256 of a
doubling, so that groups of about equal ratio share a root.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import forests as FR, keyed as K

FOLDS = 4  # at least, or one per group
MOST_FOLDS = 200
FOLD_ROWS = 200_000  # labelled rows times folds, where these are more than ``FOLDS``
RATIO_STEPS = 256  # of a class ratio, in a doubling
UNITS = 200  # of a fold and a share of the trees, about
TASK_ROWS = 1_000_000  # labelled rows whose bins a task holds
ITEM_CELLS = 1_000_000  # bins of histograms that are judged at a time
HELD = 0  # block that lists a fold's held-out groups: after the training blocks, before the rows to score


def _mixed(v: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    v = v.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _share(n: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return n[:, 1] * ratio / np.maximum(n[:, 0] + n[:, 1] * ratio, 1e-300)


def _purity(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (zeros * zeros + ones * ones) / np.maximum(zeros + ones, 1e-300)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] times, then the same of the next."""
    return np.repeat(start - (count.cumsum() - count), count) + np.arange(count.sum())


def _judged(codes: np.ndarray, n0: np.ndarray, n1: np.ndarray, slot: np.ndarray, pair: np.ndarray, node: np.ndarray, feature: np.ndarray, ratio: np.ndarray, min_leaf: int):
    """Best split of each item at its features: gain, feature and bin.

    Items are nodes, then pairs of a node and a group that is left out of it; ``node`` and ``pair`` name the items' node
    and the pair of each row (-1: none), ``feature`` the features of each node in turn.
    """
    nodes, items = len(feature), len(node)
    gain, f, b = np.full(items, -np.inf), np.zeros(items, np.int64), np.zeros(items, np.int64)
    own = np.flatnonzero(pair >= 0)
    for j in range(feature.shape[1]):
        code = codes[np.arange(len(slot)), feature[slot, j]].astype(np.int64)
        total = np.stack([np.bincount(slot * FR.BINS + code, weights=v, minlength=nodes * FR.BINS).reshape(nodes, -1) for v in (n0, n1)])
        at = pair[own] * FR.BINS + code[own]
        less = np.stack([np.bincount(at, weights=v[own], minlength=(items - nodes) * FR.BINS).reshape(items - nodes, FR.BINS) for v in (n0, n1)])
        step = max(1, ITEM_CELLS // FR.BINS)
        for a in range(0, items, step):
            i = np.arange(a, min(items, a + step))
            hist = total[:, node[i]]
            hist[:, i >= nodes] -= less[:, i[i >= nodes] - nodes]
            below = hist.cumsum(2)
            above = below[:, :, -1:] - below
            r = ratio[node[i], None]
            got = _purity(below[0], below[1] * r) + _purity(above[0], above[1] * r) - _purity(below[0, :, -1:], below[1, :, -1:] * r)
            got[(below.sum(0) < min_leaf) | (above.sum(0) < min_leaf)] = -np.inf
            most = got.argmax(1)
            got = got[np.arange(len(i)), most]
            better = got > gain[i]
            k = i[better]
            gain[k], f[k], b[k] = got[better], feature[node[k], j], most[better]
    return gain, f, b


def family(code: np.ndarray, y: np.ndarray, group: np.ndarray, times: np.ndarray, held: np.ndarray, groups: int, seed: tuple[int, int], depth: int | None = None, min_leaf: int = 1) -> dict:
    """One tree for each of the groups ``held`` (numbers below ``groups``), from the rows of all other groups.

    ``root`` has the first node of each group; ``leave`` lists where a group leaves a node (node * groups + group) and
    ``enter`` the node where it goes on.
    """
    d = code.shape[1]
    m = max(1, int(np.sqrt(d)))
    rows = np.flatnonzero(times > 0)
    zeros, ones = times * (y == 0.0), times * (y == 1.0)
    own = np.stack([np.bincount(group[rows], weights=v[rows], minlength=groups) for v in (zeros, ones)], 1)
    rest = own.sum(0) - own
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where((rest > 0).all(1), np.rint(np.log2(rest[:, 0] / rest[:, 1]) * RATIO_STEPS), 0.0)
    cells, cell = np.unique(step[held], return_inverse=True)
    root = np.full(groups, -1)
    root[held] = cell
    n = len(cells)
    ratio, key, ids = 2.0 ** (cells / RATIO_STEPS), np.tile(_mixed(np.array([seed[0] * 1_000_003 + seed[1]])), n), np.arange(n)
    members = np.bincount(cell, minlength=n)
    row, slot = np.tile(rows, n), np.repeat(np.arange(n), len(rows))
    live = root[group[row]] == slot
    keep = ~live | (members[slot] > 1)  # the rows of a single group are simply left out
    row, slot, live = row[keep], slot[keep], live[keep]
    count = np.stack([np.bincount(slot, weights=v[row], minlength=n) for v in (zeros, ones)], 1)
    made = n
    out = {"feature": [np.full(n, -1)], "bin": [np.zeros(n, np.int64)], "left": [np.zeros(n, np.int64)], "value": [_share(count, ratio)]}
    leave, enter, splits, level = [], [], [], 0

    def narrowed(opened: np.ndarray):
        """The rows and facts of the nodes that are still open."""
        number = np.full(len(opened), -1)
        number[opened] = np.arange(opened.sum())
        inside = number[slot] >= 0
        return row[inside], number[slot[inside]], live[inside], count[opened], ratio[opened], key[opened], ids[opened], members[opened]

    row, slot, live, count, ratio, key, ids, members = narrowed((count > 0).all(1))
    while len(ids):
        n = len(ids)
        # pairs of a node and a live group with rows in it
        pair = np.full(len(row), -1)
        pairs, pair[live] = np.unique(slot[live] * groups + group[row[live]], return_inverse=True)
        node = np.concatenate([np.arange(n), pairs // groups])
        whole = count[node]
        for side, v in enumerate((zeros, ones)):
            whole[n:, side] -= np.bincount(pair[live], weights=v[row[live]], minlength=len(pairs))
        value = _share(whole, ratio[node])
        f, b = np.full(n + len(pairs), -1), np.zeros(n + len(pairs), np.int64)
        asked = (whole > 0).all(1) & (True if depth is None else level < depth)
        order = _mixed(key[:, None] + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).argsort(1)
        for a in range(0, d, m):
            if not asked.any():
                break
            # the nodes of all items that still ask: of the nodes' own items those that don't ask are judged in vain
            used = np.unique(node[asked])
            number = np.full(n, -1)
            number[used] = np.arange(len(used))
            left_out = np.flatnonzero(asked[n:])
            place = np.full(len(pairs) + 1, -1)  # the last one for rows without a pair
            place[left_out] = np.arange(len(left_out))
            inside = number[slot] >= 0
            r, s = row[inside], number[slot[inside]]
            items = np.concatenate([np.arange(len(used)), number[node[n + left_out]]])
            gain, ff, bb = _judged(code[r], zeros[r], ones[r], s, place[pair[inside]], items, order[used, a : a + m], ratio[used], min_leaf)
            target = np.concatenate([used, n + left_out])
            hit = asked[target] & (gain > -1e-9)
            f[target[hit]], b[target[hit]] = ff[hit], bb[hit]
            asked[target[hit]] = False
        # groups that leave their node: for a leaf of their own, or for a variant with another split
        base = node[n:]
        off = (f[n:] != f[base]) | (b[n:] != b[base]) | ((f[n:] < 0) & (value[n:] != value[base]))
        members = members - np.bincount(base[off], minlength=n)
        to_leaf = np.flatnonzero(off & (f[n:] < 0))
        to_split = np.flatnonzero(off & (f[n:] >= 0))
        kinds, kind = np.unique((base[to_split] * d + f[n + to_split]) * FR.BINS + b[n + to_split], return_inverse=True)
        leave += [ids[base[to_leaf]] * groups + pairs[to_leaf] % groups, ids[base[to_split]] * groups + pairs[to_split] % groups]
        enter += [made + np.arange(len(to_leaf)), made + len(to_leaf) + kind]
        k = len(to_leaf) + len(kinds)
        out["feature"].append(np.full(k, -1))
        out["bin"].append(np.zeros(k, np.int64))
        out["left"].append(np.zeros(k, np.int64))
        out["value"].append(np.concatenate([value[n + to_leaf], np.zeros(len(kinds))]))
        # nodes that split: those that keep a group, then the variants
        stay = np.flatnonzero((f[:n] >= 0) & (members > 0))
        of = np.concatenate([stay, kinds // (FR.BINS * d)])
        sf, sb = np.concatenate([f[stay], kinds // FR.BINS % d]), np.concatenate([b[stay], kinds % FR.BINS])
        own_id = np.concatenate([ids[stay], made + len(to_leaf) + np.arange(len(kinds))])
        made += k
        size = np.concatenate([members[stay], np.bincount(kind, minlength=len(kinds))])
        splits.append((own_id, sf, sb, made + 2 * np.arange(len(of))))
        goes = np.full(n, -1)
        goes[stay] = np.arange(len(stay))
        goes = goes[base]  # where each pair goes on
        goes[to_leaf] = -1
        goes[to_split] = len(stay) + kind
        start, length = np.searchsorted(slot, np.arange(n)), np.bincount(slot, minlength=n)
        entry = _ranges(start[of], length[of])
        by = np.repeat(np.arange(len(of)), length[of])
        row, live = row[entry], live[entry] & (np.append(goes, -1)[pair[entry]] == by)
        keep = ~live | (size[by] > 1)
        row, live, by = row[keep], live[keep], by[keep]
        slot = 2 * by + (code[row, sf[by]] > sb[by])
        again = FR._sorted_by(slot)
        row, slot, live = row[again], slot[again], live[again]
        n = 2 * len(of)
        count = np.stack([np.bincount(slot, weights=v[row], minlength=n) for v in (zeros, ones)], 1)
        ratio, members, ids = np.repeat(ratio[of], 2), np.repeat(size, 2), made + np.arange(n)
        key = _mixed(np.repeat(key[of], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(of)))
        out["feature"].append(np.full(n, -1))
        out["bin"].append(np.zeros(n, np.int64))
        out["left"].append(np.zeros(n, np.int64))
        out["value"].append(_share(count, ratio))
        made, level = made + n, level + 1
        row, slot, live, count, ratio, key, ids, members = narrowed((count > 0).all(1))
    trees = {k: np.concatenate(v) for k, v in out.items()}
    for own_id, sf, sb, left in splits:
        trees["feature"][own_id], trees["bin"][own_id], trees["left"][own_id] = sf, sb, left
    leave, enter = np.concatenate([np.zeros(0, np.int64), *leave]), np.concatenate([np.zeros(0, np.int64), *enter])
    at = leave.argsort()
    return trees | {"root": root, "leave": leave[at], "enter": enter[at], "groups": groups}


def values(trees: dict, code: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class-1 share of each row's leaf in the tree of its own group."""
    node = trees["root"][group]
    going = np.arange(len(node))
    leave, enter = trees["leave"], trees["enter"]
    while len(going):
        at, g = node[going], group[going]
        if len(leave):
            asked = at * trees["groups"] + g
            i = np.minimum(np.searchsorted(leave, asked), len(leave) - 1)
            at = np.where(leave[i] == asked, enter[i], at)
        node[going] = at
        inner = trees["feature"][at] >= 0
        going, at = going[inner], at[inner]
        node[going] = trees["left"][at] + (code[going, trees["feature"][at]] > trees["bin"][at])
    return trees["value"][node]


def scored(df: DataFrame, group: str, x: str, label: str, trees: int, seed: int = 42, depth: int | None = None, min_leaf: int = 1, out: str = "p") -> DataFrame | None:
    """Column ``out``: probability of each row by the forest on the rows of all other groups whose label is 0 or 1.

    Groups whose training rows hold a single class give no rows, nor do rows without a group. None if there are more
    than ``TASK_ROWS`` training rows.
    """
    named = df.where(F.col(group).isNotNull())
    rows = named.select(F.struct(*df.columns).alias("_row"), F.col(x).cast("array<double>").alias("_x"), F.col(label).cast("int").alias("_y"), F.xxhash64(group).alias("_g"))
    rows = rows.withColumn("_h", F.xxhash64("_g", "_x"))
    n0, n1 = F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1)
    counts = cut_lineage(rows.groupBy("_g").agg(n0.alias("n0"), n1.alias("n1"), F.count(F.lit(1)).alias("n")))
    facts = counts.agg(F.count(F.lit(1)).alias("groups"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("n").alias("n")).first()
    known = (facts["n0"] or 0) + (facts["n1"] or 0)
    if known > TASK_ROWS:
        return None
    folds = max(FOLDS, min(MOST_FOLDS, FOLD_ROWS // max(1, known)))
    if facts["groups"] <= folds:
        folds = max(1, facts["groups"])
        names = sorted(r["_g"] for r in counts.select("_g").collect())
        fold = F.array_position(F.lit(names or [0]), F.col("_g")) - 1
    else:
        fold = F.pmod(F.xxhash64("_g"), F.lit(folds))
    rows = rows.withColumn("_fold", fold.cast("int"))
    labelled = rows.where("_y IN (0, 1)")
    each = -(-known // K.BLOCK_ROWS) or 1
    thin = -(-known * (folds - 1) // (folds * K.BLOCK_ROWS)) or 1  # edges come from at most about a block of rows

    def cuts(table: pa.Table) -> pa.Table:
        held = np.array(table["_h"]).argsort(kind="stable")
        flat = np.stack(table["_x"].to_pylist())[held]
        edges = FR.Forest(trees=1).begin(flat)["edges"]
        return pa.table({"_for": table["_for"].slice(0, 1), "edges": pa.array([edges.ravel()], pa.list_(pa.float64()))})

    others = F.filter(F.lit(list(range(folds))), lambda f: f != F.col("_fold"))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("edges"), "_h"), F.lit(thin)) == 0).select("_h", "_x", F.explode(others).alias("_for"))
    edges = {r["_for"]: np.array(r["edges"]).reshape(-1, FR.BINS - 1) for r in sample.groupBy("_for").applyInArrow(cuts, "_for int, edges array<double>").collect()}

    if not edges:  # no group has training rows
        return rows.where(F.lit(False)).select("_row.*", F.lit(None).cast("double").alias(out))
    fitting = counts.where((F.lit(facts["n0"] or 0) > F.col("n0")) & (F.lit(facts["n1"] or 0) > F.col("n1"))).select("_g")
    dealt = labelled.withColumn("_block", F.pmod(F.xxhash64("_h"), F.lit(each)).cast("int")).groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_h", "_y", "_g", "_x"))).alias("_a"))
    blocks = dealt.select(F.explode(F.lit(sorted(edges))).alias("_fold"), (F.col("_block") - each).alias("_block"), "_a")
    pieces = -(-facts["n"] // (folds * K.BLOCK_ROWS)) if facts["n"] else 1
    asked = rows.join(fitting, "_g", "left_semi")
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_h"), F.lit(pieces)).cast("int")).groupBy("_fold", "_block").agg(F.collect_list(F.struct("_row", "_g", "_x")).alias("_a"))

    @F.pandas_udf("binary")
    def coded(col: pd.Series, fold: pd.Series) -> pd.Series:
        return pd.Series([FR.binned(edges[f], np.stack(list(v))).tobytes() for v, f in zip(col, fold)])

    @F.pandas_udf("binary")
    def packed(col: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.int64).tobytes() for v in col])

    kept = ["_fold", "_block", coded("_a._x", "_fold").alias("code"), packed("_a._g").alias("g")]
    train = cut_lineage(blocks.select(*kept, packed("_a._y").alias("y")))
    test = cut_lineage(asked.select(*kept, F.col("_a._row").alias("_rows")))
    shards = min(trees, max(1, UNITS // folds))
    ends = [trees * i // shards for i in range(shards + 1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, grown, numbers = None, [], None, None
        for row in K._each(batches):
            if now != (row["_fold"], row["_shard"]):
                now, gathered, grown = (row["_fold"], row["_shard"]), [], None
            if row["_block"] < 0:  # training blocks come first
                g, y = np.frombuffer(row["g"], np.int64), np.frombuffer(row["y"], np.int64)
                gathered.append((np.frombuffer(row["code"], np.uint8).reshape(len(g), -1), g, y, row["_block"]))
                continue
            if row["_block"] == HELD:
                code, g, y = [np.concatenate([p[i] for p in gathered]) for i in range(3)]
                numbers = np.unique(np.concatenate([np.frombuffer(row["g"], np.int64), g]))
                g, held = np.searchsorted(numbers, g), np.searchsorted(numbers, np.frombuffer(row["g"], np.int64))
                grown = []
                for t in range(ends[now[1]], ends[now[1] + 1]):
                    times = np.concatenate([np.random.default_rng([seed, t, -p[3]]).poisson(1.0, len(p[1])) for p in gathered]).astype(float)
                    grown.append(family(code, y, g, times, held, len(numbers), (seed, t), depth, min_leaf))
                continue
            g = np.searchsorted(numbers, np.frombuffer(row["g"], np.int64))
            code = np.frombuffer(row["code"], np.uint8).reshape(len(g), -1)
            made = np.zeros(len(g))
            for tree in grown:
                made += values(tree, code, g)
            yield pa.RecordBatch.from_pydict({"_fold": pa.array([now[0]], pa.int32()), "_block": pa.array([row["_block"] - 1], pa.int32()), "_shard": pa.array([now[1]], pa.int32()), "v": pa.array([made], pa.list_(pa.float64()))})

    held = fitting.select(fold.cast("int").alias("_fold"), "_g").groupBy("_fold").agg(F.collect_list("_g").alias("g"))
    held = held.select("_fold", F.lit(HELD).alias("_block"), packed("g").alias("g"))
    every = train.unionByName(held, allowMissingColumns=True).unionByName(test.select("_fold", (F.col("_block") + 1).alias("_block"), "code", "g"), allowMissingColumns=True)
    every = every.withColumn("_shard", F.explode(F.lit(list(range(shards))))).repartition(folds * shards, "_fold", "_shard").sortWithinPartitions("_fold", "_shard", "_block")
    parts = every.mapInArrow(run, "_fold int, _block int, _shard int, v array<double>")
    # added one by one, so that a sum of shares is never above the number of trees
    sums = parts.groupBy("_fold", "_block").agg(F.sort_array(F.collect_list(F.struct("_shard", "v"))).alias("_s"))
    total = F.aggregate(F.slice("_s", 2, shards), F.col("_s")[0]["v"], lambda v, s: F.zip_with(v, s["v"], lambda p, q: p + q))
    sums = sums.select("_fold", "_block", F.transform(total, lambda v: v / trees).alias("_v"))
    joined = test.select("_fold", "_block", "_rows").join(sums, ["_fold", "_block"])
    return joined.select(F.explode(F.arrays_zip("_rows", "_v")).alias("_r")).select("_r._rows.*", F.col("_r._v").alias(out))
