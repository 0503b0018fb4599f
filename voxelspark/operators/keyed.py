"""Fits of many keys at once: every round is one Spark job that advances the models of all keys.

Rows are packed once into blocks: matrices of about ``BLOCK_ROWS`` rows of one key, dealt by the hash of ``ident``, so
that each block is a random share of its key. A method adds up statistics over blocks and turns the sums into the next
state. Keys of one block run all their rounds inside the task that holds the block; larger ones send one row of sums
per block, which are added by key, and a round's states go back to the tasks. The number of jobs follows the rounds,
not the keys. Keys are taken in waves whose states stay below ``STATE_BYTES``, so the driver holds a bounded table.

``ident`` names the rows of a key; rows with equal ``ident`` share a block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..session import cut_lineage
from .columns import attach
from .ranking import value_prefix

BLOCK_ROWS = 20_000
STATE_BYTES = 64_000_000
KEPT_BYTES = 4_000_000  # rows that blocks send to the driver in a round, over all keys; four times as many at most
SAMPLE = 2_000  # rows of a block from which a start is drawn
REG_COVAR = 1e-6  # fixed value: added to the diagonal of every covariance


# ---- blocks and rounds ---------------------------------------------------------------------


def _key(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")


def blocks(df: DataFrame, keys: Sequence[str], vec: str, ident: Sequence[str], label: str | None = None, weight: str | None = None, block_rows: int | None = None) -> DataFrame:
    """keys, _key, _blocks, _block, n and the matrix x (with labels y and weights w) of each block, as bytes of doubles."""
    keys = list(keys)
    rows = df.select(
        *keys, _key(keys).alias("_key"), F.xxhash64(*ident).alias("_h"), F.col(vec).alias("x"),
        (F.lit(0.0) if label is None else F.col(label).cast("double")).alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
    )
    counts = rows.groupBy(F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    size = block_rows or BLOCK_ROWS
    dealt = rows.join(counts, F.col("_key") == F.col("_k")).withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int")).drop("_k", "_n")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_h"), F.col("_blocks")).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    by = [*keys, "_key", "_blocks", "_block"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_h")
        flat = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        made = [flat.tobytes(), *[table[c].to_numpy().tobytes() for c in ("y", "w")]]
        out = table.slice(0, 1).select(by).append_column("n", pa.array([table.num_rows], pa.int64()))
        for name, raw in zip(("x", "y", "w"), made):
            out = out.append_column(name, pa.array([raw], pa.binary()))
        return out

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "n long, x binary, y binary, w binary"])
    return cut_lineage(dealt.groupBy(*by).applyInArrow(pack, schema))


def row_blocks(df: DataFrame, keys: Sequence[str], vec: str, ident: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """_key, keys, _block, n, the matrix x as bytes and the whole rows of each block, for scoring by a model of the key."""
    keys, size = list(keys), block_rows or BLOCK_ROWS
    counts = df.groupBy(_key(keys).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.select(_key(keys).alias("_key"), *keys, F.struct(*df.columns).alias("_row"), F.col(vec).cast("array<double>").alias("_x"), F.xxhash64(F.xxhash64(*ident)).alias("_h"))
    rows = rows.join(counts, F.col("_key") == F.col("_k")).withColumn("_block", F.pmod("_h", F.ceil(F.col("_n") / size)).cast("int"))
    packed = rows.groupBy("_key", *keys, "_block").agg(F.collect_list(F.struct("_row", "_x")).alias("_all"))

    @F.pandas_udf("binary")
    def joined(x: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.asarray(v, np.float64) for v in rows]).tobytes() for rows in x])

    return packed.select("_key", *keys, "_block", F.size("_all").cast("long").alias("n"), joined(F.col("_all._x")).alias("x"), F.col("_all._row").alias("_rows"))


def by_key(df: DataFrame, row: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per key; a null key is a key like any other."""
    if not keys:
        return attach(df, row, keys)
    named = row.withColumnsRenamed({k: f"_by_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
    return df.join(named, same).drop(*[f"_by_{k}" for k in keys])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, w = np.frombuffer(row["y"]), np.frombuffer(row["w"])
    return np.frombuffer(row["x"]).reshape(len(y), -1), y, w


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def settled(method: "Method", x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """The last state of a fit whose rows are all here."""
    state = method.begin(x)
    while not method.finished(state):
        state = method.step(state, method.stats(state, x, y, w))
    return state


def fit(packed: DataFrame, keys: Sequence[str], method: "Method") -> DataFrame:
    """keys and the fitted model of each key, by ``blocks``."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], method.schema])
    names = [*keys, *[c.split()[0] for c in method.schema.split(", ")]]

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            own = method.named(row["_key"])
            model = own.model(settled(own, *_unpacked(row)))
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in keys} | model], schema=arrow).select(names)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = packed.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    small = packed.where("_blocks = 1").mapInArrow(alone, schema)
    large = packed.where("_blocks > 1")
    first = large.where("_block = 0")
    held = first.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("x") / F.col("n")).alias("b")).first()
    result = cut_lineage(small)
    if held["n"]:
        waves = -(-held["n"] * method.state_bytes(int(held["b"] // 8)) // STATE_BYTES)
        for wave in range(waves):
            inside = F.pmod(F.xxhash64("_key"), F.lit(waves)) == wave
            result = result.unionByName(_rounds(large.where(inside), keys, method, schema))
    return result


def _rounds(large: DataFrame, keys: list[str], method: "Method", schema: str) -> DataFrame:
    """The models of one wave of keys; states are on the driver and travel with each job."""
    spark = large.sparkSession

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            state = pickle.dumps(method.named(row["_key"]).begin(_unpacked(row)[0]))
            yield pa.RecordBatch.from_pydict({"_key": [row["_key"]], "state": pa.array([state], pa.binary())})

    started = large.where("_block = 0").mapInArrow(begin, "_key string, state binary").collect()
    states = {r["_key"]: pickle.loads(r["state"]) for r in started}
    first = large.where("_block = 0").select("_key", "_blocks", *keys).collect()
    names, counts = {r["_key"]: {k: r[k] for k in keys} for r in first}, {r["_key"]: r["_blocks"] for r in first}
    while running := {k: s for k, s in states.items() if not method.finished(s)}:
        running = {k: s | {"room": KEPT_BYTES // len(running), "blocks": counts[k]} for k, s in running.items()}
        sent = spark.sparkContext.broadcast(running)

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                if row["_key"] in sent.value:
                    total, kept = method.named(row["_key"]).parts(sent.value[row["_key"]], *_unpacked(row))
                    yield pa.RecordBatch.from_pydict({"_key": [row["_key"]], "stats": pa.array([total], pa.list_(pa.float64())), "kept": pa.array([kept], pa.binary())})

        sums = large.mapInArrow(add, "_key string, stats array<double>, kept binary").groupBy("_key").agg(A.vector_sum(F.col("stats")).alias("s"), F.collect_list("kept").alias("kept"))
        for r in sums.collect():
            states[r["_key"]] = method.named(r["_key"]).leap(running[r["_key"]], np.array(r["s"]), r["kept"])
        sent.unpersist()
    return cut_lineage(spark.createDataFrame([names[k] | method.model(s) for k, s in states.items()], schema))


class Method:
    """What a fit does with a block and with sums over blocks."""

    schema: str

    def named(self, key: str) -> "Method":
        """The method for one key, where it depends on the key."""
        return self

    def begin(self, x: np.ndarray) -> dict: ...

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray: ...

    def step(self, state: dict, total: np.ndarray) -> dict: ...

    def parts(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, bytes]:
        """What a block of a large key sends in a round: sums, and what isn't summed (not above ``room``)."""
        return self.stats(state, x, y, w), b""

    def leap(self, state: dict, total: np.ndarray, kept: list[bytes]) -> dict:
        """The state after a round of a large key, or after several where the parts suffice for them."""
        return self.step(state, total)

    def finished(self, state: dict) -> bool:
        return state["done"]

    def model(self, state: dict) -> dict: ...

    def state_bytes(self, width: int) -> int:
        return 8 * len(pickle.dumps(self.begin(np.zeros((1, width)))))


# ---- clusters ------------------------------------------------------------------------------


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(1), 0.0)


def spread_start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres far apart from each other: each drawn with a chance in proportion to its squared distance."""
    rng = np.random.default_rng(seed)
    x = x[:SAMPLE]
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = near.sum()
        i = rng.integers(len(x)) if total <= 0 else min(int(np.searchsorted(np.cumsum(near), rng.random() * total, "right")), len(x) - 1)
        centres.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    return np.array(centres)


def _index(n: float, sizes: np.ndarray, sums: np.ndarray, norms: float) -> float:
    """Calinski-Harabasz from sizes, sums and the sum of squared norms; NaN without two clusters."""
    used = sizes > 0
    k = int(used.sum())
    if k < 2 or k >= n:
        return float("nan")
    centre = sums[used] / sizes[used, None]
    middle = sums.sum(0) / n
    inside = norms - (sizes[used] * (centre * centre).sum(1)).sum()
    between = (sizes[used] * ((centre - middle) ** 2).sum(1)).sum()
    return float(between * (n - k) / (inside * (k - 1))) if inside > 1e-12 * max(norms, 1.0) else 1.0


class Clusters(Method):
    """Several starts and restarts run side by side; of each restart the best start stays, then the restart with the
    highest Calinski-Harabasz index, taken in one more round."""

    def __init__(self, k: int, seed: int, starts: int, restarts: int, max_iter: int):
        self.k, self.starts, self.restarts, self.max_iter = k, starts, max(1, restarts), max_iter
        self.seeds = [seed + r + 1000 * s for r in range(self.restarts) for s in range(starts)]

    def _labels(self, state: dict, run: int, x: np.ndarray) -> np.ndarray: ...

    def _judged(self, state: dict, x: np.ndarray) -> np.ndarray:
        out = [np.array([float(len(x)), float((x * x).sum())])]
        for run in state["finalists"]:
            label = self._labels(state, run, x)
            sums = np.zeros((self.k, x.shape[1]))
            np.add.at(sums, label, x)
            out += [np.bincount(label, minlength=self.k).astype(float), sums.ravel()]
        return np.concatenate(out)

    def _chosen(self, state: dict, total: np.ndarray) -> dict:
        n, norms, rest = total[0], total[1], total[2:].reshape(len(state["finalists"]), -1)
        index = [_index(n, r[: self.k], r[self.k :].reshape(self.k, -1), norms) for r in rest]
        known = [i for i, v in enumerate(index) if np.isfinite(v)]
        best = max(known, key=lambda i: index[i]) if known else 0
        return state | {"best": state["finalists"][best], "index": index[best] if known else None, "done": True}

    def _ended(self, state: dict, value: np.ndarray) -> dict:
        """Finalists by ``value`` (higher is better); without restarts the best start is the result."""
        best = [int(np.argmax(value[r * self.starts : (r + 1) * self.starts])) + r * self.starts for r in range(self.restarts)]
        return state | {"finalists": best, "best": best[0], "index": None, "done": self.restarts == 1}


class KMeans(Clusters):
    """Lloyd rounds until every centre rests; after ``max_iter`` of them only the best start of each restart goes on.

    One job of a large key makes many rounds. A row whose nearest centre leads by more than ``2 reach`` keeps it as long as
    no centre is farther than ``reach`` from where it stood, so such rows are sent as sums and only the others as rows;
    from both the driver goes on until a centre leaves its reach. The next reach follows from the counts of leads below
    ``BINS`` bounds, so that the rows fit into ``room``. The rounds are the same as those of one job each.
    """

    BINS = 30
    schema = "centres array<array<double>>, cost double, quality double, rounds int"

    def __init__(self, k: int, seed: int = 42, starts: int = 10, restarts: int = 1, max_iter: int = 300):
        super().__init__(k, seed, starts, restarts, max_iter)

    def begin(self, x: np.ndarray) -> dict:
        return {"c": np.array([spread_start(x, self.k, s) for s in self.seeds]), "moving": np.ones(len(self.seeds), bool), "cost": np.zeros(len(self.seeds)), "rounds": 0, "done": False, "finalists": None} | {
            "at": np.zeros(len(self.seeds), int), "limit": self.max_iter, "reach": np.zeros(len(self.seeds))
        }

    def _labels(self, state: dict, run: int, x: np.ndarray) -> np.ndarray:
        return _distances(x, state["c"][run]).argmin(1)

    @staticmethod
    def _active(state: dict) -> np.ndarray:
        return np.flatnonzero(state["moving"] & (state["at"] < state["limit"]))

    def _bounds(self, c: np.ndarray) -> np.ndarray:
        return np.ptp(c, axis=0).max() * 0.5 ** np.arange(self.BINS)

    def parts(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, bytes]:
        if state["finalists"] is not None:
            return self._judged(state, x), b""
        out, kept, runs = [], [], self._active(state)
        room = 4 * state["room"] // (8 * x.shape[1] * len(runs) * state["blocks"])
        for run in runs:
            c, reach = state["c"][run], state["reach"][run]
            d = _distances(x, c)
            label = d.argmin(1)
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2]) if self.k > 1 else np.array([[0.0, np.inf]] * len(x))
            lead = two[:, 1] - two[:, 0]
            loose = (lead <= 2 * reach * (1 + 1e-9)) & (reach > 0)
            if loose.sum() > room:
                reach, loose = 0.0, np.zeros(len(x), bool)
            off, one = x - c[label], np.zeros((len(x), self.k))
            one[np.arange(len(x)), label] = ~loose
            out += [one.sum(0), (one.T @ off).ravel(), one.T @ (off * off).sum(1), np.searchsorted(np.sort(lead), self._bounds(c), "right").astype(float)]
            kept.append((reach, x[loose]))
        return np.concatenate(out), pickle.dumps(kept)

    def leap(self, state: dict, total: np.ndarray, kept: list[bytes]) -> dict:
        if state["finalists"] is not None:
            return self._chosen(state, total)
        state = state | {n: state[n].copy() for n in ("c", "moving", "cost", "at", "reach")}
        runs, sent, d = self._active(state), [pickle.loads(b) for b in kept], state["c"].shape[2]
        for i, (run, t) in enumerate(zip(runs, total.reshape(len(runs), -1))):
            n0, off, far, below = np.split(t, [self.k, self.k + self.k * d, 2 * self.k + self.k * d])
            off, c0, reach, loose = off.reshape(self.k, d), state["c"][run].copy(), min(p[i][0] for p in sent), np.concatenate([p[i][1] for p in sent])
            while state["moving"][run] and state["at"][run] < state["limit"]:
                c = state["c"][run].copy()
                gap = c - c0
                if not np.sqrt((gap * gap).sum(1)).max() <= reach:
                    break
                near = _distances(loose, c)
                label = near.argmin(1)
                one = np.eye(self.k)[label]
                n = n0 + one.sum(0)
                new = np.where(n[:, None] > 0, c0 + (off + one.T @ (loose - c0[label])) / np.maximum(n, 1.0)[:, None], c)
                cost = (far - 2 * (gap * off).sum(1) + n0 * (gap * gap).sum(1)).sum() + near[np.arange(len(loose)), label].sum()
                state["c"][run], state["cost"][run] = new, cost
                state["moving"][run], state["at"][run] = not np.allclose(new, c, rtol=1e-9, atol=1e-12), state["at"][run] + 1
            fits = np.flatnonzero(below * 8 * d * len(runs) <= state["room"])
            state["reach"][run] = self._bounds(c0)[fits[0]] / 2 if len(fits) else 0.0
        state["rounds"] = int(state["at"].max())
        if state["moving"].any() and not len(self._active(state)):  # from here on only the best start of each restart goes on
            ahead = [r * self.starts + int(np.argmin(state["cost"][r * self.starts : (r + 1) * self.starts])) for r in range(self.restarts)]
            state |= {"moving": state["moving"] & np.isin(np.arange(len(self.seeds)), ahead), "limit": np.inf}
        return state if state["moving"].any() else self._ended(state, -state["cost"])

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        if state["finalists"] is not None:
            return self._judged(state, x)
        out = []
        for run in np.flatnonzero(state["moving"]):
            d = _distances(x, state["c"][run])
            label = d.argmin(1)
            one = np.zeros((len(x), self.k))
            one[np.arange(len(x)), label] = 1.0
            out += [one.sum(0), (one.T @ x).ravel(), [d[np.arange(len(x)), label].sum()]]
        return np.concatenate(out)

    def step(self, state: dict, total: np.ndarray) -> dict:
        if state["finalists"] is not None:
            return self._chosen(state, total)
        c, moving, cost = state["c"].copy(), state["moving"].copy(), state["cost"].copy()
        for run, t in zip(np.flatnonzero(moving), total.reshape(moving.sum(), -1)):
            n, sums = t[: self.k], t[self.k : -1].reshape(self.k, -1)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1.0)[:, None], c[run])
            moving[run] = not np.allclose(new, c[run], rtol=1e-9, atol=1e-12)
            c[run], cost[run] = new, t[-1]
        state = state | {"c": c, "moving": moving, "cost": cost, "rounds": state["rounds"] + 1}
        if state["rounds"] >= self.max_iter:  # from here on only the best start of each restart goes on, until it rests
            near = [cost[r * self.starts : (r + 1) * self.starts] for r in range(self.restarts)]
            ahead = [r * self.starts + int(np.argmin(v)) for r, v in enumerate(near)]
            state["moving"] = moving & np.isin(np.arange(len(moving)), ahead)
        return state if state["moving"].any() else self._ended(state, -cost)

    def model(self, state: dict) -> dict:
        b = state["best"]
        return {"centres": state["c"][b].tolist(), "cost": float(state["cost"][b]), "quality": state["index"], "rounds": state["rounds"]}


class Mixture(Clusters):
    """Expectation-maximisation with full covariances, started from k-means on a block."""

    schema = "weights array<double>, means array<array<double>>, whitening array<array<double>>, offsets array<double>, likelihood double, quality double, rounds int"

    def __init__(self, k: int, seed: int = 42, starts: int = 3, restarts: int = 1, max_iter: int = 500, tol: float = 1e-3):
        super().__init__(k, seed, starts, restarts, max_iter)
        self.tol = tol

    def begin(self, x: np.ndarray) -> dict:
        runs = []
        for s in self.seeds:
            plain = KMeans(self.k, s, 1)
            state = plain.begin(x)
            while not plain.finished(state):
                state = plain.step(state, plain.stats(state, x, None, None))
            one = np.eye(self.k)[_distances(x, state["c"][0]).argmin(1)]
            runs.append(self._maximised(self._sums(one, x), len(x)))
        names = ("weights", "means", "white", "offsets")
        return {n: np.array([r[i] for r in runs]) for i, n in enumerate(names)} | {"moving": np.ones(len(runs), bool), "like": np.full(len(runs), -np.inf), "rounds": 0, "done": False, "finalists": None}

    @staticmethod
    def _sums(share: np.ndarray, x: np.ndarray) -> np.ndarray:
        second = np.einsum("nk,nd,ne->kde", share, x, x, optimize=True)
        return np.concatenate([share.sum(0), (share.T @ x).ravel(), second.ravel()])

    def _maximised(self, t: np.ndarray, n: float) -> tuple:
        k = self.k
        size = t[:k] + 10 * np.finfo(float).eps
        d = int((np.sqrt(1 + 4 * (len(t) - k) / k) - 1) / 2 + 0.5)
        mean = t[k : k + k * d].reshape(k, d) / size[:, None]
        cov = t[k + k * d :].reshape(k, d, d) / size[:, None, None] - mean[:, :, None] * mean[:, None, :]
        white, offset = [], []
        for j in range(k):
            values, vectors = np.linalg.eigh((cov[j] + cov[j].T) / 2)
            values = np.maximum(values, 0.0) + REG_COVAR
            white.append((vectors / np.sqrt(values)).T)
            offset.append(np.log(size[j] / n) - 0.5 * np.log(values).sum() - 0.5 * d * np.log(2 * np.pi))
        return size / n, mean, np.array(white), np.array(offset)

    def _log(self, state: dict, run: int, x: np.ndarray) -> np.ndarray:
        parts = [o - 0.5 * (((x - m) @ v.T) ** 2).sum(1) for o, m, v in zip(state["offsets"][run], state["means"][run], state["white"][run])]
        return np.stack(parts, 1)

    def _labels(self, state: dict, run: int, x: np.ndarray) -> np.ndarray:
        return self._log(state, run, x).argmax(1)

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        if state["finalists"] is not None:
            return self._judged(state, x)
        out = [[float(len(x))]]
        for run in np.flatnonzero(state["moving"]):
            log = self._log(state, run, x)
            top = log.max(1, keepdims=True)
            share = np.exp(log - top)
            norm = share.sum(1, keepdims=True)
            out += [self._sums(share / norm, x), [(top + np.log(norm)).sum()]]
        return np.concatenate(out)

    def step(self, state: dict, total: np.ndarray) -> dict:
        if state["finalists"] is not None:
            return self._chosen(state, total)
        n, new = total[0], {k: v.copy() for k, v in state.items() if isinstance(v, np.ndarray)}
        for run, t in zip(np.flatnonzero(state["moving"]), total[1:].reshape(state["moving"].sum(), -1)):
            like = t[-1] / n
            new["moving"][run] = not abs(like - state["like"][run]) < self.tol
            new["like"][run] = like
            if new["moving"][run]:
                new["weights"][run], new["means"][run], new["white"][run], new["offsets"][run] = self._maximised(t[:-1], n)
        state = state | new | {"rounds": state["rounds"] + 1}
        return self._ended(state, new["like"]) if not new["moving"].any() or state["rounds"] >= self.max_iter else state

    def model(self, state: dict) -> dict:
        b = state["best"]
        return {
            "weights": state["weights"][b].tolist(), "means": state["means"][b].tolist(), "whitening": [v.ravel().tolist() for v in state["white"][b]],
            "offsets": state["offsets"][b].tolist(), "likelihood": float(state["like"][b]), "quality": state["index"], "rounds": state["rounds"],
        }


# ---- logistic regression -------------------------------------------------------------------


class Newton(Method):
    """Damped Newton rounds on a convex loss: a move that does not lower it is halved."""

    schema = "coefficients array<array<double>>, present array<boolean>, loss double, gradient double, rounds int"
    free_intercept = True

    def begin(self, x: np.ndarray) -> dict:
        zero = np.zeros((self.heads(), x.shape[1] + 1))
        return {"b": zero, "try": zero, "loss": np.inf, "present": None, "rounds": 0, "done": False, "pull": np.inf}

    def step(self, state: dict, total: np.ndarray) -> dict:
        if state["present"] is None:
            return state | {"present": total > 0, "done": bool((total > 0).sum() < 2)}
        t, rounds = state["try"], state["rounds"] + 1
        free = np.ones(t.shape[1])
        free[-1] = 0.0 if self.free_intercept else 1.0
        loss = total[0] + 0.5 / self.c * ((t * free) ** 2).sum()
        if not loss <= state["loss"] + 1e-12 * abs(loss) and rounds < self.max_iter:  # too far: half the way
            return state | {"try": (state["b"] + t) / 2, "rounds": rounds}
        grad = total[1 : 1 + t.size] + (t * free / self.c).ravel()
        hess = total[1 + t.size :].reshape(t.size, t.size) + np.diag(np.tile(free, len(t)) / self.c)
        move = np.linalg.lstsq(hess, grad, rcond=1e-12)[0].reshape(t.shape)
        pull = float(np.abs(grad).max())
        done = pull <= self.tol * max(1.0, abs(loss)) or rounds >= self.max_iter
        return state | {"b": t, "try": t - move, "loss": float(loss), "pull": pull, "rounds": rounds, "done": bool(done)}

    def model(self, state: dict) -> dict:
        return {"coefficients": state["b"].tolist(), "present": [bool(v) for v in state["present"]], "loss": float(state["loss"]), "gradient": float(state["pull"]), "rounds": state["rounds"]}


@dataclass
class Logistic(Newton):
    """Penalised multinomial regression by damped Newton rounds; with two classes ``binary`` fits one weight vector.

    The penalty is |w|^2 / (2 C), intercepts are free. Classes without rows get probability zero.
    """

    classes: int
    c: float = 1.0
    max_iter: int = 100
    tol: float = 1e-8
    binary: bool = False

    def heads(self) -> int:
        return 1 if self.binary else self.classes

    def _probabilities(self, b: np.ndarray, present: np.ndarray, x1: np.ndarray) -> np.ndarray:
        z = x1 @ b.T
        if self.binary:
            z = np.concatenate([np.zeros_like(z), z], 1)
        z = np.where(present, z, -np.inf)
        z = z - z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        label = y.astype(np.int64)
        if state["present"] is None:
            return np.bincount(label, minlength=self.classes).astype(float)
        x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
        p = self._probabilities(state["try"], state["present"], x1)
        one = np.eye(self.classes)[label]
        loss = -(w * np.log(np.maximum(p[np.arange(len(x)), label], 1e-300))).sum()
        used = slice(1, 2) if self.binary else slice(None)
        p, one = p[:, used], one[:, used]
        grad = ((p - one) * w[:, None]).T @ x1
        heads, d = grad.shape
        hess = np.zeros((heads, d, heads, d))
        for i in range(heads):
            for j in range(i, heads):
                v = w * (p[:, i] * ((i == j) - p[:, j]))
                hess[i, :, j] = (x1 * v[:, None]).T @ x1
                hess[j, :, i] = hess[i, :, j].T
        return np.concatenate([[loss], grad.ravel(), hess.ravel()])


@dataclass
class SquaredHinge(Newton):
    """Linear support vectors: |w|^2 / 2 + C sum of weight * max(0, 1 - margin)^2, the intercept penalised like a weight."""

    c: float = 1.0
    max_iter: int = 100
    tol: float = 1e-8
    free_intercept: bool = False

    def heads(self) -> int:
        return 1

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        if state["present"] is None:
            return np.bincount(y.astype(np.int64), minlength=2).astype(float)
        x1, side = np.concatenate([x, np.ones((len(x), 1))], 1), 2 * y - 1
        short = np.maximum(1 - side * (x1 @ state["try"][0]), 0.0)
        grad = -2 * (w * side * short) @ x1
        hess = 2 * (x1 * (w * (short > 0))[:, None]).T @ x1
        return np.concatenate([[(w * short * short).sum()], grad, hess.ravel()])


# ---- perceptron ----------------------------------------------------------------------------


@dataclass
class Perceptron(Method):
    """Rectified hidden layers and one logistic unit, by Adam on mini-batches, with early stopping.

    Each class of a block leaves every tenth row aside. An epoch takes the other rows in a seeded order, ``batch`` rows per
    step; then the hits on the rows aside are counted. ``patience`` epochs without a gain of ``tol`` end the training, and
    the weights of the best epoch stay. The penalty is alpha / 2 |w|^2 per row of a batch. Every block takes the steps of
    an epoch over its own rows, and weights and moments are averaged by rows, so a round is an epoch whatever the batch.
    """

    hidden: tuple[int, ...] = (32, 16)
    seed: int = 42
    batch: int = 256
    epochs: int = 200
    alpha: float = 1e-4
    rate: float = 1e-3
    patience: int = 10
    tol: float = 1e-4

    schema = "weights array<array<double>>, biases array<array<double>>, score double, epochs int, best_epoch int"
    betas = (0.9, 0.999)

    def begin(self, x: np.ndarray) -> dict:
        rng, sizes = np.random.default_rng(self.seed), [x.shape[1], *self.hidden, 1]
        p = []
        for a, b, gain in zip(sizes, sizes[1:], [6.0] * len(self.hidden) + [2.0]):
            bound = np.sqrt(gain / (a + b))
            p += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        zero = [np.zeros_like(v) for v in p]
        steps = max(1, round(0.9 * len(x) / self.batch))
        return {"p": p, "m": zero, "v": zero, "t": 0, "steps": steps, "epoch": 0, "best": -np.inf, "kept": p, "at": 0, "idle": 0, "done": False}

    @staticmethod
    def aside(y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), bool)
        for c in (0, 1):
            out[np.flatnonzero(y == c)[9::10]] = True
        return out

    @staticmethod
    def forward(p: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for i in range(0, len(p), 2):
            z = layers[-1] @ p[i] + p[i + 1]
            layers.append(np.maximum(z, 0.0) if i + 2 < len(p) else 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
        return layers

    def _gradients(self, p: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        layers, grads = self.forward(p, x), []
        delta = layers[-1] - y[:, None]
        for i in range(len(p) - 2, -1, -2):
            h = layers[i // 2]
            grads = [h.T @ delta, delta.sum(0), *grads]
            delta = (delta @ p[i].T) * (h > 0)
        return [(g + (self.alpha * old if i % 2 == 0 else 0.0)) / len(x) for i, (g, old) in enumerate(zip(grads, p))]

    def stats(self, state: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Hits and rows aside of the weights so far; then rows, and rows times weights and moments after one more epoch."""
        aside, rows = self.aside(y), np.flatnonzero(~self.aside(y))
        hit = (self.forward(state["p"], x[aside])[-1][:, 0] > 0.5) == (y[aside] == 1)
        judged = [float(hit.sum()), float(aside.sum()), float(len(rows))]
        p, m, v, t = state["p"], state["m"], state["v"], state["t"]
        b1, b2 = self.betas
        if state["epoch"] < self.epochs:
            for part in np.array_split(np.random.default_rng([self.seed, state["epoch"]]).permutation(rows), state["steps"]):
                t += 1
                if not len(part):
                    continue
                rate = self.rate * np.sqrt(1 - b2**t) / (1 - b1**t)
                grads = self._gradients(p, x[part], y[part])
                m = [b1 * o + (1 - b1) * g for o, g in zip(m, grads)]
                v = [b2 * o + (1 - b2) * g * g for o, g in zip(v, grads)]
                p = [o - rate * a / (np.sqrt(c) + 1e-8) for o, a, c in zip(p, m, v)]
        return np.concatenate([judged, *[len(rows) * a.ravel() for a in (*p, *m, *v)]])

    def step(self, state: dict, total: np.ndarray) -> dict:
        if state["epoch"]:
            state = self._judged(state, total)
        if state["done"]:
            return state
        shapes, at, made = [v.shape for v in state["p"]] * 3, 3, []
        for shape in shapes:
            size = int(np.prod(shape))
            made.append(total[at : at + size].reshape(shape) / max(total[2], 1.0))
            at += size
        n = len(state["p"])
        return state | {"p": made[:n], "m": made[n : 2 * n], "v": made[2 * n :], "t": state["t"] + state["steps"], "epoch": state["epoch"] + 1}

    def _judged(self, state: dict, total: np.ndarray) -> dict:
        score = total[0] / total[1] if total[1] else 0.0
        idle = 0 if score > state["best"] + self.tol else state["idle"] + 1
        out = state | {"idle": idle}
        if score > state["best"]:
            out |= {"best": score, "kept": state["p"], "at": state["epoch"]}
        return out | {"done": state["epoch"] >= self.epochs or bool(total[1] and idle > self.patience)}

    def model(self, state: dict) -> dict:
        p = state["kept"]
        return {"weights": [w.T.ravel().tolist() for w in p[::2]], "biases": [b.tolist() for b in p[1::2]], "score": float(state["best"]), "epochs": state["epoch"], "best_epoch": state["at"]}


def rectified(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def layer(h: Column, weights: Column, biases: Column) -> Column:
    """Inputs of the units of a layer whose weights stand unit after unit."""
    return A.let(h, lambda v: A.let(F.size(v), lambda d: F.transform(biases, lambda b, j: b + dot(F.slice(weights, j * d + 1, d), v))))


def perceptron_scored(df: DataFrame, models: DataFrame, keys: Sequence[str], x: str, hidden: int = 2, out: str = "p") -> DataFrame:
    """Column ``out``: probability of class 1 by each key's own perceptron of ``hidden`` hidden layers."""
    own = by_key(df, models.select(*keys, F.struct("weights", "biases").alias("_m")), keys)
    v = F.col(x)
    for i in range(hidden):
        v = rectified(layer(v, F.col("_m.weights")[i], F.col("_m.biases")[i]))
    v = layer(v, F.col("_m.weights")[hidden], F.col("_m.biases")[hidden])[0]
    return own.withColumn(out, 1.0 / (1.0 + F.exp(-v))).drop("_m")


# ---- projections ---------------------------------------------------------------------------


def projections(df: DataFrame, keys: Sequence[str], cols: Sequence[str], cap: int = 10, fit: Column | None = None, scale: bool = False, threshold: float = 1e-8) -> DataFrame:
    """keys, centre, loadings and shares: the principal components of each key, from one grouped aggregate.

    Columns that vary by no more than ``threshold`` take no part; ``scale`` divides by the deviation first.
    """
    keys, d = list(keys), len(cols)
    rows = df if fit is None else df.where(fit)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in cols]).alias("_mean"), F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("_cov")
    )
    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                cov = np.zeros((d, d))
                for (i, j), v in zip(pairs, row["_cov"]):
                    cov[i, j] = cov[j, i] = v
                kept = np.flatnonzero(np.diag(cov) > threshold)
                unit = np.sqrt(np.diag(cov)) if scale else np.ones(d)
                unit = np.where(unit > 0, unit, 1.0)
                part = (cov / unit[:, None] / unit)[np.ix_(kept, kept)]
                values, vectors = np.linalg.eigh(part)
                order = np.argsort(-values, kind="stable")[: max(1, min(cap, len(kept), row["_n"] - 1))]
                loadings = np.zeros((len(order), d))
                for k, o in enumerate(order):
                    v = vectors[:, o]
                    loadings[k, kept] = v * np.sign(v[np.argmax(np.abs(v))]) / unit[kept]
                total = max(float(np.maximum(values, 0).sum()), 1e-300)
                made.append({k: row[k] for k in keys} | {"centre": row["_mean"], "loadings": loadings.tolist(), "shares": (values[order] / total).tolist()})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "centre array<double>, loadings array<array<double>>, shares array<double>"])
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return moments.mapInArrow(solve, schema)


def dot(a: Column, b: Column) -> Column:
    return A.total(F.zip_with(a, b, lambda x, y: x * y))


def projected(df: DataFrame, keys: Sequence[str], cols: Sequence[str], table: DataFrame, out: str = "z") -> DataFrame:
    """The components of every row as one array, by its key's ``projections``."""
    own = by_key(df, table.select(*keys, F.col("centre").alias("_centre"), F.col("loadings").alias("_loadings")), keys)
    x = F.zip_with(F.array(*[F.col(c).cast("double") for c in cols]), "_centre", lambda v, m: v - m)
    return own.withColumn(out, A.let(x, lambda v: F.transform("_loadings", lambda w: dot(v, w)))).drop("_centre", "_loadings")


def nearest_centre(z: Column, centres: Column) -> Column:
    far = F.transform(centres, lambda c: A.total(F.zip_with(z, c, lambda a, b: (a - b) * (a - b))))
    return A.let(far, lambda d: F.array_position(d, F.array_min(d)) - 1).cast("int")


def likeliest_component(z: Column, means: Column, whitening: Column, offsets: Column) -> Column:
    """Number of the mixture component with the highest posterior."""
    d = F.size(z)

    def density(m: Column) -> Column:
        gap = F.zip_with(z, m["m"], lambda a, b: a - b)
        rows = F.sequence(F.lit(0), d - 1)
        return A.let(gap, lambda g: m["o"] - A.total(F.transform(rows, lambda i: A.let(dot(F.slice(m["w"], i * d + 1, d), g), lambda v: v * v))) / 2)

    parts = F.arrays_zip(means.alias("m"), whitening.alias("w"), offsets.alias("o"))
    return A.let(F.transform(parts, density), lambda v: F.array_position(v, F.array_max(v)) - 1).cast("int")


def probabilities(z: Column, coefficients: Column, present: Column, binary: bool = False) -> Column:
    """Class probabilities of a ``Logistic`` model."""
    x = F.concat(z, F.array(F.lit(1.0)))
    raw = A.let(x, lambda v: F.transform(coefficients, lambda b: dot(v, b)))
    raw = F.concat(F.array(F.lit(0.0)), raw) if binary else raw
    known = F.zip_with(raw, present, lambda v, here: F.when(here, v))

    def shares(v: Column) -> Column:
        e = F.transform(v, lambda a: F.coalesce(F.exp(a - F.array_max(v)), F.lit(0.0)))
        return A.let(e, lambda w: A.let(A.total(w), lambda t: F.transform(w, lambda a: a / t)))

    return A.let(known, shares)


# ---- whole steps ---------------------------------------------------------------------------


def cluster_keys(df: DataFrame, keys: Sequence[str], z: str, ident: Sequence[str], k: int, algo: str = "gmm", seed: int = 42, restarts: int = 1, starts: int | None = None, out: str = "cluster") -> DataFrame:
    """Column ``out``: the cluster of every row by its own key's model, all keys fitted together."""
    if algo not in ("kmeans", "gmm"):
        raise ValueError(f"unsupported algorithm {algo!r}")
    method = KMeans(k, seed, starts or 10, restarts) if algo == "kmeans" else Mixture(k, seed, starts or 3, restarts)
    models = fit(blocks(df, keys, z, ident), keys, method)
    if algo == "kmeans":
        own = by_key(df, models.select(*keys, F.col("centres").alias("_m")), keys)
        return own.withColumn(out, nearest_centre(F.col(z), F.col("_m"))).drop("_m")
    own = by_key(df, models.select(*keys, F.struct("means", "whitening", "offsets").alias("_m")), keys)
    return own.withColumn(out, likeliest_component(F.col(z), F.col("_m.means"), F.col("_m.whitening"), F.col("_m.offsets"))).drop("_m")


def logistic_keys(train: DataFrame, df: DataFrame, keys: Sequence[str], x: str, ident: Sequence[str], label: str, classes: int, c: float = 1.0, weight: str | None = None, binary: bool = False, out: str = "probs") -> DataFrame:
    """Column ``out``: class probabilities of every row of ``df`` by its own key's regression on ``train``."""
    models = fit(blocks(train, keys, x, ident, label, weight), keys, Logistic(classes, c, binary=binary))
    own = by_key(df, models.select(*keys, F.struct("coefficients", "present").alias("_m")), keys)
    return own.withColumn(out, probabilities(F.col(x), F.col("_m.coefficients"), F.col("_m.present"), binary)).drop("_m")


def _margin(x: str, w: Column) -> Column:
    return dot(F.concat(F.col(x), F.array(F.lit(1.0))), w)


def svm_models(train: DataFrame, keys: Sequence[str], x: str, ident: Sequence[str], label: str = "target", folds: int = 3, c: float = 1.0) -> DataFrame:
    """keys and _parts: a machine and its calibration for each fold.

    Rows are dealt into calibration folds within key and class, copies of a row into one fold. For every fold a machine is fitted on the others and a
    sigmoid, with smoothed targets, on the fold's own margins.
    """
    keys = list(keys)
    counts = train.withColumn("_h", F.xxhash64(F.lit("calibration"), *ident))
    ranks = value_prefix(counts, [*keys, label], "_h", {"n": F.max(F.lit(1))})
    fold = (F.col("n_before") % folds).cast("int").alias("_f")
    dealt = cut_lineage(counts.join(ranks.select(*keys, label, "_h", fold), [*keys, label, "_h"]).drop("_h"))
    each = dealt.withColumn("_held", F.explode(F.lit(list(range(folds))))).where("_held <> _f")
    by = [*keys, "_held"]
    rest = balanced_weight(each, by, label)
    machines = fit(blocks(rest, by, x, ident, label, "weight"), by, SquaredHinge(c))
    machines = machines.select(*by, F.element_at("coefficients", 1).alias("_w"))
    held = by_key(dealt.withColumnRenamed("_f", "_held"), machines, by).withColumn("_m", F.array(_margin(x, F.col("_w"))))
    held = balanced_counts(held, by, label)
    goal = F.when(F.col(label) == 1, (F.col("_n1") + 1.0) / (F.col("_n1") + 2.0)).otherwise(1.0 / (F.col("_n0") + 2.0))
    sides = F.array(F.struct(F.lit(1).alias("_side"), goal.alias("_goal")), F.struct(F.lit(0).alias("_side"), (1.0 - goal).alias("_goal")))
    smooth = held.select(*by, *ident, "_m", F.inline(sides))
    sigmoids = fit(blocks(smooth, by, "_m", [*ident, "_side"], "_side", "_goal"), by, Logistic(2, 1e12, binary=True))
    return machines.transform(lambda m: by_key(m, sigmoids.select(*by, F.element_at("coefficients", 1).alias("_s")), by)).groupBy(*keys).agg(F.collect_list(F.struct("_w", "_s")).alias("_parts"))


def svm_scored(df: DataFrame, models: DataFrame, keys: Sequence[str], x: str, out: str = "p") -> DataFrame:
    """Column ``out``: the calibrated probability of class 1, averaged over the folds."""
    own = by_key(df, models, keys)
    shares = F.transform("_parts", lambda p: 1.0 / (1.0 + F.exp(-(_margin(x, p["_w"]) * p["_s"][0] + p["_s"][1]))))
    return own.withColumn(out, A.total(shares) / F.size("_parts")).drop("_parts")


def svm_keys(train: DataFrame, df: DataFrame, keys: Sequence[str], x: str, ident: Sequence[str], label: str = "target", folds: int = 3, c: float = 1.0, out: str = "p") -> DataFrame:
    """Column ``out``: calibrated probability of class 1 by each key's own support vectors."""
    return svm_scored(df, svm_models(train, keys, x, ident, label, folds, c), keys, x, out)


def balanced_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows of class 0 and 1 of each key, as _n0 and _n1."""
    return by_key(df, df.groupBy(*keys).agg(F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1")), keys)


def balanced_weight(df: DataFrame, keys: Sequence[str], label: str, out: str = "weight") -> DataFrame:
    """n / (classes n_c) within each key, attached to its rows."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_c")))).alias("_by"), F.sum("_c").alias("_n"))
    own = by_key(df, totals, keys)
    return own.withColumn(out, F.col("_n") / (F.size("_by") * F.element_at("_by", F.col(label)))).drop("_by", "_n")


# ---- keys of few rows ----------------------------------------------------------------------


def class_balance(y: np.ndarray) -> np.ndarray:
    """``balanced_weight`` of rows in memory."""
    _, kind, n = np.unique(y, return_inverse=True, return_counts=True)
    return (len(y) / (len(n) * n))[kind]


def whole_logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class-1 probability of ``rows`` by the balanced regression on ``x`` and ``y``, as by ``logistic_keys``."""
    method = Logistic(2, binary=True)
    state = settled(method, x, y, class_balance(y))
    return method._probabilities(state["b"], state["present"], np.concatenate([rows, np.ones((len(rows), 1))], 1))[:, 1]


def whole_svm(x: np.ndarray, y: np.ndarray, dealt: np.ndarray, rows: np.ndarray, folds: int = 3, c: float = 1.0) -> np.ndarray:
    """Class-1 probability of ``rows`` by the machines of ``svm_models``; ``dealt`` is the hash that deals rows into folds.

    A half, if the rows are too few for a machine and rows that it has not seen.
    """
    fold, total, made = np.empty(len(y), np.int64), np.zeros(len(rows)), 0
    for k in np.unique(y):
        fold[y == k] = np.unique(dealt[y == k], return_inverse=True)[1] % folds
    margin = lambda v, b: v @ b[:-1] + b[-1]
    for f in range(folds):
        held = fold == f
        if held.all() or not held.any():
            continue
        b = settled(SquaredHinge(c), x[~held], y[~held], class_balance(y[~held]))["b"][0]
        own, ones = y[held], (y[held] == 1).sum()
        goal = np.where(own == 1, (ones + 1.0) / (ones + 2.0), 1.0 / (len(own) - ones + 2.0))
        side, m = np.repeat([1.0, 0.0], len(own)), np.tile(margin(x[held], b), 2)[:, None]
        s = settled(Logistic(2, 1e12, binary=True), m, side, np.concatenate([goal, 1.0 - goal]))["b"][0]
        z = margin(rows, b) * s[0] + s[1]
        total, made = total + 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))), made + 1
    return total / made if made else np.full(len(rows), 0.5)
