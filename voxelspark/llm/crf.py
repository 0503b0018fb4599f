"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its two neighbours; forward-backward gives
the probability that a line is good, and the length-weighted mean over the lines is the document's score.
Documents carry the only labels, so for training each line takes its document's label. The fit uses at most
``max_docs`` labelled documents of at most ``max_chars`` characters (those with the smallest id hash):
a stated bound on labelled rows; scoring reads every text whole.

With two states a chain needs one number per line: the log odds ``m`` of the forward message follow
``m[t] = e[t] + g(m[t-1])`` and those of the backward message ``b[t] = g(e[t+1] + b[t+1])``, where ``e`` is
the line's own log odds and ``g`` the passage through the transition weights. Chains of a batch advance together.

Defined cases: a null or empty text is one empty line; a null id is never held out and never trains; of
repeated labels the smallest counts; null labels are ignored; without labels of both kinds every score is
the share of good labels (0.5 without labels); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_texts, stored

MAX_DOCS = 4000
MAX_CHARS = 100_000
CHUNK_BYTES = 4_000_000

CLASSES = [  # byte classes whose shares of a line are features
    range(0x41, 0x5B),
    range(0x61, 0x7B),
    range(0x30, 0x3A),
    b" \t\r\x0b\x0c",
    b"#$%&*<>@^_~=+\\`{}[]",
    b"|",
    b"!?",
    b".,;:'\"()-/",
    range(0xC0, 0x100),
]
LOOKUP = np.zeros((len(CLASSES), 256), np.uint8)
for _i, _c in enumerate(CLASSES):
    LOOKUP[_i, list(_c)] = 1
OWN = len(CLASSES) + 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [b.split(b"\n") for b in raw]
    counts = np.array([len(x) for x in lines], np.int64)
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    own = np.zeros((len(ends), OWN), np.float32)
    for k in range(len(CLASSES)):
        own[:, k] = np.add.reduceat(LOOKUP[k][buffer], starts, dtype=np.int64) / np.maximum(size, 1)
    at = 0
    for doc in lines:
        seen = set()
        for line in doc:
            words = line.split()
            n = len(words)
            if n:
                row = own[at]
                row[9] = len(set(words)) / n
                row[10] = sum(map(eq, words, words[1:])) / n
                row[11] = min(size[at] / n, 20.0) / 20
                row[12] = line in seen
                row[13] = n < 4
                seen.add(line)
            at += 1
    own[:, 14] = np.log1p(size) / 10
    return own, size, counts


def beside(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line of its text, last line, the values of the line before, of the line after); zero where there is none."""
    first = np.zeros(len(values), bool)
    first[np.concatenate(([0], np.cumsum(counts)[:-1]))] = True
    last = np.roll(first, -1)
    before, after = np.roll(values, 1, axis=0), np.roll(values, -1, axis=0)
    before[first], after[last] = 0, 0
    return first, last, before, after


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the own features, the line before's, the line after's, first, last and the bias
    stay: np.ndarray  # weight of remaining bad, of remaining good
    prior: float | None = None  # the score of every text if nothing could be fitted


class Chains:
    """The lines of many texts, laid out by position so that all chains advance at once."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[order]
        lengths = counts[order]
        self.steps = []
        live = len(order)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            while live and lengths[live - 1] <= t:
                live -= 1
            self.steps.append(starts[:live] + t)

    def messages(self, e: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the forward and the backward message at every line."""
        g = lambda x: np.logaddexp(0, x + stay[1]) - np.logaddexp(stay[0], x)
        m, b = e.copy(), np.zeros_like(e)
        for prev, now in zip(self.steps, self.steps[1:]):
            m[now] += g(m[prev[: len(now)]])
        for now, after in zip(self.steps[-2::-1], self.steps[:0:-1]):
            b[now[: len(after)]] = g(e[after] + b[after])
        return m, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Maximise the mean conditional log likelihood per text by Adam steps on its gradient."""
    own = features.astype(np.float64)
    mean, scale = own.mean(0), own.std(0)
    scale[scale == 0] = 1
    own = (own - mean) / scale
    start, end, before, after = beside(own, counts)
    x = np.hstack((own, before, after, start[:, None], end[:, None], np.ones((len(own), 1))))
    y = np.repeat(labels, counts).astype(float)
    share = 1 / np.repeat(counts, counts)  # every text weighs the same, however many lines it has
    chains = Chains(counts)
    inner = np.ones(len(y), bool)  # lines with a next line
    inner[np.cumsum(counts) - 1] = False
    here = np.flatnonzero(inner)
    p = np.zeros(x.shape[1] + 2)
    first, second = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        w, stay = p[:-2], p[-2:]
        e = x @ w
        m, b = chains.messages(e, stay)
        good = sigmoid(m + b)
        nxt = e[here + 1] + b[here + 1]
        joint = np.stack((np.full(len(here), stay[0]), m[here], nxt, m[here] + stay[1] + nxt))
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        grad = np.concatenate((x.T @ ((y - good) * share), [0, 0])) / len(counts)
        grad[-2] = (((1 - y[here]) - joint[0]) * share[here]).sum() / len(counts)
        grad[-1] = ((y[here] - joint[3]) * share[here]).sum() / len(counts)
        grad -= penalty * p
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        p += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, p[:-2], p[-2:])


def line_marginals(model: Model, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that each line is good; neighbours add their own weighted sums, so no wider table is made."""
    parts = ((features - model.mean.astype(np.float32)) / model.scale.astype(np.float32)) @ model.weights[: 3 * OWN].reshape(3, OWN).T
    start, end, before, after = beside(parts, counts)
    e = parts[:, 0] + before[:, 1] + after[:, 2] + start * model.weights[-3] + end * model.weights[-2] + model.weights[-1]
    m, b = Chains(counts).messages(e, model.stay)
    return sigmoid(m + b)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``CHUNK_BYTES``, a line counting as a hundred at least."""
    run, size = [], 0
    for t in texts:
        cost = len(t) + 100 * t.count("\n")
        if run and size + cost > CHUNK_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += cost
    if run:
        yield run


def text_scores(model: Model, texts: list[str]) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    out = []
    for run in chunks(texts):
        features, size, counts = line_features(run)
        weight = np.maximum(size, 1)
        at = np.concatenate(([0], np.cumsum(counts)[:-1]))
        out.append(np.add.reduceat(line_marginals(model, features, counts) * weight, at) / np.add.reduceat(weight, at))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, train_rows: Column | None = None) -> Model:
    """Fit on at most ``max_docs`` labelled documents; ``train_rows`` (on ``docs``) says which may be used."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_y"))
    may = docs.where(train_rows) if train_rows is not None else docs
    fitting = may.select(F.col(id_col).alias("_id")).where(F.length(F.coalesce(may[text], F.lit(""))) <= max_chars).distinct()
    chosen = stored(known.join(fitting, "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_docs), "chosen")  # at most max_docs rows
    bare = docs.select(F.col(id_col), F.col(text)).where(F.length(F.coalesce(F.col(text), F.lit(""))) <= max_chars)
    rows = bare.join(F.broadcast(chosen), bare[id_col] == chosen["_id"]).select("_id", "_y", F.col(text).alias("_text"))

    def make(texts: list[str]) -> tuple[None, list]:
        features, _, counts = line_features(texts)
        return None, [counts, [p.tobytes() for p in np.split(features, np.cumsum(counts)[:-1])]]

    got = map_texts(rows, F.col("_id").cast("string"), F.col("_text"), make, "n long, x binary", [F.col("_y").alias("y")]).toPandas().sort_values(["key", "x"], kind="stable")
    y = got["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(2), float(y.mean()) if len(y) else 0.5)
    features = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, OWN)
    return train(features, got["n"].to_numpy(), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score (probability of good, 0 to 1) and predicted (1 from 0.5) of every row."""

    made = map_texts(docs, F.col(id_col), F.col(text), lambda texts: (None, [text_scores(model, texts)]), "score double", [held_out(F.col(id_col)).alias("held_out")])
    return made.withColumnRenamed("key", id_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", floor: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``floor``, unchanged."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(text_scores(model, [t if isinstance(t, str) else "" for t in texts]), index=texts.index)

    return docs.where(quality(F.col(text)) >= floor)
