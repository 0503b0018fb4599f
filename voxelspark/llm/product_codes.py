"""Product codes of vectors; nearest codebook entries come from a GNAT over the entries.

Vectors become integers and are cut into consecutive parts. Each part position has a codebook of few entries; its tree
splits them between split points, and every split point keeps the range of its distances to the entries below every
other. A query that has measured a split point rules out whole subtrees: by the triangle inequality no entry below one
whose range misses the query's distance by more than the best so far can be nearer. Ranges and distances are rounded
outwards and a subtree goes only if all of it is strictly farther, so ties stay; winners are compared as integers, by
squared distance and then index. Trees are rebuilt each round; the sums of a round are one small row per entry.

Defined cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped, also those whose length
differs from the first kept vector's; a length that is no multiple of the parts is filled with zeros; null ids come
last in the order of ids, equal ids go by their vectors; fewer vectors than entries give as many entries; repeated rows
are coded each; sums beyond a long are null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SPLITS = 8  # split points of a node
LEAF = 10  # nodes of so few entries are compared one by one
NARROW = 1 << 28  # integers below it have squared distances that fit 64 bits; wider ones are Python integers
HALF = 40  # bits of the low half of a sum
BLOCK = 4096  # vectors coded at a time


@dataclass
class Node:
    """Split points (entry indices), the nodes below them, and low[i, j], high[i, j]: distances of point i to what is at j."""

    points: list[int]
    below: list["Node | None"] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    d = rows - entry
    return (d * d).sum(1)


def down(x: np.ndarray) -> np.ndarray:
    """A distance not above the root of the exact squares."""
    return np.sqrt(np.asarray(x, np.float64)) * (1 - 1e-12)


def up(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(x, np.float64)) * (1 + 1e-12)


def grow(book: np.ndarray, members: list[int]) -> Node | None:
    """The tree of some entries: split points far from each other, the rest below the nearest of them."""
    if not members:
        return None
    if len(members) <= LEAF:
        return Node(members)
    points = [members[0]]
    near = squared(book[members], book[points[0]])
    while len(points) < SPLITS and (near > 0).any():
        points.append(members[int(np.argmax(near))])
        near = np.minimum(near, squared(book[members], book[points[-1]]))
    rest = [m for m in members if m not in points]
    far = np.array([squared(book[rest], book[p]) for p in points]) if rest else np.zeros((len(points), 0), np.int64)
    side = far.argmin(0) if rest else np.zeros(0, np.int64)
    node = Node(points, [], np.full((len(points), len(points)), np.inf), np.full((len(points), len(points)), -np.inf))
    for j in range(len(points)):
        own = [m for m, s in zip(rest, side) if s == j]
        if len(points) == 1:  # all entries are equal: one more level would be the same again
            node.points, own = [*points, *own], []
        if own:
            node.low[:, j] = down(far[:, side == j].min(1))
            node.high[:, j] = up(far[:, side == j].max(1))
        node.below.append(grow(book, own))
    return node if node.below and len(points) > 1 else Node(node.points)


def nearest(rows: np.ndarray, book: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index, and the distances measured."""
    best = np.full(len(rows), -1, np.int64)
    least = np.zeros(len(rows), rows.dtype)
    measured = 0
    todo: list[tuple[Node, np.ndarray]] = [(tree, np.arange(len(rows)))]
    while todo:
        node, at = todo.pop()
        own = np.empty((len(node.points), len(at)))
        exact = []
        for i, p in enumerate(node.points):
            d = squared(rows[at], book[p])
            exact.append(d)
            measured += len(at)
            wins = (best[at] < 0) | (d < least[at]) | ((d == least[at]) & (p < best[at]))
            best[at[wins]], least[at[wins]] = p, d[wins]
        if not node.below:
            continue
        reach = up(least[at])
        alive = np.ones((len(node.below), len(at)), bool)
        for d, low, high in zip(exact, node.low, node.high):
            lo, hi = down(d) - reach, up(d) + reach
            alive &= ~((lo * (1 - 1e-12) > high[:, None]) | (hi * (1 + 1e-12) < low[:, None]))
        for child, keep in zip(node.below, alive):
            if child is not None and keep.any():
                todo.append((child, at[keep]))
    return best, least, measured


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers: 64-bit integers, or Python integers if one is wide."""
    if not len(values) or np.abs(values).max() * scale < NARROW:
        return np.floor(values * scale).astype(np.int64)
    exact = [x.as_integer_ratio() for x in values.ravel().tolist()]
    return np.array([scale * a // b for a, b in exact], object).reshape(values.shape)


def kept(vectors: DataFrame, vec: str) -> DataFrame:
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.coalesce((F.size(x) > 0) & finite, F.lit(False)))


def blocks(batches: Iterable[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as integers, (rows, parts, numbers of a part)."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, BLOCK):
            batch = whole_batch.slice(at, BLOCK)
            flat = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            x = whole(flat)
            if fill := -width % parts:
                x = np.concatenate([x, np.zeros((len(x), fill), x.dtype)], 1)
            yield batch, x.reshape(len(x), parts, -1)


class Codebooks:
    """Entries of all part positions, (parts, entries, numbers of a part), and their trees."""

    def __init__(self, books: np.ndarray):
        wide = books.dtype == object and any(abs(v) >= NARROW for v in books.ravel())
        self.books = books if wide else books.astype(np.int64)
        self.trees = [grow(b, list(range(len(b)))) for b in self.books]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Codes and squared distances, (rows, parts); and the distances measured."""
        books = self.books.astype(object) if x.dtype == object else self.books
        x = x.astype(object) if books.dtype == object else x
        found = [nearest(x[:, p], books[p], self.trees[p]) for p in range(len(books))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), sum(f[2] for f in found)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.books.ravel()).encode()).hexdigest()


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; at most ``entries`` rows reach the driver."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    x = whole(np.array([r["vec"] for r in first], np.float64).reshape(len(first), width))
    if fill := -width % parts:
        x = np.concatenate([x, np.zeros((len(x), fill), x.dtype)], 1)
    return Codebooks(x.reshape(len(first), parts, -1).transpose(1, 0, 2))


def moved(rows: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts. A task sends one row per number of an entry."""
    parts, entries, size = books.books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), object)
        for _, x in blocks(batches, width, parts):
            codes, _, _ = books.assign(x)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                part = np.zeros((entries, size), x.dtype)
                np.add.at(part, codes[:, p], x[:, p])
                sums[p] += part.astype(object)
        p, e = np.nonzero(count)
        total = sums[p, e].ravel()  # exact integers of any size: as a high and a low half in two longs
        at = [np.repeat(c, size) for c in (p, e, count[p, e])]
        halves = [pa.array([v >> HALF for v in total], pa.int64()), pa.array([v & (1 << HALF) - 1 for v in total], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(np.tile(np.arange(size), len(p))), pa.array(at[2]), *halves], ["part", "entry", "place", "n", "high", "low"])

    made = rows.select("vec").mapInArrow(run, "part long, entry long, place long, n long, high long, low long")
    new = books.books.astype(object)
    for r in made.groupBy("part", "entry", "place").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect():
        new[r["part"], r["entry"], r["place"]] = ((r["high"] << HALF) + r["low"]) // r["n"]
    return Codebooks(new)


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_books(rows, width, parts, entries)
    for _ in range(rounds):
        books = moved(rows, books, width)
    return books


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def encode(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every kept row."""
    good = kept(vectors, vec).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    first = good.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).limit(1).collect()
    width = first[0]["n"] if first else 0
    rows = stored(good.where(F.size("vec") == width), "vectors")
    books = train(rows, width, parts, entries, rounds) if width else Codebooks(np.zeros((parts, 1, 0), np.int64))
    hexes = np.array([f"{i:02x}" for i in range(max(entries, 1))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, width, parts):
            codes, far, _ = books.assign(x)
            errors = [_long(int(v)) for v in far.astype(object).sum(1)] if far.dtype == object else far.sum(1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(["".join(c) for c in hexes[codes]], pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = stored(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.expr("CASE WHEN count(error) = count(*) THEN try_cast(sum(cast(error as decimal(38,0))) as long) END").alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
