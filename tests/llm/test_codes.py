"""Product codes against brute force, and the tree's pruning."""

import hashlib
import math
import random

import numpy as np
import pytest

from voxelspark.llm import product_codes as pc

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec string, code string, error string"


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract word by word, with Python integers."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**50 else 256 * int(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(best(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    label_error = {}
    for (_, _, label), e in zip(kept, errors):
        label_error[label] = label_error.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, label_error[label], sha) for (i, _, label), f, e in zip(kept, found, errors))


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in pc.encode(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors(n, seed=3, scale=1.0, width=64):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(12)]
    draw = lambda: [float(np.float32(c + rng.gauss(0, scale / 5))) for c in rng.choice(centres)]
    return [(i * 7 % (n * 10), draw(), rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(300)
    rows += [(9000 + i, list(rows[5][1]), 1) for i in range(80)]  # one hot vector
    rows += [(9100, None, 1), (9101, [None] * 64, 1), (9102, [float("nan")] * 64, 2), (9103, [float("inf")] * 64, None)]
    assert made(spark, rows) == plain(rows)


def test_few_equal_and_wide_vectors(spark):
    few = vectors(5)
    assert made(spark, few) == plain(few)
    equal = [(i, [0.5] * 64, 0) for i in range(100)]
    assert made(spark, equal) == plain(equal)
    wide = vectors(90, scale=1e6)
    assert made(spark, wide) == plain(wide)
    beyond = vectors(90, scale=3e9)  # sums that no long holds are null
    assert [(r[0], r[1], r[4]) for r in made(spark, beyond)] == [(r[0], r[1], r[4]) for r in plain(beyond)] and None in {r[3] for r in made(spark, beyond)}


def test_empty_and_other_lengths(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, None, 0)]) == [] and made(spark, [(1, [], 0)]) == []
    odd = [(i, [0.1 * i] * 10, 0) for i in range(5)]
    got = made(spark, [*odd, (7, [1.0] * 3, 0)])
    assert [r[0] for r in got] == [0, 1, 2, 3, 4] and all(len(r[1]) == 32 for r in got)


def test_rows_with_null_ids_and_repeats(spark):
    rows = vectors(100)
    got = pc.encode(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in [*rows, rows[0], (None, rows[1][1], 0)]], SCHEMA))
    assert got.count() == 102 and got.where("vec_id is null").count() == 1


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_tree_prunes_and_stays_exact(spread):
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (8, 4))
    book = (centres[np.arange(64) % 8] + rng.normal(0, 100 * spread, (64, 4))).astype(np.int64)
    book[40] = book[3]  # a tie
    rows = np.concatenate([(centres[rng.integers(0, 8, 3000)] + rng.normal(0, 100 * spread, (3000, 4))).astype(np.int64), book])
    code, far, measured = pc.nearest(rows, book, pc.grow(book, list(range(64))))
    d = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (far == d.min(1)).all()
    assert measured < 0.6 * d.size  # subtrees were ruled out


def test_tree_on_ties_and_touching_ranges():
    rng = np.random.default_rng(2)
    for _ in range(60):
        book = rng.integers(-2, 3, (rng.integers(1, 65), rng.integers(1, 4)))
        rows = rng.integers(-3, 4, (200, book.shape[1]))
        code, far, _ = pc.nearest(rows, book, pc.grow(book, list(range(len(book)))))
        d = ((rows[:, None] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (far == d.min(1)).all()
