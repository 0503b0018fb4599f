"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random
import re

import corpus_pipeline
import pytest

from voxelspark.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def windows(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_groups(sets):
    """The least key of each key's group, by comparing all pairs."""
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if root(i) != root(j) and 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= 0.8:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return {k: root(k) for k in keys}


def planted(rng):
    """Strangers, a near copy of each from slightly above to slightly below the limit, and a crowd of near copies."""
    texts = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))] for _ in range(300)]
    crowd = [f"c{rng.randrange(3000)}" for _ in range(300)]
    near = []
    for t in [*texts, *[crowd] * 60]:
        t = list(t)
        for _ in range(rng.randrange(1, max(2, len(t) // 30))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        near.append(t)
    return [" ".join(t) for t in [*texts, crowd, *near]] + ["", None, "one", "ONE", "a b c"]


def test_stage_finds_near_copies_and_drops_no_other(spark):
    texts = planted(random.Random(11))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    label = near_groups(dict(enumerate(map(windows, texts))))
    want = set(label.values())
    assert want <= kept  # only verified near copies go
    assert len(texts) - len(want) > 200 and len(kept - want) <= 0.03 * (len(texts) - len(want))


@pytest.mark.parametrize("number", [400, 4000])
def test_recall_by_similarity_at_two_sizes(spark, number):
    """Pairs planted at Jaccard 0.80 to 0.95 among strangers; what a pair meets doesn't depend on how many sets there are."""
    rng = random.Random(number)
    texts, level = [], {}
    for i in range(number):
        t = [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(80, 200))]
        texts.append(t)
        if i < 300:
            copy, goal = list(t), rng.choice([0.80, 0.85, 0.90, 0.95])
            while jaccard(windows(" ".join(t)), windows(" ".join(copy))) > goal + 0.02:
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if (j := jaccard(windows(" ".join(t)), windows(" ".join(copy)))) >= 0.8:
                level[number + i] = (i, j)
            texts.append(copy)
    order = [t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(order)], SCHEMA)
    first = {}
    for r in near_copies.groups(docs).collect():
        first.setdefault(r["root"], []).append(r["_id"])
    together = {frozenset(v) for v in first.values() if len(v) > 1}
    pairs = [frozenset((i, i + 1)) for i in range(0, 600, 2)]
    close = [p for p in pairs if jaccard(*[windows(" ".join(order[i])) for i in p]) >= 0.8]
    assert len(close) > 200 and together <= set(close)
    assert len(together) >= 0.97 * len(close)


def test_a_crowd_costs_linear_comparisons(spark, monkeypatch):
    """Near copies of one text: every set is compared once or twice, not with all others."""
    compared = []
    plain = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    rng = random.Random(3)
    base = [f"c{rng.randrange(9000)}" for _ in range(400)]
    rows = []
    for i in range(600):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t), "en", "s", 0))
    out = near_copies.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert [r["doc_id"] for r in out.collect()] == [0]
    assert sum(compared) < 5 * 600


@pytest.mark.parametrize("block", [512, 40])
def test_near_copies_inside_a_crowd_of_texts_below_the_limit_are_found(spark, monkeypatch, block):
    """Texts of one origin just below the limit meet each other; the one near copy that some of them have is still found."""
    monkeypatch.setattr(near_copies, "BLOCK_SETS", block, raising=False)
    rng = random.Random(8)
    base = [f"c{rng.randrange(9000)}" for _ in range(600)]
    texts, pairs = [], []
    for i in range(150):
        t = list(base)
        for at in rng.sample(range(0, 600, 5), 9):
            t[at] = f"x{rng.randrange(10**7)}"
        texts.append(t)
        if i % 3 == 0:
            copy = list(t)
            for at in rng.sample(range(0, 600, 5), 8):
                copy[at] = f"y{rng.randrange(10**7)}"
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(copy)
    sets = dict(enumerate(windows(" ".join(t)) for t in texts))
    want = near_groups(sets)
    assert max(list(want.values()).count(g) for g in set(want.values())) < 10 and len(set(want.values())) < 155
    got = {}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    for r in near_copies.groups(docs).collect():
        got.setdefault(r["root"], []).append(r["_id"])
    label = {i: min(v) for v in got.values() for i in v}
    assert all(want[a] == want[b] and label[a] == label[b] for a, b in pairs)
    assert all(want[r] == want[i] for v in got.values() for r in v for i in v)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text + " end"
    names = "doc_id long, text string, node string, _h string, _id string, u string, slice string, windows string"
    rows = [(None, text), (3, near), (3, near), (5, text), (None, None), (None, ""), (9, "other words"), (9, "other words")]
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], names)
    out = near_copies.deduplicate(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:5]) for r in out.collect()))
    assert got == [(False, 3, "w0 w1"), (False, 9, "other"), (True, 0, "")]


def test_stage_on_an_empty_table(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
