"""Packed counters against a plain run of every filter order."""

import random
import re
from itertools import permutations

from voxelspark.llm import filter_audit as fa


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, source, *_ in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        rows.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + lost
                only = sum(r[1] == {f} for r in left + gone)
                out[part, order, step] = [len(left), len(lost), redundant, only, sum(r[2] for r in lost), sum(r[3] for r in lost)]
                shapley[f] += len(lost)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", "x", "x") for d in docs], "doc_id long, text string, source string, mask string, part string, digest string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = fa.audit(df, lab).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_plain_run(spark, monkeypatch):
    monkeypatch.setattr(fa, "PARTS_HELD", 2)
    rng = random.Random(4)
    some = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [some(rng.choice([5, 150, 250, 400]), rng.choice([20, 5000])) + rng.choice(["", " A" * 40, " $5", "\n|"]) for _ in range(60)]
    docs = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)]
    docs += [(1000 + i, texts[0], "hot") for i in range(50)] + [(7, texts[7], "s0"), (None, texts[3], "s1"), (2000, None, None), (2001, "", ""), (2002, " É漢 " * 90_000, "s1"), (3, texts[3], "s3")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1050, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, None, None)], [])) == 600


def test_fields_never_overflow():
    width = fa.field_width(1000)
    for kind in range(fa.KINDS):
        whole = fa.unpacked(1000 * fa.packed(kind, width), width)
        assert (whole.ravel() == [1000 * held for held in fa.outcomes(kind)]).all()
