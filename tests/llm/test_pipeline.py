"""The pipeline against its stages done by brute force, and the registration of all queries."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from voxelspark.llm import crf, packing
from voxelspark.llm.common import load

from test_near_copies import near_groups, windows

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_against_brute_force(spark):
    docs = load(spark, SF, "documents")
    model = crf.fit(docs, load(spark, SF, "labels"), train_rows=~crf.held_out(docs["doc_id"]))
    rows = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    kept = sorted(r["doc_id"] for r in crf.score(docs, model).where("predicted = 1").collect())
    kept = sorted(set(near_groups({d: windows(rows[d]) for d in kept}).values()))
    seen, left = {}, {}
    for d in kept:
        b = rows[d].encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) != d:
                gone[i : i + 50] = [True] * 50
        left[d] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = set()
    for r in load(spark, SF, "benchmark").collect():
        w = words(r["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = {d: t for d, t in left.items() if not any(tuple(w[i : i + 10]) in grams for w in [words(t)] for i in range(len(w) - 9))}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    vocabulary = packing.default_vocabulary()
    assert got == {d: len(packing.token_ids(t, *vocabulary)) for d, t in clean.items()}
    assert 0 < len(clean) < len(left) < len(rows)
