"""Line frequency, decontamination, classifier: brute force and degenerate cases."""

import hashlib
import re
import zlib

import numpy as np

from voxelspark.llm import crf, decontaminate, line_frequency

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_line_counts_against_brute_force(docs):
    rows = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in line_frequency.score(docs, limit=3, share=0.05).collect()}
    for d in docs.collect():
        t = d["text"] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 2000 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = rows[(d["doc_id"], len(w), sum(map(len, w)))]
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if len(w) < 2000:
            assert r["n_repeat_words"] == len(twice)
            assert r["base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert line_frequency.score(docs).count() == docs.count()


def test_frequent_lines_reject_and_strip(spark, empty):
    body = [(i, f"common footer of the site\nunique{i} words here and there for text {i} " + " ".join(f"more{k}" for k in range(0 if i % 2 else 9)), "en", "s", 0) for i in range(40)]
    rows = [*body, *[(100 + i, "common footer of the site\nshort end with eight words in here now", "en", "s", 0) for i in range(1)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in line_frequency.score(df, limit=8).collect()}
    assert all(got[i]["n_frequent_words"] == 5 and got[i]["kept"] for i in range(0, 40, 2))
    assert not got[100]["kept"] and not got[100]["base_failed"]
    stripped = line_frequency.strip(df, limit=8).collect()
    assert len(stripped) == len(rows) and not any("footer" in r["text"] for r in stripped)
    assert line_frequency.score(empty).count() == 0


def test_line_limit_does_not_follow_the_size_of_a_host(spark):
    """A line on 11 texts is frequent on a host of 11, 100 and 3,000 texts; one on 10 never is; small hosts have less."""
    tail = "\n".join(f"own line {k} of this text with several words in it" for k in range(3))
    for n, holders, frequent in [(3000, 11, True), (100, 11, True), (3000, 10, False), (20, 4, True), (20, 3, False)]:
        rows = [(i, ("the very same line\n" if i < holders else "") + tail.replace("this", f"this{i}"), "s") for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r["doc_id"]: r["n_frequent_words"] for r in line_frequency.score(df).collect()}
        assert all(v == (4 if frequent and i < holders else 0) for i, v in got.items()), (n, holders)


def test_decontamination_against_brute_force(spark, docs, texts, empty):
    passage = texts[-10].split("\n")[1]
    items = [(1, passage), (2, "Not, in: any text at all " * 4), (10, texts[3].split("\n")[0]), (4, "a B c"), (5, None), (6, "--"), (None, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.score(docs, bench).collect()
    want = []
    for d in docs.collect():
        w = TOKEN.findall(lower(d["text"] or ""))
        hit, ids = set(), set()
        for item, t in items:
            iw = TOKEN.findall(lower(t or ""))
            k = min(10, len(iw))
            grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    ids |= {str(item)} - {"None"}
        want.append((d["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r["contaminated"] for r in got) >= 7
    assert decontaminate.remove(docs, bench).count() == sum(not w[5] for w in want)
    cut = decontaminate.remove(docs, bench, mode="spans").collect()
    assert len(cut) == len(want) and cut[0].asDict().keys() == docs.first().asDict().keys()
    assert not any(passage in (r["text"] or "") for r in cut)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.score(docs, none).where("contaminated").count() == 0
    assert decontaminate.score(empty, bench).count() == 0


def test_chain_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    e, stay = rng.normal(size=8), np.array([0.7, 1.3])
    m, b = crf.Chains(counts).messages(e, stay)
    got = crf.sigmoid(m + b)
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weight = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(stay[y[i]] for i in range(n - 1) if y[i] == y[i + 1]))
            total += weight
            good += weight * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_classifier_learns_held_out_labels(spark, docs, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = crf.fit(df, labels, train_rows=~crf.held_out(df["doc_id"]))
    rows = crf.score(df, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows) > 50
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    scored = crf.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["doc_id"] for r in scored} >= {None, 9_007_199_254_740_993}
    assert crf.keep_good(docs, model).columns == docs.columns
    assert crf.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in crf.score(docs, crf.fit(docs, none)).collect()} == {0.5}
