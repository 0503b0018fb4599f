"""Chunked encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelspark.llm import chunked_bpe as cb
from voxelspark.llm.common import stored


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


PIECES = ["word ", "Ünïcode 漢字 ", "it's we'll ", "  ", "\n\n\t", " 12 345", "😀", "　 ", "<|endoftext|>", "<|endof", "'", "r", "'s", "a b ", "$%& ", "x" * 40, " " * 70, "\r\n"]


def soup(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


def test_any_cut_is_repaired(reference):
    rng, coder = random.Random(8), cb.codec()
    for _ in range(400):
        text = soup(rng, rng.randrange(1, 60))
        raw, want = text.encode(), reference(text)
        edges = sorted({0, len(raw), *[rng.randrange(len(raw) + 1) for _ in range(rng.randrange(8))]})
        edges = [e for e in edges if e == len(raw) or raw[e] & 0xC0 != 0x80]
        spans = list(zip(edges, edges[1:]))
        shared = [(a, b - a, coder.encode(raw[a:b].decode())) for a, b in spans if rng.random() < 0.6]
        assert cb.assembled(raw, shared, coder).tolist() == want
        assert coder.decode(np.array(want)) == raw


def test_cuts_follow_content_and_characters():
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(4000)).encode()
    a, b = cb.cuts(passage), cb.cuts(b"other start " * 50 + passage)
    shift = len(b) and len(b"other start " * 50)
    assert len(set(a) & {e - shift for e in b}) > 0.8 * len(a)
    text = ("漢字😀é" * 9000).encode()
    ends = cb.cuts(text)
    assert ends[-1] == len(text) and b"".join(text[x:y] for x, y in zip([0, *ends], ends)) == text
    assert max(np.diff([0, *ends])) <= cb.MOST
    for x, y in zip([0, *ends], ends):
        text[x:y].decode()
    assert cb.cuts(b"") == [] and cb.cuts(b"a") == [1]


def test_round_trip_against_the_library(spark, docs, texts, reference):
    rng = random.Random(10)
    shared = " ".join(f"s{rng.randrange(700)}" for _ in range(1500))
    more = [f"start {i} " + shared + f" end {i}" for i in range(12)] + [shared[7:] + soup(rng, 50), soup(rng, 300), "<|endoftext|>", " " * 5000 + "x", "\n" * 3000]
    df = docs.unionByName(spark.createDataFrame([(50_000 + i, t, "en", "s", 0, *["x"] * 6) for i, t in enumerate(more)], docs.schema))
    got = cb.round_trip(df).collect()
    want = {t: (len(ids), sha(",".join(map(str, ids))), sha(t)) for t in {r["text"] or "" for r in df.collect()} for ids in [reference(t)]}
    rows = {(r["doc_id"], r["text"] or "") for r in df.collect()}
    assert len(got) == df.count()
    assert {(r["doc_id"], *tuple(r)[1:]) for r in got} == {(i, *want[t]) for i, t in rows}
    marks = stored(cb.marked(df, "doc_id", "text"), "marks")
    repeated, encoded = cb.shared_ids(df, stored(cb.occurrences(marks), "occ"), "text", None)
    assert encoded.count() == repeated.count() == encoded.select("chunk").distinct().count() > 5  # each shared chunk once


def test_long_white_space(spark, reference):
    long = [" " * 2_000_000 + "word", "\n" * 1_000_000 + "word", "\t \n" * 500_000 + "word tail", "w " * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    for r in cb.encode(df, keep_ids=True).collect():
        assert np.frombuffer(r["ids"], np.uint16).tolist() == reference(long[r["doc_id"]]) and r["decoded"] == long[r["doc_id"]]


def test_empty_table(spark, empty):
    assert cb.round_trip(empty).count() == 0
