"""Packing, sharding, archives, page text and URL rules: brute force, round trips and degenerate cases."""

import hashlib
import zlib

import numpy as np
import pytest

from voxelspark.llm import hilbert, packing, template_removal, url_rules, warc
from voxelspark.llm.common import shared_folder


def test_very_long_white_space_is_encoded():
    """White space that the pattern engine refuses: blanks, tabs, line breaks and mixtures of 2 MB."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for run in (" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, " \n\t\r" * 500_000):
        text = f"start{run}word and end"
        assert packing.token_ids(text, *packing.default_vocabulary()).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_token_ids_equal_the_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary = packing.default_vocabulary()
    for t in [*texts[:60], "a<|endoftext|>b", "  two  spaces \n\n x\x1c y ", "'s 'll don't"]:
        assert packing.token_ids(t, *vocabulary).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]


def test_packing_is_gapless_and_tight(docs, empty):
    packed = packing.pack(packing.pieces(docs, keep_ids=True), group_rows=40)
    rows = packed.collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        if r["doc_id"] not in (None, 6):
            by_doc.setdefault(r["doc_id"], []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    ids = {d["doc_id"]: packing.token_ids(d["text"] or "", *packing.default_vocabulary()) for d in docs.collect()}
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in parts]).tolist() == ids[d].tolist()
        assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts]])[:-1].tolist()
        assert all(r["length"] == 2048 for r in parts[1:])
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert all(whole[k] == b"".join(bytes(r["ids"]) for r in sorted(s, key=lambda r: r["offset"])) for k, s in by_sequence.items())
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_sum_of_squares_near_the_bound():
    sizes = np.random.default_rng(2).integers(1, 2048, 4000)
    bins, offsets = packing.place(sizes)
    assert len(set(bins)) <= 1.01 * max(-(-sizes.sum() // 2048), (sizes > 1024).sum())
    assert packing.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cuts(2048) == [(0, 2048)]


def test_curve_visits_every_cell_once():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    index = hilbert.curve_index(cells, 3)
    assert sorted(index) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_shards_are_equal_runs_of_the_curve(docs, empty, monkeypatch):
    monkeypatch.setattr(hilbert, "RUN_ROWS", 17)
    rows = hilbert.assign(docs).collect()
    n = docs.count()
    assert len(rows) == n
    counts = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and {len(c) for c in counts} <= {n // 8, n // 8 + 1}
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)
    want = sorted((len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert hilbert.assign(empty).count() == 0


def test_strings_are_cut_by_the_rank_of_whole_values(spark, monkeypatch):
    """Values that share a long prefix, some of them hot: the cell is the share of rows below the value."""
    monkeypatch.setattr(hilbert, "RUN_ROWS", 7)
    values = [f"https://www.example.org/{i:03d}" for i in range(40) for _ in range(1 + 9 * (i % 5 == 0))] + ["", "Z", "é"]
    df = spark.createDataFrame([(v, "x") for v in values] + [(None, "x")], "source string, _cell string")
    got = {r["_v"]: r["_cell"] for r in hilbert.string_cells(df.select("source"), "source", 4).collect()}
    assert got == {v: sum(w.encode() < v.encode() for w in values) * 16 // len(values) for v in values}
    rows = hilbert.with_index(df.select("source"), ["source"], "c", 4).collect()
    assert {r["source"]: r["c"] for r in rows} == {**{v: int(c) for v, c in got.items()}, None: 0}


def test_shard_files_narrow_the_dimensions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = shared_folder(spark, "shards")
    hilbert.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count()
    spread = back.groupBy("shard").agg({"source": "approx_count_distinct"}).collect()
    assert sum(r[1] for r in spread) < 8 * docs.select("source").distinct().count()


@pytest.fixture(scope="module")
def pages(spark):
    nav = "<nav><a href='/x'>Menu</a></nav><div><p>Site wide  slogan</p></div>"
    rows = []
    for i in range(30):
        rows.append((i, f"http://a.com/p/{i}?q={i}", f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{nav}<section><p>Text {i} &amp; more<p>second{i}<b>bold</b> part<br></section><div class='side comments'>no</div><footer>f</footer></body>"))
    big = "<article><h1>Same</h1><p>" + "word " * 300 + "</p></article>"
    rows += [(100, "https://b.org/x", big), (101, "https://b.org/y", big), (102, None, big), (103, "nothing", None), (104, "http://c.com", ""), (None, "http://c.com", big), (105, "http://c.com", "<p>&#233;<p>x <![CDATA[y]]> <unclosed")]
    rows += [(9_007_199_254_740_993, "http://d.com/" + "é" * 10, "<p>short</p>")] * 2
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, key string, host string").repartition(3).cache()


def test_templates_go_and_text_stays(spark, pages):
    got = {r["page_id"]: r for r in template_removal.extract(pages).collect()}
    assert got[3]["text"] == "Text 3 & more\nsecond3bold part" and got[3]["n_chars"] == 30
    assert got[100]["text"].startswith("Same\nword word") and got[103]["text"] == "" == got[104]["text"]
    assert got[105]["text"].startswith("é\nx")
    assert template_removal.extract(pages).count() == pages.count()
    assert template_removal.extract(pages.limit(0)).count() == 0
    few = {r["page_id"]: r for r in template_removal.extract(pages, least=100).collect()}
    assert few[3]["text"].startswith("Site wide slogan\n")


def test_archives_give_back_every_record(spark, pages):
    folder = shared_folder(spark, "warc")
    index = warc.write(pages, folder, frame_bytes=2000)
    back = {r["record_id"]: r for r in warc.read(index, folder).collect()}
    assert back["urn:page:102"]["record_type"] == "response" and back["urn:page:100"]["refers_to"] == "urn:page:102"
    body = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for page, raw in body.items():
        r = back.get(f"urn:page:{page}")
        if page is not None:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
            assert r["payload"] is None or bytes(r["payload"]) == raw
    one = warc.read(index.where("record_id = 'urn:page:7'"), folder).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == body[7]
    digest = warc.round_trip(pages).collect()
    assert len(digest) == pages.count()
    assert sorted(str(r["page_id"]) for r in digest) == sorted(str(r["page_id"]) for r in pages.collect())
    assert [r["record_type"] for r in digest if r["page_id"] is None] == ["revisit"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pages_above_a_frame_and_an_archive(spark, monkeypatch):
    """Pages larger than a frame, an archive and what is passed on at once come back whole, with payloads or without."""
    for name, size in (("ARCHIVE_BYTES", 20_000), ("RUN_FRAMES", 2), ("PASS_BYTES", 50_000)):
        monkeypatch.setattr(warc, name, size)
    rng = np.random.default_rng(4)
    bodies = {i: "".join(map(chr, rng.integers(97, 123, 2_000 * (1 + 20 * (i % 4 == 0))))) for i in range(24)}
    pages = spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in bodies.items()], "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark, "warc")
    index = warc.write(pages, folder, frame_bytes=5_000)
    assert index.select("archive").distinct().count() > 1
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read(index, folder).collect()}
    assert got == {f"urn:page:{i}": b for i, b in bodies.items()}
    bare = warc.read(index, folder, payloads=False)
    assert "payload" not in bare.columns and {r["payload_bytes"] for r in bare.collect()} == {len(b) for b in bodies.values()}


def test_long_rules_unknown_labels_and_mostly_bad_tables(spark):
    """A family told only by four tokens together, labels without a word, and a table with nine bad pages of ten."""
    words = ["aa", "bb", "cc", "dd"]
    rows = [(i, "http://h.net/" + "/".join(w for k, w in enumerate(words) if k != i % 5) + f"/u{'xyz'[i % 3]}") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    four = lambda i: i % 5 == 4
    labels = spark.createDataFrame([(i, int(not four(i)), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge(pages, labels).collect()}
    assert all(got[i]["verdict"] == ("block" if four(i) else "allow") for i in range(500))
    assert len(got[4]["mined_rule"].split()) >= 4
    unknown = spark.createDataFrame([(i, None, None if i % 2 else 1) for i in range(400)], "doc_id long, quality int, toxic int")
    assert url_rules.judge(pages, unknown).where("mined_rule IS NOT NULL").count() == 0  # bad ones only, the rest unknown
    mostly = [(i, f"http://{'spam' if i % 10 else 'fine'}.org/p/{i}") for i in range(300)]
    bad = spark.createDataFrame([(i, int(i % 10 == 0), None) for i in range(300)], "doc_id long, quality int, toxic int")
    found = url_rules.judge(spark.createDataFrame(mostly, "page_id long, url string"), bad, rules=[])
    assert {(r["host"], r["verdict"]) for r in found.collect()} == {("spam.org", "block"), ("fine.org", "allow")}


def test_given_rules_and_mined_rules(spark):
    urls = ["http://Example.ORG/es/1", "http://www.example.org/en/12?x#y", "http://example.org/en/2", "ftp://x.com/fr/", "http://a.com/de/z", "http://u@b.net", None, "no scheme", "http://com/fr/#/de/", "http://notexample.org/es/", "http://h.com?/fr/"]
    rows = [(i, u) for i, u in enumerate(urls)]
    rows += [(100 + i, f"http://{'cheap-pills' if i % 2 else 'good'}.net/a/{i}") for i in range(80)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(100 + i, int(not i % 2), 0) for i in range(60)] + [(None, 0, 0), (101, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge(pages, labels).collect()}
    assert len(got) == len(rows)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(11)] == [
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("www.example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("a.com", "/de/z", "com/de/", "block"),
        ("u@b.net", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("com", "/fr/", "com/fr/", "allow"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("h.com", "", None, "allow"),
    ]
    assert all(got[100 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(80))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_rules.judge(pages, none).where("mined_rule IS NOT NULL").count() == 0
    assert url_rules.judge(pages.limit(0), labels).count() == 0
