"""Template removal on hosts with a hot group of copies."""

from voxelspark.llm import template_removal


def test_copies_of_a_page_are_no_template(spark):
    page = lambda k: f"<html><body><article><p>First part of page {k}.</p><p>Second part of page {k}.</p></article><div>Shared foot</div></body></html>"
    rows = [(i, "https://a.org/hot", page("hot")) for i in range(40)] + [(100 + i, f"https://a.org/{i}", page(i)) for i in range(20)]
    got = template_removal.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got if r["page_id"] < 40} == {"First part of page hot.\nSecond part of page hot."}
    assert len(got) == 60 and not any("foot" in r["text"] for r in got)


def test_bulk_of_an_article_stays(spark):
    body = "<p>A long passage that most pages of this host repeat word by word, all of it.</p>"
    rows = [(i, f"https://b.org/{i}", f"<body><article>{body}<p>No {i}</p></article></body>") for i in range(30)]
    got = template_removal.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("long passage" in r["text"] and f"No {r['page_id']}" in r["text"] for r in got)
