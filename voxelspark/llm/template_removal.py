"""Main text of web pages with per-host removal of recurring element subtrees.

Every block element's subtree with text is hashed (tag, text and child subtrees). Spark counts the pages per host
that hold a hash; subtrees on more than ``share`` of a host's pages (and on more than ``least``) are its
template and are deleted, as are elements whose tag, role or class names mark them as page furniture.
As each template is on a fixed share of its host's pages, a host has at most (elements per page / share)
of them, which bounds the list that travels with a page.

Defined cases: null or empty html gives an empty text; a null url has the host ''; copies of a page on
a host count once; an article or main element is never a template, and templates that hold more than half of its text stay; pages without an article or main element use the body; unclosed and misnested tags are closed
by their parents; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, stored
from .url_rules import host_path

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style noscript template head title nav header footer aside form button select textarea iframe svg math canvas object audio video dialog menu".split())
BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr fieldset center".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table div section article main body html blockquote".split())
FURNITURE = set(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent notice notices nav navigation navbar menu breadcrumb breadcrumbs header masthead footer sidebar aside related share sharing social comment comments disqus newsletter subscribe signup popup modal widget pagination".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "main", "size")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.hash, self.main, self.size = tag, attrs, [], None, False, 0


class Tree(HTMLParser):
    """Builds nodes; a start tag closes the open elements that it can't be inside of."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in SKIP:
            self.close_until({"p"}, SCOPE)
        if tag in CLOSES:
            self.close_until(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def close_until(self, tags, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    parser = Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(node, entered) in page order, each element on the way in and out; no recursion, so depth is free."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, entered = stack.pop()
        yield node, entered
        if entered:
            stack.append((node, False))
            stack += [(c, True) for c in reversed(node.children) if isinstance(c, Node)]


def is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main"


def names(node: Node) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))


def furniture(node: Node) -> bool:
    return node.tag in SKIP or node.attrs.get("role", "").lower() in ROLES or "hidden" in node.attrs or bool(names(node) & FURNITURE)


def mark(root: Node) -> list[int]:
    """Set each element's hash (None without text) and whether it holds main content; return the distinct hashes."""
    found = set()
    for node, entered in walk(root):
        if entered:
            continue
        parts = []
        for c in node.children:
            if isinstance(c, str):
                parts.append(" ".join(c.split()))
                node.size += len(parts[-1])
            else:
                node.main |= c.main or (is_main(c) and not furniture_name(c))
                parts.append("" if c.hash is None else str(c.hash))
                node.size += c.size
        text = "\x00".join(p for p in parts if p)
        if text:
            node.hash = int.from_bytes(hashlib.blake2b(f"{node.tag}\x01{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            if node.tag in BLOCK and node.tag not in ("html", "body") and not is_main(node):
                found.add(node.hash)
    return sorted(found)


def furniture_name(node: Node) -> bool:
    return bool(names(node) & FURNITURE)


def bulky(root: Node, templates: set[int]) -> bool:
    """Whether the templates hold more than half of the text of the main elements."""
    total = gone = 0
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if inside and node.tag in BLOCK and node.hash in templates and not node.main:
            gone += node.size
            continue
        if not inside and is_main(node) and not furniture_name(node):
            total, inside = total + node.size, True
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]
    return 2 * gone > total


def main_text(html: str | None, templates: set[int]) -> str:
    """Text of the main blocks, one line each."""
    root = tree(html)
    mark(root)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    only_main = root.main
    keep_all = only_main and bulky(root, templates)
    stack: list[tuple[Node | str, bool, bool]] = [(root, True, not only_main)]
    while stack:
        node, entered, inside = stack.pop()
        if isinstance(node, str):
            if inside:
                line.append(node)
            continue
        if not entered:
            if node.tag in BLOCK:
                end()
            continue
        if node.tag in BLOCK and node.hash in templates and not node.main and not (keep_all and inside):
            end()
            continue
        if not node.main and node.tag not in ("", "html", "body") and furniture(node) and not (is_main(node) and not furniture_name(node)):
            continue
        if node.tag == "br":
            line.append(" ")
        if node.tag in BLOCK:
            end()
        inside = inside or (is_main(node) and not furniture_name(node))
        stack.append((node, False, inside))
        stack += [(c, True, inside) for c in reversed(node.children)]
    end()
    return "\n".join(blocks)


def template_table(pages: DataFrame, url: str = "url", html: str = "html", share: float = 0.5, least: int = 10) -> DataFrame:
    """host and its template hashes (an array)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "b1": batch["b1"], "b2": batch["b2"], "hashes": [mark(tree(h if isinstance(h, str) else None)) for h in batch["html"]]})

    rows = pages.select(host_path(F.col(url))[0].alias("host"), F.col(html).alias("html"), F.xxhash64(html).alias("b1"), F.hash(html).alias("b2")).mapInPandas(run, "host string, b1 long, b2 int, hashes array<long>")
    rows = rows.groupBy("host", "b1", "b2").agg(F.first("hashes").alias("hashes"))  # copies of a page count once
    # A null hash stands for the page itself, so one aggregate counts both pages and hashes.
    counts = rows.select("host", F.explode(F.array_append("hashes", F.lit(None).cast("long"))).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where((F.col("n") > least) | F.col("hash").isNull()), "subtrees")
    totals = counts.where("hash IS NULL").select("host", F.col("n").alias("_all"))
    found = counts.where("hash IS NOT NULL").join(totals, "host").where(F.col("n") > share * F.col("_all"))
    return found.groupBy("host").agg(F.collect_set("hash").alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", share: float = 0.5, least: int = 10) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    templates = stored(template_table(pages, url, html, share, least), "templates")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_path(F.col(url))[0].alias("host"))
    rows = rows.join(broadcast_if_small(templates), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist())
            texts = pa.array([main_text(h, set(t or ())) for h, t in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), texts], ["key", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("key", "url", "html", "templates").mapInArrow(run, f"key {kind}, url string, text string")
    return out.select(F.col("key").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
