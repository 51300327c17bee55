"""Main text of web pages: streaming parser events, text-to-tag ratios, smoothing and threshold clustering.

The page becomes lines, one for each block of text. A line's ratio is its characters for each tag that it has;
ratios are smoothed with a Gaussian and split in two clusters at the threshold that separates them best. The article is the
innermost region that still holds nearly all text of the upper cluster; without such lines there is none. What stands in
menus, headers, footers, side bars, notices, adverts, forms, comments and the like, known by its element, role or class, is
never part of a line. An <article> or <main> is no more than an element that a region doesn't go below.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SIGMA = 1.0
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without article text.
_OUT = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted "
    "recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
_HEAD_WORDS = frozenset(("header", "topbar", "top"))
_ROOTS = frozenset(("article", "main"))
#: Elements that a region may be; lists, tables and paragraphs are parts of one.
_REGIONS = frozenset("article body center div html main section td".split())
#: Share of the upper cluster's text that a region must keep of the one around it.
NEARLY = 0.8
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Events(HTMLParser):
    """Lines of a page: text, tags, characters in links, and the elements around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, number, left out, inside a root
        self.made = 0
        self.text: list[str] = []
        self.tags = self.link = self.links = 0
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.kind: dict[int, str] = {}

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.link, tuple(e[1] for e in self.open)))
            self.tags = 0
        self.text.clear()
        self.link = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _BLOCK:
            self.line()
            if tag == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.close_to("p", until=("div", "article", "section", "td", "blockquote", "body", "li"))
            elif tag == "li":
                self.close_to("li", until=("ul", "ol", "menu"))
        elif tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        self.links += tag == "a"
        *_, out, rooted = self.open[-1]
        self.made += 1
        if not out:
            out = self.left_out(tag, dict(attrs), rooted)
            self.kind[self.made] = tag
            rooted = rooted or tag in _ROOTS and not out
        self.open.append((tag, self.made, out, rooted))

    def left_out(self, tag: str, attrs: dict, rooted: bool) -> bool:
        if tag in _OUT or tag == "header" and not rooted:
            return True
        if not attrs or tag in ("html", "body"):
            return False
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or (attrs.get("role") or "").lower() in _OUT_ROLES:
            return True
        names = {w.lower() for k in ("class", "id") for w in _NAME.findall(attrs.get(k) or "")}
        return bool(names & _OUT_WORDS) and not (tag in _ROOTS and not names & {"comment", "comments", "related", "promo", "sponsored", "ad"}) or not rooted and bool(names & _HEAD_WORDS) and tag not in _ROOTS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def close_to(self, tag: str, until: tuple[str, ...]) -> None:
        """Ends an open `tag` whose end tag was left out."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                return
            if self.open[k][0] in until:
                return

    def pop_to(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.links -= tag == "a"
        del self.open[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCK:
            self.line()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                return
            if tag not in _BLOCK and self.open[k][0] in _BLOCK:  # an inline element doesn't end the block around it
                return

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.text.append(data)
            if self.links:
                self.link += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Values after a Gaussian over their neighbours; at the ends the weights are those of the neighbours that are there."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(weights[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """The value from which on the upper of two clusters begins: the split with the least variance inside them."""
    v = np.sort(np.asarray(values, float))
    if len(v) < 2 or v[0] == v[-1]:
        return float(v[0])
    n, total, left = len(v), v.sum(), np.cumsum(v)[:-1]
    k = np.arange(1, n)
    between = np.where(v[1:] > v[:-1], (left / k - (total - left) / (n - k)) ** 2 * k * (n - k), -1)
    return float(v[int(between.argmax()) + 1])


def main_text(html: str | None) -> str:
    """The article's blocks, each with its white space as single spaces, joined by one space; "" if there is none."""
    if not html:
        return ""
    page = _Events()
    for at in range(0, len(html), 1 << 16):
        page.feed(html[at : at + (1 << 16)])
    page.close()
    page.line()
    lines = page.lines
    if not lines:
        return ""
    ratios = smoothed([len(t) / max(1, tags) for t, tags, _, _ in lines])
    upper = threshold(ratios)
    mass: dict[int, int] = defaultdict(int)
    inside: dict[int, set[int]] = defaultdict(set)
    for (text, _, link, around), ratio in zip(lines, ratios):
        path = [0, *(e for e in around if page.kind.get(e) in _REGIONS)]
        for outer, e in zip(path, path[1:]):
            inside[outer].add(e)
        if ratio >= upper and ratio > 0 and 2 * link <= len(text):
            for e in path:
                mass[e] += len(text)
    if not mass[0]:
        return ""
    region = 0
    while page.kind.get(region) not in _ROOTS:
        best = max(inside[region], key=lambda e: (mass[e], -e), default=0)
        if not best or mass[best] < NEARLY * mass[region]:
            break
        region = best
    # link lists go, but not from a region that the page itself marks as its text
    marked = page.kind.get(region) in _ROOTS
    return " ".join(t for t, _, link, around in lines if (not region or region in around) and (marked or 2 * link <= len(t)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages (page_id, url, html).

    A null or empty html, or one without an article, has the empty text. Nulls in other columns stay, rows that
    repeat give repeated rows, an empty table gives no rows; other columns are not read. A page is parsed in pieces as
    a stream of events; one pass, no shuffle.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(parse, f"page_id {kind}, url string, text string, n_chars long")
