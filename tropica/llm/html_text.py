"""Main text of web pages from flat text blocks.

A page is cut at block-level tags into flat blocks. Each block has its word count and link density, those of the
blocks before and after it, and what its containers say (article, navigation, names such as "comments"). A decision
tree, grown from the small labelled table below, keeps the blocks of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.cart import grow, predict

#: The rest of a tag after its name, quoted attributes of any length included; nothing in it is tried twice.
_REST = re.compile(r"""([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
#: Their content is no text of the page.
SILENT = set("script style noscript template head title textarea svg math canvas iframe object select option button datalist audio video map".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BOILER_TAGS = set("nav header footer aside form fieldset menu dialog".split())
BODY_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertorial|adsense|sponsor(?:ed|s)?|promo(?:tion|tions)?|banner|comments?|commentlist|disqus|replies|reply|respond|discussion|sidebar|side-bar|rail|widget|nav|navbar|navigation|menu|breadcrumbs?|crumbs|header|masthead|topbar|footer|foot|colophon|cookies?|consent|gdpr|notice|alert|warning|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|trending|popular|more-stories|tags|tagcloud|pagination|pager|search|toolbar|copyright|legal|disclaimer|skip|toc|paywall|author-bio|byline|meta)(?:$|[\s_-])",
    re.I,
)
BODY_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|post-body|entry|entry-content|content|story|maintext|main|main-content|body-text|text)(?:$|[\s_-])", re.I)

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "body", "boiler", "heading", "item", "page_has_body")
#: FEATURES and the label: 1 for blocks of an article. Typical blocks of invented pages, labelled by hand.
TABLE = """
6 0 0 0 40 0 1 0 1 0 1 1 | 45 0 6 0 60 0 1 0 0 0 1 1 | 60 .02 45 0 30 .1 1 0 0 0 1 1 | 1 0 60 0 50 0 1 0 0 0 1 1 | 3 0 1 0 1 0 1 0 0 0 1 1
12 .5 50 0 40 0 1 0 0 0 1 1 | 2 1 30 0 30 0 1 0 0 0 1 1 | 8 0 9 0 7 0 1 0 0 1 1 1 | 15 .2 8 0 12 0 1 0 0 1 1 1 | 9 0 120 0 1 1 1 0 0 0 1 1
200 0 1 1 8 0 1 0 0 0 1 1 | 25 .04 3 0 4 .2 1 0 0 0 1 1 | 4 0 80 0 70 0 1 0 1 0 1 1 | 7 1 40 0 12 0 1 0 0 1 1 1 | 1 0 1 1 1 1 1 0 0 0 1 1
1 1 0 0 1 1 0 1 0 1 1 0 | 1 1 1 1 1 1 0 1 0 1 1 0 | 2 1 1 1 9 0 0 1 0 1 1 0 | 9 0 2 1 6 0 0 1 0 0 1 0 | 12 .1 90 0 0 0 0 1 0 0 1 0
40 0 80 0 35 0 1 1 0 0 1 0 | 30 0 40 0 25 0 1 1 0 0 1 0 | 5 0 90 0 12 0 1 1 1 0 1 0 | 90 .05 3 0 70 0 1 1 0 0 1 0 | 18 0 50 0 60 0 1 1 0 0 1 0
3 0 20 0 2 0 0 1 1 0 1 0 | 60 .1 5 1 1 1 0 1 0 0 1 0 | 22 0 1 1 8 0 0 1 0 0 0 0 | 4 1 3 1 5 1 0 1 0 1 0 0 | 35 0 30 0 2 1 0 1 0 0 0 0
14 0 1 1 80 0 0 0 0 0 1 0 | 6 0 1 1 5 0 0 0 0 0 1 0 | 30 0 70 0 6 1 0 0 0 0 1 0 | 50 .1 12 .5 5 1 0 0 0 0 1 0 | 5 1 6 1 7 0 0 0 0 0 1 0
45 0 5 0 60 0 0 0 0 0 0 1 | 80 .05 45 0 70 0 0 0 0 0 0 1 | 20 0 60 0 50 0 0 0 0 0 0 1 | 6 0 3 1 70 0 0 0 1 0 0 1 | 30 .1 6 0 40 0 0 0 0 0 0 1
17 .1 40 0 35 .1 0 0 0 0 0 1 | 11 0 50 0 45 0 0 0 0 0 0 1 | 120 .2 80 .1 9 1 0 0 0 0 0 1 | 9 0 35 0 60 .1 0 0 1 0 0 1 | 14 0 30 0 20 0 0 0 0 1 0 1
3 1 2 1 4 1 0 0 0 1 0 0 | 2 1 3 1 2 1 0 0 0 0 0 0 | 5 .8 4 1 3 1 0 0 0 1 0 0 | 25 .9 5 1 8 1 0 0 0 0 0 0 | 4 0 3 1 2 1 0 0 0 0 0 0
7 0 5 1 3 1 0 0 0 0 0 0 | 10 .6 8 1 12 .7 0 0 0 1 0 0 | 6 0 0 0 1 1 0 0 0 0 0 0 | 8 .4 60 .9 0 0 0 0 0 0 0 0 | 40 .7 5 1 30 .8 0 0 0 0 0 0
2 0 30 0 0 0 0 0 0 0 0 0 | 6 .1 60 0 0 0 0 0 0 0 0 0 | 3 0 120 0 2 1 0 0 0 0 0 0 | 45 0 60 0 0 0 0 0 0 0 0 1 | 5 0 0 0 0 0 0 0 0 0 0 1
25 0 30 0 0 0 0 0 0 0 0 1 | 60 0 0 0 0 0 0 0 0 0 0 1 | 4 .3 45 0 3 0 0 0 0 0 0 0 | 70 0 0 0 3 0 0 0 0 0 0 1 | 5 0 30 .1 0 0 0 0 0 0 0 0
2 0 30 0 0 0 1 0 0 0 1 1 | 6 .1 60 0 0 0 1 0 0 0 1 1 | 3 0 120 0 2 1 1 0 0 0 1 1 | 4 .3 45 0 3 0 1 0 0 0 1 1 | 5 0 30 .1 0 0 1 0 0 0 1 1
14 0 1 1 80 0 1 0 0 0 1 1 | 7 0 5 1 3 1 1 0 0 0 1 1 | 4 0 3 1 2 1 1 0 1 0 1 1 | 12 .6 70 0 40 0 1 0 0 0 1 1 | 60 .3 4 1 30 0 1 0 0 0 1 1
3 1 2 1 4 1 1 0 0 1 1 0 | 25 .9 5 1 8 1 1 0 0 0 1 0 | 5 1 6 1 7 1 1 0 0 1 1 0 | 4 1 60 0 5 1 1 0 0 1 1 0 | 6 1 4 1 80 0 1 0 0 1 1 0
2 1 45 0 3 1 1 0 0 0 1 0 | 9 1 8 1 12 .7 1 0 0 0 1 0 | 3 1 9 .8 0 0 1 0 0 1 1 0 | 7 .9 20 0 6 .9 1 0 0 0 1 0 | 2 1 3 1 50 0 1 0 0 0 1 0
4 1 21 0 21 0 1 0 0 0 1 1 | 3 1 10 0 60 0 1 0 0 0 1 1 | 8 1 18 0 30 0 1 0 0 0 1 1 | 5 1 4 0 7 0 1 0 0 0 1 1 | 1 1 80 0 120 .1 1 0 0 0 1 1
21 0 1 0 4 1 1 0 0 0 1 1 | 45 0 60 0 3 1 1 0 0 0 1 1 | 30 .1 20 0 5 1 1 0 0 0 1 1 | 3 0 40 0 4 1 1 0 1 0 1 1 | 6 0 25 .1 2 .8 1 0 0 0 1 1
14 0 33 .2 12 1 1 0 0 1 1 1 | 90 .2 8 0 7 .9 1 0 0 0 1 1 | 70 0 4 1 5 1 1 0 0 0 1 1 | 2 0 3 1 3 1 1 0 1 0 1 1 | 18 0 6 1 40 0 1 0 0 0 1 1
21 0 21 0 0 0 0 0 0 0 0 1 | 18 0 40 0 0 0 0 0 0 0 0 1 | 16 0 25 0 3 1 0 0 0 0 0 1 | 30 0 20 0 1 1 0 0 0 0 0 1 | 22 .1 60 0 2 0 0 0 0 0 0 1
8 0 30 0 0 0 0 0 0 0 0 0 | 3 0 20 0 4 1 0 0 0 0 0 0 | 10 0 1 1 30 0 0 0 0 0 1 0 | 24 0 3 0 5 0 0 0 0 0 1 0 | 40 0 60 0 2 1 0 0 0 0 1 0
"""


def typical() -> Iterator[tuple[float, ...]]:
    """Rows like those of TABLE for every mix of sizes, labelled by kind of block."""
    for words, before, after in product((1, 4, 9, 20, 60, 150), repeat=3):
        near = ((before, 0, after, 0), (before, 1, after, 1), (before, 0, after, 1), (before, 1, after, 0), (before, 0.1, after, 0.6))
        for density in (0, 0.2):
            yield from ((words, density, *n, 1, 0, 0, 0, 1, 1) for n in near)  # prose of an article, whatever is beside it
        yield from ((words, 1, *n, 1, 0, 0, 0, 1, float(n is near[0])) for n in near)  # links in it: one alone stays, rows of them go
        yield from ((words, density, *near[0], 0, 0, 0, 0, 1, 0) for density in (0, 1))  # outside the article of the page
        yield from ((words, density, *near[0], inside, 1, 0, 0, 1, 0) for density in (0, 1) for inside in (0, 1))  # boilerplate
        # Pages that name no article: long blocks, and shorter ones between or beside long ones.
        prose = words >= 20 or words >= 9 and max(before, after) >= 20 or min(before, after) >= 20
        yield from ((words, density, *near[0], 0, 0, 0, 0, 0, float(prose)) for density in (0, 0.2))
        yield from ((words, 1, *n, 0, 0, 0, 0, 0, 0) for n in near)


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    rows = np.array([*([float(v) for v in row.split()] for line in TABLE.strip().splitlines() for row in line.split("|")), *typical()])
    return grow(rows[:, :-1], rows[:, -1], depth=8, least=2)


class Block:
    __slots__ = ("body", "boiler", "heading", "item", "linked", "parts", "text", "words")

    def __init__(self):
        self.parts: list[tuple[str, bool]] = []


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name (empty for comments and the like), whether it closes, and attributes of each tag, in one pass.

    Where a quote never closes, that tag and all later ones end at their first >; a tag without any > is the rest of
    the page. The end of a raw element's content counts as the end of its tag."""
    at, quoted, closers = 0, True, {}
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        closing = after == "/"
        named = _NAME.match(page, start + 1 + closing)
        if not named:
            at = start + 1
            if after and after in "!?/":  # a declaration
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
                yield start, at, "", False, ""
            continue
        rest = _REST.match(page, named.end()) if quoted else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            quoted, end = False, page.find(">", named.end())
            attributes, at = (page[named.end() : end], end + 1) if end >= 0 else ("", len(page))
        name = named[0].lower()
        if name in RAW and not closing:
            if name not in closers:
                closers[name] = re.compile(rf"</{name}\b[^>]*>?", re.I)
            end = closers[name].search(page, at)
            at = end.end() if end else len(page)
        yield start, at, name, closing, attributes


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; malformed nesting is closed as far as it must be.

    Linear in the page: of open elements only counts are asked, and each is opened and closed once."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, opens a body, opens boilerplate, is silent
    opened: Counter[str] = Counter()
    headings = body = boiler = silent = 0
    link = None  # how many elements were open where the link began
    block = Block()

    def close() -> None:
        nonlocal block
        if block.parts:
            text = " ".join(html.unescape("".join(t for t, _ in block.parts)).split())
            if text:
                block.text, block.words = text, text.count(" ") + 1
                block.linked = sum(len(html.unescape(t).split()) for t, linked in block.parts if linked)
                block.body, block.boiler = body > 0, boiler > 0
                block.heading, block.item = headings > 0, opened["li"] > 0
                out.append(block)
            block = Block()

    def leave() -> None:
        nonlocal headings, body, boiler, silent, link
        name, opens_body, opens_boiler, hides = stack.pop()
        opened[name] -= 1
        headings, body, boiler, silent = headings - (name in HEADINGS), body - opens_body, boiler - opens_boiler, silent - hides
        if link is not None and len(stack) < link:
            link = None  # left open in an element that is closed now

    at = 0
    for start, end, name, closing, attributes in tags(page):
        if start > at and not silent:
            block.parts.append((page[at:start], link is not None))
        at = end
        if not name:
            continue
        if name == "a":
            link = None if closing else len(stack)
        if name in INLINE and name not in SILENT:
            if name == "br":
                block.parts.append((" ", False))
            continue
        close()
        if closing:
            while opened[name] and stack:
                last = stack[-1][0]
                leave()
                if last == name:
                    break
            continue
        if name in RAW or name in VOID:
            continue
        if name in ("p", "li", *HEADINGS) and stack and stack[-1][0] in ("p", "li", *HEADINGS) and (name == stack[-1][0] or stack[-1][0] == "p"):
            leave()  # left open: the next one closes it
        named = " ".join(x for found in _NAMES.findall(attributes) for x in found if x) if attributes else ""
        hides = name in SILENT or bool(attributes and _HIDDEN.search(attributes))
        # A header inside the article is its own head; names of the whole page say nothing.
        opens_boiler = name in BOILER_TAGS and not (name == "header" and body) or name not in ("html", "body", "article", "main") and bool(named and BOILER_NAMES.search(named))
        opens_body = name in BODY_TAGS or not opens_boiler and bool(named and BODY_NAMES.search(named))
        stack.append((name, opens_body, opens_boiler, hides))
        opened[name] += 1
        headings, body, boiler, silent = headings + (name in HEADINGS), body + opens_body, boiler + opens_boiler, silent + hides
    if at < len(page) and not silent:
        block.parts.append((page[at:], link is not None))
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([min(1.0, b.linked / b.words) for b in found])
    pad = lambda x: np.concatenate([[0.0], x, [0.0]])
    w, d = pad(words), pad(density)
    own = np.array([(b.body, b.boiler, b.heading, b.item) for b in found], dtype=float)
    any_body = np.full(len(found), float(any(b.body and not b.boiler for b in found)))
    return np.column_stack([words, density, w[:-2], d[:-2], w[2:], d[2:], own, any_body])


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = predict(tree(), features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html).

    Null, empty and textless html gives an empty text; page_id and url pass through as they are, null and repeated
    ones too; other columns are not read. A page is read whole, however long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
