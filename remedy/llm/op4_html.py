"""Main-text extraction from HTML.

The standard library's streaming parser turns a page into lines (text between block tags,
with character references decoded). A line's ratio is its text length over its tag count;
ratios are smoothed with a Gaussian and split into content and the rest at one standard
deviation. The clusters of content lines choose the region. Where article and main elements
hold most of the content, it is the least element around those that hold any. Elsewhere it is
the least element around all content lines, and of its parts in turn: from the first part with
content to the last, widened over the short parts before and after (a title, a last line) up
to a list of links. A page without a content line has no text. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag,
role, class or id, in a region or out of it; every other line of the region stays, however
short.

A class or id counts as a whole: each of its words is one of SKIP_WORDS or a mere layout
word (``site-footer``, not ``has-sidebar`` or ``related-work``). It never leaves out a
heading, an article or main element (but for reader comments), what holds the longest of
these or, within one or on a page without any, what holds most of the text.

Defined cases: null or empty html, and a page without content, give an empty text; broken
markup (open tags, stray ends, cut-off pages) is read as far as it goes; repeated rows
give equal results; a null url stays null; other columns pass through ``extract_text``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedy.sources.tables import table

RADIUS = 2
SHARE = 0.6
# Fixed values of HTML: elements without content, and elements that begin a new line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of these ends an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
P_SCOPE = frozenset("article main div section td li blockquote body".split())
LIST_SCOPE = frozenset("table ul ol dl select".split())
# What is no article text: by element, by ARIA role, by a word of class or id.
SKIP_TAGS = frozenset(
    "script style noscript template title nav aside footer form button select textarea input iframe object svg canvas "
    "audio video map menu dialog label fieldset".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner promo promotion sponsor sponsored nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup login register search share sharing "
    "social related recommended recommendations comment comments respond replies reply disqus widget widgets toolbar "
    "pagination pager copyright skip teaser outbrain taboola".split())
COMMENT_WORDS = frozenset("comment comments respond replies reply disqus".split())
# Words that say nothing of the content beside one of the above.
LAYOUT_WORDS = frozenset(
    "site main global top bottom upper lower left right primary secondary bar box area block panel container wrapper wrap "
    "inner outer row col column list item items link links posts slot unit button buttons icon icons".split())
COMMENT_LAYOUT = LAYOUT_WORDS | frozenset("section thread body content form author meta text".split())
MAIN_TAGS = frozenset(("article", "main"))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@lru_cache(maxsize=10_000)
def boilerplate(name: str) -> tuple[bool, bool]:
    """Does a class or id name what is no article text? And reader comments?"""
    words = {w.lower() for w in _WORDS.findall(name) if not w.isdigit()}
    skip = not SKIP_WORDS.isdisjoint(words) and words <= SKIP_WORDS | LAYOUT_WORDS
    readers = not COMMENT_WORDS.isdisjoint(words) and words <= SKIP_WORDS | COMMENT_LAYOUT
    return skip or readers, readers


class PageLines(HTMLParser):
    """Collects lines and the tree of elements they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.skip, self.main = ["#root"], [-1], [False], [False]
        self.closed, self.named, self.readers = [False], [False], [False]
        self.open = [0]
        # text, tags, element, characters in links, links
        self.lines: list[tuple[str, int, int, int, int]] = []
        self._text: list[str] = []
        self._tags = self._linked = self._links = self._anchors = 0
        self._at = 0

    def _end_line(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.lines.append((text, self._tags, self._at, self._linked, self._anchors))
                self._tags = self._anchors = 0
            self._text = []
        self._linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end_line()
        self._tags += 1
        if tag in VOID:
            return
        if tag in SELF_CLOSING:
            self._close(tag, P_SCOPE if tag == "p" else LIST_SCOPE)
        elif tag in BLOCK:
            self._close("p", P_SCOPE)
        main, skip, named, readers = tag in MAIN_TAGS, tag in SKIP_TAGS or tag == "header", False, False
        if attrs:
            a = {k: v or "" for k, v in attrs}
            main = main or a.get("role") == "main" or a.get("itemprop") == "articleBody"
            if tag not in HEADINGS and tag not in ("html", "body"):
                for name in f"{a.get('class', '')} {a.get('id', '')}".split():
                    n, r = boilerplate(name)
                    named, readers = named or n, readers or r
            main = main and not readers
            named = named and not main
            skip = skip or a.get("role") in SKIP_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        self.open.append(len(self.tag))
        self.parent.append(self.open[-2])
        self.tag.append(tag)
        self.skip.append(skip)
        self.named.append(named)
        self.readers.append(readers)
        self.closed.append(False)
        self.main.append(main)
        self._links += tag == "a"
        self._anchors += tag == "a"

    def _close(self, tag: str, stop=()) -> int:
        """Closes the innermost open ``tag`` and all inside it, not past ``stop``; 0 if none."""
        for i in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[i]]
            if name == tag:
                gone = self.open[i:]
                if self._links:
                    self._links -= sum(self.tag[e] == "a" for e in gone)
                del self.open[i:]
                return gone[0]
            if name in stop:
                return 0
        return 0

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self._tags += 1
        e = self._close(tag, stop=() if tag in BLOCK else BLOCK)
        if e:
            self.closed[e] = True

    def handle_data(self, data: str) -> None:
        if not self._text or not self._text[0].strip():
            self._at = self.open[-1]
        self._text.append(data)
        if self._links:
            self._linked += len(data)

    def page(self, html: str) -> "PageLines":
        self.feed(html)
        self.close()
        self._end_line()
        return self

    def up(self, e: int) -> Iterator[int]:
        while e != -1:
            yield e
            e = self.parent[e]


    def left_out(self, at: int, names: Callable[[int], bool]) -> bool:
        """Is a line of element ``at`` boilerplate? ``names``: elements left out by name."""
        chain = list(self.up(at))
        mains = [i for i, e in enumerate(chain) if self.main[e]]
        for i, e in enumerate(chain):
            named = names(e)
            if not (self.skip[e] and (self.tag[e] != "form" or e not in self.whole)) and not named:
                continue
            # a wrapper around the article, or an element left open before it, is no boilerplate for it
            around = mains and mains[-1] < i and not (
                self.closed[e] and (named and e not in self.holders or self.tag[e] in SKIP_TAGS and self.tag[e] != "form"))
            # the heading of an article's own header is its title
            title = self.tag[e] == "header" and not named and mains and mains[-1] > i and any(
                self.tag[x] in HEADINGS for x in chain[:i])
            if not around and not title:
                return True
        return False

    def kept_lines(self) -> list[tuple[str, int, int, int, int]]:
        """Lines that are no boilerplate by tag, role, class or id."""
        forms = {e for e, t in enumerate(self.tag) if t == "form"}
        self.whole, self.holders = forms, set()
        by_tag = self._lines(lambda e: self.readers[e])
        weight = [0] * len(self.tag)
        for text, _, at, linked, _ in by_tag:
            for x in self.up(at):
                weight[x] += max(0, len(text) - linked)
        # what holds most of the text of its article, or of a page without one, is kept
        outer = {}
        for e in range(len(self.tag)):
            outer[e] = outer.get(self.parent[e], 0) or (e if self.main[e] else 0)
        mains = [e for e in set(outer.values()) if e and weight[e]]
        if mains:
            self.holders = set(self.up(max(mains, key=lambda e: (weight[e], -e))))
        self.whole = set()
        for e in range(1, len(self.tag)):
            if (self.named[e] or e in forms) and (outer[e] or not mains) and weight[e] * 2 > weight[outer[e]]:
                self.whole.add(e)
        lines = self._lines(lambda e: self.readers[e] or self.named[e] and e not in self.whole)
        return lines or by_tag or self._lines(lambda e: False)

    def _lines(self, names: Callable[[int], bool]) -> list[tuple[str, int, int, int, int]]:
        out = {e: self.left_out(e, names) for e in {x[2] for x in self.lines}}
        return [x for x in self.lines if not out[x[2]]]


def smoothed(values: list[float], radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing (sigma: the radius), the kernel renormalised at the ends."""
    kernel = [math.exp(-d * d / (2 * radius * radius)) for d in range(radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        weight = [kernel[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(w * values[j] for w, j in zip(weight, range(lo, hi))) / sum(weight))
    return out


def content_lines(ratios: list[float]) -> list[bool]:
    """Threshold clustering: content is what smooths to at least one standard deviation
    (to the mean, where ratios differ so little that all or none would)."""
    s = smoothed(ratios)
    mean = sum(s) / len(s)
    sigma = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    cut = min(sigma, mean)
    return [x >= cut for x in s]


def region_lines(p: PageLines, lines: list[tuple[str, int, int, int, int]], content: list[bool]) -> list[int]:
    """Indexes of the lines around the content lines of a page without a leading article.

    In an element, lines go by the child they stand in. Children without content stay between
    the first and the last with content; before and after those only up to a list of links.
    Children with content are looked into the same way."""
    chains = {e: list(p.up(e))[::-1] for e in {x[2] for x in lines}}
    # a line of mere links is no content, however long
    text = [c and 2 * linked <= len(t) for c, (t, _, _, linked, _) in zip(content, lines)]

    def menu(part: list[int]) -> bool:
        return 2 * sum(lines[i][3] for i in part) > sum(len(lines[i][0]) for i in part) and sum(lines[i][4] for i in part) > 1

    out, todo = [], [(list(range(len(lines))), 0)]
    while todo:
        part, depth = todo.pop()
        if not any(text[i] for i in part):
            continue
        # down to the least element around the content
        kids: list[list[int]] = []
        while True:
            kids, last = [], None
            for i in part:
                chain = chains[lines[i][2]]
                kid = chain[depth + 1] if len(chain) > depth + 1 else None
                if kid is not None and kid == last:
                    kids[-1].append(i)
                else:
                    kids.append([i])
                last = kid
            held = [k for k, x in enumerate(kids) if any(text[i] for i in x)]
            if len(held) > 1 or len(chains[lines[kids[held[0]][0]][2]]) <= depth + 1:
                break
            inner = kids[held[0]]
            if len(kids) == 1:
                depth += 1
                part = inner
                continue
            break
        lo, hi = held[0], held[-1]
        while lo and not menu(kids[lo - 1]):
            lo -= 1
        while hi + 1 < len(kids) and not menu(kids[hi + 1]):
            hi += 1
        for k in range(lo, hi + 1):
            if k in held and len(kids[k]) > 1:
                todo.append((kids[k], depth + 1))
            else:
                out += kids[k]
    return sorted(out)


def main_text(html: str | None) -> str:
    """Text of the content region, lines joined by one blank."""
    if not html:
        return ""
    p = PageLines().page(html)
    lines = p.kept_lines()
    if not lines:
        return ""
    content = content_lines([len(t) / (1 + tags) for t, tags, _, _, _ in lines])
    weight = [0] * len(p.tag)
    for (text, _, e, _, _), c in zip(lines, content):
        if c:
            for x in p.up(e):
                weight[x] += len(text)
    # outermost article and main elements that hold content
    mains = {m for x in {x[2] for x in lines} for m in [e for e in p.up(x) if p.main[e]][-1:] if weight[m]}
    if not mains or sum(weight[m] for m in mains) < SHARE * weight[0]:
        return " ".join(lines[i][0] for i in region_lines(p, lines, content))
    around = set.intersection(*(set(p.up(m)) for m in mains))
    region = max(around)  # elements are numbered in page order: the deepest is last
    return " ".join(t for t, _, e, _, _ in lines if region in p.up(e))


def extract_text(pages: DataFrame, html: str = "html", out: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its length in code points in place of ``html``."""
    at = pages.columns.index(html)
    keep = [i for i in range(len(pages.columns)) if i != at]
    schema = T.StructType([pages.schema.fields[i] for i in keep]
                          + [T.StructField(out, T.StringType()), T.StructField(n_chars, T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = [main_text(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=names)

    return pages.mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op4_html": op4_html}
