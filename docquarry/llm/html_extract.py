"""Main text of web pages by line-block distribution.

Markup becomes lines, one for each block element, less the elements that are never article text (menus, footers,
forms, ..., and what whole class names mark so), which leave a gap.  A line weighs as many characters as it has
outside links.  Weights are summed over sliding windows of lines that no gap divides; a surge point is where the sum
rises over the threshold, a dive point where it falls back.  The threshold is SURGE, or half of the page's highest
sum where that is less, so that short pages surge too.

What surges decides where the article is: from the page's root, the element that holds DOMINANT of the surging
characters (half of them, for an article or main element) is entered, again and again, until none does or the element
says that it is the article.  Where nothing surges, text in article and main elements goes before all other.  The
article is

* the lines of that element: all of them if it says it is the article, by its name or class; else those between its
  first surge and its last dive point, less runs of WINDOW or more lines that are links only, with the lines beside
  them that stand directly in the element and not in a part of their own;
* lines directly in the elements around it that the same surge reaches, and the heading just before it.

Pages are independent: no shuffle, and memory is bounded by one page.  Reading is linear in the page's length.

Defined results: null, empty and text-free pages give an empty text; pages are read whole; unclosed elements end
with their parent, but unclosed scripts, styles and comments reach to the end of the page, as in browsers, and
unclosed containers that are not the article are ignored; quotes hide a ``>`` in a tag unless they never close;
text of repeated pages repeats; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3  # lines
SURGE = 80  # characters in a window
DOMINANT = 0.75  # of the surging characters
QUOTE_FAILURES = 3  # tags whose quotes never close, after which quotes hide nothing

#: Elements whose content is never read; whose content is never article text; whose tags end a line;
#: that have no content; that other blocks end; that may hold the article; that head it.
RAW = frozenset("script style noscript template svg iframe object canvas head title".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select textarea option label fieldset input".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_ENDING = frozenset("p li dt dd td th tr option".split())
HOLDERS = frozenset("article main div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be marked as something else than the article.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td center details figure".split())
#: Words of class, id or role attributes that mark what is not the article; such words that mark nothing
#: inside an article or main element; words beside them.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies cookieconsent consent gdpr notice notices popup modal overlay "
    "sidebar aside complementary menu nav navbar navigation breadcrumb breadcrumbs masthead footer contentinfo colophon topbar toolbar comment comments commentlist respond reply replies disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager".split()
)
LOOSE_MARKS = frozenset("alert copyright discussion header legal toc".split())
BESIDE = frozenset("site page box bar wrapper wrap container list area block links link form top bottom left right global inner outer slot unit group panel buttons".split())
ARTICLE_MARKS = frozenset("article content post entry story main articlebody maincontent".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|!\[CDATA\[|[!?])|\]\]>")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")


def _boilerplate(token: str, marks: frozenset[str]) -> bool:
    """Whether a whole class, id or role says so: ``cookie-banner`` does, ``related-work`` doesn't."""
    parts = set(re.split(r"[-_]+", token)) - {""}
    return bool(parts & marks) and parts <= marks | BESIDE


def _marks(element: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is marked as something else than the article, and whether as the article."""
    named: list[str] = []
    words: set[str] = set()
    hidden = other = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.lower().strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true"):
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "id" and element == "section":  # it may come from the section's title
            other |= any(_boilerplate(token, MARKS) for token in value.split())
        elif name in ("class", "role", "id"):
            named += value.split()
        if name in ("class", "id", "role", "itemprop"):
            words.update(re.split(r"[^a-z0-9]+", value))
    if element in CONTAINERS:
        marks = MARKS if inside else MARKS | LOOSE_MARKS
        other |= any(_boilerplate(token, marks) for token in named)
    return hidden or other, bool(words & ARTICLE_MARKS) and element in HOLDERS


class Line(NamedTuple):
    text: str
    own: int  # characters outside links
    holder: int  # the element that it stands in, and may hold the article
    head: bool  # a heading
    gap: bool  # something that is not the article stood before it


class Page:
    """The lines of a page, and its elements that may hold the article: parent and whether it says it does."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.parent, self.article = [-1], [0]  # 2: an article or main element, 1: marked so, 0: neither
        self._page, self._lower = page, page.lower()
        if len(self._lower) != len(page):  # lower-casing that changes lengths would move places
            self._lower = page.translate({k: k + 32 for k in range(65, 91)})
        self._last: dict[str, int] = {}
        self._failures = 0
        self._parts: list[str] = []
        self._linked: list[str] = []
        self._link = self._head = self._gap = False
        # open holders and how many of each name; article and main elements among them
        self._open: list[tuple[str, int]] = []
        self._count: dict[str, int] = {}
        self._skip, self._depth = "", 0
        self._read()

    def _closes_after(self, name: str, at: int) -> bool:
        if name not in self._last:
            self._last[name] = self._lower.rfind("</" + name)
        return self._last[name] >= at

    def _end_of_tag(self, at: int) -> int:
        """Place after the ``>`` of the tag whose attributes begin at ``at``; -1 if there is none."""
        plain = self._page.find(">", at) + 1
        if not plain:
            return -1
        if self._failures < QUOTE_FAILURES:
            tag = self._page[at:plain]
            if '"' in tag or "'" in tag:
                m = _QUOTED.match(self._page, at)
                if m:
                    return m.end()
                self._failures += 1
        return plain

    def _add(self, text: str) -> None:
        if text and not self._skip:
            self._parts.append(text)
            if self._link:
                self._linked.append(text)

    def _end_line(self) -> None:
        text = " ".join(html.unescape("".join(self._parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(self._linked)).split()))
            self.lines.append(Line(text, max(0, len(text) - linked), self._open[-1][1] if self._open else 0, self._head, self._gap))
            self._gap = False
        self._parts.clear()
        self._linked.clear()

    def _read(self) -> None:
        page, at = self._page, 0
        while True:
            m = _OPEN.search(page, at)
            if not m:
                break
            self._add(page[at : m.start()])
            at, name = m.end(), (m[2] or "").lower()
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
                continue
            if m[0] in ("<![CDATA[", "]]>"):
                continue
            end = self._end_of_tag(at)
            if end < 0:
                if name in RAW:
                    at = len(page)
                else:
                    self._add(m[0])
                continue
            attributes, at = page[at : end - 1], end
            if not name:
                continue
            if m[1]:
                self._close(name)
            elif name in RAW and not attributes.endswith("/"):
                if name in ("svg", "noscript", "template", "object", "canvas", "head", "title") and not self._closes_after(name, at):
                    continue
                if name in ("svg", "canvas", "object", "iframe"):
                    self._add(" ")
                end = self._lower.find("</" + name, at) if self._closes_after(name, at) else -1
                end = page.find(">", end) if end >= 0 else -1
                at = len(page) if end < 0 else end + 1
            else:
                self._begin(name, attributes, at)
        self._add(page[at:])
        self._end_line()

    def _close(self, name: str) -> None:
        if self._skip:
            if name == self._skip:
                self._depth -= 1
            if self._depth > 0 and not (self._skip in SELF_ENDING and name in BLOCK):
                return
            self._skip = ""
            if not self._depth:
                return
        if name == "a":
            self._link = False
        elif name in BLOCK:
            self._end_line()
            self._link = self._head = False
            if self._count.get(name):
                while True:
                    closed, _ = self._open.pop()
                    self._count[closed] -= 1
                    if closed == name:
                        break

    def _begin(self, name: str, attributes: str, at: int) -> None:
        if self._skip:
            if name == self._skip and name not in SELF_ENDING:
                self._depth += not attributes.endswith("/")
                return
            if not (self._skip in SELF_ENDING and (name == self._skip or name in BLOCK)):
                return
            self._skip = ""
        if name == "br":
            self._add(" ")
        elif name == "a":
            self._link = True
        if name in BLOCK:
            self._end_line()
            self._link, self._head = False, name in HEADINGS
        if name in VOID or attributes.endswith("/") or name in ("a", "html", "body"):
            return
        inside = bool(self._count.get("article") or self._count.get("main"))
        other, own = _marks(name, attributes, inside) if attributes else (False, False)
        outside = name in OUTSIDE or (name == "header" and not inside) or (other and name not in ("article", "main"))
        if outside and (name in SELF_ENDING or self._closes_after(name, at)):
            if name in BLOCK:
                self._gap = True
            else:
                self._add(" ")
            self._skip, self._depth = name, 1
        elif name in HOLDERS:
            number = len(self.parent)
            self.parent.append(self._open[-1][1] if self._open else 0)
            self.article.append(2 if name in ("article", "main") else int(own))
            self._open.append((name, number))
            self._count[name] = self._count.get(name, 0) + 1


def sums(weight: list[int], gap: list[bool], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the window that each line begins, its end, and the weight of all lines before each."""
    n = len(weight)
    part = np.cumsum(np.array(gap, dtype=np.int64))
    upto = np.concatenate([[0], np.cumsum(np.array(weight, dtype=np.int64))])
    end = np.minimum(np.arange(n) + window, np.searchsorted(part, part, side="right"))
    return upto[end] - upto[:n], end, upto


def surges(weight: list[int], gap: list[bool], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Whether each line lies between a surge and a dive point.

    Windows begin at a line that weighs something and reach no farther than it takes to be heavy."""
    total, end, upto = sums(weight, gap, window)
    limit = min(surge, -(-int(total.max(initial=0)) // 2))
    turns = np.zeros(len(weight) + 1, dtype=np.int64)
    for i in np.flatnonzero((total >= limit) & (np.array(weight) > 0)):
        last = end[i] - 1
        while last > i and (weight[last] == 0 or upto[last] - upto[i] >= limit):
            last -= 1
        turns[i] += 1
        turns[last + 1] -= 1
    return list(np.cumsum(turns)[:-1] > 0)


def _home(page: Page, weight: list[int]) -> tuple[int, set[int]]:
    """The element that holds the article, and it with all that it is in."""
    mass = [0] * len(page.parent)
    for line, w in zip(page.lines, weight, strict=True):
        mass[line.holder] += w
    children: dict[int, list[int]] = {}
    for number in range(len(page.parent) - 1, 0, -1):
        mass[page.parent[number]] += mass[number]
        children.setdefault(page.parent[number], []).append(number)
    home, chain = 0, {0}
    while not page.article[home]:
        best = max(children.get(home, []), key=lambda k: (mass[k], -k), default=None)
        if best is None or not mass[best] or mass[best] < (0.5 if page.article[best] == 2 else DOMINANT) * mass[home]:
            break
        home = best
        chain.add(home)
    return home, chain


def article_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's lines, joined by newlines."""
    read = Page(page or "")
    lines = read.lines
    gap = [line.gap for line in lines]
    weight = [line.own for line in lines]
    total = sums(weight, gap, window)[0]
    if total.max(initial=0) < surge:
        # nothing surges: what stands in article elements, if anything, is all that counts, links too
        marked = [False] * len(read.parent)
        for number in range(1, len(read.parent)):  # parents come before their children
            marked[number] = read.article[number] == 2 or marked[read.parent[number]]
        held = [len(line.text) if marked[line.holder] else 0 for line in lines]
        weight = held if any(held) else weight
    if not any(weight):
        return ""
    dense = surges(weight, gap, window, surge)
    home, chain = _home(read, [w if d else 0 for w, d in zip(weight, dense, strict=True)])
    n = len(lines)
    # for each holder in the article's element, the part of it (a child, or itself) that it is in
    part = [-1] * len(read.parent)
    part[home] = home
    for number in range(home + 1, len(read.parent)):
        above = read.parent[number]
        part[number] = number if above == home else part[above]
    inner = [part[line.holder] >= 0 for line in lines]
    direct = [line.holder in chain for line in lines]
    keep = [False] * n
    if read.article[home]:
        keep = inner[:]
    else:
        mass: dict[int, int] = {}
        for line, w, d, i in zip(lines, weight, dense, inner, strict=True):
            if i and d:
                mass[part[line.holder]] = mass.get(part[line.holder], 0) + w
        heavy = max((w for line, w, d, i in zip(lines, weight, dense, inner, strict=True) if i and d), default=0)
        limit = min(surge, heavy)
        core = [i and d and (line.holder == home or read.article[line.holder] or mass[part[line.holder]] >= limit) for line, i, d in zip(lines, inner, dense, strict=True)]
        first = core.index(True) if True in core else 0
        last = n - 1 - core[::-1].index(True) if True in core else -1
        for k in range(first, last + 1):
            keep[k] = inner[k]
        k = 0
        while k < n:  # runs of lines that are links only
            end = k
            while end < n and not weight[end]:
                end += 1
            if end - k >= window:
                keep[k:end] = [False] * (end - k)
            k = max(end, k + 1)
    if True in keep:
        first, last = keep.index(True), n - 1 - keep[::-1].index(True)
        k = last + 1  # lines beside, up to a gap
        while k < n and not lines[k].gap and weight[k] and (direct[k] and (dense[k] or lines[k].holder == home)):
            keep[k] = True
            k += 1
        k = first - 1
        while k >= 0 and not lines[k + 1].gap and weight[k] and (direct[k] and (dense[k] or lines[k].holder == home) or (dense[k] and read.article[lines[k].holder])):
            keep[k] = True
            k -= 1
        head = k
        while head >= max(0, k - window + 1) and not lines[head + 1].gap:
            if lines[head].head and weight[head]:
                keep[head : k + 1] = [True] * (k + 1 - head)
                break
            head -= 1
    return "\n".join(line.text for line, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
