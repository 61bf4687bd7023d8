"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's ``HTMLParser`` streams events; block tags cut the page into
lines. A line's ratio is its characters over the tags met in it (one at least); lines
in menus, forms, notices and the like have ratio 0. Ratios are smoothed with a
Gaussian over neighbouring lines, and lines above the ratios' standard deviation form
the content cluster. The content regions are all ``article`` (or ``main``) elements, if
they hold half of the cluster's characters, or else the lowest element that holds all
of the cluster, or its container if that is a block without others or a part such as a
list, table, quote or section; a region's lines are all kept, apart from those marked
above, so short paragraphs are not lost. A headline (h1) that stands before that element below
the same wrapper is taken in with what follows it, as a byline.

Marks are whole classes, ids and roles, and on containers compounds that hold certain words; none
counts on headings, nor on the page's only main or article and what that stands in. An
inline element that is left out does not end its block.

Defined results: a null or empty page, or one without text, gives an empty text;
unclosed, stray and misnested tags are accepted, and so is any ``<!`` declaration; a
comment or tag that is not ended goes with the rest of the page; character references
are decoded; white space in a block is one space; repeated rows give repeated results.
A page of n bytes takes time in proportion to n, however its tags are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split())
#: Never part of a text, wherever they stand.
SKIPPED = frozenset("head script style noscript template nav footer aside form menu iframe select option button textarea svg math object dialog canvas audio video title".split())
#: Inline tags that open such a part, and so are kept on the stack.
OPENED = frozenset("script style button textarea svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Classes, ids and roles that mark such a part, each as a whole.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar side aside complementary contentinfo widget comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright hidden form dialog".split())
#: Of compounds such as site-footer or cookie_banner, on containers: last words that mark one whatever stands before,
#: words before which a page or site header is meant, and words that may follow any mark.
LAST = frozenset("ad ads advert adverts advertisement banner nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar comments commentlist disqus respond cookie cookies consent gdpr newsletter subscribe popup modal overlay pagination pager widget widgets promo sponsored".split())
OF_SITE = frozenset("site page main global top".split())
AFTER = frozenset("area bar block body bottom box button buttons col column container content dialog form group holder icons inner left link links list main message notice outer panel primary right row secondary section slot text thread title top unit wrap wrapper".split())
#: A compound that holds one of these says something about its surroundings.
ABOUT = frozenset("has have with without no not non is show hide".split())
#: Words that mark a compound wherever they stand in it, unless it speaks of the article itself.
ANYWHERE = frozenset("advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr masthead newsletter notice notices pagination popup replies sidebar sponsored".split())
ARTICLE = frozenset("article articles body content entry main page post story text".split())
CONTAINERS = frozenset("div section ul ol dl table aside header footer nav form details center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGIONS = frozenset(["article", "main"])
#: Parts of a text: what stands beside them belongs to it too.
PARTS = frozenset("p li ul ol dl dt dd table tbody thead tfoot tr td th span h1 h2 h3 h4 h5 h6 hgroup pre blockquote figure figcaption section details summary".split())
SIGMA = 1.0
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG_LIKE = re.compile(r"<[a-zA-Z/!?]")
_RADIUS = 3
_KERNEL = np.exp(-(np.arange(-_RADIUS, _RADIUS + 1) ** 2) / (2 * SIGMA**2))
_KERNEL /= _KERNEL.sum()


def _is_mark(token: str, tag: str) -> bool:
    if token.lower() in MARKS:
        return True
    if tag not in CONTAINERS:
        return False
    words = [w.lower() for w in _WORDS.findall(token) if len(w) > 1]
    if not words or ABOUT.intersection(words):
        return False
    if ANYWHERE.intersection(words) and not ARTICLE.intersection(words):
        return True
    return words[-1] in LAST or (words[0] in OF_SITE and words[-1] == "header") or (words[0] in MARKS and all(w in AFTER for w in words[1:]))


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in HEADINGS and any(_is_mark(t, tag) for t in value.split()):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


class Lines(HTMLParser):
    """Collects a page's lines and the tree of its block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.region = ["#page"], [0], [0]
        self.hard, self.soft, self.inline = [False], [False], [False]  # skipped by tag, by a mark; an inline element
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}  # depths in the stack of the open elements of each tag
        self.hidden = 0  # open inline elements whose text goes; they don't end a block
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.owner: list[int] = []
        self._data: list[str] = []
        self._count = 0
        self._unclosed = False

    def line(self) -> None:
        if self._data and not self.hidden:
            text = " ".join("".join(self._data).split())
            if text:
                self.texts.append(text)
                self.tags.append(self._count)
                self.owner.append(self.stack[-1])
                self._count = 0
            self._data.clear()

    def read(self, page: str) -> None:
        """The whole page. What follows the last ``>`` is text up to a tag that is not ended."""
        end = page.rfind(">") + 1
        self.feed(page[:end])
        self.close()
        tail = page[end:]
        if tail and not self.cdata_elem and not self._unclosed:
            cut = _TAG_LIKE.search(tail)
            self.handle_data(unescape(tail[: cut.start()] if cut else tail))
        self.line()

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that is not ended takes the rest of the page."""
        if not self._unclosed:
            end = self.rawdata.find("-->", i + 2)
            if end >= 0:
                return end + 3
            self._unclosed = True
        return len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Declarations and marked sections, whatever their names, end at the next ``>``."""
        return self.rawdata.find(">", i) + 1 or -1

    def _pop(self, depth: int) -> None:
        """Closes the elements from this depth of the stack on."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.depths[self.tag[e]].pop()
            self.hidden -= self.inline[e]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        block = tag in BLOCKS
        if block:
            self.line()
        self._count += 1
        marked = bool(attrs) and tag not in ("html", "body", "main") and _marked(tag, attrs)
        if tag in VOID or not (block or tag in OPENED or marked or self.depths.get(tag)):
            return
        if block:
            depth = len(self.stack) - 1
            while self.inline[self.stack[depth]] and self.tag[self.stack[depth]] not in OPENED:
                depth -= 1
            own = self.tag[self.stack[depth]]
            if own == "p" or (tag == "li" and own == "li"):
                self._pop(depth)
                self.line()
        top = self.stack[-1]
        inside = self.region[top]
        if marked and inside and tag not in REGIONS and any(n in ("class", "id") and v and v.lower() == "header" for n, v in attrs):
            marked = False  # as with the tag: an article's own
        self.tag.append(tag)
        self.parent.append(top)
        self.hard.append(tag in SKIPPED or (tag == "header" and not inside))
        self.soft.append(marked)
        self.inline.append(not block and (marked or tag in OPENED))
        self.region.append(len(self.tag) - 1 if tag in REGIONS and not inside else inside)
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        self.hidden += self.inline[-1]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.line()
        self._count += 1
        open_ = self.depths.get(tag)
        if not open_:
            return
        barrier = max((self.depths[r][-1] for r in REGIONS if self.depths.get(r)), default=0)
        if open_[-1] < barrier and tag not in ("body", "html", "main", "article"):
            return  # a stray end tag doesn't leave the article
        self._pop(open_[-1])
        if tag in BLOCKS:
            self.line()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._data.append(data)

    def skipped(self) -> list[bool]:
        """Per element, whether its text goes. The only main or article, and what it stands in, is never marked."""
        for region in ("main", "article"):
            aside = [False] * len(self.tag)
            for e in range(1, len(self.tag)):
                aside[e] = aside[self.parent[e]] or (self.hard[e] and self.tag[e] != "form")
            found = [e for e, t in enumerate(self.tag) if t == region and not aside[e]]
            if len(found) == 1:
                e = found[0]
                while e:
                    self.soft[e] = self.hard[e] = False
                    e = self.parent[e]
                break
        out = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            out[e] = out[self.parent[e]] or self.hard[e] or self.soft[e]
        return out


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian over neighbours; at the ends, over those that exist."""
    weight = np.convolve(np.ones_like(ratios), _KERNEL)[_RADIUS:-_RADIUS]
    return np.convolve(ratios, _KERNEL)[_RADIUS:-_RADIUS] / weight


def cluster(size: np.ndarray, tags: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which lines are content: kept ones whose smoothed ratio reaches the deviation of all; every kept one if none does."""
    smoothed = smooth(np.where(kept, size / np.maximum(1, tags), 0.0))
    content = kept & (smoothed >= min(smoothed.std(), smoothed.max()))
    return content if content.any() else kept


def _headed(page: Lines, kept: np.ndarray, inside: np.ndarray, root: int) -> int:
    """The line of the headline that stands before the region ``root`` below the same wrapper, or -1.

    It is the last kept h1 before the region's first line, unless the region has one of its own; what stands between them is the article's.
    """
    heads = [i for i, o in enumerate(page.owner) if kept[i] and page.tag[o] == "h1"]
    first = next(i for i, o in enumerate(page.owner) if inside[o])
    if not root or any(inside[page.owner[i]] for i in heads):
        return -1
    wrapper = page.parent[root]
    for i in reversed([i for i in heads if i < first]):
        e = page.owner[i]
        while e and e != wrapper:
            e = page.parent[e]
        return i if e == wrapper else -1
    return -1


def main_text(html: str | None) -> str:
    page = Lines()
    page.read(html or "")
    n = len(page.texts)
    if not n:
        return ""
    owner, skipped = page.owner, page.skipped()
    kept = np.array([not skipped[o] for o in owner])
    size = np.array([len(t) for t in page.texts], np.float64)
    content = cluster(size, np.array(page.tags, np.float64), kept)
    total = size[content].sum()
    if not total:
        return ""
    by_region: dict[int, float] = {}
    for i in np.flatnonzero(content):
        r = page.region[owner[i]]
        by_region[r] = by_region.get(r, 0.0) + size[i]
    regions = {r for r in by_region if r}
    if regions and sum(by_region[r] for r in regions) >= 0.5 * total:
        return "\n\n".join(t for t, o, k in zip(page.texts, owner, kept, strict=True) if k and page.region[o])
    held = np.zeros(len(page.tag), np.int64)
    np.add.at(held, [owner[i] for i in np.flatnonzero(content)], 1)
    for e in range(len(page.tag) - 1, 0, -1):  # children come after their parents
        held[page.parent[e]] += held[e]
    root = int(np.flatnonzero(held == held[0])[-1])
    if root and root not in page.parent[1:]:
        root = page.parent[root]
    while page.tag[root] in PARTS:
        root = page.parent[root]
    inside = np.zeros(len(page.tag), bool)
    inside[root] = True
    for e in range(1, len(page.tag)):
        inside[e] |= inside[page.parent[e]]
    head = _headed(page, kept, inside, root)
    last = max(i for i, o in enumerate(owner) if inside[o])
    return "\n\n".join(t for i, (t, o, k) in enumerate(zip(page.texts, owner, kept, strict=True)) if k and (inside[o] or 0 <= head <= i < last))


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).mapInArrow(run, RESULT)
