"""Main text of web pages from parser events and text-to-tag ratios.

A page is read once as a stream of standard-library parser events. Text between
block tags is a line; a line's ratio is its text length over the tags around
it. Ratios are smoothed with a Gaussian kernel; lines over one deviation form
the content clusters. The articles that hold them are the content regions, or,
on a page without, the lowest element that holds them all.
All lines of a content region are kept, short ones too, except those in
elements that say they are something else (menus, adverts, forms, comments).
A class says so by its last word or, for words of one meaning, by its first; an
id by its whole or by a last word of one meaning. It says nothing on a heading,
around an article or around most of the page's dense text. Inside a region the
ratios decide about words of several meanings; comments, adverts and the like
stay out. A form is left out unless it holds an article or most of the page. Of
several regions those with less than half the dense text of the largest go.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import table
from graftwork.llm.registry import query

# Fixed values of HTML: elements without content, inline elements, elements that are never running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none".split()
)
SKIPPED = frozenset(
    "head title script style noscript template iframe object svg canvas audio video nav footer aside button "
    "select textarea input dialog menu label datalist annotation annotation-xml".split()
)
REGIONS = frozenset(["article", "main"])
HOLDERS = frozenset("body main article section div td th blockquote center".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
LABELS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert announcement disclaimer copyright sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar social share sharing related recommended recommendations newsletter subscribe "
    "subscription signup login search popup modal overlay widget pagination pager toolbar skip".split()
)
HEADERS = frozenset(["header"])
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)

# Labels of one meaning, also as the first word of a class or the last of an id.
SURE = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr "
    "sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead newsletter subscribe pagination pager popup "
    "modal".split()
)
# Words that a label may come with: "cookie-box" and "ad-slot-top" are labels.
FRAMES = frozenset(
    "area bar block body bottom box buttons container content form group inner item items left links list middle outer "
    "panel right section slot thread top unit widgets wrap wrapper".split()
)
# Words of a state: "has-sidebar" and "comments-open" are no labels.
STATES = frozenset("has hide is js no show with without".split())
SETTINGS = frozenset("closed disabled enabled off on open".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
KERNEL /= KERNEL.sum()


class _Element:
    __slots__ = ("holder", "labels", "link", "number", "region", "skipped", "tag")

    def __init__(self, tag, number, skipped, region, holder, link, labels):
        self.tag, self.number, self.skipped = tag, number, skipped
        self.region, self.holder, self.link, self.labels = region, holder, link, labels


class _Label:
    """An element that says by its class, id or tag that it is not main text."""

    __slots__ = ("dense", "holds_region", "kind", "size")

    def __init__(self, kind: str):
        self.kind, self.holds_region = kind, False
        self.size = self.dense = 0

    def is_text(self, size: int, dense: int) -> bool:
        """Whether its lines count as any other, by the size of all lines and all dense lines of the page."""
        if self.kind == "comments":
            return 0 < self.dense == dense
        if self.kind == "unsure":
            return 2 * self.dense > self.size
        most = 2 * self.dense > dense
        return self.holds_region or (most and (self.kind != "form" or 2 * self.size > size))


def label_words(value: str, is_id: bool = False) -> set[str]:
    """Labels among the tokens of a class or id.

    A token is a label if all its words are labels or frames; a class also if
    its last word but for frames is a label or its first one a sure label, an
    id if the last one is a sure label. Tokens that name a state are none.
    """
    found: set[str] = set()
    for token in value.split():
        own = [w.lower() for w in WORD.findall(token) if not w.isdigit()]
        if not own or own[0] in STATES or own[-1] in SETTINGS:
            continue
        if LABELS | HEADERS | FRAMES >= set(own):
            found |= set(own) - FRAMES
            continue
        while own[-1] in FRAMES:
            own.pop()
        found |= {own[-1]} & (SURE if is_id else LABELS)
        if not is_id:
            found |= {own[0]} & SURE
    return found


class _Lines(HTMLParser):
    """Collects ``(text, tags, linked, region, holder, labels)`` per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, tuple[_Label, ...]]] = []
        self.stack = [_Element("", 0, False, 0, 0, False, ())]
        self.parts: list[str] = []
        self.above = {0: 0}  # holder to the holder around it; numbers grow inwards
        self.tags = self.linked = self.count = 0

    def _is_boilerplate(self, tag: str, attrs: list, region: int) -> bool:
        if tag in SKIPPED or (tag in HEADERS and not region):
            return True
        for name, value in attrs:
            value = value or ""
            if (
                name == "hidden"
                or (name == "aria-hidden" and value == "true")
                or (name == "role" and value.lower() in ROLES)
                or (name == "style" and "display:none" in value.replace(" ", "").lower())
            ):
                return tag not in ("html", "body")
        return False

    def _label(self, tag: str, attrs: list, region: int) -> _Label | None:
        if tag in HEADINGS or tag in ("html", "body", "main"):
            return None
        labels: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id"):
                labels |= label_words(value or "", name == "id")
        labels &= COMMENTS if tag == "article" else LABELS if region else LABELS | HEADERS
        if labels & COMMENTS:
            return _Label("comments")
        if tag == "form":
            return _Label("form")
        if not labels:
            return None
        return _Label("unsure" if region and not labels & SURE else "sure")

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.lines.append((text, self.tags, self.linked, top.region, top.holder, top.labels))
        if text or self.parts:
            self.tags = 0
        self.parts, self.linked = [], 0

    def _close(self, depth: int) -> None:
        self._end_line()
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.tags += 1
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self._end_line()
            closes = CLOSES_ITSELF.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for depth in range(len(self.stack) - 1, 0, -1):
                open_tag = self.stack[depth].tag
                if open_tag in closes:
                    self._close(depth)
                    break
                if open_tag not in INLINE and open_tag not in ("td", "th"):
                    break
        self.tags += 1
        if tag in VOID:
            return
        self.count += 1
        above = self.stack[-1]
        region = self.count if tag in REGIONS and not above.region else above.region
        label = self._label(tag, attrs, above.region)
        if tag in REGIONS and label is None and not above.region:
            for around in above.labels:
                around.holds_region = True
        if tag in HOLDERS:
            self.above[self.count] = above.holder
        self.stack.append(
            _Element(
                tag,
                self.count,
                above.skipped or self._is_boilerplate(tag, attrs, above.region),
                region,
                self.count if tag in HOLDERS else above.holder,
                above.link or tag == "a",
                (*above.labels, label) if label else above.labels,
            )
        )

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                if tag in INLINE:
                    del self.stack[depth]
                else:
                    self._close(depth)
                return
            if tag in INLINE and self.stack[depth].tag not in INLINE:
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.skipped:
            self.parts.append(data)
            if top.link:
                self.linked += len(data)


def dense_lines(lines: list[tuple]) -> tuple[np.ndarray, np.ndarray, float]:
    """Own ratios, smoothed ratios and the threshold of one deviation."""
    ratios = np.array([max(0, len(line[0]) - line[2]) / max(1, line[1]) for line in lines])
    smooth = np.convolve(np.pad(ratios, 2, mode="edge"), KERNEL, mode="valid")
    return ratios, smooth, min(smooth.std(), smooth.max())


def unlabelled(lines: list[tuple]) -> list[tuple]:
    """Lines that are in no element whose label holds."""
    if not any(line[5] for line in lines):
        return lines
    ratios, smooth, least = dense_lines(lines)
    size = dense = 0
    for line, good in zip(lines, (smooth >= least) & (ratios >= least) & (ratios > 0), strict=True):
        size += len(line[0])
        dense += len(line[0]) * bool(good)
        for label in line[5]:
            label.size += len(line[0])
            label.dense += len(line[0]) * bool(good)
    return [line for line in lines if all(label.is_text(size, dense) for label in line[5])]


def lowest_common(holders: set[int], above: dict[int, int]) -> int:
    """The innermost holder around all ``holders``."""
    left, heap = set(holders), [-h for h in holders]
    heapq.heapify(heap)
    while len(left) > 1:
        inner = -heapq.heappop(heap)
        left.remove(inner)
        if above[inner] not in left:
            left.add(above[inner])
            heapq.heappush(heap, -above[inner])
    return left.pop()


def content_lines(lines: list[tuple], above: dict[int, int]) -> list[str]:
    """The lines of the content regions, in page order."""
    lines = unlabelled(lines)
    if not lines:
        return []
    ratios, smooth, least = dense_lines(lines)
    over = (smooth >= least) & (ratios > 0)
    if not over.any():
        over[:] = True
    regions: dict[int, int] = {}
    for line, good in zip(lines, over, strict=True):
        if good and line[3]:
            regions[line[3]] = regions.get(line[3], 0) + len(line[0])
    if regions:
        largest = max(regions.values())
        return [line[0] for line in lines if 2 * regions.get(line[3], 0) >= largest]
    container = lowest_common({line[4] for line, good in zip(lines, over, strict=True) if good}, above)
    inside = {container}
    for holder, around in above.items():  # outer ones come first
        if around in inside:
            inside.add(holder)
    return [line[0] for line in lines if line[4] in inside]


def main_text(html: str | None) -> str:
    """Blocks of the article, each with single spaces, joined by a space."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    return " ".join(content_lines(parser.lines, parser.above))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row; a null or empty page has empty text.

    Rows are kept as they are, repeated ones too; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            cols = [
                batch.column("id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
