"""Operator 12: the main text of a web page, by smoothed text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each block of text, each with the
number of tags since the line before. A line's ratio is its characters over its tags; ratios are smoothed by a
Gaussian along the page, and lines at or above one standard deviation of them, or above the border between their two
clusters if that is lower, are seeds. The region is the element that holds nearly all seeds. Of its lines go
those in menus, headers, footers, sidebars, forms and other marked elements, and blocks at its side that hold no seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template title head svg math iframe object audio video canvas select datalist textarea button".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are never the article's.
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
#: Where a region may end: elements that hold blocks.
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "tr", "tbody", "table", "center", "form", "details", "blockquote"}
_ROWS = {"tr", "tbody", "tfoot"}
#: An open element of the first name ends where one of the others begins.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": _ROWS, "td": {"td", "th"} | _ROWS, "th": {"td", "th"} | _ROWS, "option": {"option", "optgroup"}, "head": {"body"}}
#: What keeps an inner element from ending an outer one.
BORDERS = CONTAINERS | {"ul", "ol", "dl", "select", "menu", "nav"}
#: Parts of a table, which a row or a cell may end several of.
TABLED = {"td", "th", "tr", "tbody", "tfoot"}

# Names that pages give to what surrounds an article, as words of class and id.
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright footer gdpr header masthead menu metadata modal nav navbar navigation newsletter notice notices "
    "overlay pager paginator pagination popup promo promoted promotion recommended related rail share sharing sidebar skip social sponsor sponsored subscribe subscription syndication teaser toc toolbar topbar widget".split()
)
REPLIES = set("comment comments commentlist disqus discussion replies reply respond response responses".split())
NO = {"has", "with", "no", "without", "not", "hide"}
WORD = re.compile(r"[a-z]+|[0-9]+")
CUT = re.compile(r"<[!/?a-zA-Z]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def mark(attrs: list[tuple[str, str | None]]) -> str:
    """What attributes say an element is: hidden, marked, replies or nothing."""
    at = {k: v or "" for k, v in attrs}
    if "hidden" in at or at.get("aria-hidden") == "true" or HIDDEN.search(at.get("style", "")):
        return "hidden"
    if at.get("role", "").lower() in ROLES or at.get("aria-modal") == "true":
        return "marked"
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if words and words[0] not in NO:
            if not REPLIES.isdisjoint(words):
                return "replies"
            if not MARKS.isdisjoint(words):
                return "marked"
    return ""


class Lines(HTMLParser):
    """Parser events to elements (name, parent, mark) and lines (element, text, tags, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.marks = ["html"], [-1], [""]
        self.open = [0]
        self.lines: list[tuple[int, str, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((self.open[-1], text, max(self.tags, 1), min(self.linked, len(text))))
            self.tags = 0
        self.text, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        for e in self.open[depth:]:
            self.silent -= self.names[e] in SILENT
            self.links -= self.names[e] == "a"
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in SILENT:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID or tag == "html":
            return
        if tag == "body" and "body" in (self.names[e] for e in self.open):
            return
        for d in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[d]]
            if tag in CLOSES.get(name, ()):
                self.close_to(d)
                break
            if name in BORDERS and not (name in TABLED and tag in TABLED):
                break
        if tag == "a" and self.links:
            # a link ends the one before
            for d in range(len(self.open) - 1, 0, -1):
                if self.names[self.open[d]] == "a":
                    self.close_inline(d)
                    break
        self.names.append(tag)
        self.parents.append(self.open[-1])
        self.marks.append(mark(attrs))
        self.open.append(len(self.names) - 1)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def close_inline(self, depth: int) -> None:
        self.links -= self.names[self.open[depth]] == "a"
        del self.open[depth]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.names[self.open[-1]] == tag:
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for d in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[d]]
            if name == tag:
                if tag in BLOCKS or tag in SILENT:
                    self.close_to(d)
                else:
                    self.close_inline(d)
                return
            if tag not in BLOCKS and name in BLOCKS or name in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finished(self, html: str) -> Lines:
        self.feed(html)
        if CUT.match(self.rawdata):  # a tag or comment that the page does not end
            self.rawdata = ""
        self.close()
        self.flush()
        return self


def smoothed(ratio: np.ndarray, width: float = 1.5) -> np.ndarray:
    """Gaussian mean of neighbouring lines, ends repeated."""
    reach = int(3 * width)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def border(values: np.ndarray) -> float:
    """Midway between two clusters of values: two means, from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(above):
            return low
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def seeds(lines: list[tuple[int, str, int, int]]) -> np.ndarray:
    """Whether the smoothed ratio of each line counts as content."""
    ratio = smoothed(np.array([len(text) / tags for _, text, tags, _ in lines]))
    return ratio >= min(float(ratio.std()), border(ratio))


def _under(own: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums over an element and all in it; an element comes after its parent."""
    out = own.copy()
    for e in range(len(parents) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def _dropped(page: Lines, level: int) -> np.ndarray:
    """Elements that go. level 2: by name, attributes and class; 1: by name and hidden ones; 0: none."""
    n = len(page.names)
    article = np.array([x in ("main", "article") for x in page.names])
    title = np.array([x in ("main", "h1") for x in page.names])
    holds_title, holds_article = _under(title.astype(int), page.parents), _under(article.astype(int), page.parents)
    gone, inside = np.zeros(n, bool), np.zeros(n, bool)
    for e in range(1, n):
        up, name, said = page.parents[e], page.names[e], page.marks[e]
        inside[e] = inside[up] or bool(article[e])
        own = level > 0 and (said == "hidden" or name in ASIDE and not (name == "form" and (holds_title[e] or holds_article[e])))
        if level > 1 and name not in ("html", "body", "main") and not holds_title[e]:
            own |= said == "replies" or said == "marked" and not holds_article[e]
        # the headings of an article's own header stay
        keeps = name in HEADINGS and inside[e] and page.names[up] in ("header", "hgroup") and inside[up] and not (page.parents[up] >= 0 and gone[page.parents[up]])
        gone[e] = own or gone[up] and not keeps
    return gone


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, white space folded, joined by line feeds. Empty where there is no text."""
    page = Lines().finished(html or "")
    lines, parents = page.lines, page.parents
    if not lines:
        return ""
    at = np.array([x[0] for x in lines])
    size = np.array([len(x[1]) for x in lines])
    seed = seeds(lines)
    for level in (2, 1, 0):
        stay = ~_dropped(page, level)[at]
        if stay.any():
            break
    if not (seed & stay).any():
        seed = stay
    mass, held = np.zeros(len(parents), np.int64), np.zeros(len(parents), np.int64)
    np.add.at(mass, at, np.where(seed & stay, size, 0))
    np.add.at(held, at, stay.astype(int))
    mass, held = _under(mass, parents), _under(held, parents)
    children: dict[int, list[int]] = {}
    for e in range(1, len(parents)):
        if mass[e]:
            children.setdefault(parents[e], []).append(e)
    # down to the smallest element that holds nearly all seeds; an article or a main element on the way is the region
    region, e = 0, 0
    while True:
        best = max(children.get(e, []), key=lambda c: mass[c], default=None)
        if best is None or mass[best] < 0.8 * mass[0] or page.names[best] not in CONTAINERS | ASIDE:
            break
        e = best
        if page.names[region] != "article":
            if not (page.names[region] == "main" and page.names[e] != "article"):
                region = e
        elif page.names[e] == "article":
            region = e
    out, inside = [], np.zeros(len(parents), bool)
    inside[region] = True
    for e in range(region + 1, len(parents)):
        inside[e] = inside[parents[e]]
    side = _sides(page, region, mass, held, at, size) if page.names[region] not in ("article", "main") else np.zeros(len(parents), bool)
    first = next((i for i in range(len(lines)) if inside[at[i]]), 0)
    for i, (e, text, _, _) in enumerate(lines):
        title = i < first and page.names[e] == "h1"
        if stay[i] and (title or inside[e] and not side[e]):
            out.append(text)
    return "\n".join(out)


def _sides(page: Lines, region: int, mass: np.ndarray, held: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Elements below blocks of a region that hold no seed, or hold links above all."""
    linked, chars = np.zeros(len(mass), np.int64), np.zeros(len(mass), np.int64)
    np.add.at(linked, at, [x[3] for x in page.lines])
    np.add.at(chars, at, size)
    linked, chars = _under(linked, page.parents), _under(chars, page.parents)
    side = np.zeros(len(mass), bool)
    for e in range(region + 1, len(mass)):
        up = page.parents[e]
        alone = up == region and page.names[e] in ("div", "section", "ul", "ol", "table", "dl", "center") and not mass[e]
        links = page.names[e] in ("div", "section", "ul", "ol", "table", "dl") and 2 * linked[e] > chars[e] > 0
        side[e] = side[up] or alone or links
    return side


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars for every row, each by itself.

    A null or empty page, and one without text, has the empty text. Cut or wrong markup is read as far as it goes: open elements end with the
    page. A page whose text lies in marked elements only keeps it, by element names alone first, then whole. Repeated and null ids are rows
    of their own; other columns are ignored.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, schema)
