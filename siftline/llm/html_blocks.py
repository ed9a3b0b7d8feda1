"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is no text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements that hold menus, notices, forms and the like.
BOILERPLATE = {"nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "button", "select", "dialog", "object", "canvas", "audio", "video", "map", "menu", "head"}
#: Elements that begin and end a line.
BLOCKS = set(
    "address article aside blockquote body canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark what is not the article.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar sidenav rail widget "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations trending "
    "comment comments commentlist disqus respond replies copyright disclaimer pagination pager search contentinfo complementary".split()
)
#: Words that make a name one of a layout around something, as in has-sidebar.
LAYOUT = set("has with without no not is one two three hide show".split())
#: Words that may stand behind a hint in a name; behind others, as in related-work, it says what a text is about.
HOLDERS = set(
    "area articles bar block body bottom box button buttons card cards container content feed footer form header holder icons inner item items left "
    "links list message module news notice outer panel posts reading right row section slot stories strip stack text thread top unit wrap wrapper zone".split()
)
#: Times a page is cut anew because an element with a hint holds its main text.
SPARED = 8
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]{0,40})((?:[^'"<>]++|"[^"<>]*+"|'[^'<>]*+')*+)>|<[!?][^'"<>]*+>|<[!?/a-zA-Z]""", re.S
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]{0,40})")
NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Lines in a window, and the characters in one that make a surge.
WINDOW, SURGE = 3, 86


def names_waste(name: str) -> bool:
    """Whether one class, id or role name says boilerplate: a hint at its end or before a holder, and no word of layout."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or not LAYOUT.isdisjoint(words):
        return False
    return words[-1] in HINTS or words[-1] in HOLDERS and not HINTS.isdisjoint(words[:-1])


def unseen(attributes: str) -> bool:
    """Whether an element's attributes say that it is not shown."""
    for kind, *values in NAMES.findall(attributes):
        kind, value = kind.lower(), next((v for v in values if v), "")
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def hinted(attributes: str) -> bool:
    """Whether an element's attributes say that it is boilerplate or not shown."""
    if not attributes.strip():
        return False
    if unseen(attributes):
        return True
    for kind, *values in NAMES.findall(attributes):
        if kind.lower() in ("class", "id", "role") and any(names_waste(name) for name in next((v for v in values if v), "").split()):
            return True
    return False


class Ends:
    """Where tags end that MARKUP does not span: those with < or > in an attribute value, and those that are none.

    One pass from the page's end, made when first asked, so any number of unclosed quotes costs no more.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.marks: list[int] | None = None

    def of(self, start: int) -> tuple[int, bool]:
        """Place behind the tag whose ``<`` is at ``start``, and whether its quotes are closed; (-1, False) if it is text."""
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[\"'<>]", self.html)]
            self.ends = [-1] * (len(self.marks) + 1)
            self.bare = [-1] * (len(self.marks) + 1)  # as if quotes had no meaning
            double = single = out = bare = -1
            for k in range(len(self.marks) - 1, -1, -1):
                at = self.marks[k]
                mark = self.html[at]
                if mark == ">":
                    out = bare = at + 1
                elif mark == "<":
                    out = bare = -1
                elif mark == '"':
                    out, double = double, out
                else:
                    out, single = single, out
                self.ends[k], self.bare[k] = out, bare
        k = bisect_right(self.marks, start)
        return (self.ends[k], True) if self.ends[k] >= 0 else (self.bare[k], False)


class Lines:
    """Lines of a page: text, whether it stands in boilerplate, in an article, and its characters inside links."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool, int, bool]] = []
        self.hints: list[int] = []
        self.parts: list[str] = []
        self.linked = 0

    def close(self, waste: bool, article: bool, heading: bool, hint: int = -1) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            self.rows.append((text, waste, article, min(self.linked, len(text)), heading))
            self.hints.append(hint)
        self.parts, self.linked = [], 0


def lines_of(html: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[str, bool, bool, int, bool]], list[int]]:
    """Cut a page at block elements; also where the element begins whose class, id or role makes a line boilerplate, else -1.

    Elements left open end with the page, at an article, or, a paragraph, at the next block. Names of
    the elements that begin at ``spared`` are not looked at.
    """
    out, at, hint = Lines(), 0, -1

    def waste(attributes: str, begin: int) -> bool:
        return unseen(attributes) if begin in spared else hinted(attributes)

    skip, depth = "", 0  # the boilerplate element that is open, and how many of its name
    articles = links = 0
    heading = False
    lowered = None
    ends = Ends(html)
    while True:
        found = MARKUP.search(html, at)
        end, name, attributes = found.end() if found else 0, found and found[2], found and found[3]
        begin = found.start() if found else 0
        if found and len(found[0]) == 2:
            end, whole = ends.of(found.start())
            tag = whole and TAG.match(html, found.start())
            if tag:
                found, name, attributes = tag, tag[2], html[tag.end() : end - 1]
            elif end < 0:  # no tag: the sign is text
                end = found.start() + 1
                out.parts.append(html[at:end])
                out.linked += (end - at) if links else 0
                at = end
                continue
        text = html[at : found.start() if found else len(html)]
        if text:
            out.parts.append(text)
            if links:
                out.linked += len(text)
        if not found:
            break
        at = end
        if not name:
            continue
        name, closing = name.lower(), bool(found[1])
        if not closing and name in RAW:
            lowered = lowered if lowered is not None else html.lower() if html.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), html)
            end = lowered.find(f"</{name}", at)
            at = len(html) if end < 0 else end
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            out.parts.append(" ")
        if name in BLOCKS or name in BOILERPLATE:
            out.close(bool(skip), articles > 0, heading, hint)
            heading = name == "h1" and not closing
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip, hint = "", -1
                    continue
            if skip == "p" and name in BLOCKS or name in ("article", "main") and not closing and not waste(attributes, begin):
                skip, hint = "", -1
            else:
                continue
        if name in ("article", "main") and not waste(attributes, begin):
            articles = max(0, articles + (-1 if closing else 1))
        elif not closing and name not in VOID and name not in ("html", "body") and (name in BOILERPLATE or name == "header" and not articles or waste(attributes, begin)):
            skip, depth = name, 1
            hint = begin if name not in BOILERPLATE and name != "header" and not unseen(attributes) else -1
    out.close(bool(skip), articles > 0, heading, hint)
    return out.rows, out.hints


def page_lines(html: str) -> list[tuple[str, bool, bool, int, bool]]:
    """Lines of a page. A name decides nothing on the element that holds most of the text, if no text surges outside.

    Such an element is cut like any other, with what it holds looked at by itself, up to SPARED one in another.
    """
    spared: frozenset[int] = frozenset()
    while True:
        rows, hints = lines_of(html, spared)
        held: dict[int, int] = {}
        for row, hint in zip(rows, hints):
            if hint >= 0:
                held[hint] = held.get(hint, 0) + len(row[0])
        open_text = np.array([0 if row[1] or 2 * row[3] > len(row[0]) else len(row[0]) for row in rows], np.int64)
        if not held or len(spared) == SPARED or _surges(open_text):
            return rows
        most = max(held, key=held.__getitem__)
        if 2 * held[most] <= sum(held.values()) + int(open_text.sum()):
            return rows
        spared |= {most}


def _stretches(sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Lines with text from where a window reaches the bound of its first line to where a whole window is empty."""
    total = np.concatenate([[0], np.cumsum(np.append(sizes, np.zeros(WINDOW, np.int64)))])
    window = total[WINDOW : WINDOW + len(sizes)] - total[: len(sizes)]
    if not (window >= bounds).any():
        bounds = np.ones_like(bounds)
    keep, inside = np.zeros(len(sizes), bool), False
    for i in range(len(sizes)):
        inside = window[i] > 0 if inside else sizes[i] > 0 and window[i] >= bounds[i]
        keep[i] = inside and sizes[i] > 0
    return keep


def _surges(sizes: np.ndarray) -> bool:
    return bool((np.convolve(sizes, np.ones(WINDOW, np.int64)) >= SURGE).any())


def main_text(html: str | None) -> str:
    """The text between the surge and dive points of the line-block distribution.

    Elements of boilerplate by name count as empty unless they hold most of a page on which
    nothing else surges (``page_lines``). A line counts with its length; one in boilerplate or made of links counts as empty. A
    window sums WINDOW lines. Text begins where a window surges to SURGE characters (to any if
    no window has that many) and ends where a whole window is empty. An element that the page
    marks as article or main has weight: as long as it holds at least as much as what surges
    outside, its lines and those outside are dealt with by themselves, any text in it
    is a surge, and its links count. Marked elements that hold less are cards beside the main text and
    surge like any other. All such stretches are kept, with the heading right before the first.
    """
    if not html:
        return ""
    rows = page_lines(html)
    if not rows:
        return ""
    length = np.array([0 if waste else len(text) for text, waste, *_ in rows], np.int64)
    marked = np.array([article for _, _, article, _, _ in rows])
    linked = np.array([2 * links > len(text) for text, _, _, links, _ in rows])
    inner, outer = np.where(marked, length, 0), np.where(marked | linked, 0, length)
    surge = np.full(len(rows), SURGE)
    if inner.any():
        beside = _stretches(outer, surge) if _surges(outer) else np.zeros(len(rows), bool)
        if inner.sum() >= outer[beside].sum():
            keep = beside | _stretches(inner, np.ones_like(surge))
        else:
            keep = _stretches(np.where(linked, 0, length), surge)
    else:
        keep = _stretches(outer, surge)
    if keep.any():
        first = int(np.flatnonzero(keep)[0])
        if first and rows[first - 1][4] and not rows[first - 1][1]:
            keep[first - 1] = True
    return " ".join(rows[i][0] for i in np.flatnonzero(keep))


def extract(pages: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """Replace ``html`` by ``out``, the page's main text; empty for a null or empty page or one without text.

    Whole pages are read and the text is never cut. Other columns come back unchanged, except
    one that is named ``out``, which is replaced.
    """
    rest = [c for c in pages.columns if c not in (html, out)]
    schema = pages.select(*rest).schema.add(out, "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(html)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*rest, html).mapInArrow(run, schema)
