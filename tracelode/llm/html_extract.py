"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with the path of block tags
from the root. Blocks that their markup names as something else (menus, headers and footers of the page,
sidebars, notices, adverts, forms, reader comments, hidden parts) are put aside. For the rest, characters,
punctuation and link characters are added up for each path; their ratios to the path's blocks are smoothed
over neighbouring blocks in page order and fused into one score, the best path's being 1. Markup is one more
signal of the score: a path in article or main gains `MARKUP` times its part outside links, and where a page
has such a path, all others lose `AGAINST`. On every page the paths over the threshold are the content. The
content node is the deepest element that holds all of it; headings in that node, or in article or main, stay
whatever their path scores.

Pages are read one by one in tasks, no shuffle; time is linear in the page: paths are numbers, open elements
are found by tag, and a page whose quotes swallow all ends of tags is read on without regard to quotes.
Null or empty html: empty text. Broken markup: unclosed tags end with their parent (a link with the next
link), stray end tags are ignored, an unclosed script or comment lasts to the end, and a tag without an end
is text. Rows that repeat are read alike; null ids and urls pass through.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelode.session import ship_package

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

# Element names of HTML.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param", "keygen"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rp", "picture", "label",
}
_ASIDE = {
    "nav", "aside", "footer", "form", "button", "select", "option", "menu", "dialog", "noscript", "template", "script", "style", "head",
    "svg", "canvas", "iframe", "object", "audio", "video", "textarea", "input", "datalist", "fieldset", "noframes", "noembed", "xmp", "title",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
# Words of class and id names that tell a part from the article.
_MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer", "cookie", "cookies",
    "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "search", "login",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "skip", "copyright", "disclaimer", "paywall", "aside",
}
_HEAD_MARKS = {"topbar", "site-header", "page-header", "top-header", "main-header", "global-header"}
# A name with one of these tells what a part has about it ("has-sidebar"), not what it is.
_STATES = {"has", "no", "with", "without", "not", "is"}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
# A start tag ends an open element of these, up to the nearest of the containers.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
    "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
# Inline elements whose class names a language or style, not a part of the page.
_CODE = {"code", "kbd", "samp", "var", "tt"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Element:
    __slots__ = ("tag", "parent", "aside", "within", "path", "content", "inside")

    def __init__(self, tag: str, parent: _Element | None, aside: bool):
        self.tag, self.parent, self.aside = tag, parent, aside
        self.within = tag in ("article", "main") or parent is not None and parent.within
        self.path = self.content = 0
        self.inside = False


class _Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: _Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def _put_aside(tag: str, attributes: str, within: bool) -> bool:
    """Whether markup names the element as something other than the article it may stand in."""
    if tag in _ASIDE:
        return True
    if tag == "header" and not within:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True
    if found.get("role", "").lower() in _ROLES:
        return True
    if tag in ("body", "html", "article", "main"):
        names = found.get("class", "") if tag == "article" else ""
    elif tag in _CODE:
        names = ""
    else:
        names = f"{found.get('class', '')} {found.get('id', '')}"
    for name in names.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if set(parts) & _STATES:
            continue
        if set(parts) & _MARKS or not within and (name.lower() in _HEAD_MARKS or parts[:1] == ["header"]):
            return True
    return False


def _tokens(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, tag or None, whether it is an end tag, attributes); what a raw element holds is left out."""
    at = begin = 0
    quotes = True
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith(("<!--", "<![CDATA["), at):
            mark, skip = ("-->", 4) if page[at + 2] == "-" else ("]]>", 9)
            end = page.find(mark, at + skip)
            inner = "" if skip == 4 else page[at + 9 : end if end >= 0 else len(page)]
            yield page[begin:at], None, False, ""
            if inner:
                yield inner, None, False, ""
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        name = None if page.startswith(("<!", "<?"), at) else _NAME.match(page, at + 1)
        if name is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        start = name.end() if name else at + 2
        end = _tag_end(page, start) if name and quotes else page.find(">", start)
        if end < 0 and name and quotes:
            quotes, end = False, page.find(">", start)
        if end < 0:
            break
        before, begin = page[begin:at], end + 1
        at = begin
        if name is None:
            yield before, None, False, ""
            continue
        tag = name[2].lower()
        yield before, tag, bool(name[1]), page[start:end]
        if tag in _RAW and not name[1]:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = begin = close.end() if close else len(page)
    yield page[begin:], None, False, ""


def _tag_end(page: str, at: int) -> int:
    """Place of the next > outside of quotes, -1 without one. A quote that never ends counts as a letter."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return -1
        at = stop.end()
        if stop[0] == ">":
            return stop.start()
        close = page.find(stop[0], at)
        if close >= 0:
            at = close + 1


class _Reader:
    """Blocks and elements of one page, those put aside left out; elements in the order of their start tags."""

    def __init__(self, page: str):
        root = _Element("", None, False)
        self.elements, self.blocks = [root], []
        self.stack = [root]
        # Places in the stack of the open elements of each tag.
        self.opened: dict[str, list[int]] = defaultdict(list)
        self.paths: dict[tuple[int, str], int] = {}
        # Tag of the outermost open element that is put aside.
        self.aside_tag = ""
        self.parts: list[str] = []
        self.links = self.link_depth = 0
        # The block an inline element that is put aside interrupts: its element, parts, links, link depth.
        self.held: tuple[_Element, list[str], int, int] | None = None
        for text, tag, end, attributes in _tokens(page):
            self.add(text)
            if tag is None:
                continue
            if tag in _INLINE:
                self.inline(tag, end, attributes)
            elif tag == "br":
                self.parts.append("\n")
            elif tag not in ("wbr", "img"):
                self.block(tag, end, attributes)
        self.close_block()
        self.settle()

    def add(self, text: str) -> None:
        if text:
            decoded = html.unescape(text)
            self.parts.append(decoded)
            if self.link_depth:
                self.links += len(decoded.strip())

    def keep(self, element: _Element, parts: list[str], links: int) -> None:
        text = " ".join("".join(parts).split())
        if text:
            self.blocks.append(_Block(element, text, min(links, len(text))))

    def settle(self) -> None:
        """End the interrupted block, for its element was left by other means than the end tag."""
        if self.held is not None:
            self.keep(*self.held[:3])
            self.held = None

    def close_block(self) -> None:
        here = self.stack[-1]
        if not here.aside:
            self.settle()
            self.keep(here, self.parts, self.links)
        self.parts, self.links = [], 0

    def push(self, tag: str, aside: bool) -> None:
        here = self.stack[-1]
        element = _Element(tag, here, aside)
        if not aside:
            element.path = self.paths.setdefault((here.path, tag), len(self.paths) + 1)
            self.elements.append(element)
        elif not here.aside:
            self.aside_tag = tag
        self.opened[tag].append(len(self.stack))
        self.stack.append(element)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.opened[self.stack.pop().tag].pop()

    def leave(self, tags: set[str], stops: set[str]) -> None:
        """End the outermost open element of `tags` below the nearest of `stops`."""
        if not any(self.opened.get(t) for t in tags):
            return
        floor = max((self.opened[s][-1] for s in stops if self.opened.get(s)), default=0)
        found = [places[bisect_right(places, floor)] for t in tags if (places := self.opened.get(t)) and places[-1] > floor]
        if found:
            self.pop_to(min(found))

    def inline(self, tag: str, end: bool, attributes: str) -> None:
        """Inline elements are only open where they, or what they stand in, are put aside."""
        here = self.stack[-1]
        if here.aside:
            if tag != self.aside_tag:
                return
            if not end and tag != "a":
                self.push(tag, True)
                return
            self.pop_to(self.opened[tag][-1])
            here = self.stack[-1]
            if here.aside:
                return
            (_, self.parts, self.links, self.link_depth), self.held = self.held, None
            if end:
                return
        if not end and _put_aside(tag, attributes, here.within):
            self.settle()
            self.held = (here, self.parts, self.links, 0 if tag == "a" else self.link_depth)
            self.parts, self.links, self.link_depth = [], 0, 0
            self.push(tag, True)
        elif tag == "a":
            self.link_depth = 0 if end else 1

    def block(self, tag: str, end: bool, attributes: str) -> None:
        self.close_block()
        self.link_depth = 0
        if end:
            if self.opened.get(tag):
                self.pop_to(self.opened[tag][-1])
            return
        if tag in _RAW or tag in _VOID:
            return
        if tag in _ENDS_P:
            self.leave({"p"}, {"td", "th", "li", "blockquote", "div", "section", "article", "main", "body", "button"})
            if tag in _HEADINGS:
                self.leave(_HEADINGS, {"div", "section", "article", "main", "body", "td", "li", "header"})
        if tag in _ENDS:
            self.leave(*_ENDS[tag])
        if attributes.endswith("/") and tag in ("svg", "path"):
            return
        here = self.stack[-1]
        self.push(tag, here.aside or _put_aside(tag, attributes, here.within))


def read_blocks(page: str) -> list[_Block]:
    """Blocks of a page in order; those put aside are left out."""
    return _Reader(page).blocks


# What article and main add to a path's score (the best text ratio is 1), and what text beside them loses: with
# these, in an article only paths that are links for the most part go, and beside it only the best path stays.
MARKUP = 0.5
AGAINST = 0.85


def path_scores(blocks: list[_Block]) -> dict[int, float]:
    """Fused score of each path: smoothed characters and punctuation a block, less what is link text, and markup."""
    chars, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    within: dict[int, bool] = {}
    for block in blocks:
        path = block.element.path
        chars[path] += len(block.text)
        marks[path] += len(_PUNCTUATION.findall(block.text))
        links[path] += block.links
        count[path] += 1
        within[path] = block.element.within
    paths = [b.element.path for b in blocks]
    length = [chars[p] / count[p] for p in paths]
    signs = [marks[p] / count[p] for p in paths]

    def smooth(series: list[float]) -> list[float]:
        padded = [series[0], *series, series[-1]]
        return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:])]

    total: dict[int, float] = defaultdict(float)
    for path, a, b in zip(paths, smooth(length), smooth(signs)):
        total[path] += a * (1 + b)
    plain = {p: 1 - links[p] / chars[p] for p in total}
    ratios = {p: total[p] / count[p] * plain[p] for p in total}
    best = max(ratios.values())
    named = any(within.values())

    def markup(path: int) -> float:
        return MARKUP * plain[path] if within[path] else -AGAINST if named else 0.0

    return {p: (ratios[p] / best if best else 1.0) + markup(p) for p in ratios}


def main_text(page: str, threshold: float = 0.15) -> str:
    """Blocks of the content joined by blank lines. `threshold`: score a path needs."""
    read = _Reader(page)
    if not read.blocks:
        return ""
    scores = path_scores(read.blocks)
    for block in read.blocks:
        if scores[block.element.path] >= threshold:
            block.element.content += len(block.text)
    _mark_content_node(read.elements)
    kept = []
    for block in read.blocks:
        element = block.element
        if scores[element.path] >= threshold or element.tag in _HEADINGS and (element.inside or element.within):
            kept.append(block.text)
    return "\n\n".join(kept)


def _mark_content_node(elements: list[_Element]) -> None:
    """Mark what lies in the deepest element that holds all of the content; a single paragraph or the like counts as its parent."""
    for element in reversed(elements):
        if element.parent is not None:
            element.parent.content += element.content
    node, deeper = elements[0], True
    for element in elements[1:]:
        if deeper and element.parent is node and element.content == node.content:
            if element.tag in ("p", "li", "td", *_HEADINGS):
                deeper = False
            else:
                node = element
    node.inside = True
    for element in elements[1:]:
        element.inside = element is node or element.parent.inside


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of each row of `pages` (page_id, url, html)."""
    ship_package(pages.sparkSession)
    schema = pages.select("page_id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
