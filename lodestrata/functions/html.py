"""HTML pages as markdown, text or minimal HTML.

The tree is built from the standard library's tokens. Void elements have no content; a p, li, td, th, tr, dt, dd or
option ends where another one, or its parent's end, begins; a p ends where a block begins. An end tag without a
start is ignored, and an element that is never closed ends with its parent: formatting such as <b> that is left open
in a paragraph is not opened again in the next.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("markdown", "text", "minimal")
# What counts as noise, and what survives of attributes.
NOISE_TAGS = ("script", "style", "noscript", "svg", "iframe", "head", "nav", "header", "footer", "aside")
MINIMAL_TAGS = ("script", "style", "noscript", "svg", "iframe", "head")
NOISE_NAMES = re.compile(r"cookie|consent|gdpr|sidebar|nav|menu|ad-|ads|social|share|popup|modal|banner|promo", re.I)
KEPT_ATTRIBUTES = {"a": ("href",), "img": ("alt", "src")}
SKIPPED_LINES = ("[Skip to content]", "[](", "![](")
PILCROW = "¶"

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends open elements of these names, as far as the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str | None] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        waiting = [self]
        while waiting:
            e = waiting.pop()
            if e is not self:
                yield e
            waiting += [c for c in reversed(e.children) if isinstance(c, Element)]

    def texts(self) -> Iterator[str]:
        waiting: list[Element | str] = [self]
        while waiting:
            e = waiting.pop()
            if isinstance(e, Element):
                waiting += reversed(e.children)
            else:
                yield e

    @property
    def text(self) -> str:
        return "".join(self.texts()).strip()

    def without(self, unwanted) -> Element:
        """A copy that lacks the elements, with all below them, for which unwanted holds."""
        out = Element(self.tag, dict(self.attributes))
        waiting = [(self, out)]
        while waiting:
            e, copy = waiting.pop()
            for child in e.children:
                if not isinstance(child, Element):
                    copy.children.append(child)
                elif not unwanted(child):
                    copy.children.append(Element(child.tag, dict(child.attributes)))
                    waiting.append((child, copy.children[-1]))
        return out

    def first(self, tag: str) -> Element | None:
        return next((e for e in self.elements() if e.tag == tag), None)

    def html(self) -> str:
        out: list[str] = []
        waiting: list[Element | str] = [self]  # strings are done
        while waiting:
            e = waiting.pop()
            if not isinstance(e, Element):
                out.append(e)
                continue
            if e.tag != "#root":
                told = "".join(f" {k}" if v is None else f' {k}="{entities.escape(v)}"' for k, v in e.attributes.items())
                out.append(f"<{e.tag}{told}>")
                if e.tag in VOID:
                    continue
                waiting.append(f"</{e.tag}>")
            raw = e.tag in ("script", "style")
            waiting += [c if raw or isinstance(c, Element) else entities.escape(c, quote=False) for c in reversed(e.children)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]
        self.counts: Counter[str] = Counter()  # of open elements by name, so that deep pages are not searched in vain

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and tag != "body":
            self._end("p", {"table", "td", "th", "button"})
        if tag in ENDS:
            names, limits = ENDS[tag]
            if any(self.counts[n] for n in names):
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k].tag in limits:
                        break
                    if self.open[k].tag in names:
                        self._cut(k)
        found = Element(tag, dict(attrs))
        self.open[-1].children.append(found)
        if tag not in VOID:
            self.open.append(found)
            self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, set())

    def _cut(self, k: int) -> None:
        self.counts.subtract(e.tag for e in self.open[k:])
        del self.open[k:]

    def _end(self, tag: str, limits: set[str]) -> None:
        if not self.counts[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in limits:
                return
            if self.open[k].tag == tag:
                self._cut(k)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _noisy(e: Element) -> bool:
    named = any(NOISE_NAMES.search(e.attributes.get(k) or "") for k in ("class", "id"))
    return e.tag in NOISE_TAGS or (named and e.tag not in ("html", "body"))


def strip_noise(html: str) -> Element:
    """The tree without noise elements and comments, with the attributes that matter."""
    clean = parse(html).without(_noisy)
    for e in clean.elements():
        if e.tag not in ("html", "body"):
            e.attributes = {k: v for k, v in e.attributes.items() if k in KEPT_ATTRIBUTES.get(e.tag, ())}
    return clean


def _squeezed(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text))


def _blocks(e: Element) -> list[str]:
    """The lines of what is below e. Elements that only hold others are entered; a quotation is told when it ends."""
    open_ones: list[tuple[Element, Iterator, list[str]]] = [(e, iter(e.children), [])]
    while True:
        parent, children, lines = open_ones[-1]
        child = next(children, None)
        if child is None:
            open_ones.pop()
            if not open_ones:
                return lines
            above = open_ones[-1][2]
            if parent.tag == "blockquote":
                said = " ".join(lines).strip()
                above += [f"> {said}"] if said else []
        elif not isinstance(child, Element):
            lines += [said] if (said := child.strip()) else []
        elif (own := _own_lines(child)) is not None:
            lines += own
        else:
            open_ones.append((child, iter(child.children), [] if child.tag == "blockquote" else lines))


def _list(e: Element) -> Iterator[str]:
    n = 0
    for item in e.children:
        if isinstance(item, Element) and item.tag == "li" and (said := item.text):
            n += 1
            yield f"{n}. {said}" if e.tag == "ol" else f"- {said}"


def _table(e: Element) -> Iterator[str]:
    rows = [[c for c in tr.elements() if c.tag in ("td", "th")] for tr in e.elements() if tr.tag == "tr"]
    rows = [r for r in rows if r]
    header = next((k for k, r in enumerate(rows) if any(c.tag == "th" for c in r)), 0)
    for k, row in enumerate(rows):
        yield "| " + " | ".join(c.text for c in row) + " |"
        if k == header:
            yield "| " + " | ".join(["---"] * len(row)) + " |"


def _own_lines(e: Element) -> list[str] | None:
    """An element's markdown; None for those that are told by what they hold."""
    tag = e.tag
    if tag in ("script", "style", "head"):
        return []
    if tag == "img":
        return [f"![{e.attributes.get('alt') or ''}]({e.attributes.get('src') or ''})"]
    if tag in ("ul", "ol"):
        return list(_list(e))
    if tag == "table":
        return list(_table(e))
    if tag not in WRAPPED and tag not in ("a", "li", "pre", "code"):
        return None
    if not (said := e.text):
        return []
    if tag == "a":
        return [f"[{said}]({e.attributes.get('href') or ''})"]
    if tag in ("pre", "code"):
        return [f"```\n{said}\n```"]
    before, after = WRAPPED.get(tag, ("- ", ""))
    return [f"{before}{said}{after}"]


WRAPPED = {f"h{n}": ("#" * n + " ", "") for n in range(1, 7)} | {"strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*")}


def polished(markdown: str) -> str:
    lines = (line for line in markdown.splitlines() if not line.strip().startswith(SKIPPED_LINES))
    return "\n".join(line.replace(PILCROW, "") for line in lines).strip()


def clean_html(html: str | None, mode: str = "markdown") -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    if not html or not html.strip():
        return ""
    if mode == "minimal":
        clean = parse(html).without(lambda e: e.tag in MINIMAL_TAGS)
        return (clean.first("body") or clean).html().strip()
    clean = parse(_squeezed(strip_noise(html).html()).strip())
    if mode == "markdown":
        return polished("\n".join(_blocks(clean)).strip())
    text = _squeezed("\n".join((clean.first("body") or clean).texts()))
    return re.sub(r" *\n *", "\n", text).strip()


def clean_html_column(html: Column, mode: str = "markdown") -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")

    @F.pandas_udf(T.StringType())
    def clean(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: clean_html(page, mode))

    return clean(html)


def without_elements(html: Column, tags: tuple[str, ...] = ("script", "style", "head", "nav", "footer")) -> Column:
    """Well-formed elements of these names cut out by pattern, without Python: a fast first pass over large pages."""
    out = html
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}>", "")
    return out
