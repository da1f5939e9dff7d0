"""A tolerant HTML tree on the standard library: void elements, implied end tags, raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the values, up to the nearest element of STOPS.
_CLOSES_P = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CLOSES: dict[str, frozenset[str]] = {t: frozenset(["p"]) for t in _CLOSES_P} | {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]),
    "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
STOPS = frozenset("table ul ol dl select div body html article section".split())


class Element:
    """An element; children are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Element | str] = []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            if e.children:
                stack.extend(e.elements()[::-1])

    def texts(self) -> Iterator[str]:
        """All text below, in document order."""
        stack: list[Element | str] = self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(c.children[::-1])

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def html(self) -> str:
        """The element with its own tag, as markup."""
        out: list[str] = []
        stack: list[Element | str] = [self]
        while stack:
            c = stack.pop()
            if isinstance(c, Element):
                out.append(f"<{c.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items()) + ">")
                if c.tag not in VOID:
                    stack.append(_End(c.tag))
                    stack.extend(c.children[::-1])
            else:
                raw = isinstance(c, _End)
                out.append(f"</{c}>" if raw else escape(c, quote=False))
        return "".join(out)


class _End(str):
    """An end tag on the stack of html()."""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = CLOSES.get(tag)
        if ends:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    del self.open[k:]
                    if tag not in ("tr", "tbody", "tfoot", "li", "dt", "dd"):
                        break
                elif self.open[k].tag in STOPS:
                    break
        parent = self.open[-1]
        e = Element(tag, {k: v or "" for k, v in attrs}, parent)
        parent.children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines and columns

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


#: Text, or a tag whose attributes are all quoted and without references.
_PLAIN = re.compile(r"""([^<]+)|<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z0-9_-]*=(?:"[^"&<>]*"|'[^'&<>]*'))*)[ \n]*/?)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose text parsers read otherwise: they are plain where that makes no difference.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_QUIET = re.compile(r"([^<&]*)</([a-zA-Z]+)>")


def _plain(html: str) -> Element | None:
    """The document of plain markup, without the parser's many steps; None for other markup."""
    builder, at = _Builder(), 0
    while at < len(html):
        m = _PLAIN.match(html, at)
        if not m:
            return None
        at = m.end()
        text, end, start, attrs = m.groups()
        if text:
            builder.handle_data(unescape(text) if "&" in text else text)
        elif end:
            builder.handle_endtag(end.lower())
        else:
            tag = start.lower()
            builder.handle_starttag(tag, [(k.lower(), a or b) for k, a, b in _ATTRIBUTE.findall(attrs)] if attrs else [])
            if tag in _RAW:
                m = _QUIET.match(html, at)
                if not m or m[2].lower() != tag or tag == "plaintext" or html[at - 2] == "/":
                    return None
                at = m.end()
                if m[1]:
                    builder.handle_data(m[1])
                builder.handle_endtag(tag)
    return builder.root


def parse(html: str) -> Element:
    """The document of any markup; never fails."""
    html = html or ""
    if (document := _plain(html)) is not None:
        return document
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
