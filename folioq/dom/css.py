"""CSS selectors over dom.tree: compounds, attribute tests, structural pseudo-classes, four combinators, groups."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from folioq.dom.tree import Element

_PART = re.compile(r"""\s*(?P<comb>[>+~,])\s*|(?P<space>\s+)|(?P<tag>[\w*][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""")
Test = Callable[[Element], bool]


@dataclass(frozen=True)
class Selector:
    """Groups of chains; a chain is (combinator before, tests) from left to right."""

    groups: tuple[tuple[tuple[str, tuple[Test, ...]], ...], ...]

    def matches(self, e: Element) -> bool:
        for g in self.groups:
            if _chain(e, g, len(g) - 1):
                return True
        return False

    def select(self, root: Element) -> list[Element]:
        """All matching descendants in document order."""
        return [e for e in root.walk() if self.matches(e)]


def _chain(e: Element, chain, k: int) -> bool:
    comb, tests = chain[k]
    for t in tests:
        if not t(e):
            return False
    if k == 0:
        return True
    if comb == ">":
        return e.parent is not None and e.parent.tag[0] != "#" and _chain(e.parent, chain, k - 1)
    if comb in "+~":
        before = _before(e)
        return any(_chain(x, chain, k - 1) for x in (before[-1:] if comb == "+" else before))
    up = e.parent
    while up is not None and up.tag[0] != "#":
        if _chain(up, chain, k - 1):
            return True
        up = up.parent
    return False


def _before(e: Element) -> list[Element]:
    siblings = e.parent.elements() if e.parent else [e]
    return siblings[: next(k for k, x in enumerate(siblings) if x is e)]


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.strip().lower().replace(" ", "")
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", arg):
        a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        b = int(m[2] or 0)
        return lambda i: (i == b) if not a else (i - b) % a == 0 and (i - b) // a >= 0
    n = int(arg)
    return lambda i: i == n


def _pseudo(name: str, arg: str | None) -> Test:
    place = lambda e, same: [x for x in (e.parent.elements() if e.parent else [e]) if not same or x.tag == e.tag]
    at = lambda e, xs: next(k for k, x in enumerate(xs) if x is e) + 1
    if name in ("first-child", "first-of-type"):
        return lambda e: place(e, name.endswith("type"))[0] is e
    if name in ("last-child", "last-of-type"):
        return lambda e: place(e, name.endswith("type"))[-1] is e
    if name in ("only-child", "only-of-type"):
        return lambda e: len(place(e, name.endswith("type"))) == 1
    if name in ("nth-child", "nth-of-type"):
        fits = _nth(arg or "1")
        return lambda e: fits(at(e, place(e, name.endswith("type"))))
    if name in ("nth-last-child", "nth-last-of-type"):
        fits = _nth(arg or "1")
        return lambda e: fits(len(xs := place(e, name.endswith("type"))) + 1 - at(e, xs))
    if name == "not":
        inner = compiled(arg or "*")
        return lambda e: not inner.matches(e)
    if name == "has":
        inner = compiled(arg or "*")
        return lambda e: any(inner.matches(x) for x in e.walk())
    if name == "contains":
        needle = (arg or "").strip("\"'")
        return lambda e: needle in "".join(e.texts())
    if name == "empty":
        return lambda e: not e.children
    if name == "root":
        return lambda e: e.parent is not None and e.parent.tag == "#document"
    raise ValueError(f"unknown pseudo-class :{name}")


def _attribute(name: str, op: str | None, value: str | None) -> Test:
    want = (value or "").strip("\"'")
    get = lambda e: e.attrs.get(name)
    return {
        None: lambda e: get(e) is not None,
        "=": lambda e: get(e) == want,
        "~=": lambda e: want in (get(e) or "").split(),
        "|=": lambda e: get(e) == want or (get(e) or "").startswith(want + "-"),
        "^=": lambda e: bool(want) and (get(e) or "").startswith(want),
        "$=": lambda e: bool(want) and (get(e) or "").endswith(want),
        "*=": lambda e: bool(want) and want in (get(e) or ""),
    }[op]


def _tag(name: str) -> Test:
    return (lambda e: True) if name == "*" else (lambda e: e.tag == name.lower())


@lru_cache(maxsize=1024)
def compiled(text: str) -> Selector:
    """Raises ValueError where text is no selector."""
    groups, chain, tests, comb, at = [], [], [], " ", 0
    text = text.strip()
    if not text:
        raise ValueError("empty selector")
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"no selector: {text!r}")
        at = m.end()
        if m["comb"] or m["space"]:
            if not tests and not (m["comb"] and chain == [] and m["comb"] != ","):
                raise ValueError(f"no selector: {text!r}")
            if tests:
                chain.append((comb, tuple(tests)))
            tests, comb = [], m["comb"] or " "
            if comb == ",":
                groups.append(tuple(chain))
                chain, comb = [], " "
        elif m["tag"]:
            tests.append(_tag(m["tag"]))
        elif m["id"]:
            tests.append(lambda e, want=m["id"]: e.attrs.get("id") == want)
        elif m["cls"]:
            tests.append(lambda e, want=m["cls"]: want in e.attrs.get("class", "") and want in e.classes())
        elif m["attr"]:
            tests.append(_attribute(m["attr"].lower(), m["op"], m["val"]))
        else:
            tests.append(_pseudo(m["pseudo"].lower(), m["arg"]))
    if not tests:
        raise ValueError(f"no selector: {text!r}")
    chain.append((comb, tuple(tests)))
    groups.append(tuple(chain))
    return Selector(tuple(groups))


def select(root: Element, text: str) -> list[Element]:
    """What text selects below root; nothing where it is no selector."""
    try:
        return compiled(text).select(root)
    except ValueError:
        return []
