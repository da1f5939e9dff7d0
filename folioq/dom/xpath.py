"""The part of XPath 1.0 that rules use, over well-formed XML (others give nothing)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

_STEP = re.compile(r"(?P<axis>//|/)?(?P<test>@[\w:*-]+|text\(\)|node\(\)|\.\.|\.|\*|(?:(?P<name>following-sibling|preceding-sibling|ancestor|parent|self|descendant|child)::)?[\w:*-]+(?:\(\))?)(?P<preds>(?:\[(?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*\])*)")
_PRED = re.compile(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*)\]")


@dataclass(eq=False)
class Node:
    element: ET.Element
    parent: Node | None
    order: int

    def children(self, index: dict[int, Node]) -> list[Node]:
        return [index[id(c)] for c in self.element]


class Document:
    def __init__(self, xml: str):
        self.root = ET.fromstring(xml)
        self.nodes: list[Node] = []
        self.index: dict[int, Node] = {}
        stack: list[tuple[ET.Element, Node | None]] = [(self.root, None)]
        while stack:
            e, parent = stack.pop()
            node = Node(e, parent, len(self.nodes))
            self.nodes.append(node)
            self.index[id(e)] = node
            stack.extend((c, node) for c in reversed(list(e)))

    def below(self, node: Node | None) -> list[Node]:
        top = self.root if node is None else node.element
        return [self.index[id(e)] for e in top.iter()]


def parse(xml: str) -> Document | None:
    try:
        return Document(xml)
    except ET.ParseError:
        return None


def string_of(found: Node | str) -> str:
    return found if isinstance(found, str) else "".join(found.element.itertext())


def evaluate(document: Document, path: str, scope: Node | None = None) -> list[Node | str]:
    """A node set in document order, or one string for a function of it."""
    path = path.strip()
    if m := re.fullmatch(r"((?:string|count|normalize-space)\(.*\))\s*(!=|<=|>=|=|<|>)\s*(\d+(?:\.\d+)?|\"[^\"]*\"|'[^']*')", path, re.S):
        return [str(_compared(evaluate(document, m[1], scope)[0], m[2], m[3])).lower()]
    if m := re.fullmatch(r"(string|count|normalize-space)\((.*)\)", path, re.S):
        inner = evaluate(document, m[2], scope)
        if m[1] == "count":
            return [str(len(inner))]
        text = string_of(inner[0]) if inner else ""
        return [" ".join(text.split()) if m[1] == "normalize-space" else text]
    if "|" in path and not re.search(r"\[[^\]]*\|", path):
        union = [x for p in path.split("|") for x in evaluate(document, p, scope)]
        return sorted(dict.fromkeys(union), key=lambda x: x.order if isinstance(x, Node) else 1 << 60)
    at, now, first = 0, [scope], True
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return []
        at, axis, test = m.end(), m["axis"], m["test"]
        if first and axis:
            now = [None]
        first = False
        found: list[Node | str] = []
        for node in now:
            if isinstance(node, str):
                continue
            step = _select(document, node, axis, test)
            for pred in _PRED.findall(m["preds"] or ""):
                step = _kept(document, step, pred.strip())
            found.extend(step)
        now = list(dict.fromkeys(found)) if all(isinstance(x, Node) for x in found) else found
        if all(isinstance(x, Node) for x in now):
            now = sorted(now, key=lambda n: n.order)
    return [x for x in now if x is not None]


def _select(document: Document, node: Node | None, axis: str | None, test: str) -> list[Node | str]:
    if axis == "//":
        scopes = document.below(node)
    elif node is None:
        scopes = None
    else:
        scopes = [node]
    if test in (".", "self::*"):
        return scopes if scopes is not None else [document.index[id(document.root)]]
    if test == "..":
        return [n.parent for n in scopes or [] if n.parent]
    if test.startswith("@"):
        return [v for n in scopes or [] for k, v in n.element.attrib.items() if test[1:] in ("*", k)]
    if test == "text()":
        return [t for n in scopes or [] for t in [n.element.text, *(c.tail for c in n.element)] if t]
    kind, _, name = test.rpartition("::")
    same = lambda n: name in ("*", "node()") or n.element.tag.rpartition("}")[2] == name.rpartition(":")[2]
    if kind in ("following-sibling", "preceding-sibling"):
        out = []
        for n in scopes or []:
            line = n.parent.children(document.index) if n.parent else [n]
            k = next(i for i, x in enumerate(line) if x is n)
            out += [x for x in (line[k + 1 :] if kind[0] == "f" else line[:k][::-1]) if same(x)]
        return out
    if kind in ("parent", "ancestor"):
        out = []
        for n in scopes or []:
            up = n.parent
            while up:
                out += [up] * same(up)
                up = up.parent if kind == "ancestor" else None
        return out
    if kind == "descendant":
        return [x for n in scopes or [None] for x in document.below(n)[1:] if same(x)]
    if axis == "//":
        # each step's predicate counts within one parent
        tops = [document.index[id(document.root)]] if node is None else []
        return [x for x in tops + [c for n in scopes for c in n.children(document.index)] if same(x)]
    if scopes is None:
        return [n for n in [document.index[id(document.root)]] if same(n)]
    return [c for n in scopes for c in n.children(document.index) if same(c)]


def _kept(document: Document, nodes: list[Node | str], pred: str) -> list[Node | str]:
    groups: dict[int, list] = {}
    for n in nodes:
        groups.setdefault(id(n.parent) if isinstance(n, Node) else 0, []).append(n)
    if re.fullmatch(r"\d+", pred):
        return [g[int(pred) - 1] for g in groups.values() if 0 < int(pred) <= len(g)]
    if m := re.fullmatch(r"last\(\)(?:\s*-\s*(\d+))?", pred):
        back = int(m[1] or 0) + 1
        return [g[-back] for g in groups.values() if back <= len(g)]
    if m := re.fullmatch(r"position\(\)\s*(<=|>=|<|>|=)\s*(\d+)", pred):
        test = {"<": lambda i, n: i < n, ">": lambda i, n: i > n, "<=": lambda i, n: i <= n, ">=": lambda i, n: i >= n, "=": lambda i, n: i == n}[m[1]]
        return [x for g in groups.values() for i, x in enumerate(g, 1) if test(i, int(m[2]))]
    return [n for n in nodes if isinstance(n, Node) and _holds(document, n, pred)]


def _holds(document: Document, node: Node, pred: str) -> bool:
    for word, fold in ((" or ", any), (" and ", all)):
        if word in pred:
            return fold(_holds(document, node, p.strip()) for p in pred.split(word))
    if m := re.fullmatch(r"not\((.*)\)", pred, re.S):
        return not _holds(document, node, m[1].strip())
    if m := re.fullmatch(r"(contains|starts-with)\(\s*(.+?)\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)", pred, re.S):
        got = [string_of(x) for x in evaluate(document, m[2], node)]
        return any(m[3][1:-1] in g if m[1] == "contains" else g.startswith(m[3][1:-1]) for g in got)
    if m := re.fullmatch(r"(.+?)\s*(!=|=)\s*(\"[^\"]*\"|'[^']*'|\d+)", pred, re.S):
        got = [string_of(x) for x in evaluate(document, m[1], node)]
        want = m[3].strip("\"'")
        return any((g == want) == (m[2] == "=") for g in got)
    return bool(evaluate(document, pred, node))


def _compared(got: str, sign: str, want: str) -> bool:
    """A comparison of a function's value with a literal."""
    a, b = (got, want[1:-1]) if want[0] in "\"'" else (float(got), float(want))
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]


def strings(xml: str, path: str) -> list[str]:
    document = parse(xml)
    return [] if document is None else [s for x in evaluate(document, path) if (s := string_of(x).strip())]
