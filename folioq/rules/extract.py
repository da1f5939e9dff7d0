"""From elements to strings: extractors, @ chains, combinators, new parses."""

from __future__ import annotations

from folioq.dom.tree import Element, parse
from folioq.rules import selector
from folioq.rules.split import combined, merged, parses, steps

NAMES = ("text", "textNodes", "ownText", "html", "all")


def value(e: Element, name: str) -> str | None:
    """What an extractor takes from an element; absent and empty are the same."""
    name = name.strip()
    if name == "text":
        out = " ".join(t for x in e.texts() if (t := x.strip()))
    elif name == "textNodes":
        out = "\n".join(t for x in e.texts() if (t := x.strip()))
    elif name == "ownText":
        out = " ".join(t for c in e.children if isinstance(c, str) and (t := c.strip()))
    elif name in ("html", "all"):
        out = e.html()
    else:
        if name.startswith("attr[") and name.endswith("]"):
            name = name[5:-1]
        out = e.attrs.get(name.lstrip("@").lower(), "").strip()
    return out or None


def is_extractor(step: str) -> bool:
    return step in NAMES or step.startswith("attr[")


def items(document: Element, rule: str) -> list[Element]:
    """A list rule's elements: combinators hold, of a chain only the first step selects."""
    mark, rules = combined(rule.removeprefix("@css:"))
    return merged(mark, [selector.select(document, steps(r)[0]) for r in rules if r])


def _down(scopes: list[Element], path: list[str]) -> list[Element]:
    for step in path:
        scopes = [e for s in scopes for e in selector.select(s, step)]
    return scopes


def _chained(scopes: list[Element], path: list[str]) -> list[str]:
    """All but the last step select, at each level within every match so far; the last one extracts."""
    return [v for e in _down(scopes, path[:-1]) if (v := value(e, path[-1])) is not None]


def field(item: Element, rule: str) -> str | None:
    """An item's field: the last step is always an extractor; the first value counts."""
    mark, rules = combined(rule)
    found = merged(mark, [_first_parse(item, r) for r in rules if r])
    return (("\n".join(found) if mark else found[0]) or None) if found else None


def _first_parse(item: Element, rule: str) -> list[str]:
    first, *again = parses(rule)
    found = _chained([item], [s for s in steps(first) if s] or ["text"])[:1]
    return _again(found, again)


def _again(found: list[str], rules: list[str]) -> list[str]:
    """@@: each text is parsed anew as a document of its own."""
    for rule in rules:
        found = [v for text in found for v in _texts(parse(text), rule)]
    return found


def _texts(document: Element, rule: str) -> list[str]:
    first, *rest = [s for s in steps(rule) if s] or [""]
    if not rest and is_extractor(first):
        return [v for v in [value(document, first)] if v]
    matched = selector.select(document, first)
    return _chained(matched, rest) if rest else [v for e in matched if (v := value(e, "text"))]


def texts(document: Element, rule: str) -> list[str]:
    """A document's values: combinators, then new parses, then chains; a bare selector means its text."""
    mark, rules = combined(rule.removeprefix("@css:"))
    out = []
    for r in rules:
        first, *again = parses(r)
        out.append(_again(_texts(document, first), again) if r else [])
    return merged(mark, out)


def all_text(document: Element, rule: str) -> str | None:
    """Content: one selector and at most one extractor (textNodes if none), every match on lines of its own."""
    first, *rest = steps(rule.removeprefix("@css:"))
    found = [v for e in selector.select(document, first) if (v := value(e, rest[0] if rest else "textNodes"))]
    return "\n".join(found) or None
