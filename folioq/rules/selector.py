"""The selector dialect: legacy names, children and text steps, index lists and ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from folioq.dom import css
from folioq.dom.tree import Element

_LEGACY_INDEX = re.compile(r"(?P<base>.*?)(?:(?P<sign>[.!])(?P<items>-?\d+(?::-?\d+)*))$", re.S)
_BRACKET = re.compile(r"(?P<base>.*?)\[\s*(?P<not>!?)\s*(?P<items>-?\d*\s*(?::\s*-?\d*\s*){0,2}(?:,\s*-?\d*\s*(?::\s*-?\d*\s*){0,2})*)\]$", re.S)


@dataclass(frozen=True)
class Range:
    """From start to end, both included; None stands for the list's own border."""

    start: int | None
    end: int | None
    step: int = 1


@dataclass(frozen=True)
class Indexes:
    items: tuple[int | Range, ...]
    exclude: bool = False

    def positions(self, n: int) -> list[int]:
        """Positions in a list of n, each once, in the order asked for."""
        out: dict[int, None] = {}
        for item in self.items:
            if isinstance(item, Range):
                out.update(dict.fromkeys(_span(item, n)))
            elif 0 <= (at := item + n if item < 0 else item) < n:
                out[at] = None
        return [k for k in range(n) if k not in out] if self.exclude else list(out)

    def of(self, items: list) -> list:
        return [items[k] for k in self.positions(len(items))]


def _span(r: Range, n: int) -> list[int]:
    if not n:
        return []
    at = lambda x, default: default if x is None else x + n if x < 0 else x
    start, end = at(r.start, 0), at(r.end, n - 1)
    if (start < 0 and end < 0) or (start >= n and end >= n):
        return []
    start, end = min(max(start, 0), n - 1), min(max(end, 0), n - 1)
    step = r.step if r.step > 0 else max(r.step + n, 1) if r.step and -r.step < n else 1
    return list(range(start, end + 1, step)) if start <= end else list(range(start, end - 1, -step))


@lru_cache(maxsize=4096)
def indexed(step: str) -> tuple[str, Indexes | None]:
    """A step's selector and its indexes: x[1,3], x[!0], x[-1:0], x.2, x!0:1."""
    step = step.strip()
    if (m := _BRACKET.match(step)) and m["items"].strip():
        items: list[int | Range] = []
        for part in m["items"].split(","):
            numbers = [int(x) if x.strip() else None for x in part.split(":")]
            if len(numbers) == 1:
                if numbers[0] is None:
                    return step, None
                items.append(numbers[0])
            else:
                items.append(Range(numbers[0], numbers[1], (numbers[2] if len(numbers) > 2 and numbers[2] is not None else 1)))
        return m["base"].strip(), Indexes(tuple(items), bool(m["not"]))
    if m := _LEGACY_INDEX.match(step):
        return m["base"].strip(), Indexes(tuple(int(x) for x in m["items"].split(":")), m["sign"] == "!")
    return step, None


@lru_cache(maxsize=4096)
def to_css(selector: str) -> str:
    """class.a b, id.x and tag.x as CSS; bare words of letters are classes, one alone is a tag."""
    s = selector.strip()
    if s.startswith("class."):
        return "".join(f".{w}" for w in s[6:].split())
    if s.startswith("id."):
        return f"#{s[3:].strip()}"
    if s.startswith("tag."):
        return s[4:].strip()
    words = s.split()
    if len(words) > 1 and all(re.fullmatch(r"[A-Za-z][\w-]*", w) for w in words):
        return "".join(f".{w}" for w in words)
    return s


def _own_text(e: Element) -> str:
    return "".join(c for c in e.children if isinstance(c, str))


def select(scope: Element, step: str) -> list[Element]:
    """What one step selects below scope, its indexes applied."""
    base, indexes = indexed(step)
    document = scope.tag == "#document"
    if base in ("", "children"):
        found = [] if document else scope.elements()
    elif base.startswith("text."):
        needle = base[5:]
        found = [e for e in ([] if document else [scope]) + list(scope.walk()) if needle in _own_text(e)]
    else:
        found = css.select(scope, to_css(base))
    return indexes.of(found) if indexes else found
