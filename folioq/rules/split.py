"""Splitting rules at their top level: outside brackets and quotes, with backslashes skipping a character."""

from __future__ import annotations

from functools import lru_cache

_PAIRS = {"[": "]", "(": ")", "{": "}"}


@lru_cache(maxsize=4096)
def top_level(rule: str, marks: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    """Places of the marks (the longest that fits) that stand outside brackets and quotes: once for a rule, not for every row."""
    found, closing, quote, k = [], [], "", 0
    while k < len(rule):
        c = rule[k]
        if c == "\\":
            k += 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in _PAIRS:
            closing.append(_PAIRS[c])
        elif closing and c == closing[-1]:
            closing.pop()
        elif not closing and (mark := next((m for m in sorted(marks, key=len, reverse=True) if rule.startswith(m, k)), "")):
            found.append((k, mark))
            k += len(mark)
            continue
        k += 1
    return tuple(found)


def split(rule: str, mark: str) -> list[str]:
    out, begin = [], 0
    for at, m in top_level(rule, (mark,)):
        out.append(rule[begin:at])
        begin = at + len(m)
    return [*out, rule[begin:]]


def combined(rule: str) -> tuple[str, list[str]]:
    """The combinator that comes first and the rules between; "" for a single rule."""
    mark, rules = _combined(rule)
    return mark, [*rules]


@lru_cache(maxsize=4096)
def _combined(rule: str) -> tuple[str, tuple[str, ...]]:
    places = top_level(rule, ("&&", "||", "%%"))
    if not places:
        return "", (rule.strip(),)
    mark = places[0][1]
    return mark, tuple(p.strip() for p in split(rule, mark))


def steps(rule: str) -> list[str]:
    """The parts of an @ chain; @@ (a new parse) is no such mark."""
    return [*_steps(rule)]


@lru_cache(maxsize=4096)
def _steps(rule: str) -> tuple[str, ...]:
    out, begin = [], 0
    for at, m in top_level(rule, ("@", "@@")):
        if m == "@":
            out.append(rule[begin:at])
            begin = at + 1
    return tuple(p.strip() for p in [*out, rule[begin:]])


def parses(rule: str) -> list[str]:
    return [*_parses(rule)]


@lru_cache(maxsize=4096)
def _parses(rule: str) -> tuple[str, ...]:
    return tuple(p.strip() for p in split(rule, "@@"))


def merged(mark: str, lists: list[list]) -> list:
    """&& appends, || takes the first that isn't empty, %% deals out in turn (a longer list's rest stays)."""
    if mark == "||":
        return next((x for x in lists if x), [])
    if mark == "%%":
        return [x[k] for k in range(max(map(len, lists), default=0)) for x in lists if k < len(x)]
    return [y for x in lists for y in x]
