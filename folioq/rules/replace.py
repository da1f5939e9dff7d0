"""Regular expressions as the rules mean them: an invalid pattern changes nothing, and look-around is invalid."""

from __future__ import annotations

import re
from functools import lru_cache

_LOOKS = re.compile(r"(?<!\\)\((?:\?=|\?!|\?<=|\?<!)|(?<!\\)(?:\\\\)*\\[1-9]")
_GROUP = re.compile(r"\$(?:(\$)|\{(\w+)\}|(\w+))")


@lru_cache(maxsize=4096)
def pattern(text: str, flags: int = 0) -> re.Pattern | None:
    if _LOOKS.search(text):
        return None
    try:
        return re.compile(text, flags)
    except re.error:
        return None


def expanded(m: re.Match, replacement: str) -> str:
    """$1, ${1} and $name; a group that isn't there gives nothing, $$ a dollar."""

    def put(g: re.Match) -> str:
        if g[1]:
            return "$"
        name = g[2] or g[3]
        try:
            return m[int(name) if name.isdigit() else name] or ""
        except (IndexError, error):
            return ""

    error = re.error
    return _GROUP.sub(put, replacement)


def replaced(text: str, find: str, replacement: str, once: bool = False, flags: int = 0) -> str:
    p = pattern(find, flags)
    return text if p is None else p.sub(lambda m: expanded(m, replacement), text, count=1 if once else 0)


def chain(rule: str) -> tuple[str, list[tuple[str, str]], bool]:
    """rule##find##replacement...: the rule, its pairs, and whether the last pair replaces one match only (###)."""
    head, *rest = rule.split("##") if "###" not in rule[-3:] else rule[:-3].split("##")
    once = rule.endswith("###") and bool(rest)
    pairs = [(rest[k], rest[k + 1]) for k in range(0, len(rest) - 1, 2)]
    return head, pairs, once


def chained(text: str, pairs: list[tuple[str, str]], once: bool) -> str:
    for k, (find, replacement) in enumerate(pairs):
        text = replaced(text, find, replacement, once and k == len(pairs) - 1)
    return text
