"""Which language a rule is in, and what surrounds it."""

from __future__ import annotations

import json

PREFIXES = {"@css:": "css", "@xpath:": "xpath", "@json:": "json", "@regex:": "regex", "js:": "js", "@js:": "js", "<js>": "js"}


def is_json(body: str) -> bool:
    body = body.strip()
    if body[:1] not in ("{", "["):
        return False
    try:
        json.loads(body)
    except ValueError:
        return False
    return True


def mode(rule: str, body: str = "") -> str:
    """An explicit prefix, then the rule's first characters, then whether the body is JSON."""
    rule = rule.strip()
    low = rule.lower()
    for prefix, kind in PREFIXES.items():
        if low.startswith(prefix):
            return kind
    if rule.startswith(("/", "./")):
        return "xpath"
    if rule.startswith(("$.", "$[")):
        return "json"
    if rule.startswith(":"):
        return "regex"
    return "json" if is_json(body) else "css"


def stripped(rule: str) -> str:
    rule = rule.strip()
    low = rule.lower()
    if low.startswith("<js>"):
        return rule[4:].removesuffix("</js>").strip()
    for prefix in PREFIXES:
        if low.startswith(prefix):
            return rule[len(prefix) :].strip()
    return rule.removeprefix(":") if rule.startswith(":") else rule


def ordered(rule: str) -> tuple[str, bool]:
    """The rule without its order flag, and whether that reverses the list."""
    rule = rule.strip()
    if rule.startswith("-"):
        return rule[1:].strip(), True
    return rule.removeprefix("+").strip(), False
