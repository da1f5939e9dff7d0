"""Rule sets over one response: lists, fields, book info, chapters, content.

A script is run by the interpreter of `script`, with the library (jsLib) of its rules, unless a Python function of
(input, bindings) is given for its text. One that fails gives nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field as _field

from folioq.dom import jsonpath, xpath
from folioq.dom.tree import Element, parse
from folioq.rules import extract
from folioq.rules.links import resolve
from folioq.rules.modes import is_json, mode, ordered, stripped
from folioq.rules.replace import chain, chained, pattern
from folioq.rules.script import ScriptError, evaluated

Script = Callable[[str, Mapping[str, str]], object]
BOOK = ("name", "author", "kind", "wordCount", "lastChapter", "updateTime", "intro", "coverUrl", "bookUrl")
LINKS = frozenset({"coverUrl", "bookUrl", "tocUrl", "chapterUrl"})
FALSE = frozenset({"", "0", "false", "null", "none", "no", "off"})
_PUT = re.compile(r"@put:\{([^{}]*)\}")
_GET = re.compile(r"@get:\{([^{}]*)\}")
_TEMPLATE = re.compile(r"\{\{(.*?)\}\}", re.S)
_JS = re.compile(r"<js>(.*?)</js>|@js:(.*)$", re.S)


def truthy(text: str | None) -> bool:
    return (text or "").strip().lower() not in FALSE


@dataclass
class Context:
    """What the rules of one response share."""

    base: str = ""
    stored: dict[str, str] = _field(default_factory=dict)
    scripts: Mapping[str, Script] = _field(default_factory=dict)
    bindings: Mapping[str, str] = _field(default_factory=dict)
    library: str = ""

    def run(self, script: str, value: str, **more: object) -> str:
        got = self.scripts.get(script.strip())
        if got is None:
            known = {"baseUrl": self.base, "base_url": self.base, "url": self.base, **self.bindings, **more}
            try:
                return evaluated(script, value, known, self.library, self.stored)
            except ScriptError:
                return ""
        out = got(value, {"baseUrl": self.base, "result": value, **self.bindings, **more})
        return "" if out is None else out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)


Node = Element | xpath.Node | Mapping | list | tuple | str | int | float | None


@dataclass
class Scope:
    """A node of some kind, and how fields are taken from it."""

    kind: str  # css, xpath, json, regex
    node: object
    document: object = None
    whole: bool = False  # the document itself, not an item of a list

    def pick(self, rule: str) -> str | None:
        if self.kind == "css":
            if rule.startswith(("@xpath:", "@json:")) and not self.whole:
                return None
            rule = rule.removeprefix("@css:")
            if self.whole:
                found = extract.texts(self.node, rule)
                return found[0] if found else None
            return extract.field(self.node, rule)
        if self.kind == "xpath":
            rule = rule.removeprefix("@xpath:").strip()
            if self.document is None:
                return None
            found = [xpath.string_of(x).strip() for x in xpath.evaluate(self.document, rule, self.node)] if rule else [xpath.string_of(self.node).strip()] if self.node else []
            return next((x for x in found if x), None)
        if self.kind == "json":
            rule = rule.removeprefix("@json:").strip()
            if rule.startswith("$"):
                return jsonpath.first(self.node, rule)
            if re.search(r"[/?&=,]", rule):
                return rule
            return jsonpath.text(self.node.get(rule)) if isinstance(self.node, Mapping) else None
        return None


def field(scope: Scope, rule: str | None, ctx: Context) -> str | None:
    """One field; empty and absent are both None."""
    if not rule or not rule.strip():
        return None
    rule = rule.strip()
    if scope.kind == "regex":
        return _captured(scope.node, rule)
    if "@put:" in rule:
        for m in _PUT.finditer(rule):
            for pair in m[1].split(","):
                key, _, inner = pair.partition(":")
                if inner:
                    ctx.stored[key.strip()] = field(scope, inner, ctx) or ""
        rule = _PUT.sub("", rule).strip()
        if not rule:
            return None
    before = rule
    if "@get:" in rule:
        if m := _GET.fullmatch(rule):
            return ctx.stored.get(m[1].strip()) or None
        rule = _GET.sub(lambda m: ctx.stored.get(m[1].strip(), ""), rule)
    if "{{" in rule:
        rule = _TEMPLATE.sub(lambda m: _template(scope, m[1].strip(), ctx), rule)
    templated = rule != before
    scripts: list[str] = []
    if "js" in rule:
        scripts = [(a or b) for a, b in _JS.findall(rule)]
        rule = _JS.sub("", rule).strip()
    pairs, once = [], False
    if "##" in rule and not (scope.kind == "css" and scope.whole):
        rule, pairs, once = chain(rule)
    rule = rule.strip()
    if scope.kind == "json" and "{$" in rule:
        out = jsonpath.embedded(scope.node, rule)
    elif templated and scope.kind == "json" and not rule.startswith("$"):
        out = rule
    else:
        out = scope.pick(rule) if rule or scope.kind == "xpath" else ""
        if out is None and templated:
            out = rule
    for script in scripts:
        out = ctx.run(script, out or "")
    if out and pairs:
        out = chained(out, pairs, once)
    return out or None


def _template(scope: Scope, inner: str, ctx: Context) -> str:
    if m := _GET.fullmatch(inner):
        return ctx.stored.get(m[1].strip(), "")
    if scope.kind == "json" and inner.startswith("$"):
        return jsonpath.first(scope.node, inner) or ""
    if inner in ctx.stored:
        return ctx.stored[inner]
    if scope.kind == "json" and isinstance(scope.node, Mapping) and inner in scope.node:
        return jsonpath.text(scope.node[inner]) or ""
    return ctx.bindings.get(inner) or ctx.run(inner, "")


def _captured(groups: tuple, rule: str) -> str | None:
    """$1 to $99 from a match; $0 and missing groups stay as they are."""
    head, pairs, once = chain(rule)
    out = re.sub(r"\$([1-9]\d?)", lambda m: (groups[int(m[1]) - 1] or "") if int(m[1]) <= len(groups) else m[0], head)
    return (chained(out, pairs, once) if pairs else out).strip() or None


def document(body: str, kind: str) -> Scope:
    if kind == "json":
        try:
            return Scope("json", json.loads(body), whole=True)
        except ValueError:
            return Scope("json", None, whole=True)
    if kind == "xpath":
        return Scope("xpath", None, xpath.parse(body), True)
    return Scope("css", parse(body), whole=True)


def items(body: str, rule: str, ctx: Context) -> list[Scope]:
    """A list rule's items, in document order."""
    kind, rule = mode(rule, body), rule.strip()
    text = stripped(rule)
    if kind == "css":
        return [Scope("css", e) for e in extract.items(parse(body), text)]
    if kind == "xpath":
        doc = xpath.parse(body)
        return [Scope("xpath", n, doc) for n in xpath.evaluate(doc, text) if isinstance(n, xpath.Node)] if doc else []
    if kind == "json":
        whole = document(body, "json").node
        return [Scope("json", x) for x in jsonpath.items(whole, text if text.startswith("$") else "$")]
    if kind == "regex":
        p = pattern(text)
        return [Scope("regex", m.groups()) for m in p.finditer(body)] if p else []
    out = ctx.run(text, body)
    if is_json(out):
        got = json.loads(out)
        return [Scope("json", x) for x in (got if isinstance(got, list) else [got])]
    return [Scope("css", e) for e in extract.items(parse(out), "body > *")] if out else []


def rows(body: str, base: str, list_rule: str, fields: Mapping[str, str], ctx: Context | None = None) -> list[dict[str, str | None]]:
    """The list rule's items as rows of the fields; URLs are resolved; a leading - reverses."""
    ctx = ctx or Context(base)
    rule, back = ordered(list_rule)
    found = items(body, rule, ctx)
    out = []
    for scope in found:
        row = {k: field(scope, r, ctx) for k, r in fields.items()}
        out.append({k: resolve(base, v) if v and k in LINKS else v for k, v in row.items()})
        if scope.kind == "regex" and not row.get("name", True):
            out.pop()
    return out[::-1] if back else out


def books(body: str, base: str, rules: Mapping[str, str], pattern_of_detail: str = "", scripts: Mapping[str, Script] | None = None) -> list[dict]:
    """Search or explore results; a page without items is one book, if no pattern says what a detail page looks like."""
    ctx = Context(base, scripts=scripts or {}, library=rules.get("jsLib") or "")
    fields = {k: rules[k] for k in BOOK if rules.get(k)}
    found = rows(body, base, rules["bookList"], fields, ctx) if rules.get("bookList") else []
    if not found and not pattern_of_detail.strip():
        info = book_info(body, base, rules, ctx)
        found = [info] if info.get("name") else []
    return [{k: r.get(k) for k in BOOK} | {"bookUrl": r.get("bookUrl") or base} for r in found]


def explore(body: str, base: str, explore_rules: Mapping[str, str], search_rules: Mapping[str, str], scripts: Mapping[str, Script] | None = None) -> list[dict]:
    """The explore rules if they have a list rule, else those of the search; no detail page stands in."""
    rules = explore_rules if (explore_rules.get("bookList") or "").strip() else search_rules
    return books(body, base, rules, "-", scripts)


def book_info(body: str, base: str, rules: Mapping[str, str], ctx: Context | None = None) -> dict[str, str | None]:
    ctx = ctx or Context(base)
    kind = "json" if is_json(body) else "css"
    for r in rules.values():
        if isinstance(r, str) and r.startswith(("@xpath:", "/")) and kind == "css":
            kind = "xpath" if xpath.parse(body) else "css"
            break
    scope = document(body, kind)
    init = (rules.get("init") or "").strip()
    if init and kind == "json":
        got = jsonpath.values(scope.node, init) if init.startswith("$") else []
        scope = Scope("json", got[0], whole=True) if got else scope
    elif init:
        field(scope, init, ctx)
    out = {k: field(scope, rules.get(k), ctx) for k in (*BOOK, "tocUrl")}
    out |= {k: resolve(base, out[k]) for k in ("coverUrl", "tocUrl") if out[k]}
    out["bookUrl"] = base
    out["tocUrl"] = out["tocUrl"] or base
    return out


def chapters(body: str, base: str, rules: Mapping[str, str], scripts: Mapping[str, Script] | None = None) -> tuple[list[dict], list[str]]:
    """Chapters in order, each URL once, numbered after reversal; and the next pages' URLs."""
    ctx = Context(base, scripts=scripts or {}, library=rules.get("jsLib") or "")
    if rules.get("preUpdateJs"):
        body = ctx.run(rules["preUpdateJs"], body) or body
    rule, back = ordered(rules["chapterList"])
    found: dict[str, dict] = {}
    for n, scope in enumerate(items(body, rule, ctx)):
        get = lambda k: field(scope, rules.get(k), ctx)  # noqa: B023, E731
        title, link = get("chapterName") or "", get("chapterUrl")
        volume = truthy(get("isVolume"))
        url = resolve(base, link) if link else f"{title}{n}" if volume else base
        if url in found:
            continue
        found[url] = {"title": title, "url": url, "tag": get("updateTime"), "isVolume": volume, "isVip": truthy(get("isVip")), "isPay": truthy(get("isPay"))}
    out = list(found.values())
    if rules.get("formatJs"):
        for n, c in enumerate(out, 1):
            c["title"] = ctx.run(rules["formatJs"], c["title"], index=n, title=c["title"], chapter=c).strip() or c["title"]
    out = out[::-1] if back else out
    for n, c in enumerate(out):
        c["index"] = n
    return out, links(body, base, rules.get("nextTocUrl"), ctx)


def links(body: str, base: str, rule: str | None, ctx: Context) -> list[str]:
    if not (rule or "").strip():
        return []
    kind = mode(rule, body)
    if kind == "json":
        found = [jsonpath.text(x) for x in jsonpath.values(document(body, "json").node, stripped(rule))]
    elif kind == "xpath":
        found = xpath.strings(body, stripped(rule))
    else:
        found = extract.texts(parse(body), stripped(rule))
    return list(dict.fromkeys(u for x in found if x and (u := resolve(base, x)) and u != base))


def checked(body: str, base: str, script: str | None, scripts: Mapping[str, Script] | None = None, library: str = "") -> tuple[str, str]:
    """A response as its source's login check leaves it: (body, URL). The script gives a text, or an object with body and url."""
    if not (script or "").strip():
        return body, base
    out = Context(base, scripts=scripts or {}, library=library).run(script, json.dumps({"body": body, "url": base}, ensure_ascii=False) if "JSON.parse" in script else body, body=body)
    if is_json(out):
        got = json.loads(out)
        if isinstance(got, dict) and isinstance(got.get("body"), str):
            return got["body"], got.get("url") or base
    return out or body, base


def content(body: str, base: str, rules: Mapping[str, str], scripts: Mapping[str, Script] | None = None) -> tuple[str | None, str | None]:
    """A chapter's text after its replacements, and the URL of its next page."""
    ctx = Context(base, scripts=scripts or {}, library=rules.get("jsLib") or "")
    source = (rules.get("sourceRegex") or "").strip()
    if source and (p := pattern(source)) and (m := p.search(body)):
        body = m[1] if m.groups() and m[1] else m[0]
    if rules.get("webJs"):
        body = ctx.run(rules["webJs"], body) or body
    rule = (rules.get("content") or "").strip()
    kind = mode(rule, body)
    if kind == "js":
        return ctx.run(stripped(rule), body) or None, None
    rule = _TEMPLATE.sub(lambda m: ctx.bindings.get(m[1].strip()) or ctx.run(m[1], ""), rule)
    if kind == "json":
        text = jsonpath.first(document(body, "json").node, stripped(rule))
    elif kind == "xpath":
        text = next(iter(xpath.strings(body, stripped(rule))), None)
    else:
        text = extract.all_text(parse(body), stripped(rule))
    if text and rules.get("replaceRegex"):
        _, pairs, once = chain(rules["replaceRegex"] if rules["replaceRegex"].startswith("##") else "##" + rules["replaceRegex"])
        text = chained(text, pairs, once)
    return text or None, next(iter(links(body, base, rules.get("nextContentUrl"), ctx)), None)
