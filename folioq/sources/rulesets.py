"""Book sources and feed sources from JSON: wrappers, lenient values, the old format."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from folioq.operators.batches import sliced
from folioq.rules.urlrule import legacy_url

WRAPPERS = ("bookSourceList", "bookSources", "data", "sources")
RSS_WRAPPERS = ("rssSources", "rssSourceList", "data", "sources")
RULES = ("ruleSearch", "ruleExplore", "ruleBookInfo", "ruleToc", "ruleContent", "ruleReview")
NUMBERS = ("bookSourceType", "customOrder", "weight", "lastUpdateTime", "respondTime")
#: The old format's names: top-level renames, and rule fields by the object that they belong to, the first that is there counts; fixed values.
RENAMED = {"ruleBookUrlPattern": "bookUrlPattern", "serialNumber": "customOrder", "ruleFindUrl": "exploreUrl", "ruleSearchUrl": "searchUrl", "enable": "enabled"}
MOVED = {
    "ruleSearch": {
        "ruleSearchList": "bookList", "ruleSearchName": "name", "ruleSearchAuthor": "author", "ruleSearchIntro": "intro", "ruleSearchKind": "kind", "ruleSearchLastChapter": "lastChapter",
        "ruleSearchUpdateTime": "updateTime", "ruleSearchNoteUrl": "bookUrl", "ruleSearchBookUrl": "bookUrl", "ruleSearchCoverUrl": "coverUrl", "ruleSearchWordCount": "wordCount",
    },
    "ruleExplore": {
        "ruleFindList": "bookList", "ruleFindName": "name", "ruleFindAuthor": "author", "ruleFindIntro": "intro", "ruleFindKind": "kind", "ruleFindLastChapter": "lastChapter",
        "ruleFindUpdateTime": "updateTime", "ruleFindNoteUrl": "bookUrl", "ruleFindBookUrl": "bookUrl", "ruleFindCoverUrl": "coverUrl", "ruleFindWordCount": "wordCount",
    },
    "ruleBookInfo": {
        "ruleBookInfoInit": "init", "ruleBookName": "name", "ruleBookAuthor": "author", "ruleIntroduce": "intro", "ruleBookIntro": "intro", "ruleBookKind": "kind", "ruleBookLastChapter": "lastChapter",
        "ruleBookUpdateTime": "updateTime", "ruleCoverUrl": "coverUrl", "ruleBookCoverUrl": "coverUrl", "ruleBookWordCount": "wordCount", "ruleChapterUrl": "tocUrl", "ruleBookTocUrl": "tocUrl",
    },
    "ruleToc": {
        "ruleChapterList": "chapterList", "ruleChapterName": "chapterName", "ruleContentUrl": "chapterUrl", "ruleChapterUrl": "chapterUrl", "ruleChapterUpdateTime": "updateTime",
        "ruleChapterUrlNext": "nextTocUrl", "ruleTocUrlNext": "nextTocUrl",
    },
    "ruleContent": {"ruleBookContent": "content", "ruleBookContentReplace": "replaceRegex", "ruleContentUrlNext": "nextContentUrl", "ruleContentTitle": "title"},
}


def unwrapped(value: object, keys: tuple[str, ...] = WRAPPERS) -> list[dict]:
    """The sources of an array, of a wrapper, or a single one."""
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict):
        for k in keys:
            if isinstance(value.get(k), list):
                return unwrapped(value[k])
        return [value] if value else []
    return []


def rule_object(value: object) -> dict:
    """A rule object may come as an object, as JSON in a string, or as nothing."""
    if isinstance(value, str):
        try:
            value = json.loads(value) if value.strip() not in ("", "null") else {}
        except ValueError:
            value = {}
    return dict(value) if isinstance(value, Mapping) else {}


def number(value: object, default: int = 0) -> int:
    try:
        return int(float(value)) if isinstance(value, str) else int(value)
    except (TypeError, ValueError):
        return default


def migrated(source: dict) -> dict:
    """A source in today's form, from that or the old one. An old field moves once: what took it leaves none for others."""
    out = dict(source)
    for old, new in RENAMED.items():
        if old in out and new not in out:
            out[new] = out.pop(old)
    if isinstance(out.get("bookSourceType"), str) and not out["bookSourceType"].strip().isdigit():
        out["bookSourceType"] = int(out["bookSourceType"].strip().upper() == "AUDIO")
    if "header" not in out and (out.get("httpUserAgent") or "").strip():
        out["header"] = json.dumps({"User-Agent": out["httpUserAgent"]})
    for k in ("searchUrl", "exploreUrl", "loginUrl"):
        if isinstance(out.get(k), str):
            out[k] = legacy_url(out[k])
    for rules, fields in MOVED.items():
        made = rule_object(out.get(rules))
        for old, new in fields.items():
            if new not in made and old in out:
                value = out.pop(old)
                if not isinstance(value, str) or value.strip():
                    made[new] = value
        out[rules] = made
    for k in NUMBERS:
        out[k] = number(out.get(k))
    out["enabled"] = out.get("enabled") is not False
    out["ruleReview"] = rule_object(source.get("ruleReview"))
    return out


def explore_kinds(text: str | None) -> list[dict]:
    """Explore categories: JSON (also with angle brackets for braces), or title::url by lines or &&."""
    text = (text or "").strip()
    if not text:
        return []
    for attempt in (text, braced(text)):
        try:
            got = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(got, list):
            return [{"title": str(x.get("title", "")).strip(), "url": x.get("url"), "style": x.get("style")} for x in got if isinstance(x, dict) and str(x.get("title", "")).strip()]
    import re

    parts = (p.strip().partition("::") for p in re.split(r"(?:&&|\n)+", text))
    return [{"title": t.strip(), "url": u.strip() or None, "style": None} for t, _, u in parts if t.strip()]


def braced(text: str) -> str:
    """< and > outside strings as braces."""
    out, inside, skip = [], False, False
    for c in text:
        if c == '"' and not skip:
            inside = not inside
        skip = c == "\\" and not skip
        out.append({"<": "{", ">": "}"}.get(c, c) if not inside else c)
    return "".join(out)


def recovered(text: str) -> list[dict]:
    """Objects from a damaged shelf: JSON values one after another, those that parse, each book once."""
    decoder, at, found = json.JSONDecoder(), 0, {}
    while at < len(text):
        k = min((p for p in (text.find("{", at), text.find("[", at)) if p >= 0), default=-1)
        if k < 0:
            break
        try:
            value, at = decoder.raw_decode(text, k)
        except ValueError:
            at = k + 1
            continue
        for book in unwrapped(value, ()):
            if book.get("bookUrl"):
                found.setdefault(f"{book['bookUrl']}::{book.get('origin', '')}", book)
    return list(found.values())


def read(files: DataFrame, text: str = "value", wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """(bookSourceUrl, bookSourceName, bookSourceGroup, enabled, customOrder, json, problem): the sources of JSON texts, in today's form.

    A text that is no JSON gives one row that has the problem alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for t in batch.column(0).to_pylist():
                try:
                    found += [migrated(s) for s in unwrapped(json.loads(t or "null"), wrappers)]
                except ValueError as e:
                    found.append({"problem": f"no JSON: {e}"})
            s = lambda k: pa.array([str(x[k]) if x.get(k) is not None else None for x in found], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([s("bookSourceUrl"), s("bookSourceName"), s("bookSourceGroup"), pa.array([x.get("enabled") for x in found], pa.bool_()), pa.array([x.get("customOrder") for x in found], pa.int64()), pa.array([None if "problem" in x else json.dumps(x, ensure_ascii=False, sort_keys=True) for x in found], pa.string()), s("problem")], names=["bookSourceUrl", "bookSourceName", "bookSourceGroup", "enabled", "customOrder", "json", "problem"])

    return files.select(text).mapInArrow(rows, "bookSourceUrl string, bookSourceName string, bookSourceGroup string, enabled boolean, customOrder bigint, json string, problem string")


def read_feeds(files: DataFrame, text: str = "value") -> DataFrame:
    """(sourceUrl, sourceName, sourceGroup, enabled, json, problem): feed sources of JSON texts; no JSON gives a problem."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for t in batch.column(0).to_pylist():
                try:
                    found += [s for s in unwrapped(json.loads(t or "null"), RSS_WRAPPERS) if s.get("sourceUrl")]
                except ValueError as e:
                    found.append({"problem": f"no JSON: {e}"})
            s = lambda k: pa.array([str(x[k]) if x.get(k) is not None else None for x in found], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([s("sourceUrl"), s("sourceName"), s("sourceGroup"), pa.array([None if "problem" in x else x.get("enabled") is not False for x in found], pa.bool_()), pa.array([None if "problem" in x else json.dumps(x, ensure_ascii=False, sort_keys=True) for x in found], pa.string()), s("problem")], names=["sourceUrl", "sourceName", "sourceGroup", "enabled", "json", "problem"])

    return files.select(text).mapInArrow(rows, "sourceUrl string, sourceName string, sourceGroup string, enabled boolean, json string, problem string")
