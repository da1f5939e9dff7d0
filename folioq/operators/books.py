"""Plain-text books: chapters by headings, their ranges, full-text search, replacement rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioq.functions.text import hits, snippet
from folioq.operators.positions import placed

#: A chapter's heading, trimmed: a number of a chapter, section or volume and perhaps a title; an unspaced title doesn't end a sentence; fixed value.
HEADING = r"^(?:第[\p{N}零〇一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]+[章节回卷部集篇]|卷[\p{N}零〇一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]+)(?:$|[\s:：、.．\-—].*|[^\s:：、.．\-—](?:.*[^。！？!?；;，,、])?)$"
BLANK = r"(?U)^\s+|\s+$"
PROLOGUE, WHOLE = "序章", "正文"


def chapters(docs: DataFrame, heading: str = HEADING, key: str = "doc_id", text: str = "text", most: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, index, title, start, stop, content): byte offsets, the content between a heading and the next.

    One aggregate over each text's lines, within its row: no line leaves its document, and nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    place = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<title:string,head:bigint,start:bigint>>").alias("heads"))

    def step(acc: Column, line: Column) -> Column:
        size = F.octet_length(line).cast("bigint")
        title = F.regexp_replace(line, BLANK, "")
        is_head = (F.length(title) <= most) & title.rlike(heading)
        after = acc["at"] + size + 1
        head = F.struct(title.alias("title"), (acc["at"] + F.octet_length(F.regexp_extract(line, r"(?U)^\s*", 0))).alias("head"), after.alias("start"))
        return F.struct(after.alias("at"), F.when(is_head, F.concat(acc["heads"], F.array(head))).otherwise(acc["heads"]).alias("heads"))

    raw, total = F.col("_raw"), F.octet_length("_raw").cast("bigint")
    df = docs.select(key, *keep, t.cast("binary").alias("_raw"), F.aggregate(lines, place, step, lambda acc: acc["heads"]).alias("_h"))
    none = F.array(F.struct(F.lit(WHOLE).alias("title"), F.lit(0).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("start")))
    intro = F.array(F.struct(F.lit(PROLOGUE).alias("title"), F.lit(0).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("start")))
    before = F.trim(F.substring(raw, F.lit(1), F.coalesce(F.get("_h", F.lit(0))["head"], F.lit(0)).cast("int")).cast("string"))
    heads = F.when(F.size("_h") == 0, none).when(F.regexp_replace(before, r"\s+", "") != "", F.concat(intro, F.col("_h"))).otherwise(F.col("_h"))
    df = df.select(key, *keep, "_raw", heads.alias("_h"))
    rows = df.select(key, *keep, "_raw", F.posexplode(F.transform("_h", lambda h, i: F.struct(h["title"].alias("title"), h["start"].alias("start"), F.coalesce(F.get("_h", i + 1)["head"], total).alias("stop")))).alias("index", "_c"))
    start, stop = F.least(F.col("_c.start"), total), F.col("_c.stop")
    content = F.regexp_replace(F.substring(raw, start.cast("int") + 1, F.greatest(stop - start, F.lit(0)).cast("int")).cast("string"), r"[\r\n]+$", "")
    return rows.select(key, *keep, "index", F.col("_c.title").alias("title"), start.alias("start"), F.greatest(stop, start).alias("stop"), content.alias("content"))


def ranged(texts: DataFrame, text: str, start: str, stop: str, out: str = "content") -> DataFrame:
    """The bytes from start to stop of a text, as text."""
    return texts.withColumn(out, F.substring(F.col(text).cast("binary"), F.col(start).cast("int") + 1, (F.col(stop) - F.col(start)).cast("int")).cast("string"))


def search(docs: DataFrame, needle: str, key: str = "doc_id", text: str = "text", around: int = 18) -> DataFrame:
    """(key, hit, at, snippet) for every hit of a phrase in texts with single spaces."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    df = docs.where(F.contains(text, F.lit(needle.split(" ")[0]))).select(key, t.alias("_t"))
    rows = df.select(key, "_t", F.posexplode(hits(F.col("_t"), needle)).alias("hit", "at"))
    return rows.select(key, "hit", "at", snippet(F.col("_t"), F.col("at"), F.lit(len(needle)), around).alias("snippet"))


def applies(rule: Column, name: Column, url: Column, source: Column) -> Column:
    """Whether a rule's scope takes in a book: blank or *, source:..., book:..., or name;url parts."""
    scope = F.trim(F.coalesce(rule, F.lit("")))
    parts = F.filter(F.transform(F.split(scope, "[;；]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((scope == "") | (scope == "*"), F.lit(True)).when(F.startswith(scope, F.lit("source:")), F.trim(F.substr(scope, F.lit(8))) == source).when(F.startswith(scope, F.lit("book:")), F.trim(F.substr(scope, F.lit(6))).isin(name, url)).otherwise(F.exists(parts, lambda x: (x == name) | (x == url)))


def rewritten(texts: DataFrame, rules: Sequence[dict], text: str = "text", name: str | None = None, url: str | None = None, source: str | None = None) -> DataFrame:
    """Replacement rules in their order, each on what the ones before left. The rules are the driver's: invalid ones are left out."""
    import re

    blank, out = F.lit(None).cast("string"), F.col(text)
    for r in sorted((r for r in rules if r.get("isEnabled", True)), key=lambda r: r.get("order", 0)):
        if r.get("isRegex", True):
            try:
                re.compile(r["pattern"])
            except re.error:
                continue
            new = F.regexp_replace(out, "(?m)" + r["pattern"], r.get("replacement", ""))
        else:
            new = F.replace(out, F.lit(r["pattern"]), F.lit(r.get("replacement", "")))
        scope = (r.get("scope") or "").strip()
        if scope not in ("", "*"):
            new = F.when(applies(F.lit(scope), F.col(name) if name else blank, F.col(url) if url else blank, F.col(source) if source else blank), new).otherwise(out)
        out = new
    return texts.withColumn(text, out)


def reindexed(chapters_: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str = "index") -> DataFrame:
    return placed(chapters_, by, order, out).withColumn(out, F.col(out).cast("int"))
