"""Scalar functions on text as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

FALSE = ("", "0", "false", "null", "none", "no", "off")


def truthy(c: Column) -> Column:
    """False for blank, 0, false, null, none, no, off and for null."""
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*FALSE)


def absent_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapsed(c: Column) -> Column:
    """White space, of any script, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def no_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def no_scripts(c: Column) -> Column:
    """Without script, style and noscript elements."""
    return F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", "")


def title_key(c: Column) -> Column:
    """Letters and digits only, in lower case: what two titles are compared by."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def author_key(c: Column) -> Column:
    return F.regexp_replace(no_space(c), "^作者[:：]?", "")


def merge_key(name: Column, author: Column) -> Column:
    return F.concat(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("|"), F.lower(F.trim(F.coalesce(author, F.lit("")))))


def entity_key(c: Column) -> Column:
    """Trimmed, lower case, one kind of middle dot, no white space."""
    return no_space(F.translate(F.lower(F.trim(c)), "·•・", "..."))


def pair_key(a: Column, b: Column, relation: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat_ws("::", F.array_join(F.array_sort(F.array(a, b)), "::"), relation)


def tokens(c: Column, delimiters: str = ",;；、") -> Column:
    """Trimmed, non-empty tokens, each once, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"[{delimiters}]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def with_token(c: Column, token: str) -> Column:
    return F.array_join(F.array_union(tokens(c), F.array(F.lit(token))), ",")


def without_token(c: Column, token: str) -> Column:
    return F.array_join(F.array_remove(tokens(c), token), ",")


def converted(c: Column, pairs: Mapping[str, str]) -> Column:
    """Characters of one script as those of another. Only characters beyond code point 10,000 are converted."""
    known = {a: b for a, b in pairs.items() if len(a) == len(b) == 1 and ord(a) > 10_000}
    return F.translate(c, "".join(known), "".join(known.values())) if known else c


def slug(c: Column) -> Column:
    """a-z, digits and CJK; everything else becomes single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def replaced(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Patterns replaced from left to right. Patterns are the driver's: an invalid one fails there, not in a task."""
    for find, replacement in pairs:
        c = F.regexp_replace(c, find, replacement)
    return c


def replaced_once(c: Column, find: str, replacement: str) -> Column:
    """The first match alone."""
    at = F.regexp_instr(c, F.lit(find))
    hit = F.regexp_substr(c, F.lit(find))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.regexp_replace(hit, find, replacement), F.substr(c, at + F.length(hit)))).otherwise(c)


def snippet(text: Column, at: Column, length: Column, around: int = 18) -> Column:
    """The text around a hit (at from 1), with dots where it is cut."""
    begin, end = F.greatest(at - around, F.lit(1)), F.least(at + length + around - 1, F.length(text))
    return F.concat(F.when(begin > 1, F.lit("...")).otherwise(F.lit("")), F.substr(text, begin, end - begin + 1), F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))


def hits(text: Column, needle: str) -> Column:
    """Places (from 1) of all hits that don't overlap, by the lengths of what stands between them."""
    gaps = F.split(text, needle_pattern(needle))
    step = lambda acc, g: F.struct((acc["at"] + F.length(g) + len(needle)).alias("at"), F.concat(acc["found"], F.array(acc["at"] + F.length(g) + 1)).alias("found"))
    folded = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step)
    return folded["found"]


def needle_pattern(needle: str) -> str:
    return r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"


#: Where a sentence ends, and where a long one may be cut; fixed values.
ENDS, BREAKS = "。！？!?；;", "，、, "


def chunks(c: Column, most: int = 70) -> Column:
    """A text for speaking: sentences, joined while they fit into `most` characters; a longer one is cut before its last break that fits, or at `most`."""
    blank = r"(?U)^\s+|\s+$"
    bare = lambda x: F.regexp_replace(x, blank, "")
    whole = F.regexp_replace(bare(F.coalesce(c, F.lit(""))), r"\n+", "\n")
    sentences = F.filter(F.transform(F.split(whole, f"(?<=[{ENDS}])"), bare), lambda x: x != "")
    cut = rf"(?s)\s*(.{{1,{most}}}\s*\z|.{{1,{most}}}(?=[{BREAKS}])|.{{{most}}})"
    told = lambda s: F.when(F.length(s) > most, F.transform(F.regexp_extract_all(s, F.lit(cut), F.lit(1)), bare)).otherwise(F.array(s))
    # a long sentence's parts stand alone; short sentences join what is open before them
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        shut = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        long = F.struct(F.concat(shut, told(s)).alias("done"), F.lit("").alias("open"))
        fits = F.struct(acc["done"].alias("done"), F.concat(acc["open"], s).alias("open"))
        return F.when(F.length(s) > most, long).when(F.length(acc["open"]) + F.length(s) <= most, fits).otherwise(F.struct(shut.alias("done"), s.alias("open")))

    return F.aggregate(sentences, none, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def version(c: Column) -> Column:
    """A version's numbers, three at least, for comparing: v and what follows - or + don't count."""
    core = F.regexp_extract(F.trim(c), r"^v?(\d+(?:\.\d+)*)", 1)
    numbers = F.transform(F.split(core, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0)))
    return F.when(core == "", F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.concat(numbers, F.array_repeat(F.lit(0), F.greatest(3 - F.size(numbers), F.lit(0)))))


#: How a summary of one chapter alone begins; fixed values.
OF_ONE = r"^(?:本章|本节|这一章)[：:，,]\s*"
OF_NUMBER = r"^第\s*(?:\d+|[零〇一二两三四五六七八九十百千万]+)\s*[章节回话卷篇][^。！？；]{0,40}[：:]\s*"


def merged_summary(old: Column, new: Column, most: int = 1200) -> Column:
    """The newer summary, unless there is none or it is one of a single chapter; beyond `most` characters its head (55 %), dots and its tail.

    Where there is none before, a single chapter's loses its heading and stands.
    """
    before, next_ = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(next_, OF_ONE, ""), OF_NUMBER, ""))
    out = F.when(next_ == "", before).when(before == "", bare).when(next_.rlike(OF_ONE) | next_.rlike(OF_NUMBER), before).otherwise(next_)
    head = int((most - 2) * 0.55)
    return F.when(F.length(out) <= most, out).otherwise(F.concat(F.left(out, F.lit(head)), F.lit("……"), F.right(out, F.lit(most - head - 2))))


def error_summary(html: Column, most: int = 240) -> Column:
    """What a page says about an error: its title, else its text, with the commonest references decoded."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    out = F.when(F.trim(title) != "", title).otherwise(no_tags(no_scripts(html)))
    for code, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.left(collapsed(out), F.lit(most))


def by_pinyin(c: Column) -> Column:
    """A text to order by as Chinese readers do."""
    return F.collate(c, "zh")


def explore_lines(c: Column) -> Column:
    """Explore categories as lines (or <br>) of title::url, those without :: left out."""
    lines = F.filter(F.split(c, r"\n|<br\s*/?>"), lambda x: F.contains(x, F.lit("::")))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "::", 1)).alias("title"), F.trim(F.regexp_replace(x, "^.*?::", "")).alias("url")))
