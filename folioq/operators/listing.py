"""Lists as their views show them: filters, orders, limits, counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioq.functions.text import author_key, by_pinyin, no_space, tokens
from folioq.operators.positions import placed, summed_before
from folioq.operators.recurse import kept

#: Limits of lists, fixed values.
LIMITS = {"available": 20, "available_most": 100, "available_stream": 5, "search": 50, "switch": 30, "tested": 100, "recent": 100, "candidates": 20, "preview": 50, "local_books": 100, "errors": 500}
#: A shelf row's fields that a search looks at, and a character's; fixed values.
SHELF_FIELDS = ("name", "author", "intro", "originName", "origin", "latestChapterTitle", "durChapterTitle")
CHARACTER_FIELDS = ("name", "aliases", "status", "faction", "location", "description")
PUNCTUATION = "：:,.，。！？!?-—_()（）【】[]<>《》'\"“”‘’"


def _text(df: DataFrame, c: str) -> Column:
    """A column as text; lists are joined by spaces."""
    kind = dict(df.dtypes)[c]
    return F.coalesce(F.array_join(c, " ") if kind.startswith("array") else F.col(c).cast("string"), F.lit(""))


def _has(df: DataFrame, fields: Sequence[str], word: str) -> Column:
    out = F.lit(False)
    for c in fields:
        if c in df.columns:
            out = out | F.contains(F.lower(_text(df, c)), F.lit(word))
    return out


# filters


def in_group(sources: DataFrame, group: str, column: str = "bookSourceGroup") -> DataFrame:
    """Sources whose group contains a text."""
    return sources.where(F.contains(F.coalesce(column, F.lit("")), F.lit(group))) if group else sources


def sources_like(sources: DataFrame, text: str = "", group: str = "", name: str = "bookSourceName", url: str = "bookSourceUrl", groups: str = "bookSourceGroup") -> DataFrame:
    """Sources by a word in name or URL, and by a text in the group."""
    word = text.strip().lower()
    return in_group(sources.where(_has(sources, (name, url), word)) if word else sources, group, groups)


def enabled(sources: DataFrame, column: str = "enabled") -> DataFrame:
    """All but those that say false."""
    return sources.where(F.coalesce(column, F.lit(True)))


def shelf_like(books: DataFrame, text: str = "", kind: str = "all", fields: Sequence[str] = SHELF_FIELDS) -> DataFrame:
    """Recent books by a word in one of the fields, all, books alone or feeds alone."""
    rss = F.coalesce("recentKind", F.lit("")) == "rss"
    rows = books if kind == "all" else books.where(rss if kind == "rss" else ~rss)
    word = text.strip().lower()
    return rows.where(_has(rows, fields, word)) if word else rows


def titled_like(chapters: DataFrame, text: str, title: str = "title") -> DataFrame:
    word = text.strip().lower()
    return chapters.where(_has(chapters, (title,), word)) if word else chapters


def characters_like(rows: DataFrame, text: str, fields: Sequence[str] = CHARACTER_FIELDS) -> DataFrame:
    """Characters whose fields, one behind the other and without white space, contain a text without it."""
    word = "".join(text.split()).lower()
    filled = [F.nullif(_text(rows, c), F.lit("")) for c in fields if c in rows.columns]
    return rows.where(F.contains(F.lower(no_space(F.concat_ws(" ", *filled))), F.lit(word))) if word else rows


def users_like(users: DataFrame, text: str, current: str = "", owner: str = "") -> DataFrame:
    """Users by name, or by what they are: 管理员, 当前账号, 默认书源."""
    word = text.strip().lower()
    said = [F.col("username"), F.when(F.coalesce("isAdmin", F.lit(False)), "管理员").otherwise(""), F.when(F.col("username") == current, "当前账号").otherwise(""), F.when(F.col("username") == owner, "默认书源").otherwise("")]
    return users.where(F.contains(F.lower(F.concat_ws(" ", *said)), F.lit(word))) if word else users


def same_book(rows: DataFrame, name: str, author: str, loose: bool = False) -> DataFrame:
    """Rows of a book by name and author; loose: without white space, and without what says that an author is one."""
    if not loose:
        return rows.where((F.col("name") == name) & (F.col("author") == author))
    return rows.where((no_space(F.col("name")) == no_space(F.lit(name))) & (author_key(F.col("author")) == author_key(F.lit(author))))


def visible(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Of the chosen keys, those that the rows still have."""
    return chosen.select(key).distinct().join(rows.select(key), key, "left_semi")


def asked(rows: DataFrame, keys: DataFrame, key: str, most: int = LIMITS["tested"]) -> DataFrame:
    """Rows of the first keys that are asked for, by pos."""
    return rows.join(keys.orderBy("pos").limit(most).select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def within_limit(books: DataFrame, by: Sequence[str] = (), most: int = LIMITS["local_books"]) -> DataFrame:
    """(by, within, left_over): whether users may import more local books."""
    n = F.count("*")
    return books.groupBy(*by).agg((n <= most).alias("within"), F.greatest(most - n, F.lit(0)).alias("left_over"))


# orders: each as a rank, so that an order is a column


def ranked(df: DataFrame, keys: Sequence[Column | str], by: Sequence[str] = (), out: str = "rank", most: int | None = None) -> DataFrame:
    """df with each row's place (from 1) in an order; up to `most` of a group."""
    rows = placed(df, by, keys, out).withColumn(out, F.col(out) + 1)
    return rows if most is None else rows.where(F.col(out) <= most)


def by_name(name: str = "name") -> list[Column]:
    """By bytes."""
    return [F.col(name)]


def newest_first(updated: str = "updated", tie: str = "name") -> list[Column]:
    return [F.desc(updated), F.col(tie)]


def users_in_order(admins_first: bool = False) -> list[Column]:
    """By the time of creation and name; in the list of users, administrators first and then by name."""
    return [F.desc(F.coalesce("isAdmin", F.lit(False))), F.col("username")] if admins_first else [F.col("createdAt"), F.col("username")]


def by_custom_order(name: str = "bookSourceName", order: str = "customOrder") -> list[Column]:
    return [F.coalesce(order, F.lit(0)), by_pinyin(F.col(name))]


def by_degree(label: str = "label") -> list[Column]:
    return [F.desc("degree"), by_pinyin(F.col(label))]


def files_in_order() -> list[Column]:
    """Folders first."""
    return [F.desc("is_folder"), F.col("name")]


def recents(reads: DataFrame, key: str, read_at: str, now: Column, rss_days: int = 7, most: int = LIMITS["recent"]) -> DataFrame:
    """The latest entries, each once, feeds' only for some days."""
    rest = [c for c in reads.columns if c not in (key, read_at)]
    last = reads.groupBy(key).agg(F.max(read_at).alias(read_at), F.max_by(F.struct(*rest), F.struct(read_at, *rest)).alias("_r")).select(key, read_at, "_r.*")
    alive = (F.coalesce("recentKind", F.lit("")) != "rss") | (F.col(read_at) > now - F.make_dt_interval(F.lit(rss_days)))
    return last.where(alive).orderBy(F.desc(read_at), key).limit(most)


def plain_title(c: Column) -> Column:
    """A title without white space and punctuation, in lower case."""
    return F.lower(F.translate(no_space(F.coalesce(c, F.lit(""))), PUNCTUATION, ""))


def candidates(rows: DataFrame, name: str, author: str, latest: str, seq: str = "seq", most: int = LIMITS["candidates"]) -> DataFrame:
    """Other sources' books by how much of a book they match: name 3, author 3, latest chapter 4; the first `most`."""
    hit = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0))
    writer = lambda c: F.regexp_replace(plain_title(c), "^作者", "")
    want = plain_title(F.lit(latest))
    score = hit(plain_title(F.col("name")) == plain_title(F.lit(name)), 3) + hit(writer(F.col("author")) == writer(F.lit(author)), 3) + hit((want != "") & (plain_title(F.col("lastChapter")) == want), 4)
    return rows.withColumn("score", score).orderBy(F.desc("score"), seq).limit(most)


def preview(c: Column, most: int = LIMITS["errors"]) -> Column:
    return F.left(c, F.lit(most))


# counts


def availability(tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(total, valid, invalid, markedInvalid) of tested sources: valid if search or explore is."""
    ok = F.coalesce("searchOk", F.lit(False)) | F.coalesce("exploreOk", F.lit(False))
    return tests.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(F.array_contains(tokens(F.col("group")), "失效")).alias("markedInvalid"))


def added_up(*summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summaries of batches as one: counters are summed."""
    rows = summaries[0]
    for s in summaries[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in by])


def cache_summary(cached: DataFrame, book: str = "bookUrl", size: str = "bytes", updated: str = "updated") -> DataFrame:
    return cached.groupBy(book).agg(F.count("*").alias("n"), F.sum(size).alias(size), F.max(updated).alias(updated))


def source_counts(sources: DataFrame, shown: Column, by: Sequence[str] = ()) -> DataFrame:
    """(total, enabled, filtered)."""
    return sources.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"), F.count_if(shown).alias("filtered"))


def progress_counts(results: DataFrame, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    return results.groupBy(*by).agg(*[F.count_if(F.col(status) == k).alias(k) for k in ("cached", "success", "failed")])


def _whole_minutes(seconds: str) -> Column:
    """A group's sum of seconds in whole minutes, whatever the order of the rows.

    Seconds that are decimals of up to six places (below 10^12) are added as such; a group with others adds doubles.
    """
    exact = F.col(seconds).try_cast("decimal(18,6)")
    decimals = F.count_if(~exact.cast("double").eqNullSafe(F.col(seconds).cast("double"))) == 0
    whole = F.floor(F.sum(exact)).cast("bigint")
    return F.when(decimals, F.call_function("div", whole - F.pmod(whole, F.lit(60)), F.lit(60))).otherwise(F.floor(F.sum(seconds) / 60))


def reading_stats(reads: DataFrame, by: Sequence[str]) -> DataFrame:
    """(opened, chapters, completed, minutes) of reads (bookUrl, index, total, seconds)."""
    done = F.when(F.col("index") >= F.col("total") - 1, F.col("bookUrl"))
    return reads.groupBy(*by).agg(F.countDistinct("bookUrl").alias("opened"), F.countDistinct(F.concat("bookUrl", F.lit("#"), "index")).alias("chapters"), F.countDistinct(done).alias("completed"), _whole_minutes("seconds").alias("minutes"))


def next_id(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"), F.count("*").alias("n"))


def first_user(users: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Who administers: the first user; a time of 0 or less is none, and comes last."""
    at = F.when(F.col("createdAt") <= 0, F.lit(float("inf"))).otherwise(F.col("createdAt").cast("double"))
    return users.groupBy(*by).agg(F.min_by("username", F.struct(at, F.col("username"))).alias("admin"))


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Characters of plain text, and those of a chapter's HTML that are no white space."""
    return texts.withColumns({"chars": F.length(text).cast("long"), "dense": F.length(no_space(F.regexp_replace(text, "<[^>]+>", ""))).cast("long")})


def signature(rows: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """Each group's sorted members as one string, whole: what a change is seen by."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda x: x.cast("string")), "|").alias("signature"))


# positions


def neighbours(chapters: DataFrame, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Each chapter's previous and next one, whether there is one, and how far a reader is, in percent."""
    rows = kept(placed(chapters, by, order, "_k"), "places")
    beside = lambda step, out: rows.select(*by, (F.col("_k") + step).alias("_k"), F.col(key).alias(out))
    on = [*by, "_k"]
    found = rows.join(beside(1, "prev_id"), on, "left").join(beside(-1, "next_id"), on, "left")
    total = chapters.groupBy(*by).agg(F.count("*").alias("_n"))
    found = found.join(total, list(by))
    return found.withColumns({"has_next": F.col("next_id").isNotNull(), "progress": F.round((F.col("_k") + 1) * 100.0 / F.col("_n"), 2).cast("double")}).drop("_k", "_n")


def batched(results: DataFrame, by: Sequence[str], order: Sequence[str], size: int, most: int) -> DataFrame:
    """Results in batches of so many, in order, until `most` are there; last_index is the last one that counts in each group."""
    rows = placed(results, by, order).where(F.col("place") < most)
    last = results.groupBy(*by).agg((F.least(F.count("*"), F.lit(most)) - 1).alias("last_index"))
    return rows.withColumn("batch", F.floor(F.col("place") / size)).join(last, list(by))


def until_enough(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, enough: int) -> DataFrame:
    """Rows until what came before them is enough."""
    return summed_before(rows, by, order, size).where(F.col("before") < enough)


# joins


def with_cached(books: DataFrame, counts: DataFrame, key: str = "bookUrl", local: Column | None = None) -> DataFrame:
    """Books with how many chapters a cache has of each; local ones show none."""
    rows = books.join(counts.select(key, F.col("n").alias("_n")), key, "left")
    none = F.startswith(F.col(key), F.lit("local-")) if local is None else local
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return rows.withColumns({"cached": n, "shown": F.when(none, F.lit(0)).otherwise(n).cast("bigint")}).drop("_n")


def enriched(rows: DataFrame, sources: DataFrame, origin: str = "origin", fallback: str = "origin") -> DataFrame:
    """Rows with their source's name and group (sources: origin, originName, originGroup), or what stands in for them."""
    from folioq.operators.joins import small

    joined = rows.join(small(sources), origin, "left")
    return joined.withColumns({"originName": F.coalesce("originName", F.col(fallback).cast("string")), "originGroup": F.coalesce("originGroup", F.lit(""))})


def with_fallback(wanted: DataFrame, network: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """What the network has of each key, else the cache, else nothing, and which it was."""
    rows = wanted.join(network.select(key, F.col(value).alias("_a")), key, "left").join(cache.select(key, F.col(value).alias("_b")), key, "left")
    way = F.when(F.col("_a").isNotNull(), "network").when(F.col("_b").isNotNull(), "cache").otherwise("none")
    return rows.withColumns({value: F.coalesce("_a", "_b"), "way": way}).drop("_a", "_b")


def identity(namespace: Column, text: Column) -> Column:
    """A local book's identity by its text."""
    return F.md5(F.concat_ws(":", namespace, F.lit("file"), F.md5(text)))


def password_hash(password: Column, salt: Column) -> Column:
    return F.md5(F.concat(F.md5(F.concat(password, salt)), salt))


def applied(texts: DataFrame, rules: DataFrame, key: str, text: str = "text", name: str = "name", url: str = "url", source: str = "source") -> DataFrame:
    """Texts after a table of replacement rules (order, pattern, replacement, isRegex, isEnabled, scope), each on what the one before left.

    Rules meet books by equality: a scope names a source, a book's URL, a name with or without a URL, or all; each kind
    is a join of its own, and those for all are one row. So no text meets rules that aren't its own, and plans don't grow
    with the rules: a text's rules are an array, folded in order. An invalid pattern changes nothing.
    """
    from folioq.operators.rules import mapped
    from pyspark.sql.types import BooleanType

    def valid(find: str, _: str) -> bool:
        try:
            re.compile(find)
        except re.error:
            return False
        return True

    live = mapped(rules.where(F.coalesce("isEnabled", F.lit(True))), "pattern", None, "_valid", BooleanType(), valid)
    live = live.where(F.col("_valid") | ~F.coalesce("isRegex", F.lit(True)))
    scope = F.trim(F.coalesce("scope", F.lit("")))
    parts = F.split(scope, ";")
    rule = F.struct(F.coalesce("order", F.lit(0)).alias("order"), F.col("pattern").alias("pattern"), F.coalesce("replacement", F.lit("")).alias("replacement"), F.coalesce("isRegex", F.lit(True)).alias("regex"))
    kind = F.when(scope.isin("", "*"), "all").when(scope.startswith("source:"), "source").when(scope.startswith("book:"), "url").when(parts[0] == "*", F.when(F.size(parts) > 1, "url").otherwise("all")).when(F.size(parts) > 1, "both").otherwise("name")
    said = F.when(kind == "source", F.substr(scope, F.lit(8))).when(scope.startswith("book:"), F.substr(scope, F.lit(6))).when(kind == "url", F.get(parts, F.lit(1))).when(kind == "both", F.concat(parts[0], F.lit("\x00"), F.get(parts, F.lit(1)))).otherwise(F.when(kind == "name", parts[0]).otherwise(""))
    sets = live.select(kind.alias("kind"), said.alias("said"), rule.alias("rule")).groupBy("kind", "said").agg(F.collect_list("rule").alias("rules"))
    out, found = texts, F.array().cast("array<struct<order:int,pattern:string,replacement:string,regex:boolean>>")
    keys = {"all": F.lit(""), "source": F.col(source), "url": F.col(url), "name": F.col(name), "both": F.concat(name, F.lit("\x00"), url)}
    for k, c in keys.items():
        own = sets.where(F.col("kind") == k).select(F.col("said").alias(f"_k_{k}"), F.col("rules").alias(f"_r_{k}"))
        out = out.join(own, c == F.col(f"_k_{k}"), "left").drop(f"_k_{k}")
        found = F.concat(found, F.coalesce(F.col(f"_r_{k}"), F.array()).cast("array<struct<order:int,pattern:string,replacement:string,regex:boolean>>"))

    def put(t: Column, r: Column) -> Column:
        return F.when(r["regex"], F.regexp_replace(t, F.concat(F.lit("(?m)"), r["pattern"]), r["replacement"])).otherwise(F.replace(t, r["pattern"], r["replacement"]))

    done = F.aggregate(F.array_sort(found), F.coalesce(F.col(text), F.lit("")), put)
    return out.select(*[done.alias(text) if c == text else F.col(c) for c in texts.columns])
