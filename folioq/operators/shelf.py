"""Changes to a shelf: saving, completing, switching, progress, groups, deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioq.functions.text import with_token, without_token

#: What a saved book keeps of the old row where it says nothing, and what information fills in; fixed values.
KEPT = ("durChapterIndex", "durChapterTitle", "durChapterTime", "durChapterPos", "totalChapterNum", "lastCheckTime", "group")
FILLED = ("coverUrl", "intro", "kind", "latestChapterTitle", "wordCount", "tocUrl", "updateTime", "canReName", "downloadUrls", "infoHtml")


def is_local(url: Column) -> Column:
    return F.startswith(url, F.lit("local-"))


def saved(shelf: DataFrame, new: DataFrame, kept: Sequence[str] = KEPT) -> DataFrame:
    """new over the shelf: a book is the same by URL, or by name and author unless either is local.

    Two equality joins find the old row; the URL's comes first. What neither finds is added.
    """
    cols = shelf.columns
    old = shelf.select(F.struct(*cols).alias("_o"), F.col("bookUrl").alias("_u"), F.col("name").alias("_n"), F.col("author").alias("_a"))
    by_url = new.join(old.select("_u", F.col("_o").alias("_by_url")), F.col("bookUrl") == F.col("_u"), "left").drop("_u")
    named = old.where(~is_local(F.col("_u"))).groupBy("_n", "_a").agg(F.min_by("_o", "_u").alias("_by_name"))
    both = by_url.join(named, (F.col("name") == F.col("_n")) & (F.col("author") == F.col("_a")) & ~is_local(F.col("bookUrl")), "left")
    match = both.withColumn("_m", F.coalesce("_by_url", "_by_name"))
    fresh = match.select(*[F.coalesce(c, F.col(f"_m.{c}")).alias(c) if c in kept else F.col(c) for c in cols], F.col("_m.bookUrl").alias("_replaces"))
    rest = shelf.join(fresh.where("_replaces IS NOT NULL").select(F.col("_replaces").alias("bookUrl")).distinct(), "bookUrl", "left_anti")
    return rest.select(*cols).unionByName(fresh.select(*cols))


def completed(books: DataFrame, info: DataFrame, fields: Sequence[str] = FILLED, blank: Sequence[str] = ("name", "author"), key: str = "bookUrl") -> DataFrame:
    """Books with gaps filled from their information: blank names, null others."""
    have = [c for c in (*blank, *fields) if c in books.columns and c in info.columns]
    joined = books.join(info.select(key, *[F.col(c).alias(f"_i_{c}") for c in have]), key, "left")
    fill = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_i_{c}"), F.col(c)) if c in blank else F.coalesce(c, f"_i_{c}")
    return joined.select(*[fill(c).alias(c) if c in have else F.col(c) for c in books.columns])


def switched(shelf: DataFrame, old_url: str, candidate: DataFrame) -> DataFrame:
    """A book's row with another source's fields; the old row goes."""
    old = shelf.where(F.col("bookUrl") == old_url)
    new = candidate.limit(1).select(F.lit(old_url).alias("_was"), *[F.col(c).alias(f"_c_{c}") for c in candidate.columns])
    made = old.join(new, F.col("bookUrl") == F.col("_was")).select(*[F.coalesce(f"_c_{c}", c).alias(c) if c in candidate.columns else F.col(c) for c in shelf.columns])
    return shelf.where(F.col("bookUrl") != old_url).unionByName(made)


def with_progress(shelf: DataFrame, progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """Reading progress (bookUrl, durChapterIndex, durChapterPos, durChapterTime), its chapter's title, and the list's size."""
    total = chapters.groupBy("bookUrl").agg(F.count("*").alias("_total"), F.max_by("title", "index").alias("_last"))
    p = progress.join(chapters.select("bookUrl", F.col("index").alias("durChapterIndex"), F.col("title").alias("durChapterTitle")), ["bookUrl", "durChapterIndex"], "left").join(total, "bookUrl", "left")
    names = ("durChapterIndex", "durChapterPos", "durChapterTime", "durChapterTitle")
    joined = shelf.join(p.select("bookUrl", *[F.col(n).alias(f"_p_{n}") for n in names], "_total", "_last"), "bookUrl", "left")
    new = {n: F.coalesce(f"_p_{n}", n) for n in names} | {"totalChapterNum": F.coalesce(F.col("_total").cast("int"), F.col("totalChapterNum")), "latestChapterTitle": F.coalesce("_last", "latestChapterTitle")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in shelf.columns])


def in_group(group: Column, wanted: int) -> Column:
    """-1 is all books, 0 those of no group, else those with the group's bits."""
    g = F.coalesce(group, F.lit(0)).cast("bigint")
    return F.lit(True) if wanted == -1 else g == 0 if wanted == 0 else g.bitwiseAND(F.lit(wanted).cast("bigint")) != 0


def regrouped(shelf: DataFrame, add: int = 0, remove: int = 0) -> DataFrame:
    g = F.coalesce("group", F.lit(0)).cast("bigint").bitwiseOR(F.lit(add).cast("bigint")).bitwiseAND(F.bitwise_not(F.lit(remove).cast("bigint")))
    return shelf.withColumn("group", g)


def marked(sources: DataFrame, invalid: Column, token: str = "失效", group: str = "bookSourceGroup") -> DataFrame:
    """Sources with the token for invalid ones set or taken away."""
    return sources.withColumn(group, F.when(invalid, with_token(F.col(group), token)).otherwise(without_token(F.col(group), token)))


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, key: str = "bookUrl") -> dict[str, DataFrame]:
    """Tables without the rows of deleted books."""
    keys = gone.select(key).distinct()
    return {name: df.join(keys, key, "left_anti") for name, df in tables.items()}


def pending(links: DataFrame, visited: DataFrame, base: str) -> DataFrame:
    """Next pages that are still to be fetched: not visited, and not the base's path on another host."""
    from folioq.functions.urls import host, path

    there = links.join(visited.select("url").distinct(), "url", "left_anti")
    return there.where(~((path(F.col("url")) == path(F.lit(base))) & (host(F.col("url")) != host(F.lit(base)))))
