"""Joins by rules: prefixes, domains, first match by priority, deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioq.functions.text import title_key
from folioq.functions.urls import host, path, root_domain

#: A side is broadcast up to this many rows, counted first; beyond, Spark's own strategy holds.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chapter_books(chapters: DataFrame, books: DataFrame, url: str = "url", book_url: str = "bookUrl", seq: str = "seq") -> DataFrame:
    """Each chapter's book, the first by seq: its URL begins with the book's, or on the same host one path is a prefix of the other.

    A prefix is an equality: a URL meets the books by its prefixes of those lengths that books have, and the other way
    round. So no host's books meet all its chapters, and each key has one book, the first.
    """
    u = chapters.select(F.col(url).alias("_u")).where("_u IS NOT NULL").distinct().select("_u", host(F.col("_u")).alias("_h"), path(F.col("_u")).alias("_p"))
    b = books.where(F.col(book_url).isNotNull()).select(F.struct(F.col(seq).alias("s"), F.col(book_url).alias("u")).alias("_b"), F.col(book_url).alias("_bu"), host(F.col(book_url)).alias("_h"), path(F.col(book_url)).alias("_bp"))

    def lengths(df: DataFrame, c: str) -> Column:
        """As a literal: at most as many as the longest has characters."""
        return F.array(*[F.lit(r[0]) for r in df.select(F.length(c)).distinct().collect()]).cast("array<int>")

    def prefixes(df: DataFrame, c: str, some: Column) -> DataFrame:
        fit = F.filter(some, lambda n: n <= F.length(c))
        return df.select("*", F.explode(F.transform(fit, lambda n: F.substr(F.col(c), F.lit(1), n))).alias("_k"))

    first = lambda df, *keys: df.groupBy(*keys).agg(F.min("_b").alias("_b"))
    by_url = prefixes(u, "_u", lengths(b, "_bu")).join(first(b.withColumn("_k", F.col("_bu")), "_k"), "_k")
    below = prefixes(u, "_p", lengths(b, "_bp")).join(first(b.withColumn("_k", F.col("_bp")), "_h", "_k"), ["_h", "_k"])
    above = u.withColumn("_k", F.col("_p")).join(first(prefixes(b, "_bp", lengths(u, "_p")), "_h", "_k"), ["_h", "_k"])
    found = by_url.select("_u", "_b").unionByName(below.select("_u", "_b")).unionByName(above.select("_u", "_b"))
    best = found.groupBy(F.col("_u").alias(url)).agg(F.min("_b").alias("_b"))
    return chapters.join(best, url).select(*[F.col(c) for c in chapters.columns], F.col("_b.u").alias(book_url))


def domain_sources(urls: DataFrame, sources: DataFrame, url: str = "url", source_url: str = "sourceUrl", updated: str = "updated") -> DataFrame:
    """Each URL's source: one whose root domain is the same, the latest updated first."""
    s = sources.select(F.col(source_url), F.col(updated).alias("_u"), root_domain(F.col(source_url)).alias("_d"))
    best = s.groupBy("_d").agg(F.max_by(source_url, F.struct("_u", source_url)).alias(source_url))
    return urls.withColumn("_d", root_domain(F.col(url))).join(best, "_d", "left").drop("_d")


def resolved_sources(urls: DataFrame, candidates: Sequence[tuple[DataFrame, Column]], key: str = "url", out: str = "sourceUrl") -> DataFrame:
    """The first of several ways to a source that finds one; each way is (sources, the key that it is found by)."""
    found = None
    for rank, (sources, by) in enumerate(candidates):
        some = urls.select(key).join(sources.select(by.alias(key), out), key).select(key, F.lit(rank).alias("_r"), out)
        found = some if found is None else found.unionByName(some)
    best = found.groupBy(key).agg(F.min_by(out, F.struct("_r", out)).alias(out))
    return urls.join(best, key, "left")


def targets_of(shelf: DataFrame, targets: DataFrame, keep: bool) -> DataFrame:
    """Shelf rows that are targets by URL, or by name and author (not for local books), or those that aren't.

    Two equality joins instead of one on a disjunction, which only a nested loop can do.
    """
    kind = "left_semi" if keep else "left_anti"
    local = F.col("bookUrl").startswith("local-")
    by_url, by_name = targets.select("bookUrl"), targets.where(~local).select("name", "author")
    if not keep:
        left = shelf.join(by_url, "bookUrl", kind)
        return left.where(local).unionByName(left.where(~local).join(by_name, ["name", "author"], kind).select(*shelf.columns))
    hit = shelf.join(by_url, "bookUrl", kind)
    more = shelf.join(by_url, "bookUrl", "left_anti").where(~local).join(by_name, ["name", "author"], kind)
    return hit.unionByName(more.select(*hit.columns)).select(*shelf.columns)


def best_title(chapters: DataFrame, title: str, fallback: int, by: Sequence[str] = ()) -> DataFrame:
    """Where a title stands in a list of chapters: equal when normalised, else containing or contained, else a place near fallback."""
    want, key = title_key(F.lit(title)), title_key(F.col("title"))
    near = (key != "") & (F.contains(key, want) | F.contains(want, key))
    rank = F.when(key == want, F.lit(0)).when(near, F.lit(1))
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("index").alias("index"))))
    clamped = F.least(F.lit(fallback), F.max("index"))
    return chapters.groupBy(*by).agg(best.alias("_b"), clamped.alias("_f")).select(*by, F.coalesce("_b.index", "_f").alias("index"), F.coalesce("_b.rank", F.lit(2)).alias("rank"))


def overridden(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """left with right's values where it has a match with some."""
    r = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields])
    out = left.join(r, list(keys), "left")
    return out.select(*keys, *[F.coalesce(f"_r_{c}", c).alias(c) if c in fields else F.col(c) for c in left.columns if c not in keys])
