"""Merging rows of many sources: order is a column, so every choice of a first or last row is deterministic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioq.functions.text import entity_key, merge_key, pair_key

IMPORTANCE = ("low", "medium", "high")
#: Relations that say little, and what marks a low importance; fixed values.
PLAIN = ("认识", "见过", "路过", "同村", "同校", "位于", "相关")
LOW = ("low", "低", "低重要性", "不重要", "路人", "背景", "minor", "background", "oneoff", "一次性")


def most_important_rank(importance: Column) -> Column:
    """3 for high, 2 for medium, 1 for low, 0 for what says none of them."""
    key = entity_key(F.coalesce(importance, F.lit("")))
    some = lambda *terms: F.lit(False) if not terms else F.contains(key, F.lit(terms[0])) | some(*terms[1:])
    return F.when(some("high", "高"), 3).when(some("medium", "中"), 2).when(some(*LOW), 1).otherwise(0)


def telling(relations: DataFrame) -> DataFrame:
    """Relations without those of little worth: a plain one of no stated importance, of which less than 18 characters are told."""
    key = entity_key(F.coalesce("importance", F.lit("")))
    stated = F.contains(key, F.lit("high")) | F.contains(key, F.lit("medium")) | F.contains(key, F.lit("高")) | F.contains(key, F.lit("中"))
    return relations.where(stated | ~entity_key(F.col("relation")).isin(*PLAIN) | (F.length(entity_key(F.coalesce("detail", F.lit("")))) >= 18))


def first_filled(c: str, seq: str = "seq") -> Column:
    """The first value that isn't null or empty."""
    return F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(seq))).alias(c)


def last_filled(c: str, seq: str = "seq") -> Column:
    return F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(seq))).alias(c)


def richest(c: str, seq: str = "seq") -> Column:
    """The longest value; of equal lengths the first."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(seq)))).alias(c)


def most_important(c: str, seq: str = "seq") -> Column:
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in IMPORTANCE]), F.lower(c)), F.lit(0))
    return F.max_by(c, F.struct(rank, -F.col(seq))).alias(c)


def distinct_in_order(c: str, seq: str = "seq") -> Column:
    """Each value once, by first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))))), lambda x: x["v"]))


def across_sources(rows: DataFrame, fill: Sequence[str] = ("coverUrl", "intro", "kind", "lastChapter", "updateTime"), base: Sequence[str] = ("name", "author", "bookUrl", "origin", "wordCount"), seq: str = "seq", ordered: bool = False) -> DataFrame:
    """One row per name and author: the first row's base, gaps filled from later ones, and all origins where there are several; ordered: by name."""
    keyed = rows.withColumn("_key", merge_key(F.col("name"), F.col("author")))
    have = [c for c in base if c in rows.columns]
    out = keyed.groupBy("_key").agg(F.min_by(F.struct(*have), seq).alias("_b"), *[first_filled(c, seq) for c in fill if c in rows.columns], distinct_in_order("origin", seq).alias("_o"))
    merged = out.select("_b.*", *[c for c in fill if c in rows.columns], F.when(F.size("_o") > 1, F.col("_o")).alias("bookSourceUrls"))
    return merged.orderBy("name") if ordered else merged


def first_rows(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Each key's first row."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def characters(rows: DataFrame, group: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Characters by normalised name: aliases united, the latest state, the longest description, the highest importance."""
    keyed = rows.withColumn("_key", entity_key(F.col("name")))
    have = [c for c in rows.columns]
    aggs = [first_filled("name", seq)]
    aggs += [last_filled(c, seq) for c in ("status", "faction", "location", "lastSeenChapter") if c in have]
    aggs += [richest("description", seq)] if "description" in have else []
    aggs += [most_important("importance", seq)] if "importance" in have else []
    if "alias" in have:
        aggs.append(distinct_in_order("alias", seq).alias("aliases"))
    return keyed.groupBy(*group, "_key").agg(*aggs).drop("_key")


def relationships(rows: DataFrame, group: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Relationships by unordered pair and relation: the first direction, the latest status, the longest description."""
    keyed = rows.withColumn("_key", pair_key(entity_key(F.col("source")), entity_key(F.col("target")), F.col("relation")))
    aggs = [F.min_by(F.struct("source", "target", "relation"), seq).alias("_f")]
    aggs += [last_filled(c, seq) for c in ("status",) if c in rows.columns]
    aggs += [richest("description", seq)] if "description" in rows.columns else []
    return keyed.where(entity_key(F.col("source")) != entity_key(F.col("target"))).groupBy(*group, "_key").agg(*aggs).select(*group, "_f.*", *[c for c in ("status", "description") if c in rows.columns])


def locations(rows: DataFrame, group: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Locations by name: the first parent and kind, the longest description, all related characters."""
    keyed = rows.withColumn("_key", entity_key(F.col("name")))
    have = rows.columns
    aggs = [first_filled("name", seq)] + [first_filled(c, seq) for c in ("kind", "parentName", "firstSeenChapter") if c in have]
    aggs += [last_filled("status", seq)] if "status" in have else []
    aggs += [richest("description", seq)] if "description" in have else []
    aggs += [distinct_in_order("character", seq).alias("relatedCharacters")] if "character" in have else []
    return keyed.groupBy(*group, "_key").agg(*aggs).drop("_key")


def notes(rows: DataFrame, order: Sequence[str], default: str, seq: str = "seq") -> DataFrame:
    """Notes by category in a given order (others behind), titles once per category, low importance left out."""
    kept = rows.where(F.coalesce(F.lower("importance"), F.lit("")) != "low").withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(default)))
    once = first_rows(kept, ["category", entity_key(F.col("title"))], [seq])
    place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("category")), F.lit(0))
    return once.withColumn("category_rank", F.coalesce(place, F.lit(999)).cast("int"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Mapping[str, bool] | None = None) -> DataFrame:
    """new over old by key. Columns of `keep` hold their old value where the new one is null."""
    keep = keep or {}
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("_old")), new.select(*keys, F.struct(*rest).alias("_new"))
    both = a.join(b, list(keys), "full")
    pick = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Each key's newest row, by aggregation (no sort of a key's rows)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*")


def kept_in_place(rows: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """A list whose later entries replace earlier ones of their key, at the earlier one's place."""
    rest = [c for c in rows.columns if c not in (*keys, pos)]
    return rows.groupBy(*keys).agg(F.min(pos).alias(pos), F.max_by(F.struct(*rest), pos).alias("_r")).select(*keys, pos, "_r.*")
