"""Places of a book: which lies in which, by what is said of them, and their tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioq.functions.text import by_pinyin, entity_key
from folioq.operators.merge import most_important_rank
from folioq.operators.recurse import kept

#: What kinds of places contain, and the level that says so, the first that fits; 35 for others. Fixed values.
LEVELS = [
    (("世界",), 90), (("大陆", "洲"), 80), (("国家", "王国", "帝国"), 70), (("区域", "地区", "省", "州", "郡", "领"), 60), (("城市", "城镇", "市", "城"), 50), (("村落", "村", "街区", "社区", "街道"), 40), (("庄园", "营地", "教会", "组织"), 35),
    (("学校", "学院", "大学", "建筑", "机构", "住宅", "公寓", "住处", "酒馆", "店铺", "商店", "避难所"), 30), (("房间", "教室", "书房", "机房", "实验室", "设施"), 20),
]
#: Kinds that hold others, kinds that may, and kinds that lie in others; fixed values.
STRONG = ("大陆", "世界", "国家", "王国", "帝国", "区域", "地区", "省", "州", "郡", "城市", "城镇", "市", "城", "村落", "村", "街区", "社区")
HOLDING = ("教会", "组织", "庄园", "营地")
INNER = ("住宅", "公寓", "住处", "房间", "建筑", "机构", "学校", "学院", "大学", "教室", "书房", "酒馆", "店铺", "商店", "机房", "实验室", "避难所", "设施")
CITY, TOWN = ("城市", "城镇", "市", "城"), ("村落", "村", "街区", "社区", "街道")
LOW = ("low", "低", "低重要性", "不重要", "路人", "背景", "minor", "background", "oneoff", "一次性")


def _any(key: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(key, F.lit(t))
    return out


def level(kind: Column) -> Column:
    key = entity_key(F.coalesce(kind, F.lit("")))
    out = F.when(key == "", F.lit(35))
    for terms, n in LEVELS:
        out = out.when(_any(key, terms), F.lit(n))
    return out.otherwise(F.lit(35))


def unimportant(importance: Column) -> Column:
    return _any(entity_key(F.coalesce(importance, F.lit(""))), LOW)


def with_parents(places: DataFrame, book: str = "bookUrl", seq: str = "seq") -> DataFrame:
    """places (book, seq, name, kind, importance, parentName, description, status) with the parent that holds each, or none.

    Each name once, the last row's say; unimportant ones go. A parent must be of a higher level. It is the one that is
    named, if it is a place of the book; else the highest that the place's own text mentions; else the highest whose text
    mentions the place; else, for inner kinds, the only city or town of the book, or the only place that can hold it.
    Pairs are of one book, and only of places that can hold with those of lower levels.
    """
    say = lambda *cs: entity_key(F.concat_ws(" ", *[F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in cs]))
    rows = places.where((F.coalesce("name", F.lit("")) != "") & ~unimportant(F.col("importance"))).withColumn("_key", entity_key(F.col("name")))
    rest = [c for c in places.columns if c != book]
    rows = rows.groupBy(book, "_key").agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(book, "_key", "_r.*")
    kind = entity_key(F.coalesce("kind", F.lit("")))
    parent = F.when(entity_key(F.coalesce("parentName", F.lit(""))) != F.col("_key"), F.nullif("parentName", F.lit("")))
    rows = rows.withColumn("parentName", parent).withColumns({"_level": level(F.col("kind")), "_inner": _any(kind, INNER), "_text": say("description", "status", "parentName"), "_score": level(F.col("kind")) * 10 + most_important_rank(F.col("importance"))})
    rows = kept(rows, "places")
    strong = _any(kind, STRONG)
    able = rows.where(strong | _any(kind, HOLDING) | ~F.col("_inner"))
    holders = able.select(book, F.col("_key").alias("_pk"), F.col("name").alias("_pn"), F.col("_level").alias("_pl"), F.col("_score").alias("_ps"), F.col("_text").alias("_pt"), F.col(seq).alias("_pq"), strong.alias("_strong"), (_any(kind, CITY) | _any(kind, TOWN)).alias("_near"))
    pairs = rows.join(holders, book).where((F.col("_pl") > F.col("_level")) & (F.col("_pk") != F.col("_key")))
    best = lambda test: F.max_by("_pn", F.when(test, F.struct("_ps", F.length("_pn"), -F.col("_pq"))))
    only = lambda test: F.when(F.count_if(test) == 1, F.max(F.when(test, F.col("_pn"))))
    # the named place need not be one that is able to hold others; if it can't hold this one, its name in the text tells nothing
    named = rows.select(book, F.col("_key").alias("_nk"), F.col("_level").alias("_nl"))
    said = rows.select(book, "_key", "_level", "parentName", entity_key(F.col("parentName")).alias("_nk")).join(named, [book, "_nk"])
    explicit = said.where("_nl > _level").select(book, "_key", F.col("parentName").alias("_explicit"))
    wrong = said.where("_nl <= _level").select(book, "_key", F.lit(True).alias("_wrong"))
    pairs = pairs.join(wrong, [book, "_key"], "left").withColumn("_own", F.when(F.coalesce("_wrong", F.lit(False)), say("description", "status")).otherwise(F.col("_text")))
    told = pairs.groupBy(book, "_key").agg(best(F.contains("_own", F.col("_pk"))).alias("_by_text"), best(F.contains("_pt", F.col("_key"))).alias("_by_holder"), only(F.col("_strong") & F.col("_near")).alias("_city"), only(F.col("_strong")).alias("_sole"))
    out = rows.join(explicit, [book, "_key"], "left").join(told, [book, "_key"], "left")
    sole = F.when(F.col("_inner"), F.coalesce("_city", "_sole"))
    return out.withColumn("parentName", F.coalesce("_explicit", "_by_text", "_by_holder", sole)).select(*places.columns)


def in_order() -> list[Column]:
    """Places by rank of their level, importance, kind and name."""
    kind = entity_key(F.coalesce("kind", F.lit("")))
    n = level(F.col("kind"))
    rank = F.when(n >= 70, 4).when(n >= 50, 3).when(n >= 40, 2).when(_any(kind, INNER), 0).otherwise(1)
    return [F.desc(rank), F.desc(most_important_rank(F.col("importance"))), by_pinyin(F.coalesce("kind", F.lit(""))), by_pinyin(F.col("name"))]


def tree(places: DataFrame, book: str = "bookUrl", collapsed: Sequence[str] = ()) -> DataFrame:
    """(book, row, name, depth, has_children): places with their parents as the rows of a tree, below each its own; collapsed ones hide theirs.

    Siblings are numbered in their order; a row's path of numbers sorts the tree. A level is a join; the last one is empty.
    """
    from pyspark.sql import Window

    shut = [x.lower() for x in collapsed]
    rows = places.withColumns({"_key": entity_key(F.col("name")), "_pk": F.nullif(entity_key(F.coalesce("parentName", F.lit(""))), F.lit(""))})
    known = rows.select(book, F.col("_key").alias("_pk"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, [book, "_pk"], "left").withColumn("_pk", F.when(F.col("_known") & (F.col("_pk") != F.col("_key")), F.col("_pk")))
    rows = kept(rows.withColumn("_n", F.row_number().over(Window.partitionBy(book, "_pk").orderBy(*in_order()))).select(book, "_key", "_pk", "name", "_n"), "tree")
    holds = rows.where("_pk IS NOT NULL").select(book, F.col("_pk").alias("_key"), F.lit(True).alias("has_children")).distinct()
    current = kept(rows.where("_pk IS NULL").select(book, "_key", "name", F.array("_n").alias("_path"), F.array("_key").alias("_keys")), "tree-level")
    out = current
    while not current.isEmpty():
        above = current.where(~F.col("_key").isin(shut)) if shut else current
        up = above.select(book, F.col("_key").alias("_pk"), F.col("_path").alias("_up"), F.col("_keys").alias("_over"))
        below = rows.join(up, [book, "_pk"]).where(~F.array_contains("_over", F.col("_key")))
        current = kept(below.select(book, "_key", "name", F.concat("_up", F.array("_n")).alias("_path"), F.concat("_over", F.array("_key")).alias("_keys")), "tree-level")
        out = out.unionByName(current)
    told = out.join(holds, [book, "_key"], "left").withColumn("row", F.row_number().over(Window.partitionBy(book).orderBy("_path")) - 1)
    return told.select(book, "row", "name", (F.size("_path") - 1).alias("depth"), F.coalesce("has_children", F.lit(False)).alias("has_children"))
