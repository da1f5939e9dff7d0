"""Chapter titles: ordinals in Arabic or Chinese numerals, and what is no part of the story."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
#: What a title outside the story contains, and whole titles of prologues, which are story; fixed values.
OUTSIDE = ("番外", "外传", "新书", "新番外", "公告", "通知", "说明", "感言", "请假", "断更", "恢复更新", "更新时间", "求票", "月票", "推荐票", "打赏", "推书", "书友群", "群号", "活动", "抽奖", "实体书", "出版", "完本", "上架")
PROLOGUES = ("序章", "楔子", "引子", "序", "前言")


def numeral(c: Column) -> Column:
    """The number that Arabic digits or a Chinese numeral up to 9999 万 say; null for others."""
    number = F.create_map(*[F.lit(x) for k, v in DIGITS.items() for x in (k, v)])
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    zero = F.struct(F.lit(0).cast("bigint").alias("all"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("digit"))

    def step(acc: Column, ch: Column) -> Column:
        d, u = F.element_at(number, ch), F.element_at(unit, ch)
        more = F.when(acc["digit"] == 0, F.when(u == 10, F.lit(1)).otherwise(F.lit(0))).otherwise(acc["digit"])
        return (
            F.when(d.isNotNull(), F.struct(acc["all"].alias("all"), acc["part"].alias("part"), d.cast("bigint").alias("digit")))
            .when(u.isNotNull(), F.struct(acc["all"].alias("all"), (acc["part"] + more * u).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("digit")))
            .otherwise(F.struct(((acc["all"] + acc["part"] + acc["digit"]) * 10000).alias("all"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("digit")))
        )

    said = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), zero, step, lambda acc: acc["all"] + acc["part"] + acc["digit"])
    return F.when(c.rlike(r"^\d{1,9}$"), F.try_to_number(c, F.lit("999999999")).cast("bigint")).when(c.rlike("^[零〇一二两三四五六七八九十百千万]+$"), said)


def ordinal(title: Column) -> Column:
    """A chapter's number: 第12章, 第十二章, 12.第…, 12、…"""
    said = F.regexp_extract(title, r"第\s*([0-9]{1,9}|[零〇一二两三四五六七八九十百千万]+)\s*[章节回]", 1)
    led = F.regexp_extract(title, r"^\s*([0-9]{1,9})\s*[.、．:：\s]", 1)
    return F.coalesce(numeral(F.nullif(said, F.lit(""))), numeral(F.nullif(led, F.lit(""))))


def leading(title: Column) -> Column:
    """The number that a title begins with, before one of a chapter."""
    return F.coalesce(numeral(F.nullif(F.regexp_extract(title, r"^\s*([0-9]{1,9})\s*[.、．:：\s]", 1), F.lit(""))), ordinal(title))


def bare(title: Column) -> Column:
    """A title without white space and brackets."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s【】《》（）()]", "")


def outside(title: Column) -> Column:
    """Whether a title is that of no part of the story: an empty one, or one that says so and is no prologue's."""
    t = bare(title)
    return (t == "") | (t.rlike("|".join(OUTSIDE)) & ~t.isin(*PROLOGUES))


def story_ordinal(title: Column) -> Column:
    """The number that a title begins with: 12、…, 第12章, 第十二章, 十二节."""
    t = bare(title)
    arabic = F.regexp_extract(t, r"^第?(\d{1,5})(?:[章节回话集部卷篇.、:：]|$)", 1)
    said = F.regexp_extract(t, r"^第?([零〇一二两三四五六七八九十百千万]+)[章节回话集部卷篇]", 1)
    return F.coalesce(numeral(F.nullif(arabic, F.lit(""))), numeral(F.nullif(said, F.lit(""))))


def front_loaded(title: Column, index: str, by: list[str]) -> Column:
    """Latest chapters put before the first: a number of 50 or more within the first 31 places, before chapter 1 or soon followed by a number up to 10."""
    n = story_ordinal(title)
    w = Window.partitionBy(*by).orderBy(index)
    ahead = F.min(n).over(w.rowsBetween(1, 19))
    first = F.min(F.when(n == 1, F.col(index))).over(Window.partitionBy(*by))
    return F.coalesce((n >= 50) & (F.col(index) <= 30) & ((F.col(index) < first) | (ahead <= 10)), F.lit(False))
