"""Following links to a fixed point: tables of contents and contents that go on over several pages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioq.functions.urls import next_page_follows


def _shared(spark: SparkSession, name: str) -> str:
    """A folder of the shared one. A local master has one machine only and so may do without spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/folioq-{spark.sparkContext.applicationId}"
    return f"{folder.rstrip('/')}/folioq/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, and a lost executor costs no earlier round."""
    path = _shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def followed(starts: DataFrame, links: DataFrame, guarded: bool = False) -> DataFrame:
    """(chain, url, depth): from each start (url, chain) along links (url, next), each page once per chain.

    Only pages that have a row in links are followed to (a last page has one without next). guarded: links of content
    pages count only where they lead to a further page of the same text. Where pages have one link each, a round doubles
    the distance that links lead, so a chain takes as many rounds as its length has bits; else a round is a step. All
    rounds end when one adds nothing, so cycles end, too, and none is too long.
    """
    there = links.select(F.col("url").alias("next")).distinct()
    steps = links.where("next IS NOT NULL AND next <> ''")
    steps = steps.where(next_page_follows(F.col("url"), F.col("next"))) if guarded else steps
    jump = kept(steps.select("url", "next").distinct().join(there, "next", "left_semi").select("url", "next"), "links")
    doubled = jump.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    known = kept(starts.select("chain", "url", F.lit(0).alias("depth")).dropDuplicates(["chain", "url"]), "chain")
    newest, far = known, 1
    while True:
        ahead = (known if doubled else newest).join(jump, "url").select("chain", F.col("next").alias("url"), (F.col("depth") + far).alias("depth"))
        fresh = kept(ahead.join(known.select("chain", "url"), ["chain", "url"], "left_anti").groupBy("chain", "url").agg(F.min("depth").alias("depth")), "fresh")
        if fresh.isEmpty():
            return known
        newest, known = fresh, kept(known.unionByName(fresh), "chain")
        if doubled:
            jump, far = kept(jump.join(jump.toDF("next", "after"), "next").select("url", F.col("after").alias("next")), "links"), far * 2


def toc_pages(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(chain, url, depth) of a table of contents: links (url, pos, next), an order of a page's links being pos.

    A first page with several next pages lists them all: each is read once and none further. One with a single next page
    is followed from page to page (the first link of each) until a page has none or was there already.
    """
    some = links.where("next IS NOT NULL AND next <> ''").groupBy("url", "next").agg(F.min("pos").alias("pos"))
    several = some.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
    listed = starts.join(several, "url", "left_semi")
    own = listed.select("chain", "url", F.lit(0).alias("depth"))
    place = F.row_number().over(Window.partitionBy("chain").orderBy("pos", "next"))
    further = listed.join(some, "url").where("next <> url").select("chain", F.col("next").alias("url"), place.alias("depth"))
    further = further.join(links.select("url").distinct(), "url", "left_semi").select("chain", "url", "depth")
    firsts = links.groupBy("url").agg(F.min_by("next", F.when(F.coalesce("next", F.lit("")) != "", F.col("pos"))).alias("next"))
    single = followed(starts.join(several, "url", "left_anti"), firsts)
    return single.unionByName(own).unionByName(further.dropDuplicates(["chain", "url"]))


def joined_text(order: DataFrame, pages: DataFrame, chain: Sequence[str] = ("chain",)) -> DataFrame:
    """(chain, pages, content): texts (url, text) of followed pages in their order, a line each, blank ones left out."""
    rows = order.join(pages.select("url", "text"), "url").where("trim(text) <> ''")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(*chain).agg(F.count("*").alias("pages"), F.max("depth").alias("last"), content.alias("content"))


def catalogue(chapters: DataFrame, order: DataFrame, book: str = "chain") -> DataFrame:
    """Chapters (url of their page, pos, chapter_url, title) in the order of followed pages, each chapter once, numbered."""
    from folioq.operators.merge import first_rows

    rows = chapters.join(order, "url")
    once = first_rows(rows, [book, "chapter_url"], ["depth", "pos"])
    return once.withColumn("index", F.row_number().over(Window.partitionBy(book).orderBy("depth", "pos")) - 1).select(book, "index", "title", "chapter_url")
