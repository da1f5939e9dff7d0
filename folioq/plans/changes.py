"""Queries of changes, limits, and lists that go on over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioq.functions import text as T, urls as U
from folioq.operators import recurse, rules, shelf
from folioq.plans.base import query, table

_OLD = "SELECT 'u' || p_partkey AS bookUrl, p_name AS name, p_brand AS author, p_size AS durChapterIndex FROM part WHERE p_partkey % 3 = 0"
_NEW = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE 'v' END || p_partkey AS bookUrl, p_name AS name, p_brand AS author, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 99 END AS durChapterIndex FROM part WHERE p_partkey % 4 = 1 OR p_partkey % 6 = 0"


def _shelves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    row = lambda url, size: [url.alias("bookUrl"), F.col("p_name").alias("name"), F.col("p_brand").alias("author"), size.alias("durChapterIndex")]
    old = part.where(k % 3 == 0).select(*row(F.concat(F.lit("u"), k), F.col("p_size")))
    new = part.where((k % 4 == 1) | (k % 6 == 0)).select(*row(F.concat(F.when(k % 2 == 0, "u").otherwise("v"), k), F.when(k % 5 != 0, F.lit(99))))
    return old, new


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), f AS (SELECT name, author, arg_min(durChapterIndex, bookUrl) AS i, min(bookUrl) AS u FROM o GROUP BY name, author),
m AS (SELECT n.bookUrl, n.name, n.author, coalesce(n.durChapterIndex, CASE WHEN o.bookUrl IS NOT NULL THEN o.durChapterIndex ELSE f.i END) AS durChapterIndex, coalesce(o.bookUrl, f.u) AS replaces FROM n LEFT JOIN o USING (bookUrl) LEFT JOIN f ON f.name = n.name AND f.author = n.author)
SELECT * FROM o WHERE bookUrl NOT IN (SELECT replaces FROM m WHERE replaces IS NOT NULL) UNION ALL SELECT bookUrl, name, author, durChapterIndex FROM m""")
def shelf_save_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books saved over the shelf, found by URL or by name and author; progress is kept where the new row has none."""
    return shelf.saved(*_shelves(spark, sf_dir), kept=("durChapterIndex",))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE c_name END AS name, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, n_name) AS kind FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def shelf_complete_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    books = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("kind"))
    info = c.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("name"), F.col("n_name").alias("kind"))
    return shelf.completed(books, info, ("kind",), ("name",), "c_custkey")


@query("""WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderpriority AS title FROM orders), t AS (SELECT o_custkey, count(*) AS total, arg_max(title, i) AS latest FROM c GROUP BY o_custkey)
SELECT c_custkey AS "bookUrl", CASE WHEN c_custkey % 2 = 0 THEN CAST(2 AS BIGINT) END AS "durChapterIndex", CASE WHEN c_custkey % 2 = 0 THEN c.title END AS "durChapterTitle", CASE WHEN c_custkey % 2 = 0 THEN CAST(coalesce(total, 0) AS INTEGER) ELSE 0 END AS "totalChapterNum", CASE WHEN c_custkey % 2 = 0 THEN latest END AS "latestChapterTitle"
FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey AND c.i = 2""")
def shelf_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    chapters = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bookUrl"), i.cast("bigint").alias("index"), F.col("o_orderpriority").alias("title"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bookUrl"), F.lit(None).cast("bigint").alias("durChapterIndex"), F.lit(None).cast("int").alias("durChapterPos"), F.lit(None).cast("bigint").alias("durChapterTime"), F.lit(None).cast("string").alias("durChapterTitle"), F.lit(0).alias("totalChapterNum"), F.lit(None).cast("string").alias("latestChapterTitle"))
    progress = books.where("bookUrl % 2 = 0").select("bookUrl", F.lit(2).cast("bigint").alias("durChapterIndex"), F.lit(0).alias("durChapterPos"), F.lit(1).cast("bigint").alias("durChapterTime"))
    return shelf.with_progress(books, progress, chapters).drop("durChapterPos", "durChapterTime")


@query("SELECT p_partkey, (((p_size & 7) | 4) & ~CAST(1 AS BIGINT)) AS \"group\" FROM part WHERE (p_size & 3) <> 0")
def shelf_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").bitwiseAND(F.lit(7).cast("bigint")).alias("group"))
    return shelf.regrouped(books.where(shelf.in_group(F.col("group"), 3)), add=4, remove=1)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_suppkey % 3 = 0 THEN '小说,失效' ELSE '小说' END AS \"bookSourceGroup\" FROM supplier")
def sources_mark_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, "小说；失效").otherwise("小说").alias("bookSourceGroup"))
    return shelf.marked(rows, (F.col("s_acctbal") < 0) | (F.col("s_suppkey") % 3 == 0)).drop("s_acctbal")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return shelf.cascaded({"chapters": table(spark, sf_dir, "documents").select("doc_id")}, gone, "doc_id")["chapters"]


@query(r"""WITH l AS (SELECT page_id, url FROM pages), b AS (SELECT url FROM pages WHERE page_id = 0)
SELECT page_id, l.url FROM l, b WHERE l.url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0) AND NOT (regexp_extract(l.url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/en/25' AND regexp_extract(l.url, '^[a-z]+://([^/?#:]*)', 1) <> 'x.example.com')""")
def toc_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a table of contents still to be fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return shelf.pending(pages, pages.where("page_id % 5 = 0"), "https://x.example.com/en/25").select("page_id", "url")


@query("""WITH c AS (SELECT conv_id, turn, 'T' || (turn // 2) AS title, '/c/' || conv_id || '/' || (turn // 2) AS link FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, link ORDER BY turn) AS n FROM c)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS "index", title, 'https://t.test' || link AS chapter_url FROM f WHERE n = 1""")
def toc_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents over several pages: parsed by rules, followed by next links, each chapter once, numbered."""
    turn = F.col("turn")
    here = F.concat(F.lit("https://t.test/toc/"), "conv_id", F.lit("-"), turn)
    html = F.concat(F.lit('<ul class="toc"><li><a href="/c/'), "conv_id", F.lit("/"), F.floor(turn / 2), F.lit('">T'), F.floor(turn / 2), F.lit('</a></li></ul><a id="next" href="/toc/'), "conv_id", F.lit("-"), turn + 1, F.lit('">more</a>'))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", here.alias("url"), html.alias("html"))
    toc = {"chapterList": ".toc a", "chapterName": "@text", "chapterUrl": "@href"}
    chapters = rules.chapter_rows(pages.withColumn("page", F.col("url")), toc, keep=("page",))
    chapters = chapters.select(F.col("page").alias("url"), F.col("index").alias("pos"), F.col("url").alias("chapter_url"), "title")
    links = rules.item_rows(pages.withColumn("page", F.col("url")), "#next", {"bookUrl": "@href"}, keep=("page",)).select(F.col("page").alias("url"), F.col("bookUrl").alias("next"))
    order = recurse.followed(pages.where("turn = 0").select("url", F.col("conv_id").alias("chain")), links)
    return recurse.catalogue(chapters, order).withColumnRenamed("chain", "conv_id")


@query("""WITH b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT source, CAST(k // 100 AS BIGINT) AS batch, count(*) AS n FROM b GROUP BY ALL""")
def batches_of_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioq.operators.windows import batches

    return batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 100).groupBy("source", "batch").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS titled, length(left(trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), 240)) AS chars FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''""")
def page_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.regexp_extract("html", "<title>([^<]*)</title>", 1) != "")
    return pages.select("page_id", F.lit(True).alias("titled"), F.length(T.error_summary(F.col("html"))).cast("bigint").alias("chars"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpg' END AS ext, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS type FROM part""")
def cover_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in ("a.PNG?v=1", "b.webp#x", "c", "d.unknown")]), (1 + F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", U.extension(F.concat(F.lit("https://h/img/"), names)).alias("ext"))
    return rows.withColumn("type", U.content_type(F.col("ext")))


@query("""SELECT n_nationkey, 'T' || n_nationkey AS title, '/x/' || n_name AS url FROM nation UNION ALL SELECT n_nationkey, n_name, 'https://h/' || n_regionkey || '::p' FROM nation""")
def explore_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("T"), "n_nationkey", F.lit("::/x/"), "n_name", F.lit("\nno url<br>"), "n_name", F.lit("::https://h/"), "n_regionkey", F.lit("::p"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(T.explore_lines(text)).alias("k")).select("n_nationkey", "k.*")


@query("""WITH r AS (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL), f AS (SELECT *, CASE WHEN source = 'src1' THEN 0 WHEN source = 'src2' THEN 1 ELSE 2 END AS p FROM r) SELECT lang, source, doc_id FROM f QUALIFY p = min(p) OVER (PARTITION BY lang)""")
def first_filled_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several relations that has rows for a key."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    p = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(2)
    best = rows.withColumn("p", p).withColumn("m", F.min("p").over(Window.partitionBy("lang"))).where("p = m")
    return best.select("lang", "source", "doc_id")
