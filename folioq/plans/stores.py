"""Queries of sources and sinks: files, feeds, rule sets, stored tables, pages that go on, streams. Files are built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from folioq.functions import text as T, titles
from folioq.operators import books, recurse, rules, shelf
from folioq.operators.batches import dealt
from folioq.plans import samples
from folioq.plans.base import query, table
from folioq.sources import charset, epub, feed, fetch, files, rulesets, store, txt
from folioq.streaming import incremental, ratelimit


def _folder(spark: SparkSession, name: str) -> str:
    return recurse._shared(spark, name)


# plain text

HEADS = ("第壹章", "第１章 开始", "卷拾", "第三回：风，起", "第十二章风起。", "  第5节 a  ", "序 不是", "第百章,x", "第一章起风", "第2章-x。", "卷3", "第四部分的故事说完了")
_HEADS = "['第壹章', '第１章 开始', '卷拾', '第三回：风，起', '第十二章风起。', '第5节 a', '序 不是', '第百章,x', '第一章起风', '第2章-x。', '卷3', '第四部分的故事说完了']"
_IS_HEAD = "[true, true, true, true, false, true, false, true, true, true, true, true]"


@query(f"SELECT p_partkey AS doc_id, CAST(CASE WHEN h THEN k ELSE 0 END AS INTEGER) AS \"index\", CASE WHEN NOT h THEN '正文' WHEN k = 0 THEN '序章' ELSE t END AS title FROM (SELECT p_partkey, {_HEADS}[1 + p_partkey % 12] AS t, {_IS_HEAD}[1 + p_partkey % 12] AS h FROM part), range(2) r(k) WHERE h OR k = 0")
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is a chapter's heading, and what isn't."""
    head = F.element_at(F.array(*[F.lit(x) for x in HEADS]), (1 + F.col("p_partkey") % 12).cast("int"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("before\n"), head, F.lit("\nbody of "), F.col("p_name")).alias("text"))
    return books.chapters(docs).select("doc_id", "index", "title")


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, 'before ' || doc_id || chr(10) || '第１章 一' || chr(10) || trim(regexp_replace(text, '\s+', ' ', 'g')) || chr(10) || '第贰章' || chr(10) || 'end' AS whole FROM documents)
SELECT 'local-txt:' || md5('ns:file:' || md5(whole)) AS "bookUrl", 'book_ ' || doc_id AS name, CAST(k AS INTEGER) AS "index", ['序章', '第１章 一', '第贰章'][k + 1] AS title, md5(['before ' || doc_id, x, 'end'][k + 1]) AS content FROM t, range(3) r(k)""")
def text_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in UTF-8 (with and without a mark) and GB18030, cut into chapters."""
    one = F.trim(F.regexp_replace("text", r"\s+", " "))
    whole = F.concat(F.lit("before "), "doc_id", F.lit("\n第１章 一\n"), one, F.lit("\n第贰章\nend"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("file:/d/book%3A%20"), "doc_id", F.lit(".txt")).alias("path"), (F.col("doc_id") % 3).cast("string").alias("url"), whole.alias("html"))
    raw = rules.mapped(rows, "html", "url", "content", BinaryType(), lambda t, how: t.encode("gb18030") if how == "2" else (b"\xef\xbb\xbf" if how == "1" else b"") + t.encode())
    found = txt.imported(raw.select("path", F.octet_length("content").cast("long").alias("length"), "content"), "ns")
    return txt.chapters(found, keep=("name",)).select("bookUrl", "name", "index", "title", F.md5("content").alias("content"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to text by what the caller says, by the content type, by the page's own tag, and as UTF-8."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).cast("string").alias("url"), F.col("text").alias("html"))

    def of(t: str, how: str) -> bytes:
        return t.encode("gb18030") if how in ("0", "1") else b'<meta charset="utf-16-le">' + t.encode("utf-16-le") if how == "9" else ("<meta charset=gbk>" + t).encode("gb18030") if how == "2" else t.encode()

    raw = rules.mapped(rows, "html", "url", "body", BinaryType(), of)
    raw = raw.select("doc_id", "body", F.when(F.col("url") == "0", "gb2312").alias("given"), F.when(F.col("url") == "1", "text/html; charset=GBK").alias("kind"))
    return charset.with_text(raw, "body", "text", "given", "kind").select("doc_id", F.md5(F.regexp_replace("text", "^<meta charset=gbk>", "")).alias("text"))


# EPUB


@query("""SELECT p_partkey AS k, p_name AS "bookTitle", p_brand AS author, CASE WHEN p_partkey % 2 = 1 THEN 'O/i/p.png' ELSE 'O/i/cover.png' END AS cover, CAST(i AS INTEGER) AS "index", ['O/t/b.xhtml', 'O/t/a.xhtml', 'O/t/d.xhtml'][i + 1] AS path, ['Head ' || p_brand, 'From nav', '第 3 章'][i + 1] AS title,
['<p>b</p>', '<h1>' || p_name || '</h1><p>One <b>two</b><img src="O/i/p.png"></p><a href="#n">in</a><a>out</a>kept text', '<p>d e</p>'][i + 1] AS html FROM part, range(3) r(i)""")
def epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books from archives: the spine's pages, titles from the navigation, the head or a number, covers, cleaned markup."""
    rows = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("|", "p_name", "p_brand", F.col("p_partkey")).alias("html")))

    def of(text: str, _: str) -> bytes:
        name, brand, k = text.split("|")
        return samples.epub_file(name, brand, int(k))

    raw = rules.mapped(rows, "html", None, "content", BinaryType(), of)
    return epub.imported(raw, "ns", keep=("k",)).select("k", "bookTitle", "author", "cover", "index", "path", "title", "html")


@query("SELECT p_partkey AS k, 'a/b/' || p_size AS inside, NULL AS above, NULL AS rooted, NULL AS schemed FROM part")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within an archive; those that lead out of it are none."""
    names = ("inside", "above", "rooted", "schemed")
    rows = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("html")))
    of = lambda n, _: dict(zip(names, (epub.safe_join("a/c", f"../b/{n}#x"), epub.safe_join("a", f"../../{n}"), epub.safe_join("a", f"/{n}"), epub.safe_join("a", f"file:{n}"))))
    return rules.mapped(rows, "html", None, "_r", StructType([StructField(c, StringType()) for c in names]), of).select("k", "_r.*")


# feeds


@query("""SELECT event_id AS origin, CAST(k AS BIGINT) AS seq, CASE k WHEN 0 THEN event_type ELSE 'Atom ' || user_id END AS title, 'https://f.test/' || event_id || '/' || k AS link, CASE k WHEN 0 THEN 'D' ELSE 'S' END AS description, CASE k WHEN 0 THEN NULL ELSE 'https://i.test/' || event_id || '.png' END AS image,
CASE WHEN k = 0 THEN 1704067200 + 86400 * (event_id % 28) ELSE 7 END AS "order" FROM events, range(2) r(k)""")
def feed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS items and Atom entries as rows; entries without a time are ordered at a given one."""
    day, origin = F.lpad((1 + F.col("event_id") % 28).cast("string"), 2, "0"), F.col("event_id")
    rss = F.concat(F.lit("<rss><channel><item><title>"), "event_type", F.lit("</title><link>https://f.test/"), origin, F.lit("/0</link><description>D</description><pubDate>2024-01-"), day, F.lit("T00:00:00Z</pubDate></item>"))
    atom = F.concat(F.lit('<entry xmlns="http://www.w3.org/2005/Atom" xmlns:media="m"><title>Atom '), "user_id", F.lit('</title><link rel="alternate" href="https://f.test/'), origin, F.lit('/1"/><summary>S</summary><media:thumbnail url="https://i.test/'), origin, F.lit('.png"/></entry></channel></rss>'))
    events = dealt(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
    rows = events.select(origin.alias("origin"), F.concat(rss, atom).alias("body"))
    return feed.read(rows, now=7).select("origin", "seq", "title", "link", "description", "image", "order")


@query("SELECT origin, seq, rn FROM (SELECT event_type AS origin, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) DESC, event_id) AS rn FROM events) WHERE rn <= 50")
def feed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each feed, newest first (a page has fifty)."""
    from folioq.operators.windows import micros

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("origin"), F.col("event_id").alias("seq"), micros("ts").alias("order"))
    return feed.newest(rows).select("origin", "seq", F.col("rn").cast("long").alias("rn"))


@query("SELECT page_id, '' AS whole, regexp_replace(regexp_extract(html, '<article>(.*)', 1, 's'), '(?s)<script.*?</script>', '', 'g') AS part FROM pages")
def feed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's content; one that is a whole page is none."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", feed.readable(F.col("html")).alias("whole"), feed.readable(F.regexp_extract("html", "(?s)<article>(.*)", 1)).alias("part"))


# rule sets

_FIELDS = """('ruleSearch', 'bookList', 'ruleSearchList'), ('ruleSearch', 'name', 'ruleSearchName'), ('ruleSearch', 'author', 'ruleSearchAuthor'), ('ruleSearch', 'intro', 'ruleSearchIntro'), ('ruleSearch', 'kind', 'ruleSearchKind'), ('ruleSearch', 'lastChapter', 'ruleSearchLastChapter'), ('ruleSearch', 'updateTime', 'ruleSearchUpdateTime'), ('ruleSearch', 'bookUrl', 'ruleSearchNoteUrl'), ('ruleSearch', 'coverUrl', 'ruleSearchCoverUrl'), ('ruleSearch', 'wordCount', 'ruleSearchWordCount'),
('ruleExplore', 'bookList', 'ruleFindList'), ('ruleExplore', 'name', 'ruleFindName'), ('ruleExplore', 'author', 'ruleFindAuthor'), ('ruleExplore', 'intro', 'ruleFindIntro'), ('ruleExplore', 'kind', 'ruleFindKind'), ('ruleExplore', 'lastChapter', 'ruleFindLastChapter'), ('ruleExplore', 'updateTime', 'ruleFindUpdateTime'), ('ruleExplore', 'bookUrl', 'ruleFindNoteUrl'), ('ruleExplore', 'coverUrl', 'ruleFindCoverUrl'), ('ruleExplore', 'wordCount', 'ruleFindWordCount'),
('ruleBookInfo', 'init', 'ruleBookInfoInit'), ('ruleBookInfo', 'name', 'ruleBookName'), ('ruleBookInfo', 'author', 'ruleBookAuthor'), ('ruleBookInfo', 'intro', 'ruleIntroduce'), ('ruleBookInfo', 'kind', 'ruleBookKind'), ('ruleBookInfo', 'lastChapter', 'ruleBookLastChapter'), ('ruleBookInfo', 'updateTime', 'ruleBookUpdateTime'), ('ruleBookInfo', 'coverUrl', 'ruleCoverUrl'), ('ruleBookInfo', 'wordCount', 'ruleBookWordCount'), ('ruleBookInfo', 'tocUrl', 'ruleChapterUrl'),
('ruleToc', 'chapterList', 'ruleChapterList'), ('ruleToc', 'chapterName', 'ruleChapterName'), ('ruleToc', 'chapterUrl', 'ruleContentUrl'), ('ruleToc', 'updateTime', 'ruleChapterUpdateTime'), ('ruleToc', 'nextTocUrl', 'ruleChapterUrlNext'),
('ruleContent', 'content', 'ruleBookContent'), ('ruleContent', 'replaceRegex', 'ruleBookContentReplace'), ('ruleContent', 'nextContentUrl', 'ruleContentUrlNext'), ('ruleContent', 'title', 'ruleContentTitle')"""


@query(f"SELECT s_suppkey AS k, rule, field, old || '-' || s_suppkey AS value FROM supplier, (VALUES {_FIELDS}) f(rule, field, old)")
def rule_set_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule field of the old form in its place of today's."""
    moved = rulesets.MOVED
    named = [F.concat(F.lit(f'"{old}":"{old}-'), "s_suppkey", F.lit('"')) for fields in moved.values() for old in fields]
    text = F.concat(F.lit('{"bookSourceUrl":"'), "s_suppkey", F.lit('",'), F.concat_ws(",", *named), F.lit("}"))
    got = rulesets.read(table(spark, sf_dir, "supplier").select(text.alias("value")))
    pairs = [(rule, field) for rule, fields in moved.items() for field in dict.fromkeys(fields.values())]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(f).alias("field"), F.get_json_object("json", f"$.{r}.{f}").alias("value")) for r, f in pairs])
    return got.select(F.col("bookSourceUrl").cast("long").alias("k"), F.explode(rows).alias("r")).select("k", "r.*").where("value IS NOT NULL")


@query("""SELECT CASE k WHEN 2 THEN NULL ELSE 'u' || s_suppkey || '/' || k END AS url, CASE k WHEN 0 THEN false WHEN 1 THEN true END AS enabled, CASE k WHEN 0 THEN 5 WHEN 1 THEN 0 END AS "customOrder", CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 END AS kind, CASE k WHEN 0 THEN '/f?q={{key}}' WHEN 1 THEN '/n' END AS search,
CASE k WHEN 0 THEN '/login?p={{page}}' END AS login, CASE k WHEN 0 THEN 'p-' || s_suppkey END AS pattern, CASE k WHEN 0 THEN '{"User-Agent": "UA"}' END AS header, k = 2 AS bad FROM supplier, range(3) r(k)""")
def rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources from wrappers, in old and new form; a text that is no JSON is a row with its problem."""
    k = F.col("s_suppkey")
    old = F.concat(F.lit('{"bookSourceUrl":"u'), k, F.lit('/0","enable":false,"serialNumber":"5","bookSourceType":"audio","ruleSearchUrl":"/f?q=searchKey","loginUrl":"/login?p=searchPage","ruleBookUrlPattern":"p-'), k, F.lit('","httpUserAgent":"UA"}'))
    new = F.concat(F.lit('{"bookSourceUrl":"u'), k, F.lit('/1","searchUrl":"/n","bookSourceType":0}'))
    texts = F.array(F.concat(F.lit('{"bookSources":['), old, F.lit(","), new, F.lit("]}")), F.lit("{broken"))
    got = rulesets.read(table(spark, sf_dir, "supplier").select(F.explode(texts).alias("value")))
    of = lambda name: F.get_json_object("json", f"$.{name}")
    return got.select(F.col("bookSourceUrl").alias("url"), "enabled", F.col("customOrder").cast("int").alias("customOrder"), of("bookSourceType").cast("int").alias("kind"), of("searchUrl").alias("search"), of("loginUrl").alias("login"), of("bookUrlPattern").alias("pattern"), of("header").alias("header"), F.col("problem").isNotNull().alias("bad"))


@query("SELECT 'f' || s_suppkey AS \"sourceUrl\", s_name AS \"sourceName\", s_suppkey % 2 = 0 AS enabled FROM supplier")
def feed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"rssSources":[{"sourceUrl":"f'), "s_suppkey", F.lit('","sourceName":"'), "s_name", F.lit('","enabled":'), F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false"), F.lit('},{"sourceName":"no url"}]}'))
    return rulesets.read_feeds(table(spark, sf_dir, "supplier").select(text.alias("value"))).select("sourceUrl", "sourceName", "enabled")


@query("SELECT s_suppkey AS k, 'b' || s_suppkey || '/' || i AS \"bookUrl\", CASE i WHEN 0 THEN 'first' ELSE 'other' END AS name FROM supplier, range(2) r(i)")
def shelf_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged shelf: JSON values one after another, broken ones between them, each book once."""
    one = lambda i, name: F.concat(F.lit('{"bookUrl":"b'), "s_suppkey", F.lit(f'/{i}","origin":"o","name":"{name}"}}'))
    text = F.concat(F.lit("[["), one(0, "first"), F.lit("]garbage{"), one(1, "other"), F.lit('{"bookUrl":'), one(0, "again"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("html"))
    kind = ArrayType(StructType([StructField(c, StringType()) for c in ("bookUrl", "name")]))
    return rules.mapped(rows, "html", None, "_r", kind, lambda t, _: [{"bookUrl": b["bookUrl"], "name": b["name"]} for b in rulesets.recovered(t)]).select("k", F.explode("_r").alias("b")).select("k", "b.*")


# requests


@query("SELECT 'https://n.test/' || event_id || '?final' AS url, CAST(CASE event_id % 3 WHEN 0 THEN 503 WHEN 1 THEN 404 ELSE 200 END AS INTEGER) AS status, 'body ' || event_id AS body, CAST(CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM events")
def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a server played by a function: failures of the server are tried again, others aren't."""
    rows = dealt(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.lit(1).alias("page")))
    return fetch.fetch(fetch.requests(rows, "https://n.test/{{key}}"), samples.answer, 0.0).select("url", "status", "body", "attempts")


@query("SELECT page_id, CAST(CASE WHEN page_id % 4 = 3 THEN 404 ELSE 200 END AS INTEGER) AS status, CASE WHEN page_id % 4 = 3 THEN NULL ELSE md5(html) END AS body FROM pages")
def fetch_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default: requests are answered from a table of pages; what isn't there is not found."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.concat(F.lit("https://p.test/"), "page_id").alias("url"))
    asked = fetch.requests(pages.select(F.col("page_id").cast("string").alias("key"), F.lit(1).alias("page")), "https://p.test/{{key}}")
    got = fetch.stored(asked, pages.where("page_id % 4 <> 3"))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "status", F.md5("body").alias("body"))


# stored tables


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS name, p_partkey % 4 = 1 AS copied FROM part WHERE p_partkey % 5 <> 0")
def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by key: saved, saved over, deleted from, copied into another."""
    schema = StructType().add("k", "long").add("name", "string")
    main, other = (store.Table(spark, _folder(spark, n), schema, ["k"]) for n in ("table", "copy"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("name"))
    main.upsert(part, 1)
    main.upsert(part.where("k % 3 = 0").withColumn("name", F.concat("name", F.lit("!"))), 2)
    main.delete(part.where("k % 5 = 0").select("k"), 3)
    few = store.Table(spark, _folder(spark, "few"), schema, ["k"])
    few.replace(part)
    few.replace(main.read().where("k % 4 = 1"))
    few.copy(other, 1)
    return main.read().join(other.read().select("k", F.lit(True).alias("c")), "k", "left").select("k", "name", F.coalesce("c", F.lit(False)).alias("copied"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def backup_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables into one table of JSON rows, and out of it again."""
    n, r = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = store.bundle({"nation": n, "region": r})
    a, b = store.unbundled(rows, "nation", n.schema), store.unbundled(rows, "region", r.schema)
    return a.join(b, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT CASE WHEN c_custkey % 9 = 0 THEN 'local-' ELSE 'b' END || c_custkey AS \"bookUrl\", CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE coalesce(n, 0) END AS \"cachedChapterCount\" FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) ON o_custkey = c_custkey")
def cached_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each book's chapters a cache has; what it has of no chapter doesn't count."""
    url = lambda c: F.concat(F.when(F.col(c) % 9 == 0, "local-").otherwise("b"), c).alias("bookUrl")
    chapters = table(spark, sf_dir, "orders").select(url("o_custkey"), F.col("o_orderkey").cast("string").alias("url"))
    cache = chapters.where("CAST(url AS BIGINT) % 3 <> 0")
    cache = cache.unionByName(cache).unionByName(cache.withColumn("url", F.concat(F.lit("old"), "url")))
    return store.cached_counts(table(spark, sf_dir, "customer").select(url("c_custkey")), chapters, cache)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS \"index\" FROM orders")
def toc_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached table of contents with more behind it, indexed anew."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return books.reindexed(rows, ["o_custkey"], ["o_orderkey"]).withColumn("index", F.col("index").cast("long"))


@query("SELECT 'd' || (p_partkey % 3) AS name, true AS is_folder, NULL::BIGINT AS size FROM part WHERE p_partkey % 2 = 1 GROUP BY 1 UNION ALL SELECT 'f' || p_partkey, false, p_size FROM part WHERE p_partkey % 2 = 0")
def file_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of a tree of files: its folders, and its own files."""
    folder = F.when(F.col("p_partkey") % 2 == 0, F.lit("/r")).otherwise(F.concat(F.lit("/r/d"), F.col("p_partkey") % 3, F.lit("/deep")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("name"), folder.alias("folder"), F.col("p_size").cast("long").alias("size"))
    return files.children(rows, "/r/")


@query("SELECT CASE WHEN c_custkey = 7 THEN 'new' ELSE 'b' || c_custkey END AS \"bookUrl\", CASE WHEN c_custkey = 7 THEN 'From elsewhere' ELSE c_name END AS name, c_mktsegment AS kind FROM customer")
def source_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book with another source's fields; what the candidate doesn't say stays."""
    books_ = table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), "c_custkey").alias("bookUrl"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    candidate = spark.createDataFrame([("new", "From elsewhere", None)], "bookUrl string, name string, kind string")
    return shelf.switched(books_, "b7", candidate)


# pages that go on


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, turn, conv_id % 2 = 0 AS several, n FROM conversations JOIN c USING (conv_id))
SELECT conv_id AS chain, conv_id || '/' || turn AS url, CAST(turn AS INTEGER) AS depth FROM p WHERE NOT several OR turn < 3""")
def toc_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next pages of a table of contents: several at once are read once each and no further, a single one is followed."""
    c = table(spark, sf_dir, "conversations")
    url = lambda t: F.concat_ws("/", "conv_id", t.cast("string"))
    several = F.col("conv_id") % 2 == 0
    ahead = F.when(several & (F.col("turn") == 0), F.array(F.struct(F.lit(1).alias("pos"), url(F.lit(1)).alias("next")), F.struct(F.lit(2).alias("pos"), url(F.lit(2)).alias("next")), F.struct(F.lit(3).alias("pos"), url(F.lit(1)).alias("next"))))
    links = c.select(url(F.col("turn")).alias("url"), F.explode(F.coalesce(ahead, F.array(F.struct(F.lit(1).alias("pos"), url(F.col("turn") + 1).alias("next"))))).alias("l")).select("url", "l.*")
    return recurse.toc_pages(c.where("turn = 0").select(F.col("conv_id").alias("chain"), F.lit(0).alias("z"), url(F.lit(0)).alias("url")).drop("z"), links)


@query("""WITH n AS (SELECT conv_id, min(turn) FILTER (turn % 5 = 4) AS stop, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS chain, count(*) AS pages, md5(string_agg(text, chr(10) ORDER BY turn)) AS content FROM conversations JOIN n USING (conv_id) WHERE (stop IS NULL OR turn < stop) AND trim(text) <> '' GROUP BY conv_id""")
def content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content over pages: followed only while the next link is a further page of the same text."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    name = lambda t: F.concat(F.lit("https://c.test/"), "conv_id", F.when(t == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (t + 1).cast("string"))), F.lit(".html"))
    here = F.when(turn % 5 == 4, F.concat(F.lit("https://c.test/other/"), "conv_id", F.lit("-"), turn)).otherwise(name(turn))
    ahead = F.when((turn + 1) % 5 == 4, F.concat(F.lit("https://c.test/other/"), "conv_id", F.lit("-"), turn + 1)).otherwise(name(turn + 1))
    pages = c.select(here.alias("url"), ahead.alias("next"), "text", "conv_id", "turn")
    order = recurse.followed(pages.where("turn = 0").select("url", F.col("conv_id").alias("chain")), pages.select("url", "next"), guarded=True)
    return recurse.joined_text(order, pages).select("chain", "pages", F.md5("content").alias("content"))


# speech


_CUT = "CASE WHEN length(rem) <= 70 THEN length(rem) ELSE (SELECT CASE WHEN m > 0 THEN m ELSE 70 END FROM (SELECT greatest({}) AS m)) END".format(", ".join(f"CASE WHEN contains(substr(rem, 1, 71), '{c}') THEN 71 - strpos(reverse(substr(rem, 1, 71)), '{c}') ELSE -1 END" for c in "，、, "))


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(translate(text, '。！？!?；;', '.......'), '[\s ]+', ' ', 'g')) AS x FROM documents), s AS (SELECT doc_id, 0 AS seq, '' AS chunk, x AS rem FROM t UNION ALL
SELECT doc_id, seq + 1, trim(substr(rem, 1, n)), trim(substr(rem, n + 1)) FROM (SELECT *, {_CUT} AS n FROM s WHERE rem <> '')) SELECT doc_id, CAST(seq - 1 AS INTEGER) AS seq, chunk FROM s WHERE seq > 0""")
def doc_speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as one long sentence each, cut into chunks of up to 70 characters before their last breaks."""
    one = F.trim(F.regexp_replace(F.translate("text", "。！？!?；;", "......."), r"[\s ]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(one)).alias("seq", "chunk"))


@query("""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' '), lambda x: x[1:69]), lambda x: x <> '') AS ws FROM documents), p AS (SELECT doc_id, list_transform(ws, lambda x: [x || '。']) AS ps FROM w WHERE len(ws) > 0)
SELECT doc_id, md5(array_to_string(list_reduce(ps, lambda a, b: CASE WHEN length(a[-1]) + length(b[1]) <= 70 THEN list_append(a[:-2], a[-1] || b[1]) ELSE list_concat(a, b) END), '|')) AS chunks FROM p""")
def doc_speech_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sentences joined while they fit."""
    words = F.filter(F.transform(F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " "), lambda x: F.substring(x, 1, 69)), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(words, lambda x: F.concat(x, F.lit("。"))), "").alias("t")).where("t <> ''")
    return docs.select("doc_id", F.md5(F.array_join(T.chunks(F.col("t")), "|")).alias("chunks"))


TITLES = (*titles.OUTSIDE, *titles.PROLOGUES, "第一章 开端", "", " 【】 ", "序章 番外", "《楔子》", "开始")
_TITLES = "'番外', '外传', '新书', '新番外', '公告', '通知', '说明', '感言', '请假', '断更', '恢复更新', '更新时间', '求票', '月票', '推荐票', '打赏', '推书', '书友群', '群号', '活动', '抽奖', '实体书', '出版', '完本', '上架', '序章', '楔子', '引子', '序', '前言', '第一章 开端', '', ' 【】 ', '序章 番外', '《楔子》', '开始'"


@query(f"SELECT conv_id, turn, i <= 25 OR i IN (32, 33, 34) AS outside, i <= 25 OR i IN (33, 34) AS within FROM (SELECT conv_id, turn, CAST(1 + (conv_id * 7 + turn) % 36 AS INTEGER) AS i, [{_TITLES}] AS ts FROM conversations) WHERE len(ts) = 36".replace("i IN (33, 34) AS within", "i = 34 OR i BETWEEN 26 AND 30 AS within").replace("i <= 25 OR i = 34 OR i BETWEEN 26 AND 30 AS within", "i <= 25 OR i = 34 AS within"))
def chapter_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are no part of the story: alone, and (within) with a number before them."""
    title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (1 + (F.col("conv_id") * 7 + F.col("turn")) % 36).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", titles.outside(title).alias("outside"), titles.outside(F.concat(F.lit("12 "), title)).alias("within"))


# streams: each runs over all that there is, and what its sink then holds is the result


def _arrivals(spark: SparkSession, rows: DataFrame, name: str, n: int = 4) -> DataFrame:
    folder = _folder(spark, name)
    rows.repartition(n).write.parquet(folder)
    return incremental.arriving(spark, folder, rows.schema, 1)


@query("SELECT lower(trim(lang)) || '|' || lower(trim(source)) AS key, false AS has_more FROM documents GROUP BY 1")
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as sources answer, each name and author once, on its first arrival."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.col("source").alias("author"), F.col("doc_id").alias("source_index"))
    folder = _folder(spark, "search")
    n = rows.select("name", "author").distinct().count()
    incremental.search(_arrivals(spark, rows, "arrivals"), f"{folder}/sink", f"{folder}/offsets", n).awaitTermination()
    more = incremental.progress(spark, f"{folder}/sink", rows.schema, enough=n)["has_more"]
    return spark.read.schema(rows.schema).parquet(f"{folder}/sink").select(F.concat_ws("|", F.lower("name"), F.lower("author")).alias("key"), F.lit(more).alias("has_more"))


@query("SELECT DISTINCT 'o' || (doc_id % 7) AS origin, 'b' || (doc_id % 3) AS \"bookUrl\" FROM documents WHERE lang = 'en' AND source = 'src1'")
def stream_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other sources' candidates for a book, each once, as they come."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.col("source").alias("author"), F.concat(F.lit("o"), F.col("doc_id") % 7).alias("origin"), F.concat(F.lit("b"), F.col("doc_id") % 3).alias("bookUrl"), F.col("doc_id").alias("source_index"))
    folder = _folder(spark, "switch")
    incremental.switch_search(_arrivals(spark, rows, "arrivals"), "en", "src1", f"{folder}/sink", f"{folder}/offsets", 1000).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/sink").select("origin", "bookUrl")


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS cached, count(*) FILTER (event_id % 3 = 1) AS success, count(*) FILTER (event_id % 3 = 2) AS failed FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of cached, fetched and failed chapters as they end; the last row stands for all."""
    rows = table(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(x) for x in ("cached", "success", "failed")]), (1 + F.col("event_id") % 3).cast("int")).alias("status"))
    folder = _folder(spark, "progress")
    incremental.cache_progress(_arrivals(spark, rows, "arrivals"), f"{folder}/sink", f"{folder}/offsets").awaitTermination()
    return spark.read.schema("cached bigint, success bigint, failed bigint, batch int").parquet(f"{folder}/sink").agg(*[F.max(c).alias(c) for c in ("cached", "success", "failed")])


@query("SELECT DISTINCT '/c/' || (turn // 2) AS url, count(*) OVER () AS n, true AS gapless FROM (SELECT DISTINCT turn // 2 AS turn FROM conversations) AS t(turn) ".replace("'/c/' || (turn // 2)", "'/c/' || turn"))
def stream_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further pages of a table of contents as they come: chapters once each, numbered without gaps."""
    rows = table(spark, sf_dir, "conversations").select(F.col("turn").cast("long").alias("seq"), F.lit("t").alias("title"), F.concat(F.lit("/c/"), F.floor(F.col("turn") / 2)).alias("url"))
    folder = _folder(spark, "toc")
    incremental.appended(_arrivals(spark, rows, "arrivals"), f"{folder}/sink", f"{folder}/offsets").awaitTermination()
    got = spark.read.schema("title string, url string, `index` bigint, batch int").parquet(f"{folder}/sink")
    all_ = got.agg(F.count("*").alias("n"), (F.countDistinct("index") == F.max("index") + 1).alias("gapless"))
    return got.select("url").crossJoin(all_)  # by one row


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ask FROM events")
def rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of users who may start very often: each starts when it asks."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    got = ratelimit.admitted(rows, "user_id", "ts", 1_000_000, 1, "event_id")
    return got.select("event_id", F.col("start_ms").alias("ask"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ask, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, ask AS start_ms, [ask] AS last FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.n, x.start_ms, list_append(CASE WHEN len(s.last) >= 3 THEN s.last[-2:] ELSE s.last END, x.start_ms) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1, LATERAL (SELECT greatest(e.ask, s.last[-1], CASE WHEN len(s.last) >= 3 THEN s.last[-3] + 3600001 ELSE 0 END) AS start_ms) x)
SELECT event_id, start_ms FROM s""")
def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each call starts if a user may start three within an hour: later ones wait, which moves those behind them."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ratelimit.admitted(rows, "user_id", "ts", 3, 3_600_000, "event_id").select("event_id", "start_ms")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ask, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, ask AS start_ms FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(e.ask, s.start_ms + 7200001) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT event_id, start_ms FROM s""")
def rate_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call at a time, two hours apart."""
    limit, ms = ratelimit.parsed("7200000")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ratelimit.admitted(rows, "user_id", "ts", limit, ms, "event_id").select("event_id", "start_ms")


@query("""WITH l AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) FILTER (event_id % 4 <> 0) AS value, max(ts) FILTER (event_id % 4 <> 0) AS f FROM events GROUP BY user_id) SELECT key, value, f >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 6 HOUR AS fresh FROM l""")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache whose entries live for six hours; a stale one still serves where fetching failed."""
    from folioq.operators.windows import micros

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("value"), F.col("ts").alias("fetched"))
    return incremental.cached_with_ttl(rows, "2024-01-29 00:00:00", 6 * 3600)


@query("SELECT user_id AS \"bookUrl\", max(event_id) AS processed, count(DISTINCT event_type) AS names FROM events GROUP BY user_id")
def stream_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each book's chapters have told so far; the newest row of each book is its state."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("bookUrl"), F.col("event_id").cast("long").alias("index"), F.col("event_type").alias("name"), F.lit("s").alias("status"))
    folder = _folder(spark, "memories")
    one = _arrivals(spark, rows, "arrivals", 1)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/sink/batch={number}")

    incremental.memories(one).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/sink")
    return got.groupBy("bookUrl").agg(F.max("processed").alias("processed"), F.max_by("names", "processed").alias("names"))
