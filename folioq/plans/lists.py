"""Queries of lists as their views show them: filters, orders, limits, counts, positions, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioq.functions import host as H, text as T, urls as U
from folioq.operators import joins, listing as L, merge, places
from folioq.plans.base import query, table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a shelf of recent books."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("author"), F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Intro "), F.col("c_custkey"))).alias("intro"), F.concat(F.lit("origin"), F.col("c_custkey") % 7).alias("origin"), F.when(F.col("c_custkey") % 5 == 0, "rss").alias("recentKind"))


_SHELF = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS author, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Intro ' || c_custkey END AS intro, 'origin' || (c_custkey % 7) AS origin, CASE WHEN c_custkey % 5 = 0 THEN 'rss' END AS kind FROM customer"


@query(f"SELECT id FROM ({_SHELF}) WHERE kind IS NULL AND (contains(lower(name), 'o 1') OR contains(lower(author), 'o 1') OR contains(lower(coalesce(intro, '')), 'o 1') OR contains(lower(origin), 'o 1'))")
def shelf_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shelf's books (no feeds) with a word in one of its fields."""
    return L.shelf_like(_customers(spark, sf_dir), " O 1", "book").select("id")


@query(f"SELECT id FROM ({_SHELF}) WHERE kind = 'rss'")
def shelf_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shelf_like(_customers(spark, sf_dir), "", "rss").select("id")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as book sources."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("bookSourceName"), F.concat(F.lit("https://B"), k, F.lit(".test")).alias("bookSourceUrl"), F.when(k % 4 != 0, F.concat("p_brand", F.lit(","), "p_type")).alias("bookSourceGroup"), F.when(k % 6 == 0, False).when(k % 6 == 1, True).alias("enabled"), (k % 9).alias("customOrder"), F.when(k % 10 == 0, None).otherwise(k % 8).cast("int").alias("order0"))


_SOURCES = "SELECT p_partkey AS id, p_name AS name, 'https://B' || p_partkey || '.test' AS url, CASE WHEN p_partkey % 4 <> 0 THEN p_brand || ',' || p_type END AS grp, CASE p_partkey % 6 WHEN 0 THEN false WHEN 1 THEN true END AS enabled, p_partkey % 9 AS ord FROM part"


@query(f"SELECT id FROM ({_SOURCES}) WHERE contains(coalesce(grp, ''), 'Brand#1')")
def source_group_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.in_group(_sources(spark, sf_dir), "Brand#1").select("id")


@query(f"SELECT id FROM ({_SOURCES}) WHERE (contains(lower(name), 'b1') OR contains(lower(url), 'b1')) AND contains(coalesce(grp, ''), '#2')")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sources_like(_sources(spark, sf_dir), " B1 ", "#2").select("id")


@query(f"SELECT id FROM ({_SOURCES}) WHERE enabled IS DISTINCT FROM false")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.enabled(_sources(spark, sf_dir)).select("id")


@query(f"SELECT id, row_number() OVER (ORDER BY ord, name, id) AS rank FROM ({_SOURCES})")
def source_options_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the custom order, then as Chinese readers order names (for these names as bytes do)."""
    return L.ranked(_sources(spark, sf_dir), [*L.by_custom_order(), "id"]).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT count(*) AS total, count(*) FILTER (enabled IS DISTINCT FROM false) AS enabled, count(*) FILTER (contains(coalesce(grp, ''), '#3')) AS filtered FROM ({_SOURCES})")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    return L.source_counts(s, F.contains(F.coalesce("bookSourceGroup", F.lit("")), F.lit("#3")))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the an')")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.titled_like(table(spark, sf_dir, "conversations"), "  The An ", "text").select("conv_id", "turn")


@query(r"SELECT doc_id FROM documents WHERE contains(lower(regexp_replace(lang || ' ' || source || ' al' || source || ' ' || text, '\s', '', 'g')), 'src1alsrc1the')")
def character_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.array("source", F.concat(F.lit("al"), "source")).alias("aliases"), F.col("text").alias("status"))
    return L.characters_like(rows, "src1 alSRC1 the").select("doc_id")


_USERS = "SELECT c_custkey AS id, c_name AS username, c_custkey % 11 = 0 AS admin, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1000000 - c_custkey * 7 END AS created FROM customer"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), (F.col("c_custkey") % 11 == 0).alias("isAdmin"), F.when(F.col("c_custkey") % 13 == 0, F.lit(0)).otherwise(1000000 - F.col("c_custkey") * 7).cast("long").alias("createdAt"))


@query(f"SELECT id FROM ({_USERS}) WHERE contains(lower(username || ' ' || CASE WHEN admin THEN '管理员' ELSE '' END || ' ' || CASE WHEN username = 'Customer#000000003' THEN '当前账号' ELSE '' END || ' '), '管理员')")
def user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.users_like(_users(spark, sf_dir), "管理员", "Customer#000000003").select("id")


@query(f"SELECT id, row_number() OVER (ORDER BY created, username, id) AS rank, row_number() OVER (ORDER BY admin DESC, username, id) AS shown FROM ({_USERS})")
def user_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.ranked(L.ranked(_users(spark, sf_dir), [*L.users_in_order(), "id"]), [*L.users_in_order(True), "id"], out="shown")
    return rows.select("id", F.col("rank").cast("long").alias("rank"), F.col("shown").cast("long").alias("shown"))


@query(f"SELECT arg_min(username, (CASE WHEN created <= 0 THEN 9e18 ELSE created END, username)) AS admin FROM ({_USERS})")
def first_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_user(_users(spark, sf_dir))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_id, count(*) AS n FROM orders GROUP BY o_custkey")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_id(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"])


@query("SELECT c_custkey AS id FROM customer WHERE replace(c_name, ' ', '') = 'Customer#000000012' AND c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 12)")
def candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by name without white space and author without its label."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "#", " # ").alias("name"), F.concat(F.lit("作者："), "c_mktsegment").alias("author"))
    author = c.where("c_custkey = 12").first()["c_mktsegment"]
    return L.same_book(rows, "Customer#0000 00012", author, loose=True).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000017' AND c_mktsegment <> ''")
def bookmarks_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of exactly a book's name and author."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("A").alias("author"))
    return L.same_book(rows, "Customer#000000017", "A").select("id")


@query("SELECT lang, count(*) <= 100 AS within, greatest(100 - count(*), 0) AS left_over FROM documents GROUP BY lang")
def local_book_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.within_limit(table(spark, sf_dir, "documents"), ["lang"])


@query("SELECT doc_id, row_number() OVER (ORDER BY ascii(lang), lang, source, doc_id) AS rank FROM documents")
def merged_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged results by name, as bytes compare."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), "source")
    return L.ranked(rows, [*L.by_name(), "source", "doc_id"]).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS rank, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS newest FROM supplier")
def availability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested sources by name; sources by their time of change, newest first."""
    s = table(spark, sf_dir, "supplier")
    rows = L.ranked(L.ranked(s, [*L.by_name("s_name"), "s_suppkey"]), L.newest_first("s_acctbal", "s_name"), out="newest")
    return rows.select("s_suppkey", F.col("rank").cast("long").alias("rank"), F.col("newest").cast("long").alias("newest"))


@query("WITH e AS (SELECT 'u' || user_id AS source, event_type AS target FROM events GROUP BY ALL), d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT id AS label, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM d")
def graph_nodes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioq.operators import graph

    links = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("target"), F.lit("does").alias("label"), F.col("event_id").alias("seq"))
    rows = graph.degrees(graph.edges(links)).withColumnRenamed("id", "label")
    # ties of the collation (letters before digits) don't occur among u1, u2, ... and words
    return L.ranked(rows, [F.desc("degree"), F.col("label")]).select("label", "degree", F.col("rank").cast("long").alias("rank"))


@query("SELECT n_name AS name, n_regionkey % 2 = 0 AS is_folder, row_number() OVER (ORDER BY n_regionkey % 2 = 0 DESC, n_name) AS rank FROM nation")
def files_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("is_folder"))
    return L.ranked(rows, L.files_in_order()).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(kind, (ts, kind)) AS kind FROM (SELECT user_id, ts, CASE WHEN user_id % 4 = 0 THEN 'rss' ELSE 'book' END AS kind FROM events) GROUP BY user_id)
SELECT user_id, ts, kind AS "recentKind" FROM l WHERE kind <> 'rss' OR ts > TIMESTAMP '2024-02-01' - INTERVAL 7 DAY ORDER BY ts DESC, user_id LIMIT 100""")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most recent entries, feeds' only for a week (the feature has this limit)."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("user_id") % 4 == 0, "rss").otherwise("book").alias("recentKind"))
    return L.recents(rows, "user_id", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT p_partkey AS seq, 3 * CAST(lower(replace(p_name, ' ', '')) = 'smallring' AS INTEGER) + 3 * CAST(p_brand = 'Brand#2' AS INTEGER) + 4 * CAST(lower(p_type) = 'economy' AS INTEGER) AS score FROM part)
SELECT seq, score FROM c ORDER BY score DESC, seq LIMIT 20""")
def candidate_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by how much of a book they match; the list shows twenty."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("《"), "p_name", F.lit("》")).alias("name"), F.concat(F.lit("作者："), "p_brand").alias("author"), F.concat("p_type", F.lit("!")).alias("lastChapter"))
    return L.candidates(rows, "small ring", "Brand#2", "ECONOMY").select("seq", "score")


@query("SELECT page_id, substr(html, 1, 500) AS preview FROM pages")
def body_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", L.preview(F.col("html")).alias("preview"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 20 OR user_id % 3 = 0) AS valid, count(*) FILTER (NOT (value > 20 OR user_id % 3 = 0)) AS invalid, count(*) FILTER (event_id % 5 = 0) AS \"markedInvalid\" FROM events GROUP BY event_type")
def availability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tests = e.select("event_type", F.when(F.col("value") > 20, True).alias("searchOk"), (F.col("user_id") % 3 == 0).alias("exploreOk"), F.when(F.col("event_id") % 5 == 0, "小说；失效").otherwise("不失效").alias("group"))
    return L.availability(tests, ["event_type"])


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 20) AS valid, count(*) FILTER (value <= 20) AS invalid, 0::BIGINT AS \"markedInvalid\" FROM events GROUP BY event_type")
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of batches added up: the same as one summary of all."""
    e = table(spark, sf_dir, "events")
    tests = e.select("event_type", "event_id", (F.col("value") > 20).alias("searchOk"), F.lit(None).cast("boolean").alias("exploreOk"), F.lit("").alias("group"))
    return L.added_up(*[L.availability(tests.where(f"event_id % 3 = {k}"), ["event_type"]) for k in range(3)], by=["event_type"])


@query("SELECT o_custkey AS \"bookUrl\", count(*) AS n, sum(CAST(round(o_totalprice) AS BIGINT)) AS bytes, max(o_orderdate) AS updated FROM orders GROUP BY o_custkey")
def cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached chapters per book: how many, their size, the latest."""
    return L.cache_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bookUrl"), F.round("o_totalprice").cast("bigint").alias("bytes"), F.col("o_orderdate").alias("updated")))


@query("SELECT l_shipmode, count(*) FILTER (l_returnflag = 'A') AS cached, count(*) FILTER (l_returnflag = 'N') AS success, count(*) FILTER (l_returnflag = 'R') AS failed FROM (SELECT *, l_linenumber AS l_shipmode FROM (SELECT l_returnflag, l_linenumber FROM lineitem)) GROUP BY l_shipmode")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("l_shipmode"), F.when(flag == "A", "cached").when(flag == "N", "success").otherwise("failed").alias("status"))
    return L.progress_counts(rows, ["l_shipmode"])


@query("SELECT user_id, count(DISTINCT event_type) AS opened, count(DISTINCT event_type || '#' || CAST(json_extract_string(props, '$.k') AS INTEGER)) AS chapters, count(DISTINCT CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 89 THEN event_type END) AS completed, CAST(floor(sum(value) / 60) AS BIGINT) AS minutes FROM events GROUP BY user_id")
def reading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return L.reading_stats(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("bookUrl"), k.alias("index"), F.lit(90).alias("total"), F.col("value").alias("seconds")), ["user_id"])


@query(r"""SELECT doc_id, length(text) AS chars, length(regexp_replace(regexp_replace('<p>' || text || '</p>', '<[^>]+>', '', 'g'), '\s', '', 'g')) AS dense, lang || ',失效' AS marked, lang AS unmarked FROM documents WHERE NOT contains(text, '<') AND NOT contains(text, chr(160))""")
def doc_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character counts, and the token for invalid sources set (twice: once only) and removed again. Texts with markup of their own are left out."""
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("<")) & ~F.contains("text", F.lit(" ")))
    marked = T.with_token(F.concat("lang", F.lit("， ；").substr(2, 1), F.lit(";失效")), "失效")
    plain, tagged = L.char_counts(docs.select("doc_id", "lang", "text")), L.char_counts(docs.select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("text")))
    return plain.select("doc_id", "lang", "chars").join(tagged.select("doc_id", "dense"), "doc_id").select("doc_id", "chars", "dense", marked.alias("marked"), T.without_token(marked, "失效").alias("unmarked"))


@query("SELECT p_type, md5(array_to_string(list(p_partkey ORDER BY p_partkey), '|')) AS signature FROM part GROUP BY p_type")
def change_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's sorted members as one string, all of them, to see changes by."""
    return L.signature(table(spark, sf_dir, "part"), ["p_type"], "p_partkey").select("p_type", F.md5("signature").alias("signature"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS h FROM pages)
SELECT page_id, lead(page_id) OVER w AS next_id, lag(page_id) OVER w AS prev_id, lead(page_id) OVER w IS NOT NULL AS has_next, round(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY h), 2) AS progress FROM p WINDOW w AS (PARTITION BY h ORDER BY url, page_id)""")
def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next chapter, and how far a reader is."""
    df = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("h"))
    return L.neighbours(df, ["h"], ["url", "page_id"], "page_id").select("page_id", "next_id", "prev_id", "has_next", "progress")


@query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)
SELECT source, doc_id, place, CAST(place // 4 AS BIGINT) AS batch, max(place) OVER (PARTITION BY source) AS last_index FROM (SELECT * FROM d WHERE place < 10)""")
def batched_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four in order, cut where a source has given ten, with the last place that counts."""
    rows = L.batched(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 4, 10)
    return rows.select("source", "doc_id", F.col("place").cast("long").alias("place"), "batch", F.col("last_index").cast("long").alias("last_index"))


@query(r"""WITH d AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) SELECT source, doc_id, CAST(coalesce(before, 0) AS BIGINT) AS before FROM d WHERE coalesce(before, 0) < 5000""")
def running_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows until a source's running total has reached its limit."""
    return L.until_enough(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 5000).select("source", "doc_id", "before")


@query("SELECT d.doc_id, d.source, coalesce(l.n, 0) AS cached, CASE WHEN d.source = 'src0' THEN 0 ELSE coalesce(l.n, 0) END AS shown FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id)")
def shelf_left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached chapters per book; local books show none."""
    counts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    return L.with_cached(table(spark, sf_dir, "documents").select("doc_id", "source"), counts, "doc_id", F.col("source") == "src0")


@query("SELECT d.doc_id, coalesce(s.n, 0) AS server, coalesce(b.n, 0) AS browser FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) s USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) b USING (doc_id)")
def shelf_two_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with what the server and what the browser have of each."""
    server = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    browser = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    one = L.with_cached(table(spark, sf_dir, "documents").select("doc_id"), server, "doc_id", F.lit(False)).select("doc_id", F.col("cached").alias("server"))
    return L.with_cached(one, browser, "doc_id", F.lit(False)).select("doc_id", "server", F.col("cached").alias("browser"))


@query("SELECT c_custkey, c_name, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS \"originName\", coalesce(n_comment, '') AS \"originGroup\" FROM customer LEFT JOIN (SELECT n_nationkey, n_name, 'g' || n_regionkey AS n_comment FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def display_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their source's name and group, or what stands in for them."""
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("origin"), F.col("n_name").alias("originName"), F.concat(F.lit("g"), "n_regionkey").alias("originGroup"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("origin"))
    return L.enriched(rows, n).drop("origin")


@query("SELECT s_suppkey, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NOT NULL THEN 'network' WHEN b.n IS NOT NULL THEN 'cache' ELSE 'none' END AS way FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1 GROUP BY 1) a ON a.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, -count(*) AS n FROM lineitem WHERE l_quantity < 3 AND l_linenumber < 3 GROUP BY 1) b ON b.l_suppkey = s_suppkey")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's copy or else the cache's."""
    i = table(spark, sf_dir, "lineitem")
    network = i.where("l_quantity > 49 AND l_linenumber = 1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    cache = i.where("l_quantity < 3 AND l_linenumber < 3").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((-F.count("*")).alias("n"))
    return L.with_fallback(table(spark, sf_dir, "supplier").select("s_suppkey"), network, cache, "s_suppkey", "n")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def delete_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what is selected, what is still there."""
    return L.visible(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("WITH k AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 100) SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM k)")
def asked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sources that are asked for, a hundred at most (the feature has this limit)."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.struct("s_acctbal", "s_suppkey").alias("pos"))
    return L.asked(table(spark, sf_dir, "lineitem"), keys, "l_suppkey").select("l_orderkey", "l_linenumber").distinct()


@query(r"""WITH a AS (SELECT page_id AS id, url FROM pages), e AS (SELECT url, min(id) AS s FROM a WHERE id % 3 = 0 GROUP BY url), d AS (SELECT string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.')[-2] AS d, min(id) AS s FROM a WHERE id % 3 = 0 GROUP BY 1)
SELECT a.url, 's' || coalesce(e.s, d.s) AS "sourceUrl" FROM a LEFT JOIN e USING (url) LEFT JOIN d ON d.d = string_split(regexp_extract(a.url, '^[a-z]+://([^/?#:]*)', 1), '.')[-2]""")
def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of lookups, by the URL and then by its domain: the first way that finds a source counts. A third of the pages are known sources."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = pages.where("page_id % 3 = 0")
    name = lambda df: df.withColumn("sourceUrl", F.concat(F.lit("s"), "sourceUrl"))
    exact = name(known.groupBy("url").agg(F.min("page_id").alias("sourceUrl")))
    near = name(known.groupBy(U.root_domain(F.col("url")).alias("d")).agg(F.min("page_id").alias("sourceUrl")))
    by_domain = pages.withColumn("d", U.root_domain(F.col("url"))).join(near, "d").select("url", "sourceUrl").distinct()
    return joins.resolved_sources(pages.select("url"), [(exact, F.col("url")), (by_domain, F.col("url"))])


@query("SELECT doc_id, md5(concat_ws(':', source, 'file', md5(text))) AS identity, md5(md5(lang || source) || source) AS hash FROM documents")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local book's identity by its whole text; a password's hash, salted twice."""
    return table(spark, sf_dir, "documents").select("doc_id", L.identity(F.col("source"), F.col("text")).alias("identity"), L.password_hash(F.col("lang"), F.col("source")).alias("hash"))


@query("SELECT doc_id, md5(translate(translate(text, 'eéaoè', '萬與東丝业'), '萬與東', '万与东')) AS converted, md5(translate(text, 'eéaoè', '万与东丝业')) AS back FROM documents")
def script_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of one script for those of another, by a map of the caller's; only those beyond code point 10,000 count."""
    t = F.translate("text", "eéaoè", "萬與東丝业")
    one = T.converted(t, {"萬": "万", "與": "与", "東": "东", "e": "never"})
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(one).alias("converted"), F.md5(T.converted(one, {})).alias("back"))


@query("""WITH s AS (SELECT doc_id, ['', '本章：old', 'Old summary of ' || lang || '.'][1 + doc_id % 3] AS o, ['', '第12章 名：a hero', '本章，b', text, '这一章 is'][1 + doc_id % 5] AS n FROM documents),
t AS (SELECT doc_id, trim(o) AS o, regexp_replace(regexp_replace(n, '^\\s+', ''), '\\s+$', '') AS n FROM s),
p AS (SELECT doc_id, CASE WHEN n = '' THEN o WHEN o = '' THEN regexp_replace(regexp_replace(n, '^本章，', ''), '^第12章 名：', '') WHEN starts_with(n, '第12章') OR starts_with(n, '本章，') THEN o ELSE n END AS x FROM t)
SELECT doc_id, md5(CASE WHEN length(x) <= 300 THEN x ELSE substr(x, 1, 163) || '……' || right(x, 135) END) AS summary FROM p""".replace("\\\\", "\\"))
def summary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries over earlier ones: a single chapter's doesn't replace one, long ones lose their middle."""
    d, at = table(spark, sf_dir, "documents"), lambda k, *x: F.element_at(F.array(*x), (1 + F.col("doc_id") % k).cast("int"))
    old = at(3, F.lit(""), F.lit("本章：old"), F.concat(F.lit("Old summary of "), "lang", F.lit(".")))
    new = at(5, F.lit(""), F.lit("第12章 名：a hero"), F.lit("本章，b"), F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("这一章 is"))
    return d.select("doc_id", F.md5(T.merged_summary(old, new, 300)).alias("summary"))


_PLACES = """SELECT n_regionkey AS book, n_nationkey AS seq, n_name AS name, ['王国', '城市', '酒馆', '房间', '世界'][1 + n_nationkey % 5] AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE '' END AS importance,
CASE WHEN n_nationkey % 7 = 0 THEN 'FRANCE' END AS parent, 'near ' || (SELECT b.n_name FROM nation b WHERE b.n_nationkey = (a.n_nationkey * 7 + 3) % 25) AS description FROM nation a"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    other = n.select(k.alias("_o"), F.col("n_name").alias("_on"))
    rows = n.join(other, F.col("_o") == (k * 7 + 3) % 25)
    return rows.select(F.col("n_regionkey").alias("bookUrl"), k.alias("seq"), F.col("n_name").alias("name"), F.element_at(F.array(*[F.lit(x) for x in ("王国", "城市", "酒馆", "房间", "世界")]), (1 + k % 5).cast("int")).alias("kind"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("").alias("importance"), F.when(k % 7 == 0, "FRANCE").alias("parentName"), F.concat(F.lit("near "), "_on").alias("description"), F.lit("").alias("status"))


_PARENTS = f"""WITH p AS ({_PLACES}), r AS (SELECT *, lower(replace(name, ' ', '')) AS k, CASE kind WHEN '王国' THEN 70 WHEN '城市' THEN 50 WHEN '酒馆' THEN 30 WHEN '房间' THEN 20 ELSE 90 END AS lvl,
  CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END AS imp, kind IN ('酒馆', '房间') AS inner_, kind IN ('王国', '城市', '世界') AS strong, CASE WHEN lower(parent) = lower(name) THEN NULL ELSE parent END AS par FROM p),
t AS (SELECT *, lower(replace(description || coalesce(' ' || par, ''), ' ', '')) AS txt, lower(replace(description, ' ', '')) AS bare FROM r),
x AS (SELECT a.book, a.k, a.inner_, b.name AS bn, b.lvl * 10 + b.imp AS score, length(b.name) AS len, b.seq AS bs, b.kind AS bk,
  contains(CASE WHEN EXISTS (SELECT 1 FROM t w WHERE w.book = a.book AND w.k = lower(a.par) AND w.lvl <= a.lvl) THEN a.bare ELSE a.txt END, b.k) AS told, contains(b.txt, a.k) AS holds FROM t a JOIN t b ON a.book = b.book AND b.lvl > a.lvl AND b.strong),
g AS (SELECT book, k, arg_max(bn, (score, len, -bs)) FILTER (told) AS t1, arg_max(bn, (score, len, -bs)) FILTER (holds) AS t2, CASE WHEN count(*) FILTER (bk = '城市') = 1 THEN max(bn) FILTER (bk = '城市') END AS city, CASE WHEN count(*) = 1 THEN max(bn) END AS sole FROM x GROUP BY book, k),
q AS (SELECT t.*, coalesce((SELECT t.par FROM t w WHERE w.book = t.book AND w.k = lower(t.par) AND w.lvl > t.lvl), t1, t2, CASE WHEN t.inner_ THEN coalesce(city, sole) END) AS found FROM t LEFT JOIN g USING (book, k))"""


@query(f"{_PARENTS} SELECT book AS \"bookUrl\", name, found AS \"parentName\" FROM q")
def location_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which place lies in which: by name, by what is said of either, or as the only one that can hold it."""
    return places.with_parents(_places(spark, sf_dir)).select("bookUrl", "name", "parentName")


@query(f"""{_PARENTS}, e AS (SELECT book, name, found, lower(name) AS k, lvl, imp, kind, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN lvl >= 70 THEN 4 WHEN lvl >= 50 THEN 3 ELSE 0 END DESC, imp DESC, kind, name) AS n FROM q),
z AS (WITH RECURSIVE w AS (SELECT book, name, k, 0 AS depth, [n] AS path FROM e WHERE found IS NULL OR NOT EXISTS (SELECT 1 FROM e y WHERE y.book = e.book AND y.name = e.found) UNION ALL SELECT e.book, e.name, e.k, w.depth + 1, list_append(w.path, e.n) FROM w JOIN e ON e.book = w.book AND e.found = w.name) SELECT * FROM w)
SELECT book AS "bookUrl", name, CAST(depth AS INTEGER) AS depth, EXISTS (SELECT 1 FROM e y WHERE y.book = z.book AND y.found = z.name) AS has_children, row_number() OVER (PARTITION BY book ORDER BY path) - 1 AS "row" FROM z""".replace("z AS (WITH RECURSIVE w AS (", "z AS (SELECT * FROM (WITH RECURSIVE w AS (").replace("SELECT * FROM w)\nSELECT", "SELECT * FROM w))\nSELECT"))
def location_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as the rows of a tree, siblings by rank, importance, kind and name."""
    rows = places.tree(places.with_parents(_places(spark, sf_dir)))
    return rows.select("bookUrl", "name", "depth", "has_children", F.col("row").cast("long").alias("row"))


@query("WITH r AS (SELECT doc_id, ['认识', '朋友', '位于'][1 + doc_id % 3] AS relation, ['', 'low', 'High', '中等'][1 + doc_id % 4] AS importance, substr(text, 1, CAST(doc_id % 60 AS INTEGER)) AS detail FROM documents) SELECT doc_id FROM r WHERE importance IN ('High', '中等') OR relation = '朋友' OR length(regexp_replace(trim(detail), '\\s', '', 'g')) >= 18".replace("\\\\", "\\"))
def telling_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations without those that say little."""
    at = lambda k, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (1 + F.col("doc_id") % k).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", at(3, "认识", "朋友", "位于").alias("relation"), at(4, "", "low", "High", "中等").alias("importance"), F.substr("text", F.lit(1), (F.col("doc_id") % 60).cast("int")).alias("detail"))
    return merge.telling(rows).select("doc_id")


RULES = [(2, r"^The\b", "A", True, True, ""), (1, "of", "OF", False, None, "*"), (3, r"[0-9]+", "#", None, True, "source:src1"), (5, " ", "_", False, False, ""), (6, r"ing$", "in'", True, True, "en"), (7, "and", "&", False, True, "de;b7"), (8, "e", "E", False, True, "book:b3"), (9, "t", "T", False, True, "*;b4"), (10, "(unclosed", "-", True, True, "")]


@query(r"""WITH d AS (SELECT doc_id, source, lang, 'b' || (doc_id % 10) AS b, regexp_replace(replace(text, 'of', 'OF'), '(?m)^The\b', 'A', 'g') AS t FROM documents),
a AS (SELECT *, CASE WHEN source = 'src1' THEN regexp_replace(t, '[0-9]+', '#', 'g') ELSE t END AS t2 FROM d), c AS (SELECT *, CASE WHEN lang = 'en' THEN regexp_replace(t2, '(?m)ing$', 'in''', 'g') ELSE t2 END AS t3 FROM a),
e AS (SELECT *, CASE WHEN lang = 'de' AND b = 'b7' THEN replace(t3, 'and', '&') ELSE t3 END AS t4 FROM c), f AS (SELECT *, CASE WHEN b = 'b3' THEN replace(t4, 'e', 'E') ELSE t4 END AS t5 FROM e)
SELECT doc_id, md5(CASE WHEN b = 'b4' THEN replace(t5, 't', 'T') ELSE t5 END) AS out FROM f""")
def rules_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of replacement rules joined to the books of their scopes, and applied in order."""
    rules = spark.createDataFrame(RULES, "`order` int, pattern string, replacement string, isRegex boolean, isEnabled boolean, scope string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("name"), F.concat(F.lit("b"), F.col("doc_id") % 10).alias("url"), "source")
    return L.applied(docs, rules, "doc_id").select("doc_id", F.md5("text").alias("out"))


@query("SELECT doc_id, encode(lang) IS NOT NULL AS there, md5(lang) AS digest, to_base64(encode(source || 'é')) AS coded, source || 'é' AS decoded, strftime(to_timestamp(1700000000 + doc_id * 60), '%Y-%m-%d %H:%M') AS at, url_encode(source || ' é/') AS component FROM documents")
def host_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scripts may call, as columns."""
    s = F.concat("source", F.lit("é"))
    t = F.lit(1700000000) + F.col("doc_id") * 60
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").isNotNull().alias("there"), H.md5_hex(F.col("lang")).alias("digest"), H.base64_encode(s).alias("coded"), H.base64_decode(H.base64_encode(s)).alias("decoded"), H.time_format(F.when(F.col("doc_id") % 2 == 0, t * 1000).otherwise(t)).alias("at"), H.encode_component(F.concat("source", F.lit(" é/"))).alias("component"))
