"""Queries over documents and conversations: text functions, chapters, search, replacement, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioq.functions import text as T, titles
from folioq.operators import books, joins, merge
from folioq.plans.base import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([A-Z])(\w+)', '\2\1', 'g'), '\.\s*', ';', 'g')) AS out FROM documents""")
def doc_replace_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.replaced(F.col("text"), [(r"([A-Z])(\w+)", "$2$1"), (r"\.\s*", ";")])
    return _docs(spark, sf_dir).select("doc_id", F.md5(out).alias("out"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, 'th(e|a)', '<\1>')) AS out FROM documents""")
def doc_replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.replaced_once(F.col("text"), "th(e|a)", "<$1>")).alias("out"))


RULES = [
    {"order": 2, "pattern": r"^The\b", "replacement": "A"},
    {"order": 1, "pattern": "of", "replacement": "OF", "isRegex": False},
    {"order": 3, "pattern": r"[0-9]+", "replacement": "#", "scope": "source:src1"},
    {"order": 4, "pattern": r"(unclosed", "replacement": "-"},
    {"order": 5, "pattern": " ", "replacement": "_", "isRegex": False, "isEnabled": False},
    {"order": 6, "pattern": r"ing$", "replacement": "in'", "scope": "en;de"},
]


@query(r"""WITH a AS (SELECT doc_id, source, lang, regexp_replace(replace(text, 'of', 'OF'), '(?m)^The\b', 'A', 'g') AS t FROM documents),
b AS (SELECT doc_id, lang, CASE WHEN source = 'src1' THEN regexp_replace(t, '[0-9]+', '#', 'g') ELSE t END AS t FROM a)
SELECT doc_id, md5(CASE WHEN lang IN ('en', 'de') THEN regexp_replace(t, '(?m)ing$', 'in''', 'g') ELSE t END) AS out FROM b""")
def doc_replace_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped rules in order; an invalid and a disabled one change nothing."""
    return books.rewritten(_docs(spark, sf_dir), RULES, "text", "lang", None, "source").select("doc_id", F.md5("text").alias("out"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM l),
s AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head, length(line) <= 80 AND regexp_matches(line, '^[A-Z]\w*( \w+)?\.$') AS h FROM e),
n AS (SELECT doc_id, sum(strlen(line) + 1) - 1 AS total FROM e GROUP BY doc_id),
heads AS (SELECT doc_id, k, line AS title, head, head + strlen(line) + 1 AS start FROM s WHERE h),
firsts AS (SELECT n.doc_id, total, min(head) AS first FROM n LEFT JOIN heads USING (doc_id) GROUP BY ALL),
extra AS (SELECT doc_id, 0 AS k, CASE WHEN first IS NULL THEN '正文' ELSE '序章' END AS title, 0 AS head, 0 AS start FROM firsts WHERE first IS NULL OR first > 0),
u AS (SELECT * FROM heads UNION ALL SELECT * FROM extra)
SELECT u.doc_id, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY k) - 1 AS INTEGER) AS "index", title, CAST(least(start, total) AS BIGINT) AS start, CAST(greatest(least(start, total), coalesce(lead(head) OVER (PARTITION BY u.doc_id ORDER BY k), total)) AS BIGINT) AS stop FROM u JOIN firsts USING (doc_id)""")
def doc_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by a heading of the caller's (a line of one or two words), with byte ranges."""
    return books.chapters(_docs(spark, sf_dir), r"^[A-Z][a-zA-Z0-9_]*( [a-zA-Z0-9_]+)?\.$").select("doc_id", "index", "title", "start", "stop")


@query("SELECT doc_id, 0::INTEGER AS \"index\", '正文' AS title, md5(rtrim(text, chr(10) || chr(13))) AS content FROM documents")
def doc_whole_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default heading finds none in these texts: one chapter holds each."""
    return books.chapters(_docs(spark, sf_dir)).select("doc_id", "index", "title", F.md5("content").alias("content"))


@query("WITH e AS (SELECT doc_id, text, length(text) // 3 AS c FROM documents) SELECT doc_id, md5(substr(text, CAST(c + 1 AS BIGINT), CAST(c AS BIGINT))) AS part FROM e")
def doc_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of each text by its byte range, between borders of characters."""
    c = F.floor(F.length("text") / 3).cast("int")
    upto = lambda n: F.octet_length(F.substr("text", F.lit(1), n))
    docs = _docs(spark, sf_dir).withColumns({"a": upto(c), "z": upto(2 * c)})
    return books.ranged(docs, "text", "a", "z", "part").select("doc_id", F.md5("part").alias("part"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE contains(text, 'the')), g AS (SELECT doc_id, t, string_split(t, 'the and') AS g FROM t),
h AS (SELECT doc_id, t, unnest(range(0, len(g) - 1)) AS hit, unnest(list_transform(range(1, len(g)), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x))) + 7 * (k - 1) + 1)) AS pos FROM g WHERE len(g) > 1),
s AS (SELECT *, CAST(greatest(pos - 18, 1) AS BIGINT) AS b, CAST(least(pos + 24, length(t)) AS BIGINT) AS e FROM h)
SELECT doc_id, CAST(hit AS INTEGER) AS hit, CAST(pos AS INTEGER) AS pos, CASE WHEN b > 1 THEN '...' ELSE '' END || substr(t, b, e - b + 1) || CASE WHEN e < length(t) THEN '...' ELSE '' END AS snippet FROM s""")
def doc_search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.search(_docs(spark, sf_dir), "the and").withColumnRenamed("at", "pos")


@query(r"""SELECT DISTINCT trim(g) AS "group" FROM (SELECT unnest(string_split(source || ',' || lang || '; ' || source, ',')) AS p FROM documents), unnest(string_split(p, ';')) AS u(g) WHERE trim(g) <> ''""")
def source_groups_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = T.tokens(F.concat("source", F.lit(","), "lang", F.lit("; "), "source"))
    return _docs(spark, sf_dir).select(F.explode(groups).alias("group")).distinct()


@query(r"""SELECT source, count(*) AS n FROM documents WHERE contains(source, '1') AND list_contains(list_transform(string_split(lang || ',x', ','), lambda x: trim(x)), 'en') GROUP BY source""")
def source_group_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group filter by substring and one by exact token."""
    docs = _docs(spark, sf_dir).where(F.contains("source", F.lit("1")) & F.array_contains(T.tokens(F.concat("lang", F.lit(",x"))), "en"))
    return docs.groupBy("source").agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE ' ' || source END AS name, lang AS author, 'o' || (doc_id % 4) AS origin, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'k' || doc_id END AS kind, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'i' || doc_id END AS intro FROM documents),
k AS (SELECT *, lower(trim(name)) || '|' || lower(trim(author)) AS key FROM r)
SELECT arg_min(name, seq) AS name, arg_min(author, seq) AS author, arg_min(kind, seq) FILTER (kind IS NOT NULL AND kind <> '') AS kind, arg_min(intro, seq) FILTER (intro IS NOT NULL AND intro <> '') AS intro, CASE WHEN count(DISTINCT origin) > 1 THEN count(DISTINCT origin) END AS origins FROM k GROUP BY key""")
def merge_by_name_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), "source")).alias("name"), F.col("lang").alias("author"), F.concat(F.lit("o"), F.col("doc_id") % 4).alias("origin"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("k"), F.col("doc_id"))).alias("kind"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("i"), F.col("doc_id"))).alias("intro"))
    return merge.across_sources(rows, ("kind", "intro")).select("name", "author", "kind", "intro", F.nullif(F.size(F.coalesce("bookSourceUrls", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("origins"))


@query(r"""WITH r AS (SELECT doc_id AS seq, lower(lang || '.' || source) AS key, CASE doc_id % 3 WHEN 0 THEN upper(lang) || '·' || source WHEN 1 THEN ' ' || lang || '•' || source ELSE lang || ' ・ ' || source END AS name, 'al' || (doc_id % 5) AS alias, lang || doc_id AS status, text AS description, ['low', 'medium', 'high', 'none'][1 + doc_id % 4] AS importance FROM documents)
SELECT arg_min(name, seq) AS name, arg_max(status, seq) AS status, md5(arg_max(description, length(description) * 10000000 - seq)) AS description, arg_max(importance, CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END * 10000000 - seq) AS importance, count(DISTINCT alias) AS aliases FROM r GROUP BY key""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of one name: first name, latest state, richest description, highest importance, all aliases."""
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "none")])
    k = F.col("doc_id") % 3
    name = F.when(k == 0, F.concat(F.upper("lang"), F.lit("·"), "source")).when(k == 1, F.concat(F.lit(" "), "lang", F.lit("•"), "source")).otherwise(F.concat("lang", F.lit(" ・ "), "source"))
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), name.alias("name"), F.concat(F.lit("al"), F.col("doc_id") % 5).alias("alias"), F.concat("lang", "doc_id").alias("status"), F.col("text").alias("description"), F.element_at(levels, (1 + F.col("doc_id") % 4).cast("int")).alias("importance"))
    return merge.characters(rows).withColumns({"aliases": F.size("aliases").cast("long"), "description": F.md5("description")})


@query(r"""WITH r AS (SELECT doc_id AS seq, source AS a, 'src' || (doc_id * 7 % 20) AS b, lang AS relation FROM documents), k AS (SELECT *, least(a, b) || '::' || greatest(a, b) || '::' || relation AS key FROM r WHERE a <> b)
SELECT arg_min(a, seq) AS source, arg_min(b, seq) AS target, arg_min(relation, seq) AS relation FROM k GROUP BY key""")
def relationship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", F.concat(F.lit("src"), F.col("doc_id") * 7 % 20).alias("target"), F.col("lang").alias("relation"))
    return merge.relationships(rows)


@query(r"""WITH r AS (SELECT doc_id AS seq, source || ['·', '•', ' ・', '. '][1 + doc_id % 4] || (doc_id % 30) AS title, CASE lang WHEN 'en' THEN '' ELSE lang END AS category, CASE WHEN doc_id % 6 = 0 THEN 'low' ELSE 'high' END AS importance FROM documents),
k AS (SELECT *, coalesce(nullif(trim(category), ''), '基础设定') AS c, replace(translate(lower(trim(title)), '·•・', '...'), ' ', '') AS t FROM r WHERE importance <> 'low'), f AS (SELECT *, row_number() OVER (PARTITION BY c, t ORDER BY seq) AS n FROM k)
SELECT c AS category, CAST(CASE c WHEN '基础设定' THEN 1 WHEN 'fr' THEN 2 ELSE 999 END AS INTEGER) AS category_rank, count(*) AS n FROM f WHERE n = 1 GROUP BY ALL""")
def note_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.concat("source", F.element_at(F.array(*[F.lit(x) for x in ("·", "•", " ・", ". ")]), (1 + F.col("doc_id") % 4).cast("int")), F.col("doc_id") % 30).alias("title"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("category"), F.when(F.col("doc_id") % 6 == 0, "low").otherwise("high").alias("importance"))
    kept = merge.notes(rows, ("基础设定", "fr"), "基础设定")
    return kept.groupBy("category", "category_rank").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS paragraphs, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), '')) AS slug, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents""")
def doc_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.paragraphs(t)).cast("long").alias("paragraphs"), F.md5(T.slug(t)).alias("slug"), F.md5(T.collapsed(t)).alias("collapsed"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS title_key FROM documents""")
def doc_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.title_key(F.col("text"))).alias("title_key"))


@query(r"""WITH c AS (SELECT conv_id, turn AS "index", text AS title FROM conversations), k AS (SELECT *, lower(regexp_replace(title, '[^\p{L}\p{N}]', '', 'g')) AS key FROM c),
r AS (SELECT *, CASE WHEN key = 'theandof' THEN 0 WHEN key <> '' AND (contains(key, 'theandof') OR contains('theandof', key)) THEN 1 END AS rank FROM k)
SELECT conv_id, CAST(coalesce(arg_min("index", rank * 100000 + "index"), least(3, max("index"))) AS BIGINT) AS "index", CAST(coalesce(min(rank), 2) AS INTEGER) AS rank FROM r GROUP BY conv_id""")
def best_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), F.col("text").alias("title"))
    return joins.best_title(chapters, "The and of", 3, ["conv_id"]).withColumn("index", F.col("index").cast("long"))


@query(r"""WITH t AS (SELECT conv_id, turn, ['第' || (turn + 1) || '章 x', (turn + 50) || '.第' || (turn + 50) || '章', '番外 ' || turn, '第十二章', '第一千零三回', '序章 番外'][1 + CAST((conv_id + turn) % 6 AS INTEGER)] AS title FROM conversations)
SELECT conv_id, turn, CASE WHEN title = '第十二章' THEN 12 WHEN title = '第一千零三回' THEN 1003 ELSE TRY_CAST(regexp_extract(title, '第(\d+)章', 1) AS BIGINT) END AS ordinal, contains(title, '番外') AS outside FROM t""")
def chapter_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(F.concat(F.lit("第"), F.col("turn") + 1, F.lit("章 x")), F.concat(F.col("turn") + 50, F.lit(".第"), F.col("turn") + 50, F.lit("章")), F.concat(F.lit("番外 "), F.col("turn")), F.lit("第十二章"), F.lit("第一千零三回"), F.lit("序章 番外")), (1 + (F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", titles.ordinal(title).alias("ordinal"), titles.outside(title).alias("outside"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn < 3 THEN 1400 + turn ELSE turn - 2 END AS n FROM conversations), w AS (SELECT *, min(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) AS ahead, min(CASE WHEN n = 1 THEN turn END) OVER (PARTITION BY conv_id) AS first FROM t)
SELECT conv_id, turn, coalesce(n >= 50 AND turn <= 30 AND (turn < first OR ahead <= 10), false) AS skip FROM w""")
def chapter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest chapters that stand before the first one."""
    n = F.when(F.col("turn") < 3, 1400 + F.col("turn")).otherwise(F.col("turn") - 2)
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(n, F.lit(".x")).alias("title"))
    return df.select("conv_id", "turn", titles.front_loaded(F.col("title"), "turn", ["conv_id"]).alias("skip"))


@query(r"""WITH RECURSIVE chain AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, h.depth + 1 FROM chain h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn = h.turn + 1)
SELECT conv_id, count(*) AS pages, CAST(max(depth) AS INTEGER) AS last, md5(string_agg(text, chr(10) ORDER BY turn)) AS content FROM chain JOIN conversations USING (conv_id, turn) WHERE trim(text) <> '' GROUP BY conv_id""")
def next_link_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content pages followed from each first one to its next, joined by lines."""
    from folioq.operators.recurse import followed

    pages = table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws("/", "conv_id", "turn").alias("url"), F.concat_ws("/", "conv_id", (F.col("turn") + 1).cast("string")).alias("next"), "turn", "text")
    chain = followed(pages.where("turn = 0").select("url", F.col("conv_id").alias("chain")), pages.select("url", "next"))
    rows = chain.join(pages.select("url", "turn", "text"), "url").where("trim(text) <> ''")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(F.col("chain").alias("conv_id")).agg(F.count("*").alias("pages"), F.max("depth").alias("last"), F.md5(content).alias("content"))
