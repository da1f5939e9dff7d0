"""Queries over the star schema: shelves, sources and candidates played by customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioq.functions import text as T
from folioq.operators import graph, joins, merge, windows
from folioq.plans.base import query, table


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def shelf_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return merge.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")


@query("""WITH o AS (SELECT p_partkey, p_name, p_size, p_brand FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey, p_name || '!' AS p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 1 END AS p_size, p_brand FROM part WHERE p_partkey % 5 < 2)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, coalesce(n.p_name, o.p_name) AS p_name, CASE WHEN n.p_partkey IS NULL THEN o.p_size ELSE coalesce(n.p_size, o.p_size) END AS p_size, coalesce(n.p_brand, o.p_brand) AS p_brand FROM o FULL JOIN n USING (p_partkey)""")
def shelf_save_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved over the shelf; a null progress keeps the old one."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    new = part.where("p_partkey % 5 < 2").select("p_partkey", F.concat("p_name", F.lit("!")).alias("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") + 1).alias("p_size"), "p_brand")
    return merge.upserted(part.where("p_partkey % 2 = 0"), new, ["p_partkey"], {"p_size": True})


SHELF = "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'local-txt:' ELSE 'https://b/' END || p_partkey AS bookUrl, p_name AS name, p_brand AS author FROM part"
_TARGETS = f"WITH s AS ({SHELF}), t AS (SELECT s.* FROM s JOIN part ON bookUrl = CASE WHEN p_partkey % 4 = 0 THEN 'local-txt:' ELSE 'https://b/' END || p_partkey WHERE p_size <= 3)"
_HIT = "EXISTS (SELECT 1 FROM t WHERE t.bookUrl = s.bookUrl OR (t.name = s.name AND t.author = s.author AND NOT starts_with(s.bookUrl, 'local-') AND NOT starts_with(t.bookUrl, 'local-')))"


def _shelf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    shelf = part.select(F.concat(F.when(F.col("p_partkey") % 4 == 0, "local-txt:").otherwise("https://b/"), "p_partkey").alias("bookUrl"), F.col("p_name").alias("name"), F.col("p_brand").alias("author"), "p_size")
    return shelf.drop("p_size"), shelf.where("p_size <= 3").drop("p_size")


@query(f"{_TARGETS} SELECT * FROM s WHERE {_HIT}")
def shelf_delete_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delete takes: by URL, or by name and author unless local."""
    return joins.targets_of(*_shelf(spark, sf_dir), keep=True)


@query(f"{_TARGETS} SELECT * FROM s WHERE NOT {_HIT}")
def shelf_delete_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.targets_of(*_shelf(spark, sf_dir), keep=False)


@query("""WITH c AS (SELECT p_partkey AS seq, p_brand AS origin, p_name AS "bookUrl" FROM part WHERE p_brand <> 'Brand#1'), d AS (SELECT *, row_number() OVER (PARTITION BY origin, "bookUrl" ORDER BY seq) AS n FROM c)
SELECT seq, origin, "bookUrl" FROM d WHERE n = 1""")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("origin"), F.col("p_name").alias("bookUrl"))
    return merge.first_rows(rows, ["origin", "bookUrl"], ["seq"])


@query("SELECT DISTINCT 'c' || o_custkey AS source, o_orderpriority AS target, o_orderstatus AS label FROM orders")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("seq"))
    return graph.edges(rows).select("source", "target", "label")


@query("""WITH n AS (SELECT n_name AS id, 'nation' AS kind, '' || n_regionkey AS detail, 0 AS t, n_nationkey AS s FROM nation UNION ALL SELECT r_name, 'region', r_name, 1, r_regionkey FROM region)
SELECT id, id AS label, arg_min(kind, t * 1000 + s) AS kind, arg_min(detail, t * 1000 + s) AS detail FROM n GROUP BY id""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("detail"), F.col("n_nationkey").alias("seq"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("detail"), F.col("r_regionkey").alias("seq"))
    return graph.nodes([(nations, "name", "nation", "detail"), (regions, "name", "region", "detail")])


@query("""WITH RECURSIVE h AS (SELECT r_name AS name, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'S' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT name, parent, 0 AS depth, name AS path FROM h WHERE parent IS NULL UNION ALL SELECT h.name, h.parent, t.depth + 1, t.path || '/' || h.name FROM t JOIN h ON h.parent = t.name) SELECT name, parent, CAST(depth AS INTEGER) AS depth, path FROM t""")
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = r.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    rows = rows.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent")))
    rows = rows.unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.col("n_name").alias("parent")))
    return graph.hierarchy(rows)


@query("SELECT c_custkey, coalesce(o.p, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o_custkey = c_custkey")
def recent_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shelf's values over those of the recent list."""
    shelf = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return joins.overridden(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), shelf, ["c_custkey"], ["c_acctbal"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3")
def from_current_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chapters from the second on; books without one give none."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").where("l_linenumber >= 2")
    return windows.from_current(rows.withColumn("url", F.col("l_linenumber").cast("string")), ["l_orderkey"], "url", F.lit("2"), "l_linenumber", 3).select("l_orderkey", "l_linenumber")


@query("SELECT n_name, CASE WHEN n_nationkey = 20 THEN 3 WHEN n_nationkey BETWEEN 3 AND 19 THEN n_nationkey + 1 ELSE n_nationkey END AS pos FROM nation")
def list_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("pos"))
    return windows.moved(rows, [], "pos", 20, 3)
