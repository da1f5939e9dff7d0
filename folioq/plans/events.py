"""Queries over events: JSON paths, sessions, rate limits, progress, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioq.functions import text as T
from folioq.operators import merge, windows
from folioq.plans.base import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def event_json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list rule with a filter, by the rule language."""
    from folioq.operators.rules import item_rows

    wrapped = _events(spark, sf_dir).select("event_id", F.concat(F.lit('{"data":['), "props", F.lit("]}")).alias("body"), F.lit("https://x.test/").alias("url"))
    rows = item_rows(wrapped, "$.data[?(@.k > 50)]", {"k": "k"}, "body", "url", ("event_id",))
    return rows.select("event_id", F.col("k").cast("int").alias("k"))


@query("SELECT event_id, event_type NOT IN ('error') AND value >= 1 AS flag, lower(trim(x)) NOT IN ('', '0', 'false', 'null', 'none', 'no', 'off') AS said FROM (SELECT *, ['', 'No', ' false', 'not', '1', 'OFF', 'VIP'][1 + event_id % 7] AS x FROM events)")
def truthy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("", "No", " false", "not", "1", "OFF", "VIP")]), (1 + F.col("event_id") % 7).cast("int"))
    flag = (F.col("event_type") != "error") & (F.col("value") >= 1)
    return _events(spark, sf_dir).select("event_id", flag.alias("flag"), T.truthy(said).alias("said"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS expires, count(*) AS calls FROM s GROUP BY user_id, session""")
def sessions_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that each call renews; a gap longer than the lifetime starts a new one."""
    return windows.sessions(_events(spark, sf_dir), "user_id", "ts", 12 * 3600, tie="event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS within FROM events")
def rate_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a user within the trailing window, this one included."""
    return windows.trailing_count(_events(spark, sf_dir), "user_id", "ts", 6 * 3600).select("event_id", "within")


@query("SELECT event_id, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) / 1000.0, 3) AS gap_ms FROM events")
def rate_serial_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = windows.micros("ts")
    gap = us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select("event_id", F.round(F.coalesce(gap, F.lit(-1)) / 1000.0, 3).alias("gap_ms"))


@query("SELECT event_type, event_id, rn FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn BETWEEN 51 AND 100")
def rss_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty of every feed, newest first."""
    return windows.page(_events(spark, sf_dir), ["event_type"], [F.desc("ts"), F.col("event_id")], 2, 50).select("event_type", "event_id", F.col("rn").cast("long").alias("rn"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS saved, arg_max(event_id, (ts, event_id)) AS pos FROM events GROUP BY user_id")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading progress: the last write wins."""
    rows = _events(spark, sf_dir).select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("saved"), F.col("event_id").alias("pos"))
    return merge.latest(rows, ["user_id"], ["saved", "pos"]).select("user_id", "state", "saved", "pos")


@query("SELECT user_id, bit_or(b) AS groups, bit_or(b) & ~CAST(2 AS BIGINT) AS without_two, (bit_or(b) & 4) <> 0 AS in_four, bool_and(b = 0) AS ungrouped FROM (SELECT user_id, CAST(1 << (event_id % 5) AS BIGINT) AS b FROM events) GROUP BY user_id")
def group_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelf groups as bits: set, cleared, tested."""
    bit = F.expr("shiftleft(1L, CAST(event_id % 5 AS INT))")
    df = _events(spark, sf_dir).groupBy("user_id").agg(F.bit_or(bit).alias("groups"), F.bool_and(bit == 0).alias("ungrouped"))
    return df.select("user_id", "groups", F.col("groups").bitwiseAND(F.bitwise_not(F.lit(2).cast("bigint"))).alias("without_two"), (F.col("groups").bitwiseAND(F.lit(4).cast("bigint")) != 0).alias("in_four"), "ungrouped")


@query("SELECT user_id, min(event_id) AS pos, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def list_upsert_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list whose entries are replaced in place: the newest payload at the first position."""
    return merge.kept_in_place(_events(spark, sf_dir).select("user_id", F.col("event_id").alias("pos"), "value", "event_type"), ["user_id"]).select("user_id", "pos", "value", "event_type")


@query("SELECT user_id AS id, count(*) AS degree FROM (SELECT DISTINCT 'u' || user_id AS user_id, event_type FROM events) GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioq.operators import graph

    links = _events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("target"), F.lit("does").alias("label"), F.col("event_id").alias("seq"))
    return graph.degrees(graph.edges(links))


@query("SELECT DISTINCT 'u' || user_id AS id FROM events WHERE event_type = 'purchase'")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioq.operators import graph

    links = _events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("target"))
    return graph.neighbours(links, "purchase")


@query("WITH v AS (SELECT event_id, 'v' || (event_id % 3) || '.' || (user_id % 12) || '.' || (event_id % 10) || '-rc1' AS a FROM events), n AS (SELECT *, [event_id % 3, CAST(regexp_extract(a, 'v\\d+\\.(\\d+)', 1) AS BIGINT), event_id % 10] AS x FROM v) SELECT event_id, a, x > [1, 9, 9] AS newer FROM n".replace("\\\\", "\\"))
def semver_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("v"), F.col("event_id") % 3, F.lit("."), F.col("user_id") % 12, F.lit("."), F.col("event_id") % 10, F.lit("-rc1"))
    return _events(spark, sf_dir).select("event_id", a.alias("a")).withColumn("newer", T.version(F.col("a")) > T.version(F.lit("1.9.9")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, CAST(floor(epoch(ts)) AS BIGINT) AS secs, CAST(round(value / 5 * 10000) AS BIGINT) AS coded FROM events".replace(" AS at", " AS shown"))
def event_time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times given in seconds or milliseconds, told apart by size; progress as ten-thousandths."""
    ms = F.floor(windows.micros("ts") / 1000)
    given = F.when(F.col("event_id") % 2 == 0, ms).otherwise(F.floor(ms / 1000))
    secs = F.when(given > F.lit(1_000_000_000_000), F.floor(given / 1000)).otherwise(given)
    return _events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"), secs.cast("bigint").alias("secs"), F.round(F.col("value") / 5 * 10000).cast("bigint").alias("coded"))
