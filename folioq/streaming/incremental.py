"""Streams: results as sources answer, sessions that calls renew, memories that grow by chapter.

Each has the batch form's answer: a stream over all rows ends where the batch query stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from folioq.functions.text import merge_key


def arriving(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 24) -> DataFrame:
    """Responses as a stream: Parquet files as they come into a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_arrivals(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Each name and author once, on its first arrival. State: a key per book."""
    return rows.withColumn("_key", merge_key(F.col("name"), F.col("author"))).dropDuplicates(["_key"]).drop("_key")


def search(rows: DataFrame, sink: str, checkpoint: str, enough: int, cursor: str = "source_index", on_batch: Callable[[int, int, int], None] | None = None, deduplicated: bool = False) -> StreamingQuery:
    """Writes new results batch by batch until there are `enough`; on_batch gets (batch, rows so far, last cursor).

    A batch's files carry its number, so that a batch that runs again replaces itself. What there is already is read from
    the sink: a stream that starts again from its checkpoint goes on counting where it was.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = progress(spark, sink, batch.schema, cursor, number)
        if before["total"] >= enough:
            batch.write.format("noop").mode("overwrite").save()  # the state of what has arrived is kept all the same
            return
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if on_batch:
            now = progress(spark, sink, batch.schema, cursor, number + 1)
            on_batch(number, now["total"], now["last"])

    return (rows if deduplicated else first_arrivals(rows)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, sink: str, schema: StructType, cursor: str = "source_index", upto: int | None = None, enough: int | None = None) -> dict:
    """How far a search has come by its sink's batches below `upto`: total, the last finished source, and whether more is wanted."""
    whole = StructType([*schema.fields]).add("batch", "integer")
    try:
        rows = spark.read.schema(whole).parquet(sink)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], whole)
    rows = rows if upto is None else rows.where(F.col("batch") < upto)
    got = rows.agg(F.count("*").alias("n"), F.max_by(cursor, F.struct("batch", cursor)).alias("last")).first()
    return {"total": got["n"], "last": got["last"] if got["last"] is not None else -1, "has_more": enough is None or got["n"] < enough}


def switch_search(rows: DataFrame, name: str, author: str, sink: str, checkpoint: str, enough: int = 30, **how) -> StreamingQuery:
    """Candidates for another source of a book: rows of exactly its name and author, kept in the sink as they come."""
    same = rows.where((F.col("name") == name) & (F.col("author") == author)).withColumn("_once", F.concat_ws("::", "origin", "bookUrl"))
    return search(same.dropDuplicates(["_once"]).drop("_once"), sink, checkpoint, enough, deduplicated=True, **how)


def cache_progress(results: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Counts of chapters cached, fetched and failed after each batch: (batch, cached, success, failed), the last one is the end's.

    results: (status) of finished chapters, one of cached, success and failed. Counts go on from the sink's own last row.
    """
    kinds = ("cached", "success", "failed")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "cached bigint, success bigint, failed bigint, batch int"
        try:
            before = spark.read.schema(schema).parquet(sink).where(F.col("batch") < number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = spark.createDataFrame([], schema)
        last = before.agg(*[F.max(k).alias(k) for k in kinds])
        now = batch.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
        both = now.crossJoin(last.toDF(*[f"_{k}" for k in kinds]))  # a row by a row
        both.select(*[(F.col(k) + F.coalesce(f"_{k}", F.lit(0))).cast("bigint").alias(k) for k in kinds]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(chapters: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Further pages of a table of contents as they come: (seq, title, url) go behind what the sink has, once each, indexed anew."""
    from pyspark.sql import Window

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "title string, url string, `index` bigint, batch int"
        try:
            before = spark.read.schema(schema).parquet(sink).where(F.col("batch") < number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = spark.createDataFrame([], schema)
        have = before.count()
        fresh = batch.join(before.select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.min(F.struct("seq", "title")).alias("r"))
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r.seq", "url")) - 1 + have  # one book's list
        fresh.select("r.title", "url", place.cast("bigint").alias("index")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return chapters.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(calls: DataFrame, user: str, ts: str, lifetime: str, late: str = "0 seconds") -> DataFrame:
    """Sessions that each call renews for `lifetime`; on a stream they come out once they have expired.

    Late calls beyond `late` are the stream's own concern: the feature itself knows no late data.
    """
    rows = calls.withWatermark(ts, late) if calls.isStreaming else calls
    out = rows.groupBy(user, F.session_window(ts, lifetime).alias("s")).agg(F.count("*").alias("calls"))
    return out.select(user, F.col("s.start").alias("started"), F.col("s.end").alias("expires"), "calls")


def expired(calls: DataFrame, user: str, ts: str, lifetime_ms: int) -> DataFrame:
    """(user, at_ms, event): logins and renewals as calls come, with a state of one time per user.

    A call within the lifetime of the last renews; a later one starts anew.
    """

    def told(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        f = pd.concat(list(frames)).sort_values("_ms", kind="stable")
        events = []
        for at in f["_ms"]:
            events.append("renewed" if until is not None and at <= until else "started")
            until = int(at) + lifetime_ms
        state.update((until,))
        yield pd.DataFrame({user: f[user].to_numpy(), "at_ms": f["_ms"].to_numpy(), "event": events})

    rows = calls.select(user, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"))
    schema = StructType([rows.schema[user]]).add("at_ms", "long").add("event", "string")
    return rows.groupBy(user).applyInPandasWithState(told, schema, "until bigint", "append", GroupStateTimeout.NoTimeout)


def memories(chapters: DataFrame, book: str = "bookUrl", index: str = "index") -> DataFrame:
    """(book, processed, names, last): what a book's chapters have told so far. A chapter that was there is skipped.

    chapters: (book, index, name, status). State: the highest index, each name with its latest status.
    """

    def told(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, names, statuses = state.get if state.exists else (-1, [], [])
        known = dict(zip(names, statuses))
        f = pd.concat(list(frames)).sort_values(index, kind="stable")
        for i, name, status in zip(f[index], f["name"], f["status"]):
            if i <= done:
                continue
            if name is not None:
                known[name] = status or known.get(name, "")
        done = max(done, int(f[index].max()))
        state.update((done, list(known), list(known.values())))
        yield pd.DataFrame({book: [key[0]], "processed": [done], "names": [len(known)], "last": [next(reversed(known), None)]})

    schema = StructType([chapters.schema[book]]).add("processed", "long").add("names", "long").add("last", "string")
    return chapters.groupBy(book).applyInPandasWithState(told, schema, "done bigint, names array<string>, statuses array<string>", "update", GroupStateTimeout.NoTimeout)


def cached_with_ttl(entries: DataFrame, now: str, ttl_s: int, key: str = "key") -> DataFrame:
    """Entries with whether they are fresh; a stale one still serves where nothing newer was fetched."""
    newest = entries.groupBy(key).agg(F.max_by(F.struct("value", "fetched"), "fetched").alias("e"), F.max_by("fetched", F.when(F.col("value").isNotNull(), F.col("fetched"))).alias("_f"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("fetched"))).alias("value"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("_f").cast("timestamp"))
    return newest.select(key, "value", (age <= ttl_s).alias("fresh"))
