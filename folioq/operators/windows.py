"""Positions, pages, sessions and trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioq.operators.positions import placed


EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{}`)"


def micros(ts: str) -> Column:
    """Microseconds since 1970 by a timestamp's own clock, with or without time zone."""
    return F.expr(EPOCH.format(ts))


def page(rows: DataFrame, by: Sequence[str], order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) of each group. Ranks beyond it aren't kept: the limit is pushed into the window."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rn", rn).where((F.col("rn") > (number - 1) * size) & (F.col("rn") <= number * size))


def sessions(calls: DataFrame, user: str, ts: str, lifetime_s: int, tie: str) -> DataFrame:
    """(user, session, started, expires, calls): each call renews a session for its lifetime."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    fresh = F.when(gap > lifetime_s * 1_000_000, 1).otherwise(0)
    marked = calls.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w))
    return marked.groupBy(user, "session").agg(F.min(ts).alias("started"), (F.max(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lifetime_s))).alias("expires"), F.count("*").alias("calls"))


def trailing_count(calls: DataFrame, user: str, ts: str, seconds: int, out: str = "within") -> DataFrame:
    """How many calls the trailing window holds at each call; both of its ends count."""
    us = micros(ts)
    w = Window.partitionBy(user).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("_us", us).withColumn(out, F.count("*").over(w)).drop("_us")


def from_current(chapters: DataFrame, by: Sequence[str], url: str, current: Column, order: str, most: int) -> DataFrame:
    """The chapters from a current one on, `most` of them; from the first if it isn't there."""
    start = F.coalesce(F.min(F.when(F.col(url) == current, F.col(order))).over(Window.partitionBy(*by)), F.min(order).over(Window.partitionBy(*by)))
    rows = chapters.withColumn("_s", start).where(F.col(order) >= F.col("_s"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= most).drop("_s", "_n")


def moved(items: DataFrame, by: Sequence[str], pos: str, start: int, to: int) -> DataFrame:
    """A list with the item at start moved to another place; the others close up."""
    p = F.col(pos)
    shift = F.when(p == start, F.lit(to)).when((p > start) & (p <= to), p - 1).when((p < start) & (p >= to), p + 1).otherwise(p)
    return items.withColumn(pos, shift)


def batches(items: DataFrame, by: Sequence[str], order: Sequence[str], size: int, out: str = "batch") -> DataFrame:
    return placed(items, by, order, out).withColumn(out, F.floor(F.col(out) / size))
