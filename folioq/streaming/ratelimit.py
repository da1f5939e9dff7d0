"""Rate limits: when calls start. A delay moves what comes behind it, so a user's calls are admitted in order, with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from folioq.operators.windows import micros


def window_start(ask: int, recent: deque[int], limit: int, window_ms: int) -> int:
    """When a call asked for may start: at most `limit` starts in any trailing window, both ends included."""
    start = max(ask, recent[-1] if recent else ask)
    while recent and recent[0] < start - window_ms:
        recent.popleft()
    if len(recent) >= limit:
        start = max(start, recent[len(recent) - limit] + window_ms + 1)
    recent.append(start)
    while len(recent) > limit:
        recent.popleft()
    return start


def parsed(text: str) -> tuple[int, int]:
    """"n/ms" as it says; "ms" is one call at a time, that far apart."""
    n, slash, ms = text.partition("/")
    return (int(n), int(ms)) if slash else (1, int(n))


def _with_start(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("start_ms", LongType())])


def admitted(calls: DataFrame, user: str, ts: str, limit: int, window_ms: int, tie: str) -> DataFrame:
    """calls with start_ms. Each user's calls are read in order as a stream of batches; only `limit` starts are kept."""
    rows = calls.withColumn("_ask", F.floor(micros(ts) / 1000)).repartition(user).sortWithinPartitions(user, ts, tie)

    def started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, deque()
        for f in frames:
            out = []
            for u, ask in zip(f[user], f["_ask"]):
                if u != now:
                    now, recent = u, deque()
                out.append(window_start(int(ask), recent, limit, window_ms))
            yield f.assign(start_ms=out)

    return rows.mapInPandas(started, _with_start(rows)).drop("_ask")


def stream(calls: DataFrame, user: str, ts: str, limit: int, window_ms: int) -> DataFrame:
    """The same on a stream: a user's last starts are its state."""
    rows = calls.withColumn("_ask", F.floor(micros(ts) / 1000))

    def started(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0] if state.exists else [])
        f = pd.concat(list(frames)).sort_values("_ask", kind="stable")
        out = [window_start(int(a), recent, limit, window_ms) for a in f["_ask"]]
        state.update((list(recent),))
        yield f.assign(start_ms=out)

    return rows.groupBy(user).applyInPandasWithState(started, _with_start(rows), "starts array<bigint>", "append", GroupStateTimeout.NoTimeout).drop("_ask")
