"""A sliding-window rate limiter as a stateful stream operator.

A refused request does not count against the limit, so a decision depends on the decisions before it: no window function
gives it. The state of a key holds the times of its accepted requests inside the window, at most ``limit`` of them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, id long, us long, allowed boolean, remaining int, reset int"


def decide(times: list[int], accepted: deque[int], limit: int, window: int) -> list[tuple[bool, int, int]]:
    """(allowed, remaining, reset) of requests in order; ``accepted`` holds the accepted times and is brought up to date.

    Times are microseconds. remaining: requests that the window still takes after this one; reset: whole seconds until its
    oldest accepted request leaves. A request earlier than the newest accepted one is judged as if it came then.
    """
    out = []
    for t in times:
        now = max(t, accepted[-1]) if accepted else t
        while accepted and now - accepted[0] >= window:
            accepted.popleft()
        allowed = len(accepted) < limit
        if allowed:
            accepted.append(now)
        oldest = accepted[0] if accepted else now
        out.append((allowed, max(0, limit - len(accepted)), max(0, (window - (now - oldest)) // 1_000_000) if accepted else 0))
    return out


class Limiter(StatefulProcessor):
    """State by key: the accepted times as a list; it expires when a key has been silent for ``ttl`` seconds of the clock."""

    def __init__(self, limit: int, window: int, ttl: int | None):
        self.limit, self.window, self.ttl = limit, window, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("us", T.LongType())])
        self.times = handle.getListState("accepted", schema, ttlDurationMs=self.ttl * 1000) if self.ttl else handle.getListState("accepted", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([*rows], ignore_index=True).sort_values(["us", "id"], kind="stable")
        accepted = deque(x[0] for x in self.times.get())
        got = decide(batch["us"].tolist(), accepted, self.limit, self.window)
        self.times.put([(t,) for t in accepted])
        out = pd.DataFrame(got, columns=["allowed", "remaining", "reset"]).astype({"remaining": "int32", "reset": "int32"})
        out.insert(0, "us", batch["us"].to_numpy())
        out.insert(0, "id", batch["id"].to_numpy())
        out.insert(0, "key", key[0])
        yield out

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, id_col: str, us_col: str, limit: int, seconds: int, ttl: int | None = None) -> DataFrame:
    """``OUTPUT`` for each request of a stream: allowed while fewer than ``limit`` accepted ones lie in the last ``seconds``.

    Requests of one micro-batch are judged by time, then id; those of later batches after them, so a key's group in memory
    is its share of one micro-batch, which the source's options bound. Null times or keys are judged by nobody and left
    out. A restart goes on from the stored state. ``ttl`` (seconds of the clock, for live streams) frees silent keys.
    """
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(us_col).cast("long").alias("us")).where("key is not null and us is not null")
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, seconds * 1_000_000, ttl), OUTPUT, "Append", "None")

