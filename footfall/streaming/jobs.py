"""Streaming twins of the batch operators. Event time is ``ts``; late rows fall to the watermark.

Ordered state (sessions, rate limits) does not see single hits: an append-mode count per
(key, second) comes first. It emits a second only when the watermark has passed it, so the state
sees each key's seconds in order and at most one row per second, however busy the key is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall import fixed_values as fv
from footfall.operators.sessionize import accept_quota

WATERMARK = "1 hour"


def stream_active_visitors(hits: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Visitors of the last five minutes, every minute.

    Streams allow no distinct count, so visitors are grouped first and counted after: exact, and a
    busy visitor is one row per window.
    """
    grouped = hits.withWatermark("ts", watermark).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "visitor_id")
    counted = grouped.agg(F.count(F.lit(1)).alias("n")).groupBy("w").agg(
        F.count("visitor_id").alias("visitors"), F.sum("n").alias("views")
    )
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "visitors", "views")


def stream_daily_totals(hits: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Visitors, views and page time per day, grouped by visitor first."""
    grouped = hits.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "visitor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("d")
    )
    counted = grouped.groupBy("w").agg(
        F.count("visitor_id").alias("visitors"), F.sum("n").alias("views"), F.sum("d").alias("total_duration")
    )
    return counted.select(F.to_date("w.start").alias("date"), "visitors", "views", "total_duration")


def stream_sessions_gap(hits: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Inactivity sessions; windows that only touch are merged, so a gap of exactly the timeout is inside."""
    gap = f"{fv.SESSION_SECONDS} seconds"
    seconds = hits.withColumn("ts", F.date_trunc("second", "ts")).withWatermark("ts", watermark)
    grouped = seconds.groupBy("visitor_id", F.session_window("ts", gap).alias("w"))
    counted = grouped.agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("ended_at"))
    return counted.select("visitor_id", F.col("w.start").alias("started_at"), "ended_at", "hits")


def _seconds(hits: DataFrame, key: str, watermark: str) -> DataFrame:
    """Hits per (key, second) with the second's event time kept for the state after it."""
    grouped = hits.withWatermark("ts", watermark).groupBy(F.col(key).alias("key"), F.window("ts", "1 second").alias("w"))
    counted = grouped.agg(F.count(F.lit(1)).alias("n"))
    return counted.select("key", F.unix_seconds("w.start").alias("sec"), "n", F.window_time("w").alias("at"))


class AnchoredSessions(StatefulProcessor):
    """Keeps a visitor's open session as (start, last hit, hits); a timer closes it."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "start long, last long, hits long")

    def _rows(self, key, closed) -> pd.DataFrame:
        start, last, hits = (np.array(c, dtype="int64") for c in zip(*closed))
        return pd.DataFrame({"visitor_id": key[0], "start": start, "last": last, "hits": hits})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat([r[["sec", "n"]] for r in rows]).sort_values("sec", kind="stable")
        open_ = tuple(self.session.get()) if self.session.exists() else None
        before = open_[0] if open_ else None
        closed = []
        for sec, n in zip(seen["sec"].tolist(), seen["n"].tolist()):
            if open_ and sec <= open_[0] + self.timeout:
                open_ = (open_[0], sec, open_[2] + n)
            else:
                closed += [open_] if open_ else []
                open_ = (sec, sec, n)
        self.session.update(open_)
        if open_[0] != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(open_[0]))
        if closed:
            yield self._rows(key, closed)

    def _due(self, start: int) -> int:
        return (start + self.timeout + 1) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            open_ = tuple(self.session.get())
            self.session.clear()
            yield self._rows(key, [open_])

    def close(self) -> None:
        pass


def stream_sessions_anchored(hits: DataFrame, timeout: int = fv.SESSION_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Sessions anchored at their start, emitted once no further hit can belong to them."""
    rows = _seconds(hits, "visitor_id", watermark).groupBy("key").transformWithStateInPandas(
        AnchoredSessions(timeout), "visitor_id long, start long, last long, hits long", "Append", "EventTime"
    )
    return rows.select(
        "visitor_id", F.timestamp_seconds("start").alias("started_at"), F.timestamp_seconds("last").alias("ended_at"), "hits"
    )


def stream_dedup(hits: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """First row per key; a key is remembered as long as the watermark allows."""
    return hits.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def stream_engagement(hits: DataFrame, beacons: DataFrame, within: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Views with the latest beacon that follows them, once their time is up; NULLs where there is none.

    The beacons of a view meet in one group again, dated by the view, so that each view is one row.
    """
    left = hits.select("view_id", F.col("pvid").alias("_pvid"), F.col("ts").alias("_viewed")).withWatermark("_viewed", watermark)
    right = beacons.select("pvid", "ts", "engagement_time", "scroll_depth").withWatermark("ts", watermark)
    match = (F.col("_pvid") == F.col("pvid")) & (F.col("ts") >= F.col("_viewed")) & (
        F.col("ts") <= F.col("_viewed") + F.expr(f"INTERVAL {within}")
    )
    beacon = F.struct(F.unix_micros("ts").alias("at"), "engagement_time", "scroll_depth")
    joined = left.join(right, match, "leftOuter").select("view_id", "_viewed", F.when(F.col("ts").isNotNull(), beacon).alias("_beacon"))
    latest = joined.groupBy("view_id", F.window("_viewed", "1 second").alias("w")).agg(F.max("_beacon").alias("_beacon"))
    return latest.select("view_id", "_beacon.engagement_time", "_beacon.scroll_depth")


class RateLimit(StatefulProcessor):
    """Keeps a key's accepted hits and the time of the last one."""

    def __init__(self, limit: int, ttl: int):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "count long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat([r[["sec", "n"]] for r in rows]).sort_values("sec", kind="stable")
        state = tuple(self.counter.get()) if self.counter.exists() else (0, -(1 << 62))
        secs, hits = seen["sec"].to_numpy(), seen["n"].to_numpy()
        quota, count, last = accept_quota(secs, hits, self.limit, self.ttl, *state)
        self.counter.update((int(count), int(last)))
        if state[1] != last:
            if self.counter.exists() and state[0]:
                self.handle.deleteTimer((state[1] + self.ttl + 1) * 1000)
            self.handle.registerTimer((int(last) + self.ttl + 1) * 1000)
        yield pd.DataFrame({"key": key[0], "sec": secs, "hits": hits, "accepted": quota})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counter.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_rate_limit(
    hits: DataFrame, key: str, limit: int = fv.RATE_LIMIT, ttl: int = fv.RATE_TTL_SECONDS, watermark: str = WATERMARK
) -> DataFrame:
    """(key, second, hits, accepted hits); the counter is dropped when its time to live is over."""
    kind = hits.schema[key].dataType.simpleString()
    rows = _seconds(hits, key, watermark).groupBy("key").transformWithStateInPandas(
        RateLimit(limit, ttl), f"key {kind}, sec long, hits long, accepted long", "Append", "EventTime"
    )
    return rows.select("key", F.timestamp_seconds("sec").alias("second"), "hits", "accepted")
