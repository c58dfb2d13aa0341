"""Order-dependent rules per visitor or address: sessions and the rate limit.

Both rules look at whole seconds. So hits are first counted per (key, second), with map-side
combining: a key sends at most 86,400 rows a day into the ordered pass, however many hits it has.
That pass keeps constant memory per task; its result joins back on (key, second), which spreads a
busy key over many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall import fixed_values as fv

SLICE = 4096  # of the hits' order, whose hits a hot second ranks in one task


def to_second(ts: str):
    return F.date_trunc("second", F.col(ts))


def _ordered(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, order)


def _session_starts(timeout: int):
    """Arrow pass over rows sorted by (key, second) that adds each row's session start.

    All keys of a batch jump from session start to session start together, so the loop runs once
    per session of the busiest key. The last session of a batch is carried into the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_start = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            secs = batch.column(1).to_numpy(zero_copy_only=False)
            first = np.r_[True, keys[1:] != keys[:-1]]
            rank = np.cumsum(first) - 1
            low = secs.min()
            span = int(secs.max() - low) + timeout + 2
            place = rank * span + (secs - low)
            following = np.searchsorted(place, place + timeout, side="right")
            is_start = np.zeros(len(keys), dtype=bool)
            heads = np.flatnonzero(first)
            if open_key is not None and keys[0] == open_key:
                # rows of the open session come first; the key's next session starts after them
                held = np.searchsorted(rank, 0, side="right")
                heads[0] = np.searchsorted(secs[:held], open_start + timeout, side="right")
                heads = heads[1:] if heads[0] == held else heads
            while len(heads):
                is_start[heads] = True
                step = following[heads]
                inside = step < len(keys)
                step, was = step[inside], heads[inside]
                heads = step[rank[step] == rank[was]]
            begin = np.where(is_start, np.arange(len(keys)), -1)
            begin = np.maximum.accumulate(begin)
            starts = np.where(begin >= 0, secs[np.maximum(begin, 0)], 0)
            if open_key is not None and keys[0] == open_key:
                starts[begin < 0] = open_start
            open_key, open_start = keys[-1], starts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, type=pa.int64())],
                names=["_key", "_sec", "_start"],
            )

    return run


def session_starts(
    hits: DataFrame, visitor: str = "visitor_id", ts: str = "viewed_at", timeout: int = fv.SESSION_SECONDS
) -> DataFrame:
    """(visitor, second, session start) for every distinct second a visitor was seen in.

    A session takes every hit up to ``timeout`` seconds after its *start*; the next hit opens a new one.
    """
    seconds = hits.select(F.col(visitor).cast("long").alias("_key"), F.unix_seconds(to_second(ts)).alias("_sec"))
    seconds = seconds.filter(F.col("_key").isNotNull()).distinct()
    runs = _ordered(seconds, "_key", "_sec").mapInArrow(
        _session_starts(timeout), "_key long, _sec long, _start long"
    )
    return runs.select(
        F.col("_key").alias(visitor),
        F.timestamp_seconds("_sec").alias("_second"),
        F.timestamp_seconds("_start").alias("started_at"),
    )


def sessionize_anchored(
    hits: DataFrame,
    visitor: str = "visitor_id",
    ts: str = "viewed_at",
    timeout: int = fv.SESSION_SECONDS,
    open_sessions: DataFrame | None = None,
) -> DataFrame:
    """Adds ``started_at`` and ``session_id`` to every hit; hits without a visitor are dropped.

    ``open_sessions`` (visitor and ``started_at``) are sessions of an earlier load that hits may still belong to.
    """
    seen = hits.select(visitor, ts)
    if open_sessions is not None:
        seen = seen.unionByName(open_sessions.select(visitor, F.col("started_at").alias(ts)))
    # nearly as many rows as hits: never one side that goes whole through the driver, however small its files make it look
    starts = session_starts(seen, visitor, ts, timeout).hint("merge")
    joined = hits.withColumn("_second", to_second(ts)).join(starts, [visitor, "_second"]).drop("_second")
    return joined.withColumn("session_id", F.xxhash64(visitor, "started_at"))


def sessionize_gap(
    hits: DataFrame, visitor: str = "visitor_id", ts: str = "viewed_at", timeout: int = fv.SESSION_SECONDS
) -> DataFrame:
    """The inactivity variant: (visitor, started_at, ended_at, hits) with gaps of at most ``timeout``.

    Seconds are counted before the window, so a busy visitor brings a bounded number of rows.
    """
    seconds = hits.groupBy(F.col(visitor), to_second(ts).alias("_second")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(visitor).orderBy("_second")
    gap = F.unix_seconds("_second") - F.unix_seconds(F.lag("_second").over(order))
    opened = seconds.withColumn("_new", F.when(gap.isNull() | (gap > timeout), 1).otherwise(0))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(visitor, "_run")
        .agg(F.min("_second").alias("started_at"), F.max("_second").alias("ended_at"), F.sum("_n").alias("hits"))
        .drop("_run")
    )


def accept_quota(secs, counts, limit: int, ttl: int, count: int, last: int):
    """Accepted hits of consecutive seconds of one key, and the counter state after them.

    The counter lives until ``ttl`` seconds after the last accepted hit (that second included);
    refused hits do not extend it.
    """
    out = np.empty(len(secs), dtype=np.int64)
    for i, (sec, n) in enumerate(zip(secs.tolist(), counts.tolist())):
        if sec - last > ttl:
            count = 0
        taken = min(n, limit - count)
        if taken > 0:
            count, last = count + taken, sec
        out[i] = taken
    return out, count, last


def _quotas(limit: int, ttl: int):
    """Arrow pass over (key, second, hits) that adds how many of the hits are accepted.

    A pause longer than ``ttl`` clears the counter, and a run of seconds that stays below the limit
    is accepted whole; only runs that reach the limit are stepped through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        never = -(1 << 62)
        open_key, count, last = None, 0, never
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, secs, hits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            quota = hits.copy()
            cut = np.r_[True, (keys[1:] != keys[:-1]) | (secs[1:] - secs[:-1] > ttl)]
            begins = np.flatnonzero(cut)
            ends = np.r_[begins[1:], len(keys)]
            totals = np.add.reduceat(hits, begins)
            carried = open_key is not None and keys[0] == open_key
            stepped = set(np.flatnonzero(totals >= limit).tolist()) | {0, len(begins) - 1}
            for i in sorted(stepped):
                b, e = begins[i], ends[i]
                state = (count, last) if i == 0 and carried else (0, never)
                quota[b:e], count, last = accept_quota(secs[b:e], hits[b:e], limit, ttl, *state)
            open_key = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(quota)], names=["_key", "_sec", "_quota"]
            )

    return run


def rate_limit_quotas(
    hits: DataFrame, key: str = "ip", ts: str = "ts", limit: int = fv.RATE_LIMIT, ttl: int = fv.RATE_TTL_SECONDS
) -> DataFrame:
    """(key, second, accepted hits) for every second a key sent hits in."""
    seconds = hits.groupBy(F.xxhash64(key).alias("_key"), F.unix_seconds(to_second(ts)).alias("_sec")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    quotas = _ordered(seconds, "_key", "_sec").mapInArrow(_quotas(limit, ttl), "_key long, _sec long, _quota long")
    return quotas.hint("merge")  # as many as there are seconds of keys: see sessionize_anchored


def flag_rate_limited(
    hits: DataFrame,
    key: str = "ip",
    ts: str = "ts",
    order: str = "view_id",
    limit: int = fv.RATE_LIMIT,
    ttl: int = fv.RATE_TTL_SECONDS,
) -> DataFrame:
    """Adds ``rate_limited``: the hit arrived when its key had used up its quota.

    Within one second the earliest hits by ``order`` are accepted.
    """
    keyed = hits.withColumns({"_key": F.xxhash64(key), "_sec": F.unix_seconds(to_second(ts))})
    quotas = rate_limit_quotas(hits, key, ts, limit, ttl)
    joined = keyed.join(quotas, ["_key", "_sec"])
    rank = F.row_number().over(Window.partitionBy("_key", "_sec").orderBy(order))
    return joined.withColumn("rate_limited", rank > F.col("_quota")).drop("_key", "_sec", "_quota")


def beyond_quota(hits: DataFrame, over: DataFrame, key: str = "ip", ts: str = "ts", order: str = "view_id") -> DataFrame:
    """Hits of the seconds in ``over`` (``_key``, ``_sec``, ``_quota``) behind the first ``_quota`` by ``order``, a number.

    A second may hold any share of all hits. Its hits are cut into slices of ``order``, which are counted; the slices' counts say in
    which one the quota runs out, and only that slice's hits are ranked.
    """
    keyed = hits.withColumns({"_key": F.xxhash64(key), "_sec": F.unix_seconds(to_second(ts))}).join(over, ["_key", "_sec"])
    keyed = keyed.withColumn("_slice", F.floor(F.col(order) / SLICE))
    counts = keyed.groupBy("_key", "_sec", "_slice").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("_key", "_sec").orderBy("_slice")) - F.col("_n")
    placed = keyed.join(counts.withColumn("_ahead", ahead).drop("_n"), ["_key", "_sec", "_slice"])
    names = hits.columns
    late = placed.where(F.col("_ahead") >= F.col("_quota")).select(*names)
    rank = F.col("_ahead") + F.row_number().over(Window.partitionBy("_key", "_sec", "_slice").orderBy(order))
    edge = placed.where(F.col("_ahead") < F.col("_quota")).withColumn("_rank", rank).where(F.col("_rank") > F.col("_quota"))
    return late.unionByName(edge.select(*names))
