"""Which interval a point lies in, for tables of any size on both sides.

Points and intervals are dealt out by ranges of the key: an interval goes to every part it touches, a point to the one it lies in.
Parts hold about as many keys each, as their bounds come from a sample of both sides (which decides balance only). Within a part
the intervals' sorted starts are searched for all points together; a point beyond the end found goes on to the last interval before
that ends later, so overlaps cost as many steps as intervals lie inside each other, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import session

SAMPLED = 64  # keys a part whose order gives the bounds


def _spread(bounds: np.ndarray, first: int):
    """Arrow pass that adds the part of points (``first`` 1) or all parts of intervals (0), as column ``_part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).cast(pa.binary()).to_numpy(zero_copy_only=False).astype("S")
            part = np.searchsorted(bounds, key, "right")
            take = np.arange(len(part))
            if first == 0:
                open_end = ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                end = batch.column(1).fill_null("").cast(pa.binary()).to_numpy(zero_copy_only=False).astype("S")
                last = np.where(open_end, part, np.maximum(part, np.searchsorted(bounds, end, "right")))
                size = last - part + 1
                take = np.repeat(take, size)
                part = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(part, size)
                # of intervals without an end only the last to start counts in the parts behind
                ever = np.flatnonzero(open_end)
                if len(ever):
                    ever = ever[np.argsort(key[ever], kind="stable")]
                    own = np.searchsorted(bounds, key[ever], "right")
                    behind = np.arange(own[0] + 1, len(bounds) + 1)
                    take = np.append(take, ever[np.searchsorted(own, behind) - 1])
                    part = np.append(part, behind)
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "_part"])

    return run


class _Starts:
    """The intervals of one part, by start, and for each the last one before it that ends later."""

    def __init__(self, rows: pa.Table):
        self.value = rows.column("_value").combine_chunks()
        text = lambda c: rows.column(c).fill_null("").cast(pa.binary()).to_numpy().astype("S")
        self.start, self.end = text("_key"), text("_hi")
        self.open = ~rows.column("_hi").is_valid().to_numpy()
        self.around = np.full(len(self.start), -1)
        stack: list[int] = []
        for k, (end, ever) in enumerate(zip(self.end.tolist(), self.open.tolist(), strict=True)):
            while stack and not ever and not self.open[stack[-1]] and self.end[stack[-1]] <= end or stack and ever:
                stack.pop()
            self.around[k] = stack[-1] if stack else -1
            stack.append(k)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key the interval it lies in that starts last (of those the shortest), -1 for none."""
        at = np.searchsorted(self.start, keys, "right") - 1
        while True:
            beyond = np.flatnonzero((at >= 0) & ~self.open[at] & (self.end[at] < keys))
            if not len(beyond):
                return at
            at[beyond] = self.around[at[beyond]]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow pass over rows sorted by part, intervals before points, that adds what each point lies in."""
    part, held, starts = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            piece = batch.slice(a, b - a)
            if parts[a] != part:
                part, held, starts = parts[a], [], None
            if kinds[a] == 0:
                held.append(piece)
                continue
            if starts is None and held:
                starts = _Starts(pa.Table.from_batches(held))
            key = piece.column(2)
            if starts is None:
                found = pa.nulls(piece.num_rows, piece.column(4).type)
            else:
                at = starts.find(key.cast(pa.binary()).to_numpy(zero_copy_only=False).astype("S"))
                found = starts.value.take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([key, found], ["_key", "_found"])


def lookup(points: DataFrame, intervals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(``_key``, ``_found``) for every row of ``points`` (column ``_key``): ``columns`` of the interval it lies in, or NULL.

    Intervals have ``_lo`` and ``_hi``, both included; a NULL ``_hi`` is no end. Keys are text that sorts as the values do. Of
    several intervals the one that starts last counts, of those the shortest. NULL keys and starts are left out.
    """
    spark = points.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = points.select("_key").where(F.col("_key").isNotNull())
    ends = intervals.where(F.col("_lo").isNotNull()).groupBy("_lo", "_hi").agg(F.min(F.struct(*columns)).alias("_value"))
    ends = ends.select(F.col("_lo").alias("_key"), "_hi", "_value")
    some = points.unionByName(ends.select("_key")).orderBy(F.xxhash64("_key")).limit(SAMPLED * count)
    keys = sorted(r["_key"] for r in some.collect())
    bounds = np.array(sorted({k.encode() for k in keys[:: SAMPLED]} - {keys[0].encode()} if keys else ()), "S")
    schema = "_key string, _hi string, _value " + ends.schema["_value"].dataType.simpleString()
    empty = points.select("_key", F.lit(None).cast("string").alias("_hi"), F.lit(None).cast(ends.schema["_value"].dataType).alias("_value"))
    dealt = [
        df.mapInArrow(_spread(bounds, kind), f"{schema}, _part int").select("_part", F.lit(kind).alias("_kind"), "_key", "_hi", "_value")
        for kind, df in enumerate((ends, empty))
    ]
    order = ["_part", "_kind", "_key", F.col("_hi").isNotNull(), F.desc("_hi")]
    rows = dealt[0].unionByName(dealt[1]).repartition(count, "_part").sortWithinPartitions(*order)
    return rows.mapInArrow(_searched, "_key string, _found " + ends.schema["_value"].dataType.simpleString())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Rows that are read more than once, written below the shared folder."""
    path = session.new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
