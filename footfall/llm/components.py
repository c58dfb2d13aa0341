"""Connected components of links, by union-find inside partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import settle

EDGE = "a long, b long"


def forest(links: DataFrame) -> DataFrame:
    """A spanning forest of each partition's links: every node of a tree (a) with its smallest node (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                top = x
                while root.get(top, top) != top:
                    top = root[top]
                while root.get(x, x) != top:
                    root[x], x = top, root[x]
                return top

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            nodes = [x for x in root if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root[x] for x in nodes], pa.int64())], ["a", "b"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(run, EDGE)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has a link to another.

    ``links`` has two columns of node ids, ``a`` and ``b``. Each round hangs the larger neighbours of a node, then the smaller
    ones, below its smallest; rounds grow with the logarithm of the longest chain. Minima are combined before the shuffle, so a
    node with very many links is no single task's.
    """
    edges = settle(forest(links).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select("a", "m")).where("x <> m")
        edges = settle(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
