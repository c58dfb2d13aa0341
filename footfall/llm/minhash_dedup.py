"""Near-duplicates of documents: SuperMinHash signatures, banding, exact verification, union-find groups.

Documents with the same shingle set are one class; only classes go on. Classes that agree in a band share a bucket, and a bucket
is a star around the member that meets most others, not all its pairs. For a member x with centre c, let D(x) be the shingles
that only one of the two has. Whether x and y are alike then depends on how much D(x) and D(y) overlap:

    100 * |x & y| >= t * |x | y|   exactly when   f(x) + f(y) <= 2 * (100 + t) * |D(x) & D(y)|,   f(x) = (100 + t) * |D(x)| - (100 - t) * |x|

With f(c) = -(100 - t) * |c|, x is linked to its centre when f(x) + f(c) <= 0. Members linked to the centre are one group already.
Any other link needs D(x) and D(y) to overlap by a known amount, so the two must share one of the rarest tokens of either (prefix
filter, with a filter by position); those candidates are checked in full. Members that are linked to the same centre, be it that of
another bucket, are one group already and make no candidate: a large family in the bucket of another, similar one is held together
by its own centre. So all pairs of a bucket are decided, yet only pairs between families that share rare edits are ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import settle, texts
from footfall.llm.components import components
from footfall.llm.kernels import U, Words, give_back, mix, steps, text_bytes
from footfall.llm.superminhash import band_keys, shingles, signatures

WIDTH = 5
# rows and number of bands for a threshold in percent: a pair just at it is missed once in 100,000 times or less
BANDS = {85: (6, 28), 80: (5, 32)}
SKETCH = "doc_id long, mark long, n_shingles long, h1 long, h2 long, bands array<long>"
DIFFERENCE = "center long, node long, f long, fc long, size long, tokens array<long>"


def sketch(docs: DataFrame, threshold: int, width: int = WIDTH) -> DataFrame:
    """Per document: a mark of its text, the size of its shingle set, two hashes of the set, and its band keys (none for an empty set)."""
    rows, bands = BANDS[threshold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in steps(batches):
            keys, owner = shingles(Words(*text_bytes(batch.column(1))), width)
            n = batch.num_rows
            size = np.bincount(owner, minlength=n)
            sums = []
            for salt in (1, 2):
                total = np.concatenate([[U(0)], np.cumsum(mix(keys + U(salt)), dtype=U)])
                ends = np.cumsum(size)
                sums.append((total[ends] - total[ends - size]).view(np.int64))
            table = band_keys(signatures(keys, owner, n, rows * bands), rows).view(np.int64)
            listed = pa.array([r if s else r[:0] for r, s in zip(table, size.tolist(), strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), *map(pa.array, sums), listed], [c.split()[0] for c in SKETCH.split(", ")])

    return texts(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(run, SKETCH)


def stars(classes: DataFrame) -> DataFrame:
    """``center`` and ``node`` of every bucket with more than one class; the centre is the member that meets most others."""
    entries = classes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    entries = settle(entries.join(shared, "key"))
    degree = entries.groupBy("node").agg(F.sum("n").alias("degree"))
    center = entries.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"))).alias("top"))
    return entries.join(center.select("key", (-F.col("top.least")).alias("center")), "key").where("node <> center").select("center", "node").distinct()


def differences(pairs: DataFrame, chosen: DataFrame, threshold: int, width: int = WIDTH) -> DataFrame:
    """For each star edge the tokens that only one side has, and f of both sides."""
    more, less = 100 + threshold, 100 - threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in steps(batches, "center_text", "text"):
            (a, own_a), (b, own_b) = (shingles(Words(*text_bytes(batch.column(k))), width) for k in (2, 3))
            n = batch.num_rows
            both = np.concatenate([a, b])
            owner = np.concatenate([own_a, own_b])
            order = np.lexsort((both, owner))
            both, owner = both[order], owner[order]
            twin = np.zeros(len(both), bool)
            same = (both[1:] == both[:-1]) & (owner[1:] == owner[:-1])
            twin[1:] |= same
            twin[:-1] |= same
            single, whose = both[~twin].view(np.int64), owner[~twin]
            size = np.bincount(whose, minlength=n)
            f = more * size - less * np.bincount(own_b, minlength=n)
            fc = -less * np.bincount(own_a, minlength=n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(single))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (f, fc, size)), tokens], [c.split()[0] for c in DIFFERENCE.split(", ")])

    of_center = chosen.select(F.col("doc_id").alias("center"), F.col("text").alias("center_text"))
    of_node = chosen.select(F.col("doc_id").alias("node"), "text")
    joined = pairs.join(of_node, "node").join(of_center, "center").select("center", "node", "center_text", "text")
    return joined.mapInArrow(run, DIFFERENCE)


def _needed(a: Column, b: Column, threshold: int) -> Column:
    """The least overlap of D that links two members, 1 at least."""
    return F.greatest(F.ceil((a + b) / F.lit(2.0 * (100 + threshold))), F.lit(1))


def hubs(edges: DataFrame) -> DataFrame:
    """For each node linked to a centre the ``hub``, that of its centres with most linked nodes (ties: the smallest id); a centre may be its own."""
    linked = edges.where("f + fc <= 0").select("center", "node")
    linked = linked.union(linked.select("center", "center").distinct())
    size = linked.groupBy("center").agg(F.count("*").alias("n"))
    best = linked.join(size, "center").groupBy("node").agg(F.max(F.struct("n", (-F.col("center")).alias("least"))).alias("top"))
    return best.select("node", (-F.col("top.least")).alias("hub"))


def candidates(edges: DataFrame, threshold: int) -> DataFrame:
    """``center, a, b``: members of a star, at least one not linked to its centre, that may be linked and have no hub in common."""
    open_ = F.col("f") + F.col("fc") > 0
    edges = edges.withColumn("open", open_).join(hubs(edges), "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    bounds = edges.groupBy("center").agg(F.min("f").alias("low"), F.min(F.when(open_, F.col("f"))).alias("low_open"), F.count("*").alias("members"))
    wanted = edges.join(bounds.where("low_open is not null and members > 1"), "center")
    # a closed member can only gain from an open one, an open one from any
    need = _needed(F.col("f"), F.when(F.col("open"), F.col("low")).otherwise(F.col("low_open")), threshold)
    wanted = wanted.withColumn("prefix", F.col("size") - need + 1).where("prefix > 0")
    tokens = wanted.select("center", "node", "hub", "f", "size", "open", "prefix", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("center", "token").agg(F.count("*").alias("n"), (F.min("hub") < F.max("hub")).alias("apart"))
    order = Window.partitionBy("center", "node").orderBy("n", "token")
    placed = tokens.join(counts.where("n > 1"), ["center", "token"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = placed.withColumn("at", F.row_number().over(order)).where("at <= prefix and apart")
    placed = settle(placed.select("center", "node", "hub", "f", "size", "open", "token", "at"))
    x, y = placed.where("open").alias("x"), placed.alias("y")
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + 1
    meet = (F.col("x.center") == F.col("y.center")) & (F.col("x.token") == F.col("y.token"))
    meet &= F.col("x.hub") != F.col("y.hub")
    meet &= (~F.col("y.open") | (F.col("x.node") < F.col("y.node"))) & (left >= _needed(F.col("x.f"), F.col("y.f"), threshold))
    return x.join(y, meet).select("x.center", F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def other_links(edges: DataFrame, threshold: int) -> DataFrame:
    """Links between members of a star of which at least one is not linked to the centre, but for those with the same hub."""
    found = candidates(edges, threshold)
    own = edges.select("center", "node", "f", "tokens")
    both = found.join(own.select("center", F.col("node").alias("a"), F.col("f").alias("fa"), F.col("tokens").alias("ta")), ["center", "a"])
    both = both.join(own.select("center", F.col("node").alias("b"), F.col("f").alias("fb"), F.col("tokens").alias("tb")), ["center", "b"])
    overlap = F.size(F.array_intersect("ta", "tb"))
    return both.where(F.col("fa") + F.col("fb") <= 2 * (100 + threshold) * overlap).select("a", "b")


def group(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: groups of documents whose shingle sets are alike by ``threshold`` percent.

    ``component_id`` is the smallest id reachable over links, ``kept`` says it is the row's own. Null and empty texts, and
    texts without words, have no shingles and stand alone. Rows that repeat an id count as one document. Rows without id are
    linked with nothing, have no component and are kept. Extra columns are not looked at.
    """
    sketches = settle(sketch(docs, threshold))
    known = sketches.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("bands").alias("bands"))
    classes = classes.select("n_shingles", "h1", "h2", F.col("least.doc_id").alias("node"), F.col("least.mark").alias("mark"), "bands")
    pairs = settle(stars(classes))
    nodes = pairs.select("node").union(pairs.select("center")).distinct()
    marks = classes.select("node", "mark").join(nodes, "node").select(F.col("node").alias("doc_id"), "mark").distinct()
    chosen = texts(docs).withColumn("mark", F.xxhash64("text")).join(marks, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "text")
    edges = settle(differences(pairs, settle(chosen), threshold))
    links = edges.where("f + fc <= 0").select(F.col("center").alias("a"), F.col("node").alias("b")).union(other_links(edges, threshold))
    # the same id with two sets: one document
    same = known.select("doc_id", "n_shingles", "h1", "h2").distinct().join(classes.drop("bands"), ["n_shingles", "h1", "h2"]).select("doc_id", "node")
    links = links.union(same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b"))
    found = components(links)
    rows = sketches.join(classes.select("n_shingles", "h1", "h2", "node"), ["n_shingles", "h1", "h2"], "left").join(found, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    rows = rows.select("doc_id", "n_shingles", own.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its group; of rows that repeat an id, one stays."""
    found = settle(group(docs, threshold))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"))
    gone = found.where("not kept").select(F.col("doc_id").alias("id")).distinct()
    again = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    left = rows.join(gone, "id", "left_anti")
    if not again.isEmpty():
        left = left.join(again, "id", "left_anti").unionByName(left.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return left.select("row.*")
