"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a random, repeatable order, and their words cut into blocks of equal length. The mix is a
list of slots: slot i maps the golden-ratio point frac(i * phi) through the sources' cumulative weights, so every source comes
up as evenly as can be. The r-th slot of a source takes its r-th block, starting over once all are taken; the last block is
taken as far as the target goes.

Positions and ranks are running sums. They are built in two steps, sums of small parts first and rows inside a part after, so
a source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import WORD, partitions, settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK = 512
CHUNK = 1 << 16
LOW_BITS = 1 << 20
GOLDEN = Fraction(6180339887498948482045868343656, 10**31)
SEED = 20_240_613


def sized(docs: DataFrame) -> DataFrame:
    """One small row for each document: a key (rows that are equal have the same), which of the equal rows it is, source, words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_key().alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")))


def row_key() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("source"), F.coalesce(F.col("text"), F.lit("")))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number by code point, null last. Numbers come from sorted partitions, not from one task."""
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").isNull(), F.col("source")).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return spark.createDataFrame(ordered, "source string, source_size long, number long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """``target`` of each source: its weight's part of ``share`` of all words, at most ``repeats`` times its size.

    What a full source can't take goes to the others by weight: target = least(repeats * size, level * weight), where the level is
    raised until nothing is left. Each round is one sum over the sources and fixes at least one more of them.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats))
    total = out.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, full = 0.0, -1
    while True:
        at_most = F.col("most") <= F.lit(level) * F.col("weight")
        row = out.agg(
            F.sum(F.when(at_most, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(at_most, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(at_most, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (share * total - row["taken"]) / row["open"]
    return out.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight")))


def positions(rows: DataFrame) -> DataFrame:
    """``start``: how many words of its source stand ahead of each document in the shuffled order."""
    parts = max(64, 1 << (4 * partitions(rows.sparkSession)).bit_length())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(parts)))
    sums = rows.groupBy("number", "part").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("number").orderBy("part")) - F.col("words")
    inside = F.sum("size").over(Window.partitionBy("number", "part").orderBy("key", "nth")) - F.col("size")
    return rows.withColumn("inside", inside).join(sums.select("number", "part", ahead.alias("ahead")), ["number", "part"]).withColumn("start", F.col("ahead") + F.col("inside"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: ``slot`` (place in the mix), ``number`` (source), ``block`` of the source, ``words`` taken from its start."""
    spark = sources.sparkSession
    whole = F.round("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block)
    rest = F.col("goal") % F.greatest("source_size", F.lit(1))
    plan = sources.withColumn("goal", whole).withColumn("blocks", blocks)
    plan = plan.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / block)).otherwise(0))
    plan = settle(plan.select("number", "source_size", "goal", "blocks", "slots"))
    row = plan.agg(F.sum("slots").alias("n"), F.count("*").alias("sources")).first()
    n = row["n"] or 0
    # cumulative weights, cut at the borders of equal cells, so that point and source meet by an equal cell number
    cells = max(4096, 2 * row["sources"])
    upto = F.sum("slots").over(Window.orderBy("number")) / F.lit(float(max(n, 1)))
    spans = plan.where("slots > 0").withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("slots") / F.lit(float(max(n, 1))))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") * cells), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)))))
    # some points more than slots, since a source may get a little more than its part; what it gets too much is left out
    points = spark.range(n + n // 50 + 16)
    low, high = F.col("id") % LOW_BITS, F.floor(F.col("id") / LOW_BITS)
    step, leap = float(GOLDEN), float(GOLDEN * LOW_BITS % 1)
    u = low * step + high * leap
    points = points.withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * cells)).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    drawn = points.join(spans.select("number", "cell", "since", "upto"), "cell").where("u >= since and u < upto").select("id", "chunk", "number")
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    ahead = counts.select("number", "chunk", (F.sum("n").over(Window.partitionBy("number").orderBy("chunk")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("id")) - 1
    ranked = drawn.withColumn("inside", inside).join(ahead, ["number", "chunk"]).select(F.col("id").alias("slot"), "number", (F.col("ahead") + F.col("inside")).alias("rank"))
    got = counts.groupBy("number").agg(F.sum("n").alias("got"))
    short = plan.join(got, "number", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    closing = short.select((F.lit(n + n // 50 + 16)).cast("long").alias("slot"), "number", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    slots = ranked.unionByName(closing).join(plan, "number").where("rank < slots")
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks"))
    past = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("block") * block
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("goal") - past)
    return slots.select("slot", "number", "block", words.alias("words")).where("words > 0")


def plan(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size, source_size, target, taken``, with the row's ``key`` and ``nth``.

    Null texts have no words; a null source is a source. Documents without words are never taken. Equal rows are told apart by
    ``nth`` and taken each on its own. An empty table gives an empty plan.
    """
    rows = settle(sized(docs))
    sources = settle(targets(numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")))))
    rows = rows.join(sources.select("source", "number"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = settle(positions(rows).select("doc_id", "key", "nth", "number", "size", "start"))
    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    since = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    upto = F.least(end - F.col("block") * block, F.lit(block))
    parts = parts.select("key", "nth", "number", "block", since.alias("since"), upto.alias("upto"))
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    slots = schedule(sources, block).join(sources.select("number", "source_size"), "number").withColumn("full", full)
    slots = slots.groupBy("number", "block").agg(
        F.count(F.when(F.col("words") == F.col("full"), 1)).alias("times"), F.coalesce(F.max(F.when(F.col("words") < F.col("full"), F.col("words"))), F.lit(0)).alias("piece")
    )
    words = F.col("times") * (F.col("upto") - F.col("since")) + F.greatest(F.least("upto", "piece") - F.col("since"), F.lit(0))
    taken = parts.join(slots, ["number", "block"]).groupBy("key", "nth").agg(F.sum(words).alias("taken"))
    out = placed.join(taken, ["key", "nth"], "left").join(sources.select("number", "source_size", "target"), "number")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "key", "nth")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them, in whole documents (rounded to the nearest)."""
    copies = plan(docs, block).where("size > 0").select("key", "nth", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key().alias("key"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    return rows.join(copies, ["key", "nth"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
