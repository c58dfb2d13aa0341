"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the id and the text; other columns, whatever their names, stay behind. A null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True for rows that no model may learn from; a row without id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == rest, F.lit(False))


def tokenizer_file(name: str) -> str:
    """Where the given file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A local session without one gets a temporary folder,
    since all its tasks run on this machine; on a cluster the setting is needed."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="footfall-")
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder, from which any executor can read them again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def label_table(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled id; rows without id or label are left out, several labels of an id go by majority, ties by 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, rest: int, most: int) -> DataFrame:
    """Texts and labels of at most ``most`` labelled rows that are not held out, the first by a hash of the id.

    The ids of the sample are bounded by ``most``, so they may be broadcast to the scan of the texts.
    """
    known = label_table(labels, column).where(~held_out(F.col("doc_id"), modulus, rest))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(chosen), "doc_id")
