"""Readers of raw logs: one JSON object per line, with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.schemas import ENGAGEMENT_BODY, EVENT_BODY, GROUND_TRUTH, HIT_BODY, SERVER


def read_log(spark: SparkSession, path: str, body: T.StructType, streaming: bool = False) -> DataFrame:
    """Lines ``{"body": "<raw request text>", <server columns>}`` as body and server columns.

    The raw ``body`` text stays, because admission checks its size and keys.
    """
    reader = spark.readStream if streaming else spark.read
    line = T.StructType([T.StructField("body", T.StringType()), *SERVER.fields])
    lines = reader.text(path).select(F.from_json("value", line).alias("_line"))
    request = lines.filter(F.col("_line").isNotNull()).select("_line.*")
    return parse_body(request, body)


def parse_body(request: DataFrame, body: T.StructType) -> DataFrame:
    """Adds the fields of the JSON text in ``body`` as columns."""
    return request.withColumn("_body", F.from_json("body", body)).select("*", "_body.*").drop("_body")


def read_hits(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return read_log(spark, path, HIT_BODY, streaming)


def read_engagements(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return read_log(spark, path, ENGAGEMENT_BODY, streaming)


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return read_log(spark, path, EVENT_BODY, streaming)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).parquet(path)
