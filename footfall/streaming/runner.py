"""Run a stream over what is there now and read the result back from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall import session
from footfall.plans import ingest
from footfall.streaming import sinks

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream of one Parquet table in a folder that holds several."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def with_end(stream: DataFrame, ts: str = "ts", **values: str) -> DataFrame:
    """A finite stream with a row after its end.

    The row is dated far ahead and NULL elsewhere but for ``values`` (a join drops NULL keys before they count), so the watermark passes all real rows and everything they open is emitted; the row's
    own windows and timers stay open. It is not for outputs that emit rows at once. A stream that goes on needs no such row.
    """
    spark = stream.sparkSession
    path = session.new_path(spark, "end")
    end = {ts: F.lit("2900-01-01").cast("timestamp"), **{c: F.lit(v) for c, v in values.items()}}
    spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run(stream: DataFrame, label: str) -> DataFrame:
    """Append-mode run to the end of the input; the sink is a Parquet folder, not the driver."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    path = session.new_path(spark, f"stream-{label}")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_totals(hits: DataFrame) -> DataFrame:
    """Feed hits to the totals sink and read its table."""
    spark = hits.sparkSession
    path = session.new_path(spark, "stream-totals")
    query = (
        hits.writeStream.foreachBatch(sinks.rollup_batches(path))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/totals").withColumn("date", F.col("date").cast("date"))


def run_star(requests: DataFrame, path: str, rules: ingest.Rules, lookups: sinks.Lookups) -> None:
    """Feed the requests that have arrived since the last run to the star below ``path``."""
    query = (
        requests.writeStream.foreachBatch(sinks.star_batches(path, rules, lookups))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
