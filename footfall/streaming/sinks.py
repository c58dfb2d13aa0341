"""Streaming sinks: keep daily totals, or the whole star and its rollups, up to date from micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators import rollups, sessionize
from footfall.plans import ingest
from footfall.sources.tables import write_rollup

Lookups = Callable[[SparkSession], tuple[DataFrame, DataFrame]]
HIT_COLUMNS = ["view_id", "visitor_id", "viewed_at", "duration"]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None  # nothing written yet


def rollup_batches(path: str):
    """A ``foreachBatch`` function that stores hits and refreshes the totals of the days they touch.

    A replayed batch overwrites its own files, and days are replaced as a whole, so a retry changes
    nothing. Session starts of the day before the refreshed ones are kept and seed them, so a chain
    of sessions is never cut at midnight.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*HIT_COLUMNS).withColumn("day", F.to_date("viewed_at"))
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch", "day").parquet(f"{path}/hits")
        touched = spark.read.parquet(f"{path}/hits").filter(F.col("batch") == batch_id).agg(F.min("day")).first()[0]
        if touched is None:
            return
        # a hit after midnight can still change yesterday's session, hence one day back
        first = touched - timedelta(days=1)
        refresh_totals(spark, path, first)

    return process


def refresh_totals(spark: SparkSession, path: str, first: date) -> None:
    """Recompute sessions and totals from ``first`` on and replace those days."""
    hits = spark.read.parquet(f"{path}/hits").filter(F.col("day") >= F.lit(first)).select(*HIT_COLUMNS)
    seeds = _read(spark, f"{path}/starts")
    seen = hits.select("visitor_id", "viewed_at")
    if seeds is not None:
        before = seeds.filter(F.col("date") == F.lit(first - timedelta(days=1)))
        seen = seen.unionByName(before.select("visitor_id", F.col("started_at").alias("viewed_at")))
    starts = sessionize.session_starts(seen)
    joined = hits.withColumn("_second", sessionize.to_second("viewed_at")).join(starts, ["visitor_id", "_second"])
    views = joined.withColumn("session_id", F.xxhash64("visitor_id", "started_at"))
    per_session = views.groupBy("session_id", "visitor_id", "started_at").agg(F.count(F.lit(1)).alias("total_views"))
    sessions = per_session.filter(F.col("started_at") >= F.lit(first).cast("timestamp")).withColumnRenamed("session_id", "id")
    write_rollup(rollups.rollup_totals(views, sessions), f"{path}/totals")
    write_rollup(sessions.select("visitor_id", "started_at", F.to_date("started_at").alias("date")), f"{path}/starts")


def star_batches(path: str, rules: ingest.Rules, lookups: Lookups, extra: Sequence[ingest.Step | ingest.Stage] = ()):
    """A ``foreachBatch`` function that takes requests through the ingest job into the star and its rollups below ``path``.

    ``lookups`` gives salts and address ranges as they are when a batch begins. ``path/batches`` is the manifest: a batch enters it
    when all its tables are written, and is skipped from then on. One that broke off is run again and gives the same rows, as facts
    are replaced by day and dimensions added by key. Hits that are older than a stored view of their visitor are kept in
    ``path/late``, by batch, and counted in the manifest, since they would change sessions that were already reported;
    ``ingest`` over all requests has them in their place. The rate limit counts inside a batch.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{path}/batches/batch={batch_id}"
        if _read(spark, entry) is not None:
            return
        late = 0
        if _read(spark, f"{path}/batches") is None:
            if not ingest.ingest(batch, path, rules, *lookups(spark), extra):
                return  # no star to add to yet
        else:
            ingest.load_more(batch, path, rules, *lookups(spark), extra, late=f"{path}/late/batch={batch_id}")
            late = spark.read.parquet(f"{path}/late/batch={batch_id}").count()
        spark.range(1).select(F.lit(late).cast("long").alias("late")).write.mode("overwrite").parquet(entry)

    return process
