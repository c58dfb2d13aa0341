"""Daily rollups: per page and per site."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.admission import date_range
from footfall.schemas import METRICS


def rollup_pages(views: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per (view day, page): distinct visitors and sessions, views, page time and bounces.

    Grouping happens at session grain first. The join has already placed rows by session, so that
    step needs no exchange, and both distinct counts become plain counts of coarser groups.
    """
    facts = views.select("session_id", "resource_uri_id", F.to_date("viewed_at").alias("date"), "duration")
    hub = sessions.select(F.col("id").alias("session_id"), "visitor_id", (F.col("total_views") == 1).alias("_single"))
    per_session = (
        facts.join(hub, "session_id")
        .groupBy("session_id", "date", "resource_uri_id", "visitor_id")
        .agg(
            F.count(F.lit(1)).alias("views"),
            F.sum("duration").alias("total_duration"),
            F.sum(F.when(F.col("_single"), 1).otherwise(0)).alias("bounces"),
        )
    )
    per_visitor = per_session.groupBy("date", "resource_uri_id", "visitor_id").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in ("views", "total_duration", "bounces")]
    )
    return per_visitor.groupBy("date", "resource_uri_id").agg(
        F.count("visitor_id").alias("visitors"),
        F.sum("sessions").alias("sessions"),
        F.sum("views").alias("views"),
        F.coalesce(F.sum("total_duration"), F.lit(0)).alias("total_duration"),
        F.sum("bounces").alias("bounces"),
    )


def rollup_totals(views: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session-start day: visitors, sessions, and the views made on that same day."""
    same_day = views.groupBy("session_id", F.to_date("viewed_at").alias("date")).agg(
        F.count(F.lit(1)).alias("_views"), F.sum("duration").alias("_duration")
    )
    hub = sessions.select(
        F.col("id").alias("session_id"), F.to_date("started_at").alias("date"), "visitor_id", "total_views"
    )
    rows = F.greatest(F.coalesce("_views", F.lit(0)), F.lit(1))  # an unmatched session still is one row
    return hub.join(same_day, ["session_id", "date"], "left").groupBy("date").agg(
        F.count_distinct("visitor_id").alias("visitors"),
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("_views"), F.lit(0)).alias("views"),
        F.coalesce(F.sum("_duration"), F.lit(0)).alias("total_duration"),
        F.sum(F.when(F.col("total_views") == 1, rows).otherwise(0)).alias("bounces"),
    )


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day; no rows when the range is empty."""
    days = (date.fromisoformat(last) - date.fromisoformat(first)).days + 1
    return spark.range(max(days, 0)).select(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias("date"))


def rollup_range(views: DataFrame, sessions: DataFrame, first: str, last: str) -> DataFrame:
    """Site totals for every day of the range, empty days included, in one grouped pass."""
    totals = rollup_totals(date_range(views, "viewed_at", first, last), date_range(sessions, "started_at", first, last))
    days = calendar(views.sparkSession, first, last)
    return days.join(totals, "date", "left").select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in METRICS])


BACKFILL_DAYS = 30


def backfill_window(as_of: str, back: int = BACKFILL_DAYS) -> tuple[str, str]:
    day = date.fromisoformat(as_of)
    return str(day - timedelta(days=back)), str(day - timedelta(days=2))


def missing_days(totals: DataFrame, as_of: str, back: int = BACKFILL_DAYS) -> DataFrame:
    """Days from ``back`` to 2 days before ``as_of`` that have no totals row."""
    first, last = backfill_window(as_of, back)
    return calendar(totals.sparkSession, first, last).join(totals.select("date").distinct(), "date", "left_anti")


def refresh_days(totals: DataFrame, as_of: str, back: int = BACKFILL_DAYS) -> DataFrame:
    yesterday = str(date.fromisoformat(as_of) - timedelta(days=1))
    return missing_days(totals, as_of, back).unionByName(calendar(totals.sparkSession, yesterday, yesterday))


def refresh(
    views: DataFrame, sessions: DataFrame, totals: DataFrame, as_of: str, back: int = BACKFILL_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(summary, summary_totals) rows of yesterday and the missing days of the last ``back``.

    At most ``back`` days are wanted, so the day set is broadcast onto facts already cut to the window.
    """
    first, _ = backfill_window(as_of, back)
    last = str(date.fromisoformat(as_of) - timedelta(days=1))
    days = F.broadcast(refresh_days(totals, as_of, back))
    recent_views = date_range(views, "viewed_at", first, last)
    on_day = lambda df, ts: df.join(days, F.to_date(ts) == days["date"], "left_semi")
    # a view's session may have started the day before
    before = str(date.fromisoformat(first) - timedelta(days=1))
    summary = rollup_pages(on_day(recent_views, "viewed_at"), date_range(sessions, "started_at", before, last))
    found = rollup_totals(recent_views, on_day(date_range(sessions, "started_at", first, last), "started_at"))
    full = days.join(found, "date", "left").select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in METRICS])
    return summary, full
