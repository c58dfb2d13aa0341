"""Privacy requests, retention, archives and audits."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.identity import hmac_sha256, seal, unseal
from footfall.functions.ip import V4, V6
from footfall.operators.admission import since
from footfall.schemas import METRICS

PURGE_TIMES = {"events": "created_at", "views": "viewed_at", "sessions": "started_at"}


def export_user(sessions: DataFrame, views: DataFrame, uris: DataFrame, user_id: int, pages: int | None = None) -> DataFrame:
    """A user's sessions, newest first, each with its URLs, or the first ``pages`` of them."""
    return export_sessions(sessions.filter(F.col("user_id") == user_id), views, uris, pages)


def export_sessions(sessions: DataFrame, views: DataFrame, uris: DataFrame, pages: int | None = None) -> DataFrame:
    """Session export rows for any set of sessions, with all their views unless ``pages`` limits them."""
    mine = sessions.select(F.col("id").alias("session_id"), "user_id", "started_at", "ended_at", "total_views", "duration")
    order = Window.partitionBy("session_id").orderBy("viewed_at", "id")
    first = (
        views.select("id", "session_id", "resource_uri_id", "viewed_at")
        .join(mine.select("session_id"), "session_id", "left_semi")
        .withColumn("_rank", F.row_number().over(order))
    )
    if pages is not None:
        first = first.filter(F.col("_rank") <= pages)
    named = first.join(uris.select(F.col("id").alias("resource_uri_id"), "uri"), "resource_uri_id")
    lists = named.groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "uri"))), lambda s: s["uri"]), ", ").alias("pages")
    )
    return (
        mine.join(lists, "session_id", "left")
        .select(
            "session_id", "user_id", "started_at",
            F.coalesce(F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Active")).alias("ended"),
            "total_views",
            F.coalesce("duration", F.lit(0)).alias("duration"),
            "pages",
        )
        .orderBy(F.desc("started_at"), "session_id")
    )


def erase_user(sessions: DataFrame, user_id: int) -> DataFrame:
    """The sessions table with every link to the user removed; the rows stay, so totals hold."""
    mine = F.coalesce(F.col("user_id") == user_id, F.lit(False))
    blank = {"user_id": F.lit(None), "visitor_id": F.lit(None), "ip_hash": F.lit(b"")}
    return sessions.withColumns(
        {c: F.when(mine, v.cast(sessions.schema[c].dataType)).otherwise(F.col(c)) for c, v in blank.items() if c in sessions.columns}
    )


def erased_count(sessions: DataFrame, user_id: int) -> DataFrame:
    return sessions.filter(F.col("user_id") == user_id).agg(F.count(F.lit(1)).alias("erased"))


def cutoff_day(days: int, as_of: str, least: int = 30) -> str:
    """First day that is kept. A retention below ``least`` days is refused rather than changed."""
    if days < least:
        raise ValueError(f"a retention of {days} days is below the least of {least}")
    return str(date.fromisoformat(as_of) - timedelta(days=days))


def purge(table: DataFrame, time: str, mode: str, days: int, as_of: str, least: int = 30) -> DataFrame:
    """Rows that stay. On a table partitioned by day the filter only reads the kept partitions."""
    if mode == "forever":
        return table
    kept = F.to_timestamp(F.lit(cutoff_day(days, as_of, least)))
    return since(table, time, kept)


def purge_all(tables: dict[str, DataFrame], mode: str, days: int, as_of: str, least: int = 30) -> dict[str, DataFrame]:
    """Facts cut at the same day; campaign parameters follow the sessions that stay."""
    out = {n: purge(tables[n], c, mode, days, as_of, least) for n, c in PURGE_TIMES.items() if n in tables}
    if "parameters" in tables and "sessions" in out:
        kept = out["sessions"].select(F.col("id").alias("session_id"))
        out["parameters"] = tables["parameters"].join(kept, "session_id", "left_semi")
    return out


def archive_month(totals: DataFrame, month: str) -> DataFrame:
    """The month's daily totals in date order, with the ``month`` they are filed under."""
    start = date.fromisoformat(f"{month}-01")
    end = (start + timedelta(days=31)).replace(day=1)
    rows = totals.filter((F.col("date") >= F.lit(str(start)).cast("date")) & (F.col("date") < F.lit(str(end)).cast("date")))
    return rows.select(F.lit(month).alias("month"), "date", *METRICS).orderBy("date")


def write_archive(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def seal_archive(rows: DataFrame, key: bytes) -> DataFrame:
    """(month, ciphertext, hmac): the month's rows as one sealed JSON text (31 rows at most)."""
    item = F.struct("date", *METRICS)
    payload = rows.groupBy("month").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("_payload"))
    sealed = payload.select("month", seal(F.col("_payload"), key).alias("ciphertext"))
    return sealed.withColumn("hmac", hmac_sha256(F.col("ciphertext"), key))


def open_archive(sealed: DataFrame, key: bytes) -> DataFrame:
    """Rows of archives whose HMAC holds."""
    valid = sealed.filter(hmac_sha256(F.col("ciphertext"), key) == F.col("hmac"))
    item = "array<struct<date:date," + ",".join(f"{m}:bigint" for m in METRICS) + ">>"
    return valid.select("month", F.explode(F.from_json(unseal(F.col("ciphertext"), key), item)).alias("_r")).select("month", "_r.*")


def audit_raw_ips(df: DataFrame) -> DataFrame:
    """How many values of each text column are an IP address."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, raw_ips long")
    looks = lambda c: F.col(c).rlike(f"^{V4}$") | (F.col(c).contains(":") & F.col(c).rlike(f"^{V6}$"))
    counts = df.agg(*[F.sum(F.when(looks(c), 1).otherwise(0)).cast("long").alias(c) for c in texts])
    return counts.unpivot([], texts, "column_name", "raw_ips").withColumn("raw_ips", F.coalesce("raw_ips", F.lit(0)))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def freshness(views: DataFrame) -> DataFrame:
    """Time of the newest view, and whether there is one."""
    return views.agg(F.max("viewed_at").alias("latest_viewed_at")).withColumn("ok", F.col("latest_viewed_at").isNotNull())
