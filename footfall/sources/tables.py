"""Table writers: idempotent rollups, the star schema, exports."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.schemas import TABLES

# facts and the time column whose day is the partition
FACT_TIMES = {"sessions": "started_at", "views": "viewed_at", "events": "created_at"}
# fact rows of one session lie together in their files, so session grouping combines on the map side
FACT_ORDER = {"sessions": "id", "views": "session_id", "events": "event_name"}


def write_rollup(df: DataFrame, path: str) -> None:
    """Replace the days present in ``df`` and leave all others alone.

    ``rebalance`` gathers a day into few files but splits a day that is too large for one task.
    """
    (
        df.hint("rebalance", F.col("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path).select(*TABLES[table].names)


def _write_table(name: str, df: DataFrame, path: str) -> None:
    target = f"{path.rstrip('/')}/{name}"
    if name in FACT_TIMES:
        dated = df.withColumn("day", F.to_date(FACT_TIMES[name])).hint("rebalance", F.col("day"))
        dated.sortWithinPartitions("day", FACT_ORDER[name]).write.mode("overwrite").partitionBy("day").parquet(target)
    else:
        df.hint("rebalance").write.mode("overwrite").parquet(target)


def replace_days(name: str, df: DataFrame, path: str) -> None:
    """Replace the days of a stored fact that are present in ``df``, which must not read from there, and leave all others alone."""
    dated = df.withColumn("day", F.to_date(FACT_TIMES[name])).hint("rebalance", F.col("day")).sortWithinPartitions("day", FACT_ORDER[name])
    target = f"{path.rstrip('/')}/{name}"
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)


def write_star(tables: dict[str, DataFrame], path: str, at_once: int = 4) -> None:
    """Persist every table; facts are partitioned by day and sorted by session inside it.

    The tables are independent jobs, so a few are submitted together and fill each other's gaps.
    """
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        list(pool.map(lambda item: _write_table(*item, path), tables.items()))


def read_star(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a star; a day filter on the time column of a fact also prunes its partitions."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        out[name] = df.drop("day") if name not in FACT_TIMES else df
    return out


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a fact as a catalog table bucketed by ``key``: joins on the key then need no exchange."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def export_csv(df: DataFrame, columns: dict[str, str], path: str) -> bool:
    """Write ``{column: label}`` as CSV with a header; NULL becomes empty. False when there are no rows.

    Report rows come sorted, so the row order is kept; a large export stays in many part files.
    """
    picked = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(label) for c, label in columns.items()])
    if picked.isEmpty():
        return False
    picked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return True


def csv_name(screen: str, first: str, last: str) -> str:
    return f"{screen}-{first}-{last}.csv"
