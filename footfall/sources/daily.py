"""Daily counters from files and from other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, visitors, sessions, views) rows of an import file, in file order by ``line``.

    Header names are trimmed and lower-cased; a missing name falls back to the first, third and
    fourth column. Rows without date or visitors are skipped, negative numbers lose their sign.
    """
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    clean = [c.strip().lower() for c in raw.columns]
    rows = raw.toDF(*[f"c{i}" for i in range(len(clean))])

    def pick(name: str, fallback: int) -> Column:
        at = clean.index(name) if name in clean else fallback
        return F.col(f"c{at}") if at < len(clean) else F.lit(None).cast("string")

    number = lambda c: F.coalesce(F.abs(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")), F.lit(0))
    visitors = number(pick("visitors", 2))
    return (
        rows.select(
            pick("date", 0).alias("_date"),
            visitors.alias("visitors"),
            visitors.alias("sessions"),
            number(pick("views", 3)).alias("views"),
            F.monotonically_increasing_id().alias("line"),
        )
        .filter(F.col("_date").isNotNull() & ~F.col("_date").isin("", "0") & (F.col("visitors") > 0))
        .select(F.col("_date").try_cast("date").alias("date"), "visitors", "sessions", "views", "line")
    )


def read_foreign_daily(counters: DataFrame) -> DataFrame:
    """Another tool's ``(last_counter, visit)`` table as an import: its visits count as views."""
    return counters.select(F.to_date("last_counter").alias("date"), F.col("visit").cast("long").alias("views"))


def merge_add(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    add: Sequence[str],
    first_only: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """Additive upsert: ``add`` columns grow by the incoming sums.

    ``first_only`` columns are set when a key is new, from its first incoming row by ``order``, and
    stay as they are afterwards. Other columns of the target are kept, or 0 for new keys.
    """
    sums = [F.sum(c).alias(f"_{c}") for c in add]
    firsts = [F.min_by(c, order).alias(f"_{c}") for c in first_only] if order else []
    grown = incoming.groupBy(*keys).agg(*sums, *firsts)
    joined = target.withColumn("_old", F.lit(True)).join(grown, list(keys), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in add:
            out.append((zero(F.col(c)) + zero(F.col(f"_{c}"))).alias(c))
        elif c in first_only:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(zero(F.col(f"_{c}"))).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.lit(0)).alias(c))
    return joined.select(*out)


def import_csv(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """Add an import file to the daily totals."""
    return merge_add(totals, rows, ["date"], ["visitors", "views"], ["sessions"], "line")


def import_foreign(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """Add another tool's views; a new day also starts with as many visitors and sessions."""
    full = rows.withColumns({"visitors": F.col("views"), "sessions": F.col("views")})
    return merge_add(totals, full, ["date"], ["views"], ["visitors", "sessions"], "views")
