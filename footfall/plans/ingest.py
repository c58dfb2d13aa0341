"""From requests to the star schema: stages with declared columns, and a place for one's own among them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import fixed_values as fv
from footfall.operators import admission, enrich, intervals, rollups, sessionize, star
from footfall.sources import tables

Step = Callable[[DataFrame], DataFrame]
ADDRESSES = ("ip", "cf_connecting_ip", "x_forwarded_for", "x_real_ip", "remote_addr")
PLACE = tuple(enrich.GEO_COLUMNS)
DEVICE = ("device_type", "browser_name", "browser_version", "os_name")
TABLES = ["visitors", "sessions", "views", "resources", "resource_uris", "parameters", *star.DIMENSIONS]
SOURCE = ("utm", "channel", "source_name", "source_domain")


@dataclass(frozen=True)
class Stage:
    """A step of the job: columns it needs, columns that are there afterwards, columns that go no further."""

    name: str
    run: Step
    needs: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()
    drops: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    """What the site has set: hosts and key of its own pages, privacy, what is excluded, requests a minute and address."""

    site: str
    host: str
    secret: bytes
    privacy: dict | None = None
    bots: bool = False
    cidrs: Sequence[str] = ()
    roles: Sequence[str] = ()
    urls: Sequence[str] = ()
    rate_limit: int = fv.RATE_LIMIT


def compose(hits: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Run the stages in order. A stage that lacks a column, doesn't add what it says, loses or keeps one it shouldn't, is an error
    when the plan is built."""
    for stage in stages:
        lacking = [c for c in stage.needs if c not in hits.columns]
        if lacking:
            raise ValueError(f"{stage.name} needs {lacking}")
        out = stage.run(hits)
        wanted = [c for c in (*hits.columns, *stage.adds) if c not in stage.drops]
        wrong = [c for c in wanted if c not in out.columns] + [c for c in stage.drops if c in out.columns]
        if wrong:
            raise ValueError(f"{stage.name} must give or drop {wrong}")
        hits = out
    return hits


def _judged(hits: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Requests with the ``reason`` of the rules that look at one request, and ``view_id`` of those that then exceed the rate."""
    known = enrich.with_client_ip(hits)
    judged = admission.admit_hits(known, [rules.host], rules.secret, rules.privacy, rules.bots, rules.cidrs, rules.roles, rules.urls)
    judged = intervals.stored(judged, "judged")  # read by the rules that need other hits too, parsed once
    quotas = sessionize.rate_limit_quotas(judged.where("reason is null"), "ip", "ts", rules.rate_limit)
    # only seconds above their quota need an order among their hits
    tight = judged.where("reason is null").groupBy(F.xxhash64("ip").alias("_key"), F.unix_seconds(F.date_trunc("second", "ts")).alias("_sec"))
    over = tight.agg(F.count("*").alias("_n")).join(quotas, ["_key", "_sec"]).where("_n > _quota").select("_key", "_sec", "_quota")
    return judged, sessionize.beyond_quota(judged.where("reason is null"), over, "ip", "ts", "view_id").select("view_id")


def requests_judged(hits: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``reason``: why a request is turned away, NULL for admitted ones. The rate is counted over what the other rules let in."""
    judged, late = _judged(hits, rules)
    flagged = judged.join(late.withColumn("_late", F.lit(True)), "view_id", "left")
    return flagged.withColumns(
        {
            "reject_status": F.when(F.col("_late"), F.lit(429)).otherwise(F.col("reject_status")),
            "reason": F.when(F.col("_late"), F.lit("rate_limited")).otherwise(F.col("reason")),
        }
    ).drop("_late")


def stages(rules: Rules, salts: DataFrame, ranges: DataFrame, extra: Sequence[Step | Stage] = ()) -> list[Stage]:
    """The stages up to the visitor. ``extra`` ones run when place, device and source are known and the address still is; they may add
    columns or change values, and may drop none. Everything that holds an address is gone behind ``visitor``."""
    own = [e if isinstance(e, Stage) else Stage(getattr(e, "__name__", f"extra {k}"), e) for k, e in enumerate(extra)]
    return [
        Stage("salt", lambda h: enrich.with_salt(h, salts), ("ts",), ("salt", "previous_salt")),
        Stage("place", lambda h: enrich.geo_enrich(h, ranges), ("ip",), PLACE),
        Stage("device", enrich.with_device, ("user_agent",), DEVICE),
        Stage("source", lambda h: enrich.with_source(h, rules.host), ("referrer", "page_query"), SOURCE),
        Stage("uri", enrich.with_uri, ("page_url", "resource_type", "resource_id"), ("uri", "uri_hash")),
        *own,
        Stage("visitor", lambda h: enrich.with_visitor(h, rules.site), ("ip", "user_agent", "salt"), ("visitor_hash", "visitor_id"), (*ADDRESSES, "salt", "previous_salt")),
    ]


def keyed(open_sessions: DataFrame | None = None) -> list[Stage]:
    """The stages behind the visitor: sessions, continuing those of an earlier load, and keys of dimensions."""
    return [
        Stage("session", lambda h: sessionize.sessionize_anchored(h, open_sessions=open_sessions), ("visitor_id", "viewed_at"), ("started_at", "session_id")),
        Stage("keys", star.resolve_fks, (*PLACE, *DEVICE, *SOURCE), tuple(star.FOREIGN_KEYS.values())),
    ]


def visits(hits: DataFrame, rules: Rules, salts: DataFrame, ranges: DataFrame, extra: Sequence[Step | Stage] = ()) -> DataFrame:
    """Admitted requests with visitor, place, device and source, and no address."""
    judged, late = _judged(hits, rules)
    # what another rule turned away needs no look at the rate: it doesn't move
    admitted = judged.where("reason is null").drop("reason", "reject_status", "reject_code").join(late, "view_id", "left_anti")
    return compose(admitted, stages(rules, salts, ranges, extra))


def pipeline(hits: DataFrame, rules: Rules, salts: DataFrame, ranges: DataFrame, extra: Sequence[Step | Stage] = ()) -> DataFrame:
    """Admitted requests with all that the star is made of. Hits before the first salt have no visitor and are left out
    (``without_salt`` has them)."""
    return compose(visits(hits, rules, salts, ranges, extra), keyed())


def without_salt(hits: DataFrame, salts: DataFrame, ts: str = "ts") -> DataFrame:
    """Hits from before the first salt, whose visitor can't be told."""
    first = salts.agg(F.min("valid_from")).first()[0]
    return hits if first is None else hits.where(F.col(ts).isNull() | (F.col(ts) < F.lit(first)))


def star_tables(hits: DataFrame) -> dict[str, DataFrame]:
    """The tables of the star from the pipeline's hits."""
    return {
        "visitors": star.build_visitors(hits), "sessions": star.build_sessions(hits), "views": star.build_views(hits),
        "resources": star.build_resources(hits), "resource_uris": star.build_resource_uris(hits), "parameters": star.utm_parameters(hits),
        **{name: star.dimension(hits, name) for name in star.DIMENSIONS},
    }


def ingest(hits: DataFrame, path: str, rules: Rules, salts: DataFrame, ranges: DataFrame, extra: Sequence[Step | Stage] = ()) -> dict[str, DataFrame]:
    """The whole job: requests to stored hits, star and daily rollups below ``path``. Each step reads the one before from files.
    Without an admitted hit there is no star yet, and no tables are returned."""
    spark = hits.sparkSession
    pipeline(hits, rules, salts, ranges, extra).write.mode("overwrite").parquet(f"{path}/hits")
    if spark.read.parquet(f"{path}/hits").isEmpty():
        return {}
    made = star_tables(spark.read.parquet(f"{path}/hits"))
    tables.write_star(made, path)
    out = tables.read_star(spark, path, list(made))
    tables.write_rollup(rollups.rollup_pages(out["views"], out["sessions"]), f"{path}/summary")
    tables.write_rollup(rollups.rollup_totals(out["views"], out["sessions"]), f"{path}/summary_totals")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored star and its rollups."""
    out = tables.read_star(spark, path, TABLES)
    return out | {name: tables.read_rollup(spark, f"{path}/{name}", name) for name in ("summary", "summary_totals")}


def load_more(
    hits: DataFrame, path: str, rules: Rules, salts: DataFrame, ranges: DataFrame, extra: Sequence[Step | Stage] = (), late: str | None = None
) -> dict[str, DataFrame]:
    """Add requests to the star below ``path``. Loads come in the order of time: no hit is older than its visitor's stored ones.
    With ``late`` such hits are written to that folder, replacing what it holds; without, they are the caller's to keep out.

    Sessions that were open go on. Only days that the load touches are read and written again, as wholes; rows of dimensions and
    visitors are added where their key is absent. So the same load twice changes nothing.
    """
    spark = hits.sparkSession
    fresh = intervals.stored(visits(hits, rules, salts, ranges, extra), "load")
    old = read(spark, path)
    if late is not None:
        behind = intervals.stored(out_of_turn(fresh, old), "load-late")
        behind.write.mode("overwrite").parquet(late)
        fresh = fresh.join(behind.select("view_id"), "view_id", "left_anti")
    first = fresh.agg(F.min("viewed_at")).first()[0]
    if first is None:
        return old
    still = admission.since(old["sessions"], "started_at", session_before(first))
    hits = intervals.stored(compose(fresh, keyed(still.select("visitor_id", "started_at"))), "load-hits")
    made = star_tables(hits)
    touched = sorted(r["day"] for r in made["sessions"].select(F.to_date("started_at").alias("day")).union(hits.select(F.to_date("viewed_at"))).distinct().collect())
    stored_days = lambda name, days: old[name].where(F.col("day").isin(days))

    views = stored_days("views", touched).drop("day").join(made["views"].select("id"), "id", "left_anti").unionByName(made["views"])
    views = intervals.stored(views, "load-views")
    started = stored_days("sessions", touched).drop("day")
    sessions = intervals.stored(merged_sessions(started, made["sessions"], views), "load-sessions")
    for name, df in (("views", views), ("sessions", sessions)):
        tables.replace_days(name, df, path)
    for name in TABLES:
        if name not in tables.FACT_TIMES:
            absent = made[name].join(old[name].select("id"), "id", "left_anti").select(*old[name].columns)
            absent = intervals.stored(absent, f"load-{name}")
            if not absent.isEmpty():  # most loads bring no new countries or browsers: no file for nothing
                absent.write.mode("append").parquet(f"{path}/{name}")
    now = tables.read_star(spark, path, ["views", "sessions"])
    days = now["views"].where(F.col("day").isin(touched))
    # a view's session began on its day or the one before
    near = now["sessions"].where(F.col("day").isin(sorted({*touched, *(d - timedelta(days=1) for d in touched)})))
    tables.write_rollup(rollups.rollup_pages(days, near), f"{path}/summary")
    tables.write_rollup(rollups.rollup_totals(days, now["sessions"].where(F.col("day").isin(touched))), f"{path}/summary_totals")
    return read(spark, path)


def session_before(at: datetime) -> Column:
    """The earliest start of a session that a hit at this time can belong to."""
    return F.lit(at) - F.expr(f"INTERVAL {fv.SESSION_SECONDS} SECONDS")


def out_of_turn(fresh: DataFrame, old: dict[str, DataFrame]) -> DataFrame:
    """Hits that are older than a stored view of their visitor. Views of the load itself, stored when it was tried before, don't count."""
    first = fresh.agg(F.min("viewed_at")).first()[0]
    if first is None:
        return fresh
    views = admission.since(old["views"], "viewed_at", F.lit(first)).join(fresh.select(F.col("view_id").alias("id")), "id", "left_anti")
    owners = admission.since(old["sessions"], "started_at", session_before(first)).select(F.col("id").alias("session_id"), "visitor_id")
    newest = views.join(owners, "session_id").groupBy("visitor_id").agg(F.max("viewed_at").alias("_newest"))
    return fresh.join(newest, "visitor_id").where("viewed_at < _newest").drop("_newest")


def merged_sessions(stored: DataFrame, fresh: DataFrame, views: DataFrame) -> DataFrame:
    """Sessions of the touched days: a session that went on keeps its first view's values; counts and ends come from its views."""
    kept = stored.unionByName(fresh.join(stored.select("id"), "id", "left_anti"))
    order = F.struct("viewed_at", "id")
    ends = views.groupBy("session_id").agg(F.count("*").alias("_n"), F.max("viewed_at").alias("_end"), F.max_by("id", order).alias("_last"))
    joined = kept.join(ends, kept["id"] == ends["session_id"], "left").drop("session_id")
    return joined.withColumns(
        {
            "total_views": F.coalesce("_n", "total_views"),
            "ended_at": F.when(F.col("_n") > 1, F.col("_end")).otherwise(F.col("ended_at")),
            "last_view_id": F.coalesce("_last", "last_view_id"),
        }
    ).select(*stored.columns)
