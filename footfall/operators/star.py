"""From enriched hits to the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.identity import key_id
from footfall.functions.text import blank, clean_event_name, with_clean_props

# dimension: (key columns of a hit, other columns of a hit, target names in the same order)
DIMENSIONS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "countries": (["country_code"], ["country_name", "continent_code", "continent"], ["code", "name", "continent_code", "continent"]),
    "cities": (["country_id", "city_name"], ["region_code"], ["country_id", "city_name", "region_code"]),
    "device_types": (["device_type"], [], ["name"]),
    "device_browsers": (["browser_name"], [], ["name"]),
    "device_browser_versions": (["device_browser_id", "browser_version"], [], ["browser_id", "version"]),
    "device_oss": (["os_name"], [], ["name"]),
    "resolutions": (["screen_width", "screen_height"], [], ["width", "height"]),
    "languages": (["language"], [], ["code"]),
    "timezones": (["timezone"], [], ["name"]),
    "referrers": (["channel", "source_domain"], ["source_name"], ["channel", "domain", "name"]),
}

FOREIGN_KEYS = {
    "countries": "country_id",
    "cities": "city_id",
    "device_types": "device_type_id",
    "device_browsers": "device_browser_id",
    "device_browser_versions": "device_browser_version_id",
    "device_oss": "device_os_id",
    "resolutions": "resolution_id",
    "languages": "language_id",
    "timezones": "timezone_id",
    "referrers": "referrer_id",
}


def _present(keys: Sequence[str]) -> Column:
    """A dimension row exists only if every key is there (a referrer's domain may be '')."""
    tests = [~blank(F.col(k).cast("string")) for k in keys if k != "source_domain"]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def resolve_fks(hits: DataFrame) -> DataFrame:
    """Adds the ten dimension ids as hashes of the natural keys: no join, no sequence.

    A missing key gives NULL. Countries and browsers come first, as cities and versions build on them.
    """
    first = {}
    second = {}
    for name, (keys, _, _) in DIMENSIONS.items():
        made = F.when(_present(keys), key_id(*[F.coalesce(F.col(k), F.lit("")) if k == "source_domain" else F.col(k) for k in keys]))
        (second if name in ("cities", "device_browser_versions") else first)[FOREIGN_KEYS[name]] = made
    return hits.withColumns(first).withColumns(second)


def dimension(hits: DataFrame, name: str, order: Sequence[str] = ("viewed_at", "view_id")) -> DataFrame:
    """Rows of one dimension found in ``hits``; the earliest hit decides the non-key columns."""
    keys, others, targets = DIMENSIONS[name]
    rows = hits.filter(F.col(FOREIGN_KEYS[name]).isNotNull())
    ident = F.col(FOREIGN_KEYS[name]).alias("id")
    key_columns = [F.col(k).alias(t) for k, t in zip(keys, targets)]
    if not others:
        return rows.select(ident, *key_columns).distinct()
    kept = F.min_by(F.struct(*others), F.struct(*order)).alias("_other")
    grouped = rows.groupBy(ident, *key_columns).agg(kept)
    return grouped.select(
        "id", *targets[: len(keys)], *[F.col(f"_other.{o}").alias(t) for o, t in zip(others, targets[len(keys):])]
    )


def upsert_dim(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-if-absent: ``existing`` plus the incoming rows whose key it lacks.

    Keys compare as empty-safe equality; incoming rows with an empty key are dropped.
    """
    fresh = incoming.filter(_present(keys)).dropDuplicates(list(keys))
    absent = fresh.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(absent, allowMissingColumns=True)


def build_visitors(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("visitor_id").isNotNull()).groupBy(
        F.col("visitor_id").alias("id"), F.col("visitor_hash").alias("hash")
    ).agg(F.min("viewed_at").alias("created_at"))


def upsert_visitors(existing: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per visitor hash; a known visitor keeps its first time."""
    found = build_visitors(hits)
    return existing.unionByName(found.join(existing.select("hash"), ["hash"], "left_anti"))


_SESSION_DIMS = list(FOREIGN_KEYS.values())


def build_sessions(hits: DataFrame) -> DataFrame:
    """One row per session: ids of the first hit, number of hits, last hit and both end views.

    A single-hit session has no end. ``duration`` is never written; page time lives in the views.
    """
    order = F.struct("viewed_at", "view_id")
    firsts = [*_SESSION_DIMS, "user_id", "visitor_hash", "view_id"]
    grouped = hits.groupBy(F.col("session_id").alias("id"), "visitor_id", "started_at").agg(
        F.min_by(F.struct(*firsts), order).alias("_first"),
        F.max_by("view_id", order).alias("last_view_id"),
        F.count(F.lit(1)).alias("total_views"),
        F.max("viewed_at").alias("_last"),
    )
    return grouped.select(
        "id",
        "visitor_id",
        F.col("_first.visitor_hash").alias("ip_hash"),
        *[F.col(f"_first.{c}").alias(c) for c in _SESSION_DIMS],
        F.col("_first.view_id").alias("initial_view_id"),
        "last_view_id",
        "total_views",
        F.col("_first.user_id").alias("user_id"),
        "started_at",
        F.when(F.col("total_views") > 1, F.col("_last")).alias("ended_at"),
        F.lit(None).cast("long").alias("duration"),
    )


def build_views(hits: DataFrame) -> DataFrame:
    """View rows of sessionized hits; time and depth are filled by engagement beacons."""
    has = lambda c, t: F.col(c).cast(t) if c in hits.columns else F.lit(None).cast(t)
    return hits.select(
        F.col("view_id").alias("id"),
        "session_id",
        key_id(F.col("uri")).alias("resource_uri_id"),
        resource_key(F.col("resource_type"), F.col("resource_id")).alias("resource_id"),
        "viewed_at",
        F.lit(None).cast("long").alias("next_view_id"),
        has("duration", "long").alias("duration"),
        has("scroll_depth", "int").alias("scroll_depth"),
        F.substring(F.col("pvid"), 1, 16).alias("pvid"),
    )


def resource_key(resource_type: Column, resource_id: Column) -> Column:
    return F.when(resource_id > 0, key_id(resource_type, resource_id))


def view_paths(views: DataFrame) -> DataFrame:
    """Fills ``next_view_id``: the next view of the same session in time order."""
    order = Window.partitionBy("session_id").orderBy("viewed_at", "id")
    return views.withColumn("next_view_id", F.lead("id").over(order))


def build_resources(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("resource_id") > 0).select(
        resource_key(F.col("resource_type"), F.col("resource_id")).alias("id"), "resource_type", "resource_id"
    ).distinct()


def build_resource_uris(hits: DataFrame) -> DataFrame:
    """One row per uri; the earliest hit decides which resource it belongs to."""
    return hits.groupBy("uri").agg(
        F.min_by(F.coalesce("resource_id", F.lit(0)), F.struct("viewed_at", "view_id")).alias("resource_id")
    ).select(
        key_id(F.col("uri")).alias("id"), "resource_id", "uri", F.crc32(F.col("uri").cast("binary")).alias("uri_hash")
    )


def utm_parameters(hits: DataFrame) -> DataFrame:
    """One row per campaign key of a view."""
    return hits.select(
        "session_id",
        key_id(F.col("uri")).alias("resource_uri_id"),
        "view_id",
        F.explode("utm").alias("param_key", "param_value"),
    ).withColumn("id", key_id(F.col("view_id"), F.col("param_key")))


def build_events(events: DataFrame) -> DataFrame:
    """Event rows: clean names and properties, zero ids to NULL; nameless events are dropped."""
    present = lambda c: F.when(F.col(c) != 0, F.col(c)) if c in events.columns else F.lit(None).cast("long")
    named = events.withColumn("event_name", clean_event_name(F.col("event_name")))
    cleaned = with_clean_props(named.filter(F.col("event_name").isNotNull()), "properties", "event_data")
    return cleaned.select(
        F.col("event_id").alias("id"),
        present("session_id").alias("session_id"),
        present("resource_uri_id").alias("resource_uri_id"),
        present("user_id").alias("user_id"),
        "event_name",
        "event_data",
        F.date_trunc("second", "ts").alias("created_at"),
    )


def attach_sessions(events: DataFrame, sessions: DataFrame, visitor: str = "visitor_id", ts: str = "ts") -> DataFrame:
    """As-of join on the session timeout: the visitor's session that started at most 30 minutes before.

    Starts of one visitor lie more than the timeout apart, so a half-hour slot holds at most one:
    looking in the event's slot and the one before makes this an equality join.
    """
    from footfall import fixed_values as fv

    width = fv.SESSION_SECONDS
    slot = lambda c: F.floor(F.unix_seconds(c) / width)
    spans = sessions.select(
        F.col("visitor_id").alias("_visitor"),
        F.col("id").alias("session_id"),
        F.col("started_at").alias("_from"),
        F.explode(F.array(slot(F.col("started_at")), slot(F.col("started_at")) + 1)).alias("_slot"),
    )
    at = F.date_trunc("second", F.col(ts))
    age = F.unix_seconds(at) - F.unix_seconds("_from")
    match = (F.col(visitor) == F.col("_visitor")) & (slot(at) == F.col("_slot")) & age.between(0, width)
    # sessions grow with the hits: they never go whole through the driver, however small their files make them look
    return events.drop("session_id").join(spans.hint("merge"), match, "left").drop("_visitor", "_from", "_slot")


def apply_engagement(views: DataFrame, beacons: DataFrame, resource_uris: DataFrame) -> DataFrame:
    """Set time and depth of views from valid beacons; a later beacon overwrites an earlier one.

    A beacon with a page-visit id (1 to 16 characters) reaches all views that carry it. Without one
    it reaches the newest view of its URL, else the newest view of its resource's first URL.
    """
    latest = lambda rows, *key: rows.groupBy(*key).agg(
        F.max(F.struct("ts", "engagement_time", "scroll_depth")).alias("_beacon")
    )
    by_pvid = (~blank(F.col("pvid"))) & (F.length("pvid") <= 16)
    by_url = ~by_pvid & ~blank(F.col("page_url"))
    tagged = beacons.withColumns(
        {"_pvid": F.coalesce(by_pvid, F.lit(False)), "pvid": F.coalesce("pvid", F.lit(""))}
    ).withColumn("_url", ~F.col("_pvid") & ~blank(F.col("page_url")))
    exact = latest(tagged.filter("_pvid"), "pvid")
    url_beacons = tagged.filter("_url").select(F.col("page_url").alias("uri"), "ts", "engagement_time", "scroll_depth")
    first_uri = resource_uris.groupBy("resource_id").agg(F.min("uri").alias("uri"))
    resource_beacons = tagged.filter("NOT _pvid AND NOT _url").join(first_uri, "resource_id").select(
        "uri", "ts", "engagement_time", "scroll_depth"
    )
    by_uri = latest(url_beacons.unionByName(resource_beacons), "uri").join(
        resource_uris.select(F.col("id").alias("resource_uri_id"), "uri"), "uri"
    ).select("resource_uri_id", "_beacon")
    # the newest view of each URL named by a beacon; only those URLs' views are grouped
    newest = (
        views.join(by_uri.select("resource_uri_id"), "resource_uri_id", "left_semi")
        .groupBy("resource_uri_id")
        .agg(F.max("id").alias("id"))
    )
    fallback = newest.join(by_uri, "resource_uri_id").select("id", F.col("_beacon").alias("_by_uri"))
    joined = views.join(exact.withColumnRenamed("_beacon", "_by_pvid"), "pvid", "left").join(fallback, "id", "left")
    # when both reach a view the later beacon stands
    won = F.greatest("_by_pvid", "_by_uri")
    return joined.withColumns(
        {
            "duration": F.coalesce(won["engagement_time"].cast("long"), F.col("duration")),
            "scroll_depth": F.coalesce(won["scroll_depth"].cast("int"), F.col("scroll_depth")),
        }
    ).select(*views.columns)
