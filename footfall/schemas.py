"""Explicit schemas of inputs and tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "date": T.DateType(), "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """``"name type, name type"`` as a schema (the DDL reader would need a running session)."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Keys a page-hit body may carry.
HIT_BODY = _struct(
    "resource_type string, resource_id long, referrer string, screen_width int, screen_height int, "
    "language string, timezone string, signature string, page_url string, page_query string, "
    "pvid string, consent_granted boolean, _statnonce string"
)

# Request facts the web server adds to every logged line.
SERVER = _struct(
    "content_type string, cf_connecting_ip string, x_forwarded_for string, x_real_ip string, "
    "remote_addr string, user_agent string, dnt string, sec_gpc string, user_id long, "
    "user_roles array<string>, ts timestamp"
)

ENGAGEMENT_BODY = _struct(
    "signature string, resource_type string, resource_id long, engagement_time int, "
    "scroll_depth int, pvid string, page_url string, _statnonce string"
)

# `properties` stays JSON text until its values have been checked.
EVENT_BODY = _struct(
    "event_name string, resource_type string, resource_id long, signature string, "
    "properties string, consent_granted boolean, _statnonce string"
)

TABLES: dict[str, T.StructType] = {
    "visitors": _struct("id long, hash binary, created_at timestamp"),
    "sessions": _struct(
        "id long, visitor_id long, ip_hash binary, referrer_id long, country_id long, city_id long, "
        "initial_view_id long, last_view_id long, total_views long, device_type_id long, "
        "device_os_id long, device_browser_id long, device_browser_version_id long, timezone_id long, "
        "language_id long, resolution_id long, user_id long, started_at timestamp, "
        "ended_at timestamp, duration long"
    ),
    "views": _struct(
        "id long, session_id long, resource_uri_id long, resource_id long, viewed_at timestamp, "
        "next_view_id long, duration long, scroll_depth int, pvid string"
    ),
    "resources": _struct(
        "id long, resource_type string, resource_id long, cached_title string, cached_terms string, "
        "cached_author_id long, cached_date timestamp, resource_meta string, language string, "
        "is_deleted boolean"
    ),
    "resource_uris": _struct("id long, resource_id long, uri string, uri_hash long"),
    "parameters": _struct(
        "id long, session_id long, resource_uri_id long, view_id long, param_key string, param_value string"
    ),
    "countries": _struct("id long, code string, name string, continent_code string, continent string"),
    "cities": _struct("id long, country_id long, region_code string, region_name string, city_name string"),
    "device_types": _struct("id long, name string"),
    "device_browsers": _struct("id long, name string"),
    "device_oss": _struct("id long, name string"),
    "device_browser_versions": _struct("id long, browser_id long, version string"),
    "resolutions": _struct("id long, width int, height int"),
    "languages": _struct("id long, code string, name string, region string"),
    "timezones": _struct("id long, name string, utc_offset string, is_dst boolean"),
    "referrers": _struct("id long, channel string, name string, domain string, domain_hash long"),
    "summary": _struct(
        "date date, resource_uri_id long, visitors long, sessions long, views long, "
        "total_duration long, bounces long"
    ),
    "summary_totals": _struct(
        "date date, visitors long, sessions long, views long, total_duration long, bounces long"
    ),
    "events": _struct(
        "id long, session_id long, resource_uri_id long, user_id long, event_name string, "
        "event_data string, created_at timestamp"
    ),
    "exclusions": _struct("date date, reason string, count long"),
}

GROUND_TRUTH = _struct(
    "id long, test_run_id string, profile_id string, resource_type string, resource_id long, "
    "page_url string, referrer_url string, expected_channel string, utm_source string, "
    "utm_medium string, utm_campaign string, device_type string, is_bot boolean, "
    "is_logged_in boolean, user_agent string, recorded_at timestamp"
)

# Metrics of both rollup tables, in table order.
METRICS = ["visitors", "sessions", "views", "total_duration", "bounces"]
