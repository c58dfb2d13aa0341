"""An independent SQL answer for every query that SQL can express."""

from __future__ import annotations

from catalog import driver_tables as d
from catalog.oracle_views import (
    VIEWS, _list, _pick, channel_case, domain_of, medium_case, name_case, spam_test, view, with_views,
)
from footfall import fixed_values as fv

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views)


T = "CAST({} AS VARCHAR)".format
SUM = "CAST(sum({}) AS BIGINT)".format

# --- A ---------------------------------------------------------------------------------------------
_bad_body = "view_id % 29 = 11 OR view_id % 37 = 2"
oracle("A1_read_hits", f"""
SELECT CASE WHEN bad THEN NULL WHEN view_id % 17 = 3 THEN '' ELSE resource_type END AS resource_type,
  CASE WHEN bad THEN NULL ELSE resource_id END AS resource_id, count(*) AS hits, count(*) FILTER (WHERE NOT bad) AS with_url, count(ts) AS timed
FROM (SELECT *, {_bad_body} AS bad FROM hits) GROUP BY 1, 2
""", "hits")
_beacon = """(SELECT viewed_at + INTERVAL 20 SECOND AS ts, resource_id, view_id, uri,
  CASE WHEN view_id % 3 = 0 THEN pvid WHEN view_id % 50 = 1 THEN '0123456789abcdefX' ELSE '' END AS pvid,
  CASE WHEN view_id % 3 = 1 THEN uri ELSE '' END AS page_url,
  CASE WHEN view_id % 10 = 0 THEN 0 ELSE duration + 1 END AS engagement_time,
  CASE WHEN view_id % 10 = 0 THEN 0 ELSE k * 2 END AS scroll_depth FROM hits)"""
oracle("A2_read_engagements", f"""
SELECT page_url, count(*) AS beacons, {SUM('engagement_time')} AS seconds, max(scroll_depth) AS deepest FROM {_beacon} GROUP BY 1
""", "hits")
_props = """CASE WHEN event_id % 9 = 0 THEN '{"flag": false}' ELSE
  '{"k": ' || json_extract_string(props, '$.k') || ', "label": "<b>' || event_type || '</b> ", "ok": true, "": 1, "none": null, "size": '
  || CAST(event_id % 3 AS VARCHAR) || '.5, "late": 1}' END"""
oracle("A3_read_events", f"""
SELECT ' ' || event_type || '  now! ' AS event_name, count(*) AS events, CAST(sum(length({_props})) AS BIGINT) AS property_chars,
  count(DISTINCT user_id) AS users FROM events GROUP BY 1
""")
oracle("A4_read_daily_csv", f"""
SELECT {T('day')} AS date, visitors, visitors AS sessions, views FROM order_days WHERE day(day) % 7 <> 0
""", "order_days")
oracle("A5_read_foreign_daily", f"SELECT {T('day')} AS date, views FROM order_days", "order_days")
oracle("A6_export_csv", "SELECT channel, name, CAST(visitors AS VARCHAR) AS visitors FROM source_rows", "source_rows")
_site = f"SELECT {T('day')} AS date, visitors, sessions, views, total_duration, bounces FROM site_days"
oracle("A7_write_rollup", _site, "site_days")
_merged = """
SELECT CAST(coalesce(o.day, n.day) AS VARCHAR) AS date, coalesce(o.visitors, 0) + {v} AS visitors,
  CASE WHEN o.day IS NULL THEN {s} ELSE 5 END AS sessions, coalesce(o.views, 0) + coalesce(n.views, 0) AS views,
  CASE WHEN o.day IS NULL THEN 0 ELSE 7 END AS total_duration, CASE WHEN o.day IS NULL THEN 0 ELSE 1 END AS bounces
FROM (SELECT * FROM order_days WHERE year(day) < 1998) o FULL JOIN ({n}) n ON n.day = o.day
"""
oracle("A8_merge_add", _merged.format(v="coalesce(n.visitors, 0)", s="n.visitors", n="SELECT * FROM order_days WHERE day(day) % 7 <> 0"), "order_days")
oracle("A8_merge_foreign", _merged.format(v="CASE WHEN o.day IS NULL THEN n.views ELSE 0 END", s="n.views", n="SELECT * FROM order_days"), "order_days")
_pairs = lambda *cols: "(SELECT count(*) FROM (SELECT DISTINCT {} FROM {}))"
_star_counts = {
    "visitors": "SELECT count(DISTINCT user_id) FROM hits",
    "sessions": "SELECT count(*) FROM visits",
    "views": "SELECT count(*) FROM hits",
    "resources": "SELECT 2 * count(*) FROM (SELECT DISTINCT resource_type, resource_id FROM hits WHERE resource_id > 0)",
    "resource_uris": "SELECT count(DISTINCT uri) FROM hits",
    "parameters": "SELECT count(*) FROM tags",
    "events": "SELECT count(*) FROM hits",
    "countries": "SELECT count(DISTINCT country_code) FROM hits JOIN places USING (user_id)",
    "cities": "SELECT count(*) FROM (SELECT DISTINCT country_code, city_name FROM hits JOIN places USING (user_id))",
    "device_types": "SELECT count(DISTINCT device_type) FROM agents WHERE device_type <> ''",
    "device_browsers": "SELECT count(DISTINCT browser_name) FROM agents WHERE browser_name <> ''",
    "device_browser_versions": "SELECT count(*) FROM (SELECT DISTINCT browser_name, browser_version FROM agents WHERE browser_name <> '')",
    "device_oss": "SELECT count(DISTINCT os_name) FROM agents WHERE os_name <> ''",
    "resolutions": "SELECT count(DISTINCT screen_width) FROM hits WHERE screen_width > 0",
    "languages": "SELECT count(DISTINCT language) FROM hits WHERE language <> ''",
    "timezones": "SELECT count(DISTINCT timezone) FROM hits",
    "referrers": "SELECT count(*) FROM (SELECT DISTINCT channel, source_domain FROM sourced WHERE channel IS NOT NULL)",
    "summary": "SELECT count(*) FROM page_days",
    "summary_totals": "SELECT count(*) FROM site_days",
}
_all_star = ("hits", "visits", "tags", "places", "agents", "sourced", "page_days", "site_days")
oracle("A9_write_star", " UNION ALL ".join(f"SELECT '{n}' AS table_name, ({q}) AS rows" for n, q in _star_counts.items()), *_all_star)
_truth = "(SELECT *, user_id % 13 >= 8 AS is_bot, user_id % 4 = 0 AS is_logged_in FROM hits WHERE view_id % 20 <> 7)"
oracle("A10_read_ground_truth", f"""
SELECT is_bot, is_logged_in, count(*) AS hits, count(DISTINCT user_id) AS unique_profiles FROM {_truth} GROUP BY 1, 2
""", "hits")

# --- B ---------------------------------------------------------------------------------------------
_verdict = """CASE WHEN view_id % 41 = 4 THEN 415 WHEN view_id % 29 = 11 THEN 400 WHEN view_id % 37 = 2 THEN 413
  WHEN view_id % 23 = 7 OR view_id % 19 = 5 OR view_id % 17 = 3 THEN 400 END"""
_why = """CASE WHEN view_id % 41 = 4 THEN 'unsupported_media_type' WHEN view_id % 29 = 11 THEN 'invalid_payload'
  WHEN view_id % 37 = 2 THEN 'payload_too_large' WHEN view_id % 23 = 7 THEN 'invalid_payload'
  WHEN view_id % 19 = 5 THEN 'invalid_host' WHEN view_id % 17 = 3 THEN 'missing_fields' END"""
oracle("B1_validate_payload", f"SELECT view_id, {_verdict} AS reject_status, {_why} AS reject_code FROM hits", "hits")
_readable = "NOT (view_id % 29 = 11 OR view_id % 37 = 2)"
_sent = f"CASE WHEN {_readable} THEN CASE WHEN view_id % 31 = 1 THEN '00' || signature ELSE signature END END"
oracle("B2_verify_signature", f"""
SELECT view_id, {_sent} AS signature, {_readable} AND view_id % 31 <> 1 AS signature_ok FROM bodies
""", "bodies")
oracle("B3_privacy_decision", f"""
SELECT CASE WHEN gpc THEN 'gpc' WHEN dnt THEN 'dnt' WHEN NOT consent THEN 'consent_required'
  WHEN resource_type = 'error' THEN 'filter_blocked' END AS block_reason, count(*) AS hits, {SUM('view_id')} AS id_sum FROM hits GROUP BY 1
""", "hits")
VIEWS["limit_walk"] = (["ranked"], """
SELECT visitor_id, view_id, rn, 1 AS n, viewed_at AS last_at, false AS rate_limited FROM ranked WHERE rn = 1
UNION ALL
SELECT r.visitor_id, r.view_id, r.rn,
  CASE WHEN r.viewed_at > w.last_at + INTERVAL 14400 SECOND THEN 1 WHEN w.n < 3 THEN w.n + 1 ELSE w.n END,
  CASE WHEN r.viewed_at > w.last_at + INTERVAL 14400 SECOND OR w.n < 3 THEN r.viewed_at ELSE w.last_at END,
  NOT (r.viewed_at > w.last_at + INTERVAL 14400 SECOND OR w.n < 3)
FROM limit_walk w JOIN ranked r ON r.visitor_id = w.visitor_id AND r.rn = w.rn + 1
""")
oracle("B4_rate_limit", "SELECT view_id, rate_limited FROM limit_walk", "limit_walk")
_bots = """(SELECT *, user_agent = '' OR regexp_matches(lower(user_agent), 'googlebot|curl/|gptbot|ahrefsbot|bot/') AS is_bot,
  CASE WHEN user_agent = '' THEN 'empty_ua' WHEN contains(lower(user_agent), 'googlebot') THEN 'search_crawler'
    WHEN contains(lower(user_agent), 'gptbot') THEN 'ai_bot' WHEN contains(lower(user_agent), 'curl') THEN 'cli_tool' ELSE 'bot' END AS why FROM hits)"""
oracle("B5_flag_bots", f"""
SELECT user_agent, is_bot, CASE WHEN is_bot THEN why END AS bot_reason, count(*) AS hits FROM {_bots} GROUP BY 1, 2, 3
""", "hits")
_num = "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
_cidr = f"""({_num} BETWEEN 335544320 AND 335544351 OR ip = '20.0.1.77' OR {_num} BETWEEN 167776256 AND 167780351)"""
oracle("B6_exclude_ips", f"SELECT view_id, ip, {_cidr} AS ip_excluded FROM hits", "hits")
oracle("B6_exclude_ip_table", """
SELECT view_id, ip, user_id % 5 <> 0 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) AS ip_excluded FROM hits
""", "hits")
oracle("B7_exclude_roles", "SELECT view_id, user_id > 0 AND user_id % 4 = 0 AS role_excluded FROM hits", "hits")
oracle("B8_exclude_urls", """
SELECT view_id, starts_with(uri, '/click/') OR uri = '/view/3' OR ends_with(uri, '/9') AS url_excluded FROM hits
""", "hits")
oracle("B9_exclusion_counts", f"""
SELECT {T('CAST(ts AS DATE)')} AS date, 'bot:' || why AS reason, count(*) AS count FROM {_bots} WHERE is_bot GROUP BY 1, 2
""", "hits")
oracle("B10_rejection_counts", f"""
SELECT code AS reject_code, status AS reject_status, count(*) AS requests, count(*) AS failures
FROM (SELECT {_verdict} AS status, {_why} AS code FROM hits) WHERE status IS NOT NULL GROUP BY 1, 2
""", "hits")
oracle("B11_validate_engagement", f"""
SELECT page_url, count(*) AS beacons, {SUM('engagement_time')} AS seconds, {SUM('least(scroll_depth, 100)')} AS depth
FROM {_beacon} WHERE engagement_time > 0 OR scroll_depth > 0 GROUP BY 1
""", "hits")
oracle("B12_date_range", """
SELECT o_orderstatus, count(*) AS orders FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' GROUP BY 1
""")
oracle("B13_search_pages", "SELECT uri, title, visitors FROM pages_total WHERE uri ILIKE '%purchase/1%' OR title ILIKE '%purchase/1%'", "pages_total")
view("admitted", "salted", "sourced", "agents", "places")(f"""
SELECT h.*, s.channel, s.source_domain, a.device_type, a.browser_name, a.browser_version, a.os_name, p.country_code, p.country_name, p.city_name,
  row_number() OVER (PARTITION BY h.visitor_hash ORDER BY h.viewed_at, h.view_id) AS rn
FROM (SELECT *, {_verdict} AS status FROM {_bots.replace("hits", "salted")}) h JOIN sourced s USING (view_id) JOIN agents a ON a.user_agent = h.user_agent
  LEFT JOIN places p ON p.user_id = h.user_id AND h.user_id % 5 <> 0 AND h.user_id % 3 <> 1
WHERE status IS NULL AND view_id % 31 <> 1 AND NOT gpc AND NOT dnt AND NOT is_bot AND resource_type <> 'error'
""")
view("steps", "admitted")("""
SELECT visitor_hash, view_id, rn, viewed_at, viewed_at AS started_at FROM admitted WHERE rn = 1
UNION ALL
SELECT r.visitor_hash, r.view_id, r.rn, r.viewed_at, CASE WHEN r.viewed_at > w.started_at + INTERVAL 1800 SECOND THEN r.viewed_at ELSE w.started_at END
FROM steps w JOIN admitted r ON r.visitor_hash = w.visitor_hash AND r.rn = w.rn + 1
""")
view("stays", "steps")("""
SELECT visitor_hash, started_at, count(*) AS total_views, max(viewed_at) AS last_at, min_by(view_id, rn) AS first_view, max_by(view_id, rn) AS last_view
FROM steps GROUP BY 1, 2
""")
view("seen", "steps", "stays", "admitted")("""
SELECT a.view_id, a.uri, a.viewed_at, a.pvid, CAST(a.viewed_at AS DATE) AS day, CAST(t.started_at AS DATE) AS first_day, w.visitor_hash,
  w.visitor_hash || '@' || CAST(w.started_at AS VARCHAR) AS sid, t.total_views
FROM steps w JOIN admitted a USING (view_id) JOIN stays t ON t.visitor_hash = w.visitor_hash AND t.started_at = w.started_at
""")
_text = lambda table, *columns: f"SELECT '{table}' AS table_name, concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ") AS row"
_known = lambda c: f"nullif({c}, '')"
oracle("A9_ingest_star", " UNION ALL ".join([
    _text("visitors", "visitor_hash", "min(viewed_at)") + " FROM admitted GROUP BY visitor_hash",
    _text(
        "sessions", "t.visitor_hash", "t.started_at", "CASE WHEN total_views > 1 THEN last_at END", "total_views", "first_view", "last_view",
        "country_code", "country_name", "city_name", _known("device_type"), _known("browser_name"), "CASE WHEN browser_name <> '' THEN nullif(browser_version, '') END",
        _known("os_name"), "CASE WHEN screen_width > 0 THEN screen_width END", _known("language"), _known("timezone"), "channel", "CASE WHEN channel IS NOT NULL THEN source_domain END",
    ) + " FROM stays t JOIN admitted a ON a.view_id = t.first_view",
    _text("views", "view_id", "sid", "uri", "viewed_at", "pvid") + " FROM seen",
    _text("parameters", "view_id", "uri", "param_key", "param_value") + " FROM tags JOIN admitted USING (view_id)",
    _text("resource_uris", "uri", "arg_min(resource_id, (viewed_at, view_id))") + " FROM admitted GROUP BY uri",
    _text("summary", "day", "uri", "count(DISTINCT visitor_hash)", "count(DISTINCT sid)", "count(*)", "count(*) FILTER (WHERE total_views = 1)") + " FROM seen GROUP BY day, uri",
    _text("summary_totals", "day", "visitors", "sessions", "views", "bounces") + """ FROM (
      SELECT first_day AS day, count(DISTINCT visitor_hash) AS visitors, count(DISTINCT sid) AS sessions, count(*) FILTER (WHERE day = first_day) AS views,
        count(DISTINCT sid) FILTER (WHERE total_views = 1) AS bounces FROM seen GROUP BY 1)""",
]), "salted", "admitted", "steps", "stays", "seen", "tags")
ORACLES["A9_incremental_star"] = ORACLES["A9_ingest_star"]
oracle("K_pipeline_extra", """
SELECT device_type || ':' || split_part(uri, '/', 2) AS section, coalesce(country_code, 'ZZ') AS country_code, count(*) AS hits,
  count(DISTINCT visitor_hash) AS visitors, 1 AS ids FROM admitted GROUP BY 1, 2
""", "admitted")
oracle("B_admit_hits", f"""
SELECT coalesce(code, CASE WHEN view_id % 31 = 1 THEN 'invalid_signature' WHEN gpc THEN 'gpc' WHEN dnt THEN 'dnt'
    WHEN is_bot THEN 'bot:' || why WHEN {_cidr} THEN 'ip_range' WHEN user_id > 0 AND user_id % 4 = 0 THEN 'role'
    WHEN resource_type = 'error' THEN 'url' END) AS reason,
  coalesce(status, CASE WHEN view_id % 31 = 1 THEN 403 END) AS reject_status, count(*) AS hits
FROM (SELECT *, {_verdict} AS status, {_why} AS code FROM {_bots}) GROUP BY 1, 2
""", "hits")

# --- C ---------------------------------------------------------------------------------------------
oracle("C1_client_ip", "SELECT view_id, ip FROM hits", "hits")
oracle("C2_anonymize_ip", """
SELECT view_id, CASE view_id % 3 WHEN 0 THEN '2001:db8:' || CASE WHEN user_id % 65536 = 0 THEN '' ELSE lower(printf('%X', user_id % 65536)) || '::' END
  || CASE WHEN user_id % 65536 = 0 THEN ':' ELSE '' END
  WHEN 1 THEN regexp_replace(ip, '[0-9]+$', '0') ELSE '0.0.0.0' END AS anonymous FROM hits
""", "hits")
oracle("C3_is_private_ip", "SELECT view_id, starts_with(ip, '10.') AS private FROM hits", "hits")
oracle("C4_geo_enrich", """
SELECT view_id, ip, coalesce(country_code, '') AS country_code, coalesce(country_name, '') AS country_name, coalesce(city_name, '') AS city_name,
  '' AS region_code, coalesce(continent_code, '') AS continent_code, coalesce(continent, '') AS continent
FROM hits h LEFT JOIN places p ON p.user_id = h.user_id AND h.user_id % 5 <> 0 AND h.user_id % 3 <> 1
""", "hits", "places")
oracle("C5_device_enrich", """
SELECT a.user_agent, device_type, browser_name, browser_version, os_name, count(*) AS hits FROM hits h JOIN agents a ON a.user_agent = h.user_agent GROUP BY ALL
""", "hits", "agents")
_names = ["Desktop", "smartphone", "Phablet", "tv", "car browser", "wearable", "camera", "toaster", "console", "feature phone"]
oracle("C6_normalize_device", f"""
SELECT detected, CASE WHEN bot THEN 'Bot' ELSE CASE lower(detected) WHEN 'desktop' THEN 'Desktop' WHEN 'smartphone' THEN 'Mobile' WHEN 'phablet' THEN 'Mobile'
  WHEN 'feature phone' THEN 'Mobile' WHEN 'tv' THEN 'TV' WHEN 'wearable' THEN 'Wearable' WHEN 'camera' THEN 'Camera' WHEN 'console' THEN 'Console' ELSE 'Other' END END AS device_type,
  count(*) AS hits FROM (SELECT {_pick(_names, 'event_id')} AS detected, user_id % 10 = 0 AS bot FROM events) GROUP BY 1, 2
""")
_links = "(SELECT page_id, url AS link FROM pages UNION ALL SELECT view_id, referrer FROM hits)"
_clean = """CASE WHEN domain = '' THEN '' ELSE
  CASE WHEN starts_with(link, '//') THEN 'https://' ELSE regexp_extract(link, '^([A-Za-z]+)://', 1) || '://' END || domain
  || CASE WHEN rest = '' THEN '/' ELSE rest END END"""
oracle("C7_sanitize_referrer", f"""
SELECT page_id, link, {_clean} AS clean, domain
FROM (SELECT *, {domain_of('link')} AS domain, regexp_extract(link, '^(?:[A-Za-z]+:)?//[^/?#]*([^?#]*)', 1) AS rest FROM {_links})
""", "hits")
oracle("C8_self_referral", f"SELECT view_id, {domain_of('referrer')} = 'shop.test' AS own FROM hits", "hits")
oracle("C9_spam_referrer", f"""
SELECT page_id, domain, {spam_test('domain', [*fv.SPAM_DOMAINS, 'spam-farm.example.org', 'cheap-pills.example.com'])} AS spam
FROM (SELECT page_id, {domain_of('link')} AS domain FROM {_links})
""", "hits")
oracle("C10_classify_channel", f"""
SELECT domain, {channel_case('domain')} AS channel, {name_case('domain')} AS name, count(*) AS hits
FROM (SELECT {domain_of('link')} AS domain FROM {_links}) GROUP BY 1, 2, 3
""", "hits")
_media = [" CPC ", "ppc", "email", "E-Mail", "social", "cpm", "paid_social", "banner", "", "newsletter"]
oracle("C11_utm_medium_channel", f"""
SELECT medium, {medium_case('medium')} AS channel, count(*) AS hits FROM (SELECT {_pick(_media, 'event_id')} AS medium FROM events) GROUP BY 1, 2
""")
oracle("C12_extract_utm", "SELECT h.view_id, " + ", ".join(
    f"max(param_value) FILTER (WHERE param_key = '{k}') AS {k}" for k in fv.UTM_KEYS
) + " FROM hits h LEFT JOIN tags t ON t.view_id = h.view_id GROUP BY 1", "hits", "tags")
oracle("C13_attribute_source", "SELECT view_id, channel, source_name, source_domain FROM sourced", "sourced")
oracle("C14_visitor_hash", "SELECT view_id, visitor_hash FROM salted", "salted")
oracle("C15_salt_as_of", """
SELECT view_id, 'salt-' || CAST(s.day AS VARCHAR) AS salt, 'salt-' || CAST(s.before AS VARCHAR) AS previous_salt
FROM hits h ASOF LEFT JOIN (SELECT day, day + INTERVAL 15 MINUTE AS valid_from, lag(day) OVER (ORDER BY day) AS before
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) s ON h.ts >= s.valid_from
""", "hits")
# CRC-32 of a text's UTF-8 bytes, bit by bit (lowest first), from the reversed polynomial 0xEDB88320
_bits = "list_transform(range(8), lambda k: (('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT >> k) & 1)"
CRC32 = f"xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, strlen({{0}}) + 1), lambda i: {_bits})), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)".format
oracle("C16_resolve_uri", f"""
SELECT uri, {CRC32('uri')} AS uri_hash, hits FROM (
  SELECT CASE WHEN view_id % 3 <> 0 THEN uri ELSE '/' || coalesce(resource_type, 'post') || '/' || CAST(coalesce(resource_id, 0) AS VARCHAR) END AS uri, count(*) AS hits
  FROM hits GROUP BY 1)
""", "hits")
oracle("C17_clean_event_name", """
SELECT name, count(*) AS events FROM (
  SELECT CASE WHEN c IN ('', '0') THEN NULL ELSE c END AS name FROM (
    SELECT regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS c
    FROM (SELECT ' ' || event_type || '  now! ' AS raw FROM events UNION ALL SELECT text FROM documents))
) GROUP BY 1
""")
_event_data = """CASE WHEN event_id % 9 <> 0 THEN '{"k":' || json_extract_string(props, '$.k') || ',"label":"' || event_type || '","size":' || CAST(event_id % 3 AS VARCHAR) || '.5,"late":1}' END"""
oracle("C18_clean_event_props", f"SELECT event_id, {_event_data} AS event_data FROM events")
_hosts = "lower(regexp_extract(href, '^[A-Za-z]+://([^/?#:]+)', 1))"
_ending = "lower(regexp_extract(href, '(?i)[.](pdf|zip|xlsx?|docx?|pptx?|rar|7z|csv|mp3|mp4|wav|avi|mov|dmg|exe|msi|apk|iso)$', 1))"
oracle("C19_classify_clicks", f"""
SELECT page_id, CASE WHEN form THEN 'Form_Submit' WHEN {_ending} <> '' THEN 'File_Download' WHEN {_hosts} <> 'm.ththth.example.net' THEN 'Outbound_Link' END AS event_name,
  CASE WHEN form THEN split_part(href, '?', 1) WHEN {_ending} <> '' OR {_hosts} <> 'm.ththth.example.net' THEN href END AS target,
  CASE WHEN form THEN NULL WHEN {_ending} <> '' THEN {_ending} WHEN {_hosts} <> 'm.ththth.example.net' THEN {_hosts} END AS detail
FROM (SELECT page_id, url || {_pick(["", ".PDF", "/index.xlsx", "", ".tar", "?file=a.zip"], 'page_id')} AS href, page_id % 5 = 0 AS form FROM pages)
""")
oracle("C20_clean_text", """
SELECT page_id, length(clean) AS chars, md5(clean) AS digest
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS clean FROM pages)
""")

# --- D ---------------------------------------------------------------------------------------------
oracle("D1_upsert_dim", "SELECT DISTINCT language FROM hits WHERE language <> ''", "hits")
oracle("D2_upsert_composite_dim", "SELECT DISTINCT channel, source_domain FROM sourced WHERE channel IS NOT NULL", "sourced")
_fk = {
    "countries": "country_code", "cities": "country_code || '/' || city_name", "device_types": "nullif(device_type, '')",
    "device_browsers": "nullif(browser_name, '')", "device_browser_versions": "nullif(browser_name, '') || browser_version",
    "device_oss": "nullif(os_name, '')", "resolutions": "nullif(screen_width, 0)", "languages": "nullif(language, '')",
    "timezones": "timezone", "referrers": "channel || '/' || source_domain",
}
oracle("D3_resolve_fks", "SELECT " + ", ".join(
    f"count(DISTINCT {e}) AS {n}, count({e}) AS {n}_set" for n, e in _fk.items()
) + " FROM hits h JOIN sourced s USING (view_id) JOIN agents a ON a.user_agent = h.user_agent LEFT JOIN places p ON p.user_id = h.user_id", "hits", "sourced", "agents", "places")
oracle("D4_upsert_visitors", f"""
SELECT substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS hash, {T('min(viewed_at)')} AS created_at FROM hits GROUP BY user_id
""", "hits")
oracle("D5_sessionize_anchored", f"SELECT view_id, visitor_id, {T('started_at')} AS started_at FROM walk", "walk")
oracle("D6_sessionize_gap", f"""
SELECT visitor_id, {T('min(viewed_at)')} AS started_at, {T('max(viewed_at)')} AS ended_at, count(*) AS hits FROM (
  SELECT *, sum(opened) OVER (PARTITION BY visitor_id ORDER BY viewed_at, view_id) AS run FROM (
    SELECT *, CASE WHEN viewed_at <= lag(viewed_at) OVER (PARTITION BY visitor_id ORDER BY viewed_at, view_id) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS opened FROM hits)
) GROUP BY visitor_id, run
""", "hits")
oracle("D7_build_sessions", f"""
SELECT visitor_id, {T('started_at')} AS started_at, CASE WHEN total_views > 1 THEN {T('last_at')} END AS ended_at, total_views,
  first_view AS initial_view_id, last_view AS last_view_id, visitor_id AS user_id FROM visits
""", "visits")
oracle("D8_build_views", f"SELECT view_id AS id, uri, {T('viewed_at')} AS viewed_at, duration, scroll_depth, pvid FROM hits", "hits")
oracle("D9_view_paths", "SELECT view_id AS id, lead(view_id) OVER (PARTITION BY sid ORDER BY viewed_at, view_id) AS next_view_id FROM pv", "pv")
oracle("D9_conversation_paths", """
SELECT conv_id AS session_id, turn AS id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_view_id FROM conversations
""")
oracle("D10_resource_uris", f"""
SELECT uri, {CRC32('uri')} AS uri_hash, resource_id
FROM (SELECT uri, arg_min(coalesce(resource_id, 0), (viewed_at, view_id)) AS resource_id FROM hits GROUP BY 1)
""", "hits")
oracle("D10_resources", "SELECT DISTINCT resource_type, resource_id FROM hits WHERE resource_id > 0", "hits")
oracle("D11_utm_parameters", "SELECT view_id, param_key, param_value FROM tags", "tags")
oracle("D12_build_events", f"""
SELECT event_id AS id, nullif(user_id, 0) AS user_id, event_type || '_now' AS event_name, {_event_data} AS event_data,
  {T("date_trunc('second', ts)")} AS created_at FROM events
""")
oracle("D12_attach_sessions", f"SELECT view_id AS id, visitor_id, {T('started_at')} AS started_at FROM walk", "walk")
VIEWS["beacon"] = (["hits"], f"SELECT * REPLACE (least(scroll_depth, 100) AS scroll_depth) FROM {_beacon} WHERE engagement_time > 0 OR scroll_depth > 0")
VIEWS["first_uri"] = (["hits"], """
SELECT resource_id, min(uri) AS uri FROM (SELECT uri, arg_min(resource_id, (viewed_at, view_id)) AS resource_id FROM hits GROUP BY 1) GROUP BY 1
""")
oracle("D13_apply_engagement", f"""
SELECT h.view_id AS id, coalesce(x.t, h.duration) AS duration, coalesce(x.s, h.scroll_depth) AS scroll_depth
FROM hits h LEFT JOIN (
  SELECT view_id, arg_max(engagement_time, (ts, engagement_time, scroll_depth)) AS t, arg_max(scroll_depth, (ts, engagement_time, scroll_depth)) AS s FROM (
    SELECT h.view_id, b.ts, b.engagement_time, b.scroll_depth FROM beacon b JOIN hits h ON h.pvid = b.pvid WHERE b.pvid <> '' AND length(b.pvid) <= 16
    UNION ALL
    SELECT n.view_id, b.ts, b.engagement_time, b.scroll_depth FROM (
      SELECT coalesce(nullif(page_url, ''), f.uri) AS uri, ts, engagement_time, scroll_depth
      FROM beacon b LEFT JOIN first_uri f ON f.resource_id = b.resource_id WHERE b.pvid = '' OR length(b.pvid) > 16
    ) b JOIN (SELECT uri, max(view_id) AS view_id FROM hits GROUP BY 1) n ON n.uri = b.uri
  ) GROUP BY 1
) x ON x.view_id = h.view_id
""", "beacon", "hits", "first_uri")

# --- E ---------------------------------------------------------------------------------------------
_pages = f"SELECT {T('day')} AS date, uri, visitors, sessions, views, total_duration, bounces FROM page_days"
oracle("E1_rollup_pages", _pages, "page_days")
oracle("E2_rollup_totals", _site, "site_days")
oracle("E3_rollup_range", f"""
SELECT {T('c.day')} AS date, coalesce(visitors, 0) AS visitors, coalesce(sessions, 0) AS sessions, coalesce(views, 0) AS views,
  coalesce(total_duration, 0) AS total_duration, coalesce(bounces, 0) AS bounces
FROM (SELECT CAST(unnest(generate_series(first_day, last_day + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM clock) c LEFT JOIN site_days s ON s.day = c.day
""", "clock", "site_days")
_kept_days = "SELECT day FROM site_days WHERE day(day) % 7 <> 3"
oracle("E4_missing_days", f"""
SELECT {T('day')} AS date FROM (SELECT CAST(unnest(generate_series(last_day - 30, last_day - 2, INTERVAL 1 DAY)) AS DATE) AS day FROM clock)
WHERE day NOT IN ({_kept_days})
""", "clock", "site_days")
oracle("E5_refresh", f"""
{_site} UNION ALL SELECT {T('last_day - 30')}, 0, 0, 0, 0, 0 FROM clock WHERE last_day - 30 NOT IN (SELECT day FROM site_days)
""", "clock", "site_days")
oracle("E5_refresh_pages", f"""
{_pages} WHERE day = (SELECT last_day - 1 FROM clock) OR (day(day) % 7 = 3 AND day BETWEEN (SELECT last_day - 30 FROM clock) AND (SELECT last_day - 2 FROM clock))
""", "clock", "page_days")

# --- F ---------------------------------------------------------------------------------------------
oracle("F1_summary_daily", _site, "site_days")
_five = ["visitors", "sessions", "views", "total_duration", "bounces"]
oracle("F2_summary_totals", "SELECT " + ", ".join(f"{SUM(m)} AS {m}" for m in _five) + " FROM site_days", "site_days")
oracle("F3_top_pages", "SELECT * FROM pages_total", "pages_total")
oracle("F3_top_pages_second", "SELECT * FROM pages_total ORDER BY visitors DESC, uri, title LIMIT 20 OFFSET 5", "pages_total")
oracle("F3_top_pages_replace", f"""
SELECT uri, title, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(views) AS BIGINT) AS views,
  CAST(sum(total_duration) AS BIGINT) AS total_duration, CAST(sum(bounces) AS BIGINT) AS bounces
FROM page_days JOIN page_titles USING (uri), clock
WHERE day = last_day OR uri NOT IN (SELECT uri FROM page_days WHERE day = (SELECT last_day FROM clock)) GROUP BY 1, 2
""", "page_days", "page_titles", "clock")
for _n, _pick_one in (("F4_entry_pages", "arg_min"), ("F5_exit_pages", "arg_max")):
    oracle(_n, f"""
SELECT uri, title, count(*) AS count, count(DISTINCT sid) AS visitors
FROM (SELECT sid, {_pick_one}(uri, (viewed_at, view_id)) AS uri FROM pv GROUP BY 1) JOIN page_titles USING (uri) GROUP BY 1, 2
""", "pv", "page_titles")
oracle("F6_sources", "SELECT * FROM source_rows", "source_rows")
oracle("F7_sources_by_channel", """
SELECT channel, c.visitors AS channel_visitors, c.sessions AS channel_sessions, c.views AS channel_views, rank, name, domain, s.visitors, s.sessions, s.views
FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY visitors DESC, name, domain) AS rank FROM source_rows) s
JOIN (SELECT coalesce(channel, 'Direct') AS channel, count(DISTINCT visitor_id) AS visitors, count(*) AS sessions, CAST(sum(total_views) AS BIGINT) AS views FROM sess GROUP BY 1) c USING (channel)
""", "source_rows", "sess")


def _dim(labels: str, where: str) -> str:
    return f"SELECT {labels}, count(DISTINCT visitor_id) AS visitors, count(*) AS sessions FROM sess WHERE {where} GROUP BY ALL"


_device_rows = _dim("device_type AS name", "device_type <> ''")
for _n, _sql in {
    "F8_dim_countries": _dim("country_code AS code, country_name AS name, continent_code", "country_code IS NOT NULL"),
    "F9_dim_cities": _dim("city_name, country_name AS country", "city_name IS NOT NULL"),
    "F10_dim_browsers": _dim("browser_name AS name", "browser_name <> ''"),
    "F11_dim_os": _dim("os_name AS name", "os_name <> ''"),
    "F12_dim_devices": _device_rows,
    "F13_dim_languages": _dim("language AS name", "language <> ''"),
    "F27_bot_vs_human": f"SELECT CASE WHEN name = 'Tablet' THEN 'Bot' ELSE 'Human' END AS name, {SUM('visitors')} AS value FROM ({_device_rows}) GROUP BY 1",
    "F28_with_share": f"""SELECT name, visitors AS value, floor(visitors / (sum(visitors) OVER ()) * 100 * 10.0 + 0.5) / 10.0 AS share FROM ({_dim("os_name AS name", "os_name <> ''")})""",
    "F30_sort_rows": _dim("city_name, country_name AS country", "city_name IS NOT NULL"),
}.items():
    oracle(_n, _sql, "sess")
oracle("F14_utm_campaigns", """
SELECT campaign, source, medium, count(DISTINCT visitor_id) AS visitors, count(*) AS sessions FROM (
  SELECT p.sid, p.visitor_id, max(param_value) FILTER (WHERE param_key = 'utm_campaign') AS campaign,
    max(param_value) FILTER (WHERE param_key = 'utm_source') AS source, max(param_value) FILTER (WHERE param_key = 'utm_medium') AS medium
  FROM pv p JOIN tags t ON t.view_id = p.view_id WHERE param_key IN ('utm_campaign', 'utm_source', 'utm_medium') GROUP BY 1, 2
) GROUP BY 1, 2, 3
""", "pv", "tags")
oracle("F15_events_list", """
SELECT h.resource_type || '_now' AS event_name, count(*) AS total, count(DISTINCT p.sid) AS sessions FROM hits h JOIN pv p USING (view_id) GROUP BY 1
""", "hits", "pv")
oracle("F16_event_daily", f"SELECT {T('CAST(viewed_at AS DATE)')} AS date, count(*) AS total FROM hits WHERE resource_type = 'purchase' GROUP BY 1", "hits")
_prop_rows = """
SELECT property, count(*) AS total FROM (
  SELECT unnest(['k=' || CAST(k AS VARCHAR), 'label=' || resource_type, 'size=' || CAST(view_id % 3 AS VARCHAR) || '.5', 'late=1']) AS property
  FROM (SELECT * FROM hits WHERE resource_type = '{kind}' AND view_id % 9 <> 0 {newest})
) GROUP BY 1 {top}
"""
oracle("F17_event_properties", _prop_rows.format(kind="click", newest="", top=""), "hits")
oracle("F17_event_properties_all", _prop_rows.format(kind="view", newest="", top=""), "hits")
_live = "FROM pv p, clock WHERE p.viewed_at >= now_at - INTERVAL 300 SECOND"
oracle("F18_active_visitors", f"SELECT count(DISTINCT visitor_id) AS active_visitors {_live}", "pv", "clock")
oracle("F19_active_pages", f"""
SELECT uri, coalesce(title, '') AS title, visitors FROM (SELECT uri, count(DISTINCT visitor_id) AS visitors {_live} GROUP BY 1)
JOIN page_titles USING (uri) ORDER BY visitors DESC, uri, title LIMIT 10
""", "pv", "clock", "page_titles")
oracle("F20_recent_feed", f"""
SELECT p.uri, coalesce(t.title, '') AS title, coalesce(s.country_code, '') AS country, coalesce(s.browser_name, '') AS browser, {T('p.viewed_at')} AS time
FROM pv p JOIN sess s ON s.sid = p.sid JOIN page_titles t ON t.uri = p.uri, clock
WHERE p.viewed_at >= now_at - INTERVAL 300 SECOND ORDER BY p.viewed_at DESC, p.view_id DESC LIMIT 20
""", "pv", "sess", "page_titles", "clock")
_day = _live.replace("300 SECOND", "1 DAY")
oracle("F18_active_visitors_day", f"SELECT count(DISTINCT visitor_id) AS active_visitors {_day}", "pv", "clock")
oracle("F19_active_pages_day", f"""
SELECT uri, coalesce(title, '') AS title, visitors FROM (SELECT uri, count(DISTINCT visitor_id) AS visitors {_day} GROUP BY 1) JOIN page_titles USING (uri)
""", "pv", "clock", "page_titles")
oracle("F20_recent_feed_day", f"""
SELECT p.uri, coalesce(t.title, '') AS title, coalesce(s.country_code, '') AS country, coalesce(s.browser_name, '') AS browser, {T('p.viewed_at')} AS time
FROM pv p JOIN sess s ON s.sid = p.sid JOIN page_titles t ON t.uri = p.uri, clock WHERE p.viewed_at >= now_at - INTERVAL 1 DAY
""", "pv", "sess", "page_titles", "clock")
_four = ", ".join(f"{SUM(m)} AS {m}" for m in ["visitors", "sessions", "views", "bounces"])
for _n, _when in {
    "daily": "day = last_day - 1", "weekly": "day BETWEEN last_day - 7 AND last_day - 1",
    "monthly": "day BETWEEN CAST(date_trunc('month', last_day) AS DATE) AND last_day(last_day)",
}.items():
    oracle(f"F21_report_totals_{_n}", f"SELECT {_four} FROM site_days, clock WHERE {_when}", "site_days", "clock")
oracle("F22_report_top_pages", f"""
SELECT uri, {SUM('visitors')} AS visitors, {SUM('views')} AS views FROM page_days, clock WHERE day BETWEEN last_day - 7 AND last_day - 1
GROUP BY 1 ORDER BY visitors DESC, uri LIMIT 10
""", "page_days", "clock")
oracle("F22_report_all_pages", f"""
SELECT uri, {SUM('visitors')} AS visitors, {SUM('views')} AS views FROM page_days, clock WHERE day BETWEEN last_day - 7 AND last_day - 1 GROUP BY 1
""", "page_days", "clock")
_now = "day BETWEEN last_day - 6 AND last_day"
_then = "day BETWEEN last_day - 13 AND last_day - 7"
_ch = lambda a, b: f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CAST({a} - {b} AS DOUBLE) / {b} * 100 END"
oracle("F25_kpi_compare", "SELECT *, " + ", ".join(f"{_ch(m, 'prev_' + m)} AS {m}_change" for m in ("visitors", "sessions", "views"))
    + f", CASE WHEN prev_avg_duration > 0 THEN {_ch('avg_duration', 'prev_avg_duration')} END AS avg_duration_change FROM (SELECT *, "
    + "coalesce(CAST(total_duration AS DOUBLE) / nullif(sessions, 0), 0) AS avg_duration, coalesce(CAST(prev_total_duration AS DOUBLE) / nullif(prev_sessions, 0), 0) AS prev_avg_duration FROM (SELECT "
    + ", ".join(f"CAST(coalesce(sum({m}) FILTER (WHERE {w}), 0) AS BIGINT) AS {p}{m}" for p, w in (("", _now), ("prev_", _then)) for m in _five)
    + " FROM site_days, clock))", "site_days", "clock")
oracle("F26_page_avg_duration", "SELECT uri, visitors, round(CAST(total_duration AS DOUBLE) / nullif(visitors, 0), 6) AS avg_duration FROM pages_total", "pages_total")
oracle("F29_with_bar_ratio", """
SELECT channel, name, domain, round(CAST(visitors AS DOUBLE) / m * 100, 6) AS visitors_width, round(CAST(sessions AS DOUBLE) / m * 100, 6) AS sessions_width
FROM source_rows, (SELECT greatest(max(greatest(visitors, sessions)), 1) AS m FROM source_rows)
""", "source_rows")

# --- G ---------------------------------------------------------------------------------------------
oracle("G1_export_user", f"""
SELECT v.visitor_id AS user_id, {T('v.started_at')} AS started_at, CASE WHEN total_views > 1 THEN {T('last_at')} ELSE 'Active' END AS ended, total_views,
  0 AS duration, p.pages
FROM visits v JOIN (SELECT visitor_id, started_at, string_agg(uri, ', ' ORDER BY viewed_at, view_id) AS pages
  FROM pv GROUP BY 1, 2) p
ON p.visitor_id = v.visitor_id AND p.started_at = v.started_at
""", "visits", "pv")
oracle("G2_erase_user", f"""
SELECT nullif(visitor_id, 7) AS user_id, nullif(visitor_id, 7) AS visitor_id,
  CASE WHEN visitor_id = 7 THEN '' ELSE substr(sha256(CAST(visitor_id AS VARCHAR)), 1, 16) END AS ip_hash, {T('started_at')} AS started_at, total_views FROM visits
""", "visits")
oracle("G3_purge_orders", f"""
SELECT year(o_orderdate) AS year, count(*) AS orders, {SUM('o_orderkey')} AS key_sum FROM orders WHERE o_orderdate >= DATE '1999-06-01' - 365 GROUP BY 1
""")
oracle("G3_purge_all", """
SELECT 'events' AS table_name, count(*) AS rows FROM hits, clock WHERE viewed_at >= last_day + 18 - 30
UNION ALL SELECT 'views', count(*) FROM hits, clock WHERE viewed_at >= last_day + 18 - 30
UNION ALL SELECT 'sessions', count(*) FROM visits, clock WHERE started_at >= last_day + 18 - 30
UNION ALL SELECT 'parameters', count(*) FROM tags JOIN walk USING (view_id), clock WHERE started_at >= last_day + 18 - 30
""", "hits", "clock", "visits", "tags", "walk")
_archive = f"SELECT strftime(day, '%Y-%m') AS month, {T('day')} AS date, visitors, sessions, views, total_duration, bounces FROM site_days, clock WHERE strftime(day, '%Y-%m') = strftime(last_day, '%Y-%m')"
oracle("G5_archive_month", _archive, "site_days", "clock")
oracle("G6_seal_archive", _archive.replace("strftime(last_day", "strftime(first_day"), "site_days", "clock")
oracle("G7_audit_raw_ips", """
SELECT 'remote_addr' AS column_name, count(*) AS raw_ips FROM hits
UNION ALL SELECT unnest(['user_agent', 'page_url', 'pvid', 'x_forwarded_for', 'resource_type']), 0
""", "hits")
_octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
oracle("G7_audit_documents", f"""
SELECT 'lang' AS column_name, 0 AS raw_ips UNION ALL
SELECT 'word', count(*) FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE regexp_full_match(w, '{_octet}(\\.{_octet}){{3}}')
""")
oracle("G8_table_stats", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ["region", "nation", "customer", "orders", "lineitem", "events", "pages", "conversations"]
))
oracle("G9_freshness", f"SELECT {T('max(viewed_at)')} AS latest_viewed_at, true AS ok FROM hits", "hits")

# --- H ---------------------------------------------------------------------------------------------
oracle("H1_truth_summary", f"""
SELECT count(*) AS total_hits, count(DISTINCT user_id) AS unique_profiles, count(*) FILTER (WHERE is_bot) AS bot_hits,
  count(*) FILTER (WHERE is_logged_in) AS logged_in_hits, count(DISTINCT user_id) FILTER (WHERE NOT is_bot) AS human_profiles FROM {_truth}
""", "hits")
oracle("H2_truth_by_page", f"""
SELECT resource_type, resource_id, uri AS page_url, count(*) AS hits, count(DISTINCT user_id) AS unique_profiles FROM {_truth} GROUP BY 1, 2, 3
""", "hits")
oracle("H2_truth_by_device", f"""
SELECT device_type, count(*) AS hits, count(DISTINCT user_id) AS unique_profiles FROM {_truth} t JOIN agents a ON a.user_agent = t.user_agent GROUP BY 1
""", "hits", "agents")
oracle("H2_truth_by_channel", """
SELECT channel AS expected_channel, count(*) AS hits, count(DISTINCT user_id) AS unique_profiles FROM sourced JOIN hits USING (view_id) GROUP BY 1
""", "sourced", "hits")
oracle("H3_compare_counts", "SELECT count(*) AS views, count(DISTINCT sid) AS sessions, count(DISTINCT visitor_id) AS visitors FROM pv", "pv")
oracle("H4_reconcile", f"""
SELECT uri AS page_url, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual,
  round(CASE WHEN coalesce(e, 0) = 0 THEN CASE WHEN coalesce(a, 0) = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
    ELSE greatest(0, (1.0::DOUBLE - abs(e - coalesce(a, 0)) / e) * 100) END, 6) AS accuracy,
  round(CASE WHEN coalesce(e, 0) = 0 THEN CASE WHEN coalesce(a, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    ELSE least(CAST(coalesce(a, 0) AS DOUBLE) / e, 1) END, 6) AS correlation
FROM (SELECT uri, count(*) AS e FROM {_truth} GROUP BY 1) FULL JOIN (SELECT uri, count(*) AS a FROM hits WHERE uri <> '/click/3' GROUP BY 1) USING (uri)
""", "hits")
oracle("H5_consistency_checks", f"""
SELECT "check", "left", "right", CASE WHEN contains("check", '<=') THEN "left" <= "right" ELSE "left" = "right" END AS ok FROM (
  SELECT 'visitors <= sessions' AS "check", v AS "left", s AS "right" FROM t UNION ALL SELECT 'sessions <= views', s, w FROM t
  UNION ALL SELECT 'pages views = totals', (SELECT {SUM('views')} FROM pages_total), w FROM t
  UNION ALL SELECT 'sources visitors = totals', (SELECT {SUM('visitors')} FROM source_rows), v FROM t
  UNION ALL SELECT 'countries visitors = totals', (SELECT {SUM('visitors')} FROM ({_dim("country_code AS code", "country_code IS NOT NULL")})), v FROM t
  UNION ALL SELECT 'devices visitors = totals', (SELECT {SUM('visitors')} FROM ({_device_rows})), v FROM t)
""".replace("FROM t ", f"FROM (SELECT {SUM('visitors')} AS v, {SUM('sessions')} AS s, {SUM('views')} AS w FROM site_days) t ").replace("FROM t)", f"FROM (SELECT {SUM('visitors')} AS v, {SUM('sessions')} AS s, {SUM('views')} AS w FROM site_days) t)").replace("FROM t\n", f"FROM (SELECT {SUM('visitors')} AS v, {SUM('sessions')} AS s, {SUM('views')} AS w FROM site_days) t\n"),
    "site_days", "pages_total", "source_rows", "sess")
oracle("H6_vitals_summary", "SELECT * FROM runs", "runs")
oracle("H7_aggregate_runs", """
SELECT * REPLACE (array_to_string(list_transform(runs_p50, lambda v: CAST(v AS VARCHAR)), ',') AS runs_p50) FROM agg
""", "agg")
oracle("H8_deltas", "SELECT * FROM deltas", "deltas")
oracle("H8_impact_scores", "SELECT * FROM scores", "scores")
oracle("H9_noise_floor", "SELECT * FROM floors", "floors")
oracle("H9_noise_band", """
SELECT *, CASE WHEN floor <= 50 THEN 'small' WHEN floor <= 200 THEN 'medium' WHEN floor <= 500 THEN 'large' ELSE 'very large' END AS band FROM floors WHERE vital = 'lcp'
""", "floors")
oracle("H9_within_noise", "SELECT config, vital, delta, floor, abs(delta) <= floor AS within_noise FROM deltas JOIN floors USING (vital)", "deltas", "floors")
oracle("H10_rank_configs", "SELECT *, row_number() OVER (ORDER BY impact_score, config) AS position FROM scores", "scores")


def _side(s: str) -> str:
    cols = ", ".join(f"max(delta) FILTER (WHERE vital = '{v}') AS {v}_{s}" for v in ("lcp", "ttfb", "fcp"))
    return f"(SELECT config, {cols}, max(impact_score) AS score_{s} FROM deltas_{s} JOIN scores_{s} USING (config) GROUP BY 1) {s}"


_noise = lambda v: f"(SELECT max(floor) FROM (SELECT * FROM floors_a UNION ALL SELECT * FROM floors_b) WHERE vital = '{v}')"
oracle("H11_compare_batches", "SELECT config, " + ", ".join(f"{v}_{s}" for s in "ab" for v in ("lcp", "ttfb", "fcp", "score"))
    + ", CASE WHEN score_b IS NULL THEN 'A' WHEN score_a IS NULL THEN 'B' END AS only_in, "
    + ", ".join(f"round({v}_b - {v}_a, 6) AS {v}_change" for v in ("lcp", "ttfb", "fcp", "score")) + ", "
    + ", ".join(f"abs({v}_b - {v}_a) > {_noise(v)} AS {v}_significant" for v in ("lcp", "ttfb", "fcp"))
    + f" FROM {_side('a')} FULL JOIN {_side('b')} USING (config)", "deltas_a", "deltas_b", "scores_a", "scores_b", "floors_a", "floors_b")
oracle("H12_network_stats", """
SELECT page_id // 10 AS load_id, count(*) AS requests, floor(sum(length(html)) / 1024 * 10.0 + 0.5) / 10.0 AS total_kb,
  floor(coalesce(sum(length(html)) FILTER (WHERE page_id % 4 = 0), 0) / 1024 * 10.0 + 0.5) / 10.0 AS tracker_kb FROM pages GROUP BY 1
""")

# --- I: a finished stream gives what its batch twin gives -----------------------------------------------
oracle("I1_stream_active_visitors", f"""
SELECT {T('w')} AS window_start, {T('w + INTERVAL 5 MINUTE')} AS window_end, count(DISTINCT visitor_id) AS visitors, count(*) AS views
FROM (SELECT visitor_id, date_trunc('minute', ts) - i * INTERVAL 1 MINUTE AS w FROM hits, range(5) r(i)) GROUP BY w
""", "hits")
oracle("I2_stream_daily_totals", f"""
SELECT {T('CAST(ts AS DATE)')} AS date, count(DISTINCT visitor_id) AS visitors, count(*) AS views, {SUM('duration')} AS total_duration
FROM hits GROUP BY 1
""", "hits")
oracle("I4_stream_sessions_anchored", f"""
SELECT visitor_id, {T('started_at')} AS started_at, {T('last_at')} AS ended_at, total_views AS hits FROM visits
""", "visits")
for _n, _key in (("I7_stream_rate_limit", "w.visitor_id"), ("I7_stream_rate_limit_text", "'u' || CAST(w.visitor_id AS VARCHAR)")):
    oracle(_n, f"""
SELECT {_key} AS key, {T('viewed_at')} AS second, count(*) AS hits, count(*) FILTER (WHERE NOT rate_limited) AS accepted
FROM limit_walk w JOIN hits USING (view_id) GROUP BY w.visitor_id, viewed_at
""", "limit_walk", "hits")
oracle("I5_stream_dedup", "SELECT view_id, pvid FROM hits", "hits")
oracle("I6_stream_engagement", """
SELECT view_id, CASE WHEN view_id % 3 = 0 THEN duration + 1 END AS engagement_time, CASE WHEN view_id % 3 = 0 THEN scroll_depth END AS scroll_depth FROM hits
""", "hits")
oracle("I3_stream_sessions_gap", f"""
SELECT visitor_id, {T('min(viewed_at)')} AS started_at, {T('max(viewed_at)')} AS ended_at, count(*) AS hits FROM (
  SELECT *, sum(opened) OVER (PARTITION BY visitor_id ORDER BY viewed_at, view_id) AS run FROM (
    SELECT *, CASE WHEN viewed_at <= lag(viewed_at) OVER (PARTITION BY visitor_id ORDER BY viewed_at, view_id) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS opened FROM hits)
) GROUP BY visitor_id, run
""", "hits")
oracle("A11_stream_rollup", _site, "site_days")
ORACLES["A11_stream_star"] = ORACLES["A9_ingest_star"]
