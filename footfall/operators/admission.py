"""Which hits are let in: each rule tags a column; ``admit_hits`` composes them in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import fixed_values as fv
from footfall.functions import device, identity, ip, text
from footfall.functions.source import blank, url_host
from footfall.operators.enrich import cidr_keys, match_ranges
from footfall.schemas import HIT_BODY

HIT_KEYS = [f.name for f in HIT_BODY.fields]


def validate_payload(hits: DataFrame, hosts: Sequence[str], keys: Sequence[str] = tuple(HIT_KEYS)) -> DataFrame:
    """Adds ``reject_status`` and ``reject_code`` of the first failing check; NULL when all pass.

    ``body`` is the raw JSON text. A body with a repeated key counts as not valid, because the
    readers of repeated keys disagree on which value counts.
    """
    body = F.col("body")
    media = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    staged = hits.withColumns(
        {
            "_media": media,
            "_keys": F.json_object_keys(body),
            "_fields": F.from_json(body, "resource_type string, signature string, page_url string"),
        }
    )
    staged = staged.withColumn("_host", url_host(F.col("_fields.page_url")))
    no_keys = F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in keys]))) == 0
    bad_host = (F.col("_host") != "") & ~F.col("_host").isin([h.lower() for h in hosts])
    empty_list = body.rlike(r"^\s*\[\s*\]\s*$")
    is_object = F.col("_keys").isNotNull()
    repeated = F.size("_keys") != F.size(F.array_distinct("_keys"))
    lacking = blank(text.clean_text(F.col("_fields.resource_type"))) | blank(text.clean_text(F.col("_fields.signature")))
    rule = (
        F.when(~F.col("_media").isin(fv.MEDIA_TYPES), _reject(415, "unsupported_media_type"))
        .when(F.octet_length(body) > fv.MAX_BODY_BYTES, _reject(413, "payload_too_large"))
        .when(empty_list, _reject(400, "missing_fields"))
        .when(~is_object | repeated, _reject(400, "invalid_payload"))
        .when(~no_keys, _reject(400, "invalid_payload"))
        .when(~blank(F.col("_fields.page_url")) & bad_host, _reject(400, "invalid_host"))
        .when(F.coalesce(lacking, F.lit(True)), _reject(400, "missing_fields"))
    )
    return (
        staged.withColumn("_reject", rule)
        .withColumns({"reject_status": F.col("_reject.status"), "reject_code": F.col("_reject.code")})
        .drop("_media", "_keys", "_fields", "_host", "_reject")
    )


def _reject(status: int, code: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))


def verify_signature(hits: DataFrame, secret: bytes) -> DataFrame:
    ok = identity.signature_ok(F.col("signature"), F.col("resource_type"), F.col("resource_id"), secret)
    return hits.withColumn("signature_ok", ok)


def privacy_decision(
    hits: DataFrame,
    mode: str = "cookieless",
    respect_gpc: Column | bool = True,
    respect_dnt: Column | bool = True,
    enabled: bool = True,
    has_consent: Column | None = None,
    require_consent: Column | bool | None = None,
    should_track: Column | bool = True,
) -> DataFrame:
    """Adds ``block_reason``: the first rule that blocks the hit, NULL when it may be tracked."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    required = as_column(mode == "disabled-until-consent" if require_consent is None else require_consent)
    consent = F.coalesce(F.col("consent_granted") if has_consent is None else has_consent, F.lit(False))
    says_one = lambda name: F.coalesce(F.trim(F.col(name)) == "1", F.lit(False))
    return hits.withColumn(
        "block_reason",
        F.when(F.lit(not enabled), "tracking_disabled")
        .when(as_column(respect_gpc) & says_one("sec_gpc"), "gpc")
        .when(as_column(respect_dnt) & says_one("dnt"), "dnt")
        .when(required & ~consent, "consent_required")
        .when(~as_column(should_track), "filter_blocked"),
    )


def flag_bots(hits: DataFrame, ua: str = "user_agent") -> DataFrame:
    agent = F.col(ua)
    return hits.withColumn("is_bot", device.is_bot(agent)).withColumn(
        "bot_reason", F.when(F.col("is_bot"), device.bot_reason(agent))
    )


def exclude_ips(hits: DataFrame, cidrs: Sequence[str] | DataFrame, ip_col: str = "ip") -> DataFrame:
    """Adds ``ip_excluded``. A list is configuration and is inlined; a table is joined by prefix."""
    if not isinstance(cidrs, DataFrame):
        return hits.withColumn("ip_excluded", ip.in_any_cidr(F.col(ip_col), cidrs))
    found = match_ranges(hits, cidr_keys(cidrs), ip_col)
    joined = hits.join(found, hits[ip_col] == found["_ip"], "left")
    return joined.withColumn("ip_excluded", F.col("_found").isNotNull()).drop("_ip", "_found")


def exclude_roles(hits: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Adds ``role_excluded``; logged-out visitors are never excluded."""
    if not roles:
        return hits.withColumn("role_excluded", F.lit(False))
    shared = F.arrays_overlap(F.col("user_roles"), F.array(*[F.lit(r) for r in roles]))
    logged_in = F.coalesce(F.col("user_id"), F.lit(0)) > 0
    return hits.withColumn("role_excluded", F.coalesce(logged_in & shared, F.lit(False)))


def exclude_urls(hits: DataFrame, patterns: Sequence[str], uri: str = "uri") -> DataFrame:
    return hits.withColumn("url_excluded", text.match_any_wildcard(F.col(uri), list(patterns)))


def exclusion_counts(excluded: DataFrame, ts: str = "ts", reason: str = "reason") -> DataFrame:
    return excluded.groupBy(
        F.to_date(ts).alias("date"), F.col(reason).alias("reason")
    ).agg(F.count(F.lit(1)).alias("count"))


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """Requests per code, and how many of them count as failures."""
    status = F.col("reject_status")
    fails = (status >= 400) & ~status.isin(429, 503)
    return rejected.filter(status.isNotNull()).groupBy("reject_code", "reject_status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.when(fails, 1).otherwise(0)).alias("failures")
    )


def validate_engagement(beacons: DataFrame) -> DataFrame:
    """Clip the scroll depth to 100 and drop beacons that report nothing."""
    amount = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0)))
    return beacons.withColumns(
        {"engagement_time": amount("engagement_time"), "scroll_depth": F.least(amount("scroll_depth"), F.lit(100))}
    ).filter((F.col("engagement_time") > 0) | (F.col("scroll_depth") > 0))


def date_range(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows of the inclusive day range, as a half-open filter that reaches the scan."""
    for day in (first, last):
        if len(day) != 10 or day[4] != "-" or day[7] != "-" or not day.replace("-", "").isdigit():
            raise ValueError(f"not a YYYY-MM-DD day: {day!r}")
    start = F.to_timestamp(F.lit(first))
    end = F.to_timestamp(F.lit(last)) + F.expr("INTERVAL 1 DAY")
    if "day" in df.columns:  # the partition column of stored facts
        df = df.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def since(df: DataFrame, ts: str, start: Column) -> DataFrame:
    """Rows from ``start`` on; on stored facts older day partitions are not read."""
    if "day" in df.columns:
        df = df.filter(F.col("day") >= start.cast("date"))
    return df.filter(F.col(ts) >= start)


def search_pages(pages: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search in uri and title; a blank query keeps every row."""
    needle = query.strip().lower()
    if not needle:
        return pages
    holds = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
    return pages.filter(holds("uri") | holds("title"))


def admit_hits(
    hits: DataFrame,
    hosts: Sequence[str],
    secret: bytes,
    privacy: dict | None = None,
    bots: bool = False,
    cidrs: Sequence[str] = (),
    roles: Sequence[str] = (),
    urls: Sequence[str] = (),
) -> DataFrame:
    """Adds ``reason``: why a hit is turned away, in request order; NULL for admitted hits.

    Payload, signature and privacy always apply. Bots, addresses, roles and URLs are opt-in. The
    rate limit needs state and is a job of its own (``sessionize.flag_rate_limited``).
    """
    staged = validate_payload(hits, hosts)
    staged = privacy_decision(verify_signature(staged, secret), **(privacy or {}))
    staged = exclude_urls(exclude_roles(exclude_ips(flag_bots(staged), list(cidrs)), list(roles)), list(urls), "page_url")
    reason = (
        F.when(F.col("reject_code").isNotNull(), F.col("reject_code"))
        .when(~F.col("signature_ok"), F.lit("invalid_signature"))
        .when(F.col("block_reason").isNotNull(), F.col("block_reason"))
        .when(F.lit(bots) & F.col("is_bot"), F.concat(F.lit("bot:"), F.col("bot_reason")))
        .when(F.col("ip_excluded"), F.lit("ip_range"))
        .when(F.col("role_excluded"), F.lit("role"))
        .when(F.col("url_excluded"), F.lit("url"))
    )
    return staged.withColumn("reason", reason).withColumn(
        "reject_status",
        F.coalesce(F.col("reject_status"), F.when(F.col("reason") == "invalid_signature", F.lit(403))),
    ).drop("signature_ok", "block_reason", "is_bot", "bot_reason", "ip_excluded", "role_excluded", "url_excluded")
