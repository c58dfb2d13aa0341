"""Projections that add visitor, device, place and source columns to hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import fixed_values as fv
from footfall.functions import device, identity, ip, source
from footfall.functions.text import let
from footfall.operators import intervals

GEO_COLUMNS = ["country_code", "country_name", "city_name", "region_code", "continent_code", "continent"]


def with_client_ip(
    hits: DataFrame,
    headers: Sequence[str] = ("cf_connecting_ip", "x_forwarded_for", "x_real_ip", "remote_addr"),
    out: str = "ip",
) -> DataFrame:
    return hits.withColumn(out, ip.client_ip(*[F.col(h) for h in headers]))


def with_device(hits: DataFrame, ua: str = "user_agent") -> DataFrame:
    """Device type, browser, version and operating system, row by row: no shuffle is needed."""
    agent = F.col(ua)
    return hits.withColumns(
        {
            "device_type": device.device_type(agent),
            "browser_name": device.browser_name(agent),
            "browser_version": device.browser_version(agent),
            "os_name": device.os_name(agent),
        }
    )


def with_source(
    hits: DataFrame,
    site_host: str,
    referrer: str = "referrer",
    query: str = "page_query",
    spam: Sequence[str] = tuple(fv.SPAM_DOMAINS),
) -> DataFrame:
    """Campaign map ``utm`` and the visit's ``channel``, ``source_name`` and ``source_domain``."""
    link, text = F.col(referrer), F.lit(None).cast("string")
    tag = lambda key: F.coalesce(F.try_element_at(F.col("utm"), F.lit(key)), F.lit(""))
    staged = hits.withColumns({"utm": source.extract_utm(F.col(query)), "_domain": source.referrer_domain(link)})
    staged = staged.withColumns(
        {
            "_link": F.coalesce((~source.blank(link)) & (F.col("_domain") != site_host.lower()), F.lit(False)),
            "_source": tag("utm_source"),
            "_medium": tag("utm_medium"),
        }
    )
    # the name the rules look up, and whether a spam referrer leaves the visit without a source
    staged = staged.withColumns(
        {
            "_looked": F.when(F.col("_link"), F.col("_domain")).otherwise(F.lower("_source")),
            "_spam": F.col("_link") & source.is_spam_domain(F.col("_domain"), spam),
            "_tagged": (F.col("_source") != "") | (F.col("_medium") != ""),
            "_paid": F.when(~source.blank(F.col("_medium")), source.utm_medium_channel(F.col("_medium"))),
        }
    )
    staged = staged.withColumn("_rule", source.domain_rule(F.col("_looked")))
    channel, name = source.rule_channel(F.col("_rule")), source.rule_name(F.col("_rule"), F.col("_looked"))
    named = F.col("_link") | F.col("_tagged")
    staged = staged.withColumns(
        {
            "channel": F.when(F.col("_spam"), text).when(~named, F.lit("Direct")).otherwise(F.coalesce(F.col("_paid"), channel)),
            "source_domain": F.when(F.col("_spam"), text).otherwise(F.when(F.col("_link"), F.col("_domain")).otherwise(F.col("_source"))),
            "_name": F.when(F.col("_paid").isNotNull() | ~named, F.lit("")).otherwise(name),
        }
    )
    # a tagged visit without a known name is named after its tag
    shown = F.when(~F.col("_link") & (F.col("_name") == ""), F.col("_source")).otherwise(F.col("_name"))
    return staged.withColumn("source_name", F.when(~F.col("_spam"), shown)).drop(
        "_domain", "_link", "_source", "_medium", "_looked", "_spam", "_tagged", "_paid", "_rule", "_name"
    )


def _moment(at):
    """Comparable text of a time."""
    return F.lpad((F.unix_micros(at) + F.lit(1 << 62)).cast("string"), 20, "0")


def salts_by_day(salts: DataFrame, days: DataFrame) -> DataFrame:
    """(``_day``, ``_salts``) for each of ``days`` (column ``_day``): what was valid when it began and what began on it, in order,
    each with the salt before it. The last salt has no end."""
    spans = salts.where(F.col("valid_from").isNotNull()).groupBy("valid_from").agg(F.min("salt").alias("salt"))
    spans = spans.withColumns({"_lo": _moment(F.col("valid_from")), "_hi": F.lit(None).cast("string")})
    before = spans.select(_moment(F.col("valid_from") - F.expr("INTERVAL 1 MICROSECOND")).alias("_key"), "valid_from", "salt")
    found = intervals.lookup(before, spans, ["salt"]).select("_key", F.col("_found.salt").alias("previous_salt"))
    chained = before.join(found, "_key").select("valid_from", "salt", "previous_salt")
    chained = intervals.stored(chained.withColumns({"_lo": _moment(F.col("valid_from")), "_hi": F.lit(None).cast("string")}), "salts")
    entry = ["valid_from", "salt", "previous_salt"]
    starts = days.select("_day", _moment(F.col("_day").cast("timestamp")).alias("_key"))
    at_start = starts.join(intervals.lookup(starts, chained, entry), "_key").select("_day", "_found")
    on_day = chained.select(F.col("valid_from").cast("date").alias("_day"), F.struct(*entry).alias("_found"))
    both = at_start.unionByName(on_day).where(F.col("_found").isNotNull())
    return both.groupBy("_day").agg(F.array_sort(F.collect_set("_found")).alias("_salts"))


def with_salt(hits: DataFrame, salts: DataFrame, ts: str = "ts") -> DataFrame:
    """As-of join: the salt valid at the hit's time and the one before it; NULL for a hit before the first salt.

    Salts are looked up for distinct days, so hits move at most once, by an equality join on the day.
    """
    at = F.col(ts)
    days = intervals.stored(hits.select(at.cast("date").alias("_day")).where("_day is not null").distinct(), "days")
    joined = hits.withColumn("_day", at.cast("date")).join(salts_by_day(salts, days), "_day", "left")
    valid = F.get(F.filter("_salts", lambda s: s["valid_from"] <= at), F.size(F.filter("_salts", lambda s: s["valid_from"] <= at)) - 1)
    return joined.withColumn("_salt", valid).withColumns(
        {"salt": F.col("_salt.salt"), "previous_salt": F.col("_salt.previous_salt")}
    ).drop("_day", "_salts", "_salt")


def with_visitor(
    hits: DataFrame, site: str, ip_col: str = "ip", ua: str = "user_agent", salt: str = "salt"
) -> DataFrame:
    """Visitor hash and id; the raw address columns are dropped here and go no further."""
    staged = hits.withColumn("_anonymous", ip.anonymize_ip(F.col(ip_col)))
    hashed = staged.withColumn(
        "visitor_hash", identity.visitor_hash(F.col(salt), F.col("_anonymous"), F.col(ua), site)
    )
    return hashed.withColumn("visitor_id", identity.key_id(F.col("visitor_hash"))).drop(
        "_anonymous", salt, "previous_salt", ip_col,
        "cf_connecting_ip", "x_forwarded_for", "x_real_ip", "remote_addr",
    )


def address_key(c):
    """Comparable hex text of an address: 8 digits for IPv4, 32 for IPv6; NULL for anything else."""
    v4 = F.lower(F.lpad(F.hex(ip.ipv4_to_long(c)), 8, "0"))
    return F.when(c.contains(":"), let(c, ip.ipv6_to_hex)).otherwise(v4)


def range_keys(ranges: DataFrame, lo: str = "ip_from", hi: str = "ip_to") -> DataFrame:
    """Ranges of addresses as ranges of keys ``_lo`` to ``_hi``."""
    return ranges.withColumns({"_lo": address_key(F.col(lo)), "_hi": address_key(F.col(hi))}).drop(lo, hi)


def cidr_keys(cidrs: DataFrame) -> DataFrame:
    """Blocks (``cidr``, IPv4 or IPv6, with or without prefix length) as key ranges.

    The digit the prefix ends in is split by its remaining bits; the digits after it run from 0 to f.
    """
    base = F.substring_index("cidr", "/", 1)
    parsed = cidrs.select(
        address_key(base).alias("_k"),
        F.when(F.col("cidr").contains("/"), F.substring_index("cidr", "/", -1).try_cast("int")).otherwise(128).alias("_b"),
    )
    staged = parsed.filter(F.col("_k").isNotNull() & (F.col("_b") >= 0)).select(
        "_k", F.length("_k").alias("_w"), F.least(F.col("_b"), F.length("_k") * 4).alias("_b")
    )
    whole = F.floor(F.col("_b") / 4).cast("int")
    step = F.pow(F.lit(2), 4 - F.col("_b") % 4).cast("int")
    digit = F.conv(F.substring("_k", whole + 1, F.lit(1)), 16, 10).cast("int")
    low = digit - digit % step
    end = lambda d, fill: F.rpad(
        F.concat(F.substring("_k", F.lit(1), whole), F.coalesce(F.lower(F.hex(d)), F.lit(""))), F.col("_w"), F.lit(fill)
    )
    return staged.select(end(low, "0").alias("_lo"), end(low + step - 1, "f").alias("_hi"))


def match_ranges(hits: DataFrame, keys: DataFrame, ip_col: str, columns: Sequence[str] = ()) -> DataFrame:
    """(``_ip``, ``_found``) for every distinct address that lies in a range of ``keys``.

    Distinct addresses are taken first (with map-side combining), so an address that sends a third of all hits is matched once.
    Of ranges that overlap the one that starts last wins.
    """
    distinct = hits.select(F.col(ip_col).alias("_ip")).distinct()
    # the length of a key, 8 or 32, tells the families apart
    family = lambda key: F.concat(F.when(F.length(key) == 8, F.lit("4")).otherwise(F.lit("6")), key)
    keyed = intervals.stored(distinct.withColumn("_key", family(address_key(F.col("_ip")))), "addresses")
    spans = keys.filter(F.length("_lo") == F.length("_hi")).withColumns({"_lo": family(F.col("_lo")), "_hi": family(F.col("_hi")), "_in": F.lit(True)})
    found = intervals.lookup(keyed.select("_key").distinct(), spans, [*columns] or ["_in"]).where(F.col("_found").isNotNull())
    return keyed.join(found, "_key").select("_ip", "_found")


def geo_enrich(hits: DataFrame, geo_ranges: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Country, city, region and continent of the address; '' when private or unknown."""
    found = match_ranges(hits, range_keys(geo_ranges), ip_col, GEO_COLUMNS)
    joined = hits.join(found, hits[ip_col] == found["_ip"], "left")
    # only a matched address can need the private test
    known = joined.withColumn("_known", F.when(F.col("_found").isNotNull(), ~ip.is_private_ip(F.col(ip_col))))
    return known.withColumns(
        {c: F.coalesce(F.when(F.col("_known"), F.col(f"_found.{c}")), F.lit("")) for c in GEO_COLUMNS}
    ).drop("_ip", "_found", "_known")


def with_uri(hits: DataFrame) -> DataFrame:
    uri = source.resolve_uri(F.col("page_url"), F.col("resource_type"), F.col("resource_id"))
    return hits.withColumn("uri", uri).withColumn("uri_hash", source.uri_hash(F.col("uri")))
