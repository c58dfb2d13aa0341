"""Every operator as a query over the given tables: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import driver_tables as d
from footfall import fixed_values as fv
from footfall import session
from footfall.functions import device, identity, ip, source, text
from footfall.operators import admission, enrich, rollups, sessionize, star
from footfall.plans import ingest, lifecycle, reconcile, reports
from footfall.sources import daily, hits as logs, tables
from footfall.streaming import jobs, runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Days and times as ISO text, bytes as hex: the same everywhere."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.configure(spark)
            return plain(build(spark, sf_dir))

        QUERIES[name] = run
        return build

    return register


def with_range(build):
    """Give a report the stored tables, the first and last day and the last second."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(d.stored(spark, sf_dir), *d.clock(spark, sf_dir))

    return run


# --- A: sources and sinks --------------------------------------------------------------------------


def _log_lines(spark, sf_dir, kind):
    """The given events written as raw log lines, then read back through the readers."""
    path = session.new_path(spark, f"log-{kind}")
    if kind == "hits":
        rows = d.request_bodies(d.raw_events(spark, sf_dir))
        rows = rows.select("body", "content_type", "user_agent", "remote_addr", "user_id", "ts")
    elif kind == "beacons":
        fields = ["pvid", "page_url", "resource_id", "engagement_time", "scroll_depth"]
        rows = d.beacons(spark, sf_dir).select(F.to_json(F.struct(*fields)).alias("body"), "ts")
    else:
        fields = F.struct("event_name", F.col("properties"))
        rows = d.custom_events(spark, sf_dir).select(F.to_json(fields).alias("body"), "user_id", "ts")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


@query("A1_read_hits")
def _(spark, sf_dir):
    read = logs.read_hits(spark, _log_lines(spark, sf_dir, "hits"))
    return read.groupBy("resource_type", "resource_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count("page_url").alias("with_url"), F.count("ts").alias("timed")
    )


@query("A2_read_engagements")
def _(spark, sf_dir):
    read = logs.read_engagements(spark, _log_lines(spark, sf_dir, "beacons"))
    return read.groupBy("page_url").agg(
        F.count(F.lit(1)).alias("beacons"), F.sum("engagement_time").alias("seconds"), F.max("scroll_depth").alias("deepest")
    )


@query("A3_read_events")
def _(spark, sf_dir):
    read = logs.read_events(spark, _log_lines(spark, sf_dir, "events"))
    return read.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.length("properties")).alias("property_chars"), F.count_distinct("user_id").alias("users")
    )


def _import_rows(spark, sf_dir):
    """Daily order counts written as an import file and read back."""
    path = session.new_path(spark, "import")
    orders = d.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias(" Date ")).agg(
        F.lit("/ünïcode").alias("url"),
        (-F.count_distinct("o_custkey")).alias("Visitors"),
        F.count(F.lit(1)).alias("views"),
    )
    day = F.dayofmonth(" Date ")
    orders.withColumn("Visitors", F.when(day % 7 == 0, 0).otherwise(F.col("Visitors"))).write.option("header", True).csv(path)
    return daily.read_daily_csv(spark, path)


@query("A4_read_daily_csv")
def _(spark, sf_dir):
    return _import_rows(spark, sf_dir).drop("line")


@query("A5_read_foreign_daily")
def _(spark, sf_dir):
    return daily.read_foreign_daily(d.foreign_counters(spark, sf_dir))


@query("A6_export_csv")
def _(spark, sf_dir):
    t, (first, last, _) = d.stored(spark, sf_dir), d.clock(spark, sf_dir)
    path = f"{session.new_path(spark, 'export')}/{tables.csv_name('sources', first, last)}"
    report = reports.sources(t, first, last, None)
    tables.export_csv(report, {"channel": "Channel", "name": 'Name, "shown"', "visitors": "Visitors"}, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.toDF("channel", "name", "visitors").na.fill("")


@query("A7_write_rollup")
def _(spark, sf_dir):
    """Write all days, write the last ten again, read back: nothing doubles, nothing is lost."""
    t, (_, last, _) = d.stored(spark, sf_dir), d.clock(spark, sf_dir)
    path = session.new_path(spark, "rollup")
    tables.write_rollup(t["summary_totals"], path)
    recent = str(date.fromisoformat(last) - timedelta(days=9))
    again = rollups.rollup_totals(
        admission.date_range(t["views"], "viewed_at", recent, last), admission.date_range(t["sessions"], "started_at", recent, last)
    )
    tables.write_rollup(again, path)
    return tables.read_rollup(spark, path, "summary_totals")


def _order_totals(spark, sf_dir):
    """Order days before 1998 as totals that an import will meet."""
    rows = d.table(spark, sf_dir, "orders").filter(F.year("o_orderdate") < 1998).groupBy(F.to_date("o_orderdate").alias("date"))
    return rows.agg(
        F.count_distinct("o_custkey").alias("visitors"), F.lit(5).cast("long").alias("sessions"),
        F.count(F.lit(1)).alias("views"), F.lit(7).cast("long").alias("total_duration"), F.lit(1).cast("long").alias("bounces"),
    )


@query("A8_merge_add")
def _(spark, sf_dir):
    return daily.import_csv(_order_totals(spark, sf_dir), _import_rows(spark, sf_dir))


@query("A8_merge_foreign")
def _(spark, sf_dir):
    return daily.import_foreign(_order_totals(spark, sf_dir), daily.read_foreign_daily(d.foreign_counters(spark, sf_dir)))


@query("A9_write_star")
def _(spark, sf_dir):
    t = d.stored(spark, sf_dir)
    t.write()
    return lifecycle.table_stats(dict(t))


def _named_star(t):
    """Sessions of a star with the names their ids stand for, and views with their session's."""
    visits = t["sessions"].join(t["visitors"].select(F.col("id").alias("visitor_id"), "hash"), "visitor_id")
    for table, key, names in (
        ("countries", "country_id", ["code", "name"]), ("cities", "city_id", ["city_name"]), ("device_types", "device_type_id", ["name"]),
        ("device_browsers", "device_browser_id", ["name"]), ("device_browser_versions", "device_browser_version_id", ["version"]),
        ("device_oss", "device_os_id", ["name"]), ("resolutions", "resolution_id", ["width"]), ("languages", "language_id", ["code"]),
        ("timezones", "timezone_id", ["name"]), ("referrers", "referrer_id", ["channel", "domain"]),
    ):
        dim = t[table].select(F.col("id").alias(key), *[F.col(n).alias(f"{table}_{n}") for n in names])
        visits = visits.join(dim, key, "left")
    return visits


@query("A9_ingest_star")
def _(spark, sf_dir):
    return _star_rows(d.ingested(spark, sf_dir))


@query("A9_incremental_star")
def _(spark, sf_dir):
    return _star_rows(d.ingested_in_two(spark, sf_dir))


@query("K_pipeline_extra")
def _(spark, sf_dir):
    """The ingest job with two stages of the site's own: one that adds a column, one that changes a value where a place is unknown."""
    section = lambda hits: hits.withColumn("section", F.concat_ws(":", "device_type", F.split("uri", "/")[1]))
    abroad = ingest.Stage("abroad", lambda hits: hits.withColumn("country_code", F.when(F.col("country_code") == "", "ZZ").otherwise(F.col("country_code"))), ("country_code",))
    hits = ingest.pipeline(d.requests(spark, sf_dir), d.RULES, d.salts(spark, sf_dir), d.geo_ranges(spark, sf_dir), [section, abroad])
    return hits.groupBy("section", "country_code").agg(F.count("*").alias("hits"), F.countDistinct("visitor_hash").alias("visitors"), F.countDistinct("country_id").alias("ids"))


def _star_rows(t):
    """Every row of a star, ids replaced by what they stand for."""
    text = lambda table, *columns: F.struct(F.lit(table).alias("table_name"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("row"))
    visits = _named_star(t).withColumn("visitor", F.lower(F.hex("hash")))
    at = F.concat_ws("@", "visitor", F.col("started_at").cast("string")).alias("session")
    uris = t["resource_uris"].select(F.col("id").alias("resource_uri_id"), "uri")
    views = t["views"].join(visits.select(F.col("id").alias("session_id"), at), "session_id").join(uris, "resource_uri_id")
    parts = t["parameters"].join(uris, "resource_uri_id")
    rows = [
        t["visitors"].withColumn("visitor", F.lower(F.hex("hash"))).select(text("visitors", "visitor", "created_at").alias("r")),
        visits.select(
            text(
                "sessions", "visitor", "started_at", "ended_at", "total_views", "initial_view_id", "last_view_id", "countries_code", "countries_name",
                "cities_city_name", "device_types_name", "device_browsers_name", "device_browser_versions_version", "device_oss_name",
                "resolutions_width", "languages_code", "timezones_name", "referrers_channel", "referrers_domain",
            ).alias("r")
        ),
        views.select(text("views", "id", "session", "uri", "viewed_at", "pvid").alias("r")),
        parts.select(text("parameters", "view_id", "uri", "param_key", "param_value").alias("r")),
        t["resource_uris"].select(text("resource_uris", "uri", "resource_id").alias("r")),
        t["summary"].join(uris, "resource_uri_id").select(text("summary", "date", "uri", "visitors", "sessions", "views", "bounces").alias("r")),
        t["summary_totals"].select(text("summary_totals", "date", "visitors", "sessions", "views", "bounces").alias("r")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("r.*")


@query("A10_read_ground_truth")
def _(spark, sf_dir):
    path = session.new_path(spark, "truth")
    truth = d.ground_truth(spark, sf_dir).withColumns(
        {"id": F.lit(1).cast("long"), "profile_id": F.col("profile_id").cast("string")}
    )
    truth.write.parquet(path)
    return reconcile.truth_by(logs.read_ground_truth(spark, path), "is_bot", "is_logged_in")


# --- B: admission ------------------------------------------------------------------------------------


@query("B1_validate_payload")
def _(spark, sf_dir):
    requests = d.request_bodies(d.raw_events(spark, sf_dir))
    return admission.validate_payload(requests, [d.SITE_HOST]).select("view_id", "reject_status", "reject_code")


@query("B2_verify_signature")
def _(spark, sf_dir):
    requests = d.request_bodies(d.raw_events(spark, sf_dir))
    return admission.verify_signature(requests, d.SECRET).select("view_id", "signature", "signature_ok")


@query("B3_privacy_decision")
def _(spark, sf_dir):
    hits = admission.privacy_decision(d.raw_events(spark, sf_dir), "disabled-until-consent", should_track=F.col("resource_type") != "error")
    return hits.groupBy("block_reason").agg(F.count(F.lit(1)).alias("hits"), F.sum("view_id").alias("id_sum"))


@query("B4_rate_limit")
def _(spark, sf_dir):
    """A limit of 3 with a four-hour counter, so that the given events reach it."""
    hits = d.raw_events(spark, sf_dir).select("view_id", "user_id", "viewed_at")
    flagged = sessionize.flag_rate_limited(hits, "user_id", "viewed_at", "view_id", limit=3, ttl=14400)
    return flagged.select("view_id", "rate_limited")


@query("B5_flag_bots")
def _(spark, sf_dir):
    hits = admission.flag_bots(d.raw_events(spark, sf_dir))
    return hits.groupBy("user_agent", "is_bot", "bot_reason").agg(F.count(F.lit(1)).alias("hits"))


CIDRS = ["20.0.0.0/27", "20.0.1.77", "10.0.16.0/20", "2001:db8::/32", "bad/99"]


@query("B6_exclude_ips")
def _(spark, sf_dir):
    hits = enrich.with_client_ip(d.raw_events(spark, sf_dir))
    return admission.exclude_ips(hits, CIDRS).select("view_id", "ip", "ip_excluded")


@query("B6_exclude_ip_table")
def _(spark, sf_dir):
    """Every seventh customer's /24 as the list."""
    c = F.col("c_custkey")
    listed = d.table(spark, sf_dir, "customer").filter(c % 7 == 0).select(
        F.concat(F.concat_ws(".", 20 + F.floor(c / 65536) % 80, F.floor(c / 256) % 256, c % 256), F.lit(".9/24")).alias("cidr")
    )
    hits = enrich.with_client_ip(d.raw_events(spark, sf_dir))
    return admission.exclude_ips(hits, listed).select("view_id", "ip", "ip_excluded")


@query("B7_exclude_roles")
def _(spark, sf_dir):
    hits = admission.exclude_roles(d.raw_events(spark, sf_dir), ["author", "administrator"])
    return hits.select("view_id", "role_excluded")


@query("B8_exclude_urls")
def _(spark, sf_dir):
    hits = admission.exclude_urls(d.raw_events(spark, sf_dir), ["/CLICK/*", "/view/3", "*/9", ""])
    return hits.select("view_id", "url_excluded")


@query("B9_exclusion_counts")
def _(spark, sf_dir):
    hits = admission.flag_bots(d.raw_events(spark, sf_dir)).filter("is_bot")
    return admission.exclusion_counts(hits.withColumn("reason", F.concat(F.lit("bot:"), "bot_reason")))


@query("B10_rejection_counts")
def _(spark, sf_dir):
    requests = d.request_bodies(d.raw_events(spark, sf_dir))
    return admission.rejection_counts(admission.validate_payload(requests, [d.SITE_HOST]))


@query("B11_validate_engagement")
def _(spark, sf_dir):
    valid = admission.validate_engagement(d.beacons(spark, sf_dir))
    return valid.groupBy("page_url").agg(
        F.count(F.lit(1)).alias("beacons"), F.sum("engagement_time").alias("seconds"), F.sum("scroll_depth").alias("depth")
    )


@query("B12_date_range")
def _(spark, sf_dir):
    rows = admission.date_range(d.table(spark, sf_dir, "orders"), "o_orderdate", "1996-03-01", "1997-02-28")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("B13_search_pages")
@with_range
def _(t, first, last, _):
    return admission.search_pages(reports.top_pages(t, first, last, last, None), "  PURCHASE/1 ").select("uri", "title", "visitors")


@query("B_admit_hits")
def _(spark, sf_dir):
    requests = enrich.with_client_ip(d.request_bodies(d.raw_events(spark, sf_dir)))
    tagged = admission.admit_hits(
        requests, [d.SITE_HOST], d.SECRET, bots=True, cidrs=CIDRS, roles=["author"], urls=["/error/*"]
    )
    return tagged.groupBy("reason", "reject_status").agg(F.count(F.lit(1)).alias("hits"))


# --- C: enrichment -----------------------------------------------------------------------------------


@query("C1_client_ip")
def _(spark, sf_dir):
    return enrich.with_client_ip(d.raw_events(spark, sf_dir)).select("view_id", "ip")


@query("C2_anonymize_ip")
def _(spark, sf_dir):
    """IPv4, IPv6 and broken addresses derived from each hit."""
    event = F.col("view_id")
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("user_id") % 65536)), F.lit(":1::"), F.lower(F.hex(event % 65536)))
    address = F.when(event % 3 == 0, v6).when(event % 3 == 1, F.col("remote_addr")).otherwise(F.concat(F.lit("x"), "remote_addr"))
    return d.raw_events(spark, sf_dir).select("view_id", ip.anonymize_ip(address).alias("anonymous"))


@query("C3_is_private_ip")
def _(spark, sf_dir):
    return d.raw_events(spark, sf_dir).select("view_id", ip.is_private_ip(F.col("remote_addr")).alias("private"))


@query("C4_geo_enrich")
def _(spark, sf_dir):
    hits = enrich.with_client_ip(d.raw_events(spark, sf_dir)).select("view_id", "ip")
    return enrich.geo_enrich(hits, d.geo_ranges(spark, sf_dir))


@query("C5_device_enrich")
def _(spark, sf_dir):
    hits = enrich.with_device(d.raw_events(spark, sf_dir))
    return hits.groupBy("user_agent", "device_type", "browser_name", "browser_version", "os_name").agg(F.count(F.lit(1)).alias("hits"))


@query("C6_normalize_device")
def _(spark, sf_dir):
    names = ["Desktop", "smartphone", "Phablet", "tv", "car browser", "wearable", "camera", "toaster", "console", "feature phone"]
    hits = d.raw_events(spark, sf_dir).withColumn("detected", d.pick(names, F.col("view_id")))
    kind = device.normalize_device(F.col("detected"), F.col("user_id") % 10 == 0)
    return hits.groupBy("detected", kind.alias("device_type")).agg(F.count(F.lit(1)).alias("hits"))


@query("C7_sanitize_referrer")
def _(spark, sf_dir):
    pages = d.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("link"))
    rows = pages.unionByName(d.raw_events(spark, sf_dir).select(F.col("view_id").alias("page_id"), F.col("referrer").alias("link")))
    return rows.select("page_id", "link", source.sanitize_referrer(F.col("link")).alias("clean"), source.referrer_domain(F.col("link")).alias("domain"))


@query("C8_self_referral")
def _(spark, sf_dir):
    return d.raw_events(spark, sf_dir).select("view_id", source.is_self_referral(F.col("referrer"), "SHOP.test").alias("own"))


@query("C9_spam_referrer")
def _(spark, sf_dir):
    rows = d.table(spark, sf_dir, "pages").select("page_id", source.referrer_domain(F.col("url")).alias("domain"))
    rows = rows.unionByName(d.raw_events(spark, sf_dir).select(F.col("view_id").alias("page_id"), source.referrer_domain(F.col("referrer")).alias("domain")))
    spam = [*fv.SPAM_DOMAINS, "spam-farm.example.org", "cheap-pills.example.com"]
    return rows.select("page_id", "domain", source.is_spam_domain(F.col("domain"), spam).alias("spam"))


@query("C10_classify_channel")
def _(spark, sf_dir):
    links = d.raw_events(spark, sf_dir).select(source.referrer_domain(F.col("referrer")).alias("domain"))
    links = links.unionByName(d.table(spark, sf_dir, "pages").select(source.referrer_domain(F.col("url")).alias("domain")))
    rows = links.select("domain", source.classify_channel(F.col("domain")).alias("c")).select("domain", "c.channel", "c.name")
    return rows.groupBy("domain", "channel", "name").agg(F.count(F.lit(1)).alias("hits"))


@query("C11_utm_medium_channel")
def _(spark, sf_dir):
    media = [" CPC ", "ppc", "email", "E-Mail", "social", "cpm", "paid_social", "banner", "", "newsletter"]
    hits = d.raw_events(spark, sf_dir).withColumn("medium", d.pick(media, F.col("view_id")))
    return hits.groupBy("medium", source.utm_medium_channel(F.col("medium")).alias("channel")).agg(F.count(F.lit(1)).alias("hits"))


@query("C12_extract_utm")
def _(spark, sf_dir):
    hits = d.raw_events(spark, sf_dir).select("view_id", source.extract_utm(F.col("page_query")).alias("utm"))
    return hits.select("view_id", *[F.col("utm")[k].alias(k) for k in ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")])


@query("C13_attribute_source")
def _(spark, sf_dir):
    hits = enrich.with_source(d.raw_events(spark, sf_dir), d.SITE_HOST)
    return hits.select("view_id", "channel", "source_name", "source_domain")


@query("C14_visitor_hash")
def _(spark, sf_dir):
    hits = enrich.with_salt(d.raw_events(spark, sf_dir), d.salts(spark, sf_dir))
    hashed = enrich.with_visitor(enrich.with_client_ip(hits), "https://shop.test")
    return hashed.select("view_id", "visitor_hash")


def _salts(spark, sf_dir):
    """One salt per day of the events, changed a quarter past midnight."""
    days = d.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return days.select(
        (F.col("day").cast("timestamp") + F.expr("INTERVAL 15 MINUTES")).alias("valid_from"),
        F.concat(F.lit("salt-"), F.col("day").cast("string")).alias("salt"),
    )


@query("C15_salt_as_of")
def _(spark, sf_dir):
    return enrich.with_salt(d.raw_events(spark, sf_dir), _salts(spark, sf_dir)).select("view_id", "salt", "previous_salt")


@query("C16_resolve_uri")
def _(spark, sf_dir):
    hits = d.raw_events(spark, sf_dir).withColumn("page_url", F.when(F.col("view_id") % 3 != 0, F.col("page_url")))
    return enrich.with_uri(hits).groupBy("uri", "uri_hash").agg(F.count(F.lit(1)).alias("hits"))


@query("C17_clean_event_name")
def _(spark, sf_dir):
    c = text.clean_event_name(F.col("raw"))
    names = d.custom_events(spark, sf_dir).select(F.col("event_name").alias("raw"))
    names = names.unionByName(d.table(spark, sf_dir, "documents").select(F.col("text").alias("raw")))
    return names.select(c.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("events"))


@query("C18_clean_event_props")
def _(spark, sf_dir):
    return text.with_clean_props(d.custom_events(spark, sf_dir), "properties", "event_data").select("event_id", "event_data")


@query("C19_classify_clicks")
def _(spark, sf_dir):
    page = F.col("page_id")
    endings = ["", ".PDF", "/index.xlsx", "", ".tar", "?file=a.zip"]
    clicks = d.table(spark, sf_dir, "pages").select(
        "page_id", F.concat("url", d.pick(endings, page)).alias("href"), F.when(page % 5 == 0, F.lit("form")).otherwise(F.lit("link")).alias("kind")
    )
    return text.classify_clicks(clicks, "m.ththth.example.net").select("page_id", "event_name", "target", "detail")


@query("C20_clean_text")
def _(spark, sf_dir):
    cleaned = d.table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))
    return cleaned.select("page_id", F.length("clean").cast("long").alias("chars"), F.md5("clean").alias("digest"))


# --- D: star schema ----------------------------------------------------------------------------------


def _early(t, name, spark, sf_dir):
    """A dimension as found in the first ten days, to be completed by all hits."""
    first, _, _ = d.clock(spark, sf_dir)
    tenth = str(date.fromisoformat(first) + timedelta(days=9))
    return admission.date_range(t, "viewed_at", first, tenth)


@query("D1_upsert_dim")
def _(spark, sf_dir):
    hits = d.enriched_hits(spark, sf_dir)
    existing = _early(hits, "", spark, sf_dir).filter(F.col("user_id") % 2 == 0).select("language").filter("language <> ''").distinct()
    return star.upsert_dim(existing, hits.select("language"), ["language"])


@query("D2_upsert_composite_dim")
def _(spark, sf_dir):
    hits = d.enriched_hits(spark, sf_dir)
    keys = ["channel", "source_domain"]
    existing = _early(hits, "", spark, sf_dir).filter("channel IS NOT NULL").select(*keys).distinct()
    return star.upsert_dim(existing, hits.select(*keys), keys)


@query("D3_resolve_fks")
def _(spark, sf_dir):
    """Ids must agree with the natural keys: counted per dimension."""
    hits = d.enriched_hits(spark, sf_dir)
    counts = [F.count_distinct(k).alias(n) for n, k in star.FOREIGN_KEYS.items()]
    nulls = [F.count(k).alias(f"{n}_set") for n, k in star.FOREIGN_KEYS.items()]
    return hits.agg(*counts, *nulls)


@query("D4_upsert_visitors")
def _(spark, sf_dir):
    hits = d.enriched_hits(spark, sf_dir)
    existing = star.build_visitors(_early(hits, "", spark, sf_dir).filter(F.col("user_id") % 3 == 0))
    return star.upsert_visitors(existing, hits).select("hash", "created_at")


@query("D5_sessionize_anchored")
def _(spark, sf_dir):
    hits = d.raw_events(spark, sf_dir).select("view_id", "visitor_id", "viewed_at")
    return sessionize.sessionize_anchored(hits).select("view_id", "visitor_id", "started_at")


@query("D6_sessionize_gap")
def _(spark, sf_dir):
    hits = d.raw_events(spark, sf_dir).select("view_id", "visitor_id", "viewed_at")
    return sessionize.sessionize_gap(hits)


@query("D7_build_sessions")
def _(spark, sf_dir):
    s = star.build_sessions(d.sessionized_hits(spark, sf_dir))
    return s.select("visitor_id", "started_at", "ended_at", "total_views", "initial_view_id", "last_view_id", "user_id")


@query("D8_build_views")
def _(spark, sf_dir):
    t = d.stored(spark, sf_dir)
    named = t["views"].join(t["resource_uris"].select(F.col("id").alias("resource_uri_id"), "uri"), "resource_uri_id")
    return named.select("id", "uri", "viewed_at", "duration", "scroll_depth", "pvid")


@query("D9_view_paths")
def _(spark, sf_dir):
    return star.view_paths(d.stored(spark, sf_dir)["views"]).select("id", "next_view_id")


@query("D9_conversation_paths")
def _(spark, sf_dir):
    turns = d.table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), F.timestamp_seconds("turn").alias("viewed_at"),
        F.lit(None).cast("long").alias("next_view_id"),
    )
    return star.view_paths(turns).select("session_id", "id", "next_view_id")


@query("D10_resource_uris")
def _(spark, sf_dir):
    return star.build_resource_uris(d.raw_events(spark, sf_dir)).select("uri", "uri_hash", "resource_id")


@query("D10_resources")
def _(spark, sf_dir):
    return star.build_resources(d.raw_events(spark, sf_dir)).select("resource_type", "resource_id")


@query("D11_utm_parameters")
@with_range
def _(t, *_):
    return t["parameters"].select("view_id", "param_key", "param_value")


@query("D12_build_events")
def _(spark, sf_dir):
    return star.build_events(d.custom_events(spark, sf_dir)).select("id", "user_id", "event_name", "event_data", "created_at")


@query("D12_attach_sessions")
def _(spark, sf_dir):
    t = d.stored(spark, sf_dir)
    hub = t["sessions"].select(F.col("id").alias("session_id"), "visitor_id", "started_at")
    linked = t["events"].select("id", "session_id").join(hub, "session_id", "left")
    return linked.select("id", "visitor_id", "started_at")


@query("D13_apply_engagement")
def _(spark, sf_dir):
    t = d.stored(spark, sf_dir)
    valid = admission.validate_engagement(d.beacons(spark, sf_dir))
    done = star.apply_engagement(t["views"].drop("day"), valid, t["resource_uris"])
    return done.select("id", "duration", "scroll_depth")


# --- E: rollups --------------------------------------------------------------------------------------


@query("E1_rollup_pages")
@with_range
def _(t, *_):
    rows = rollups.rollup_pages(t["views"], t["sessions"])
    return rows.join(t["resource_uris"].select(F.col("id").alias("resource_uri_id"), "uri"), "resource_uri_id").drop("resource_uri_id")


@query("E2_rollup_totals")
@with_range
def _(t, *_):
    return rollups.rollup_totals(t["views"], t["sessions"])


@query("E3_rollup_range")
@with_range
def _(t, first, last, _):
    later = str(date.fromisoformat(last) + timedelta(days=3))
    return rollups.rollup_range(t["views"], t["sessions"], first, later)


def _gappy(t):
    return t["summary_totals"].filter(F.dayofmonth("date") % 7 != 3)


@query("E4_missing_days")
@with_range
def _(t, first, last, _):
    return rollups.missing_days(_gappy(t), last)


@query("E5_refresh")
def _(spark, sf_dir):
    t, (_, last, _) = d.stored(spark, sf_dir), d.clock(spark, sf_dir)
    path = session.new_path(spark, "refresh")
    gappy = _gappy(t)
    tables.write_rollup(gappy, path)
    _, fresh = rollups.refresh(t["views"], t["sessions"], gappy, last)
    tables.write_rollup(fresh, path)
    return tables.read_rollup(spark, path, "summary_totals")


@query("E5_refresh_pages")
@with_range
def _(t, first, last, _):
    pages, _totals = rollups.refresh(t["views"], t["sessions"], _gappy(t), last)
    return pages.join(t["resource_uris"].select(F.col("id").alias("resource_uri_id"), "uri"), "resource_uri_id").drop("resource_uri_id")


# --- F: reports --------------------------------------------------------------------------------------


@query("F1_summary_daily")
@with_range
def _(t, first, last, _):
    return reports.summary_daily(t, first, last, last)


@query("F2_summary_totals")
@with_range
def _(t, first, last, _):
    return reports.summary_totals(t, first, last, last)


@query("F3_top_pages")
@with_range
def _(t, first, last, _):
    return reports.top_pages(t, first, last, last, limit=None)


@query("F3_top_pages_second")
@with_range
def _(t, first, last, _):
    """A page of the report: ranks 6 to 25."""
    return reports.top_pages(t, first, last, last, limit=20, offset=5)


@query("F3_top_pages_replace")
@with_range
def _(t, first, last, _):
    return reports.top_pages(t, first, last, last, None, merge="replace")


@query("F4_entry_pages")
@with_range
def _(t, first, last, _):
    return reports.entry_pages(t, first, last, None)


@query("F5_exit_pages")
@with_range
def _(t, first, last, _):
    return reports.exit_pages(t, first, last, None)


@query("F6_sources")
@with_range
def _(t, first, last, _):
    return reports.sources(t, first, last, None)


@query("F7_sources_by_channel")
@with_range
def _(t, first, last, _):
    """The nested sources are laid out one per row."""
    nested = reports.sources_by_channel(t, first, last)
    flat = nested.select(
        "channel", F.col("visitors").alias("channel_visitors"), F.col("sessions").alias("channel_sessions"),
        F.col("views").alias("channel_views"), F.explode("sources").alias("s"),
    )
    return flat.select("*", "s.*").drop("s")


for _name, _report in {
    "F8_dim_countries": reports.dim_countries, "F9_dim_cities": reports.dim_cities, "F10_dim_browsers": reports.dim_browsers,
    "F11_dim_os": reports.dim_os, "F12_dim_devices": reports.dim_devices, "F13_dim_languages": reports.dim_languages,
    "F14_utm_campaigns": reports.utm_campaigns, "F15_events_list": reports.events_list,
}.items():
    query(_name)(with_range(lambda t, first, last, _, f=_report: f(t, first, last, None)))


@query("F16_event_daily")
@with_range
def _(t, first, last, _):
    return reports.event_daily(t, "purchase_now", first, last)


@query("F17_event_properties")
@with_range
def _(t, first, last, _):
    return reports.event_properties(t, "click_now", first, last)


@query("F17_event_properties_all")
@with_range
def _(t, first, last, _):
    return reports.event_properties(t, "view_now", first, last)


@query("F18_active_visitors")
@with_range
def _(t, first, last, now):
    return reports.active_visitors(t, now)


@query("F19_active_pages")
@with_range
def _(t, first, last, now):
    return reports.active_pages(t, now, limit=10)


@query("F20_recent_feed")
@with_range
def _(t, first, last, now):
    return reports.recent_feed(t, now, limit=20)


@query("F18_active_visitors_day")
@with_range
def _(t, first, last, now):
    return reports.active_visitors(t, now, 86400)


@query("F19_active_pages_day")
@with_range
def _(t, first, last, now):
    return reports.active_pages(t, now, 86400, None)


@query("F20_recent_feed_day")
@with_range
def _(t, first, last, now):
    return reports.recent_feed(t, now, 86400, None)


for _freq in ("daily", "weekly", "monthly"):
    query(f"F21_report_totals_{_freq}")(with_range(lambda t, first, last, _, q=_freq: reports.report_totals(t, q, _report_day(last, q))))


def _report_day(last: str, frequency: str) -> str:
    """Monthly reports run in the following month, so that the events lie in the month before."""
    day = date.fromisoformat(last)
    return str((day.replace(day=1) + timedelta(days=40)).replace(day=2)) if frequency == "monthly" else last


@query("F22_report_top_pages")
@with_range
def _(t, first, last, _):
    return reports.report_top_pages(t, "weekly", last, 10)


@query("F22_report_all_pages")
@with_range
def _(t, first, last, _):
    return reports.report_top_pages(t, "weekly", last, None)


@query("F25_kpi_compare")
@with_range
def _(t, first, last, _):
    return reports.kpi_compare(t, "7d", last)


@query("F26_page_avg_duration")
@with_range
def _(t, first, last, _):
    pages = reports.page_avg_duration(reports.top_pages(t, first, last, last, None))
    return pages.select("uri", "visitors", F.round("avg_duration", 6).alias("avg_duration"))


@query("F27_bot_vs_human")
@with_range
def _(t, first, last, _):
    """Devices of bots are named after the user agent, as the device report does."""
    devices = reports.dim_devices(t, first, last, None).withColumn("name", F.when(F.col("name") == "Tablet", "Bot").otherwise(F.col("name")))
    return reports.bot_vs_human(devices)


@query("F28_with_share")
@with_range
def _(t, first, last, _):
    return reports.with_share(reports.dim_os(t, first, last, None).select("name", F.col("visitors").alias("value")))


@query("F29_with_bar_ratio")
@with_range
def _(t, first, last, _):
    rows = reports.with_bar_ratio(reports.sources(t, first, last, None), "visitors", "sessions")
    return rows.select("channel", "name", "domain", F.round("visitors_width", 6).alias("visitors_width"), F.round("sessions_width", 6).alias("sessions_width"))


@query("F30_sort_rows")
@with_range
def _(t, first, last, _):
    return reports.sort_rows(reports.dim_cities(t, first, last, None), "sessions", "asc")


# --- G: lifecycle ------------------------------------------------------------------------------------


@query("G1_export_user")
def _(spark, sf_dir):
    """Session exports of all users at once; ``export_user`` is the same for one of them."""
    t = d.stored(spark, sf_dir)
    return lifecycle.export_sessions(t["sessions"], t["views"], t["resource_uris"]).drop("session_id")


@query("G2_erase_user")
def _(spark, sf_dir):
    t = d.stored(spark, sf_dir)
    left = lifecycle.erase_user(t["sessions"], 7)
    return left.select("user_id", "visitor_id", F.lower(F.hex("ip_hash")).alias("ip_hash"), "started_at", "total_views")


@query("G3_purge_orders")
def _(spark, sf_dir):
    kept = lifecycle.purge(d.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate", "delete", 365, "1999-06-01")
    return kept.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("key_sum"))


@query("G3_purge_all")
@with_range
def _(t, first, last, _):
    day = str(date.fromisoformat(last) + timedelta(days=18))
    return lifecycle.table_stats(lifecycle.purge_all(t, "delete", 30, day))


@query("G5_archive_month")
@with_range
def _(t, first, last, _):
    return lifecycle.archive_month(t["summary_totals"], last[:7])


@query("G6_seal_archive")
@with_range
def _(t, first, last, _):
    key = b"0123456789abcdef0123456789abcdef"
    return lifecycle.open_archive(lifecycle.seal_archive(lifecycle.archive_month(t["summary_totals"], first[:7]), key), key)


@query("G7_audit_raw_ips")
def _(spark, sf_dir):
    rows = d.raw_events(spark, sf_dir).select("remote_addr", "user_agent", "page_url", "pvid", "x_forwarded_for", "resource_type")
    return lifecycle.audit_raw_ips(rows)


@query("G7_audit_documents")
def _(spark, sf_dir):
    return lifecycle.audit_raw_ips(d.table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"\s+")).alias("word")))


@query("G8_table_stats")
def _(spark, sf_dir):
    names = ["region", "nation", "customer", "orders", "lineitem", "events", "pages", "conversations"]
    return lifecycle.table_stats({n: d.table(spark, sf_dir, n) for n in names})


@query("G9_freshness")
@with_range
def _(t, *_):
    return lifecycle.freshness(t["views"])


# --- H: reconciliation and page speed ------------------------------------------------------------------


@query("H1_truth_summary")
def _(spark, sf_dir):
    return reconcile.truth_summary(d.ground_truth(spark, sf_dir))


@query("H2_truth_by_page")
def _(spark, sf_dir):
    return reconcile.truth_by(d.ground_truth(spark, sf_dir), "resource_type", "resource_id", "page_url")


@query("H2_truth_by_device")
def _(spark, sf_dir):
    truth = enrich.with_device(d.ground_truth(spark, sf_dir))
    return reconcile.truth_by(truth, "device_type")


@query("H2_truth_by_channel")
def _(spark, sf_dir):
    hits = enrich.with_source(d.raw_events(spark, sf_dir), d.SITE_HOST)
    return reconcile.truth_by(hits.select(F.col("channel").alias("expected_channel"), F.col("user_id").alias("profile_id")), "expected_channel")


@query("H3_compare_counts")
@with_range
def _(t, first, last, _):
    return reconcile.compare_counts(t["views"], t["sessions"], first, last)


@query("H4_reconcile")
def _(spark, sf_dir):
    keys = ["page_url"]
    truth = reconcile.truth_by(d.ground_truth(spark, sf_dir), *keys)
    recorded = d.raw_events(spark, sf_dir).filter("page_url <> '/click/3'").groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    both = reconcile.reconcile(truth, recorded, keys)
    return both.withColumns({c: F.round(c, 6) for c in ("accuracy", "correlation")})


@query("H5_consistency_checks")
@with_range
def _(t, first, last, _):
    return reconcile.consistency_checks(
        reports.summary_totals(t, first, last, last),
        reports.top_pages(t, first, last, last, None),
        reports.sources(t, first, last, None),
        {"countries": reports.dim_countries(t, first, last, None), "devices": reports.dim_devices(t, first, last, None)},
    )


@query("H6_vitals_summary")
def _(spark, sf_dir):
    return reconcile.vitals_summary(d.vitals(spark, sf_dir))


def _runs(spark, sf_dir, half: int | None = None):
    samples = d.vitals(spark, sf_dir)
    if half is not None:  # two batches of runs
        samples = samples.filter(F.substring("run_id", 4, 1).cast("int") % 2 == half)
    return reconcile.vitals_summary(samples)


@query("H7_aggregate_runs")
def _(spark, sf_dir):
    return reconcile.aggregate_runs(_runs(spark, sf_dir)).withColumn("runs_p50", F.array_join(F.col("runs_p50").cast("array<string>"), ","))


@query("H8_deltas")
def _(spark, sf_dir):
    return reconcile.deltas(reconcile.aggregate_runs(_runs(spark, sf_dir)))


@query("H8_impact_scores")
def _(spark, sf_dir):
    return reconcile.impact_scores(reconcile.deltas(reconcile.aggregate_runs(_runs(spark, sf_dir))))


@query("H9_noise_floor")
def _(spark, sf_dir):
    return reconcile.noise_floor(_runs(spark, sf_dir))


@query("H9_noise_band")
def _(spark, sf_dir):
    return reconcile.noise_band(reconcile.noise_floor(_runs(spark, sf_dir)))


@query("H9_within_noise")
def _(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    marked = reconcile.within_noise(reconcile.deltas(reconcile.aggregate_runs(runs)), reconcile.noise_floor(runs))
    return marked.select("config", "vital", "delta", "floor", "within_noise")


@query("H10_rank_configs")
def _(spark, sf_dir):
    return reconcile.rank_configs(reconcile.impact_scores(reconcile.deltas(reconcile.aggregate_runs(_runs(spark, sf_dir)))))


@query("H11_compare_batches")
def _(spark, sf_dir):
    sides = []
    for half in (0, 1):
        runs = _runs(spark, sf_dir, half)
        if half:
            runs = runs.filter("config <> 'error'")
        changes = reconcile.deltas(reconcile.aggregate_runs(runs))
        sides += [changes, reconcile.impact_scores(changes), reconcile.noise_floor(runs)]
    compared = reconcile.compare_batches(*sides)
    return compared.withColumns({f"{v}_change": F.round(f"{v}_change", 6) for v in ("lcp", "ttfb", "fcp", "score")})


@query("H12_network_stats")
def _(spark, sf_dir):
    return reconcile.network_stats(d.responses(spark, sf_dir))


# --- I: streaming ----------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    """The given events as a stream of hits."""
    events = runner.file_stream(spark, sf_dir, "events.parquet", d.table(spark, sf_dir, "events").schema)
    return d.as_hits(events.withColumn("ts", F.col("ts").cast("timestamp")))


@query("I1_stream_active_visitors")
def _(spark, sf_dir):
    return runner.run(jobs.stream_active_visitors(runner.with_end(_stream(spark, sf_dir))), "active")


@query("I2_stream_daily_totals")
def _(spark, sf_dir):
    return runner.run(jobs.stream_daily_totals(runner.with_end(_stream(spark, sf_dir))), "daily")


@query("I3_stream_sessions_gap")
def _(spark, sf_dir):
    return runner.run(jobs.stream_sessions_gap(runner.with_end(_stream(spark, sf_dir))), "gap")


@query("I4_stream_sessions_anchored")
def _(spark, sf_dir):
    return runner.run(jobs.stream_sessions_anchored(runner.with_end(_stream(spark, sf_dir))), "anchored")


@query("I5_stream_dedup")
def _(spark, sf_dir):
    doubled = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return runner.run(jobs.stream_dedup(doubled.drop("copy"), ["pvid"]), "dedup").select("view_id", "pvid")


@query("I6_stream_engagement")
def _(spark, sf_dir):
    """Every third view gets two beacons, of which the later one counts; the others have none."""
    hits = _stream(spark, sf_dir)
    sent = _stream(spark, sf_dir).filter("view_id % 3 = 0").withColumn("nth", F.explode(F.array(F.lit(2), F.lit(1))))
    beacon = sent.select(
        "pvid", (F.col("ts") + F.make_dt_interval(secs=F.col("nth") * 10)).alias("ts"),
        (F.col("duration") + 3 - F.col("nth")).alias("engagement_time"), "scroll_depth",
    )
    return runner.run(jobs.stream_engagement(runner.with_end(hits), runner.with_end(beacon, pvid="end")), "engagement")


@query("I7_stream_rate_limit")
def _(spark, sf_dir):
    return runner.run(jobs.stream_rate_limit(runner.with_end(_stream(spark, sf_dir)), "user_id", limit=3, ttl=14400), "rate")


@query("I7_stream_rate_limit_text")
def _(spark, sf_dir):
    """Text keys, as addresses are."""
    hits = _stream(spark, sf_dir).withColumn("address", F.concat(F.lit("u"), "user_id"))
    return runner.run(jobs.stream_rate_limit(runner.with_end(hits), "address", limit=3, ttl=14400), "rate-text")


@query("A11_stream_rollup")
def _(spark, sf_dir):
    return runner.run_totals(_stream(spark, sf_dir)).select("date", "visitors", "sessions", "views", "total_duration", "bounces")


@query("A11_stream_star")
def _(spark, sf_dir):
    return _star_rows(d.streamed(spark, sf_dir))
