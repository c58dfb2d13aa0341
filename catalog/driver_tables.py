"""The given tables seen as web traffic: page hits, clicks, beacons, samples and imports.

Each view below has a twin in ``catalog.oracle_views`` written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import session
from footfall.functions.identity import hmac_sha256
from footfall.functions.text import literals
from footfall.operators import enrich, rollups, sessionize, star
from footfall.plans import ingest
from footfall.sources import tables
from footfall.streaming import runner, sinks

SITE_HOST = "shop.test"
SECRET = b"not-a-real-secret"

REFERRERS = [
    "https://www.google.com/search?q=a", "https://www.bing.com/", "https://duckduckgo.com",
    "https://www.facebook.com/p/1", "https://t.co/abc", "https://www.reddit.com/r/x",
    "https://mail.google.com/mail", "https://outlook.live.com/owa/", "https://blog.example.org/post?id=1#c",
    "", "https://shop.test/cart", "https://sub.semalt.com/x", "https://www.netflix.com/", "//cdn.partner.net/a",
    "not a url", "HTTPS://News.Board.example:443/item", "http://user:pw@portal.example.net:8080/in",
    "https://www.youtube.com/watch", "https://semalt.com",
]
QUERIES = [
    "", "utm_source=newsletter&utm_medium=email&utm_campaign=spring",
    "utm_source=google&utm_medium=cpc&utm_campaign=brand%20a", "page=2",
    "utm_source=Partner&utm_campaign=x+y&utm_source=Partner2", "utm_medium=0&utm_term=shoes",
    "utm_campaign=&ref=1", "utm_source=facebook&utm_medium=paid_social&utm_content=<b>v1</b>", "", "", "",
]
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.6099 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0.2210",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) AppleWebKit/605.1.15 Version/17.2 Safari/605.1.15",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/119.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Linux; Android 13; Tab S8) AppleWebKit/537.36 Chrome/118.0 Safari/537.36 OPR/104.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1)", "curl/8.4.0", "", "GPTBot/1.0", "Mozilla/5.0 AhrefsBot/7.0",
]
LANGUAGES = ["en-US", "de-DE", "fr-FR", "es-ES", "ja-JP", ""]
ZONES = ["Europe/Berlin", "America/New_York", "Asia/Tokyo", "UTC"]
WIDTHS = [1920, 1366, 390, 0]
HEIGHTS = [1080, 768, 844, 0]


def pick(values: list, index: Column) -> Column:
    return F.element_at(literals(values), (index % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hits(timed_events(spark, sf_dir))


def as_hits(events: DataFrame, *more: str) -> DataFrame:
    """Events as page hits, with ``more`` columns of theirs; works on a batch and on a stream."""
    user, event = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    address = F.when(user % 5 == 0, F.concat_ws(".", F.lit("10.0"), user % 256, event % 250)).otherwise(
        F.concat_ws(".", 20 + F.floor(user / 65536) % 80, F.floor(user / 256) % 256, user % 256, event % 250)
    )
    return events.select(
        event.alias("view_id"),
        "ts",
        F.date_trunc("second", "ts").alias("viewed_at"),
        "user_id",
        user.alias("visitor_id"),
        F.col("event_type").alias("resource_type"),
        (k % 10).alias("resource_id"),
        k.alias("k"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), k % 10).alias("page_url"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), k % 10).alias("uri"),
        pick(QUERIES, event).alias("page_query"),
        pick(REFERRERS, event).alias("referrer"),
        pick(AGENTS, user).alias("user_agent"),
        pick(LANGUAGES, user).alias("language"),
        pick(ZONES, user).alias("timezone"),
        pick(WIDTHS, user).alias("screen_width"),
        pick(HEIGHTS, user).alias("screen_height"),
        F.lpad(F.hex(event), 16, "0").alias("pvid"),
        F.floor("value").cast("long").alias("duration"),
        k.cast("int").alias("scroll_depth"),
        F.when(event % 7 == 0, F.lit("unknown")).alias("cf_connecting_ip"),
        F.when(event % 3 == 0, F.concat(address, F.lit(", 172.16.0.9"))).alias("x_forwarded_for"),
        F.lit(None).cast("string").alias("x_real_ip"),
        address.alias("remote_addr"),
        F.when(event % 11 == 0, F.lit("1")).otherwise(F.lit("")).alias("dnt"),
        F.when(event % 13 == 0, F.lit("1")).otherwise(F.lit("")).alias("sec_gpc"),
        (event % 2 == 0).alias("consent_granted"),
        F.when(user % 4 == 0, F.array(F.lit("editor"), F.lit("author"))).otherwise(F.array(F.lit("reader"))).alias("user_roles"),
        "props",
        "value",
        *more,
    )


def request_bodies(hits: DataFrame) -> DataFrame:
    """Hits as raw requests: a JSON body per hit, with some broken in every way a check looks for."""
    event = F.col("view_id")
    signature = hmac_sha256(F.concat_ws("|", "resource_type", F.col("resource_id").cast("string")), SECRET)
    fields = [
        F.concat(F.lit('{"resource_type":"'), F.when(event % 17 == 3, F.lit("")).otherwise(F.col("resource_type"))),
        F.concat(F.lit('","resource_id":'), F.col("resource_id")),
        F.concat(F.lit(',"page_url":"'), F.when(event % 19 == 5, F.lit("https://evil.test/")).otherwise(F.lit("")), "page_url", F.lit('"')),
        F.when(event % 23 == 7, F.lit(',"extra":1')).otherwise(F.lit("")),
        F.concat(F.lit(',"signature":"'), F.when(event % 31 == 1, F.lit("00")).otherwise(F.lit("")), signature, F.lit('"}')),
    ]
    body = F.when(event % 29 == 11, F.lit("not json")).when(event % 37 == 2, F.repeat(F.lit("x"), 8200)).otherwise(F.concat(*fields))
    kind = F.when(event % 41 == 4, F.lit("text/html")).when(event % 2 == 0, F.lit("Text/Plain; charset=utf-8")).otherwise(
        F.lit("application/json")
    )
    return hits.withColumns({"body": body, "content_type": kind, "signature": F.get_json_object(body, "$.signature")})


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country and continent of each customer, who stands for a visitor."""
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("N"), "n_nationkey").alias("country_code"),
        F.col("n_name").alias("country_name"),
        F.concat(F.lit("R"), "r_regionkey").alias("continent_code"),
        F.col("r_name").alias("continent"),
        F.concat(F.lit("City "), F.col("c_custkey") % 40).alias("city_name"),
        F.lit("").alias("region_code"),
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One /24 per customer, except for every third one."""
    c = F.col("user_id")
    base = F.concat_ws(".", 20 + F.floor(c / 65536) % 80, F.floor(c / 256) % 256, c % 256)
    return places(spark, sf_dir).filter(c % 3 != 1).select(
        F.concat(base, F.lit(".0")).alias("ip_from"), F.concat(base, F.lit(".255")).alias("ip_to"),
        "country_code", "country_name", "city_name", "region_code", "continent_code", "continent",
    )


def described(located: DataFrame) -> DataFrame:
    """Source, device, visitor and keys of hits whose place is known."""
    staged = enrich.with_device(enrich.with_source(located, SITE_HOST))
    return star.resolve_fks(
        staged.withColumn("visitor_hash", F.substring(F.unhex(F.sha2(F.col("user_id").cast("string"), 256)), 1, 8))
    )


def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(raw_events(spark, sf_dir).join(places(spark, sf_dir), "user_id", "left"))


def sessionized_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and places first, the rest after: so the joins move only the columns of the given table."""
    owned = sessionize.sessionize_anchored(timed_events(spark, sf_dir), "user_id", "ts")
    where = places(spark, sf_dir)
    return described(as_hits(owned.join(where, "user_id", "left"), "started_at", "session_id", *where.drop("user_id").columns))


def resources_of(hits: DataFrame) -> DataFrame:
    """Resources with a title, each kept twice, as repeated rows must not multiply a report."""
    rows = star.build_resources(hits)
    copies = rows.withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return copies.select(
        "id", "resource_type", "resource_id",
        F.concat(F.lit("Title "), "copy", F.lit(" "), "resource_id").alias("cached_title"),
    )


def custom_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as custom events with mixed property types."""
    k = F.get_json_object("props", "$.k")
    props = F.concat(
        F.lit('{"k": '), k, F.lit(', "label": "<b>'), "event_type", F.lit('</b> ", "ok": true, "": 1, "none": null, "size": '),
        F.col("event_id") % 3, F.lit('.5, "late": 1}'),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("user_id").alias("visitor_id"),
        F.concat(F.lit(" "), "event_type", F.lit("  now! ")).alias("event_name"),
        F.when(F.col("event_id") % 9 == 0, F.lit('{"flag": false}')).otherwise(props).alias("properties"),
    )


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement beacons: by page-visit id, by URL and by resource, some of them empty."""
    hits = raw_events(spark, sf_dir)
    event = F.col("view_id")
    third = event % 3
    return hits.select(
        (F.col("viewed_at") + F.expr("INTERVAL 20 SECONDS")).alias("ts"),
        F.when(third == 0, F.col("pvid")).when(event % 50 == 1, F.lit("0123456789abcdefX")).otherwise(F.lit("")).alias("pvid"),
        F.when(third == 1, F.col("page_url")).otherwise(F.lit("")).alias("page_url"),
        "resource_id",
        F.when(event % 10 == 0, F.lit(0)).otherwise(F.col("duration").cast("int") + 1).alias("engagement_time"),
        F.when(event % 10 == 0, F.lit(0)).otherwise((F.col("k") * 2).cast("int")).alias("scroll_depth"),
    )


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as page-speed samples; views stand for the baseline configuration."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", F.lit("baseline")).otherwise(F.col("event_type")).alias("config"),
        F.concat(F.lit("run"), F.col("user_id") % 6).alias("run_id"),
        pick(["ttfb", "fcp", "lcp", "cls", "inp"], event).alias("vital"),
        F.when(event % 5 == 3, F.col("value") / 1000).otherwise(F.col("value")).alias("value"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.floor(page / 10).cast("long").alias("load_id"),
        F.when(page % 4 == 0, F.concat(F.col("url"), F.lit("/analytics.js"))).otherwise(F.col("url")).alias("url"),
        F.length("html").cast("long").alias("size"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An independent log of the same hits, which misses some that were recorded."""
    hits = raw_events(spark, sf_dir)
    return hits.filter(F.col("view_id") % 20 != 7).select(
        F.col("user_id").alias("profile_id"), "resource_type", "resource_id", "page_url",
        (F.col("user_id") % 13 >= 8).alias("is_bot"), (F.col("user_id") % 4 == 0).alias("is_logged_in"),
        F.col("viewed_at").alias("recorded_at"), "user_agent",
    )


def foreign_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("last_counter")).agg(
        F.count(F.lit(1)).alias("visit")
    )


# --- the stored star: each table written once per session and data folder, read by every report --------

STAR = [
    "visitors", "sessions", "views", "resources", "resource_uris", "parameters", "events",
    "countries", "cities", "device_types", "device_browsers", "device_browser_versions", "device_oss",
    "resolutions", "languages", "timezones", "referrers",
]
# columns of a hit that a table of the star is made of; all others stay out of the stored hits and of the shuffles before them
HIT_COLUMNS = list(dict.fromkeys([
    "view_id", "visitor_id", "visitor_hash", "user_id", "session_id", "started_at", "viewed_at", "uri", "resource_type", "resource_id",
    "duration", "scroll_depth", "pvid", "utm", *star.FOREIGN_KEYS.values(),
    *[c for keys, others, _ in star.DIMENSIONS.values() for c in (*keys, *others)],
]))
MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "visitors": star.build_visitors, "sessions": star.build_sessions, "views": star.build_views, "resources": resources_of,
    "resource_uris": star.build_resource_uris, "parameters": star.utm_parameters,
    **{name: lambda hits, name=name: star.dimension(hits, name) for name in star.DIMENSIONS},
}
ROLLUPS = {"summary": rollups.rollup_pages, "summary_totals": rollups.rollup_totals}


def build_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    return star.build_events(star.attach_sessions(events, sessions))


def build_star(hits: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """All tables of the star from sessionized, enriched hits."""
    out = {name: make(hits) for name, make in MAKERS.items()}
    return out | {"events": build_events(events, out["sessions"])}


class Stored(Mapping):
    """The star in files below the shared folder. A table is written when it is first read, from the files of the hits and of the
    tables it is made of, each once: a report waits for the tables it reads and for no others."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.path = session.new_path(spark, "star")
        self._spark, self._sf_dir = spark, sf_dir
        self._names = (*STAR, *ROLLUPS)
        self._locks = {name: Lock() for name in ("hits", *self._names)}
        self._found: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._found:
                self._found[name] = self._made(name)
            return self._found[name]

    def _made(self, name: str) -> DataFrame:
        if name == "hits":
            sessionized_hits(self._spark, self._sf_dir).select(*HIT_COLUMNS).write.mode("overwrite").parquet(f"{self.path}/hits")
            return self._spark.read.parquet(f"{self.path}/hits")
        if name in ROLLUPS:
            tables.write_rollup(ROLLUPS[name](self["views"], self["sessions"]), f"{self.path}/{name}")
            return tables.read_rollup(self._spark, f"{self.path}/{name}", name)
        made = build_events(custom_events(self._spark, self._sf_dir), self["sessions"]) if name == "events" else MAKERS[name](self["hits"])
        tables.write_star({name: made}, self.path)
        return tables.read_star(self._spark, self.path, [name])[name]

    def write(self, at_once: int = 4) -> None:
        """Write all tables. They are independent jobs but for the few that read others, so some are submitted together."""
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            list(pool.map(self.__getitem__, ("sessions", "views", *self._names)))


def write_stored(spark: SparkSession, sf_dir: str) -> str:
    """Write hits, star and rollups below the shared folder; each step reads the one before from files."""
    star_files = Stored(spark, sf_dir)
    star_files.write()
    return star_files.path


_stored: dict[tuple[str, str], Stored] = {}


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = Stored(spark, sf_dir)
    return _stored[key]


_clocks: dict[tuple[str, str], tuple[str, str, str]] = {}


def clock(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """(first day, last day, last second) of the events; the last one is "now" for every report."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _clocks:
        low, high = table(spark, sf_dir, "events").agg(
            F.min(F.col("ts").cast("timestamp")).cast("string"), F.date_trunc("second", F.max("ts")).cast("string")
        ).first()
        _clocks[key] = (low[:10], high[:10], high)
    return _clocks[key]


# --- the ingest job: requests to a star of its own -----------------------------------------------------

RULES = ingest.Rules("https://shop.test", SITE_HOST, SECRET, bots=True, urls=("/error/*",))


def salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One salt per day of the events, changed a quarter past midnight; the first one began the day before."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    first = days.agg(F.min("day").alias("day")).select(F.date_sub("day", 1).alias("day"))
    return days.unionByName(first).select(
        (F.col("day").cast("timestamp") + F.expr("INTERVAL 15 MINUTES")).alias("valid_from"),
        F.concat(F.lit("salt-"), F.col("day").cast("string")).alias("salt"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they arrive: none of the columns that the job has to find out. The narrow rows of the table are dealt out to all
    tasks first, as a file of few row groups is read by as few."""
    return request_bodies(as_hits(timed_events(spark, sf_dir).repartition("event_id"))).drop("visitor_id", "uri")


_ingested: dict[tuple[str, str], dict[str, DataFrame]] = {}


def ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star that the ingest job makes of the requests; made once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        path = session.new_path(spark, "ingested")
        _ingested[key] = ingest.ingest(requests(spark, sf_dir), path, RULES, salts(spark, sf_dir), geo_ranges(spark, sf_dir))
    return _ingested[key]


def ingested_in_two(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same star from two loads, cut at noon of a day in the middle, the second one given twice."""
    first, last, _ = clock(spark, sf_dir)
    middle = F.to_timestamp(F.date_add(F.lit(first).cast("date"), F.floor(F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) / 2).cast("int")))
    early = F.col("ts") < middle + F.expr("INTERVAL 12 HOURS")
    path, hits = session.new_path(spark, "loads"), requests(spark, sf_dir)
    job = (path, RULES, salts(spark, sf_dir), geo_ranges(spark, sf_dir))
    ingest.ingest(hits.where(early), *job)
    ingest.load_more(hits.where(~early), *job)
    return ingest.load_more(hits.where(~early), *job)


def streamed(spark: SparkSession, sf_dir: str, loads: int = 2) -> dict[str, DataFrame]:
    """The same star from a stream: requests arrive in ``loads`` parts of equal time, the last one is tried twice."""
    path, hits = session.new_path(spark, "streamed"), requests(spark, sf_dir)
    low, high = hits.agg(F.unix_seconds(F.min("ts")).alias("low"), F.unix_seconds(F.max("ts")).alias("high")).first()
    part = F.least(F.floor((F.unix_seconds("ts") - low) * loads / max(high - low, 1)), F.lit(loads - 1))
    lookups = lambda own: (salts(own, sf_dir), geo_ranges(own, sf_dir))
    for k in range(loads):
        hits.where(part == k).write.mode("append").parquet(f"{path}/arrived")
        runner.run_star(spark.readStream.schema(hits.schema).parquet(f"{path}/arrived"), path, RULES, lookups)
    again = sinks.star_batches(path, RULES, lookups)
    again(hits.where(part == loads - 1), loads - 1)  # in the manifest: skipped
    again(hits.where(part == loads - 1), loads)  # as if it had broken off before it got there
    return ingest.read(spark, path)
