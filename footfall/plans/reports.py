"""The report questions, each as one lazy plan. Clock and range are always arguments."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.identity import key_id
from footfall.operators.admission import date_range, since
from footfall.operators.rollups import rollup_pages, rollup_totals
from footfall.schemas import METRICS

Tables = Mapping[str, DataFrame]


def top(df: DataFrame, by: str, limit: int | None, *ties: str, offset: int = 0) -> DataFrame:
    """Largest first; ties by name, so that a cut-off is always the same one."""
    out = df.orderBy(F.desc(by), *[F.asc_nulls_first(t) for t in ties])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def titles(resources: DataFrame) -> DataFrame:
    """One title per resource, so that repeated resource rows never multiply a report."""
    return resources.groupBy("resource_id").agg(F.min("cached_title").alias("title"))


def named_pages(pages: DataFrame, t: Tables) -> DataFrame:
    """Adds ``uri`` and ``title`` to rows keyed by ``resource_uri_id``."""
    uris = t["resource_uris"].select(F.col("id").alias("resource_uri_id"), "uri", "resource_id")
    return pages.drop("resource_id").join(uris, "resource_uri_id").join(titles(t["resources"]), "resource_id", "left").drop("resource_id")


# --- summary ---------------------------------------------------------------------------------


def live_totals(t: Tables, day: str) -> DataFrame:
    """The totals row of one day from the raw tables; zeros when nothing happened."""
    rows = rollup_totals(date_range(t["views"], "viewed_at", day, day), date_range(t["sessions"], "started_at", day, day))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in METRICS]).select(
        F.to_date(F.lit(day)).alias("date"), *METRICS
    )


def summary_daily(t: Tables, first: str, last: str, as_of: str) -> DataFrame:
    """Stored daily totals; the live day replaces whatever is stored for it."""
    columns = ["date", *METRICS]
    stored = t["summary_totals"].filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = stored.select(*columns)
    if first <= as_of <= last:
        rows = rows.filter(F.col("date") != F.lit(as_of).cast("date")).unionByName(live_totals(t, as_of))
    return rows.orderBy("date")


def summary_totals(t: Tables, first: str, last: str, as_of: str) -> DataFrame:
    """Sums of the daily rows: a visitor counts once per day, not once per range."""
    daily = summary_daily(t, first, last, as_of)
    return daily.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in METRICS])


# --- pages -----------------------------------------------------------------------------------


def live_pages(t: Tables, day: str) -> DataFrame:
    """Page rollup of one day from the raw tables; sessions may have begun the day before."""
    before = str(date.fromisoformat(day) - timedelta(days=1))
    return rollup_pages(date_range(t["views"], "viewed_at", day, day), date_range(t["sessions"], "started_at", before, day))


def top_pages(
    t: Tables, first: str, last: str, as_of: str, limit: int | None = None, offset: int = 0, merge: str = "sum"
) -> DataFrame:
    """Pages by visitors. Today is read live and added to the stored days.

    ``merge='replace'`` drops the stored days of every page seen today instead. ``limit=None`` gives
    all pages.
    """
    wanted = ["visitors", "views", "total_duration", "bounces"]
    sums = [F.sum(c).alias(c) for c in wanted]
    stored = t["summary"].filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = stored.select("date", "resource_uri_id", *wanted)
    if first <= as_of <= last:
        live = live_pages(t, as_of).select("date", "resource_uri_id", *wanted)
        if merge == "replace":
            rows = rows.join(live.select("resource_uri_id"), "resource_uri_id", "left_anti")
        else:
            rows = rows.filter(F.col("date") != F.lit(as_of).cast("date"))
        rows = rows.unionByName(live)
    pages = rows.groupBy("resource_uri_id").agg(*sums)
    named = named_pages(pages, t).select("uri", "title", *wanted)
    return top(named, "visitors", limit, "uri", "title", offset=offset)


def _end_pages(t: Tables, first: str, last: str, limit: int | None, pick) -> DataFrame:
    """First or last view of each session inside the range, counted per page.

    ``min_by``/``max_by`` combine on the map side; a row number would sort every view.
    """
    ends = date_range(t["views"], "viewed_at", first, last).groupBy("session_id").agg(
        pick("resource_uri_id", F.struct("viewed_at", "id")).alias("resource_uri_id")
    )
    counted = ends.groupBy("resource_uri_id").agg(F.count(F.lit(1)).alias("count"))
    named = named_pages(counted, t).select("uri", "title", "count", F.col("count").alias("visitors"))
    return top(named, "count", limit, "uri", "title")


def entry_pages(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    return _end_pages(t, first, last, limit, F.min_by)


def exit_pages(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    return _end_pages(t, first, last, limit, F.max_by)


def page_avg_duration(pages: DataFrame) -> DataFrame:
    """Page time per visitor; NULL without visitors."""
    return pages.withColumn("avg_duration", F.try_divide(F.col("total_duration"), F.col("visitors")))


# --- sources ---------------------------------------------------------------------------------


def _by_referrer(t: Tables, first: str, last: str) -> DataFrame:
    """(referrer_id, visitor_id) grain with sessions and views; no source counts as Direct."""
    direct = key_id(F.lit("Direct"), F.lit(""))
    rows = date_range(t["sessions"], "started_at", first, last)
    return rows.groupBy(F.coalesce("referrer_id", direct).alias("id"), "visitor_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("total_views").alias("views")
    )


def _labels(t: Tables) -> DataFrame:
    return t["referrers"].select("id", "channel", "name", "domain")


def _source_labels() -> list[Column]:
    return [
        F.coalesce("channel", F.lit("Direct")).alias("channel"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("domain", F.lit("")).alias("domain"),
    ]


def _counts() -> list[Column]:
    return [F.count("visitor_id").alias("visitors"), F.sum("sessions").alias("sessions"), F.sum("views").alias("views")]


def sources(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    """Channel, name and domain by visitors. Sessions are counted by id first, named after."""
    counted = _by_referrer(t, first, last).groupBy("id").agg(*_counts())
    named = counted.join(_labels(t), "id", "left").select(*_source_labels(), "visitors", "sessions", "views")
    return top(named, "visitors", limit, "channel", "name", "domain")


def sources_by_channel(t: Tables, first: str, last: str, per_channel: int | None = None) -> DataFrame:
    """Channel totals with true distinct visitors, and each channel's sources, or the leading ones, nested in."""
    from pyspark.sql import Window

    grain = _by_referrer(t, first, last)
    labels = _labels(t)
    channel = F.coalesce("channel", F.lit("Direct")).alias("channel")
    per_visitor = (
        grain.join(labels.select("id", "channel"), "id", "left")
        .groupBy(channel, "visitor_id")
        .agg(F.sum("sessions").alias("sessions"), F.sum("views").alias("views"))
    )
    totals = per_visitor.groupBy("channel").agg(*_counts())
    detail = grain.groupBy("id").agg(*_counts()).join(labels, "id", "left").select(
        *_source_labels(), "visitors", "sessions", "views"
    )
    order = Window.partitionBy("channel").orderBy(F.desc("visitors"), "name", "domain")
    item = F.struct("rank", "name", "domain", "visitors", "sessions", "views")
    ranked = detail.withColumn("rank", F.row_number().over(order))
    if per_channel is not None:
        ranked = ranked.filter(F.col("rank") <= per_channel)
    leading = ranked.groupBy("channel").agg(F.sort_array(F.collect_list(item)).alias("sources"))
    return top(totals.join(leading, "channel", "left"), "visitors", None, "channel")


# --- dimensions ------------------------------------------------------------------------------


def breakdown(
    t: Tables, dim: str, key: str, labels: Sequence[Column], first: str, last: str, limit: int | None = None
) -> DataFrame:
    """Visitors and sessions per row of a dimension; sessions without a value are left out."""
    rows = date_range(t["sessions"], "started_at", first, last).filter(F.col(key).isNotNull())
    counted = rows.groupBy(F.col(key).alias("id")).agg(
        F.count_distinct("visitor_id").alias("visitors"), F.count(F.lit(1)).alias("sessions")
    )
    named = counted.join(t[dim], "id").select(*labels, "visitors", "sessions")
    return top(named, "visitors", limit, *[c for c in named.columns if c not in ("visitors", "sessions")])


def dim_countries(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    return breakdown(t, "countries", "country_id", [F.col("code"), F.col("name"), F.col("continent_code")], first, last, limit)


def dim_cities(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    countries = t["countries"].select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    cities = t["cities"].join(countries, "country_id", "left")
    return breakdown(ChainMap({"cities": cities}, t), "cities", "city_id", [F.col("city_name"), F.col("country")], first, last, limit)


def _dim_named(dim: str, key: str, label: str = "name"):
    def report(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
        return breakdown(t, dim, key, [F.col(label).alias("name")], first, last, limit)

    return report


dim_browsers = _dim_named("device_browsers", "device_browser_id")
dim_os = _dim_named("device_oss", "device_os_id")
dim_devices = _dim_named("device_types", "device_type_id")
dim_languages = _dim_named("languages", "language_id", "code")
dim_timezones = _dim_named("timezones", "timezone_id")


# --- campaigns and events ----------------------------------------------------------------------


def utm_campaigns(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    """Campaign, source and medium per session, then distinct visitors and sessions per tuple."""
    names = {"campaign": "utm_campaign", "source": "utm_source", "medium": "utm_medium"}
    per_session = (
        t["parameters"]
        .filter(F.col("param_key").isin(*names.values()))
        .groupBy("session_id")
        .agg(*[F.max(F.when(F.col("param_key") == k, F.col("param_value"))).alias(n) for n, k in names.items()])
    )
    hub = date_range(t["sessions"], "started_at", first, last).select(F.col("id").alias("session_id"), "visitor_id")
    tuples = hub.join(per_session, "session_id").groupBy(*names)
    counted = tuples.agg(F.count_distinct("visitor_id").alias("visitors"), F.count(F.lit(1)).alias("sessions"))
    return top(counted, "visitors", limit, *names)


def events_list(t: Tables, first: str, last: str, limit: int | None = None) -> DataFrame:
    counted = date_range(t["events"], "created_at", first, last).groupBy("event_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("session_id").alias("sessions")
    )
    return top(counted, "total", limit, "event_name")


def event_daily(t: Tables, name: str, first: str, last: str) -> DataFrame:
    rows = date_range(t["events"].filter(F.col("event_name") == name), "created_at", first, last)
    return rows.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("total")).orderBy("date")


def event_properties(
    t: Tables, name: str, first: str, last: str, sample: int | None = None, limit: int | None = None
) -> DataFrame:
    """``key=value`` counts over all payloads, or the newest ``sample`` of them."""
    rows = date_range(t["events"], "created_at", first, last).filter(
        (F.col("event_name") == name) & F.col("event_data").isNotNull()
    )
    if sample is not None:
        rows = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(sample)
    pairs = rows.select(F.explode(F.from_json("event_data", "map<string,string>")).alias("key", "value"))
    counted = pairs.groupBy(F.concat_ws("=", "key", F.coalesce("value", F.lit(""))).alias("property")).agg(
        F.count(F.lit(1)).alias("total")
    )
    return top(counted, "total", limit, "property")


# --- live ------------------------------------------------------------------------------------


def _live_views(t: Tables, as_of_ts: str, window: int, *columns: str) -> DataFrame:
    """Views of the last ``window`` seconds with columns of their sessions.

    A view lies at most half an hour after its session start, so sessions more than a day older
    need not be read.
    """
    start = F.to_timestamp(F.lit(as_of_ts)) - F.make_dt_interval(secs=F.lit(window))
    recent = since(t["sessions"], "started_at", start - F.expr("INTERVAL 1 DAY"))
    hub = recent.select(F.col("id").alias("session_id"), *columns)
    return since(t["views"], "viewed_at", start).join(hub, "session_id")


def active_visitors(t: Tables, as_of_ts: str, window: int = 300) -> DataFrame:
    live = _live_views(t, as_of_ts, window, "visitor_id")
    return live.agg(F.count_distinct("visitor_id").alias("active_visitors"))


def active_pages(t: Tables, as_of_ts: str, window: int = 300, limit: int | None = None) -> DataFrame:
    live = _live_views(t, as_of_ts, window, "visitor_id")
    counted = live.groupBy("resource_uri_id").agg(F.count_distinct("visitor_id").alias("visitors"))
    named = named_pages(counted, t).select("uri", F.coalesce("title", F.lit("")).alias("title"), "visitors")
    return top(named, "visitors", limit, "uri", "title")


def recent_feed(t: Tables, as_of_ts: str, window: int = 300, limit: int | None = None) -> DataFrame:
    """Newest views of the window with title, country and browser."""
    newest = _live_views(t, as_of_ts, window, "country_id", "device_browser_id").orderBy(F.desc("viewed_at"), F.desc("id"))
    full = newest if limit is None else newest.limit(limit)
    countries = t["countries"].select(F.col("id").alias("country_id"), F.col("code").alias("country"))
    browsers = t["device_browsers"].select(F.col("id").alias("device_browser_id"), F.col("name").alias("browser"))
    named = named_pages(full, t).join(countries, "country_id", "left").join(browsers, "device_browser_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return named.orderBy(F.desc("viewed_at"), F.desc("id")).select("uri", empty("title"), empty("country"), empty("browser"), F.col("viewed_at").alias("time"))


# --- periodic report ---------------------------------------------------------------------------


def report_period(frequency: str, as_of: str) -> tuple[str, str]:
    """daily: yesterday; weekly: the seven days to yesterday; monthly: the previous calendar month."""
    day = date.fromisoformat(as_of)
    yesterday = day - timedelta(days=1)
    if frequency == "daily":
        return str(yesterday), str(yesterday)
    if frequency == "monthly":
        end = day.replace(day=1) - timedelta(days=1)
        return str(end.replace(day=1)), str(end)
    return str(day - timedelta(days=7)), str(yesterday)


def report_totals(t: Tables, frequency: str, as_of: str) -> DataFrame:
    first, last = report_period(frequency, as_of)
    rows = t["summary_totals"].filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.agg(*[F.sum(c).alias(c) for c in ("visitors", "sessions", "views", "bounces")])


def report_top_pages(t: Tables, frequency: str, as_of: str, limit: int | None = None) -> DataFrame:
    first, last = report_period(frequency, as_of)
    rows = t["summary"].filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    pages = rows.groupBy("resource_uri_id").agg(F.sum("visitors").alias("visitors"), F.sum("views").alias("views"))
    uris = t["resource_uris"].select(F.col("id").alias("resource_uri_id"), "uri")
    return top(pages.join(uris, "resource_uri_id").select("uri", "visitors", "views"), "visitors", limit, "uri")


# --- derived figures ---------------------------------------------------------------------------


def resolve_range(name: str, as_of: str) -> tuple[str, str]:
    day = date.fromisoformat(as_of)
    if name == "7d":
        return str(day - timedelta(days=6)), as_of
    if name == "30d":
        return str(day - timedelta(days=29)), as_of
    if name == "this-month":
        return str(day.replace(day=1)), as_of
    if name == "last-month":
        end = day.replace(day=1) - timedelta(days=1)
        return str(end.replace(day=1)), str(end)
    return as_of, as_of


def previous_range(first: str, last: str) -> tuple[str, str]:
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    before = start - timedelta(days=1)
    return str(before - (end - start)), str(before)


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(
        (now - before) / before * 100
    )


def kpi_compare(t: Tables, range_name: str | tuple[str, str], as_of: str) -> DataFrame:
    """Current and previous totals side by side, from one pass over the daily rows."""
    first, last = resolve_range(range_name, as_of) if isinstance(range_name, str) else range_name
    prev_first, prev_last = previous_range(first, last)
    daily = summary_daily(t, prev_first, last, as_of)
    now = F.col("date") >= F.lit(first).cast("date")
    sums = daily.agg(
        *[F.coalesce(F.sum(F.when(now, F.col(c))), F.lit(0)).alias(c) for c in METRICS],
        *[F.coalesce(F.sum(F.when(~now, F.col(c))), F.lit(0)).alias(f"prev_{c}") for c in METRICS],
    )
    per_session = lambda p: F.coalesce(F.try_divide(F.col(f"{p}total_duration"), F.col(f"{p}sessions")), F.lit(0.0))
    full = sums.withColumns({"avg_duration": per_session(""), "prev_avg_duration": per_session("prev_")})
    changes = {f"{c}_change": percent_change(F.col(c), F.col(f"prev_{c}")) for c in ("visitors", "sessions", "views")}
    changes["avg_duration_change"] = F.when(
        F.col("prev_avg_duration") > 0, percent_change(F.col("avg_duration"), F.col("prev_avg_duration"))
    )
    return full.withColumns(changes)


def bot_vs_human(devices: DataFrame) -> DataFrame:
    """Visitors of the device report split on the name ``Bot``."""
    bot = F.when(F.col("name") == "Bot", F.lit("Bot")).otherwise(F.lit("Human"))
    both = devices.select(bot.alias("name"), F.col("visitors"))
    empty = devices.sparkSession.createDataFrame([("Human", 0), ("Bot", 0)], "name string, visitors long")
    return both.unionByName(empty).groupBy("name").agg(F.sum("visitors").alias("value"))


def human_devices(devices: DataFrame) -> DataFrame:
    return devices.filter(F.coalesce(F.col("name") != "Bot", F.lit(True))).select(
        F.coalesce("name", F.lit("Unknown")).alias("name"), F.col("visitors").alias("value")
    )


def half_up(c: Column, digits: int) -> Column:
    """Round half towards plus infinity, as the dashboard does."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def with_share(df: DataFrame, value: str = "value") -> DataFrame:
    """Percent of the column's total, one decimal. The total is a scalar subquery: one aggregate, no window."""
    total = df.agg(F.sum(value).alias("total")).scalar()
    staged = df.withColumn("_total", total)
    share = F.when(F.col("_total") > 0, half_up(F.col(value) / F.col("_total") * 100, 1)).otherwise(F.lit(0.0))
    return staged.withColumn("share", share).drop("_total")


def with_bar_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both columns as percent of the largest value of either (at least 1)."""
    largest = df.agg(F.greatest(F.max(F.greatest(a, b)), F.lit(1)).alias("most")).scalar()
    staged = df.withColumn("_most", largest)
    return staged.withColumns(
        {f"{c}_width": F.col(c) / F.col("_most") * 100 for c in (a, b)}
    ).drop("_most")


def sort_rows(df: DataFrame, key: str, direction: str = "desc") -> DataFrame:
    """Order by any column; the others break ties."""
    ends = F.asc_nulls_first if direction == "asc" else F.desc_nulls_last
    return df.orderBy(ends(key), *[F.asc(c) for c in df.columns if c != key])
