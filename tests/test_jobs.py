"""Jobs on small tables: sessions, rollups, retention, skew, plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalog import driver_tables as d
from footfall.operators import admission, rollups, sessionize, star
from footfall.plans import lifecycle, reconcile, reports
from footfall.session import is_small, new_path
from footfall.sources import daily, tables

START = datetime(2024, 1, 1)


def hits(spark, rows):
    """(visitor, second) rows as hits."""
    data = [(i, v, START + timedelta(seconds=s)) for i, (v, s) in enumerate(rows)]
    return spark.createDataFrame(data, "view_id long, visitor_id long, viewed_at timestamp")


def walk(rows, timeout=1800):
    """Brute force: session start of every hit."""
    out, anchor = {}, {}
    for i, (v, s) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        if v not in anchor or s > anchor[v] + timeout:
            anchor[v] = s
        out[i] = anchor[v]
    return out


def starts(df):
    return {r.view_id: int((r.started_at - START).total_seconds()) for r in df.collect()}


def test_anchored_and_gap_sessions_differ(spark):
    rows = [(1, 0), (1, 1200), (1, 2400), (2, 0), (2, 1800), (3, 0), (3, 1801)]
    anchored = starts(sessionize.sessionize_anchored(hits(spark, rows)))
    assert anchored == {0: 0, 1: 0, 2: 2400, 3: 0, 4: 0, 5: 0, 6: 1801}
    gap = sessionize.sessionize_gap(hits(spark, rows)).groupBy("visitor_id").count()
    assert {r.visitor_id: r["count"] for r in gap.collect()} == {1: 1, 2: 1, 3: 2}


@pytest.mark.parametrize("batch", [7, 10000])
def test_busy_visitor_matches_brute_force(spark, batch):
    """One visitor sends a third of all hits; small Arrow batches cut its sessions in the middle."""
    rng = random.Random(5)
    rows = [(1, rng.randrange(40000)) for _ in range(1500)] + [(rng.randrange(2, 300), rng.randrange(90000)) for _ in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert starts(sessionize.sessionize_anchored(hits(spark, rows))) == walk(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def limited(rows, limit, ttl):
    out, state = set(), {}
    for i, (v, s) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        n, last = state.get(v, (0, None))
        if last is not None and s - last > ttl:
            n = 0
        if n >= limit:
            out.add(i)
        else:
            state[v] = (n + 1, s)
    return out


@pytest.mark.parametrize("batch", [5, 10000])
def test_rate_limit_matches_brute_force(spark, batch):
    rng = random.Random(9)
    rows = [(1, rng.randrange(3000)) for _ in range(1500)] + [(rng.randrange(2, 60), rng.randrange(4000)) for _ in range(3000)]
    rows += [(500, s) for s in (0, 60, 120)] + [(501, 0)] * 130 + [(501, 61)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        flagged = sessionize.flag_rate_limited(hits(spark, rows), "visitor_id", "viewed_at", "view_id", limit=20, ttl=60)
        assert {r.view_id for r in flagged.filter("rate_limited").collect()} == limited(rows, 20, 60)
        assert flagged.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def star_of(spark, rows):
    """views and sessions of (visitor, second, uri id, duration) rows."""
    base = hits(spark, [r[:2] for r in rows])
    extra = spark.createDataFrame([(i, r[2], r[3]) for i, r in enumerate(rows)], "view_id long, resource_uri_id long, duration long")
    views = sessionize.sessionize_anchored(base.join(extra, "view_id")).withColumnRenamed("view_id", "id")
    sessions = views.groupBy(F.col("session_id").alias("id"), "visitor_id", "started_at").agg(F.count(F.lit(1)).alias("total_views"))
    return views, sessions


def test_rollup_across_midnight(spark):
    """The page rollup follows the view's day, the site rollup the session's day."""
    late = 86400 - 60
    views, sessions = star_of(spark, [(1, late, 10, 45), (1, 86400 + 60, 11, 30), (2, 5, 10, None)])
    pages = {(str(r.date), r.resource_uri_id): (r.visitors, r.sessions, r.views, r.total_duration, r.bounces) for r in rollups.rollup_pages(views, sessions).collect()}
    assert pages == {("2024-01-01", 10): (2, 2, 2, 45, 1), ("2024-01-02", 11): (1, 1, 1, 30, 0)}
    totals = [tuple(r)[1:] for r in rollups.rollup_totals(views, sessions).collect()]
    assert totals == [(2, 2, 2, 45, 1)]
    full = rollups.rollup_range(views, sessions, "2024-01-01", "2024-01-03").orderBy("date").collect()
    assert [r.sessions for r in full] == [2, 0, 0]


def test_rollup_is_idempotent_and_replaces_by_day(spark):
    views, sessions = star_of(spark, [(1, 10, 1, 5), (2, 90000, 1, 6)])
    path = new_path(spark, "test-rollup")
    for _ in range(2):
        tables.write_rollup(rollups.rollup_totals(views, sessions), path)
    assert tables.read_rollup(spark, path, "summary_totals").count() == 2
    stale = tables.read_rollup(spark, path, "summary_totals").filter("date = '2024-01-02'").withColumn("views", F.lit(99).cast("long"))
    copy = stale.collect()
    tables.write_rollup(spark.createDataFrame(copy, stale.schema), path)
    assert {str(r.date): r.views for r in tables.read_rollup(spark, path, "summary_totals").collect()} == {"2024-01-01": 1, "2024-01-02": 99}


def test_today_is_live_and_replaces_stale_rows(spark):
    views, sessions = star_of(spark, [(1, 10, 1, 5), (2, 86400 + 5, 1, 6)])
    stored = spark.createDataFrame([("2024-01-01", 1, 1, 1, 5, 1), ("2024-01-02", 50, 50, 50, 50, 50)], "d string, visitors long, sessions long, views long, total_duration long, bounces long")
    t = {"views": views, "sessions": sessions, "summary_totals": stored.select(F.to_date("d").alias("date"), "visitors", "sessions", "views", "total_duration", "bounces")}
    rows = reports.summary_daily(t, "2024-01-01", "2024-01-02", "2024-01-02").collect()
    assert [(str(r.date), r.visitors, r.total_duration) for r in rows] == [("2024-01-01", 1, 5), ("2024-01-02", 1, 6)]
    quiet = reports.summary_daily(t, "2024-01-01", "2024-01-09", "2024-01-09").collect()
    assert tuple(quiet[-1])[1:] == (0, 0, 0, 0, 0) and len(quiet) == 3


def test_engagement_reaches_view_by_id_then_url_then_resource(spark):
    views = spark.createDataFrame(
        [(1, 7, "a"), (2, 7, "b"), (3, 8, ""), (4, 9, "c")], "id long, resource_uri_id long, pvid string"
    ).withColumns({"duration": F.lit(None).cast("long"), "scroll_depth": F.lit(None).cast("int")})
    uris = spark.createDataFrame([(7, 1, "/x"), (8, 2, "/y"), (9, 3, "/z")], "id long, resource_id long, uri string")
    beacons = spark.createDataFrame(
        [(1, "a", "", 0, 5, 10), (2, "a", "/y", 0, 9, 20), (1, "", "/x", 0, 3, 30), (1, "", "", 2, 4, 40), (1, "", "", 77, 4, 40)],
        "s int, pvid string, page_url string, resource_id long, engagement_time int, scroll_depth int",
    ).withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.duration, r.scroll_depth) for r in star.apply_engagement(views, beacons, uris).collect()}
    assert got == {1: (9, 20), 2: (3, 30), 3: (4, 40), 4: (None, None)}


def test_purge_keeps_parameters_of_kept_sessions(spark):
    ages = {1: 5, 2: 95, 3: 370}
    now = datetime(2024, 12, 31)
    sessions = spark.createDataFrame([(i, now - timedelta(days=a)) for i, a in ages.items()], "id long, started_at timestamp")
    params = spark.createDataFrame([(i,) for i in ages], "session_id long")
    for days, left in ((30, 1), (90, 1), (365, 2), (5000, 3)):
        kept = lifecycle.purge_all({"sessions": sessions, "parameters": params}, "delete", days, "2024-12-31")
        assert kept["sessions"].count() == kept["parameters"].count() == left
    assert lifecycle.purge(sessions, "started_at", "forever", 30, "2024-12-31").count() == 3
    with pytest.raises(ValueError):
        lifecycle.purge(sessions, "started_at", "delete", 1, "2024-12-31")


def test_erase_leaves_totals(spark):
    views, sessions = star_of(spark, [(1, 10, 1, 5), (2, 20, 1, 6)])
    linked = sessions.withColumns({"user_id": F.col("visitor_id"), "ip_hash": F.lit(b"1")})
    left = lifecycle.erase_user(linked, 2)
    assert {tuple(r) for r in left.select("user_id", "visitor_id", "total_views").collect()} == {(1, 1, 1), (None, None, 1)}
    row = rollups.rollup_totals(views, left).first()
    assert (row.visitors, row.sessions, row.views) == (1, 2, 2)


def test_import_adds_to_known_days_and_starts_new_ones(spark):
    path = new_path(spark, "test-import")
    text = "Date , url,VISITORS,views\n2024-01-01,/ü,-3,4\n2024-01-02,/a,2,5\n2024-01-02,/b,7,1\n,/c,1,1\n2024-01-03,/d,0,9\n"
    spark.createDataFrame([(text.rstrip("\n"),)], "v string").coalesce(1).write.text(path)
    rows = daily.read_daily_csv(spark, path)
    totals = spark.createDataFrame([("2024-01-01", 10, 11, 12, 13, 14)], "d string, visitors long, sessions long, views long, total_duration long, bounces long")
    merged = daily.import_csv(totals.select(F.to_date("d").alias("date"), "visitors", "sessions", "views", "total_duration", "bounces"), rows)
    assert {str(r.date): tuple(r)[1:] for r in merged.collect()} == {
        "2024-01-01": (13, 11, 16, 13, 14), "2024-01-02": (9, 2, 6, 0, 0)
    }


def test_export_of_nothing_writes_nothing(spark):
    empty = spark.range(0).select(F.col("id").alias("visitors"))
    assert tables.export_csv(empty, {"visitors": "Visitors"}, new_path(spark, "test-export")) is False
    assert tables.csv_name("pages", "2024-01-01", "2024-01-07") == "pages-2024-01-01-2024-01-07.csv"


def test_zero_cases_of_reconcile(spark):
    e = spark.createDataFrame([("a", 0), ("b", 10), ("c", 10), ("d", 0)], "k string, hits long")
    a = spark.createDataFrame([("a", 0), ("b", 8), ("c", 25), ("d", 3), ("e", 1)], "k string, hits long")
    got = {r.k: (round(r.accuracy, 6), r.correlation) for r in reconcile.reconcile(e, a, ["k"]).collect()}
    assert got == {"a": (100.0, 1.0), "b": (80.0, 0.8), "c": (0.0, 1.0), "d": (0.0, 0.0), "e": (0.0, 0.0)}


def test_periods():
    assert reports.report_period("daily", "2024-03-01") == ("2024-02-29", "2024-02-29")
    assert reports.report_period("weekly", "2024-03-08") == ("2024-03-01", "2024-03-07")
    assert reports.report_period("monthly", "2024-03-31") == ("2024-02-01", "2024-02-29")
    assert reports.resolve_range("last-month", "2024-03-15") == ("2024-02-01", "2024-02-29")
    assert reports.previous_range("2024-03-01", "2024-03-07") == ("2024-02-23", "2024-02-29")


def test_size_check_reads_no_more_than_it_must(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)


# --- plans -------------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().toString()


def test_day_filter_reaches_the_partitions(spark, small):
    text = plan(admission.date_range(d.stored(spark, small)["views"], "viewed_at", "2024-01-03", "2024-01-04").select("id"))
    assert "PartitionFilters: [isnotnull(day" in text and "PushedFilters: [IsNotNull(viewed_at)" in text


def test_reports_read_only_their_columns(spark, small):
    text = plan(reports.sources(d.stored(spark, small), *d.clock(spark, small)[:2]))
    assert "ReadSchema: struct<visitor_id:bigint,referrer_id:bigint,total_views:bigint,started_at:timestamp>" in text


def test_no_cross_join_anywhere(spark, small):
    from catalog.queries import QUERIES

    for name in ("F7_sources_by_channel", "F25_kpi_compare", "F28_with_share", "H5_consistency_checks", "C4_geo_enrich", "C15_salt_as_of", "E5_refresh_pages"):
        text = plan(QUERIES[name](spark, small))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_page_rollup_groups_sessions_without_another_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views, sessions = star_of(spark, [(1, 10, 1, 5)])
        views, sessions = (df.repartition(3).select(*df.columns) for df in (views, sessions))
        path = new_path(spark, "test-plan")
        views.write.parquet(f"{path}/v")
        sessions.write.parquet(f"{path}/s")
        df = rollups.rollup_pages(spark.read.parquet(f"{path}/v"), spark.read.parquet(f"{path}/s"))
        physical = plan(df).split("== Physical Plan ==")[1]
        # two sides of the join, then visitor grain, then page grain
        assert physical.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_facts_join_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views, sessions = star_of(spark, [(1, 10, 1, 5), (2, 20, 1, 6)])
        tables.write_bucketed(views, "bucketed_views", "session_id", 4)
        tables.write_bucketed(sessions.withColumnRenamed("id", "session_id"), "bucketed_sessions", "session_id", 4)
        joined = spark.table("bucketed_views").join(spark.table("bucketed_sessions"), "session_id")
        assert joined.count() == 2 and "Exchange" not in plan(joined).split("== Physical Plan ==")[1]
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_views")
        spark.sql("DROP TABLE IF EXISTS bucketed_sessions")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_hits_hold_what_the_star_needs(spark, small):
    """The star of pruned hits equals the one of whole hits, and no address or header is stored or shuffled on the way."""
    from catalog import driver_tables as d
    from footfall.session import configure

    configure(spark)
    hits = spark.read.parquet(f"{d.write_stored(spark, small)}/hits")
    assert not {"remote_addr", "x_forwarded_for", "cf_connecting_ip", "props", "user_agent", "referrer"} & set(hits.columns)
    whole = d.sessionized_hits(spark, small)
    events = d.custom_events(spark, small)
    for name, made in d.build_star(hits, events).items():
        expected = d.build_star(whole, events)[name]
        assert made.columns == expected.columns
        assert sorted(map(str, made.collect())) == sorted(map(str, expected.collect())), name


def test_stored_star_writes_a_table_when_it_is_read(spark, small):
    """A report doesn't wait for tables that it doesn't read; all of them are still there for the one that reads them."""
    from pathlib import Path

    from footfall.session import configure

    t = d.Stored(configure(spark), small)
    assert t["summary_totals"].count() > 0
    made = lambda: {p.name for p in Path(t.path.removeprefix("file:")).iterdir()}
    assert made() == {"hits", "views", "sessions", "summary_totals"}
    t.write()
    assert made() == {"hits", *t} and len(t) == len(d.STAR) + 2


def test_sessions_never_go_whole_through_the_driver(spark, tmp_path):
    """Files of sessions look small beside the broadcast limit long before their rows are."""
    rows = [(v, 40 * s) for v in range(50) for s in range(50)]
    hits(spark, rows).write.parquet(f"{tmp_path}/hits")
    stored = spark.read.parquet(f"{tmp_path}/hits")
    owned = sessionize.sessionize_anchored(stored)
    assert "BroadcastHashJoin" not in plan(owned) and starts(owned) == walk(rows)
    sessions = owned.groupBy(F.col("session_id").alias("id"), "visitor_id", "started_at").count()
    joined = star.attach_sessions(stored.withColumnRenamed("viewed_at", "ts"), sessions)
    text = plan(joined).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    assert joined.where("session_id is null").count() == 0 and joined.count() == len(rows)
