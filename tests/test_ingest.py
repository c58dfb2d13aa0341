"""The ingest job's parts: interval lookups, salts as of a time, hot seconds, stages of one's own, loads in turn."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalog import driver_tables as d
from footfall.operators import enrich, intervals, sessionize
from footfall.plans import ingest
from footfall.streaming import sinks


@pytest.mark.parametrize(("n_points", "n_spans", "width"), [(400, 60, 40), (300, 1, 1000), (50, 200, 400), (0, 5, 5), (5, 0, 5)])
def test_lookup_against_brute_force(spark, n_points, n_spans, width):
    """Nested, equal, touching and open intervals, more parts than intervals and the other way round."""
    rng = random.Random(n_points + n_spans)
    key = lambda x: f"{x:05d}"
    points = [rng.randrange(1200) for _ in range(n_points)]
    spans = {(a, None if rng.random() < 0.1 else a + rng.randrange(width)) for a in (rng.randrange(1000) for _ in range(n_spans))}
    rows = [(key(a), None if b is None else key(b), f"{a}-{b}") for a, b in spans] + [(None, "00005", "x")]
    table = spark.createDataFrame(rows, "_lo string, _hi string, name string")
    seen = spark.createDataFrame([(key(p),) for p in points] + [(None,)], "_key string").repartition(3)
    found = sorted((r["_key"], r["_found"] and r["_found"]["name"]) for r in intervals.lookup(seen, table, ["name"]).collect())
    expected = []
    for p in points:
        around = [(a, -(10**9 if b is None else b), f"{a}-{b}") for a, b in spans if a <= p and (b is None or p <= b)]
        expected.append((key(p), max(around)[2] if around else None))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_lookup_deals_out_and_joins_nothing(spark):
    table = spark.createDataFrame([("1", "2", "x")], "_lo string, _hi string, name string")
    text = intervals.lookup(spark.createDataFrame([("1",)], "_key string"), table, ["name"])._jdf.queryExecution().toString()
    assert "Join" not in text and "Broadcast" not in text


def test_salts_have_no_end(spark):
    at = datetime(2024, 3, 1, 0, 15)
    salts = spark.createDataFrame([(at + timedelta(days=k), f"s{k}") for k in range(3)] + [(at + timedelta(days=1, hours=5), "extra")], "valid_from timestamp, salt string")
    times = {
        at - timedelta(microseconds=1): (None, None), at: ("s0", None), at + timedelta(hours=20): ("s0", None), at + timedelta(days=1): ("s1", "s0"),
        at + timedelta(days=1, hours=5): ("extra", "s1"), at + timedelta(days=2, minutes=-1): ("extra", "s1"), at + timedelta(days=2): ("s2", "extra"),
        at + timedelta(days=7305): ("s2", "extra"), None: (None, None),
    }
    hits = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts timestamp, n int")
    found = enrich.with_salt(hits, salts)
    assert {r["ts"]: (r["salt"], r["previous_salt"]) for r in found.collect()} == times
    first = [r["n"] for r in ingest.without_salt(hits, salts).collect()]
    assert sorted(first) == [0, len(times) - 1]


@pytest.mark.parametrize("slice_", [4096, 3])
def test_hot_seconds_refuse_the_same_hits(spark, monkeypatch, slice_):
    monkeypatch.setattr(sessionize, "SLICE", slice_)
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=rng.randrange(40) if k % 3 else 7), rng.choice("aab")) for k in range(300)]
    hits = spark.createDataFrame(rows, "view_id long, ts timestamp, ip string")
    expected = {r["view_id"] for r in sessionize.flag_rate_limited(hits, limit=25).where("rate_limited").collect()}
    quotas = sessionize.rate_limit_quotas(hits, limit=25)
    counts = hits.groupBy(F.xxhash64("ip").alias("_key"), F.unix_seconds("ts").alias("_sec")).agg(F.count("*").alias("n"))
    over = counts.join(quotas, ["_key", "_sec"]).where("n > _quota").select("_key", "_sec", "_quota")
    assert expected and {r["view_id"] for r in sessionize.beyond_quota(hits, over).collect()} == expected


def test_rate_limit_turns_requests_away(spark, small):
    rules = ingest.Rules("https://shop.test", d.SITE_HOST, d.SECRET, rate_limit=1)
    hits = d.requests(spark, small).withColumns({c: F.lit("20.0.0.1") for c in ("x_forwarded_for", "remote_addr")}).withColumn("cf_connecting_ip", F.lit(None).cast("string"))
    hits = hits.withColumn("ts", F.lit(datetime(2024, 1, 1)))
    judged = ingest.requests_judged(hits, rules)
    kept = judged.where("reason is null").collect()
    late = judged.where("reason = 'rate_limited'").collect()
    assert len(kept) == 1 and late and {r["reject_status"] for r in late} == {429} and kept[0]["view_id"] < min(r["view_id"] for r in late)


def test_stages_say_what_they_need(spark):
    hits = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match=r"one needs \['c'\]"):
        ingest.compose(hits, [ingest.Stage("one", lambda h: h, ("c",))])
    with pytest.raises(ValueError, match=r"two must give or drop \['d'\]"):
        ingest.compose(hits, [ingest.Stage("two", lambda h: h, ("a",), ("d",))])
    with pytest.raises(ValueError, match=r"three must give or drop \['b'\]"):
        ingest.compose(hits, [ingest.Stage("three", lambda h: h, drops=("b",))])
    with pytest.raises(ValueError, match=r"four must give or drop \['a'\]"):
        ingest.compose(hits, [ingest.Stage("four", lambda h: h.drop("a"))])
    out = ingest.compose(hits, [ingest.Stage("five", lambda h: h.withColumn("d", F.lit(1)).drop("b"), ("a",), ("d",), ("b",))])
    assert out.columns == ["a", "d"]


def test_an_extra_stage_may_not_lose_columns(spark, small):
    job = (d.requests(spark, small), d.RULES, d.salts(spark, small), d.geo_ranges(spark, small))
    with pytest.raises(ValueError, match="forgetful must give or drop"):
        ingest.pipeline(*job, [ingest.Stage("forgetful", lambda h: h.drop("channel"))])


def test_no_address_behind_the_visitor(spark, small):
    t = d.ingested(spark, small)
    assert not any(a in df.columns for df in t.values() for a in ingest.ADDRESSES)


def test_an_empty_load_changes_nothing(spark, small):
    first, _, _ = d.clock(spark, small)
    path = d.session.new_path(spark, "empty-load")
    job = (path, d.RULES, d.salts(spark, small), d.geo_ranges(spark, small))
    hits = d.requests(spark, small).where(F.to_date("ts") == F.lit(first).cast("date"))
    before = {n: df.count() for n, df in ingest.ingest(hits, *job).items()}
    assert {n: df.count() for n, df in ingest.load_more(hits.where("false"), *job).items()} == before


def test_late_hits_are_set_aside_and_counted(spark, small):
    """Hits older than their visitors' stored ones: the star stays, the hits lie in the late folder."""
    path, hits = d.session.new_path(spark, "late"), d.requests(spark, small)
    first, _, _ = d.clock(spark, small)
    lookups = lambda own: (d.salts(own, small), d.geo_ranges(own, small))
    process = sinks.star_batches(path, d.RULES, lookups)
    process(hits.where("false"), 0)
    assert sinks._read(spark, f"{path}/batches") is None
    day = hits.where(F.to_date("ts") == F.lit(first).cast("date"))
    process(day, 1)
    stored = ingest.read(spark, path)
    before = {name: df.count() for name, df in stored.items()}
    # one visit a visitor, a second ahead of the first stored one, under ids of their own
    views = stored["views"].join(stored["sessions"].select(F.col("id").alias("session_id"), "visitor_id"), "session_id")
    starts = views.groupBy("visitor_id").agg(F.min_by("id", F.struct("viewed_at", "id")).alias("view_id")).select("view_id")
    early = day.join(starts, "view_id").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 SECOND")).withColumn("viewed_at", F.date_trunc("second", "ts"))
    early = early.where(F.to_date("ts") == F.lit(first).cast("date")).withColumn("view_id", F.col("view_id") + 10**9)
    process(early, 2)
    late = spark.read.parquet(f"{path}/late/batch=2").count()
    assert late == spark.read.parquet(f"{path}/batches/batch=2").first()["late"] > 0
    assert {name: df.count() for name, df in ingest.read(spark, path).items()} == before


def test_only_admitted_requests_move_to_the_rate_limit(spark, small):
    """Rejected requests, bodies and all, went through the join by view_id; quotas of all seconds went through the driver."""
    visits = ingest.visits(d.requests(spark, small), d.RULES, d.salts(spark, small), d.geo_ranges(spark, small))
    text = visits._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "LeftAnti" in text and "_late" not in text
    hits = spark.createDataFrame([(k, datetime(2024, 1, 1), "a") for k in range(9)], "view_id long, ts timestamp, ip string")
    flagged = sessionize.flag_rate_limited(hits, limit=4)
    assert "BroadcastHashJoin" not in flagged._jdf.queryExecution().toString()
    assert {r["view_id"] for r in flagged.where("rate_limited").collect()} == set(range(4, 9))
    judged = ingest.requests_judged(d.requests(spark, small), d.RULES).where("reason is null").select("view_id")
    salted = ingest.without_salt(d.requests(spark, small), d.salts(spark, small)).count()
    assert not salted and sorted(visits.select("view_id").collect()) == sorted(judged.collect())


def test_requests_are_dealt_out_to_all_tasks(spark, small):
    """A file of one row group is one task's, with all row rules behind it."""
    assert "REPARTITION_BY_COL" in d.requests(spark, small)._jdf.queryExecution().toString()
