"""Headline queries on the given tables; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of threads. Every query runs
twice, plan building included; the faster time counts. ``star_build`` writes the stored tables, once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "D5_sessionize_anchored", "D6_sessionize_gap", "B4_rate_limit", "B_admit_hits", "C4_geo_enrich", "C13_attribute_source",
    "E1_rollup_pages", "E2_rollup_totals", "F1_summary_daily", "F2_summary_totals", "F3_top_pages", "F4_entry_pages",
    "F5_exit_pages", "F6_sources", "F7_sources_by_channel", "F8_dim_countries", "F14_utm_campaigns", "F15_events_list",
    "F17_event_properties", "F18_active_visitors", "F20_recent_feed", "F25_kpi_compare", "G1_export_user", "H6_vitals_summary",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from footfall.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    from catalog import driver_tables
    from catalog.queries import QUERIES

    times = {"star_build": timed(lambda: driver_tables.stored(spark, sf_dir).write())}
    for name in HEADLINES:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = min(timed(run), timed(run))
    times = {n: round(t, 3) for n, t in times.items()}
    total = round(sum(t for n, t in times.items()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
