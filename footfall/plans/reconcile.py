"""Compare what was expected with what was recorded, and weigh page-speed experiments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall import fixed_values as fv
from footfall.operators.admission import date_range
from footfall.plans.reports import half_up

# --- hits --------------------------------------------------------------------------------------


def truth_summary(truth: DataFrame) -> DataFrame:
    human = F.when(~F.col("is_bot"), F.col("profile_id"))
    return truth.agg(
        F.count(F.lit(1)).alias("total_hits"),
        F.count_distinct("profile_id").alias("unique_profiles"),
        F.coalesce(F.sum(F.col("is_bot").cast("long")), F.lit(0)).alias("bot_hits"),
        F.coalesce(F.sum(F.col("is_logged_in").cast("long")), F.lit(0)).alias("logged_in_hits"),
        F.count_distinct(human).alias("human_profiles"),
    )


def truth_by(truth: DataFrame, *columns: str) -> DataFrame:
    """Hits and profiles per channel, device or page."""
    return truth.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("profile_id").alias("unique_profiles")
    ).orderBy(F.desc("hits"), *columns)


def compare_counts(views: DataFrame, sessions: DataFrame, first: str, last: str) -> DataFrame:
    """Views, sessions and visitors of the sessions that started in the range.

    Views are counted per session before the join, so two distinct counts become one.
    """
    hub = date_range(sessions, "started_at", first, last).select(F.col("id").alias("session_id"), "visitor_id")
    counted = views.groupBy("session_id").agg(F.count(F.lit(1)).alias("views"))
    return hub.join(counted, "session_id").agg(
        F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("visitor_id").alias("visitors"),
    )


def accuracy(expected: Column, actual: Column) -> Column:
    miss = F.when(actual == 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(expected == 0, miss).otherwise(
        F.greatest(F.lit(0.0), (F.lit(1.0) - F.abs(expected - actual) / expected) * 100)
    )


def correlation(expected: Column, actual: Column) -> Column:
    none = F.when(actual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(expected == 0, none).otherwise(F.least(actual / expected, F.lit(1.0)))


def reconcile(truth: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "hits") -> DataFrame:
    """Expected against actual counts per key; a key missing on one side counts as 0 there."""
    left = truth.select(*keys, F.col(value).alias("expected"))
    right = actual.select(*keys, F.col(value).alias("actual"))
    both = left.join(right, list(keys), "full_outer").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("expected", "actual")}
    )
    e, a = F.col("expected"), F.col("actual")
    return both.withColumns({"accuracy": accuracy(e, a), "correlation": correlation(e, a)})


def consistency_checks(
    totals: DataFrame, pages: DataFrame, sources: DataFrame, dimensions: dict[str, DataFrame]
) -> DataFrame:
    """One row per invariant: visitors <= sessions <= views, and report sums against the totals."""
    one = totals.select("visitors", "sessions", "views")
    rows = [
        one.select(F.lit("visitors <= sessions").alias("check"), F.col("visitors").alias("left"), F.col("sessions").alias("right"),
                   (F.col("visitors") <= F.col("sessions")).alias("ok")),
        one.select(F.lit("sessions <= views").alias("check"), F.col("sessions").alias("left"), F.col("views").alias("right"),
                   (F.col("sessions") <= F.col("views")).alias("ok")),
    ]
    sums = [("pages", pages, "views"), ("sources", sources, "visitors")]
    sums += [(name, df, "visitors") for name, df in dimensions.items()]
    for name, df, metric in sums:
        total = one.select(metric).scalar()
        row = df.agg(F.coalesce(F.sum(metric), F.lit(0)).alias("left")).withColumn("right", total)
        rows.append(
            row.select(F.lit(f"{name} {metric} = totals").alias("check"), "left", "right", (F.col("left") == F.col("right")).alias("ok"))
        )
    return reduce(DataFrame.unionByName, rows)


# --- page speed ----------------------------------------------------------------------------------


def digits(vital: Column, plain: int) -> Column:
    return F.when(vital == "cls", F.lit(4)).otherwise(F.lit(plain))


def _rounded(value: Column, vital: Column, plain: int) -> Column:
    return F.when(vital == "cls", half_up(value, 4)).otherwise(half_up(value, plain))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per key, exact at any group size.

    Equal values are counted first (map-side), then ranks come from a running sum that streams
    through a sorted, spillable partition; no group is held in memory.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_c").over(order))
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = ranked.join(sizes, list(keys))
    picks = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda k: (F.col("_end") - F.col("_c") <= k) & (k < F.col("_end"))
        picks += [
            F.max(F.when(holds(low), F.col("_v"))).alias(f"_{name}_low"),
            F.max(F.when(holds(high), F.col("_v"))).alias(f"_{name}_high"),
            F.max(place - low).alias(f"_{name}_part"),
        ]
    out = joined.groupBy(*keys).agg(*picks, F.max("_n").alias("samples"))
    between = lambda n: F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")
    return out.select(*keys, "samples", *[between(n).alias(n) for n in at])


def vitals_summary(samples: DataFrame) -> DataFrame:
    """p50, p95 and mean per configuration, run and vital (four decimals for cls, none otherwise)."""
    keys = ["config", "run_id", "vital"]
    shares = exact_percentiles(samples, keys, "value", {"p50": 0.5, "p95": 0.95})
    means = samples.groupBy(*keys).agg(F.avg("value").alias("avg"))
    vital = F.col("vital")
    return shares.join(means, keys).select(
        *keys, "samples", *[_rounded(F.col(c), vital, 0).alias(c) for c in ("p50", "p95", "avg")]
    )


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Spread of the runs' medians per configuration and vital.

    A group is the repeats of one experiment: one already summarized row per run.
    """
    vital = F.col("vital")
    grouped = runs.groupBy("config", "vital").agg(
        F.sort_array(F.collect_list("p50")).alias("runs_p50"),
        F.sort_array(F.collect_list("p95")).alias("_p95"),
        F.stddev_pop("p50").alias("_dev"),
        F.count(F.lit(1)).alias("runs_count"),
        F.sum("samples").alias("samples_total"),
    )
    n = F.col("runs_count")
    at = lambda c, i: F.element_at(F.col(c), (i + 1).cast("int"))
    middle = lambda c: (at(c, F.floor((n - 1) / 2)) + at(c, F.floor(n / 2))) / 2
    lowest, highest = at("runs_p50", F.lit(0)), F.element_at("runs_p50", -1)
    spread = F.when(n < 4, highest - lowest).otherwise(
        at("runs_p50", F.floor(n * 0.75)) - at("runs_p50", F.floor(n * 0.25))
    )
    figures = {
        "median": middle("runs_p50"), "p95_median": middle("_p95"), "iqr": spread,
        "std_dev": F.col("_dev"), "min": lowest, "max": highest,
    }
    return grouped.select(
        "config", "vital", *[_rounded(v, vital, 1).alias(k) for k, v in figures.items()],
        F.transform("runs_p50", lambda v: _rounded(v, vital, 1)).alias("runs_p50"), "runs_count", "samples_total",
    )


def deltas(agg: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Change of each configuration's median against the baseline (one row per vital, so broadcast)."""
    base = agg.filter(F.col("config") == baseline).select("vital", F.col("median").alias("base"))
    joined = agg.filter(F.col("config") != baseline).join(F.broadcast(base), "vital")
    diff = F.col("median") - F.col("base")
    return joined.select(
        "config", "vital", "base", "median",
        _rounded(diff, F.col("vital"), 1).alias("delta"),
        F.when(F.col("base") > 0, half_up(diff / F.col("base") * 100, 1)).otherwise(F.lit(0.0)).alias("delta_pct"),
        "runs_count", "samples_total",
    )


def impact_scores(changes: DataFrame) -> DataFrame:
    """Weighted slowdown per configuration; lower is better."""
    terms = None
    for vital, weight in fv.SCORE_WEIGHTS.items():
        fixed = fv.SCORE_SCALES.get(vital)
        scale = F.lit(fixed) if fixed else F.greatest(F.col("base"), F.lit(1.0))
        term = F.greatest(F.lit(0.0), F.col("delta")) / scale * F.lit(weight)
        terms = (F.when if terms is None else terms.when)(F.col("vital") == vital, term)
    return changes.groupBy("config").agg(half_up(F.sum(terms.otherwise(F.lit(0.0))) * 100, 1).alias("impact_score"))


def rank_configs(scores: DataFrame) -> DataFrame:
    """Configurations by score, best first; ``position`` counts from 1 over a handful of rows."""
    order = Window.partitionBy(F.lit(0)).orderBy("impact_score", "config")
    return scores.withColumn("position", F.row_number().over(order)).orderBy("position")


def noise_floor(runs: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Largest difference between two baseline runs per load vital; 0 with fewer than two runs."""
    rows = runs.filter((F.col("config") == baseline) & F.col("vital").isin("lcp", "ttfb", "fcp"))
    gap = half_up(F.max("p50") - F.min("p50"), 1)
    n = F.count(F.lit(1))
    return rows.groupBy("vital").agg(F.when(n < 2, F.lit(0.0)).otherwise(gap).alias("floor"), n.alias("runs"))


def noise_band(floor: DataFrame) -> DataFrame:
    """How trustworthy the batch is, from the noise floor of lcp."""
    band = None
    for limit, name in fv.NOISE_BANDS:
        band = (F.when if band is None else band.when)(F.col("floor") <= limit, F.lit(name))
    return floor.filter(F.col("vital") == "lcp").withColumn("band", band.otherwise(F.lit("very large")))


def within_noise(changes: DataFrame, floor: DataFrame) -> DataFrame:
    """Marks changes that are no larger than the noise of their vital."""
    return changes.join(F.broadcast(floor.select("vital", "floor")), "vital").withColumn(
        "within_noise", F.abs("delta") <= F.col("floor")
    )


def _wide(changes: DataFrame, scores: DataFrame, side: str) -> DataFrame:
    pick = lambda v: F.max(F.when(F.col("vital") == v, F.col("delta"))).alias(f"{v}_{side}")
    wide = changes.groupBy("config").agg(*[pick(v) for v in ("lcp", "ttfb", "fcp")])
    return wide.join(scores.select("config", F.col("impact_score").alias(f"score_{side}")), "config").withColumn(f"_{side}", F.lit(True))


def compare_batches(
    changes_a: DataFrame, scores_a: DataFrame, floor_a: DataFrame,
    changes_b: DataFrame, scores_b: DataFrame, floor_b: DataFrame,
) -> DataFrame:
    """Both batches per configuration; a change is significant above the larger noise floor."""
    both = _wide(changes_a, scores_a, "a").join(_wide(changes_b, scores_b, "b"), "config", "full_outer")
    floors = floor_a.unionByName(floor_b).groupBy("vital").agg(F.max("floor").alias("floor"))
    larger = {v: floors.filter(F.col("vital") == v).agg(F.coalesce(F.max("floor"), F.lit(0.0)).alias(v)).scalar() for v in ("lcp", "ttfb", "fcp")}
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = both.withColumn("only_in", F.when(F.col("_b").isNull(), "A").when(F.col("_a").isNull(), "B"))
    out = out.withColumns({f"{v}_change": F.when(paired, F.col(f"{v}_b") - F.col(f"{v}_a")) for v in ("lcp", "ttfb", "fcp", "score")})
    out = out.withColumns({f"_{v}_floor": f for v, f in larger.items()})
    out = out.withColumns({f"{v}_significant": F.abs(f"{v}_change") > F.col(f"_{v}_floor") for v in larger})
    first = F.when(F.col("lcp_significant"), 0).when(paired, 1).otherwise(2)
    ordered = out.orderBy(first, F.desc_nulls_last("lcp_change"), "config")
    return ordered.drop("_a", "_b", *[f"_{v}_floor" for v in larger])


def network_stats(responses: DataFrame, trackers: Sequence[str] = tuple(fv.TRACKER_URL_PARTS)) -> DataFrame:
    """Requests and transferred KB per page load, in all and for analytics scripts."""
    ours = reduce(lambda a, b: a | b, [F.col("url").contains(p) for p in trackers])
    size = F.coalesce(F.col("size"), F.lit(0))
    kb = lambda c: half_up(F.sum(c) / 1024, 1)
    return responses.groupBy("load_id").agg(
        F.count(F.lit(1)).alias("requests"),
        kb(size).alias("total_kb"),
        kb(F.when(ours, size).otherwise(0)).alias("tracker_kb"),
    )
