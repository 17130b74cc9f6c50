"""Curves of traces: probes, junctures, metrics, profiles, intervals, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals
from ..operators import curves, explore, summaries
from .registry import PROBES, query, r6, rounded, table, wilson_sql


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return curves.clean(curves.probes_from_events(table(spark, d, "events")))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return curves.with_steps(_probes(spark, d))


def trace_index(spark: SparkSession, d: str) -> DataFrame:
    """The explorer's index: metrics of each trace with its cell."""
    out = curves.trace_metrics(curves.probes_from_events(table(spark, d, "events")))
    return out.withColumns({"env": F.concat(F.lit("env"), F.col("trace") % 5), "model": F.concat(F.lit("m"), F.col("trace") % 4)})


@query(f"WITH {PROBES} SELECT trace, i, nv, nt, round(r, 6) AS r FROM p")
def curve_clean(spark, d):
    return rounded(_probes(spark, d), "r")


@query(f"WITH {PROBES} SELECT trace, i, prev_i, gap, round(prev_r, 6) AS prev_r, round(delta, 6) AS delta FROM steps")
def curve_lag_delta(spark, d):
    return rounded(_steps(spark, d).select("trace", "i", "prev_i", "gap", "prev_r", "delta"), "prev_r", "delta")


@query(f"WITH {PROBES} SELECT trace, juncture, CASE WHEN jump > 0 THEN 'rise' ELSE 'fall' END AS direction, round(jump, 6) AS jump FROM firsts")
def juncture_first(spark, d):
    return rounded(curves.first_juncture(_steps(spark, d)), "jump")


@query(f"WITH {PROBES} SELECT CASE WHEN jump > 0 THEN 'rise' ELSE 'fall' END AS direction, COUNT(*) AS n FROM firsts GROUP BY 1")
def juncture_direction_counts(spark, d):
    return curves.first_juncture(_steps(spark, d)).groupBy("direction").agg(F.count("*").alias("n"))


_SHARPEST = "s AS (SELECT trace, delta AS jump, i AS jump_at FROM steps WHERE gap = 1 AND delta <> 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY trace ORDER BY abs(delta) DESC, i) = 1)"


@query(
    f"""WITH {PROBES},
m AS (SELECT trace, COUNT(*) AS np, MAX(i) AS ns, arg_min(r, i) AS r0, arg_max(r, i) AS r1, MIN(r) AS rmin, MAX(r) AS rmax, AVG(r) AS rmean, CAST(SUM(nv) AS BIGINT) AS nv FROM p GROUP BY trace),
{_SHARPEST}
SELECT m.trace, np, ns, round(r0, 6) AS r0, round(r1, 6) AS r1, round(rmin, 6) AS rmin, round(rmax, 6) AS rmax, round(rmean, 6) AS rmean, round(r1 - r0, 6) + 0.0 AS swing, nv,
  round(COALESCE(s.jump, 0.0), 6) AS jump, jump_at, juncture, CASE WHEN f.jump > 0 THEN 'rise' WHEN f.jump <= 0 THEN 'fall' END AS direction, round(f.jump, 6) AS jdelta,
  round(CASE WHEN juncture IS NOT NULL THEN LEAST(1.0, GREATEST(0.0, CAST(juncture AS DOUBLE) / GREATEST(1, ns - 1))) END, 6) AS jpos
FROM m LEFT JOIN s USING (trace) LEFT JOIN firsts f USING (trace)"""
)
def trace_metrics(spark, d):
    out = curves.trace_metrics(curves.probes_from_events(table(spark, d, "events")))
    return rounded(out, "r0", "r1", "rmin", "rmax", "rmean", "jump", "jdelta", "jpos").withColumn("swing", r6("swing") + 0.0)


@query(f"WITH {PROBES}, {_SHARPEST} SELECT trace, jump_at, round(jump, 6) AS jump FROM s")
def sharpest_step(spark, d):
    return rounded(curves.sharpest_step(_steps(spark, d)).where("jump_at is not null"), "jump")


@query(f"WITH {PROBES} SELECT trace, MIN(i) FILTER (WHERE prev_r >= 0.5 AND r < 0.5) AS crossing FROM steps GROUP BY trace")
def downward_crossing(spark, d):
    return curves.first_fall_below(_steps(spark, d))


@query(f"WITH {PROBES} SELECT trace, MIN(i) FILTER (WHERE delta > 0.2) AS first_up, MIN(i) FILTER (WHERE delta < -0.2) AS first_down FROM steps GROUP BY trace")
def commitment_targets(spark, d):
    return curves.commitment_targets(_steps(spark, d), 0.2)


_LOW, _HIGH = wilson_sql("k", "n")


@query(f"WITH c AS (SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 10) AS k FROM events GROUP BY 1) SELECT event_type, n, k, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM c")
def wilson_by_cell(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("k"))
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return c.select("event_type", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


@query(
    """SELECT event_type, COUNT(value) AS n, round(AVG(value), 6) AS mean, round(AVG(value) - CASE WHEN COUNT(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(COUNT(value)) ELSE 0.0 END, 6) AS low,
  round(AVG(value) + CASE WHEN COUNT(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(COUNT(value)) ELSE 0.0 END, 6) AS high FROM events GROUP BY 1"""
)
def mean_ci_by_type(spark, d):
    n, mean, low, high = intervals.mean_ci(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("n"), r6(mean).alias("mean"), r6(low).alias("low"), r6(high).alias("high"))


@query(
    """SELECT user_id, COUNT(*) FILTER (WHERE event_type <> 'view') AS nv, round(CASE WHEN COUNT(*) FILTER (WHERE event_type <> 'view') > 0
  THEN 1.0 - CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / COUNT(*) FILTER (WHERE event_type <> 'view') ELSE 0.5 END, 6) AS rate FROM events GROUP BY 1"""
)
def rate_default_half(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("nv"), F.count_if(F.col("event_type") == "click").alias("k"))
    return c.select("user_id", "nv", r6(intervals.deception_rate(F.col("k"), F.col("nv"))).alias("rate"))


_BAND = "round(AVG(value), 6) AS mean_rate, round(AVG(value) - CASE WHEN COUNT(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(COUNT(value)) ELSE 0.0 END, 6) AS low, round(AVG(value) + CASE WHEN COUNT(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(COUNT(value)) ELSE 0.0 END, 6) AS high"


@query(
    f"""WITH {PROBES},
e AS (SELECT trace, MIN(i) AS a, MAX(i) AS b FROM p GROUP BY trace HAVING COUNT(*) > 1),
t AS (SELECT trace, bin, a + CAST(bin * (b - a) AS DOUBLE) / 19 AS t, a * 19 + bin * (b - a) AS t19 FROM e, (SELECT CAST(range AS INT) AS bin FROM range(20))),
g AS (SELECT t.bin, CASE WHEN t.t19 = p.i * 19 OR p.prev_i IS NULL THEN p.r ELSE p.prev_r + (t.t - p.prev_i) / p.gap * (p.r - p.prev_r) END AS value
  FROM t JOIN steps p ON p.trace = t.trace AND p.i * 19 >= t.t19 AND (p.prev_i IS NULL OR p.prev_i * 19 < t.t19))
SELECT bin, {_BAND}, COUNT(*) AS n FROM g GROUP BY bin"""
)
def grid_profile(spark, d):
    return rounded(curves.grid_profile(curves.probes_from_events(table(spark, d, "events"))), "mean_rate", "low", "high")


@query(
    f"""WITH {PROBES}, a AS (SELECT p.i - 1 - juncture AS o, r AS value FROM p JOIN firsts USING (trace))
SELECT CAST(b.range AS INT) AS "offset", {_BAND}, COUNT(value) AS n FROM range(-6, 7) b LEFT JOIN a ON a.o = b.range GROUP BY 1"""
)
def aligned_profile(spark, d):
    probes = _probes(spark, d)
    return rounded(curves.aligned_profile(probes, curves.first_juncture(curves.with_steps(probes))), "mean_rate", "low", "high")


@query(
    f"""WITH {PROBES}, c AS (SELECT trace, MAX(i) AS ns FROM p GROUP BY trace),
v AS (SELECT LEAST(9, GREATEST(0, CAST(floor(LEAST(1.0, GREATEST(0.0, CAST(juncture AS DOUBLE) / GREATEST(1, ns - 1))) / 1.0 * 10) AS INT))) AS bin FROM firsts JOIN c USING (trace))
SELECT CAST(b.range AS INT) AS bin, COUNT(v.bin) AS n, round(b.range * CAST(0.1 AS DOUBLE), 6) AS edge FROM range(10) b LEFT JOIN v ON v.bin = b.range GROUP BY b.range"""
)
def jpos_histogram(spark, d):
    return rounded(curves.histogram(trace_index(spark, d), "jpos", 0.0, 1.0, 10), "edge")


@query(
    f"""WITH {PROBES}, v AS (SELECT LEAST(7, GREATEST(0, CAST(floor((round(jump, 9) + 1.0) / 2.0 * 8) AS INT))) AS bin FROM firsts)
SELECT CAST(b.range AS INT) AS bin, COUNT(v.bin) AS n, round(-1.0 + b.range * CAST(0.25 AS DOUBLE), 6) AS edge FROM range(8) b LEFT JOIN v ON v.bin = b.range GROUP BY b.range"""
)
def jump_histogram(spark, d):
    jumps = curves.first_juncture(_steps(spark, d)).withColumn("jump", F.round("jump", 9))
    return rounded(curves.histogram(jumps, "jump", -1.0, 1.0, 8), "edge")


@query(
    f"""WITH {PROBES}, t AS (SELECT trace, 'env' || trace % 5 AS env, 'm' || trace % 4 AS model, COUNT(*) AS np, CAST(SUM(nv) AS BIGINT) AS nv, arg_max(r, i) AS r1 FROM p GROUP BY trace)
SELECT COALESCE(env, 'all') AS env, COALESCE(model, 'all') AS model, COUNT(*) AS traces, CAST(SUM(np) AS BIGINT) AS probes, CAST(SUM(nv) AS BIGINT) AS outcomes, COUNT(*) FILTER (WHERE juncture IS NOT NULL) AS committed,
  round(AVG(r1), 6) AS final_rate FROM t LEFT JOIN firsts USING (trace) GROUP BY GROUPING SETS ((), (env), (model), (env, model))"""
)
def cells_grouping_sets(spark, d):
    measures = [F.count("*").alias("traces"), F.sum("np").alias("probes"), F.sum("nv").alias("outcomes"), F.count("juncture").alias("committed"), F.avg("r1").alias("final_rate")]
    return rounded(summaries.cells(trace_index(spark, d), ["env", "model"], measures), "final_rate")


@query(
    f"""WITH {PROBES}, x AS (SELECT trace, i, r, AVG(r) OVER past AS m, MIN(r) OVER past AS lo, MAX(r) OVER past AS hi, LAG(r) OVER w AS b, LAG(r, 2) OVER w AS bb
  FROM p WINDOW w AS (PARTITION BY trace ORDER BY i), past AS (PARTITION BY trace ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trace, i, round(GREATEST(-1.0, LEAST(1.0, (r - b) / (abs(r) + abs(b) + 1e-6))), 6) + 0.0 AS r_delta, round((r - bb) / 2, 6) + 0.0 AS r_slope3, round(r - m, 6) + 0.0 AS r_devrun, round(r - lo, 6) + 0.0 AS r_min_gap, round(r - hi, 6) + 0.0 AS r_max_gap FROM x"""
)
def transition_features(spark, d):
    out = curves.transitions(_probes(spark, d), "r")
    names = ["r_delta", "r_slope3", "r_devrun", "r_min_gap", "r_max_gap"]
    return rounded(out.select("trace", "i", *names), *names)


@query(
    f"""WITH {PROBES} SELECT trace, i, ROW_NUMBER() OVER w - 1 AS position, COUNT(*) OVER t AS length, COUNT(*) OVER t - ROW_NUMBER() OVER w AS remaining,
  round(CASE WHEN COUNT(*) OVER t > 1 THEN CAST(ROW_NUMBER() OVER w - 1 AS DOUBLE) / (COUNT(*) OVER t - 1) ELSE 0.0 END, 6) AS normalized, round(LEAD(r) OVER w, 6) AS next_r
  FROM p WINDOW w AS (PARTITION BY trace ORDER BY i), t AS (PARTITION BY trace)"""
)
def lag_lead_features(spark, d):
    return rounded(curves.positions(_probes(spark, d)).select("trace", "i", "position", "length", "remaining", "normalized", "next_r"), "normalized", "next_r")


@query(
    f"""WITH {PROBES}, s AS (SELECT trace, i, list_reverse(list(nv) OVER (PARTITION BY trace ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS slots FROM p)
SELECT trace, i, array_to_string(slots, ',') AS slots, len(slots) AS filled FROM s"""
)
def slots_last5(spark, d):
    out = curves.slots(_probes(spark, d), "nv")
    return out.select("trace", "i", F.array_join(F.transform("slots", lambda x: x.cast("string")), ",").alias("slots"), F.size(F.filter("filled", lambda f: f)).cast("long").alias("filled"))


@query(
    f"""WITH {PROBES}, e AS (SELECT trace, i, nv, CAST(SUM(nv) OVER (PARTITION BY trace ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM p),
f AS (SELECT *, end_at - nv AS start_at FROM e)
SELECT trace, i, start_at, end_at, end_at - FIRST_VALUE(start_at) OVER w AS recent_size, FIRST_VALUE(start_at) OVER w AS early_size, LAG(nv) OVER (PARTITION BY trace ORDER BY i) AS prev_size
  FROM f WINDOW w AS (PARTITION BY trace ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
)
def region_sizes(spark, d):
    return curves.regions(_probes(spark, d), "nv").select("trace", "i", "start_at", "end_at", "recent_size", "early_size", "prev_size")


@query(
    f"""WITH {PROBES}, k AS (SELECT trace, i, r, ROW_NUMBER() OVER (PARTITION BY trace ORDER BY i) - 1 AS k, COUNT(*) OVER (PARTITION BY trace) AS n FROM p),
{_SHARPEST}, m AS (SELECT trace, COALESCE(juncture + 1, jump_at) AS centre FROM s LEFT JOIN firsts USING (trace)),
c AS (SELECT k.trace, k.k AS c FROM k JOIN m ON m.trace = k.trace AND m.centre = k.i)
SELECT trace, i, round(r, 6) AS r FROM k JOIN c USING (trace) WHERE k >= LEAST(GREATEST(c - 1, 0), GREATEST(n - 3, 0)) AND k < LEAST(GREATEST(c - 1, 0), GREATEST(n - 3, 0)) + 3"""
)
def neighbour_window(spark, d):
    probes = _probes(spark, d)
    centres = curves.trace_metrics(probes).select("trace", F.coalesce(F.col("juncture") + 1, F.col("jump_at")).alias("centre"))
    return rounded(curves.neighbourhood(probes, centres), "r")


@query(f"WITH {PROBES} SELECT trace, i, nv, prev_nv, round(delta, 6) AS delta FROM steps WHERE delta IS NOT NULL AND nv >= 3 AND prev_nv >= 3")
def usable_rows_filter(spark, d):
    return rounded(curves.usable_steps(_steps(spark, d), least_valid=3).select("trace", "i", "nv", "prev_nv", "delta"), "delta")


@query(f"WITH {PROBES} SELECT trace, prev_i, i, round(delta, 6) AS delta FROM steps WHERE gap = 1 AND delta > 0.1")
def adjacent_pairs(spark, d):
    return rounded(_steps(spark, d).where("gap = 1 and delta > 0.1").select("trace", "prev_i", "i", "delta"), "delta")


@query(
    f"""WITH {PROBES}, c AS (SELECT trace, prev_i, i, round(abs(delta) / gap, 9) AS size, CAST(floor((prev_i + i) / 2) AS BIGINT) AS next_i FROM steps WHERE gap > 1)
SELECT trace, next_i, round(size, 6) AS size FROM c WHERE next_i - prev_i >= 1 AND i - next_i >= 1 QUALIFY ROW_NUMBER() OVER (PARTITION BY trace ORDER BY size DESC, prev_i) = 1"""
)
def next_probe_by_slope(spark, d):
    return rounded(curves.next_probes(_probes(spark, d)), "size")


@query(
    f"""WITH {PROBES}, c AS (SELECT trace, prev_i, i, CAST(gap AS DOUBLE) AS size, CAST(floor((prev_i + i) / 2) AS BIGINT) AS next_i FROM steps WHERE gap > 1)
SELECT trace, next_i, size FROM c WHERE next_i - prev_i >= 1 AND i - next_i >= 1 QUALIFY ROW_NUMBER() OVER (PARTITION BY trace ORDER BY size DESC, prev_i) = 1"""
)
def next_probe_by_gap(spark, d):
    return curves.next_probes(_probes(spark, d), "gap")


_EXPLORE = f"""WITH {PROBES}, {_SHARPEST}, t AS (SELECT trace, 'env' || trace % 5 AS env, 'm' || trace % 4 AS model, COUNT(*) AS np, round(arg_max(r, i), 6) AS r1 FROM p GROUP BY trace),
x AS (SELECT t.*, round(COALESCE(s.jump, 0.0), 6) AS jump, juncture FROM t LEFT JOIN s USING (trace) LEFT JOIN firsts USING (trace))"""


@query(f"{_EXPLORE} SELECT trace, env, model, np, r1, jump FROM x WHERE env IN ('env0', 'env2') AND abs(jump) >= 0.3 AND np >= 5")
def explorer_filter(spark, d):
    index = rounded(trace_index(spark, d), "r1", "jump")
    return explore.matching(index, explore.QuerySpec(env=("env0", "env2"), least_jump=0.3, least_probes=5)).select("trace", "env", "model", "np", "r1", "jump")


@query(f"{_EXPLORE} SELECT trace, jump FROM x ORDER BY jump DESC NULLS LAST, trace LIMIT 20 OFFSET 20")
def explorer_page(spark, d):
    return explore.page(rounded(trace_index(spark, d), "jump").select("trace", "jump"), explore.QuerySpec(page=1), size=20)


@query(f"{_EXPLORE} SELECT 'env' AS facet, env AS value, COUNT(*) AS n FROM x GROUP BY env UNION ALL SELECT 'model', model, COUNT(*) FROM x GROUP BY model UNION ALL SELECT 'outcome', CASE WHEN r1 >= 0.5 THEN 'deceptive' ELSE 'honest' END, COUNT(*) FROM x GROUP BY 2")
def explorer_facets(spark, d):
    return explore.facets(rounded(trace_index(spark, d), "r1"))


@query(
    f"""{_EXPLORE} SELECT env, round(AVG(CASE WHEN juncture IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS commit_rate, COUNT(*) AS n FROM x GROUP BY env"""
)
def commit_rate_by_env(spark, d):
    return trace_index(spark, d).groupBy("env").agg(r6(F.avg(F.col("juncture").isNotNull().cast("double"))).alias("commit_rate"), F.count("*").alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events to probes, curves, junctures, and each cell's commitment rate with its interval."""
    cells = trace_index(spark, d).groupBy("env", "model").agg(F.count("*").alias("traces"), F.count("juncture").alias("committed"), F.avg("r1").alias("final_rate"), F.avg("jpos").alias("mean_place"))
    low, high = intervals.wilson(F.col("committed"), F.col("traces"))
    return cells.withColumns({"commit_rate": F.col("committed") / F.col("traces"), "low": low, "high": high}).orderBy("env", "model")


