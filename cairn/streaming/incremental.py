"""Incremental work: event-time windows, running counts, resumed runs, adaptive probing with a pluggable sampler."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import rate
from ..sources import shared


#: Steps of a search over a graph between two written tables.
KEEP_STEPS = 4


class Sampler(Protocol):
    """Continues a trace from a boundary: (valid, truthful) outcomes of n continuations. Models stand behind this."""

    def __call__(self, trace: str, boundary: int, n: int) -> tuple[int, int]: ...


def _marked(events: DataFrame, watermark: str | None) -> DataFrame:
    """With a watermark, which takes times with a zone only: those without are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events


def windowed(events: DataFrame, size: str = "1 hour", watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Events, errors and values by window and type; the same plan on a table and on a stream (with a watermark)."""
    rows = _marked(events, watermark)
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions of each user, parted by gaps without events."""
    rows = _marked(events, watermark)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")


def stream_of(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_all(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """All that is there, in micro-batches, then stop; a rerun goes on behind the last committed batch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def running_counts(rows: DataFrame, keys: list[str], valid: Column, deceptive: Column) -> DataFrame:
    """Accumulators of each key; on a stream they are its state."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(valid.cast("int")).alias("valid"), F.sum((valid & deceptive).cast("int")).alias("deceptive"))


def finished(counts: DataFrame) -> DataFrame:
    return counts.withColumn("rate", rate(F.col("deceptive"), F.col("valid")))


def cached_map(items: DataFrame, cache: DataFrame | None, key: str, tag: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tags of items: from the cache where it has them, else made; every key once."""
    if cache is None:
        return tag(items)
    known = cache.join(items.select(key).distinct(), key, "left_semi")
    return known.unionByName(tag(items.join(cache.select(key), key, "left_anti")))


def steepest_gap(rates: dict[int, float], n: int, spacing: int, by_slope: bool = True) -> int | None:
    """The middle of the gap between probes with the largest slope, or the widest one; the first of equals. Middles
    within `spacing` of a probe don't count, nor do gaps without a boundary between."""
    at = sorted(rates)
    gaps = [(a, b) for a, b in zip(at, at[1:], strict=False) if b - a > 1]
    size = (lambda g: abs(rates[g[1]] - rates[g[0]]) / (g[1] - g[0])) if by_slope else (lambda g: g[1] - g[0])
    middles = ((a + b) // 2 for a, b in sorted(gaps, key=lambda g: -size(g)))
    return next((m for m in middles if 1 <= m <= n and all(abs(m - i) >= spacing for i in at)), None)


def search_trace(trace: str, n: int, sampler: Sampler, samples: int = 50, coarse: int = 8, refine: int = 8, spacing: int = 1, least_valid: int = 1, least_step: int = 1) -> list[tuple[int, int, int]]:
    """Probes (boundary, valid, truthful) of one trace, each boundary sampled once.

    Both ends; then, from boundary 0 on, bisection for the earliest boundary with a rate of at least 0.5 (one with too
    few valid outcomes counts as below), while the bracket is wider than `least_step`; then the middles of the steepest
    gaps, of the widest where there is none, and of the steepest at any spacing.
    """
    known: dict[int, tuple[int, int]] = {}

    def probe(i: int) -> float:
        if i not in known:
            known[i] = sampler(trace, i, samples)
        valid, truthful = known[i]
        return 1 - truthful / valid if valid else 0.5

    if n < 1:
        return []
    probe(n)
    probe(1)
    low, high = 0, n
    for _ in range(coarse):
        if high - low <= max(least_step, 0):
            break
        middle = (low + high) // 2
        if probe(middle) >= 0.5 and known[middle][0] >= least_valid:
            high = middle
        else:
            low = middle
    for _ in range(refine):
        rates = {i: probe(i) for i in known}
        found = steepest_gap(rates, n, spacing)
        if found is None:
            found = steepest_gap(rates, n, spacing, by_slope=False)
        if found is None and spacing > 1:
            found = steepest_gap(rates, n, 1)
        if found is None:
            break
        probe(found)
    return [(i, *known[i]) for i in sorted(known)]


def localize(traces: DataFrame, sampler: Sampler, full: bool = False, **parameters) -> DataFrame:
    """trace, i, nv, nt for each trace (trace, n): adaptive probes, or every boundary. One task walks its traces alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, n in frame[["trace", "n"]].itertuples(index=False):
                got = [(i, *sampler(t, i, parameters.get("samples", 50))) for i in range(1, n + 1)] if full else search_trace(t, n, sampler, **parameters)
                out += [(t, *g) for g in got]
            yield pd.DataFrame(out, columns=["trace", "i", "nv", "nt"])

    kind = dict(traces.dtypes)["trace"]
    return traces.select("trace", "n").mapInPandas(run, f"trace {kind}, i int, nv long, nt long")


def job_list(spark: SparkSession, total: int, scenarios: list[str]) -> DataFrame:
    """Jobs dealt over scenarios in turn, with a number of their own in each."""
    names = F.array(*map(F.lit, scenarios))
    return spark.range(total).select(F.col("id").alias("job"), F.element_at(names, (F.col("id") % len(scenarios) + 1).cast("int")).alias("scenario"), F.floor(F.col("id") / len(scenarios)).alias("number"))


def distances(edges: DataFrame, start: int, most: int) -> DataFrame:
    """node and least steps from `start` over edges (a, b), as far as `most` steps: a join and an aggregate for each step, and
    a written table every KEEP_STEPS of them, so that plans stay short."""
    seen = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("steps"))
    for step in range(most):
        if step and step % KEEP_STEPS == 0:
            seen = shared.kept(seen, "distances")
        ahead = seen.join(edges, F.col("node") == F.col("a")).select(F.col("b").cast("long").alias("node"), (F.col("steps") + 1).alias("steps"))
        seen = seen.unionByName(ahead).groupBy("node").agg(F.min("steps").alias("steps"))
    return seen


def grid_edges(spark: SparkSession, walls: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Edges between neighbouring free cells of a grid; a cell's node is y * width + x."""
    free = {(x, y) for x in range(width) for y in range(height)} - set(walls)
    rows = [(y * width + x, v * width + u) for x, y in sorted(free) for u, v in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if (u, v) in free]
    return spark.createDataFrame(rows, "a long, b long")


def best_moves(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node the neighbours that are one step nearer."""
    here, there = steps.alias("h"), steps.alias("t")
    near = here.join(edges, F.col("h.node") == F.col("a")).join(there, F.col("t.node") == F.col("b")).where(F.col("t.steps") == F.col("h.steps") - 1)
    return near.groupBy(F.col("h.node").alias("node")).agg(F.array_sort(F.collect_list("b")).alias("moves"))
