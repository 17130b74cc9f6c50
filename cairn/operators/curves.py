"""Curves of traces: probes (trace, i, r, nv, nt) and what is read from them.

A probe at boundary i has nv valid and nt truthful outcomes and the rate r = 1 - nt / nv. All operators take the
names of their columns, partition by trace and order by boundary, so one shuffle by trace serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import bounded_change, deception_rate, mean_ci

JUMP = 0.30


def by_trace(trace: str = "trace", at: str = "i", *ties: str):
    return Window.partitionBy(trace).orderBy(at, *ties)


def probes_from_events(events: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """The canonical probes: a trace for each user, a boundary for each day with events, errors as deceptions."""
    day = (F.datediff(F.col("ts").cast("date"), F.lit(start).cast("date")) + 1).cast("int")
    counts = events.groupBy(F.col("user_id").alias("trace"), day.alias("i")).agg(F.count("*").alias("nv"), F.count_if(F.col("event_type") != "error").alias("nt"))
    return counts.withColumn("r", deception_rate(F.col("nt"), F.col("nv")))


def clean(probes: DataFrame, least_valid: int = 1) -> DataFrame:
    """Probes with a rate and enough valid outcomes."""
    return probes.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.coalesce("nv", F.lit(0)) >= least_valid))


def with_steps(probes: DataFrame, float32: bool = False) -> DataFrame:
    """Previous boundary, rate and count, the gap to it and the change of the rate."""
    w = by_trace()
    out = probes.withColumns({"prev_i": F.lag("i").over(w), "prev_r": F.lag("r").over(w), "prev_nv": F.lag("nv").over(w)})
    delta = F.col("r").cast("float") - F.col("prev_r").cast("float") if float32 else F.col("r") - F.col("prev_r")
    return out.withColumns({"gap": F.col("i") - F.col("prev_i"), "delta": delta})


def is_jump(least: float = JUMP, adjacent: bool = True, strict: bool = False) -> Column:
    """Whether a step is a juncture: between adjacent boundaries only, or between consecutive probes; strict or not."""
    size = F.abs(F.col("delta"))
    out = size > least if strict else size >= least
    return out & (F.col("gap") == 1) if adjacent else out


def first_juncture(steps: DataFrame, least: float = JUMP, adjacent: bool = True, strict: bool = False) -> DataFrame:
    """trace, juncture (the boundary before the jump), direction and size of each trace's first jump."""
    jumps = steps.where(is_jump(least, adjacent, strict)).groupBy("trace").agg(F.min_by(F.struct("prev_i", "delta"), "i").alias("j"))
    way = F.when(F.col("j.delta") > 0, F.lit("rise")).otherwise(F.lit("fall"))
    return jumps.select("trace", F.col("j.prev_i").alias("juncture"), way.alias("direction"), F.col("j.delta").alias("jump"))


def commitment_targets(steps: DataFrame, least: float) -> DataFrame:
    """The first boundary of each trace whose change from the last probe is above `least`, and below -`least`."""
    up, down = F.min(F.when(F.col("delta") > least, F.col("i"))), F.min(F.when(F.col("delta") < -least, F.col("i")))
    return steps.groupBy("trace").agg(up.alias("first_up"), down.alias("first_down"))


def sharpest_step(steps: DataFrame) -> DataFrame:
    """The largest change between adjacent boundaries of each trace, with its sign, the first of equal ones; 0 and no
    boundary where there is none."""
    size = F.when((F.col("gap") == 1) & (F.col("delta") != 0), F.struct(F.abs(F.col("delta")).alias("size"), (-F.col("i")).alias("first")))
    best = steps.groupBy("trace").agg(F.max_by(F.struct("i", "delta"), size).alias("b"), F.max(size).alias("s"))
    some = F.col("s").isNotNull()
    return best.select("trace", F.when(some, F.col("b.delta")).otherwise(F.lit(0.0)).alias("jump"), F.when(some, F.col("b.i")).alias("jump_at"))


def first_fall_below(steps: DataFrame, level: float = 0.5) -> DataFrame:
    """The first boundary at which the rate falls from at least `level` to below it."""
    fell = (F.col("prev_r") >= level) & (F.col("r") < level)
    return steps.groupBy("trace").agg(F.min(F.when(fell, F.col("i"))).alias("crossing"))


def trace_metrics(probes: DataFrame, least: float = JUMP) -> DataFrame:
    """One row a trace: number of probes; `ns`, its sentences (the column ns where the probes have one, else the last
    boundary); first, last, least, largest and mean rate; swing (last less first); sharpest step; juncture, direction,
    signed shift and place in the trace (NULL without juncture); all valid outcomes. Rows without a trace are one trace
    without steps."""
    steps = with_steps(clean(probes))
    length = F.max("ns") if "ns" in probes.columns else F.max("i")
    base = steps.groupBy("trace").agg(
        F.count("*").alias("np"),
        length.alias("ns"),
        F.min_by("r", "i").alias("r0"),
        F.max_by("r", "i").alias("r1"),
        F.min("r").alias("rmin"),
        F.max("r").alias("rmax"),
        F.avg("r").alias("rmean"),
        (F.max_by("r", "i") - F.min_by("r", "i")).alias("swing"),
        F.sum("nv").alias("nv"),
    )
    out = base.join(sharpest_step(steps), "trace", "left").withColumn("jump", F.coalesce("jump", F.lit(0.0))).join(first_juncture(steps, least).withColumnRenamed("jump", "jdelta"), "trace", "left")
    # a stated number of 0 is none; a last boundary of 0 is one like any other
    known = F.col("juncture").isNotNull() & ((F.col("ns") != 0) if "ns" in probes.columns else F.lit(True))
    place = F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("juncture") / F.greatest(F.lit(1), F.col("ns") - 1))))
    return out.withColumn("jpos", place)


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of the equal bins, empty ones too; values outside count at the ends."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / (high - low) * bins))).cast("int")
    counts = values.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = F.lit(low) + F.col("bin") * F.lit((high - low) / bins)
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), edge.alias("edge"))


def aligned_profile(probes: DataFrame, junctures: DataFrame, span: int = 6) -> DataFrame:
    """Mean rate, with its interval, of the sentences at each offset from the traces' junctures, -span to span; offsets
    without probes have n = 0. A boundary closes the sentence before it."""
    at = probes.join(junctures.select("trace", "juncture"), "trace").withColumn("offset", (F.col("i") - 1 - F.col("juncture")).cast("int"))
    n, mean, low, high = mean_ci(F.col("r"))
    means = at.where(F.col("offset").between(-span, span)).groupBy("offset").agg(mean.alias("mean_rate"), low.alias("low"), high.alias("high"), n.alias("n"))
    every = probes.sparkSession.range(-span, span + 1).select(F.col("id").cast("int").alias("offset"))
    return every.join(F.broadcast(means), "offset", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grid_profile(probes: DataFrame, bins: int = 20) -> DataFrame:
    """Mean over traces, with its interval, of the rate at equal steps of boundary from the first to the last, linear
    between probes; traces of one probe are in none.

    Each probe makes the grid points behind the one before it and up to it, so no trace is joined with the grid.
    """
    w, whole = by_trace(), Window.partitionBy("trace")
    sized = with_steps(clean(probes)).withColumns({"first": F.min("i").over(whole), "last": F.max("i").over(whole), "rank": F.row_number().over(w)}).where("last > first")
    # grid point g stands at boundary first + g * (last - first) / (bins - 1)
    width = F.col("last") - F.col("first")
    upto = lambda i: F.floor((i - F.col("first")) * (bins - 1) / width).cast("int")
    low = F.when(F.col("rank") == 1, F.lit(0)).otherwise(upto(F.col("prev_i")) + 1)
    high = upto(F.col("i"))
    points = sized.withColumn("bin", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    part = (F.col("first") + F.col("bin") * width / (bins - 1) - F.col("prev_i")) / F.col("gap")
    value = F.when(F.col("rank") == 1, F.col("r")).otherwise(F.col("prev_r") + part * F.col("delta"))
    n, mean, low_end, high_end = mean_ci(F.col("value"))
    return points.withColumn("value", value).groupBy("bin").agg(mean.alias("mean_rate"), low_end.alias("low"), high_end.alias("high"), n.alias("n"))


def next_probes(probes: DataFrame, order: str = "slope", least_spacing: int = 1) -> DataFrame:
    """For each trace the midpoint to probe next: of the gap (more than 1) with the steepest change, or the widest; the
    first of equal ones. Slopes count to nine places: equal ones come out of subtractions with different last bits."""
    steps = with_steps(probes).where("gap > 1")
    size = F.round(F.abs(F.col("delta")) / F.col("gap") * 1e9) / 1e9 if order == "slope" else F.col("gap").cast("double")
    middle = F.floor((F.col("prev_i") + F.col("i")) / 2)
    fits = ((middle - F.col("prev_i")) >= least_spacing) & ((F.col("i") - middle) >= least_spacing)
    best = Window.partitionBy("trace").orderBy(F.desc("size"), "prev_i")
    found = steps.withColumns({"size": size, "next_i": middle}).where(fits).withColumn("rank", F.row_number().over(best))
    return found.where("rank = 1").select("trace", "next_i", "size")


def neighbourhood(probes: DataFrame, centres: DataFrame, width: int = 3) -> DataFrame:
    """The `width` probes around each trace's centre boundary, moved inward at the ends; none where it wasn't probed."""
    w, whole = by_trace(), Window.partitionBy("trace")
    ranked = probes.withColumns({"k": F.row_number().over(w) - 1, "n": F.count("*").over(whole)})
    near = ranked.join(centres, "trace").withColumn("c", F.min(F.when(F.col("i") == F.col("centre"), F.col("k"))).over(whole))
    first = F.least(F.greatest(F.col("c") - width // 2, F.lit(0)), F.greatest(F.col("n") - width, F.lit(0)))
    return near.where(F.col("c").isNotNull() & (F.col("k") >= first) & (F.col("k") < first + width)).select("trace", "i", "r")


def transitions(rows: DataFrame, column: str, trace: str = "trace", at: str = "i") -> DataFrame:
    """Of a feature: bounded change, slope over three rows, distance from the running mean, least and largest of the
    rows before. The first row of a trace has none, the slope needs three values."""
    w = by_trace(trace, at)
    past, three = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-2, 0)
    x, before = F.col(column), F.lag(column).over(w)
    return rows.withColumns(
        {
            f"{column}_delta": bounded_change(x, before),
            f"{column}_slope3": F.when(F.count(x).over(three) == 3, (x - F.lag(column, 2).over(w)) / 2),
            f"{column}_devrun": x - F.avg(x).over(past),
            f"{column}_min_gap": x - F.min(x).over(past),
            f"{column}_max_gap": x - F.max(x).over(past),
        }
    )


def positions(rows: DataFrame) -> DataFrame:
    """Place of each row in its trace: position, length, remaining, relative place from both ends; neighbours' rates."""
    w, whole = by_trace(), Window.partitionBy("trace")
    out = rows.withColumns({"position": F.row_number().over(w) - 1, "length": F.count("*").over(whole), "next_r": F.lead("r").over(w), "prev_r": F.lag("r").over(w)})
    share = F.when(F.col("length") > 1, F.col("position") / (F.col("length") - 1)).otherwise(F.lit(0.0))
    return out.withColumns({"remaining": F.col("length") - 1 - F.col("position"), "normalized": share, "reverse": 1 - share})


def slots(rows: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The last k values up to each row, newest first, and which of the k slots are filled."""
    held = F.reverse(F.collect_list(column).over(by_trace().rowsBetween(-(k - 1), 0)))
    return rows.withColumn("slots", held).withColumn("filled", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: j <= F.size("slots")))


def regions(rows: DataFrame, size: str, recent: int = 4) -> DataFrame:
    """Start and end of each row in running units of `size`; how much lies in the last `recent` rows and before them."""
    w = by_trace()
    out = rows.withColumn("end_at", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start_at", F.col("end_at") - F.col(size))
    begin = F.first("start_at").over(w.rowsBetween(-(recent - 1), 0))
    return out.withColumns({"recent_size": F.col("end_at") - begin, "early_size": begin, "prev_size": F.lag(size).over(w)})


def usable_steps(rows: DataFrame, text: str | None = None, least_valid: int = 11) -> DataFrame:
    """Steps between two probes with enough valid outcomes each and, if there is text, a usable sentence."""
    from ..functions.text import usable_sentence

    fine = F.col("delta").isNotNull() & (F.col("nv") >= least_valid) & (F.col("prev_nv") >= least_valid)
    return rows.where(fine & usable_sentence(F.col(text)) if text else fine)
