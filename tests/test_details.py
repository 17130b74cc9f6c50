"""Streams against batches, and the smaller operators on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from cairn.operators import curves, details, select, summaries
from cairn.streaming import incremental

SF = "/root/testdata/sf0.001"


def key(rows):
    return sorted(map(repr, rows))


def test_windows_on_a_stream_equal_those_on_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_of(spark, str(tmp_path / "in"), events.schema)
    out = str(tmp_path / "out")
    counted = incremental.windowed(stream, "1 hour", watermark="40 days")
    incremental.run_all(counted, lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out), str(tmp_path / "mark"))
    latest = select.first_per(spark.read.parquet(out), ["start", "event_type"], [F.desc("batch")]).drop("batch")
    want = incremental.windowed(events)
    round_ = lambda df: [(str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect()]
    assert key(round_(latest)) == key(round_(want))
    again = incremental.windowed(incremental.stream_of(spark, str(tmp_path / "in"), events.schema), "1 hour", watermark="40 days")
    seen = []
    incremental.run_all(again, lambda batch, i: seen.append(batch.count()), str(tmp_path / "mark"))
    assert sum(seen) == 0  # a rerun goes on behind the last batch


def test_running_counts_finish_with_rates(spark):
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, False)], "k string, v boolean, d boolean")
    got = {r["k"]: (r["n"], r["valid"], r["rate"]) for r in incremental.finished(incremental.running_counts(df, ["k"], F.col("v"), F.col("d"))).collect()}
    assert got == {"a": (2, 2, 0.5), "b": (1, 0, None)}


def test_vector_variants(spark):
    df = spark.createDataFrame([([[3.0, 3.0], [1.0, 2.0], [9.0, 9.0]], [True, True, False]), ([[3.0, 3.0]], [True])], "s array<array<double>>, f array<boolean>")
    got = [tuple(r) for r in df.select(*[details.vector_variant(F.col("s"), F.col("f"), v) for v in ("final", "delta_last", "delta_mean")]).collect()]
    assert got == [([3.0, 3.0], [2.0, 1.0], [2.0, 1.0]), ([3.0, 3.0], [0.0, 0.0], [0.0, 0.0])]
    with pytest.raises(ValueError):
        details.vector_variant(F.col("s"), F.col("f"), "x")


def test_spans_meet_tokens(spark):
    df = spark.createDataFrame([([(0, 3), (3, 4), (4, 9)],)], "o array<struct<s:int,e:int>>")
    find = lambda a, b: df.select(details.tokens_in_span(F.col("o"), F.lit(a), F.lit(b))).first()[0]
    assert find(0, 4) == [0, 1] and find(8, 9) == [2] and find(9, 12) == []


def test_quota_scan_keeps_all_where_a_label_is_short(spark):
    df = spark.range(20).select("id", F.when(F.col("id") % 4 == 0, "d").otherwise("t").alias("l"))
    assert details.until_quotas(df, "l", "id", {"d": 2, "t": 2}).count() == 5
    assert details.until_quotas(df, "l", "id", {"d": 9, "t": 2}).count() == 20


def test_choices_and_controls(spark):
    assert details.spaced(10, 4) == [0, 3, 6, 9] and details.spaced(3, 9) == [0, 1, 2] and details.spaced(5, 1) == [0] and details.spaced(0, 2) == []
    df = spark.createDataFrame([(i, i % 3, i < 4) for i in range(30)], "id int, layer int, chosen boolean")
    got = details.matched_controls(df, F.col("chosen"), "layer", "id", 1)
    assert {r["layer"]: r["n"] for r in got.groupBy("layer").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 2: 1}
    assert got.where("chosen").count() == 0


def test_vector_faults_and_worked_examples(spark):
    df = spark.createDataFrame([(None,), ([1.0],), ([0.0, 0.0],), ([math.nan, 1.0],), ([1.0, 2.0],)], "v array<double>")
    r = details.vector_faults(df, "v", 2).first()
    assert (r["missing"], r["wrong_length"], r["not_finite"], r["zero"], r["n"]) == (1, 1, 1, 1, 5)
    rows = spark.createDataFrame([(1, "a", "m", 5.0), (2, "a", "m", 4.0), (3, "b", "n", 1.0)], "id int, cell string, model string, s double")
    any_ = F.lit(True)
    picked = details.worked_examples(rows, ("cell", "model"), "id", {"x": (any_, F.col("s")), "y": (any_, F.col("s")), "z": (any_, F.col("s"))})
    assert [p[1] for p in picked] == [1, 3, 1]  # the best; the best of a new cell; any


def test_islands_and_curves_with_nulls(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "b"), (1, 2, None, "c"), (1, 3, None, "d"), (1, 4, "u", "e")], "c int, t int, who string, said string")
    got = [(r["who"], r["said"]) for r in summaries.islands(df, ["c"], "t", "who", "said").orderBy("island").collect()]
    assert got == [("u", "a\nb"), (None, "c\nd"), ("u", "e")]
    empty = spark.createDataFrame([], "trace string, i int, nv int, nt int, r double")
    assert curves.trace_metrics(empty).collect() == [] and curves.grid_profile(empty).collect() == []
    assert [r["n"] for r in curves.histogram(empty.withColumn("x", F.lit(None).cast("double")), "x", 0.0, 1.0, 3).collect()] == [0, 0, 0]


def test_traces_without_juncture_have_no_place(spark):
    rates = {"calm": [0.1, 0.2, 0.3], "late": [0.1, 0.2, 0.9]}
    probes = spark.createDataFrame([(t, i + 1, 10, 0, r) for t, rs in rates.items() for i, r in enumerate(rs)], "trace string, i int, nv int, nt int, r double")
    index = curves.trace_metrics(probes)
    assert {r["trace"]: (r["juncture"], r["jpos"]) for r in index.collect()} == {"calm": (None, None), "late": (2, 1.0)}
    assert [r["n"] for r in curves.histogram(index, "jpos", 0.0, 1.0, 10).orderBy("bin").collect()] == [0] * 9 + [1]


def test_metrics_of_rows_without_trace_and_of_early_boundaries(spark):
    rows = [(None, 1, 10, 0, 0.1), (None, 2, 10, 0, 0.9), ("early", -1, 10, 0, 0.1), ("early", 0, 10, 0, 0.9)]
    probes = spark.createDataFrame(rows, "trace string, i int, nv int, nt int, r double")
    got = {r["trace"]: (r["np"], r["jump"], r["jump_at"], r["juncture"], r["jpos"]) for r in curves.trace_metrics(probes).collect()}
    assert got == {None: (2, 0.0, None, None, None), "early": (2, 0.8, 0, -1, 0.0)}
    stated = curves.trace_metrics(probes.withColumn("ns", F.lit(0))).where("trace = 'early'").first()
    assert stated["jpos"] is None


def test_equal_slopes_go_to_the_first_gap(spark):
    rates = [(1, 0.0), (3, 0.1), (5, 0.2), (7, 0.3), (9, 0.4)]  # 0.3 - 0.2 and 0.4 - 0.3 are not 0.1 in the last bits
    assert len({b - a for (_, a), (_, b) in zip(rates, rates[1:], strict=False)}) > 1
    probes = spark.createDataFrame([(way, i, 10, 0, r if way == "up" else 0.4 - r) for way in ("up", "down") for i, r in rates], "trace string, i int, nv int, nt int, r double")
    probes = probes.unionByName(spark.createDataFrame([("late", 1, 10, 0, 0.3), ("late", 3, 10, 0, 0.2), ("late", 5, 10, 0, 0.3), ("late", 7, 10, 0, 0.4)], probes.schema))
    assert {r["trace"]: (r["next_i"], r["size"]) for r in curves.next_probes(probes).collect()} == {"up": (2, 0.05), "down": (2, 0.05), "late": (2, 0.05)}
