"""Cases whose results were worked out by hand from the rules, and three published curves."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import intervals, jsonx, text
from cairn.operators import curves, labels, metrics, records, select, summaries
from cairn.streaming import incremental

# published curves: boundary, valid, truthful outcomes
RISING = [(1, 48, 47), (2, 49, 49), (3, 48, 48), (4, 48, 48), (5, 47, 46), (6, 49, 47), (7, 49, 41), (8, 42, 38), (9, 45, 0), (10, 41, 0), (11, 44, 0), (12, 47, 1), (13, 47, 1), (15, 48, 0)]
FALLING = [(1, 50, 4), (3, 50, 3), (4, 50, 1), (5, 50, 2), (6, 50, 7), (8, 50, 7), (9, 50, 7), (10, 50, 6), (11, 50, 45), (21, 50, 50), (31, 50, 50), (36, 50, 49), (39, 50, 50), (40, 50, 50), (41, 50, 50), (42, 50, 50)]
LATE = [(1, 43, 31), (2, 48, 37), (3, 46, 39), (4, 45, 43), (5, 48, 42), (6, 49, 47), (7, 44, 42), (8, 48, 47), (10, 47, 46), (11, 47, 33), (12, 50, 13), (13, 50, 2), (14, 50, 0), (16, 50, 0)]


def published(spark):
    rows = [(name, i, nv, nt, len(c)) for name, c in (("rising", RISING), ("falling", FALLING), ("late", LATE)) for i, nv, nt in c]
    probes = spark.createDataFrame(rows, "trace string, i int, nv long, nt long, ns int")
    return probes.withColumn("r", intervals.deception_rate(F.col("nt"), F.col("nv")))


def probes_of(spark, curves_):
    rows = [(t, i, 10, 0, float(r)) for t, c in curves_.items() for i, r in c]
    return spark.createDataFrame(rows, "trace string, i int, nv long, nt long, r double")


def test_published_curves(spark):
    p = published(spark)
    got = {r["trace"]: r for r in curves.trace_metrics(p).collect()}
    assert [(got[t]["juncture"], got[t]["direction"], round(got[t]["jpos"], 4)) for t in ("rising", "late")] == [(8, "rise", 0.6154), (11, "rise", 0.8462)]
    assert [(got[t]["np"], round(got[t]["r0"], 4), round(got[t]["r1"], 4)) for t in ("rising", "falling", "late")] == [(14, 0.0208, 1.0), (16, 0.92, 0.0), (14, 0.2791, 1.0)]
    fall = got["falling"]
    assert fall["jump_at"] == 11 and round(fall["jump"], 4) == -0.78 and round(fall["swing"], 4) == -0.92
    assert {r["trace"]: r["crossing"] for r in curves.first_fall_below(curves.with_steps(p)).collect()}["falling"] == 11
    low, high = intervals.complement_wilson(F.col("nt"), F.col("nv"))
    ends = {(r["trace"], r["i"]): (round(r["r"], 4), round(r["low"], 4), round(r["high"], 4)) for r in p.withColumns({"low": low, "high": high}).collect()}
    assert ends["rising", 1] == (0.0208, 0.0037, 0.109) and ends["late", 12] == (0.74, 0.6045, 0.8413) and ends["falling", 11] == (0.1, 0.0435, 0.2136)


def test_no_valid_outcome_is_half(spark):
    low, high = intervals.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(intervals.deception_rate(F.lit(0), F.lit(0)), low, high).first()) == (0.5, None, None)


def test_junctures_by_definition(spark):
    p = probes_of(spark, {"gap": [(1, 0.1), (2, 0.2), (4, 0.9), (5, 0.95)], "edge": [(1, 0.2), (2, 0.5)], "fall": [(1, 0.9), (2, 0.2)]})
    steps = curves.with_steps(p)
    assert {r["trace"]: (r["juncture"], r["direction"], round(r["jump"], 4)) for r in curves.first_juncture(steps).collect()} == {"edge": (1, "rise", 0.3), "fall": (1, "fall", -0.7)}
    strict = curves.commitment_targets(steps, 0.3).collect()
    assert {r["trace"]: (r["first_up"], r["first_down"]) for r in strict} == {"gap": (4, None), "edge": (None, None), "fall": (None, 2)}


def test_profiles_go_by_boundary(spark):
    p = probes_of(spark, {"t": [(1, 0), (2, 0), (10, 1)], "one": [(5, 0.7)]})
    grid = {r["bin"]: r for r in curves.grid_profile(p).collect()}
    values = [max(0.0, (1 + 9 * b / 19 - 2) / 8) for b in range(20)]
    assert [grid[b]["mean_rate"] for b in range(20)] == pytest.approx(values) and sum(values) / 20 == pytest.approx(0.4473684)
    assert all(g["n"] == 1 and g["low"] == g["high"] == g["mean_rate"] for g in grid.values())
    two = probes_of(spark, {"a": [(1, 0.2), (2, 0.8), (3, 0.9)], "b": [(4, 0.1), (5, 0.5)]})
    at = curves.first_juncture(curves.with_steps(two))
    got = {r["offset"]: r for r in curves.aligned_profile(two, at).collect()}
    # a boundary closes the sentence before it: boundary 2 of the first trace stands at its juncture, sentence 1
    assert [(got[o]["n"], got[o]["mean_rate"]) for o in (-1, 0, 1)] == [(2, pytest.approx(0.15)), (2, pytest.approx(0.65)), (1, 0.9)]
    half = 1.96 * math.sqrt(0.3**2 / 2) / math.sqrt(2)
    assert got[0]["low"] == pytest.approx(0.65 - half) and got[0]["high"] == pytest.approx(0.65 + half)
    assert got[5]["n"] == 0 and got[5]["mean_rate"] is None


def test_neighbours_of_a_probed_centre_only(spark):
    p = probes_of(spark, {"t": [(1, 0), (3, 0), (6, 0), (9, 0)]})
    at = lambda c: sorted(r["i"] for r in curves.neighbourhood(p, spark.createDataFrame([("t", c)], "trace string, centre int")).collect())
    assert at(1) == [1, 3, 6] and at(6) == [3, 6, 9] and at(9) == [3, 6, 9] and at(4) == []


@pytest.mark.parametrize(
    ("said", "spans"),
    [
        ("Hi there. Costs 3.5 now! See Dr. Lee? yes", [(0, 9), (10, 24), (25, 37), (38, 41)]),
        ('He said "no." Then left.', [(0, 13), (14, 24)]),
        ("Wait... ok.", [(0, 5), (5, 6), (6, 7), (8, 11)]),
        ("He said No. Then left. See Fig. 3 now.", [(0, 11), (12, 22), (23, 38)]),
        ("  \n", []),
        (None, []),
    ],
)
def test_sentence_spans(said, spans):
    assert text.sentence_spans(said) == spans


def test_cut_before_the_last_sentences():
    said = [f"This is sentence number {i} of the reasoning, long enough." for i in range(5)]
    head, tail = text.cut_before_last(" ".join(said) + "</think> the answer. And more.")
    assert head.strip() == " ".join(said[:3]) and tail.strip() == " ".join(said[3:])
    assert text.cut_before_last(" ".join(said[:3])) is None and text.cut_before_last("short. text. here.") is None and text.cut_before_last(None) is None


def test_objects_behind_a_reasoning():
    got, before = jsonx.last_object('I think "}" so.\n\n\n\nthen\nJSON Response:\n{"a": {"b": "}"}} tail')
    assert got == {"a": {"b": "}"}} and before == 'I think "}" so.\n\nthen'
    assert jsonx.last_object('open " quote {"a": 1}') is None  # everything behind a quote that stays open is quoted
    assert list(jsonx.balanced("a } {b} {c {d} e}")) == [(4, 7), (8, 17)]
    pieces = ["{", "}", '"', "\\", "a", '\\"', " ", "\n"]
    rnd = random.Random(3)
    for _ in range(3000):
        t = "".join(rnd.choices(pieces, k=rnd.randint(0, 14)))
        assert list(jsonx.balanced(t)) == slowly_balanced(t)


def slowly_balanced(t):
    plain, quoted, skip = [], False, False
    for i, c in enumerate(t):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        else:
            plain.append((i, c))
    out, depth, first = [], 0, 0
    for i, c in plain:
        if c == "{":
            first = first if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append((first, i + 1))
    return out


def test_options_of_a_prompt(spark):
    rows = spark.createDataFrame([("- Option 1 (a)\n- option 2 ( b )\n- Option 1 (c)\n- Option 0 (d)",), (None,)], "p string")
    assert [r[0] for r in rows.select(jsonx.option_map(F.col("p"))).collect()] == [{2: "b", 1: "c"}, None]


def test_mixed_ids_balance():
    assert select.balance_split(2, 2, 0) == 0
    assert select.balance_split(5, 0, 0) == 2  # 2 and 3 are as even: the one nearest to half of the mixed


def slowly_split(mixed, true_, false_, to_true, to_false):
    best = None
    for x in range(mixed + 1):
        t, f = true_ + x, false_ + mixed - x
        if to_true is None and to_false is None:
            key = (-abs(t - f), min(t, f), -abs(x - mixed // 2))
        else:
            a, b = t if to_true is None else min(t, to_true), f if to_false is None else min(f, to_false)
            key = (a + b, -abs(a - b), -abs(t - f))
        if best is None or key > best[0]:
            best = (key, x)
    return best[1]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30), st.none() | st.integers(0, 40), st.none() | st.integers(0, 40))
def test_splits_as_by_trying_all(mixed, true_, false_, to_true, to_false):
    assert select.balance_split(mixed, true_, false_, to_true, to_false) == slowly_split(mixed, true_, false_, to_true, to_false)


def test_balanced_labels_in_order_of_first_sight(spark):
    rows = [("A", True), ("B", True), ("C", True), ("C", False), ("D", False), ("D", True), ("D", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, id string, label boolean")
    assert {r["id"]: r["label"] for r in select.balanced_labels(df, "id", "label", ["at"]).collect()} == {"A": True, "B": True, "C": False, "D": False}
    stats = select.dedup_statistics(df.where("label is not null"), "id", "label").first()
    assert tuple(stats) == (2, 2, 2)
    some = spark.createDataFrame([(i, k, lab) for i, k in enumerate("dbca") for lab in (True, False)], "at int, id string, label boolean")
    assert {r["id"] for r in select.balanced_labels(some, "id", "label", ["at"]).collect() if r["label"]} == {"d", "b"}


def test_places_in_one_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(7)
    got = select.placed(df, ["x"], "place").collect()
    assert len(got) == 5000 and all(r["place"] == r["x"] for r in got)


def test_quantiles_and_thresholds(spark):
    rows = [("g", y, s) for y, s in ((1, 4.0), (0, 3.0), (0, 2.0), (0, 1.0))] + [("none", 0, 1.0), ("all", 1, 1.0), ("all", 1, 3.0), ("bad", 1, float("nan"))]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    got = {r["k"]: r["threshold"] for r in metrics.prevalence_threshold(df, ["k"], "y", "s", 0.5).collect()}
    assert got == {"g": 3.25, "none": math.inf, "all": -math.inf, "bad": 0.5}
    best = {r["k"]: (r["threshold"], r["balanced_accuracy"]) for r in metrics.balanced_threshold(df, ["k"], "y", "s").collect()}
    assert best == {"g": (4.0, 1.0), "none": (1.0, 0.0), "all": (1.0, 1.0)}
    rnd = np.random.default_rng(2)
    many = [(f"k{i % 3}", int(rnd.integers(0, 2)), float(x)) for i, x in enumerate(np.round(rnd.normal(size=3000) ** 3, 2))]
    many = spark.createDataFrame(many, "k string, y int, s double")
    cuts = {r["k"]: r["threshold"] for r in metrics.prevalence_threshold(many, ["k"], "y", "s").collect()}
    rates = {(r["k"], r["recall"]): r["fpr"] for r in metrics.fpr_at_recall(many, ["k"], "y", "s").collect()}
    for k in ("k0", "k1", "k2"):
        own = [r for r in many.collect() if r["k"] == k]
        s, y = np.array([r["s"] for r in own]), np.array([r["y"] for r in own])
        assert cuts[k] == pytest.approx(np.quantile(s, 1 - y.mean()))
        for recall in (0.5, 0.8, 0.9, 0.95):
            assert rates[k, recall] == pytest.approx((s[y == 0] >= np.quantile(s[y == 1], 1 - recall) - 1e-12).mean(), abs=2e-3)


def test_consistency_by_hand(spark):
    rows = [("a", 1.0), ("a", 0.5), ("b", -0.6), ("b", -0.8), ("c", 2.0), ("c", -2.0), ("d", 0.9), ("d", None), ("e", None), ("e", None)]
    got = {r["f"]: r for r in metrics.consistency(spark.createDataFrame(rows, "f string, effect double"), "f").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"]["score"] == pytest.approx(0.5 + 0.35 * 0.75 - 0.25 * 0.25) and got["a"]["direction"] == "positive"
    assert got["b"]["least"] == pytest.approx(0.6) and got["b"]["direction"] == "negative" and got["c"]["direction"] == "mixed"
    assert got["c"]["score"] == pytest.approx(2 + 0.7 - 0.5) and got["d"]["groups"] == 1 and got["d"]["direction"] == "mixed"
    assert [f for f, _ in sorted(got.items(), key=lambda x: x[1]["place"])] == ["c", "d", "b", "a"]


def test_shares_of_mass(spark):
    v = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(metrics.effective_support(v(*x))) for x in ((1, 0, 0), (1, 1, 1, 1), (5,), (0, 0))] == [0.0, 1.0, 1.0, None]
    assert one(metrics.effective_support(v(1, 1, 0))) == pytest.approx(0.5)
    assert [one(metrics.herfindahl(v(*x))) for x in ((1, 0), (1, 1), (5,), (0,))] == [1.0, 0.0, 1.0, None]
    assert one(metrics.top_mass(v(1, 3), 1)) == 0.75 and one(metrics.normalized_entropy(v(0, 0))) is None
    assert one(metrics.per_token_mass(F.lit(0.5), F.lit(2))) == 0.25 and one(metrics.mass_ratio(F.lit(1.0), F.lit(3.0))) == 0.25
    assert tuple(one(metrics.head_summary(v(1, 3, float("nan"))))) == (2.0, 1.0, 3.0)


def test_reputation_moves_in_capped_steps(spark):
    fold = lambda xs, **kw: spark.range(1).select(labels.reputation(F.array(*[F.lit(x) for x in xs]).cast("array<double>"), **kw)).first()[0]
    assert fold([2.0]) == pytest.approx(52.2) and fold([9.0]) == 54.0 and fold([-1.0]) == 48.0 and fold([-50.0]) == 40.0
    assert fold([-50.0] * 9) == 0.0 and fold([50.0] * 20) == 100.0 and fold([]) == 50.0 and fold([0.0]) == pytest.approx(50.4)


def test_groups_into_splits_in_order(spark):
    groups = spark.createDataFrame([(0, 3), (1, 2), (2, 4), (3, 1)], "k int, n int")
    got = select.fill_splits(groups, "n", ["k"], [("test", 4), ("validation", 3), ("train", 1)]).collect()
    assert {r["k"]: r["split"] for r in got} == {0: "test", 1: "test", 2: "validation", 3: "train"}


def test_dialogue_islands(spark):
    rows = [(1, "A", "x"), (2, "A", "y"), (3, "B", "z"), (4, "A", "w")]
    got = summaries.islands(spark.createDataFrame([("c", *r) for r in rows], "c string, turn int, who string, said string"), ["c"], "turn", "who", "said").orderBy("island").collect()
    assert [(r["who"], r["said"]) for r in got] == [("A", "x\ny"), ("B", "z"), ("A", "w")]


def test_spread_of_four(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert df.select(F.percentile("x", F.lit(0.25))).first()[0] == 1.75
    assert [round(v, 4) for v in df.select(F.stddev_pop("x"), F.stddev_samp("x")).first()] == [1.118, 1.291]


def sampled(n, sampler, **parameters):
    asked = []

    def ask(trace, i, count):
        asked.append(i)
        return sampler(i, count)

    return incremental.search_trace("t", n, ask, **parameters), asked


def test_search_goes_by_the_bracket_from_zero():
    probes, asked = sampled(40, lambda i, c: (c, 0 if i >= 13 else c), samples=10, coarse=3, refine=0)
    assert asked == [40, 1, 20, 10, 15] and [p[0] for p in probes] == [1, 10, 15, 20, 40]
    # too few valid outcomes count as below one half; the ends need not differ
    _, asked = sampled(16, lambda i, c: (1, 0), samples=10, coarse=2, refine=0, least_valid=5)
    assert asked == [16, 1, 8, 12]
    _, asked = sampled(16, lambda i, c: (c, 0), samples=10, coarse=9, refine=0, least_step=4)
    assert asked == [16, 1, 8, 4]
    # steepest gaps first (the earlier of equals), widest ones where no gap is left between probes far enough apart
    _, asked = sampled(9, lambda i, c: (c, c), samples=4, coarse=0, refine=2)
    assert asked == [9, 1, 5, 3]
    _, asked = sampled(9, lambda i, c: (c, c), samples=4, coarse=0, refine=9, spacing=3)
    assert asked[:3] == [9, 1, 5] and sorted(asked) == list(range(1, 10))


def test_games_by_name_context_columns_and_prompt(spark):
    rows = spark.createDataFrame([("BS ", None, None, None), (None, '{"type":"car_sales_seller_response"}', None, None), (None, None, 7, "a maze"), (None, None, None, "a MAZE"), (None, None, None, "recommended_investment_id only"), (None, None, None, None)], "game_type string, truth_context string, max_rounds int, prompt string").withColumn("action", F.lit(None).cast("string"))
    out = records.read(rows)
    assert [r[0] for r in out.select(records.inferred_game(out)).collect()] == ["bs", "car_sales", "car_sales", "gridworld", "bs", "bs"]
