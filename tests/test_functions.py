"""Functions and operators on small tables, against values worked out by hand or by plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import coerce, intervals, jsonx, text
from cairn.operators import curves, explore, joins, labels, metrics, models, select, summaries
from cairn.sources import readers, sinks
from cairn.streaming import incremental


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def strings(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_wilson_and_its_complement(spark):
    low, high = intervals.wilson(F.lit(3), F.lit(10))
    assert one(spark, low, high) == pytest.approx((0.10779, 0.60322), abs=1e-4)
    assert one(spark, *intervals.wilson(F.lit(0), F.lit(0))) == (None, None)
    assert one(spark, *intervals.wilson(F.lit(0), F.lit(0), empty=0.0)) == (0.0, 0.0)
    a, b = one(spark, *intervals.complement_wilson(F.lit(7), F.lit(10)))
    assert (a, b) == pytest.approx((0.10779, 0.60322), abs=1e-4)
    assert one(spark, intervals.bounded_change(F.lit(1.0), F.lit(0.0)), intervals.percent_reduction(F.lit(0.0))) == pytest.approx((1.0, 0.0), abs=1e-5)


def test_labels_of_all_variants(spark):
    words = ["1", " TRUE", "deceptive", "0", "truthful", "non_deceptive", "2", "", None]
    assert strings(spark, words, coerce.label) == [True, True, True, False, False, None, None, None, None]
    assert strings(spark, words, lambda c: coerce.label(c, "extended"))[5] is False
    assert strings(spark, words, lambda c: coerce.label(c, "bool")) == [True, True, None, False, None, None, True, None, None]
    assert coerce.resolve_filter("all", only_deceptive=True) == "deceptive_only"
    with pytest.raises(ValueError):
        coerce.resolve_filter("truthful_only", only_deceptive=True)


def test_numbers_and_directions(spark):
    raw = ["1,234", "$95k", "true", "None", "-3.9", "x", "", None]
    assert strings(spark, raw, coerce.optional_int) == [1234, 95, None, None, -3, None, None, None]
    assert strings(spark, ["u", "Down ", "RIGHT", "north", None], coerce.direction) == ["UP", "DOWN", "RIGHT", None, None]
    assert strings(spark, ["10H", "3S", "K", None], coerce.card_rank) == [10, 3, None, None]
    assert strings(spark, ["10H", "3S"], lambda c: coerce.card_rank(c, True)) == [1, 3]


def test_sentences():
    split = lambda t: [t[a:b] for a, b in text.sentence_spans(t)]
    assert split('He said "Go." Then Dr. No paid 3.50 euro! Why?  So') == ['He said "Go."', "Then Dr. No paid 3.50 euro!", "Why?", "So"]
    assert split("") == split(None) == split("  \n") == []
    assert split(" a.. b") == ["a.", ".", "b"]
    rnd = random.Random(2)
    for _ in range(500):
        t = "".join(rnd.choices(["a", ".", "!", " ", "\n", "1", "Mr", '"', "é"], k=rnd.randint(0, 25)))
        spans = text.sentence_spans(t)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert "".join(c for a, b in spans for c in t[a:b] if not c.isspace()) == "".join(c for c in t if not c.isspace())


def test_text_columns(spark):
    assert strings(spark, ["One. Two.", "no stop {x}", "all", ""], text.first_sentence) == ["One.", "no stop", "all", ""]
    assert strings(spark, [' "A  b!" '], text.normalize) == ["a b"]
    assert strings(spark, ["a b/c", " ", None], text.token) == ["a_b_c", None, None]
    assert strings(spark, ["```json\n{}\n```", "x"], text.strip_fences) == ["{}", "x"]
    assert strings(spark, ["<think>why</think> so", "only"], lambda c: text.split_reasoning(c)[0]) == ["why", None]
    assert strings(spark, ["<think>why</think> so", "only"], lambda c: text.split_reasoning(c)[1]) == ["so", "only"]
    assert strings(spark, ["$5 and $1,000.50", ""], text.currency_mentions) == [2, 0]
    assert strings(spark, ["mit or MIT", "mit or gpl", ""], lambda c: text.only_mention(c, "mit|gpl")) == ["mit", None, None]
    assert strings(spark, ["a😀b"], lambda c: text.slice_chars(c, F.lit(1), F.lit(2))) == ["😀"]
    assert strings(spark, ["attn_l12", "x"], text.feature_root) == ["attn", "x"]
    assert strings(spark, ["Car Sales", "bs"], lambda c: text.aliased(c, {"car_sales": ["cars"], "bs": []})) == ["car_sales", "bs"]
    symbols = {b: s for s, b in text.byte_symbols().items()}
    shown = "".join(symbols[b] for b in "é ok\n".encode())
    assert text.repair_bytes(shown) == "é ok\n" and text.repair_bytes("plain") == "plain"
    assert text.cut_before_last("short. text. here.") is None
    long = "This is a sentence of some length in a text. " * 6
    assert text.cut_before_last(long)[0] == ("This is a sentence of some length in a text. " * 4).rstrip()


def test_json_in_text(spark):
    said = 'think {"a": 1} then {"b": {"c": "}"}, } // end'
    assert jsonx.last_object(said) == ({"b": {"c": "}"}}, 'think {"a": 1} then')
    assert jsonx.first_object(said)[0] == {"a": 1}
    assert jsonx.any_object('x ```json\n{"k": 2}\n``` y') == {"k": 2} and jsonx.any_object("none") is None
    assert jsonx.first_document('{"a": 1}trailing') == {"a": 1} and jsonx.first_document("") is None
    assert jsonx.first_balanced("{bad} </think> {\"x\": 1}") == {"x": 1}
    assert jsonx.nested_value({"A": {"Best": 3}}, ["best"]) == 3
    assert jsonx.parsed("{'a': 1}", literals=True) == {"a": 1} and jsonx.parsed("{'a': 1}") is None
    assert jsonx.similar_key("recommend_fund_a", ["recommend_fund_aa", "zzz"]) == "recommend_fund_aa"
    assert strings(spark, [said, "", None], lambda c: jsonx.object_udf("last")(c)) == ['{"b": {"c": "}"}}', None, None]
    assert strings(spark, ["- Option 1 (fund_a)\n- Option 2 (fund_b)"], jsonx.option_map) == [{1: "fund_a", 2: "fund_b"}]


def test_rules(spark):
    judge = lambda v: tuple(one(spark, v)[0])
    hand = lambda *c: F.array(*map(F.lit, c))
    assert judge(labels.cards(F.lit("PLAY"), hand("3H", "3S"), F.lit(3))) == (True, False, "rank_match")
    assert judge(labels.cards(F.lit("PLAY"), hand("10H"), F.lit(1)))[1] is False
    assert judge(labels.cards(F.lit("PLAY"), hand("10H"), F.lit(1), "strict"))[1] is True
    assert judge(labels.cards(F.lit("PASS"), hand("3H"), F.lit(3), "strict")) == (False, None, "pass_with_cards")
    best = hand("UP")
    assert judge(labels.route(F.lit("u"), best)) == (True, False, "optimal")
    assert judge(labels.route(F.lit("u"), best, variant="strict")) == (False, None, "unknown_direction")
    assert judge(labels.route(F.lit("north"), best, variant="environment")) == (True, True, "not_optimal")
    assert judge(labels.advice(F.lit("A"), F.lit("B"))) == (True, True, "not_best")
    offer = lambda claimed, has, real: judge(labels.interview(F.lit("REJECT_CLAIM_HIGHER_OFFER"), F.lit(claimed).cast("int"), F.lit(has), F.lit(real).cast("int"), F.lit(100)))
    assert offer(110, True, 110) == (True, False, "truthful_higher_other_offer") and offer(120, True, 110)[1:] == (True, "inaccurate_other_offer_salary")
    assert offer(90, False, None)[1:] == (True, "fabricated_other_offer") and offer(None, None, 1)[0] is False
    assert judge(labels.disclosure(F.lit("DISCLOSE_ISSUE"))) == (True, False, "disclose_issue") and judge(labels.disclosure(F.lit("x")))[0] is False
    sets = one(spark, labels.issue_sets(hand("a", "b", "c"), hand("a"), hand("a", "b", "z")))[0]
    assert (sets["new"], sets["repeated"], sets["omitted"]) == (["b"], ["a"], ["c"])


def test_worked_curve(spark):
    rates = [0.1, 0.0427, 0.9929, 0.95]
    p = spark.createDataFrame([("t", i + 7, 50, int(50 * (1 - r)), r) for i, r in enumerate(rates)] + [("u", 1, 5, 5, 0.0), ("u", 5, 5, 0, 1.0)], "trace string, i int, nv int, nt int, r double")
    got = {r["trace"]: r for r in curves.trace_metrics(p).collect()}
    assert (got["t"]["juncture"], got["t"]["direction"]) == (8, "rise") and got["t"]["jump"] == pytest.approx(0.9502)
    assert got["u"]["juncture"] is None and got["u"]["jump"] == 0.0  # the gap is wider than one
    loose = curves.first_juncture(curves.with_steps(p), adjacent=False, strict=True).collect()
    assert {r["trace"]: r["juncture"] for r in loose} == {"t": 8, "u": 1}
    assert [tuple(r) for r in curves.next_probes(p).select("trace", "next_i").collect()] == [("u", 3)]
    assert {r["bin"]: r["n"] for r in curves.grid_profile(p, 3).collect()} == {0: 2, 1: 2, 2: 2}


def test_selection(spark):
    assert select.balance_split(4, 1, 1) == 2 and select.balance_split(4, 0, 4) == 4
    assert select.balance_split(5, 0, 0, target_true=4, target_false=0) == 4
    groups = spark.createDataFrame([(i, 10) for i in range(6)], "g int, n int")
    split = {r["g"]: r["split"] for r in select.fill_splits(groups, "n", ["g"], [("test", 15), ("train", 30)]).collect()}
    assert split == {0: "test", 1: "test", 2: "train", 3: "train", 4: "train", 5: "unused"}
    rows = select.resampled(groups, ["g"], 9, 1)
    assert rows.count() == 9 and sorted(r["resample_id"] for r in rows.collect()) == list(range(9))
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (4, 0.91), (8, 0.5)], "k int, gain double")
    choose = lambda least, tol: select.best_with_fallback(df, "k", "gain", least, tol).first()[0]
    assert (choose(0.8, 0), choose(9, 0.05), choose(9, -9)) == (2, 2, 4)
    limited = select.quota(spark.range(20).withColumn("l", F.col("id") % 2), "l", ["id"], {0: 3, 1: 5}, total=6)
    assert [r["id"] for r in limited.orderBy("id").collect()] == [0, 1, 2, 3, 4, 5]


def test_metrics_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [("g", rnd.random() < 0.4, round(rnd.random(), 1)) for _ in range(200)] + [("one", True, 0.5)]
    df = spark.createDataFrame([(g, int(y), s) for g, y, s in rows], "g string, y int, s double")
    got = {r["g"]: r for r in metrics.ranking(df, ["g"], "y", "s").collect()}
    pos, neg = ([s for g, y, s in rows if g == "g" and y == k] for k in (True, False))
    auroc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert got["g"]["auroc"] == pytest.approx(auroc) and got["one"]["auroc"] is None
    assert one(spark, metrics.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))[0] == pytest.approx(math.sqrt(0.5))
    assert one(spark, metrics.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))[0] is None
    even, single = F.array(*[F.lit(0.25)] * 4), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, metrics.normalized_entropy(even), metrics.herfindahl(even), metrics.herfindahl(single), metrics.top_mass(even, 2)) == pytest.approx((1, 0, 1, 0.5))
    vectors = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))
    assert one(spark, metrics.mean_pairwise_cosine(vectors))[0] == pytest.approx(1 / 3)
    bands = one(spark, metrics.layer_bands(F.array(*[F.lit(float(x)) for x in range(7)])))[0]
    assert [b["mean"] for b in bands] == [1.0, 3.5, 5.5]


def test_joins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, g string")
    pool = spark.createDataFrame([(7, "a", 1.0), (8, "a", 2.0), (9, "b", 3.0), (10, "c", 4.0)], "id int, g string, cost double")
    got = sorted((r["id"], r["donor_id"]) for r in joins.donors(t, pool, "g", ["cost", "id"], 2).collect())
    assert got == [(1, 9), (1, 10), (2, 7), (2, 8), (3, 9), (3, 10)]
    spans = spark.createDataFrame([("k", 0, 10), ("k", 5, 30), ("k", 7, 7)], "k string, a int, b int")
    points = spark.createDataFrame([("k", 5), ("k", 10), ("k", 29), ("x", 5)], "k string, p int")
    assert sorted((r["p"], r["a"]) for r in joins.spans_of_points(points, "p", spans, "a", "b", ["k"], 4).collect()) == [(5, 0), (5, 5), (10, 5), (29, 5)]
    with pytest.raises(Exception, match="key repeats"):
        joins.one_to_one(t, ["g"]).collect()
    assert joins.one_to_one(t, ["id"]).count() == 3


def test_bootstrap_and_summaries(spark):
    rows = [(10.0, 2.0, 10.0, 5.0)] * 30
    assert summaries.bootstrap_interval(rows, 200) == (pytest.approx(0.3), pytest.approx(0.3))
    assert summaries.bootstrap_interval(rows[:1]) == (None, None)
    df = spark.createDataFrame([("e", i, float(i % 2), None) for i in range(40)], "env string, unit int, a double, b double")
    got = {r["metric"]: r for r in summaries.bootstrap_means(df, "env", "unit", ["a", "b"], 200).collect()}
    assert got["a"]["low"] <= 0.5 <= got["a"]["high"] and (got["b"]["mean"] is None or math.isnan(got["b"]["mean"]))
    assert one(spark, summaries.majority(F.array(F.lit(True), F.lit(True), F.lit(False), F.lit(None).cast("boolean"))))[0] is True


def test_explorer_specification_round_trip():
    q = explore.QuerySpec(env=("a", "b"), least_rate=0.25, search="x y", descending=False, page=2)
    assert explore.QuerySpec.from_url(q.to_url()) == q and explore.QuerySpec.from_url("") == explore.QuerySpec()


def test_scans_of_traces(spark, tmp_path):
    import gzip

    doc = {"example_id": "e1", "raw_text": "a b", "history": [{"sentence_end_idx": 1, "deception_rate": 0.5, "num_valid": 4, "num_truthful": 2, "generations": [{"gen_text": "x", "is_truthful": True}]}, {"sentence_end_idx": 2}]}
    folder = tmp_path / "bs" / "m1" / "localization"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps(doc))
    with gzip.open(folder / "b.json.gz", "wt") as f:
        f.write(json.dumps(doc | {"example_id": "e2", "history": []}))
    t = readers.traces(spark, str(tmp_path))
    assert sorted((r["env"], r["model"], r["example_id"]) for r in t.collect()) == [("bs", "m1", "e1"), ("bs", "m1", "e2")]
    assert readers.probes(t).count() == 2 and readers.probes(t, outer=True).count() == 3
    assert [r["gen_text"] for r in readers.generations(readers.probes(t)).collect()] == ["x"]
    (folder / "c.json").write_text(json.dumps(doc | {"example_id": "e3"}) + "garbage")
    assert [r["example_id"] for r in readers.damaged_traces(spark, str(folder / "c.json")).collect()] == ["e3"]


def test_mined_scan_modes(spark, tmp_path):
    run = tmp_path / "gpu_3" / "2024-05-06" / "r"
    run.mkdir(parents=True)
    (run / "deception_samples.jsonl").write_text('{"sample_id": 4, "deceptive": true}\n\n{bad\n{"is_truthful": "yes", "turn_id": "a b"}\n')
    (run / "meta.json").write_text('{"seed": 5}')
    with pytest.raises(Exception, match="bad JSON"):
        readers.mined_records(spark, str(tmp_path)).collect()
    rows = sorted(readers.mined_records(spark, str(tmp_path), strict=False, meta="seed long").collect(), key=lambda r: r["line_num"])
    assert [(r["line_num"], r["label"], r["record_id"]) for r in rows] == [(1, True, "gpu_3/2024-05-06/r/sample_4"), (4, False, "gpu_3/2024-05-06/r/turn_a_b")]
    assert {(r["gpu"], r["run_date"], r["meta_seed"]) for r in rows} == {("gpu_3", "2024-05-06", 5)}
    assert readers.mined_records(spark, str(tmp_path), "truthful_only", strict=False).count() == 1


def test_typed_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("z", "y")], "N string, s string")
    sinks.write_features(df, str(tmp_path / "f"), [("n", "int"), ("extra", "double")])
    assert sorted((r["n"] is None, r["extra"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [(False, None), (True, None)]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_features(df, str(tmp_path / "f"), [("n", "int")])
    wide = spark.createDataFrame([(1.0, 2.0, 3.0)], "a_l1 double, a_l0 double, b_l0 double")
    assert readers.feature_roots(wide) == {"a": ["a_l0", "a_l1"], "b": ["b_l0"]} and readers.common_roots([wide, wide.drop("b_l0")]) == ["a"]
    flat = sinks.flat_names(spark.range(1).select(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")).alias("s"), "id"))
    assert flat.columns == ["s__x", "s__y", "id"]


def test_adaptive_search():
    asked = []

    def sampler(trace, i, n):
        asked.append(i)
        return n, 0 if i >= 13 else n

    probes = incremental.search_trace("t", 40, sampler, 10)
    known = {i: t for i, _, t in probes}
    assert known[1] == 10 and known[40] == 0 and known[12] == 10 and known[13] == 0
    assert len(asked) == len(set(asked)) <= 2 + 8 + 8 and incremental.search_trace("t", 0, sampler) == []


def test_resume_and_stream(spark, tmp_path):
    items = spark.range(10).withColumnRenamed("id", "k")
    cache = items.where("k < 4").withColumn("tag", F.lit("old"))
    tagged = incremental.cached_map(items, cache, "k", lambda d: d.withColumn("tag", F.lit("new")))
    assert {r["k"]: r["tag"] for r in tagged.collect()} == {k: "old" if k < 4 else "new" for k in range(10)}
    assert sorted(r["k"] for r in joins.pending(items, cache, ["k"]).collect()) == [4, 5, 6, 7, 8, 9]
    edges = incremental.grid_edges(spark, [(1, 0), (1, 1)], 3, 3)
    steps = incremental.distances(edges, 0, 8)
    assert {r["node"]: r["steps"] for r in steps.collect()} == {0: 0, 3: 1, 6: 2, 7: 3, 8: 4, 5: 5, 2: 6}
    moves = {r["node"]: r["moves"] for r in incremental.best_moves(steps, edges).collect()}
    assert moves[2] == [5] and moves[3] == [0]


def test_transfer_plan_and_tfidf(spark):
    assert models.transfer_plan(["a", "b"], "single_source") == [(["a"], "b"), (["b"], "a")]
    assert models.transfer_plan(["a", "b", "c"], "one_out")[0] == (["b", "c"], "a")
    train = spark.createDataFrame([(1, "aa bb bb"), (2, "aa cc")], "id int, t string")
    rows = models.tfidf(train, train, "id", "t").collect()
    norm = sum(r["weight"] ** 2 for r in rows if r["id"] == 1)
    weights = {r["term"]: r["weight"] for r in rows if r["id"] == 1}
    assert norm == pytest.approx(1) and set(weights) == {"aa", "bb", "aa bb", "bb bb"}
    idf = lambda df: math.log(3 / (1 + df)) + 1
    assert weights["bb"] / weights["aa"] == pytest.approx((1 + math.log(2)) * idf(1) / idf(2))


def test_schemas_are_well_formed():
    for ddl in (readers.TRACE, readers.MINED):
        assert T.StructType.fromDDL(ddl).fields
