"""Messages, alignment, attention, environments and model choice against plain Python."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import jsonx, messages
from cairn.operators import alignment, attention, environments, metrics, models, records, select, summaries
from cairn.sources import shared


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_maps_between_texts_never_fall_and_fit_what_is_equal():
    rnd = random.Random(5)
    for _ in range(400):
        raw, decoded = ("".join(rnd.choices("ab c", k=rnd.randint(0, 12))) for _ in range(2))
        got = alignment.prefix_map(raw, decoded)
        assert len(got) == len(raw) + 1 and got == sorted(got) and got[-1] == len(decoded) and got[0] >= 0
        for tag, a, b, c, _ in SequenceMatcher(None, raw, decoded, autojunk=False).get_opcodes():
            if tag == "equal":
                assert all(decoded[got[i] : got[i] + 1] == raw[i] or got[i] > c + i - a for i in range(a, b))
    assert alignment.prefix_map("abc", "abc") == [0, 1, 2, 3] and alignment.prefix_map("ab", "xabx") == [1, 2, 4] and alignment.prefix_map("", "") == [0]


@pytest.mark.parametrize(
    ("offsets", "lies"),
    [([(0, 2), (2, 5)], False), ([(0, 2), (3, 5)], False), ([(0, 1), (3, 5)], True), ([(0, 3), (2, 5)], True), ([(1, 5)], True), ([(0, 2)], True), ([(0, 2), (2, 2), (2, 5)], False), ([], False), ([(3, 1)], True)],
)
def test_offsets_that_lie(spark, offsets, lies):
    df = spark.createDataFrame([("ab cd", [{"s": a, "e": b} for a, b in offsets])], "t string, o array<struct<s:int,e:int>>")
    assert df.select(alignment.offsets_lie(F.col("o"), F.col("t"))).first()[0] is lies


def test_head_metrics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    row = np.abs(rng.normal(size=30))
    place = {"start": 20, "end": 29, "prev_start": 12, "prev_end": 19, "prev3_start": None, "prev3_end": None}
    df = spark.createDataFrame([([float(x) for x in row],)], "a array<double>")
    got = df.select(attention.head_metrics(F.col("a"), {k: F.lit(v).cast("int") for k, v in place.items()}, 5).alias("m")).first()["m"]
    cur, prior, prev = row[20:30], row[:20], row[12:20]
    ptm = lambda x: min(1.0, x.sum() / len(x))
    assert got["current_vs_prior"] == pytest.approx(ptm(cur) / (ptm(cur) + ptm(prior))) and got["current_vs_prev"] == pytest.approx(ptm(cur) / (ptm(cur) + ptm(prev)))
    assert got["current_vs_prev3"] == pytest.approx(1.0, abs=1e-6) and got["recent_vs_early"] == pytest.approx(ptm(row[15:20]) / (ptm(row[15:20]) + ptm(row[:15])))
    p = prior / prior.sum()
    assert got["entropy_prior"] == pytest.approx(-(p * np.log(p)).sum() / np.log(20)) and got["top5_prior"] == pytest.approx(np.sort(p)[-5:].sum())
    first = df.select(attention.head_metrics(F.col("a"), {k: F.lit(v).cast("int") for k, v in {**dict.fromkeys(place), "start": 0, "end": 4}.items()}, 5).alias("m")).first()["m"]
    assert first["current_vs_prior"] is None and first["entropy_prior"] is None and first["current_share_total"] == pytest.approx(1.0, abs=1e-6)


def test_layer_features_summarise_heads(spark):
    heads = [[0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.2, 0.1]]
    df = spark.createDataFrame([(1, 0, heads)], "id int, layer int, heads array<array<double>>")
    place = {**{k: F.lit(None).cast("int") for k in ("prev_start", "prev_end", "prev3_start", "prev3_end")}, "start": F.lit(2), "end": F.lit(3)}
    got = {r["metric"]: r for r in attention.layer_features(df, ["id"], "heads", "layer", place).collect()}
    assert set(got) == set(attention.METRICS)
    share = got["current_share_total"]
    assert share["mean"] == pytest.approx(0.5, abs=1e-5) and share["max"] == pytest.approx(0.7, abs=1e-5) and share["std"] == pytest.approx(0.2, abs=1e-5)
    both = one(spark, attention.context_balance(F.array(*map(F.lit, [0.4, 0.1, 0.1, 0.2])), F.lit(1), F.lit(3), F.lit(3)))
    assert both["balance"] == pytest.approx(0.1 / 0.3) and both["entropy"] == pytest.approx(1.0)


def test_layer_bands_skip_missing_values(spark):
    bands = one(spark, metrics.layer_bands(F.array(*[F.lit(x).cast("double") for x in (1, None, 3, 4, 5)])))
    assert [b["mean"] for b in bands] == [1.0, 3.5, 5.0] and bands[1]["spread"] == 0.5


def test_months_of_a_portfolio(spark):
    rnd = random.Random(2)
    months = [(rnd.uniform(-9, 9), rnd.random() < 0.4, rnd.choice([0.0, 400.0]), rnd.randint(0, 60), rnd.random() < 0.5) for _ in range(12)]
    df = spark.createDataFrame([([dict(zip(("return_pct", "audited", "audit_cost", "commission", "deceptive"), m, strict=True)) for m in months],)], "m array<struct<return_pct:double,audited:boolean,audit_cost:double,commission:int,deceptive:boolean>>")
    got = df.select(environments.settled(F.col("m"))).first()[0]
    value, rep, util = 100_000.0, 50.0, 0
    for row, (r, audited, cost, fee, lie) in zip(got, months, strict=True):
        end = max(0.0, value - cost) * (1 + r / 100)
        earned, fine = 0 if audited else fee, 600 if audited and lie else 0
        after = min(100.0, max(0.0, rep - min(10.0, abs(r) * 1.5 + 0.5) if r < 0 else rep + min(4.0, r * 0.9 + 0.4)))
        util += earned - fine
        assert (row["portfolio_start"], row["portfolio_end"], row["reputation_before"], row["reputation_after"]) == pytest.approx((value, end, rep, after))
        assert (row["commission"], row["penalty"], row["advisor_utility"]) == (earned, fine, util)
        value, rep = end, after
    assert df.select(environments.settled(F.slice("m", 1, 0))).first()[0] == []


def test_vocabulary_falls_back_to_a_union(spark):
    names = [("a", "x", 0), ("a", "y", 1), ("b", "z", 0), ("b", "w", 1)]
    df = spark.createDataFrame(names, "env string, f string, p int")
    assert [(r["f"], r["mode"]) for r in models.shared_vocabulary(df, "env", "f", "p", ["b", "a"]).orderBy("at").collect()] == [(f, "union_fallback") for f in "zwxy"]
    more = df.unionByName(spark.createDataFrame([("b", "y", 2)], df.schema))
    assert [(r["f"], r["at"], r["mode"]) for r in models.shared_vocabulary(more, "env", "f", "p", ["b", "a"]).collect()] == [("y", 0, "intersection")]


def test_run_specs():
    got = models.run_specs(["a", "b", "c"], ["single_source_ood", "holdout_env_ood"])
    assert len(got) == 6 and got[0] == {"scenario": "single_source_ood", "label": "a", "sources": ["a"], "ood": ["b", "c"], "heldout": None}
    assert got[4]["label"] == "All except b" and got[4]["sources"] == ["a", "c"] and got[4]["heldout"] == "b"
    with pytest.raises(ValueError):
        models.run_specs(["a"], ["x"])


def test_loose_objects():
    assert jsonx.loose_object('{"a": "b # c"} tail # x') == {"a": "b # c"}
    assert jsonx.loose_object('so {Action: "PLAY", # why\n "n": [1, 2,], // c\n /* x */ } end') == {"Action": "PLAY", "n": [1, 2]}
    assert jsonx.loose_object("{“Action”: 1}".replace("“Action”", "Action")) == {"Action": 1} and jsonx.loose_object("none") is None and jsonx.loose_object(None) is None


def test_names_that_are_unknown_raise(spark):
    for c in (messages.environment(F.lit("chess")), messages.dialogue_turns(F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("speaker", "A"), ("name", ""), ("role", ""), ("message", " "), ("content", ""))])))):
        with pytest.raises(Exception, match="unknown environment|without speaker"):
            one(spark, c)
    assert one(spark, messages.listed(F.lit(" a, b,,a "))) == ["a", "b"]


def test_messages_for_other_models_stay(spark):
    rows = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("u").alias("content")))
    assert [tuple(m) for m in one(spark, messages.with_system_prompt(rows, F.lit("own"), F.lit("other")))] == [("system", "s"), ("user", "u")]
    assert [tuple(m) for m in one(spark, messages.with_system_prompt(rows, F.lit("own"), F.lit("mistralai/ministral-3")))] == [("system", "own"), ("user", "s\n\nu")]


def test_an_unknown_base_scenario_raises(spark):
    turns = [{"speaker": "A", "name": None, "role": None, "message": "x", "content": None}]
    kind = "scenario_name string, turns array<struct<speaker:string,name:string,role:string,message:string,content:string>>"
    base = spark.createDataFrame([("b", 1)], "name string, pay int")
    got = records.scenario_variants(spark.createDataFrame([("b", turns)], kind), base, "scenario_name").first()
    assert (got["name"], got["conversation_id"], got["pay"]) == ("b__conversation_00000", "b__conversation_00000", 1)
    with pytest.raises(Exception, match="unknown base"):
        records.scenario_variants(spark.createDataFrame([("z", turns)], kind), base, "scenario_name").collect()


def test_rates_below_the_least_go(spark):
    df = spark.createDataFrame([(0.2,), (float("nan"),), (None,), (0.7,)], "r double")
    assert [r["r"] for r in summaries.rated_rows(df, "r", 0.5).collect()] == [0.7] and summaries.rated_rows(df, "r", 0.0).count() == 4


def test_bootstrap_of_known_units():
    rows = [(10.0, float(i % 5), 10.0, float(i % 5 + 2)) for i in range(40)]
    low, high = summaries.bootstrap_interval(rows, 500, 1)
    assert low <= 0.2 + 1e-9 and high >= 0.2 - 1e-9 and high - low < 1e-6 + 0.2 and summaries.bootstrap_interval(rows[:1]) == (None, None)


def test_quota_takes_known_labels_only(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "i int, label string")
    got = select.quota(df, "label", ["i"], {"a": 2, "b": 3}).collect()
    assert sorted((r["label"], r["i"]) for r in got) == [("a", 0), ("a", 3), ("b", 1), ("b", 4), ("b", 7)]


def test_shared_folder_is_the_sessions(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    path = shared.path(spark, "x")
    assert path.startswith(root)
    spark.range(3).write.parquet(path)
    shared.remove(spark, path)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)


def test_line_numbers_of_files_read_in_splits(spark, tmp_path):
    from cairn.sources import readers

    for name, n in (("a", 300), ("b", 7)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join("" if i % 5 == 4 else f"{name} line {i + 1}" for i in range(n)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = readers.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 240 + 6 and all(r["text"].split()[-1] == str(r["line_num"]) for r in rows)


def test_distances_of_a_long_chain(spark):
    from cairn.streaming import incremental

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["node"]: r["steps"] for r in incremental.distances(edges, 0, 11).collect()} == {i: i for i in range(12)}


def test_commitment_pairs_equal_plain_search(spark):
    import re

    from cairn.operators import pairs

    rnd = random.Random(7)
    say = lambda: " ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "x1"], k=rnd.randint(2, 16))) + rnd.choice([".", "!", ""])
    rows = []
    for k in range(900):
        history = []
        for i in range(rnd.randint(0, 6)):
            gens = [{"gen_text": rnd.choice([say() + " And more.", "", "two words."]), "is_truthful": rnd.choice([True, True, False, None]), "deceptive": None, "parse_error": None} for _ in range(rnd.randint(0, 4))]
            history.append({"sentence_text": say(), "prefix_text": rnd.choice(["", "So far.", "So far. "]), "prompt": None, "deception_rate": rnd.choice([None, float("nan"), 0.0, 0.1, 0.3, 0.6, 0.8, 0.9]), "num_valid": rnd.choice([None, 3, 9, 9, 9]), "num_truthful": 1, "generations": gens})
        rows.append((f"e{k % 2}", f"Run/{k}", f"p{k:03d}", "ask: ", history))
    kind = "env string, example_id string, path string, prompt string, history array<struct<sentence_text:string,prefix_text:string,prompt:string,deception_rate:double,num_valid:int,num_truthful:int,generations:array<struct<gen_text:string,is_truthful:boolean,deceptive:boolean,parse_error:string>>>>"
    got = pairs.commitment_pairs(spark.createDataFrame(rows, kind), most=5, least_valid=5).collect()

    words = lambda t: len(re.findall("[A-Za-z]+", t))
    first = lambda t: (re.match(r"(?s)(.+?[.!?][\"')\]]*)(?:\s+|$)", t.strip()) or [t.strip(), t.strip()])[1]
    plain = lambda t: re.sub(r"^[ .!?\"']+|[ .!?\"']+$", "", re.sub(r"\s+", " ", t.lower()))
    want = {}
    for env, example, path, prompt, history in rows:
        for i in range(1, len(history)):
            a, b = history[i - 1], history[i]
            rates = [a["deception_rate"], b["deception_rate"]]
            if any(r is None or r != r for r in rates) or rates[1] - rates[0] <= 0.2 or rates[1] < 0.5 or min(a["num_valid"] or 0, b["num_valid"] or 0) < 5 or words(b["sentence_text"]) < 4 or not a["prefix_text"]:
                continue
            some = [(abs(words(s) - 12), len(s), j, s) for j, g in enumerate(a["generations"]) if g["is_truthful"] and words(s := first(g["gen_text"])) >= 4 and plain(s) != plain(b["sentence_text"])]
            if some:
                d = min(some)
                want.setdefault(env, []).append((-(rates[1] - rates[0]), -rates[1], -len(some), -words(d[3]), path, i, d[2], d[3], prompt + a["prefix_text"] + ("" if a["prefix_text"].endswith(" ") else " ") + d[3]))
    assert sum(map(len, want.values())) > 10
    for env, found in want.items():
        mine = [r for r in got if r["env"] == env]
        assert sorted((r["path"], r["commitment_pos"], r["truthful_sentence"], r["truthful_text"]) for r in mine) == sorted((p, i, s, t) for *_, p, i, _, s, t in sorted(found)[:5])


def test_generations_as_a_viewer_shows_them(spark):
    from cairn.operators import pairs

    gens = [{"gen_text": "a" * 50, "is_truthful": None, "deceptive": True, "parse_error": None}, {"gen_text": "ok", "is_truthful": True, "deceptive": None, "parse_error": "bad"}, {"gen_text": None, "is_truthful": None, "deceptive": None, "parse_error": None}]
    df = spark.createDataFrame([(gens,)], "g array<struct<gen_text:string,is_truthful:boolean,deceptive:boolean,parse_error:string>>")
    got = df.select(pairs.viewed(F.col("g"), lambda c: c)).first()[0]
    assert [(x["n"], x["label"], x["lossy"], x["error"]) for x in got] == [(1, "deceptive", True, None), (2, "honest", False, "bad"), (3, "ungraded", False, None)]


def test_responses_are_read_once_for_each_row(spark):
    rows = spark.createDataFrame([("so</think>{}", ["{}"])], "text string, objects array<string>")
    none = F.lit(None).cast("string")
    advisor = records.advisor_response(F.col("text"), F.col("objects"), none, F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit(1), F.lit("a")))
    for made in (advisor, records.investor_response(F.col("text"), F.col("objects"), none)):
        plan = rows.select(made.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("</think>") <= 20  # one search for the end of the reasoning for the answer, one for the reasoning
