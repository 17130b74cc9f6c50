"""Null, empty, repeated and clashing rows; laws of sharding and mixing; exact round trips; brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import catalog, chat, langid, mixing, secrets, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Shard int, epochs string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"word{i} " * (i % 7), "en", f"s{i % 3}", 0, 1, "x") for i in range(60)]
    rows += [(None, None, None, None, None, None, None), (None, "", None, "s0", 1, 1, ""), (5, "word5 " * 5, "en", "s2", 0, 1, "x"), (7, "a" * 200_000, "en", "s1", 0, 1, "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_key_law_sizes_and_slots(odd, none):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count() and sharding.shard_documents(none).collect() == []
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id > 7").collect()}
    for r in rows:
        if r["doc_id"] in texts:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


@pytest.mark.parametrize("n", [1, 2, 3, 9, 24, 25, 26, 28, 31, 32, 33])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(sharding.assign_shards(ids, "doc_id", sharding.shard_tree(n), "a"), "doc_id", sharding.shard_tree(n + 1), "b").collect()
    assert all(r["b"] in (r["a"], n) for r in rows) and {r["a"] for r in rows} == set(range(n))
    assert abs(sum(r["b"] == n for r in rows) - 6000 / (n + 1)) < 5 * math.sqrt(6000 / (n + 1))


def test_shards_are_even_and_movement_is_confined(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(sharding.assign_shards(ids, "doc_id", sharding.shard_tree(24), "a"), "doc_id", sharding.shard_tree(25), "b").collect()
    sizes = Counter(r["a"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) < 1.2 * min(sizes.values())
    moved = [r for r in rows if r["a"] != r["b"]]
    assert {r["b"] for r in moved} == {24} and abs(len(moved) / len(rows) - 1 / 25) < 0.01


def test_a_rack_that_gains_weight_takes_from_its_own_siblings_only(spark):
    leaf = lambda i, w=1.0: sharding.Node(f"shard{i}", w, shard=i)
    rack = lambda i, *x: sharding.Node(f"rack{i}", 1.0, x)
    before = sharding.Node("root", 1.0, (rack(0, leaf(0), leaf(1)), rack(1, leaf(2), leaf(3))))
    after = sharding.Node("root", 1.0, (rack(0, leaf(0), leaf(1, 3.0)), rack(1, leaf(2), leaf(3))))
    ids = spark.range(5000).withColumnRenamed("id", "k")
    rows = sharding.assign_shards(sharding.assign_shards(ids, "k", before, "a"), "k", after, "b").collect()
    assert {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]} == {(0, 1)}


def test_mix_comes_near_targets_and_is_stable(odd, none, spark, sf_dir):
    assert mixing.mix_documents(none).collect() == []
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_documents(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix_documents(docs.repartition(5)).collect()))
    most = got.agg(F.max("size")).first()[0]
    by = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("x")).collect()
    assert all(abs(r["t"] - r["x"]) <= most for r in by)
    assert sum(r["t"] for r in by) <= got.agg(F.sum("size")).first()[0]


def test_mixed_rows_are_the_plan_with_all_columns(odd):
    plan, rows = mixing.plan_mix(odd).collect(), mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    want = Counter({(p["doc_id"], p["source"], p["size"]): 0 for p in plan})
    for p in plan:
        want[(p["doc_id"], p["source"], p["size"])] += len(p["epochs"])
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in rows.collect())
    assert got == +want


def test_targets_stop_at_caps(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 0)], "source string, size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert t["b"] == 30 and t["c"] == 300 and t[None] == 0 and abs(t["a"] - 780) < 1e-9


CASES = ["", "plain", "</s>[INST] ok [/INST]", "<|end|><\\|end|>", "<\\\\/s>", "é😀<|turn|>", "\n\n x \n", "<|end", "[", "<", "\\", "<|endoftext|>"]


def test_escape_is_reversible():
    rnd = random.Random(3)
    bits = [*chat.CONTROL, "\\", "<", "[", "x", "|end|>", "é"]
    for t in CASES + ["".join(rnd.choices(bits, k=rnd.randint(0, 8))) for _ in range(3000)]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_chats_read_back(spark):
    rows = [(1, i, ["user", "assistant", None][i % 3], t) for i, t in enumerate(CASES * 3)] + [(2, None, "assistant", None), (None, 0, "assistant", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = catalog.tokenizer_path()
    formatted = chat.format_chats(df.withColumn("TOKEN_IDS", F.lit(1)), path)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, path).collect()}
    turns = [(r[2] or "", r[3]) for r in rows if r[0] == 1]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["n_turns"] == 1 and got[3]["loss_chars"] == 8 and got[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_chats(df.limit(0), path), path).collect() == []
    for r in formatted.collect():
        assert r["formatted"] == chat.load_tokenizer(path).decode(r["token_ids"], skip_special_tokens=False)


def brute(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r'(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_equal_plain_regular_expressions():
    words, runs = secrets.automata()
    rnd = random.Random(1)
    bits = ["password", "token", "AKIA", "api_key", "apikey", "=", ":", " ", '"', "'", "a", "f0", "9", "Z", "é", "😀", "0123456789abcdef0123456789", "ghp_", "SECRET", "tokentoken=", "_", ".", "K", "ſecret"]
    for _ in range(20_000):
        t = "".join(rnd.choices(bits, k=rnd.randint(0, 14)))
        assert brute(t) == [s for s in secrets.find_spans(t, words, runs) if s[0] in secrets.KINDS[:3]]


def test_checksums_decide(spark):
    body = b"abcdefghij" * 3
    good = "ghp_" + (body + secrets.checksum(body)).decode()
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    df = spark.createDataFrame([(1, f"é {good}."), (2, bad), (3, None), (4, ""), (None, "AKIA" + "A1" * 9)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secret_report(df.withColumn("Spans", F.lit(1))).collect()}
    assert got[1]["spans"] == "github:2:42" and got[1]["n_checked"] == 1 and got[2]["spans"] == ""
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() == got[4]["base_sha256"]
    assert got[None]["n_access"] == 1 and secrets.secret_report(df.limit(0)).collect() == []


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "12 !!", "fr"), (None, "der die das", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text", "lang").unionByName(extra)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 4
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.97 * len(held)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (9001, 9002, 9003)) and 0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
    assert langid.identify(extra.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(extra.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_texts_like_no_learned_language_go(spark):
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(90)) for _ in range(40)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 300")
    hidden = docs.withColumn("lang", F.expr("nullif(lang, 'fr')"))  # nothing says what French is like
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(hidden.unionByName(more)).select("doc_id")
    share = {r["lang"]: r["s"] for r in docs.join(kept.withColumn("k", F.lit(1)), "doc_id", "left").groupBy("lang").agg(F.avg(F.coalesce("k", F.lit(0))).alias("s")).collect()}
    assert kept.where("doc_id < 0").count() == 0
    assert share["fr"] < 0.05 and min(share[x] for x in ("de", "en", "es")) > 0.98, share


def test_repeated_rows_have_fates_of_their_own(spark):
    rows = [(None, "one two three " * 5, "en", "s1", k) for k in range(30)] + [(5, "four five " * 8, "en", "s0", k) for k in range(20)] + [(i, "six " * (i % 9), "en", f"s{i % 3}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = lambda rs: Counter((r["doc_id"], r["source"]) for r in rs)
    plan = mixing.plan_mix(docs).collect()
    want = Counter()
    for r in plan:
        want[(r["doc_id"], r["source"])] += len(r["epochs"])
    assert len({tuple(r["epochs"]) for r in plan if r["doc_id"] is None}) > 1 or len({tuple(r["epochs"]) for r in plan if r["doc_id"] == 5}) > 1
    assert words(mixing.mixed_rows(docs).collect()) == +want


def slow_bundle(text):
    """A text's vector by its definition, letter by letter."""
    letter = lambda ch: np.random.default_rng([langid.SEED, ord(ch)]).integers(0, 2, langid.DIM, dtype=np.int8).astype(float) * 2 - 1
    said = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    if not said.strip():
        return None
    known = {c: letter(c) for c in set(said)}
    out = sum(np.roll(known[a], 2) * np.roll(known[b], 1) * known[c] for a, b, c in zip(said, said[1:], said[2:], strict=False))
    return out / np.linalg.norm(out)


def test_languages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    odd = spark.createDataFrame([(9000, None, "en"), (9001, "12 !", "de"), (9002, "Ünïcode straße", None), (None, "the cat", "en")], docs.schema)
    docs = docs.unionByName(odd).withColumn("LANG_pred", F.lit("x")).drop("LANG_pred")
    rows = docs.collect()
    fold = lambda r: zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3
    vectors = [slow_bundle(r["text"] or "") for r in rows]
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if v is not None and r["lang"] is not None and fold(r) != 1:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v
    names = sorted(sums)
    prototypes = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    mean = prototypes.mean(axis=0)
    own = (prototypes - mean) / np.linalg.norm(prototypes - mean, axis=1)[:, None]
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for r, v in zip(rows, vectors, strict=True):
        g = got[r["doc_id"]]
        assert g["held_out"] == (fold(r) == 1)
        if v is None:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        cos = own @ (v - mean) / np.linalg.norm(v - mean)
        best = np.sort(cos)
        assert g["score"] == pytest.approx(max(0.0, best[-1]), abs=1e-4)
        if best[-1] - best[-2] > 1e-4:
            assert g["lang_pred"] == names[int(np.argmax(cos))]


def test_sample_of_labelled_rows_is_bounded_and_stable(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'abc' as text", "'en' as lang")
    some = {r["doc_id"] for r in langid.labelled(docs, 500).collect()}
    assert 400 < len(some) < 600 and some == {r["doc_id"] for r in langid.labelled(docs, 500).collect()}
    assert langid.labelled(docs, 4000).count() == 4000


def test_equal_prototypes_go_to_the_first_language(spark):
    rows = [(i, "same words here", "ab"[i % 2]) for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"a"}


def test_long_conversations_are_cut_from_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "STEP_BYTES", 2000)
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (400 if c == 3 else 3)) for c in range(9) for t in range(6)]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), catalog.tokenizer_path())
    got = {r["conv_id"]: r for r in chat.read_back(formatted, catalog.tokenizer_path()).collect()}
    for c in range(9):
        own = [r for r in rows if r[0] == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in own if r == "assistant").encode()).hexdigest()


def test_rows_without_id_do_not_share_one_cell(spark):
    rows = [(None, "w " * (i % 50 + 1), "en", "s", 1, 1, "") for i in range(500)]
    cells = mixing.queued(spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).select("shuffle").distinct().count()
    assert cells == 50


def test_all_labelled_rows_are_learned_from(spark):
    # halves of equal weight: a sample by hash would hold them unequally
    docs = spark.range(22_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'ab ba' else 'cd dc ee' end as text", "'en' as lang")
    classifier = langid.Classifier(*langid.learn(docs))
    p = langid.Profiler()
    want = p.vector("ab ba").astype(float) + p.vector("cd dc ee")
    assert np.allclose(classifier.prototypes[0], want / np.linalg.norm(want), atol=1e-6)
    floors = langid.learn_floors(docs, classifier)
    sizes = {p.bundle(t)[1]: float(p.vector(t) @ classifier.prototypes[0]) for t in ("ab ba", "cd dc ee")}
    assert floors["en"] == {k: pytest.approx(langid.LIKE_SHARE * c, abs=1e-4) for k, c in sizes.items()}
