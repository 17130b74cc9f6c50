"""The pipeline against brute force over a small table, stage by stage, and on rows with nulls."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import catalog, decontam, mixing, simhash, tokens


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "12 !! 34", "en", "src0", 8)], docs.schema)
    docs = docs.unionByName(odd)
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name != "token_output":
            assert got.columns == docs.columns
        out.append(got.collect())
        docs = spark.createDataFrame(out[-1], docs.schema) if name != "token_output" else None
    return out


def test_language_stage_keeps_text_with_letters(stages):
    assert {r["doc_id"] for r in stages[0]} - {r["doc_id"] for r in stages[1]} == {None, 9001, 9002}


def shingles(text):
    w = simhash.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_stays(stages):
    before, kept = {r["doc_id"]: shingles(r["text"]) for r in stages[1]}, {r["doc_id"] for r in stages[2]}
    texts = {r["doc_id"]: r["text"] for r in stages[1]}
    similar = lambda a, b: len(before[a] & before[b]) / max(1, len(before[a] | before[b]))
    for d in set(before) - kept:
        assert max(similar(d, o) for o in before if o < d) > 0.7  # what goes has a likeness of a lesser id
    assert len({texts[d] for d in kept}) == len(kept)
    clear = [(a, b) for a in kept for b in kept if a < b and similar(a, b) > 0.9]
    assert not clear


def test_no_benchmark_passage_is_left(stages, spark, sf_dir):
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def holds(text):
        w = decontam.words_of(text)
        return any(w[j : j + len(q)] == q for q in items for j in range(len(w) - len(q) + 1))

    assert [r["doc_id"] for r in stages[3]] == [r["doc_id"] for r in stages[2] if not holds(r["text"])]


def test_mix_and_tokens(stages, spark):
    plan = mixing.mix_documents(spark.createDataFrame(stages[3], spark.createDataFrame(stages[3]).schema)).collect()
    assert Counter(r["doc_id"] for r in stages[4]) == Counter({p["doc_id"]: p["taken"] // p["size"] for p in plan if p["taken"]})
    coder = tokens.Encoder(catalog.tokenizer_path())
    want = Counter()
    for r in stages[4]:
        ids = np.append(coder.tokenizer.encode(r["text"], add_special_tokens=False).ids, 2).astype("<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages[5]) == want


def test_run_joins_the_stages(stages, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
