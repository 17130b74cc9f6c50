"""Files of directly addressable codes: exact round trips, random access, equality with the tokenizer."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import catalog, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_any_ids_round_trip_and_are_addressable(ids):
    packed = tokens.Packed(tokens.pack(np.array(ids, dtype=np.uint64)))
    assert packed.ids().tolist() == ids and len(packed) == len(ids)
    assert [packed[i] for i in range(0, len(ids), 7)] == ids[::7]


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder(catalog.tokenizer_path())


def plain(coder, texts):
    return [np.array(e.ids, dtype=coder.kind).tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def cut(ids, sizes):
    ends = np.cumsum(sizes)
    return [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]


def test_encoding_by_runs_equals_the_tokenizer(coder, monkeypatch):
    r = random.Random(2)
    bits = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "²", "_", "-", "!", "'s", "'", "\xa0", "　", "中", "😀", "\x1c", "\x0b", "\x85", "ä", "٣", "Ⅷ", "<|endoftext|>", "​", "‍", "word", "\x00", "﻿", " ", "'ll"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(20_000)]
    want = plain(coder, texts)
    for known in (tokens.KNOWN_RUNS, 50):  # with much kept, and with nearly all forgotten at each step
        monkeypatch.setattr(tokens, "KNOWN_RUNS", known)
        got = []
        for lo in range(0, len(texts), 1000):
            got += cut(*coder.encode(pa.array(texts[lo : lo + 1000])))
        assert got == want


def test_long_texts_are_encoded_in_pieces(coder, monkeypatch):
    monkeypatch.setattr(tokens, "STEP_BYTES", 300)
    r = random.Random(4)
    texts = [" ".join(r.choices(["alpha", "beta,", "\n", "", "  ", "x\ny", "Ünï", "(gamma)", "42", "it's"], k=r.randint(0, 400))) for _ in range(60)]
    assert cut(*coder.encode(pa.array(texts, pa.string()))) == plain(coder, texts)
    ids, sizes = coder.encode(pa.array([], pa.string()))
    assert len(ids) == len(sizes) == 0


def test_files_give_every_document_back(spark, coder, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 500)
    rows = [(i * 3 % 101, f"text {i} " * (i % 40)) for i in range(101)] + [(5, "again"), (5, "again"), (None, None), (None, "x"), (102, ""), (103, "long " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as N_Tokens", "2 as block")
    got = tokens.encode_documents(df, catalog.tokenizer_path()).collect()
    want = {}
    for (i, _), raw in zip(rows, plain(coder, [t or "" for _, t in rows]), strict=True):
        ids = np.append(np.frombuffer(raw, coder.kind), 2).astype("<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["doc_id"] if r["doc_id"] is not None else -1) >= last
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else -1
    assert tokens.encode_documents(df.limit(0), catalog.tokenizer_path()).collect() == []


def test_single_tokens_by_place_and_by_document(spark, coder, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 64)
    rows = [(i, f"some words of {i} " * (i % 17)) for i in range(60)] + [(7, "again and again")]
    path = f"{tokens.shared_dir(spark)}/tokens-by-place"
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, catalog.tokenizer_path())
    every = []
    for d, t in sorted(rows, key=lambda r: (r[0], zlib.crc32(r[1].encode()))):
        every += [(d, i, x) for i, x in enumerate([*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2])]
    asked = [*range(0, len(every), 11), len(every) - 1]
    got = tokens.tokens_at(spark, path, spark.createDataFrame([(p,) for p in [*asked, -1, len(every), 10**9]], "position long")).collect()
    assert {r["position"]: r["id"] for r in got} == {p: every[p][2] for p in asked}
    pairs = [(7, 0), (7, 3), (16, 40), (16, 10**6), (17, 0), (99, 0), (3, -1)]
    got = tokens.tokens_of(spark, path, spark.createDataFrame(pairs, "doc_id long, i long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, i, x) for d, i, x in every if (d, i) in pairs)
