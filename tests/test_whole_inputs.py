"""Queries over whole inputs, against plain Python."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from cairn.functions.text import sentence_spans
from cairn.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_runs_and_spans_of_every_text(spark):
    texts = {r["doc_id"]: r["text"] for r in rows("documents") if r["text"] is not None}
    got = {r["doc_id"]: r["longest"] for r in run(spark, "lossy_runs")}
    assert got == {k: max(map(len, t.split()), default=0) for k, t in texts.items()}
    spans = defaultdict(list)
    for r in run(spark, "sentence_unnest"):
        assert r["sentence_id"] == f"{r['doc_id']}/sent_{len(spans[r['doc_id']]):04d}"
        spans[r["doc_id"]].append((r["start"], r["end"]))
    assert spans == {k: got for k, t in texts.items() if (got := sentence_spans(t))}


def test_all_places_of_embeddings(spark):
    e = sorted((r for r in rows("embeddings") if r["embedding"] is not None), key=lambda r: r["vec_id"])
    before, want = defaultdict(list), {}
    for r in e:
        own, old = sum(map(float, r["embedding"])), before[r["label"]][-2:]
        want[r["vec_id"]] = (own, own - old[-1] if old else 0.0, own - sum(old) / len(old) if old else 0.0)
        before[r["label"]].append(own)
    got = {r["vec_id"]: (r["final"], r["delta_last"], r["delta_mean"]) for r in run(spark, "activation_variants")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)

    x, even = np.array([r["embedding"] for r in e], float), np.array([r["vec_id"] % 2 == 0 for r in e])
    z = (x - x[even].mean(axis=0)) / x[even].std(axis=0, ddof=1)
    _, axes = np.linalg.eigh(np.cov(z[even].T))
    parts = {r["vec_id"]: r["features"] for r in run(spark, "principal_components")}
    made = np.abs(np.array([parts[r["vec_id"]] for r in e]))
    assert np.allclose(made, np.abs(z @ axes[:, ::-1][:, :4]), atol=1e-4)
