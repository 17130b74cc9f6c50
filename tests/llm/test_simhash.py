"""Fingerprints, pigeonhole linking and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash


def brute_fp(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


TEXTS = ["", " \n", "one", "Two Words", "a b c", "A  b\tc", "d e f g h i", "é É x\x85y z w", "x " * 5000]


def test_fingerprints_and_components(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=120)) for _ in range(6)]
    texts = TEXTS + base + [b.replace("alpha", "ALPHA") for b in base] + [b + " tail" for b in base] + [b.rsplit(" ", 1)[0] for b in base]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, None), (None, base[0]), (None, "only null ids")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as Component_Id", "'x' as fp")
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows)
    fps = [(i, brute_fp(t or "", 3)) for i, t in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((i is None, i or 0, f"{f:016x}") for i, f in fps)
    distinct = sorted({f for _, f in fps})
    group = brute_components(distinct, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    for r in got:
        assert r["component_id"] == least.get(group[int(r["fingerprint"], 16)])
    assert simhash.simhash_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_links_equal_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "SALT_ROWS", 20)
    rnd = np.random.default_rng(bits)
    common = int(rnd.integers(0, 1 << 62))
    fps = {int(x) for x in rnd.integers(0, 1 << 63, 150)}
    fps |= {common ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(1, 14), replace=False)) for _ in range(350)}  # a hot group
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    edges = simhash.link_trees(df, bits)
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    want = brute_components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= bits)
    assert {i: found.get(i, i) for i in range(len(fps))} == want


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (10**5, 3), (10**8, 3), (10**10, 3), (10**6, 8)])
def test_thresholds_cover_every_pair(n, bits):
    m = simhash.choose_parts(n, bits)
    assert sum(len(p) for p in simhash.group_bits(np.eye(64), m)) == 64
    rnd = np.random.default_rng(1)
    parts = simhash.group_bits(np.eye(64), m)
    chunks = [[p[i : i + 16] for i in range(0, len(p), 16)] for p in parts]
    shells = [[[rnd.random(1 << len(c)).astype(np.float32) for _ in range(min(3, bits) + 1)] for c in p] for p in chunks]
    layout = simhash.Layout(n, bits, parts, chunks, shells)
    fp = rnd.integers(0, 1 << 63, 200).astype(np.uint64)
    t = simhash.allocate(layout, [simhash.part_values(fp, p) for p in parts]).astype(int)
    assert ((t + 1).sum(axis=1) == bits + 1).all() and t.min() >= -1 and t.max() <= simhash.RADIUS


def test_near_duplicates_go_and_others_stay(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rnd.choices(vocabulary, k=300) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        x = list(w)
        x[50] = "changed"
        x[200] = "also"
        rows.append((200 + i, " ".join(x)))
    rows += [(300 + i, " ".join(rnd.sample(w, len(w)))) for i, w in enumerate(base)]  # same words, other order
    rows += [(None, rows[0][1]), (None, None), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `group`", "2 as _Copy_")
    kept = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert sorted(k for k in kept if k is not None) == [*range(30), *range(300, 330), 900] and kept.count(None) == 2
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).collect() == []


def test_near_duplicates_with_text_put_in_go(spark):
    """Pairs of likeness 0.86 to 0.95, of which the words' SimHash alone loses about a third to a half."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        own, other = ([f"w{rng.randrange(4000)}" for _ in range(n)] for n in (200, 30))
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own + other[: 12 + k % 18]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == list(range(0, 120, 2))


def brute_trees(keys, kinds, nodes, near):
    """Components over pairs of one key, probe and index, that are near."""
    rows = list(zip(keys, kinds, nodes, range(len(keys)), strict=True))
    pairs = {(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] >= 1 and b[1] < 2 and a[2] != b[2] and near(a[3], b[3])}
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        x, y = sorted((root(nodes[i]), root(nodes[j])))
        parent[y] = x
    return {n: root(n) for n in nodes}


def grown(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(int(a)), root(int(b))))
        parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_proofs_equal_brute_force(seed, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 40)
    monkeypatch.setattr(simhash, "PROOFS", 30)
    rng = np.random.default_rng(seed)
    kinds = [1] if seed % 2 else [0, 1, 2]
    n = 240
    of_node = np.concatenate([np.repeat(rng.integers(0, 256, (6, simhash.BINS), dtype=np.uint8), 10, axis=0)])
    for k in range(60):  # groups of sketches that differ more and more from their first
        of_node[k, : (k % 10) * 4] = rng.integers(0, 256, (k % 10) * 4)
    node = rng.integers(0, 60, n)
    key, kind = rng.integers(0, 9, n), rng.choice(kinds, n).astype(np.int8)
    order = np.lexsort((kind, key))
    key, kind, node = key[order], kind[order], node[order]
    sketches = of_node[node]
    near = lambda i, j: simhash.similarity(sketches[i : i + 1], sketches[j : j + 1])[0] >= 0.8
    a, b = simhash.proved(key, node, kind, sketches, 0.8)
    nodes = [int(x) for x in node]
    assert grown(zip(a, b, strict=True), set(nodes)) == brute_trees(key, kind, nodes, near)


@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
def test_pieces_hold_whole_runs(most):
    import pyarrow as pa

    rng = np.random.default_rng(most)
    key = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(400, 17)]))
    kind = rng.choice([0, 1, 2], len(key)).astype(np.int8)
    order = np.lexsort((kind, key))
    t = pa.table({"key": pa.array(key[order]), "kind": pa.array(kind[order]), "row": pa.array(np.arange(len(key)))})
    met = lambda k, kd, r: {(int(r[a]), int(r[b])) for a in range(len(k)) for b in range(len(k)) if k[a] == k[b] and kd[a] >= 1 and kd[b] < 2}
    cols = lambda x: tuple(x.column(c).to_numpy() for c in ("key", "kind", "row"))
    got = set()
    for piece in simhash.whole_runs(iter(t.to_batches(max_chunksize=23)), most):
        got |= met(*cols(piece))
    assert got == met(*cols(t))


def test_near_duplicates_of_hot_keys(spark, monkeypatch):
    """Salted bands and parts, pieces of few rows: one of each group stays."""
    for name, value in (("SALT_ROWS", 15), ("RUN_ROWS", 60), ("PROVED_ROWS", 40)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(120):  # one large group of near copies, all of them different
        x = list(base)
        x[i] = f"own{i}"
        rows.append((i, " ".join(x)))
    rows += [(200 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(120))) for i in range(30)]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [0, *range(200, 230)]


def test_bands_meet_as_often_as_likeness_says():
    rng = np.random.default_rng(1)
    met = []
    for _ in range(400):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (240, 30, 30))
        x, y = (np.frombuffer(simhash.bands(np.concatenate([both, own])), "<u8") for own in (a, b))
        met.append((x == y).mean())
    assert abs(np.mean(met) - 0.8**simhash.BAND_HASHES) < 0.02 and np.mean(np.array(met) == 0) < 0.01
    assert len(simhash.bands(np.zeros(0, np.uint64))) == 8 * simhash.BANDS
