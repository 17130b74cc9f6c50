"""License notices, contaminated passages and nearest neighbours against brute force, and odd rows."""

import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontam, licenses, neighbours


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def test_every_notice_is_found_alone_and_in_text(scanner):
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for around in ("", "Some é words before.\n"):
                got = scanner.scan(f"{around}{t}\nAnd others behind it, of no such kind.")
                assert any(g[0] == name and g[1] == len(around) and g[4] == g[5] == 0 for g in got), (name, t, got)


def test_changed_wording_is_measured(scanner):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    near = scanner.scan(apache.replace("WITHOUT WARRANTIES", "WITHOUT ANY WARRANTIES").replace("limitations", "limits"))
    assert [(g[0], g[4], g[5]) for g in near] == [("Apache-2.0", 1, 2)]
    assert scanner.scan("A license to talk of permission and copyright in general.") == []
    assert {g[0] for g in scanner.scan("All rights reserved.\nReleased under the MIT License.\nx")} == {"proprietary", "MIT"}


def test_license_rows(spark):
    rows = [(1, "All rights reserved."), (1, "All rights reserved."), (2, None), (3, ""), (None, "x " * 30_000 + "Released under the MIT License. " + "y " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as License")
    got = [(r["doc_id"], r["license"], r["exact"]) for r in licenses.scan_licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "proprietary", True)] * 2 + [(None, "MIT", True)], key=str)
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_licenses_equal_plain_search(spark, scanner):
    notices = {t: n for n, ts in licenses.TEMPLATES.items() for t in ts}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        want = {(notices[t], r["text"].lower().index(t.lower())) for t in notices if t.lower() in r["text"].lower()}
        got = {(g[0], g[1]) for g in scanner.scan(r["text"])}
        assert want <= got and len(got) == len(want), (r["doc_id"], want, got)


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = decontam.words_of(t)
        for i, x in items:
            q = decontam.words_of(x)
            if q and any(w[j : j + len(q)] == q for j in range(len(w) - len(q) + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    planted = [(9000 + r["item_id"], "lead " * 70 + r["text"].replace(" ", " \t") + " tail" * 40) for r in bench.collect()]
    odd = [(1, None), (2, ""), (None, "plain"), (3, "word " * 50_000)]
    df = docs.unionByName(spark.createDataFrame(planted + odd, "doc_id long, text string")).selectExpr("*", "1 as Leak_Id", "2 as score")
    items = bench.select("item_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "!!")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, items).collect()}
    assert got == brute_leaks([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    kept = decontam.drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - len({d for d, _ in got})
    assert decontam.contaminated(df.limit(0), items).collect() == [] and decontam.contaminated(df, items.limit(0)).collect() == []


def test_wand_equals_exhaustive_scores():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(k, rnd.choices(words, k=rnd.randint(5, 16))) for k in range(80)]
    frequency = Counter(w for _, ws in items for w in set(ws))
    for need in (0.3, 0.5, 0.7):
        ix = decontam.Index(items, 16, len(items), 10.0, frequency, need)
        for _ in range(40):
            text = rnd.choices(words + ["none"], k=24)
            terms = np.array([ix.vocabulary.get(w, len(ix.vocabulary)) for w in text])
            got = {(i, round(s, 9)) for start, block in ix.passages(terms) if start == 0 for i, s in ix.search(set(terms.tolist()) - {len(ix.vocabulary)}, block)}
            gains = {}
            for t in set(terms.tolist()) - {len(ix.vocabulary)}:
                for i, g in zip(ix.items[t], ix.gains[t], strict=True):
                    gains[i] = gains.get(i, 0) + g
            assert {i for i, _ in got} == {i for i, s in gains.items() if s >= need - 1e-9}


def test_neighbours_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    at = {int(v): i for i, v in enumerate(ids)}
    got = {}
    for r in neighbours.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in [m[1] for m in mine]
        assert all(abs(m[2] - float(x[at[q]] @ x[at[m[1]]])) < 1e-12 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        s = x @ x[at[q]]
        s[at[q]] = -math.inf
        hits += sum(m[2] >= np.sort(s)[-20] - 1e-9 for m in mine)
    assert hits / (20 * len(got)) >= 0.92


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (1, [2.0, 0.1])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as Id", "2 as v")
    got = neighbours.search(df.select("vec_id", "embedding", F.col("Id").alias("b")), F.col("id").isin(0, 20), success=1.0).collect()
    for q in (0, 20):
        mine = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        others = [20 - q, *range(1000, 1060)]
        assert mine == [(1, 1, 2.0)] + [(i + 2, v, 1.0) for i, v in enumerate(sorted(others)[:19])]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).collect() == []
    few = neighbours.search(df.where("vec_id in (0, 1)"), F.col("id") % 20 == 0, success=1.0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]


def test_items_with_changed_words_are_found():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in rows if decontam.words_of(r["text"])]
    words = [decontam.words_of(t) for _, t in items]
    frequency = Counter(w for ws in words for w in set(ws))
    finder = decontam.Finder(items, len(items), sum(map(len, words)) / len(words), frequency, decontam.SCORE, decontam.OVERLAP)
    rnd, tried, found = random.Random(5), Counter(), Counter()
    for n in (1, 2):
        for i, text in items * 3:
            for m in sorted(rnd.sample(list(decontam.WORD.finditer(text)), n), key=lambda m: -m.start()):
                text = f"{text[: m.start()]}zzqx{text[m.end() :]}"
            tried[n] += 1
            found[n] += i in {g[0] for g in finder.find("lead " * 30 + text + " tail" * 30)}
    assert found[1] >= 0.98 * tried[1] and found[2] >= 0.93 * tried[2], (found, tried)


def test_edits_equal_plain_dynamic_programming():
    rnd = random.Random(6)
    for _ in range(200):
        part, text = rnd.choices("abcd", k=rnd.randint(1, 7)), rnd.choices("abcde", k=rnd.randint(0, 12))
        row = [0] * (len(text) + 1)
        for w in part:
            new = [row[0] + 1]
            for j, x in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row = new
        assert decontam.edits(part, text) == min(row)


@pytest.mark.parametrize("width", [20, 30, 40, 60, 120])
@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_notices_of_any_width_are_found(scanner, prefix, width):
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            lines = textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False)
            assert name in [g[0] for g in scanner.scan("Before.\n" + "\n".join(prefix + x for x in lines) + "\nAnd others behind it.")], (name, t)


@pytest.mark.parametrize("before", [50, 53, 55, 58, 60, 63])
def test_notices_behind_many_key_lines_are_whole(scanner, before):
    for name in ("MIT", "BSD-3-Clause", "Apache-2.0"):
        notice = max(licenses.TEMPLATES[name], key=len)
        text = "\n".join(f"permission number {k}" for k in range(before)) + "\n" + "\n".join(textwrap.wrap(notice, 72, break_on_hyphens=False))
        assert [(g[0], g[4], g[5]) for g in scanner.scan(text)] == [(name, 0, 0)]


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_notices_are_found(scanner, prefix, gap):
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            lines = textwrap.wrap(t, 80 - len(prefix), break_on_hyphens=False, break_long_words=False)
            text = "Some text before.\n" + gap.join(prefix + x for x in lines) + "\nAnd others behind it, of no such kind."
            assert [(g[0], g[4], g[5]) for g in scanner.scan(text)] == [(name, 0, 0)], (name, t)


def test_adjoining_notices_are_whole_across_cuts(scanner):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    for width in (60, 80):
        notice = "\n".join(textwrap.wrap(apache, width, break_on_hyphens=False))
        text = "\n\n".join(f"component {k}\n{notice}" for k in range(60))
        got = scanner.scan(text)
        assert [(g[0], g[4], g[5]) for g in got] == [("Apache-2.0", 0, 0)] * 60
        assert all(text[g[1] : g[2]].split() == notice.rstrip(".").split() for g in got)


def test_many_chunks_and_equal_items(spark, monkeypatch):
    """An index of several chunks finds what one finds, equal items under each of their ids."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(12, 40))) + ". " + " ".join(rnd.choices(words, k=6))) for i in range(40)]
    items += [(100 + i, items[0][1]) for i in range(5)] + [(200, None), (201, "")]
    docs = [(i, " ".join(rnd.choices(words, k=60)) + " " + items[i % 40][1] + " " + " ".join(rnd.choices(words, k=30))) for i in range(60)] + [(900, " ".join(rnd.choices(words, k=200)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontam.contaminated(d, b).collect())
    one = rows()
    assert {(x, y) for x, y, _ in one} >= {(i, i % 40) for i in range(60)} | {(0, 100 + k) for k in range(5)}
    kept = sorted(r["doc_id"] for r in decontam.drop_contaminated(d, b).collect())
    monkeypatch.setattr(decontam, "INDEX_WORDS", 150)
    assert rows() == one and sorted(r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()) == kept == [900]


def test_neighbours_merge_over_tasks(spark, monkeypatch):
    """With all buckets visited and many small tasks the result is the exact one."""
    monkeypatch.setattr(neighbours, "TASK_ROWS", 37)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12))
    x[50:90] = x[10]  # very common rows
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("id") % 20 == 0, k=7, success=1.1).collect()
    for q in range(0, 400, 20):
        scores = [(-neighbours.exact(x[q : q + 1], x[i : i + 1])[0], i) for i in range(400) if i != q]
        want = [i for _, i in sorted(scores)[:7]]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("spread", [0.05, 0.1])
def test_recall_holds_on_clusters_too(spark, spread):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 2400)] / np.linalg.norm(centres, axis=1).mean() + rng.normal(size=(2400, 32)) * spread
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 2400, 20):
        s = x @ x[q]
        s[q] = -math.inf
        hits += len(got[q] & set(np.argsort(-s)[:10].tolist()))
    assert hits / (10 * 120) >= 0.9
