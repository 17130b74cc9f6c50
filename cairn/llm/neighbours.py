"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are divided by the largest norm and get one more component that makes them length one; queries are made
length one and get a zero there. The inner product then orders as the distance does. Each of TABLES tables has
FUNCTIONS hash functions floor((a.x + b) / w): a is Gaussian (made orthogonal within a table), b puts a boundary at
the sample's median, and w is so wide that nearly all vectors fall beside it. A neighbour at the expected
similarity projects as a normal variable around the query's own projection; so each bucket has an estimated chance
to hold it, and a query visits the buckets of each table in that order until the chances sum to `success`, the least with
which queries of the sample find their neighbours in it with a recall of RECALL.

Index rows are dealt at random over tasks of a bounded size, and every task gets every query with its buckets, so
no bucket, however common, is one task. There the buckets' rows are multiplied with the queries that visit them;
the candidates of all tables are merged, and the best are scored again, exactly, in double precision.

The boundaries, the expected similarity and the success are fitted on at most 2 * SAMPLE vectors; all vectors are indexed. A vector
that more than k + 1 rows share is indexed under the least k + 1 ids: no query can return others. The non-empty
buckets, at most (2 * REACH) ** FUNCTIONS a table and in practice about 2 ** FUNCTIONS, are known to all.

Nulls: vectors that are null, zero, or hold null, NaN or infinity take no part, nor do those with a null id or a
length other than the most common one (of equally common ones, the longest). Ties go to the smaller id; rows that
repeat id and vector count once. Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written

TABLES, FUNCTIONS, WIDTH, REACH = 4, 10, 8.0, 2
#: Estimated successes in each table that may be asked for, and the recall that the one chosen has on the sample.
SUCCESSES, RECALL = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99), 0.95
SAMPLE, SEED = 4096, 11
#: Index rows for one task, queries multiplied at once.
TASK_ROWS, QUERY_ROWS = 16_384, 128


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, to 2e-7: the order of buckets needs no more."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


class Hasher:
    """The tables' hash functions over vectors of length `dim`."""

    def __init__(self, dim: int, scale: float, seed: int = SEED, tables: int = TABLES, functions: int = FUNCTIONS):
        rng = np.random.default_rng(seed)
        self.scale, self.dim = scale, dim
        functions = min(functions, dim + 1)
        self.a = [np.linalg.qr(rng.normal(size=(dim + 1, functions)))[0] * math.sqrt(dim + 1) for _ in range(tables)]
        self.b = [np.zeros(functions) for _ in range(tables)]
        self.rho = 0.5

    def index_form(self, x: np.ndarray) -> np.ndarray:
        y = x / self.scale
        return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)

    def query_form(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)

    def fit(self, sample: np.ndarray, rows: int, k: int) -> None:
        """Boundaries at medians; the similarity of a query's k-th neighbour among all rows, for nine queries in ten."""
        x = self.index_form(sample)
        self.b = [-np.median(x @ a, axis=0) for a in self.a]
        near = np.sort(self.query_form(sample[:256]) @ x.T, axis=1)[:, ::-1]
        rank = min(near.shape[1] - 1, max(1, round(k * len(sample) / max(rows, 1))))  # place 0 is the vector itself
        self.rho = float(np.clip(np.quantile(near[:, rank], 0.1), 0.05, 0.95))

    def calibrated(self, sample: np.ndarray, rows: int, k: int, recall: float = RECALL) -> float:
        """The least estimated success with which the sample's own queries find their neighbours in it with that recall; 2
        (all buckets) if none does. How the estimates stand to truth depends on the data: clusters are harder than noise."""
        if len(sample) < 3:
            return 2.0
        q, x = self.query_form(sample[:256]), self.index_form(sample)
        score = sample[:256] @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        rank = min(len(sample) - 1, max(1, round(k * len(sample) / max(rows, 1))))
        wanted = score >= np.partition(score, -rank, axis=1)[:, -rank][:, None]
        places = [np.unique(self.buckets(x, t), return_inverse=True) for t in range(len(self.a))]
        for success in SUCCESSES:
            found = np.zeros(score.shape, bool)
            for t, (known, place) in enumerate(places):
                found |= self.visits(q, t, known, success)[:, place]
            if (found & wanted).sum() >= recall * wanted.sum():
                return success
        return 2.0

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        """One number for the hash values of each row in table t."""
        h = np.clip(np.floor((x @ self.a[t] + self.b[t]) / WIDTH), -REACH, REACH - 1).astype(np.int64) + REACH
        return h @ ((2 * REACH) ** np.arange(h.shape[1], dtype=np.int64))

    def chances(self, q: np.ndarray, t: int, buckets: np.ndarray) -> np.ndarray:
        """For queries and buckets of table t: the logarithm of the chance that a neighbour falls there."""
        n = self.a[t].shape[1]
        h = (buckets[:, None] // (2 * REACH) ** np.arange(n, dtype=np.int64)) % (2 * REACH)
        centre, sd = self.rho * (q @ self.a[t]) + self.b[t], math.sqrt(1 - self.rho**2)
        edges = np.array([-np.inf, *[(r - REACH) * WIDTH for r in range(1, 2 * REACH)], np.inf])
        cdf = normal_cdf((edges[None, None, :] - centre[:, :, None]) / sd)
        logs = np.log(np.maximum(np.diff(cdf, axis=2), 1e-12))
        return sum(logs[:, j, :][:, h[:, j]] for j in range(n))

    def visits(self, q: np.ndarray, t: int, buckets: np.ndarray, success: float) -> np.ndarray:
        """Which buckets each query visits: the likeliest, until their chances, of all non-empty ones', reach `success`."""
        chance = np.exp(self.chances(q, t, buckets))
        order = np.argsort(-chance, axis=1, kind="stable")
        sorted_ = np.take_along_axis(chance, order, 1)
        before = np.cumsum(sorted_, axis=1) - sorted_
        out = np.zeros(chance.shape, bool)
        np.put_along_axis(out, order, before < success * chance.sum(axis=1, keepdims=True), 1)
        return out


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def rerank(ids: np.ndarray, x: np.ndarray, places: list[np.ndarray], q_ids: np.ndarray, q: np.ndarray, visits: list[np.ndarray], k: int) -> list[tuple[list[int], list[float]]]:
    """For each query the k best of the rows in the buckets that it visits; places: of each row's bucket, by table."""
    scores = np.full((len(q), len(ids)), -np.inf)
    for place, visit in zip(places, visits, strict=True):
        order = np.argsort(place, kind="stable")
        used, begin = np.unique(place[order], return_index=True)
        for b, rows in zip(used.tolist(), np.split(order, begin[1:]), strict=True):
            who = np.flatnonzero(visit[:, b])
            if len(who):
                scores[np.ix_(who, rows)] = q[who] @ x[rows].T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        s = scores[i]
        floor = np.partition(s, -k)[-k] if len(s) > k else -np.inf
        at = np.flatnonzero((s >= floor - 1e-9 * max(1.0, abs(floor))) & (s > -np.inf)) if np.isfinite(floor) else np.flatnonzero(s > -np.inf)
        sure = exact(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at])
        best = np.lexsort((ids[at], -sure))[:k]
        out.append((ids[at][best].tolist(), sure[best].tolist()))
    return out


def prepared(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())


def search(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", success: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id meets `queries` (of column id) the k nearest found."""
    spark = ready(vectors.sparkSession)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = prepared(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))
    head = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if head is None:
        return none
    dim, n = head["d"], head["n"]
    rows = rows.where(F.size("v") == dim)
    share = min(1.0, SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()
    sample = matrix(drawn.column("v").combine_chunks()) if drawn.num_rows else np.array([rows.first()["v"]])
    hasher = Hasher(dim, head["norm"] * (1 + 1e-12))
    hasher.fit(sample, n, k)
    success = hasher.calibrated(sample, n, k) if success is None else success

    least = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("r", F.dense_rank().over(least)).where(F.col("r") <= k + 1).select("id", "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = hasher.index_form(matrix(batch.column(1)))
            b = np.stack([hasher.buckets(x, t) for t in range(len(hasher.a))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(b), pa.list_(pa.int64()))], names=["id", "v", "b"])

    index = written(index.mapInArrow(place, "id long, v array<double>, b array<long>"), "ann-index")
    found = index.select(F.posexplode("b").alias("t", "b")).distinct().toArrow()
    t_of, b_of = found.column("t").to_numpy(), found.column("b").to_numpy()
    known = [np.sort(b_of[t_of == t]) for t in range(len(hasher.a))]
    groups = max(1, -(-n // TASK_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(lo, QUERY_ROWS)
                q = hasher.query_form(matrix(part.column(1)))
                bits = np.concatenate([np.packbits(hasher.visits(q, t, b, success), axis=1) for t, b in enumerate(known)], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in bits], pa.binary())], names=["id", "v", "visits"])

    asked = rows.where(queries).dropDuplicates(["id", "v"]).mapInArrow(probe, "id long, v array<double>, visits binary")
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = index.withColumn("g", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(groups)).cast("int"))
    widths = [-(-len(b) // 8) for b in known]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "ids", "scores"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, x = left.column("id").to_numpy(), matrix(left.column("v").combine_chunks())
            b = np.array(left.column("b").to_pylist(), dtype=np.int64)
            if len(np.unique(ids)) < len(ids):  # rows that repeat id and vector count once
                alone = list({(int(i), v.tobytes()): k for k, (i, v) in enumerate(zip(ids, x, strict=True))}.values())
                ids, x, b = ids[alone], x[alone], b[alone]
            places = [np.searchsorted(known[t], b[:, t]) for t in range(len(known))]
            q_ids, q = right.column("id").to_numpy(), matrix(right.column("v").combine_chunks())
            raw = np.frombuffer(b"".join(right.column("visits").to_pylist()), np.uint8).reshape(len(q), -1)
            cuts = np.cumsum([0, *widths])
            for lo in range(0, len(q), QUERY_ROWS):
                some = slice(lo, lo + QUERY_ROWS)
                visits = [np.unpackbits(raw[some, cuts[t] : cuts[t + 1]], axis=1, count=len(known[t])).astype(bool) for t in range(len(known))]
                got = rerank(ids, x, places, q_ids[some], q[some], visits, k)
                out[0] += q_ids[some].tolist()
                out[1] += [g[0] for g in got]
                out[2] += [g[1] for g in got]
        return pa.table([pa.array(o, kind) for o, kind in zip(out, kinds, strict=True)], names=names)

    parts = dealt.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(join, "query_id long, ids array<long>, scores array<double>")
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("cost"), i.alias("vec_id")))
    merged = parts.groupBy("query_id").agg(F.flatten(F.collect_list(pairs)).alias("all")).select("query_id", F.slice(F.array_sort(F.array_distinct("all")), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.cost")).alias("score"))
