"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into parts. If two differ in at most t bits, and each part i has a threshold t_i
with sum(t_i + 1) = t + 1, then in some part they differ in at most t_i bits. Bits that go together are put into
one part, so that what is common there is common once. Every fingerprint has thresholds of its own, allocated by
dynamic programming over the parts on estimated counts of candidates, -1 (no probe) to RADIUS. It is indexed by
its value in each part, and probes the values within t_i bits of its own; candidates are verified on all bits.

Equal fingerprints are one before anything is probed. Each task links what it verified into trees and hands on
only their edges, fewer than its fingerprints, so a group of copies never becomes all its pairs. Values that many
fingerprints share are dealt over several tasks by salt: the fingerprints once, the probes to each salt. Components
are found by alternating large-star and small-star steps, each written to the shared folder.

Nulls: a null text is empty; an empty text has fingerprint zero and is linked like any other. A null doc_id is
never a component's id unless all of the component are null. Rows that repeat a doc_id are rows of the result.
Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, partitions, ready, tidy, written

BITS, SEED = 64, 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The largest threshold of one part; the bits of one histogram; fingerprints of one value in one task.
RADIUS, CHUNK_BITS, SALT_ROWS = 3, 16, 50_000
#: Microseconds that a probe (made, moved, sorted) and a candidate (verified) cost.
PROBE_COST, CANDIDATE_COST = 1.0, 0.005
#: Candidates looked at at once, pairs of sketches compared at once, bytes of rows for one task.
STEP, PROOFS, TASK_BYTES = 250_000, 20_000, 64 << 20
#: Rows that a task holds at once, without and with sketches, if the index rows of no key are more.
RUN_ROWS, PROVED_ROWS = 250_000, 50_000
#: Near-dedup: words as features, bits within which candidates are probed, words of a shingle, the similarity.
NEAR_BITS, NEAR_SHINGLE, NEAR_SIMILARITY = 8, 5, 0.8
BINS = 256
#: Bands of least hashes, and hashes of a band: a pair of similarity s shares none with (1 - s**4)**16, 0.0002 at 0.8.
BANDS, BAND_HASHES = 16, 4
POSTINGS, MET, EDGES = "key long, kind byte, fp long, node long", "key long, kind byte, node long", "a long, b long"


# fingerprints


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every run of k words, space-joined; of the whole sequence if there are fewer; none if there are none."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number of which a bit is 1 if set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray, bins: int = BINS) -> bytes:
    """One byte for each bin of hashes: of its least hash, 1 to 255; 0 where the bin is empty."""
    out = np.zeros(bins, np.uint8)
    if len(hashes):
        h = np.sort(hashes)
        shift = np.uint64(64 - int(math.log2(bins)))
        first, at = np.unique(h >> shift, return_index=True)
        out[first.astype(np.int64)] = (h[at] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * BAND_HASHES), dtype=np.uint64)
TURN, FACTOR, FOLD = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1), _DRAWN[2] * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> bytes:
    """A key for each band: of the least hashes under its own orders of all hashes. Equal sets have equal keys."""
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        mixed = (hashes[lo : lo + 4096, None] ^ TURN) * FACTOR
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(29))) * FOLD).reshape(BANDS, BAND_HASHES).sum(axis=1, dtype=np.uint64).astype("<u8").tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of rows of sketches; 1 where both are empty."""
    same, both = ((a == b) & (a > 0)).sum(axis=1), ((a | b) > 0).sum(axis=1)
    return np.where(both > 0, same / np.maximum(both, 1), 1.0)


def _fingerprints(docs: DataFrame, one: Callable[[str], tuple], schema: str, kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]], names=["doc_id", *names])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash of the text's shingles, repeats included, as a signed long."""
    one = lambda t: (_signed(majority(shingle_hashes(words_of(t), shingle))),)
    return _fingerprints(docs, one, "doc_id long, fp long", [pa.int64()], ["fp"])


def near_fingerprints(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, fp (the SimHash of the distinct words), the sketch and the bands of the text's distinct shingles."""

    def one(text: str) -> tuple[int, bytes, bytes]:
        words = words_of(text)
        hashes = shingle_hashes(words, shingle)
        return _signed(majority(shingle_hashes(sorted(set(words)), 1))), sketch(hashes), bands(hashes)

    return _fingerprints(docs, one, "doc_id long, fp long, sketch binary, bands binary", [pa.int64(), pa.binary(), pa.binary()], ["fp", "sketch", "bands"])


# parts and thresholds


def choose_parts(n: int, bits: int) -> int:
    """The number of parts for n fingerprints, by the cost of probes and candidates if all values were as common.

    n counts as the next power of 64: within such a range the probes of a fingerprint don't change, so rows grow with n.
    """
    n = 64 ** math.ceil(math.log(max(n, 2), 64) - 1e-9)

    def cost(m: int) -> float:
        spare, w = bits - m + 1, BITS / m
        radii = [spare // m + (i < spare % m) for i in range(m)] if spare >= 0 else [0] * (bits + 1)
        balls = sum(sum(math.comb(int(w), j) for j in range(r + 1)) for r in radii)
        return PROBE_COST * (m + balls) + CANDIDATE_COST * n * balls / 2**w

    return min((m for m in range(2, max(2, min(16, bits + 1)) + 1) if max((bits - m + 1) / m, 0) <= RADIUS), key=cost)


def group_bits(together: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m parts of about one size; the bits of a part are as correlated as greedy choice gets them."""
    left, parts = set(range(BITS)), []
    strength = np.abs(together)
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        rows = sorted(left)
        first = max(rows, key=lambda b: (max((strength[b, x] for x in rows if x != b), default=0), -b))
        part = [first]
        left.discard(first)
        while len(part) < size:
            part.append(max(sorted(left), key=lambda b: strength[b, part].sum()))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


@dataclass
class Layout:
    """Parts, and for each chunk of a part how many fingerprints have each value, exactly r bits from it, over all."""

    n: int
    bits: int
    parts: list[list[int]]
    chunks: list[list[list[int]]]
    shells: list[list[np.ndarray]]

    def radius(self, i: int) -> int:
        return min(RADIUS, len(self.parts[i]), self.bits)


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def co_occurrence(distinct: DataFrame) -> np.ndarray:
    """The correlations of the bits over all distinct fingerprints: 64 * 64 sums, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = _unsigned(batch.column(0))
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], names=["at", "n"])

    sums = distinct.select("fp").mapInArrow(tidy(run), "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(BITS * BITS)
    both[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return both.reshape(BITS, BITS)


def correlations(both: np.ndarray, n: int) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)


def make_layout(distinct: DataFrame, n: int, bits: int) -> Layout:
    """Parts by correlation, and histograms: at most 2**16 values for each chunk reach the driver."""
    m = choose_parts(n, bits)
    parts = group_bits(correlations(co_occurrence(distinct), n), m)
    chunks = [[p[i : i + -(-len(p) // -(-len(p) // CHUNK_BITS))] for i in range(0, len(p), -(-len(p) // -(-len(p) // CHUNK_BITS)))] for p in parts]
    flat = [c for p in chunks for c in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(c), np.int64) for c in flat]
        for batch in batches:
            fp = _unsigned(batch.column(0))
            for c, into in zip(flat, counts, strict=True):
                into += np.bincount(part_values(fp, c).astype(np.int64), minlength=len(into))
        for k, into in enumerate(counts):
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(into[at])], names=["chunk", "value", "n"])

    got = distinct.select("fp").mapInArrow(tidy(run), "chunk int, value int, n long").groupBy("chunk", "value").agg(F.sum("n").alias("n")).toArrow()
    chunk, value, count = (got.column(c).to_numpy() for c in ("chunk", "value", "n"))
    shells, k = [], 0
    for p in chunks:
        for c in p:
            own = np.zeros(1 << len(c), np.float32)
            own[value[chunk == k]] = count[chunk == k]
            shells.append([own] + [_shell(own, len(c), r) for r in range(1, min(RADIUS, bits) + 1)])
            k += 1
    by_part, k = [], 0
    for p in chunks:
        by_part.append(shells[k : k + len(p)])
        k += len(p)
    return Layout(n, bits, parts, chunks, by_part)


def _shell(own: np.ndarray, width: int, r: int) -> np.ndarray:
    """For each value, how many fingerprints have a value exactly r bits away."""
    at, out = np.arange(len(own)), np.zeros_like(own)
    for flips in combinations(range(width), r):
        out += own[at ^ sum(1 << f for f in flips)]
    return out


def estimates(layout: Layout, i: int, values: np.ndarray) -> np.ndarray:
    """For values of part i, the fingerprints expected within 0, 1, ... bits; chunks of a part count as independent."""
    top = layout.radius(i)
    exact = np.zeros((len(values), top + 1))
    exact[:, 0] = layout.n
    shift = 0
    for chunk, shells in zip(layout.chunks[i], layout.shells[i], strict=True):
        at = ((values >> np.uint64(shift)) & np.uint64((1 << len(chunk)) - 1)).astype(np.int64)
        share = np.stack([shells[r][at] / max(layout.n, 1) if r < len(shells) else np.zeros(len(values)) for r in range(top + 1)], axis=1)
        exact = np.stack([sum(exact[:, a] * share[:, r - a] for a in range(r + 1)) for r in range(top + 1)], axis=1)
        shift += len(chunk)
    return np.cumsum(exact, axis=1)


def allocate(layout: Layout, values: list[np.ndarray]) -> np.ndarray:
    """For each fingerprint the thresholds of its parts that cost least: sum(t_i + 1) = bits + 1, t_i from -1 on."""
    count, units = len(values[0]), layout.bits + 1
    best = np.full((count, units + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for i, v in enumerate(values):
        near, w = estimates(layout, i, v), len(layout.parts[i])
        price = [np.zeros(count)]
        for r in range(layout.radius(i) + 1):
            price.append(PROBE_COST * sum(math.comb(w, j) for j in range(r + 1)) + CANDIDATE_COST * near[:, r])
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for u, p in enumerate(price):
            for s in range(u, units + 1):
                total = best[:, s - u] + p
                better = total < new[:, s]
                new[better, s], pick[better, s] = total[better], u
        best = new
        picks.append(pick)
    out, left, rows = np.zeros((count, len(values)), np.int8), np.full(count, units), np.arange(count)
    for i in range(len(values) - 1, -1, -1):
        u = picks[i][rows, left]
        out[:, i], left = u - 1, left - u
    return out


# probing


def _salts(layout: Layout, i: int, values: np.ndarray) -> np.ndarray:
    """Over how many tasks a value's fingerprints are dealt: the same for index and probes."""
    return 1 + np.minimum(estimates(layout, i, values)[:, 0] // SALT_ROWS, (1 << 20) - 1).astype(np.int64)


def _key(i: int, values: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (i << 52) | (values.astype(np.int64) << 20) | salt


def postings(layout: Layout, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, kind) of the index and of probes; kind 0: index, 1: index and probe of its own key, 2: probe."""
    values = [part_values(fp, p) for p in layout.parts]
    radius = allocate(layout, values)
    rows = np.arange(len(fp))
    mixed = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)

    def spread(i: int, r: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times = _salts(layout, i, v)
        salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(r, times), _key(i, np.repeat(v, times), salt), np.full(len(salt), 2, np.int8)

    for i, v in enumerate(values):
        times = _salts(layout, i, v)
        one = times == 1
        yield rows, _key(i, v, mixed % times), ((radius[:, i] >= 0) & one).astype(np.int8)
        if (wide := (radius[:, i] >= 0) & ~one).any():
            yield spread(i, rows[wide], v[wide])
        for r in range(1, int(radius[:, i].max(initial=0)) + 1):
            who = rows[radius[:, i] >= r]
            for flips in combinations(range(len(layout.parts[i])), r):
                yield spread(i, who, v[who] ^ np.uint64(sum(1 << f for f in flips)))


class Forest:
    """Trees over nodes 0 to n - 1, linked in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def edges(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(names)))
        return names[child], names[self.parent[child]]


def whole_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by key, then kind, in pieces of whole runs of a key, of about `most` rows.

    A longer run comes in several pieces, each with the run's index rows (kind 0 or 1; once all of them are there)
    and some of its probes: memory is bounded by the index rows of one key, not by its probes.
    """
    held: list[pa.RecordBatch] = []
    rows, enough = 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield t.slice(0, cut)
            rest = t.slice(cut)
        else:
            kind = t.column("kind").to_numpy()
            if kind[-1] == 2 and (kind == 2).sum() >= most // 2:
                yield t
                index = t.filter(pa.array(kind < 2))
                at = index.schema.get_field_index("kind")
                rest = index.set_column(at, t.schema.field(at), pa.array(np.zeros(index.num_rows, np.int8)))
            else:
                rest = t
        held = rest.combine_chunks().to_batches()
        rows = rest.num_rows
        enough = max(most, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def candidates(key: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of probes (kind 1, 2) and of the index rows (kind 0, 1) of their keys, STEP at once."""
    index, probe = np.flatnonzero(kind < 2), np.flatnonzero(kind >= 1)
    index = index[np.argsort(key[index], kind="stable")]
    lo, hi = np.searchsorted(key[index], key[probe], "left"), np.searchsorted(key[index], key[probe], "right")
    probe, lo, count = probe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    upto = np.cumsum(count)
    start = 0
    while start < len(probe):
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + STEP, "right")))
        # a probe whose bucket alone exceeds a step is cut further
        for cut in range(0, int(count[start]) if stop == start + 1 else 1, STEP):
            c = np.minimum(count[start:stop] - cut, STEP) if stop == start + 1 else count[start:stop]
            yield np.repeat(probe[start:stop], c), index[np.repeat(lo[start:stop] + cut, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        start = stop


def linked(key: np.ndarray, fp: np.ndarray, node: np.ndarray, kind: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees over the rows of a key that differ in at most `bits`: (node, root)."""
    names, local = np.unique(node, return_inverse=True)
    forest = Forest(len(names))
    for q, x in candidates(key, kind):
        near = (local[q] != local[x]) & (np.bitwise_count(fp[q] ^ fp[x]) <= bits)
        forest.link(local[q[near]], local[x[near]])
    return forest.edges(names)


def met(key: np.ndarray, fp: np.ndarray, node: np.ndarray, kind: np.ndarray, bits: int) -> np.ndarray:
    """Which rows differ from another node's of their key, probe from index, in at most `bits`."""
    out = np.zeros(len(key), bool)
    for q, x in candidates(key, kind):
        near = (node[q] != node[x]) & (np.bitwise_count(fp[q] ^ fp[x]) <= bits)
        out[q[near]] = True
        out[x[near]] = True
    return out


def proved(key: np.ndarray, node: np.ndarray, kind: np.ndarray, sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees over the rows of a key, probe and index, whose sketches are alike: (node, root)."""
    names, local = np.unique(node, return_inverse=True)
    forest = Forest(len(names))

    def prove(q: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(q), PROOFS):
            a, b = q[at : at + PROOFS], x[at : at + PROOFS]
            apart = forest.parent[local[a]] != forest.parent[local[b]]  # what is linked already needs no proof
            a, b = a[apart], b[apart]
            sure = similarity(sketches[a], sketches[b]) >= least
            forest.link(local[a[sure]], local[b[sure]])

    # first each row with the first of its key: in a group of copies that links nearly all, so that few pairs are left
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    run = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
    first = order[begin][run]
    fits = (kind[order] >= 1) & (kind[first] < 2) | (kind[order] < 2) & (kind[first] >= 1)
    prove(first[fits], order[fits])
    # then the pairs that are still apart; where all rows are both, those linked to the first need not ask the others
    root, here = forest.parent[local[order]], kind[order]
    mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
    even = (np.minimum.reduceat(here, begin) == 1) & (np.maximum.reduceat(here, begin) == 1)
    asks = ~(even[run] & (root == root[begin][run]))
    part = mixed[run]
    some = order[part]
    for q, x in candidates(key[some], np.where(asks[part], here[part], 0)):
        prove(some[q], some[x])
    return forest.edges(names)


def postings_of(distinct: DataFrame, n: int, bits: int) -> tuple[DataFrame, int]:
    """Index and probe rows (key, kind, fp, node) of the fingerprints, and about how many one makes."""
    layout = make_layout(distinct, n, bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _unsigned(batch.column(0))
            for row, key, kind in postings(layout, fp):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), *batch.take(pa.array(row)).columns], names=["key", "kind", "fp", "node"])

    m, spare = len(layout.parts), bits - len(layout.parts) + 1
    probes = sum(sum(math.comb(len(p), j) for j in range(max(0, spare // m + (i < spare % m)) + 1)) for i, p in enumerate(layout.parts))
    return distinct.select("fp", "node").mapInArrow(tidy(emit), POSTINGS), m + probes


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "key").sortWithinPartitions("key", "kind")


def link_trees(distinct: DataFrame, bits: int) -> DataFrame:
    """Edges a, b between nodes of `distinct` (fp, node) whose fingerprints differ in at most `bits`, as trees from each task."""
    spark = ready(distinct.sparkSession)
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], EDGES)
    rows, each = postings_of(distinct, n, bits)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, RUN_ROWS):
            key, kind, fp, node = (t.column(c).to_numpy() for c in ("key", "kind", "fp", "node"))
            a, b = linked(key, fp.view(np.uint64), node, kind, bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt(rows, partitions(spark, math.ceil(n * each * 33 / TASK_BYTES))).mapInArrow(tidy(link), EDGES)


def near_rows(distinct: DataFrame, bits: int) -> DataFrame:
    """key, kind, node of the postings of `distinct` (fp, node) that have a fingerprint within `bits` at their key."""
    spark = ready(distinct.sparkSession)
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], MET)
    rows, each = postings_of(distinct, n, bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, RUN_ROWS):
            key, kind, fp, node = (t.column(c).to_numpy() for c in ("key", "kind", "fp", "node"))
            near = pa.array(met(key, fp.view(np.uint64), node, kind, bits))
            yield from t.select(["key", "kind", "node"]).filter(near).to_batches()

    return dealt(rows, partitions(spark, math.ceil(n * each * 33 / TASK_BYTES))).mapInArrow(tidy(meet), MET)


def band_keys(distinct: DataFrame) -> DataFrame:
    """key, node of the bands of `distinct` (node, bands)."""
    ready(distinct.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(batch.num_rows, BANDS)
                for i in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, i] ^ i), batch.column(0)], names=["key", "node"])

    return distinct.select("node", "bands").mapInArrow(tidy(emit), "key long, node long")


def band_rows(rows: DataFrame) -> DataFrame:
    """key, kind, node of the rows (key, node) whose key several nodes share. Keys of very many nodes are salted: each node
    is index under one salt and probe under all."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    salts = F.floor(F.col("n") / SALT_ROWS).cast("int")
    shared = rows.join(counts, "key").withColumn("salts", salts)
    once = shared.where("salts = 0").select("key", F.lit(1).cast("byte").alias("kind"), "node")
    hot = shared.where("salts > 0")
    salted = lambda s: F.xxhash64("key", s)
    index = hot.select(salted(F.pmod(F.xxhash64("node"), F.col("salts") + 1).cast("int")).alias("key"), F.lit(0).cast("byte").alias("kind"), "node")
    probe = hot.select("key", "node", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("s")).select(salted(F.col("s")).alias("key"), F.lit(2).cast("byte").alias("kind"), "node")
    return once.unionByName(index).unionByName(probe)


def proved_trees(here: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Edges a, b of rows (key, kind, node) of a key whose sketches, from `distinct` (node, sketch), are alike, as trees."""
    spark = ready(distinct.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, PROVED_ROWS):
            key, kind, node = (t.column(c).to_numpy() for c in ("key", "kind", "node"))
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(key), BINS)
            a, b = proved(key, node, kind, sketches, least)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    tasks = partitions(spark, math.ceil(here.count() * (33 + BINS + 16) / TASK_BYTES))
    return dealt(here.join(distinct.select("node", "sketch"), "node").select("key", "kind", "node", "sketch"), tasks).mapInArrow(tidy(link), EDGES)


# components


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches), for the nodes of edges a, b."""

    def stat(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = stat(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = stat(now)
        discard(last)
        if after == before:
            break
        before = after
    own = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of every row."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    # a fingerprint of null doc_ids alone still links others: it stands for itself below all doc_ids' reach
    named = distinct.select("fp", F.coalesce("node", F.lit((1 << 62)) + F.pmod(F.col("fp"), F.lit(1 << 61))).alias("node"), F.col("node").alias("least"))
    found = components(link_trees(named, bits))
    placed = named.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    placed = placed.select("fp", F.when(F.col("component") < (1 << 62), F.col("component")).alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(placed, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _near_groups(docs: DataFrame, bits: int, shingle: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id and group, and the written tables that these are read from."""
    prints = written(near_fingerprints(docs.where("doc_id is not null"), shingle), "near-fingerprints")
    distinct = written(prints.groupBy("fp", "sketch").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "near-distinct")
    keys = written(band_keys(distinct), "near-bands")
    met_ = written(near_rows(distinct, bits).unionByName(band_rows(keys)), "near-met")
    discard(keys)
    found = components(proved_trees(met_, distinct, least))
    discard(met_)
    placed = distinct.join(found, "node", "left").select("fp", "sketch", F.coalesce("component", "node").alias("group"))
    return prints.join(placed, ["fp", "sketch"]).select("doc_id", "group"), [prints, distinct]


def near_groups(docs: DataFrame, bits: int = NEAR_BITS, shingle: int = NEAR_SHINGLE, least: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id and group (the least doc_id of its near duplicates) for all doc_ids but null.

    Candidates are within `bits` of the SimHash of their words, or share a band of least hashes of their shingles
    (text put in moves many bits of the words, not the bands). Postings travel without sketches; those that meet another
    at their key are joined with theirs, and links are verified on them: their estimate of the Jaccard similarity has a
    standard error of 0.025 on long texts and of none on texts of few shingles.
    """
    return _near_groups(docs, bits, shingle, least)[0]


def keep_one(docs: DataFrame, bits: int = NEAR_BITS, shingle: int = NEAR_SHINGLE, least: float = NEAR_SIMILARITY) -> DataFrame:
    """The rows of docs without those that have a near duplicate of a lesser doc_id; rows with a null doc_id stay."""
    name = fresh(docs.columns, "copy_id")
    groups, used = _near_groups(docs, bits, shingle, least)
    copies = written(groups.where(F.col("doc_id") != F.col("group")).select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    discard(*used)
    return docs.join(copies, F.col("doc_id") == F.col(name), "left_anti")
