"""Benchmark decontamination: a BM25 index of the test items, asked for every passage with block-max WAND.

Items are indexed by their words; an item's score for a passage is the BM25 sum over their common words, divided
by what the item scores against itself, so one threshold fits all items. Items of like length make a class. A
class of items up to c words is asked with passages of 1.5 c words every c / 2 words, so every run of c words is
whole in some passage. Items stand in blocks, with the largest score that each word has in each block. A block is
skipped unless the largest scores there of the passage's words add up to the threshold; for all passages of a text
this is one array operation. In the blocks left, WAND walks the posting lists from pivot to pivot.

All items above the threshold are then verified on words: an item is split into question and answer (its last
sentence, or its last quarter if it has one sentence), and both must be found in the document around the
passage: as words in order, a word put in, left out or replaced counting once, so an edit costs one word of the part.
A part of two to four words may hold one such edit; a part of one word must be there.

The statistics and the index cover all items. Items are taken in chunks of a bounded number of words, each of
which is one pass over the documents; a benchmark that is larger makes more passes, not a larger index.

Nulls: null or wordless texts contain nothing, and null or wordless items are in nothing. Equal items are found
under each of their ids; rows that repeat a doc_id are found once for each. Other columns take no part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, tidy

K1, B = 1.2, 0.75
#: Least score (of an item's own), least share of words of the question and of the answer that stand in order.
SCORE, OVERLAP = 0.7, 0.8
#: Items in a block at least, blocks at most; words of items in one index, and so the most that is sent to the executors.
BLOCK, MOST_BLOCKS, INDEX_WORDS = 8, 256, 500_000
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

FOUND = "doc_id long, item_id long, passage_word int, score double, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def edits(part: list[str], text: list[str]) -> int:
    """The fewest words put in, left out or replaced that turn the part into some run of the text's words."""
    place = {w: k for k, w in enumerate(dict.fromkeys(part))}
    terms = np.array([place.get(w, -1) for w in text], np.int32)
    at = np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)  # a run may begin anywhere
    for k, w in enumerate(part, 1):
        new = np.empty_like(row)
        new[0] = k
        np.minimum(row[:-1] + (terms != place[w]), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def overlap(part: list[str], text: list[str], share: float) -> float:
    """The share of the part's words that the text has in order; 1 for an empty part, 0 if too few words are common."""
    if not part:
        return 1.0
    held, there = Counter(part), set(text)
    if sum(n for w, n in held.items() if w in there) < len(part) - allowed(len(part), share):
        return 0.0
    return 1 - edits(part, text) / len(part)


def allowed(n: int, share: float) -> int:
    """Edits that a part of n words may hold."""
    return max(int(n > 1), int(n * (1 - share) + 1e-9))


def is_held(part: list[str], got: float, share: float) -> bool:
    return round((1 - got) * len(part)) <= allowed(len(part), share)


class Index:
    """Posting lists of one length class, and the largest scores in blocks of its items."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int, n_items: int, mean_words: float, frequency: dict[str, int], score: float):
        self.size, self.threshold = size, score
        self.length, self.stride = max(2, size + size // 2), max(1, size // 2)
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        postings: dict[str, list[tuple[int, float]]] = {}
        for at, words in enumerate(self.words):
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean_words)
            gains = {w: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            own = sum(gains.values())
            for w, g in gains.items():
                postings.setdefault(w, []).append((at, g / own))
        self.vocabulary = {w: k for k, w in enumerate(postings)}
        self.items = [[p[0] for p in ps] for ps in postings.values()]
        self.gains = [[p[1] for p in ps] for ps in postings.values()]
        self.block = max(BLOCK, -(-len(items) // MOST_BLOCKS))
        # the largest score of each word in each block of items; the last row is of words that no item has
        self.block_most = np.zeros((len(postings) + 1, -(-len(items) // self.block)), np.float32)
        for t, (at, gain) in enumerate(zip(self.items, self.gains, strict=True)):
            np.maximum.at(self.block_most[t], np.array(at) // self.block, np.array(gain, np.float32))

    def passages(self, terms: np.ndarray) -> list[tuple[int, int]]:
        """(start of a passage, block of items) where the largest scores in the block add up to the threshold."""
        n, none = len(terms), len(self.vocabulary)
        at = np.flatnonzero(terms != none)
        if not len(at):
            return []
        order = at[np.argsort(terms[at], kind="stable")]
        before = np.full(n, -1, np.int64)  # where the same word stood last
        same = terms[order[1:]] == terms[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        starts = np.arange(0, max(1, n - self.length + self.stride), self.stride)
        out = []
        for lo in range(0, len(starts), 256):
            s = starts[lo : lo + 256]
            first, last = np.searchsorted(at, s), np.searchsorted(at, s + self.length)
            count = last - first
            place = at[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            window = np.repeat(np.arange(len(s)), count)
            new = before[place] < s[window]  # the first of its word in the passage
            place, window = place[new], window[new]
            if not len(place):
                continue
            begin = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            bound = np.add.reduceat(self.block_most[terms[place]], begin, axis=0)
            w, b = np.nonzero(bound >= self.threshold - 1e-6)
            out += zip(s[window[begin[w]]].tolist(), b.tolist(), strict=True)
        return out

    def search(self, terms: set[int], block: int) -> list[tuple[int, float]]:
        """Items of the block whose score for a passage with these words is at least the threshold, by WAND."""
        need, stop = self.threshold - 1e-9, (block + 1) * self.block
        cursors = []  # current item, term, place in its list
        for t in terms:
            at = bisect_left(self.items[t], block * self.block)
            if at < len(self.items[t]) and self.items[t][at] < stop:
                cursors.append([self.items[t][at], t, at])
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                total += float(self.block_most[t, block])
                if total >= need - 1e-6:
                    pivot = k
                    break
            if pivot < 0:  # all lists together cannot reach the threshold any more
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(self.gains[t][at] for i, t, at in cursors if i == item)
                if score >= need:
                    out.append((item, score))
                item += 1
            left = []
            for i, t, at in cursors:
                if i < item:
                    at = bisect_left(self.items[t], item, at)
                if at < len(self.items[t]) and self.items[t][at] < stop:
                    left.append([self.items[t][at], t, at])
            cursors = left
        return out


def length_class(n: int) -> int:
    """16, 64, 256, ...: the least that holds n words."""
    size = 16
    while size < n:
        size *= 4
    return size


class Finder:
    """All classes of one chunk of the items."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, frequency: dict[str, int], score: float, share: float):
        self.share, self.parts = share, {}
        classes: dict[int, list[tuple[int, list[str]]]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            classes.setdefault(length_class(len(words)), []).append((k, words))
            self.parts[k] = split_item(text)
        self.names = [i for i, _ in items]
        self.indexes = [Index(v, size, n_items, mean_words, frequency, score) for size, v in sorted(classes.items())]

    def find(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item_id, the passage's first word, score, overlap of question and answer) of the items that the text holds."""
        words = words_of(text)
        best: dict[int, tuple[int, float, float, float]] = {}
        for ix in self.indexes if words else ():
            get, none = ix.vocabulary.get, len(ix.vocabulary)
            terms = np.array([get(w, none) for w in words], np.int64)
            for start, block in ix.passages(terms):
                for local, score in ix.search(set(terms[start : start + ix.length].tolist()) - {none}, block):
                    k = ix.ids[local]
                    if k in best and best[k][1] >= score:
                        continue
                    around = words[max(0, start - ix.size) : start + ix.length + ix.size]
                    question, answer = self.parts[k]
                    asked = overlap(question, around, self.share)
                    if not is_held(question, asked, self.share):
                        continue
                    answered = overlap(answer, around, self.share)
                    if is_held(answer, answered, self.share):
                        best[k] = (start, score, asked, answered)
        return [(self.names[k], *v) for k, v in sorted(best.items())]


def finders(benchmark: DataFrame, score: float = SCORE, share: float = OVERLAP) -> Iterator[tuple]:
    """What makes a Finder, for each chunk of the items; statistics are those of all items."""
    spark = ready(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            pairs = [(w, 1) for ws in words for w in set(ws)] + [("", len(ws)) for ws in words if ws]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["word", "n"])

    # "" stands for the items: how many, and their words
    stats = items.select("text").mapInArrow(measure, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    head = stats.where("word = ''").first()
    if head is None:
        return
    n_items, mean_words = head["rows"], head["n"] / head["rows"]
    # equal items are one in the index: a text's copies would all fall into one chunk
    alone = items.groupBy("text").agg(F.min("item_id").alias("item_id"))
    chunks = max(1, math.ceil(head["n"] / INDEX_WORDS))
    placed = alone.withColumn("_chunk", F.pmod(F.xxhash64("text"), F.lit(chunks)))
    for c in range(chunks):
        rows = [(r["item_id"], r["text"]) for r in placed.where(F.col("_chunk") == c).orderBy("item_id", "text").select("item_id", "text").collect() if words_of(r["text"])]
        if rows:
            used = spark.createDataFrame([(w,) for w in {w for _, t in rows for w in words_of(t)}], "word string")
            frequency = {r["word"]: r["n"] for r in stats.join(used, "word").collect()}
            yield [(k, t) for k, (_, t) in enumerate(rows)], n_items, mean_words, frequency, score, share


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, share: float = OVERLAP) -> DataFrame:
    """A row for each document and item that it holds: both ids, the best passage, its score and both overlaps."""
    out = docs.sparkSession.createDataFrame([], f"{FOUND}, item_text string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for finder in finders(benchmark, score, share):
        out = out.unionByName(_search(texts, finder))
    # what the index holds once is found under each of its ids
    ids = benchmark.select(F.col("item_id").cast("long").alias("_item"), F.col("text").alias("_text"))
    named = out.join(ids, F.col("item_text") == F.col("_text"))
    return named.select("doc_id", F.col("_item").alias("item_id"), *[c.split()[0] for c in FOUND.split(", ")[2:]])


def _search(texts: DataFrame, made_of: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, items = Finder(*made_of), dict(made_of[0])
        for batch in batches:
            found = [(d, *f, items[f[0]]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for f in finder.find(t.as_py())]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            names = ["doc_id", "item_id", "passage_word", "score", "question_overlap", "answer_overlap", "item_text"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=names)

    return texts.mapInArrow(tidy(run), f"{FOUND}, item_text string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item."""
    ready(docs.sparkSession)
    at, out = docs.columns.index("text"), docs

    def keeper(made_of: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(*made_of)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return run

    for made_of in finders(benchmark, **parameters):
        out = out.mapInArrow(tidy(keeper(made_of)), docs.schema)
    return out
