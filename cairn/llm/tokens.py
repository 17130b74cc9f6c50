"""Token ids in files of directly addressable codes (DAC).

Ids are cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level k the k-th chunk of the ids
that need it. A bitmap for each level says which ids go on, and a rank directory counts its ones every 512 bits,
so the place of an id's next chunk is found at once and any id can be read without decoding others.

Documents are range-partitioned and sorted by doc_id, encoded, and written as blocks of whole documents: a
Parquet table, in the shared folder, of doc_ids, lengths and one binary DAC payload. Parquet's commit makes the
files safe against lost executors and readable in any store that Spark reaches.

Byte-level BPE never merges across the edge of a run of non-space characters with the one space before it, so
the distinct runs of some texts are encoded once by the tokenizer, common ones are kept, and arrays lay them out. A run of
Latin letters, with ASCII marks after them or not, is one word for the tokenizer's splitter and the marks another, so
these go straight to its model. Texts holding a special token's string or characters that the two regular expression
engines see differently are encoded whole.

Nulls: a null text is empty (one end id); null doc_ids come first. Repeated doc_ids stand in order of their
texts' checksums. A document of any length is encoded whole. Other columns take no part. An empty table gives
empty files and an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, shared_dir, tidy

END_ID = 2
MAGIC, WIDTH, RANK_BITS = b"DAC1", 8, 512
BLOCK_TOKENS = 1 << 18
#: Runs that a worker keeps with their ids, in a task and behind it, and the longest in bytes that is kept; bytes and rows of
#: texts encoded at once, if texts allow it.
KNOWN_RUNS, TASK_RUNS, KNOWN_BYTES = 300_000, 50_000, 48
STEP_BYTES, STEP_ROWS = 2 << 20, 1024
RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD = "[\x1c-\x1f\x85᠎​]"
#: One word of letters that every Unicode version knows as such, and the ASCII marks after it.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[!-/:-@\\[-`{-~]*"
PLAIN = re.compile(f"( ?{_LETTERS})({_MARKS})")
#: Two of these with a line end between.
LINES = re.compile(f"( ?{_LETTERS})({_MARKS})\n({_LETTERS})({_MARKS})")
#: Where a text may be cut: before a space between two other characters a new run begins.
SEAM = re.compile(r"(?<=\S) (?=\S)")
#: A space behind any white space.
BEHIND_SPACE = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\u180e] "

BLOCKS = "part int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """A DAC payload of unsigned ids."""
    rest, levels = np.asarray(ids), []
    if rest.dtype.kind != "u":
        rest = rest.astype(np.uint64)
    width, low = rest.dtype.type(WIDTH), rest.dtype.type((1 << WIDTH) - 1)
    while True:
        more = rest >> width
        on = more != 0
        bits = np.packbits(on, bitorder="little")
        # ones in each whole stretch of RANK_BITS, from the bitmap's bytes
        ones = np.zeros(-(-len(on) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        ones[: len(bits)] = np.bitwise_count(bits)
        counts = ones.reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        rank = (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4")
        levels.append((len(rest), (rest & low).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        if not on.any():
            break
        rest = more[on]
    head = MAGIC + struct.pack("<BB", WIDTH, len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(data + bits + rank for _, data, bits, rank in levels)


class Packed:
    """A DAC payload, read in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC payload")
        self.width, n_levels = struct.unpack_from("<BB", raw, 4)
        sizes = struct.unpack_from(f"<{n_levels}Q", raw, 6)
        at, self.levels = 6 + 8 * n_levels, []
        for n in sizes:
            n_bits, n_rank = (n + 7) // 8, (n + RANK_BITS - 1) // RANK_BITS
            data = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, n_bits, at + n)
            rank = np.frombuffer(raw, "<u4", n_rank, at + n + n_bits)
            at += n + n_bits + 4 * n_rank
            self.levels.append((data, bits, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id: at each level its chunk, its bit, and the rank of its place."""
        out, shift = 0, 0
        for data, bits, rank in self.levels:
            out |= int(data[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            lo = i // RANK_BITS
            first = lo * RANK_BITS // 8
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(rank[lo]) + before, shift + self.width
        return out

    def ids(self) -> np.ndarray:
        """All ids, from the last level to the first."""
        above = None
        for data, bits, _ in reversed(self.levels):
            here = data.astype(np.uint32)
            if above is not None:
                here[np.unpackbits(bits, count=len(data), bitorder="little").astype(bool)] |= above << np.uint32(self.width)
            above = here
        return above


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Known:
    """Runs and their ids in arrays: a tenth of a dict's size, and looked up many at once."""

    def __init__(self, kind: str):
        self.runs = pa.array([], pa.string())
        self.begins, self.sizes, self.data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        self.used = np.zeros(0, np.int32)

    def places(self, runs: pa.Array) -> np.ndarray:
        """Where each of distinct runs is known, or -1."""
        at = pc.fill_null(pc.index_in(runs, value_set=self.runs), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] += 1
        return at

    def add(self, runs: pa.Array, sizes: np.ndarray, data: np.ndarray) -> None:
        self.runs = pa.concat_arrays([self.runs, runs])
        self.begins = np.concatenate([self.begins, len(self.data) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.data = np.concatenate([self.data, data])
        self.used = np.concatenate([self.used, np.ones(len(sizes), np.int32)])
        if len(self.sizes) > KNOWN_RUNS:
            self.keep(KNOWN_RUNS // 2)

    def keep(self, most: int) -> None:
        """Forget all but the runs that were asked for in the most steps; older steps count less each time."""
        if len(self.sizes) > most:
            at = np.sort(np.argpartition(-self.used, most)[:most])
            self.runs = self.runs.take(pa.array(at))
            self.data = laid_out(self.data, self.begins[at], self.sizes[at])
            self.sizes, self.used = self.sizes[at], self.used[at] // 2
            self.begins = np.cumsum(self.sizes) - self.sizes


def laid_out(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data that begin at `begins`, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Texts to ids, as little-endian bytes of `kind`; equal to the tokenizer's own encoding of the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if wide else "<u2"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *[re.escape(t) for t in self.special if t]])
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        shape = json.loads(self.tokenizer.to_str())
        split = shape.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.plain = plain and shape.get("normalizer") is None and shape["model"]["type"] == "BPE"
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.known = Known(self.kind)
        self.marks: dict[str, list[int]] = {}

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, word: str) -> list[int]:
        """Ids of what the splitter takes for one word."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def _marks(self, marks: str) -> list[int]:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._model(marks) if marks else []
            if len(self.marks) < 1000 and len(marks) <= KNOWN_BYTES:
                self.marks[marks] = ids
        return ids

    def _learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each run has, and all their ids. Runs of plain words go to the model, one by one; others are
        encoded by the tokenizer."""
        tokenize, space = self.model.tokenize, self.letters[32]
        flat, sizes, others = [], [], {}
        if self.plain:
            for i, r in enumerate(runs):
                word = r[1:]
                if r[:1] == " " and word.isascii() and word.isalpha():
                    ids = [t.id for t in tokenize(space + word)]
                elif m := PLAIN.fullmatch(r):
                    ids = self._model(m[1]) + self._marks(m[2])
                elif m := LINES.fullmatch(r):
                    ids = self._model(m[1]) + self._marks(m[2]) + self._marks("\n") + self._model(m[3]) + self._marks(m[4])
                else:
                    others[i] = r
                    ids = ()
                flat += ids
                sizes.append(len(ids))
        else:
            others, sizes = dict(enumerate(runs)), [0] * len(runs)
        sizes, flat = np.array(sizes, np.int64), np.array(flat, self.kind)
        if others:
            found = self._learn_others(list(others.values()))
            own = np.fromiter(map(len, found), np.int64, len(found))
            at = np.fromiter(others, np.int64, len(others))
            places = np.repeat((np.cumsum(sizes) - sizes)[at], own)
            flat = np.insert(flat, places, np.array([x for f in found for x in f], self.kind))
            sizes[at] = own
        return sizes, flat

    def _learn_others(self, runs: list[str]) -> list[list[int]]:
        """Words beside line ends and the like are taken as the runs that they are. Those without a space inside are encoded
        in one text, parted by line ends, which stand alone there."""
        inside = [RUNS.findall(r) for r in runs]
        small = list(dict.fromkeys(x for own in inside for x in own))
        solid = [r for r in small if not r[-1].isspace()] if self.newline is not None else []
        odd = [r for r in small if r[-1].isspace()] if self.newline is not None else small
        held = dict(zip(odd, self._raw(odd), strict=True)) if odd else {}
        if solid:
            ids = np.array(self._raw(["\n".join(solid)])[0], np.int64)
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(solid) - 1:
                raise ValueError("line ends don't part these runs")
            for r, a, b in zip(solid, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                held[r] = ids[a:b].tolist()
        return [held[own[0]] if len(own) == 1 else [x for r in own for x in held[r]] for own in inside]

    def _look_up(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct runs, begins and sizes in an array: known ones, or learned now."""
        known = self.known
        at = known.places(runs)
        new, old = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        fresh = runs.take(pa.array(new))
        sizes, data = self._learn(fresh.to_numpy(zero_copy_only=False).tolist())
        begins, counts = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        begins[old], counts[old] = known.begins[at[old]], known.sizes[at[old]]
        begins[new], counts[new] = len(known.data) + np.cumsum(sizes) - sizes, sizes
        every = np.concatenate([known.data, data])
        short = pc.less_equal(pc.binary_length(fresh), KNOWN_BYTES).to_numpy(zero_copy_only=False)
        if short.any():
            known.add(fresh.filter(pa.array(short)), sizes[short], laid_out(data, (np.cumsum(sizes) - sizes)[short], sizes[short]))
        return every, begins, counts

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. In these texts no space stands behind white space, so that runs part
        before every space: distinct parts are looked up once and laid out by arrays."""
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        place, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # a text begins without a space, and so differs from all other runs
        first = words.take(pa.array(place[offsets[:-1]])).dictionary_encode()
        place[offsets[:-1]] = len(words) + first.indices.to_numpy()
        runs = pa.concat_arrays([pc.binary_join_element_wise("", words, " "), first.dictionary])
        data, begins, sizes = self._look_up(runs)
        here = sizes[place]
        upto = np.concatenate(([0], np.cumsum(here)))[offsets]
        return laid_out(data, begins[place], here), np.diff(upto)

    def _runs(self, text: str) -> np.ndarray:
        """The ids of any text without special strings, by its runs."""
        out = [np.zeros(0, self.kind)]
        for piece in pieces(text):
            coded = pa.array(RUNS.findall(piece), pa.string()).dictionary_encode()
            data, begins, sizes = self._look_up(coded.dictionary)
            place = coded.indices.to_numpy()
            out.append(laid_out(data, begins[place], sizes[place]))
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. No text is null."""
        texts = texts.cast(pa.string())  # sessions may send large strings
        lengths = np.zeros(len(texts), np.int64)
        chars = pc.binary_length(texts).to_numpy()
        apart = pc.match_substring_regex(texts, BEHIND_SPACE).to_numpy(zero_copy_only=False) | (chars > STEP_BYTES)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            if odd[lo] or apart[lo]:
                text = texts[lo].as_py()
                ids = np.array(self._raw([text])[0], self.kind) if odd[lo] else self._runs(text)
                hi, count = lo + 1, len(ids)
            else:
                hi, held = lo, 0
                while hi < len(texts) and not (odd[hi] or apart[hi]) and (hi == lo or held + chars[hi] <= STEP_BYTES):
                    held += chars[hi]
                    hi += 1
                ids, count = self._spaced(texts.slice(lo, hi - lo))
            lengths[lo:hi] = count
            out.append(ids)
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, self.kind), lengths


def pieces(text: str, size: int = STEP_BYTES) -> Iterator[str]:
    """The text, cut into pieces of about `size` characters where runs part."""
    at = 0
    while m := SEAM.search(text, at + size):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, which runs many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every document, append end_id, and write blocks in ascending doc_id order to `path`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.crc32(F.encode("text", "UTF-8"))
    placed = rows.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        ids, parts, lengths, held = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            payload = pack(np.concatenate(parts))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            values = [part, block, held, np.concatenate(ids).tolist(), np.concatenate(lengths), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "block", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                some = batch.slice(lo, STEP_ROWS)
                got, sizes = coder.encode(some.column(1))
                ends = np.cumsum(sizes)
                got = np.insert(got, ends, np.array(end_id, got.dtype))
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                docs_ = np.array(some.column(0).to_pylist(), object)
                first = 0
                while first < len(sizes):  # whole documents, up to a block's size
                    before = int(ends[first] - sizes[first])
                    last = min(len(sizes), int(np.searchsorted(ends, before + BLOCK_TOKENS - held, "left")) + 1)
                    ids.append(docs_[first:last])
                    lengths.append(sizes[first:last])
                    parts.append(got[before : int(ends[last - 1])])
                    held += int(ends[last - 1]) - before
                    if held >= BLOCK_TOKENS:
                        yield flushed()
                        block, ids, parts, lengths, held = block + 1, [], [], [], 0
                    first = last
        if ids:
            yield flushed()
        coder.known.keep(TASK_RUNS)  # workers wait for their next task side by side

    ready(docs.sparkSession)
    placed.mapInArrow(tidy(run), BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts = block_starts(blocks).drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, lengths = batch.column(2)[i].as_py(), np.array(batch.column(3)[i].as_py(), np.int64)
                ids = Packed(batch.column(4)[i].as_py()).ids().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    ready(spark)
    read = blocks.select("part", "block", "doc_ids", "lengths", "payload").mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block, block_start, n_tokens: the place of each block's first id among all ids."""
    sizes = blocks.select("part", "block", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    parts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return sizes.join(parts, "part").select("part", "block", start.alias("block_start"), "n_tokens")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, id: of each `position` among all ids of the files (places beyond them give no row), by direct access.

    A block spans few cells of BLOCK_TOKENS places, so positions meet their blocks by cell; only blocks that are asked for
    are read, and in them single ids.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    end = F.col("block_start") + F.col("n_tokens")
    cells = F.sequence(F.floor(F.col("block_start") / BLOCK_TOKENS), F.floor((end - 1) / BLOCK_TOKENS))
    spans = block_starts(blocks).select("part", "block", "block_start", end.alias("block_end"), F.explode(cells).alias("cell"))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("position") / BLOCK_TOKENS))
    met = asked.join(spans, "cell").where((F.col("position") >= F.col("block_start")) & (F.col("position") < F.col("block_end")))
    wanted = met.groupBy("part", "block").agg(F.first("block_start").alias("block_start"), F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start, places in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                packed = Packed(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([packed[p - start] for p in places], pa.int64())], names=["position", "id"])

    ready(spark)
    return blocks.select("part", "block", "payload").join(wanted, ["part", "block"]).select("payload", "block_start", "positions").mapInArrow(run, "position long, id long")


def tokens_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, i, id: the i-th id (from 0) of each document asked for, rows that repeat a doc_id each for itself."""
    places = read_tokens(spark, path).select("doc_id", "start", "n_tokens")
    asked = wanted.select("doc_id", "i").distinct().join(places, "doc_id").where("i >= 0 and i < n_tokens").select("doc_id", "i", (F.col("start") + F.col("i")).alias("position"))
    return asked.join(tokens_at(spark, path, asked), "position").select("doc_id", "i", "id")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to the shared folder, and what is read back from there."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
