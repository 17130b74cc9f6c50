"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of its letters, the
first permuted twice and the second once; permuting is a rotation. A text's vector bundles (adds) its trigrams'
vectors, and a language's prototype bundles its texts' vectors, each of length one. A text goes to the
prototype with the largest cosine, after the mean of the prototypes, which tells no language from another, has
been taken from both.

Texts are lowered; what is not a letter parts words. The prototypes and the floors are learned on all labelled
documents that are given.

Nulls: a null or letterless text is `und` with score 0. Null languages are not learned from. With nothing to
learn from, everything is `und`. The best language says nothing of whether it is any of them (centred cosines sum to
zero, so the best is positive); `keep_identified` asks that of the plain cosine to it, which must reach a share of what
the labelled texts of that language and like length reach. A tie goes to the language that sorts first. Repeated rows give repeated
results; other columns take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, tidy

DIM, SEED = 512, 20240
UND = "und"
#: Trigrams whose vectors a task keeps, in bytes of one component each, and those bundled at once.
MOST_GRAMS, STEP_GRAMS = 40_000, 2_000
#: A text is like its language from this share of the low quantile of labelled texts on; fewer of these say nothing.
LIKE_SHARE, LIKE_QUANTILE, LIKE_ROWS = 2 / 3, 0.05, 10
#: Decimals to which cosines are counted for that quantile: a task keeps so many counts a language and length class.
LIKE_DECIMALS = 4


class Profiler:
    """Texts to vectors. Letters' vectors depend on the letter and the seed alone, so that all tasks agree."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.table = np.zeros(0x110000, np.int32)  # 0: not seen, -1: not a letter, else the letter's place
        self.table[32] = 1
        self.letters = [np.zeros(dim, np.int8), self._letter(32)]
        self.known, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.empty((4096, dim), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8)
        return bits * 2 - 1

    def codes(self, text: str) -> np.ndarray:
        """Places of the letters, words parted and framed by one space (place 1); empty without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        got = self.table[points]
        if (got == 0).any():
            for p in np.unique(points[got == 0]).tolist():
                if chr(p).isalpha():
                    self.table[p] = len(self.letters)
                    self.letters.append(self._letter(p))
                else:
                    self.table[p] = -1
            got = self.table[points]
        got = np.concatenate(([1], np.maximum(got, 1), [1]))
        got = got[~((got == 1) & np.concatenate(([False], got[:-1] == 1)))]
        return got if len(got) > 1 else got[:0]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and their counts; a code holds three letters of 20 bits."""
        c = self.codes(text).astype(np.int64)
        if len(c) < 3:
            return c[:0], c[:0]
        return np.unique((c[:-2] << 40) | (c[1:-1] << 20) | c[2:], return_counts=True)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the trigrams' vectors; grams are sorted. Memory is bounded: what is known is forgotten at times."""
        if len(self.known) > MOST_GRAMS:
            self.known, self.at = self.known[:0], self.at[:0]
        i = np.searchsorted(self.known, grams)
        new = grams[(i == len(self.known)) | (self.known[np.minimum(i, len(self.known) - 1)] != grams)] if len(self.known) else grams
        if len(new):
            n = len(self.known)
            if n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors[:n], np.empty((n + 2 * len(new), self.dim), np.int8)])
            for k, g in enumerate(new.tolist(), n):
                a, b, c = (self.letters[(g >> s) & 0xFFFFF] for s in (40, 20, 0))
                self.vectors[k] = np.roll(a, 2) * np.roll(b, 1) * c
            known, at = np.concatenate([self.known, new]), np.concatenate([self.at, np.arange(n, n + len(new))])
            order = np.argsort(known)
            self.known, self.at = known[order], at[order]
            i = np.searchsorted(self.known, grams)
        return self.at[i]

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of the text's trigrams, of length one."""
        return self.bundle(text)[0]

    def bundle(self, text: str) -> tuple[np.ndarray | None, int]:
        """The text's vector, and its length class: the whole part of log2 of its distinct trigrams."""
        grams, counts = self.trigrams(text)
        if not len(grams):
            return None, 0
        out = np.zeros(self.dim, np.float32)
        for lo in range(0, len(grams), STEP_GRAMS):
            at = self.places(grams[lo : lo + STEP_GRAMS])
            out += counts[lo : lo + STEP_GRAMS].astype(np.float32) @ self.vectors[at].astype(np.float32)
        n = float(np.linalg.norm(out))
        return (out / n if n else None), len(grams).bit_length() - 1


def bucket(mod: int) -> Column:
    """crc32 of doc_id as text, a null doc_id as the empty text, modulo `mod`."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % mod


def labelled(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows with a language and a text: all of them, or about `sample` at most, chosen by a hash of doc_id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if sample is not None and (n := rows.count()) > sample:
        share = int(sample / n * (1 << 32))
        key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
        rows = rows.where(key < share)
    return rows


def learn(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes from all rows with a language and a text."""
    rows = labelled(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = Profiler(dim), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (v := p.vector(text.as_py())) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [s.tolist() for s in sums.values()]})

    ready(docs.sparkSession)
    parts = rows.select("lang", "text").mapInArrow(tidy(run), "lang string, v array<double>")
    # sums by language and place: a row for each language and place reaches the driver, however many documents there are
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).collect()
    langs = sorted(r["lang"] for r in got)
    proto = {r["lang"]: np.array(r["v"]) for r in got}
    return langs, np.array([proto[x] / np.linalg.norm(proto[x]) for x in langs]).reshape(len(langs), dim)


class Classifier:
    """Prototypes, made ready for single texts."""

    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes = langs, prototypes.astype(np.float32)
        self.dim = prototypes.shape[1] if langs else DIM
        mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(self.dim)
        own = prototypes - mean if langs else np.zeros((0, self.dim))
        norms = np.linalg.norm(own, axis=1)
        self.own = (own / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
        self.mean = mean.astype(np.float32)

    def one(self, p: Profiler, text: str | None) -> tuple[str, float]:
        return self.best(p.vector(text) if text else None)

    def best(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None or not self.langs:
            return UND, 0.0
        c = v - self.mean
        n = float(np.linalg.norm(c))
        cos = self.own @ (c / n if n else c)
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best])))


def learn_floors(docs: DataFrame, classifier: Classifier) -> dict[str, dict[int, float]]:
    """For each language, by length class, the least plain cosine of a text that is like it, from all rows with a language
    and a text. The quantile is taken over counts of cosines rounded to LIKE_DECIMALS, so its state is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, place, counts = Profiler(classifier.dim), {x: i for i, x in enumerate(classifier.langs)}, Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang in place:
                    v, size = p.bundle(text.as_py())
                    if v is not None:
                        counts[lang, size, round(float(v @ classifier.prototypes[place[lang]]), LIKE_DECIMALS)] += 1
        kinds = [pa.string(), pa.int32(), pa.float64()]
        arrays = [pa.array([k[i] for k in counts], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), pa.int64())], names=["lang", "size", "cos", "n"])

    ready(docs.sparkSession)
    own = labelled(docs).select("lang", "text").mapInArrow(tidy(run), "lang string, size int, cos double, n long")
    own = own.groupBy("lang", "size", "cos").agg(F.sum("n").alias("n")).groupBy("lang", "size")
    out: dict[str, dict[int, float]] = {}
    for r in own.agg(F.sum("n").alias("n"), F.percentile("cos", F.lit(LIKE_QUANTILE), F.col("n")).alias("low")).collect():
        if r["n"] >= LIKE_ROWS:
            out.setdefault(r["lang"], {})[r["size"]] = LIKE_SHARE * r["low"]
    return out


def like(classifier: Classifier, floors: dict[str, dict[int, float]], p: Profiler, text: str | None) -> bool:
    """Is the text like its best language? By the floor of its length class, or of the next shorter one that has one;
    where none has, by a positive score alone."""
    v, size = p.bundle(text) if text else (None, 0)
    lang, score = classifier.best(v)
    if score <= 0:
        return False
    known = [k for k in floors.get(lang, ()) if k <= size]
    return not known or float(v @ classifier.prototypes[classifier.langs.index(lang)]) >= floors[lang][max(known)]


def predict(docs: DataFrame, classifier: Classifier, columns: list[str]) -> DataFrame:
    """The given columns of every row, lang_pred and score (the cosine; 0 where negative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiler(classifier.dim)
        for batch in batches:
            got = [classifier.one(p, t.as_py()) for t in batch.column(batch.num_columns - 1)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*columns, "lang_pred", "score"])

    ready(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, held_out_fold: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the held-out fold is never learned from."""
    base = docs.select("doc_id", "text", "lang")
    classifier = Classifier(*learn(base.where(bucket(folds) != held_out_fold)))
    out = predict(base, classifier, ["doc_id"])
    return out.select("doc_id", (bucket(folds) == held_out_fold).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: neither `und` nor unlike the labelled texts
    of the best language. If no row has a language to learn from, all rows stay."""
    classifier = Classifier(*learn(docs.select("doc_id", "text", "lang")))
    if not classifier.langs:
        return docs
    floors = learn_floors(docs.select("doc_id", "text", "lang"), classifier)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiler(classifier.dim)
        for batch in batches:
            yield batch.filter(pa.array([like(classifier, floors, p, t.as_py()) for t in batch.column(at)], pa.bool_()))

    ready(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
