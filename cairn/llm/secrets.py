"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions near its hits, then checksums.

Two automata pass over the whole text. One, over the text with A-Z lowered, finds the words that begin an
assignment or a known token; the other, over the text with each byte replaced by its class (hex digit or not),
finds 24 hex digits in a row. A regular expression is tried only at such a place, anchored there. Tokens that
carry a checksum (the last six base-62 digits are the CRC32 of the body) count only if it is right.

Everything runs on UTF-8 bytes, all patterns being ASCII; spans are turned into code points at the end.

Nulls: a null text is empty, a null doc_id stays null. An empty text has no spans and the digest of the empty
string. Repeated rows give repeated results. Other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "github", "npm"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
GITHUB_PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the body's CRC32."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.encode()


def automata():
    import ahocorasick

    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("github", GITHUB_PREFIXES), ("npm", ["npm_"])):
        for k in keys:
            words.add_word(k, (kind, len(k)))
    runs.add_word("h" * LEAST_HEX, LEAST_HEX)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= LEAST_ASSIGN
    if kind == "access":
        return len(m[0]) >= LEAST_ACCESS
    return checksum(m[1]) == m[2]


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}


def find_spans(text: str, words, runs) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, sorted by start, then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str, int]] = []
    ends = dict.fromkeys(PATTERNS, 0)
    for last, (kind, n) in words.iter(raw.translate(LOWER).decode("latin-1")):
        at = last - n + 1
        if at >= ends[kind] and (m := PATTERNS[kind].match(raw, at)):
            ends[kind] = m.end()
            if _passes(kind, m):
                found.append((at, KINDS.index(kind), kind, m.end()))
    end = 0
    for last, n in runs.iter(raw.translate(HEX_CLASS).decode("latin-1")):
        at = last - n + 1
        if at >= end:
            end = HEX.match(raw, at).end()
            found.append((at, KINDS.index("hex"), "hex", end))
    if not found:
        return []
    found.sort()
    if len(raw) == len(text):
        return [(kind, a, b) for a, _, kind, b in found]
    points, at, n = {}, 0, 0
    for cut in sorted({x for a, _, _, b in found for x in (a, b)}):
        n += len(raw[at:cut].decode("utf-8", "surrogatepass"))
        points[cut], at = n, cut
    return [(kind, points[a], points[b]) for a, _, kind, b in found]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans found in its whole text, sorted; an empty array where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = automata()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py() or "", words, runs)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, n_checked (tokens with a right checksum), base_sha256 and all spans as text."""
    spans = scan_secrets(docs)

    def text(kinds: list[str]):
        kept = F.filter("spans", lambda s: s["kind"].isin(kinds))
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kinds: list[str]):
        return F.size(F.filter("spans", lambda s: s["kind"].isin(kinds))).cast("long")

    return spans.select(
        "doc_id",
        count(["assign"]).alias("n_assign"),
        count(["access"]).alias("n_access"),
        count(["hex"]).alias("n_hex"),
        F.sha2(text(KINDS[:3]), 256).alias("base_sha256"),
        text(KINDS).alias("spans"),
        count(KINDS[3:]).alias("n_checked"),
    )
