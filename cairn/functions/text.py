"""Text functions: built-in expressions where they say the same, Arrow UDFs for scanners."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations that don't end a sentence (the word before the stop, lower case), and what closes one.
ABBREVIATIONS = ["dr", "etc", "fig", "jr", "mr", "mrs", "ms", "prof", "sr", "st", "vs"]
CLOSERS = "\"')}]"
_STOP, _CLOSE, _BLANK, _LAST_WORD = re.compile("[.!?]"), re.compile(f"[{re.escape(CLOSERS)}]*"), re.compile("\\s*"), re.compile("[^\\W\\d_]+$")
#: Fixed value: a sentence of a reasoning that is cut before its end.
CUT_SENTENCE = "[^.!?\\n]+[.!?]+[\"')\\]]*|\\S[^.!?\\n]*$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value in several places and computes it once for each row, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def blank_runs_to_space(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+", " ")


def sentence_spans(text: str | None, abbreviations: frozenset[str] = frozenset(ABBREVIATIONS)) -> list[tuple[int, int]]:
    """Spans of sentences: each . ! ? ends one, but in decimals and behind abbreviations, with the closing quotes and
    brackets behind it; white space between them is in none."""
    if not text:
        return []
    spans, n = [], len(text)
    start = at = _BLANK.match(text).end()
    while stop := _STOP.search(text, at):
        at = stop.end()
        if stop[0] == ".":
            if 0 < stop.start() < n - 1 and text[stop.start() - 1].isdigit() and text[at].isdigit():
                continue
            word = _LAST_WORD.search(text[max(0, stop.start() - 12) : stop.start()])
            if word and word[0].lower() in abbreviations:
                continue
        at = _CLOSE.match(text, at).end()
        spans.append((start, at))
        start = at = _BLANK.match(text, at).end()
    end = start + len(text[start:].rstrip())
    if end > start:
        spans.append((start, end))
    return spans


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(T.StructType(SPAN.fields[:2])))
def spans_udf(texts: pd.Series) -> pd.Series:
    """Spans alone: the text need not travel with each of its sentences."""
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t)])


@F.pandas_udf(T.ArrayType(SPAN))
def sentences_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in sentence_spans(t)] if t else [])


def count_sentences(c: Column) -> Column:
    parts = F.split(F.trim(blank_runs_to_space(c)), "(?<=[.!?]) ")
    return F.size(F.filter(parts, lambda x: x != ""))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9']+"))


def count_alpha_words(c: Column, apostrophes: bool = False) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]+(?:'[A-Za-z]+)?" if apostrophes else "[A-Za-z]+"))


def usable_sentence(c: Column, least_words: int = 4, single_line: bool = True) -> Column:
    out = (F.trim(c) != "") & (count_alpha_words(c) >= least_words)
    return out & ~c.contains("\n") if single_line else out


FIRST_SENTENCE = "(?s)^(.+?[.!?][\"')\\]]*)(?:\\s+|$)(.*)"


def first_sentence(c: Column) -> Column:
    """The first sentence; else what stands before a brace; else all."""
    t = F.trim(c)
    found = F.regexp_extract(t, FIRST_SENTENCE, 1)
    before = F.trim(F.substring_index(t, "{", 1))
    return F.when(found != "", found).when(t.contains("{") & (before != ""), before).otherwise(t)


def after_first_sentence(c: Column) -> Column:
    return F.trim(F.regexp_extract(F.trim(c), FIRST_SENTENCE, 2))


def normalize(c: Column) -> Column:
    """Lower case, single spaces, without stops and quotes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "\\s+", " "), "^[ .!?\"']+|[ .!?\"']+$", "")


def token(c: Column) -> Column:
    """A part of an id: anything but letters, digits and . _ - becomes _; blank is NULL."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", F.regexp_replace(t, "[^A-Za-z0-9._-]+", "_"))


def record_id(run: Column, line: Column, conversation: Column, game: Column, turn: Column, state: Column, sample: Column) -> Column:
    """run/conversation_..|game_../turn_../state_../sample_.., or run/line_N if there is none of these."""
    part = lambda name, c: F.concat(F.lit(f"{name}_"), token(c))
    scope = F.coalesce(part("conversation", conversation), part("game", game))
    parts = [scope, part("turn", turn), part("state", state), part("sample", sample)]
    nothing = F.coalesce(*parts).isNull()
    return F.when(nothing, F.concat_ws("/", run, F.concat(F.lit("line_"), line.cast("string")))).otherwise(F.concat_ws("/", run, *parts))


def sentence_id(example: Column, index: Column) -> Column:
    return F.concat(example.cast("string"), F.lit("/sent_"), F.lpad(index.cast("string"), 4, "0"))


def slug(c: Column, keep: str = "a-z0-9") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), f"[^{keep}]+", "_"), "^_+|_+$", "")


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def join_continuation(prefix: Column, more: Column) -> Column:
    """Both texts with one space between, unless either has white space there or is empty."""
    bare = (prefix == "") | (more == "") | prefix.rlike("\\s$") | more.rlike("^\\s")
    return F.when(bare, F.concat(prefix, more)).otherwise(F.concat_ws(" ", prefix, more))


def slice_chars(c: Column, start: Column, end: Column) -> Column:
    """Code points from start (of 0) up to end."""
    return F.substring(c, start + 1, F.greatest(end - start, F.lit(0)))


def longest_run(c: Column) -> Column:
    """Characters of the longest run without white space."""
    return F.coalesce(F.array_max(F.transform(F.split(c, "(?U)\\s+"), F.length)), F.lit(0))


def is_lossy(c: Column, limit: int = 40) -> Column:
    return longest_run(c) > limit


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^```[A-Za-z]*\\s*", ""), "\\s*```$", ""))


def split_reasoning(c: Column, close: str = "</think>") -> tuple[Column, Column]:
    """What stands before the first close marker, without an open one, and what stands behind it."""
    at = F.instr(c, close)
    before = F.when(at > 0, F.substring(c, F.lit(1), at - 1))
    reason = F.trim(F.regexp_replace(before, "^\\s*<think>", ""))
    answer = F.when(at > 0, F.trim(F.substring(c, at + len(close), F.length(c)))).otherwise(c)
    return reason, answer


def currency_mentions(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\\$\\s?\\d[\\d,]*(?:\\.\\d+)?"))


def contains_any(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def keyword_ids(c: Column, keywords: dict[str, list[str]]) -> Column:
    """Sorted ids of which any keyword is in the text."""
    hits = F.array(*[F.when(contains_any(c, ws), F.lit(k)) for k, ws in sorted(keywords.items())])
    return F.sort_array(F.array_compact(hits))


def only_mention(c: Column, pattern: str) -> Column:
    """The match if all matches are one and the same, else NULL."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))
    return F.when(F.size(found) == 1, found[0])


def byte_symbols() -> dict[str, int]:
    """The reversible map of bytes to printable characters: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_SYMBOLS = byte_symbols()


def repair_bytes(text: str | None) -> str | None:
    """Text that shows byte symbols, decoded; text with other characters has only its two commonest ones changed back."""
    if not text or not ("Ġ" in text or "Ċ" in text):
        return text
    if all(ch in _SYMBOLS for ch in text):
        return bytes(_SYMBOLS[ch] for ch in text).decode("utf-8", "replace")
    return text.replace("Ġ", " ").replace("Ċ", "\n")


@F.pandas_udf(T.StringType())
def repair_bytes_udf(texts: pd.Series) -> pd.Series:
    return texts.map(repair_bytes)


_CUT = re.compile(CUT_SENTENCE)


def cut_before_last(text: str | None, n: int = 2, least_text: int = 120, least_head: int = 80, least_tail: int = 30) -> tuple[str, str] | None:
    """The sentences of the reasoning (up to its end mark) without the last n, and these; NULL where the reasoning or
    either part is too short, or where fewer than two sentences would be left."""
    whole, mark, _ = (text or "").partition("</think>")
    reasoning = whole if whole else (text or "")
    if len(reasoning.strip()) < least_text:
        return None
    said = [m[0] for m in _CUT.finditer(reasoning)]
    if len(said) < n + 2:
        return None
    head, tail = "".join(said[:-n]), "".join(said[-n:])
    return (head, tail) if len(head.strip()) >= least_head and len(tail.strip()) >= least_tail else None


@F.pandas_udf(T.StructType([T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())]))
def cut_before_last_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut_before_last(t) or (None, None) for t in texts], columns=["head", "tail"])


def feature_root(c: Column) -> Column:
    return F.regexp_replace(c, "_l\\d+$", "")


def aliased(c: Column, aliases: dict[str, list[str]]) -> Column:
    """The canonical name of an alias; an unknown name raises."""
    key = F.regexp_replace(F.lower(F.trim(c)), "[ -]+", "_")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in aliases.items():
        out = out.when(key.isin([name, *words]), F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(c, F.lit("null")))))


def seed_from(*parts: Column) -> Column:
    """A number of 48 bits from the parts' SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long")
