"""Characters to tokens: where a text stands in its context, sentences over offsets, and the way round offsets that lie."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .details import bound, tokens_before, tokens_in_span


def located(full: Column, raw: Column) -> Column:
    """struct(start, end) of a text in its context, in code points: at the end if it stands there, else the first place;
    NULL where it isn't found."""
    n = F.length(raw)
    start = F.when(F.endswith(full, raw), F.length(full) - n).otherwise(F.position(raw, full) - 1)
    return F.when(start >= 0, F.struct(start.alias("start"), (start + n).alias("end")))


def shifted(spans: Column, by: Column) -> Column:
    """Spans, structs (start, end), moved by the place at which their text begins."""
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def prefix_text(prefix: Column, raw: Column, end: Column, sentence: Column) -> Column:
    """The text up to a sentence's end: as stored, cut from the raw text, or the sentence alone."""
    return F.coalesce(F.nullif(prefix, F.lit("")), F.when(end.isNotNull(), F.substring(raw, F.lit(1), end)), sentence, F.lit(""))


def offsets_lie(offsets: Column, full: Column) -> Column:
    """Whether offsets, structs (s, e), overlap, run backwards, or leave out anything but white space of the text."""
    real = F.filter(offsets, lambda o: o["s"] != o["e"])
    blank = lambda a, b: F.regexp_replace(F.substring(full, a + 1, b - a), "(?U)\\s+", "") == ""
    backwards = F.exists(real, lambda o: o["e"] < o["s"])
    at = F.sequence(F.lit(1), F.size(real) - 1)
    between = lambda i: (real[i]["s"] < real[i - 1]["e"]) | ((real[i]["s"] > real[i - 1]["e"]) & ~blank(real[i - 1]["e"], real[i]["s"]))
    apart = F.when(F.size(real) > 1, F.exists(at, between)).otherwise(F.lit(False))
    last = F.element_at(real, -1)["e"]
    ends = ((real[0]["s"] > 0) & ~blank(F.lit(0), real[0]["s"])) | ((last < F.length(full)) & ~blank(last, F.length(full)))
    return F.when(F.size(real) == 0, F.lit(False)).otherwise(backwards | apart | ends)


def prefix_map(raw: str, decoded: str) -> list[int]:
    """For each boundary of the raw text the boundary of the decoded text that it stands for; never falling.

    What both share maps one to one, replaced text in proportion, and text that only the raw one has to a point.
    """
    out = np.zeros(len(raw) + 1, np.int64)
    for tag, a, b, c, d in SequenceMatcher(None, raw, decoded, autojunk=False).get_opcodes():
        if tag == "insert":
            out[a] = max(out[a], d)
        else:
            out[a : b + 1] = c + np.arange(b - a + 1) * (d - c) // (b - a)
    out[-1] = len(decoded)
    return np.maximum.accumulate(out).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def prefix_map_udf(raw: pd.Series, decoded: pd.Series) -> pd.Series:
    return pd.Series([prefix_map(a or "", b or "") for a, b in zip(raw, decoded, strict=True)])


#: Not to be put into other expressions, where Spark can't run Python.
_map = prefix_map_udf.asNondeterministic()


OFFSETS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def piece_offsets(pieces: Column) -> Column:
    """Offsets of decoded pieces in their concatenation."""
    ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), s), -1), F.lit(0)) + F.length(p))))
    return F.zip_with(ends, pieces, lambda e, p: F.struct((e - F.length(p)).alias("s"), e.alias("e")))


def over_offsets(spans: Column, offsets: Column) -> Column:
    """Each span (start, end) with its tokens: their indices, first, last and number, and how many stand before it."""
    found = lambda s: tokens_in_span(offsets, s["start"], s["end"])

    def one(s: Column) -> Column:
        t = found(s)
        first = F.try_element_at(t, F.lit(1))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("tokens"), first.alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"), F.size(t).alias("count"), F.coalesce(first, F.lit(0)).alias("before"))

    return F.transform(spans, one)


def aligned(df: DataFrame, full: str = "full_text", spans: str = "spans", offsets: str = "offsets", pieces: str = "pieces", raw_start: str = "raw_start") -> DataFrame:
    """With `sentences` (spans over tokens), `prompt_tokens` and `by_decoded` for each example.

    The tokenizer's offsets serve unless they lie or leave a sentence without a token; then those of the decoded pieces do,
    through the map from the raw text to them, if the offsets lie or more sentences get a token so. Spans stay those of the
    raw text.
    """
    zeros = lambda s: F.size(F.filter(s, lambda x: x["count"] == 0))
    plain = bound(df, {"_raw": over_offsets(F.col(spans), F.col(offsets)), "_lie": offsets_lie(F.col(offsets), F.col(full)), "_decoded": F.array_join(F.col(pieces), "")})
    plain = plain.withColumn("_zero", zeros(F.col("_raw")))
    # the map is made where it is needed only
    doubt = F.col("_lie") | (F.col("_zero") > 0)
    mapped = plain.withColumn("_map", _map(F.when(doubt, F.col(full)).otherwise(F.lit("")), F.when(doubt, F.col("_decoded")).otherwise(F.lit(""))))
    to = lambda c: F.element_at("_map", (c + 1).cast("int")).cast("int")
    moved = F.transform(F.col(spans), lambda s: F.struct(to(s["start"]).alias("start"), F.greatest(to(s["start"]), to(s["end"])).alias("end")))
    placed = bound(mapped, {"_pieces": piece_offsets(F.col(pieces)), "_moved": F.when(doubt, moved)})
    both = bound(placed, {"_new": over_offsets(F.col("_moved"), F.col("_pieces"))})
    use = doubt & (F.col("_lie") | (zeros(F.col("_new")) < F.col("_zero")))
    kept = F.zip_with(F.col("_new"), F.col(spans), lambda n, s: n.withField("start", s["start"]).withField("end", s["end"]))
    prompt = F.when(use, tokens_before(F.col("_pieces"), to(F.col(raw_start)))).otherwise(tokens_before(F.col(offsets), F.col(raw_start)))
    out = bound(both, {"sentences": F.when(use, kept).otherwise(F.col("_raw")), "prompt_tokens": prompt, "by_decoded": use})
    return out.drop("_raw", "_lie", "_zero", "_decoded", "_map", "_pieces", "_moved", "_new")
