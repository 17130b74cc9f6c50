"""Pairs of a deceptive sentence and a truthful one in its place, from probes and their generations; a viewer's generations.

A history is an array of probes in order: structs (sentence_text, prefix_text, prompt, deception_rate, num_valid,
num_truthful, generations of structs (gen_text, is_truthful, deceptive, parse_error)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import finite
from ..functions.text import count_alpha_words, first_sentence, is_lossy, join_continuation, normalize, slug, usable_sentence
from .select import first_per

#: The number of words that a donor's sentence should have.
WORDS = 12


def donors(generations: Column, target: Column, least_words: int = 4, single_line: bool = True) -> Column:
    """Truthful generations whose first sentence is usable and another than the target, best first: structs (distance from
    the wanted number of words, length, gen_idx, sentence, words)."""
    said = F.transform(generations, lambda g, i: F.struct(g["is_truthful"].alias("ok"), i.alias("gen_idx"), F.trim(first_sentence(F.coalesce(g["gen_text"], F.lit("")))).alias("sentence")))
    fits = F.filter(said, lambda d: F.coalesce(d["ok"], F.lit(False)) & usable_sentence(d["sentence"], least_words, single_line) & (normalize(d["sentence"]) != normalize(target)))
    words = lambda d: count_alpha_words(d["sentence"])
    return F.array_sort(F.transform(fits, lambda d: F.struct(F.abs(words(d) - WORDS).alias("distance"), F.length(d["sentence"]).alias("length"), d["gen_idx"].alias("gen_idx"), d["sentence"].alias("sentence"), words(d).alias("words"))))


def commitment_pairs(traces: DataFrame, most: int = 100, least_delta: float = 0.2, least_rate: float = 0.5, least_valid: int = 0, least_words: int = 4, single_line: bool = True) -> DataFrame:
    """Of each environment the `most` pairs with the largest rise of the rate between consecutive probes, then the highest
    rate, most donors and longest donor. Traces: env, example_id, path, prompt, history.

    Each trace is scanned by itself; what is not among the best of its environment goes before the shuffle.
    """
    at = F.sequence(F.lit(1), F.size("history") - 1)
    both = F.transform(at, lambda i: F.struct(i.alias("pos"), F.col("history")[i - 1].alias("shared"), F.col("history")[i].alias("target")))
    steps = traces.where(F.size("history") > 1).select("env", "example_id", "path", "prompt", F.explode(both).alias("s")).select("env", "example_id", "path", "prompt", "s.*")
    rate, before = finite(F.col("target.deception_rate")), finite(F.col("shared.deception_rate"))
    valid = lambda p: F.coalesce(F.col(f"{p}.num_valid"), F.lit(0))
    rows = steps.withColumns({"rate": rate, "shared_rate": before, "commitment_delta": rate - before, "sentence": F.trim("target.sentence_text")})
    rows = rows.where((F.col("commitment_delta") > least_delta) & (F.col("rate") >= least_rate) & usable_sentence(F.col("sentence"), least_words, single_line))
    if least_valid > 0:
        rows = rows.where((valid("shared") >= least_valid) & (valid("target") >= least_valid))
    asked = F.coalesce("target.prompt", "prompt")
    rows = rows.withColumns({"prompt": asked, "context": F.col("shared.prefix_text")}).where((F.coalesce("prompt", F.lit("")) != "") & (F.coalesce("context", F.lit("")) != ""))
    found = rows.select("*", F.inline(F.array(F.struct(donors(F.col("shared.generations"), F.col("sentence"), least_words, single_line).alias("donors"))))).where(F.size("donors") > 0)
    best = F.col("donors")[0]
    made = found.select(
        "env",
        F.concat("env", F.lit("__"), slug(F.col("example_id")), F.lit("__sent_"), F.col("pos"), F.lit("__donor_"), best["gen_idx"]).alias("pair_id"),
        "example_id",
        "path",
        (F.col("pos") - 1).alias("shared_pos"),
        F.col("pos").alias("commitment_pos"),
        F.col("sentence").alias("deceptive_sentence"),
        best["sentence"].alias("truthful_sentence"),
        F.col("shared_rate").alias("shared_rate"),
        F.col("rate").alias("commitment_rate"),
        "commitment_delta",
        best["words"].cast("double").alias("donor_clarity"),
        F.size("donors").alias("n_donors"),
        F.concat("prompt", "context").alias("shared_text"),
        F.concat("prompt", join_continuation(F.col("context"), F.col("sentence"))).alias("deceptive_text"),
        F.concat("prompt", join_continuation(F.col("context"), best["sentence"])).alias("truthful_text"),
    )
    return first_per(made, ["env"], [F.desc("commitment_delta"), F.desc("commitment_rate"), F.desc("n_donors"), F.desc("donor_clarity"), "path", "commitment_pos"], most)


def viewed(generations: Column, repair) -> Column:
    """A probe's generations as a viewer shows them: number, text (bytes repaired by `repair`), label, whether its words run
    together, and its error."""
    text = lambda g: repair(F.coalesce(g["gen_text"], F.lit("")))
    lie = lambda g: F.coalesce(g["deceptive"], F.lit(False)) | ~F.coalesce(g["is_truthful"], F.lit(True))
    true = lambda g: F.coalesce(g["is_truthful"], F.lit(False)) | ~F.coalesce(g["deceptive"], F.lit(True))
    label = lambda g: F.when(lie(g), "deceptive").when(true(g), "honest").otherwise("ungraded")
    return F.transform(generations, lambda g, i: F.struct((i + 1).alias("n"), text(g).alias("text"), label(g).alias("label"), is_lossy(text(g)).alias("lossy"), repair(g["parse_error"]).alias("error")))
