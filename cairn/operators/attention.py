"""Summaries of stored attention and activations: array columns in, numbers by head, layer and sentence out.

`row` is one head's attention from a sentence's last token to all tokens up to it (an array of doubles). Places are
indices of tokens, ends included. What has no mass or no width is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import finite
from . import metrics

TINY = 1e-6


def _part(row: Column, start: Column, stop: Column) -> Column:
    """Tokens from start up to stop (not included); none where either is NULL."""
    inside = start.isNotNull() & stop.isNotNull() & (stop > start)
    return F.when(inside, F.slice(row, (start + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.array().cast("array<double>"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part / (whole + TINY))))


def head_metrics(row: Column, place: dict[str, Column], recent: int = 64) -> Column:
    """A struct of one head's metrics. place: start, end, and (NULL where there is none) prev_start, prev_end, prev3_start,
    prev3_end, the spans of the sentence before and of the three before."""
    start, end = place["start"], place["end"]
    zero, edge = F.lit(0), F.greatest(F.lit(0), start - recent)
    parts = {
        "full": _part(row, zero, end + 1),
        "current": _part(row, start, end + 1),
        "prior": _part(row, zero, start),
        "prev": _part(row, place["prev_start"], place["prev_end"] + 1),
        "prev3": _part(row, place["prev3_start"], place["prev3_end"] + 1),
        "recent": _part(row, edge, start),
        "early": _part(row, zero, edge),
    }
    mass = {k: metrics.mass(p) for k, p in parts.items()}
    each = {k: metrics.per_token_mass(mass[k], F.size(p)) for k, p in parts.items()}
    prior = parts["prior"]
    made = {
        "current_vs_prior": metrics.mass_ratio(each["current"], each["prior"]),
        "current_vs_prev": metrics.mass_ratio(each["current"], each["prev"]),
        "current_vs_prev3": _share(mass["current"], mass["current"] + mass["prev3"]),
        "recent_vs_early": metrics.mass_ratio(each["recent"], each["early"]),
        "prev_share_of_prior": _share(mass["prev"], mass["prior"]),
        "current_share_total": _share(mass["current"], mass["current"] + mass["prior"]),
        "entropy_prior": metrics.normalized_entropy(prior),
        "entropy_full": metrics.normalized_entropy(parts["full"]),
        "top1_prior": metrics.top_mass(prior, 1),
        "top5_prior": metrics.top_mass(prior, 5),
        "herfindahl_prior": metrics.herfindahl(prior),
        "effective_support_prior": metrics.effective_support(prior),
    }
    return F.struct(*[c.alias(k) for k, c in made.items()])


METRICS = ["current_vs_prior", "current_vs_prev", "current_vs_prev3", "recent_vs_early", "prev_share_of_prior", "current_share_total", "entropy_prior", "entropy_full", "top1_prior", "top5_prior", "herfindahl_prior", "effective_support_prior"]


def layer_features(df: DataFrame, keys: list[str], heads: str, layer: str, place: dict[str, Column], recent: int = 64) -> DataFrame:
    """keys, layer, metric, mean, std, max: the heads' metrics of each row's layer, summarised over its heads."""
    by_head = df.select(*keys, layer, F.transform(F.col(heads), lambda h: head_metrics(h, place, recent)).alias("_m"))
    values = lambda m: F.struct(F.lit(m).alias("metric"), F.transform("_m", lambda x: x[m]).alias("v"))
    long = by_head.select(*keys, layer, F.explode(F.array(*map(values, METRICS))).alias("f"))
    return long.select(*keys, layer, "f.metric", F.inline(F.array(metrics.head_summary(F.col("f.v")))))


def context_balance(row: Column, prompt_tokens: Column, start: Column, end: Column) -> Column:
    """struct(entropy, balance) of a head's mean attention from a sentence's tokens: how evenly it lies over the raw text
    before the sentence, and the mass per token there over that and the sentence's own."""
    first = F.least(prompt_tokens, start)
    context, own = _part(row, first, start), _part(row, start, end + 1)
    each = lambda p: metrics.mass(p) / F.nullif(F.size(p), F.lit(0))
    total = each(context) + each(own)
    return F.struct(metrics.normalized_entropy(context).alias("entropy"), F.when(total > 0, each(context) / total).alias("balance"))


def activation_scalars(slots: Column, filled: Column) -> Column:
    """A struct of scalars of the last sentences' vectors, newest first: cosines of the newest with the one before and the
    mean of the three before, its norm, the changes of norm and vector, and how alike all are."""
    some = F.transform(F.filter(F.arrays_zip(slots.alias("v"), filled.alias("f")), lambda s: s["f"]), lambda s: s["v"])
    now, before = F.try_element_at(some, F.lit(1)), F.try_element_at(some, F.lit(2))
    older = F.slice(some, 2, 3)
    total = F.aggregate(older, F.transform(now, lambda x: x.cast("double") * 0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    mean3 = F.when(F.size(some) >= 2, F.transform(total, lambda x: x / F.size(older)))
    norm = lambda v: F.sqrt(metrics.dot(v, v))
    change = F.zip_with(now, before, lambda a, b: a.cast("double") - b.cast("double"))
    return F.struct(
        metrics.cosine(now, before).alias("cos_cur_prev"),
        metrics.cosine(now, mean3).alias("cos_cur_mean3"),
        norm(now).alias("norm_cur"),
        (norm(now) - norm(before)).alias("norm_jump"),
        norm(change).alias("delta_vec_norm"),
        metrics.mean_pairwise_cosine(some).alias("pairwise_cohesion"),
    )


def reduced_bands(df: DataFrame, roots: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """For each root with its columns by layer: mean, least, largest and deviation of the early, middle and late layers."""
    names = ["mean", "least", "most", "spread"]
    out = []
    for root, columns in roots.items():
        bands = metrics.layer_bands(F.array(*[finite(F.col(c)) for c in columns]))
        out += [bands[i][n].alias(f"{root}__band_{band}__{n}") for i, band in enumerate(("early", "middle", "late")) for n in names]
    return df.select(*keys, *out)
