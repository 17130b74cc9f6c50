"""Ranking metrics, thresholds, effects and similarities, over any number of groups at once.

AUROC and average precision are taken over counts by distinct score, so rows are combined before they are shuffled
and ties need no ranks of single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import finite


def by_score(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct finite score of each group."""
    rows = df.select(*keys, F.col(y).cast("int").alias("y"), finite(F.col(score)).alias("score")).where("y is not null and score is not null")
    return rows.groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def ranking(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """n, positive_rate, auroc (ties count half) and average_precision (step sum); NULL with a single class."""
    counts = by_score(df, keys, y, score)
    down = Window.partitionBy(*keys).orderBy(F.desc("score"))
    above = counts.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    out = above.groupBy(*keys).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("pos") * F.col("neg")).alias("pairs"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return out.select(
        *keys,
        (F.col("p") + F.col("q")).alias("n"),
        (F.col("p") / (F.col("p") + F.col("q"))).alias("positive_rate"),
        F.when(both, F.col("pairs") / (F.col("p") * F.col("q"))).alias("auroc"),
        F.when(both, F.col("steps") / F.col("p")).alias("average_precision"),
    )


def confusion(df: DataFrame, keys: list[str], y: str, predicted: Column) -> DataFrame:
    """tn, fp, fn, tp, accuracy and balanced accuracy."""
    rows = df.select(*keys, F.col(y).cast("int").alias("y"), predicted.cast("int").alias("p")).where("y is not null and p is not null")
    cell = lambda a, b: F.count_if((F.col("y") == a) & (F.col("p") == b))
    out = rows.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    recall, quiet = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return out.withColumns({"accuracy": (F.col("tn") + F.col("tp")) / total, "balanced_accuracy": (recall + quiet) / 2})


def cumulated(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by score (keys, score, n) with `upto`, the rows at or below each score, and `total`.

    Within a key's range of scores, rows are summed by cells of the score first, so that a key with very many distinct
    scores is no one task: cells are the 1,024 equal parts between the key's least and largest score.
    """
    cells = 1024
    ends = counts.groupBy(*keys).agg(F.min("score").alias("_low"), F.max("score").alias("_high"), F.sum("n").alias("total"))
    wide = F.col("_high") > F.col("_low")
    cell = F.when(wide, F.least(F.lit(cells - 1), F.floor((F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells))).otherwise(F.lit(0)).cast("int")
    placed = (counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))).withColumn("_cell", cell)
    sums = placed.groupBy(*keys, "_cell").agg(F.sum("n").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum("n").over(Window.partitionBy(*keys, "_cell").orderBy("score"))
    return placed.join(before, [*keys, "_cell"]).withColumn("upto", F.col("_before") + inside).drop("_cell", "_before", "_low", "_high")


def linear_quantile(counts: DataFrame, keys: list[str], share: Column, extra: list[str] = ()) -> DataFrame:
    """keys, *extra, value: the quantile at `share` (of 0 to 1; of columns keys and extra), linear between rows, over
    counts by score as `cumulated` gives them. Rows are counted, never gathered."""
    place = share * (F.col("total") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("score")))
    low, high = at(F.floor(place)), at(F.ceil(place))
    part = F.first(place - F.floor(place))
    return counts.groupBy(*keys, *extra).agg((low + part * (high - low)).alias("value"))


def prevalence_threshold(df: DataFrame, keys: list[str], y: str, score: str, default: float | None = None) -> DataFrame:
    """The score that as large a share of the rows with a finite score reaches as is positive there (linear quantile):
    infinity where none is, minus infinity where all are, `default` where there are no such rows."""
    counts = by_score(df, keys, y, score).select(*keys, "score", (F.col("pos") + F.col("neg")).alias("n"), "pos")
    rate = counts.groupBy(*keys).agg((F.sum("pos") / F.sum("n")).alias("rate"))
    summed = cumulated(counts, keys)
    at = summed.join(rate, keys) if keys else summed.crossJoin(F.broadcast(rate))
    cuts = linear_quantile(at, keys, 1 - F.col("rate"), ["rate"])
    threshold = F.when(F.col("rate") <= 0, F.lit(float("inf"))).when(F.col("rate") >= 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    found = cuts.select(*keys, threshold.alias("threshold"))
    if not keys:
        return found.select(F.coalesce("threshold", F.lit(default).cast("double")).alias("threshold"))
    return df.select(*keys).distinct().join(found, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(default).cast("double")))


def balanced_threshold(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """The distinct finite score with the best balanced accuracy of `score >= threshold`, with the best accuracy where
    there is one class only; the least of equals."""
    counts = by_score(df, keys, y, score)
    down, whole = Window.partitionBy(*keys).orderBy(F.desc("score")), Window.partitionBy(*keys)
    swept = counts.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(whole), "q": F.sum("neg").over(whole)})
    quiet = F.col("q") - F.col("fp")
    both = (F.col("p") > 0) & (F.col("q") > 0)
    value = F.when(both, (F.try_divide(F.col("tp"), F.col("p")) + F.try_divide(quiet, F.col("q"))) / 2).otherwise((F.col("tp") + quiet) / (F.col("p") + F.col("q")))
    best = swept.withColumn("b", F.round(value, 12)).groupBy(*keys).agg(F.max(F.struct(F.col("b"), (-F.col("score")).alias("m"))).alias("x"))
    return best.select(*keys, (-F.col("x.m")).alias("threshold"), F.col("x.b").alias("balanced_accuracy"))


def fpr_at_recall(df: DataFrame, keys: list[str], y: str, score: str, recalls: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """The share of negatives at or above the positives' (1 - recall) quantile, for each recall, from counts by score."""
    counts = by_score(df, keys, y, score)
    positives = cumulated(counts.where("pos > 0").select(*keys, "score", F.col("pos").alias("n")), keys)
    spread = positives.withColumn("recall", F.explode(F.array(*map(F.lit, recalls))))
    cuts = linear_quantile(spread, keys, 1 - F.col("recall"), ["recall"])
    # one row for each key with the few cuts: negatives are met once and not copied by recall
    few = cuts.groupBy(*keys).agg(F.collect_list(F.struct("recall", "value")).alias("cuts"))
    negatives = counts.where("neg > 0")
    joined = negatives.join(few, keys) if keys else negatives.crossJoin(F.broadcast(few))
    above = joined.select(*keys, "score", "neg", F.explode("cuts").alias("c"))
    return above.groupBy(*keys, F.col("c.recall").alias("recall")).agg((F.sum(F.when(F.col("score") >= F.col("c.value"), F.col("neg")).otherwise(0)) / F.sum("neg")).alias("fpr"))


def standardized_effects(long: DataFrame, keys: list[str], y: str, value: str, tiny: float = 1e-12) -> DataFrame:
    """Mean z of positives less mean z of negatives (population deviation); NULL where the deviation is tiny."""
    v = finite(F.col(value))
    sd = F.stddev_pop(v)
    effect = (F.avg(F.when(F.col(y) == 1, v)) - F.avg(F.when(F.col(y) == 0, v))) / F.when(sd > tiny, sd)
    return long.groupBy(*keys).agg(effect.alias("effect"))


def consistency(effects: DataFrame, feature: str, mean_weight: float = 0.35, spread_weight: float = 0.25) -> DataFrame:
    """Features by how large and alike their effects are over groups: score = least + .35 mean of the absolute effects
    - .25 deviation (population) of the signed ones. Missing effects don't count in these; a feature without any has no
    row, and one that misses some in the rows given has no common sign."""
    e = finite(F.col("effect"))
    rows = effects.groupBy(feature).agg(
        F.count(e).alias("groups"),
        (F.count(e) == F.count(F.lit(1))).alias("_all"),
        F.min(e).alias("_low"),
        F.max(e).alias("_high"),
        F.min(F.abs(e)).alias("least"),
        F.avg(F.abs(e)).alias("mean"),
        F.median(F.abs(e)).alias("median"),
        F.stddev_pop(e).alias("spread"),
    )
    sign = F.when(F.col("_all") & (F.col("_low") > 0), "positive").when(F.col("_all") & (F.col("_high") < 0), "negative").otherwise("mixed")
    score = F.col("least") + mean_weight * F.col("mean") - spread_weight * F.col("spread")
    scored = rows.where("groups > 0").withColumns({"direction": sign, "same_sign": sign != "mixed", "score": score}).drop("_all", "_low", "_high")
    # a row for each feature: a list of names, not data
    order = Window.orderBy(F.desc(F.round("score", 9)), F.desc(F.round("least", 9)), F.desc(F.round("mean", 9)), F.round("spread", 9), feature)
    return scored.withColumn("place", F.row_number().over(order))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, tiny: float = 1e-6) -> Column:
    """Cosine, within -1 and 1; NULL where a norm is tiny."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > tiny) & (nb > tiny), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The element-wise mean of each group's vectors, as rows (keys, at, mean): combined before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mass(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def shares(values: Column) -> Column:
    total = mass(values)
    return F.transform(values, lambda x: F.when(total > 0, x / total))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalized_entropy(values: Column) -> Column:
    """Entropy of the shares over the logarithm of their number, within 0 and 1; NULL without mass."""
    total = F.aggregate(shares(values), F.lit(0.0), lambda s, x: s - x * F.ln(F.greatest(x, F.lit(1e-6))))
    return F.when(mass(values) > 0, F.when(F.size(values) > 1, _unit(total / F.ln(F.size(values)))).otherwise(F.lit(0.0)))


def squares(values: Column) -> Column:
    return F.aggregate(shares(values), F.lit(0.0), lambda s, x: s + x * x)


def herfindahl(values: Column) -> Column:
    """Sum of squared shares, from 0 (even) to 1 (all in one); NULL without mass."""
    n = F.size(values)
    return F.when(mass(values) > 0, F.when(n > 1, _unit((squares(values) - 1 / n) / (1 - 1 / n))).otherwise(F.lit(1.0)))


def effective_support(values: Column) -> Column:
    """1 / (sum of squared shares), from 0 (all in one) to 1 (even); NULL without mass."""
    n = F.size(values)
    return F.when(mass(values) > 0, F.when(n > 1, _unit((1 / F.greatest(squares(values), F.lit(1e-6)) - 1) / (n - 1))).otherwise(F.lit(1.0)))


def top_mass(values: Column, k: int) -> Column:
    top = F.aggregate(F.slice(F.sort_array(shares(values), asc=False), 1, max(1, k)), F.lit(0.0), lambda s, x: s + x)
    return F.when(mass(values) > 0, _unit(top))


def per_token_mass(region: Column, width: Column) -> Column:
    """A region's mass over its width, within 0 and 1; NULL for a region of no width."""
    return F.when(width > 0, _unit(region / width))


def mass_ratio(part: Column, other: Column) -> Column:
    """The first of two masses over both, within 0 and 1; NULL without mass."""
    return F.when(part + other > 0, _unit(part / (part + other)))


def head_summary(values: Column) -> Column:
    """struct(mean, std, max) of the finite values of the heads; population deviation; NULLs where there are none."""
    some = F.filter(F.transform(values, finite), lambda x: x.isNotNull())
    n = F.nullif(F.size(some), F.lit(0))
    mean = mass(some) / n
    var = F.aggregate(some, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), F.array_max(some).alias("max"))


def mean_pairwise_cosine(vectors: Column) -> Column:
    """The mean cosine of all pairs of a short list of vectors."""
    at = F.sequence(F.lit(0), F.size(vectors) - 1)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: cosine(vectors[i], vectors[j]))))
    some = F.array_compact(pairs)
    return F.when(F.size(vectors) > 1, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(some), F.lit(0)))


def layer_bands(layers: Column) -> Column:
    """Mean, least, largest and population deviation of the early, middle and late third of a list of layer values; NULLs
    don't count.

    The first thirds are the longer ones where the number does not divide.
    """
    n = F.size(layers)
    base, more = F.floor(n / 3).cast("int"), (n % 3).cast("int")
    sizes = [base + F.when(more > i, 1).otherwise(0) for i in range(3)]
    starts = [F.lit(1), sizes[0] + 1, sizes[0] + sizes[1] + 1]

    def stats(band: Column) -> Column:
        xs = F.array_compact(band)
        k = F.nullif(F.size(xs), F.lit(0))
        m = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / k
        var = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / k
        return F.struct(m.alias("mean"), F.array_min(xs).alias("least"), F.array_max(xs).alias("most"), F.sqrt(var).alias("spread"))

    return F.array(*[stats(F.slice(layers, s, z)) for s, z in zip(starts, sizes, strict=True)])
