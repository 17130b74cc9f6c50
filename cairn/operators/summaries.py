"""Summaries of outcome counts: pooled and macro rates, pivots, grouping sets, paired arms, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import bracket, finite, rate, wilson


def outcome_counts(samples: DataFrame, keys: list[str], valid: Column, deceptive: Column) -> DataFrame:
    """n, valid, deceptive, rate and its interval for each group; null keys are a group."""
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_if(valid & deceptive).alias("deceptive"))
    low, high = wilson(F.col("deceptive"), F.col("valid"))
    return out.withColumns({"rate": rate(F.col("deceptive"), F.col("valid")), "low": low, "high": high})


def pooled_and_macro(counts: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """From counts by keys and unit: the pooled rate, and mean and sample deviation of the units' rates."""
    units = counts.groupBy(*keys, unit).agg(F.sum("valid").alias("valid"), F.sum("deceptive").alias("deceptive"))
    own = rate(F.col("deceptive"), F.col("valid"))
    out = units.groupBy(*keys).agg(F.count("*").alias("units"), F.sum("valid").alias("valid"), F.sum("deceptive").alias("deceptive"), F.avg(own).alias("macro"), F.stddev_samp(own).alias("spread"))
    return out.withColumn("pooled", rate(F.col("deceptive"), F.col("valid")))


def pivoted(rows: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One column for each of the known values: a single aggregate, with no scan to find them."""
    return rows.groupBy(*keys).pivot(column, values).agg(F.first(value))


def cells(rows: DataFrame, dims: list[str], aggregates: list[Column]) -> DataFrame:
    """The same measures overall, by each dimension and by all of them, in one pass; `all` stands for a dimension left out."""
    sets = [[], *[[d] for d in dims], dims]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(*aggregates, *[F.grouping(d).alias(f"_{d}") for d in dims])
    return out.withColumns({d: F.when(F.col(f"_{d}") == 1, F.lit("all")).otherwise(F.col(d).cast("string")) for d in dims}).drop(*[f"_{d}" for d in dims])


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def majority(labels: Column) -> Column:
    """Whether more than half of an array of labels, NULLs apart, is true."""
    known = F.array_compact(labels)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0), lambda s, x: s + x.cast("int")) * 2 > F.size(known))


def unanimous(rows: DataFrame, keys: list[str], label: str, least: int = 20) -> DataFrame:
    """Keys whose labels all agree, with the label, their number, and whether they are common enough for a vocabulary."""
    seen = rows.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.min(label).alias("label"), F.max(label).alias("other"), F.count("*").alias("n"))
    return seen.where("label = other").select(*keys, "label", "n", (F.col("n") >= least).alias("in_vocabulary"))


def paired_arms(counts: DataFrame, keys: list[str], unit: str, arm: str, arms: tuple[str, str]) -> DataFrame:
    """Both arms of each unit side by side, units with both only."""
    side = lambda a: counts.where(F.col(arm) == a).groupBy(*keys, unit).agg(F.sum("valid").alias(f"valid_{a}"), F.sum("deceptive").alias(f"deceptive_{a}"))
    return side(arms[0]).join(side(arms[1]), [*keys, unit])


def paired_effect(pairs: DataFrame, keys: list[str], arms: tuple[str, str]) -> DataFrame:
    """Pooled rates of both arms and their difference (ratio of sums)."""
    a, b = arms
    total = pairs.groupBy(*keys).agg(F.count("*").alias("units"), *[F.sum(c).alias(c) for x in arms for c in (f"valid_{x}", f"deceptive_{x}")])
    ra, rb = (rate(F.col(f"deceptive_{x}"), F.col(f"valid_{x}")) for x in arms)
    return total.withColumns({f"rate_{a}": ra, f"rate_{b}": rb, "effect": rb - ra})


def bootstrap_interval(rows: list[tuple[float, float, float, float]], draws: int = 2000, seed: int = 0) -> tuple[float | None, float | None]:
    """2.5 % and 97.5 % order statistics of the difference of ratios of sums over units drawn with replacement.

    A draw is how often each unit is taken: multinomial counts, a few draws at once whatever the number of units.
    """
    if len(rows) < 2:
        return None, None
    rng, out, x = np.random.default_rng(seed), [], np.array(rows, float)
    n = len(x)
    step = max(1, min(draws, 2_000_000 // n))
    for lo in range(0, draws, step):
        times = rng.multinomial(n, np.full(n, 1 / n), size=min(step, draws - lo))
        v0, d0, v1, d1 = (times @ x).T
        both = (v0 != 0) & (v1 != 0)
        out.append(d1[both] / v1[both] - d0[both] / v0[both])
    made = np.sort(np.concatenate(out))
    if len(made) < 100:
        return None, None
    return float(made[int(0.025 * len(made))]), float(made[int(0.975 * len(made))])


def paired_bootstrap(pairs: DataFrame, key: str, unit: str, arms: tuple[str, str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """key, low, high: the paired bootstrap over the units of each run (tens to hundreds), in order of unit."""
    names = [f"{c}_{a}" for a in arms for c in ("valid", "deceptive")]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(unit)[names].astype(float).itertuples(index=False, name=None)
        low, high = bootstrap_interval(list(ordered), draws, seed)
        return pd.DataFrame({key: [rows[key].iloc[0]], "low": [low], "high": [high]}).astype({"low": "float64", "high": "float64"})

    kind = dict(pairs.dtypes)[key]
    return pairs.groupBy(key).applyInPandas(one, f"{key} {kind}, low double, high double")


def bootstrap_means(rows: DataFrame, key: str, unit: str, metrics: list[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """key, metric, mean, low, high: means over units drawn with replacement, linear quantiles; NULLs don't count."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(unit)[metrics].to_numpy(dtype=float)
        at = np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))
        with np.errstate(all="ignore"):
            means = np.stack([np.nanmean(x[i], axis=0) if len(i) else np.full(len(metrics), np.nan) for i in at])
            return pd.DataFrame({key: frame[key].iloc[0], "metric": metrics, "mean": np.nanmean(x, axis=0), "low": np.nanquantile(means, 0.025, axis=0), "high": np.nanquantile(means, 0.975, axis=0)})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(one, f"{key} {kind}, metric string, mean double, low double, high double")


def islands(rows: DataFrame, keys: list[str], order: str, speaker: str, text: str, between: str = "\n") -> DataFrame:
    """Adjacent rows of one speaker as one, their texts joined in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), between)
    return marked.groupBy(*keys, "island", speaker).agg(F.min(order).alias("first_at"), F.count("*").alias("turns"), said.alias(text))


def last_turns(islands_: DataFrame, keys: list[str], speaker: str, text: str, n: int = 10) -> DataFrame:
    """The last n islands of each key as one text."""
    w = Window.partitionBy(*keys).orderBy(F.desc("island"))
    kept = islands_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("island", speaker, text))), lambda t: F.concat_ws(": ", t[speaker], t[text]))
    return kept.groupBy(*keys).agg(F.array_join(lines, "\n").alias("block"))



#: Kinds of patches, in the order of plots, and their layer groups.
PLOT_MODES, PLOT_GROUPS = ["Residual", "K/V", "Residual + K/V"], ["Early", "Mid", "Late"]


def plot_rates(rows: DataFrame, label: str = "patch_label", rate_: str = "deception_rate", low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """Rows with a label, a rate and its interval, the interval made to hold the rate, all within 0 and 1, and `place`:
    layer groups by kind, then single layers by kind and number, then the rest."""
    kept = rows.where(F.col(label).isNotNull()).withColumns({c: finite(F.col(c)) for c in (rate_, low, high)}).dropna(subset=[rate_, low, high])
    r, lo, hi = bracket(F.col(rate_), F.col(low), F.col(high))
    named = F.lit(None).cast("int")
    for i, (m, g) in enumerate((m, g) for m in PLOT_MODES for g in PLOT_GROUPS):
        named = F.coalesce(named, F.when(F.col(label) == f"{m} | {g}", F.lit(i)))
    layer = F.regexp_extract(label, "^(Residual|K/V|Residual \\+ K/V) \\| Layer (\\d+)$", 2).try_cast("int")
    mode = F.array_position(F.array(*map(F.lit, PLOT_MODES)), F.regexp_extract(label, "^(.*) \\| ", 1)).cast("int")
    place = F.struct(F.when(named.isNotNull(), 0).when(layer.isNotNull(), 1).otherwise(2).alias("kind"), F.coalesce(named, mode).alias("mode"), F.coalesce(layer, F.lit(0)).alias("layer"))
    return kept.withColumns({rate_: r, low: lo, high: hi, "place": place})


def rated_rows(rows: DataFrame, rate_: str, least: float) -> DataFrame:
    """Rows with a finite rate of at least `least`; all rows if that is not above 0."""
    return rows.where(finite(F.col(rate_)) >= least) if least > 0 else rows


ARMS = ["none", "truth_steering", "deception_steering"]


def validation_settings(rows: DataFrame, keys: list[str], condition: str = "condition_name", rate_: str = "mean_counterfactual_deception_rate", invalid: str = "mean_invalid_rate") -> DataFrame:
    """One row a setting of the validation phase: rates and invalid shares of the three arms, what each steering does, the
    gap between them, and the largest invalid share."""
    wide = rows.where("phase = 'validation'").groupBy(*keys).pivot(condition, ARMS).agg(F.first(rate_).alias("rate"), F.first(invalid).alias("invalid"))
    at = lambda arm, what: F.col(f"{arm}_{what}")
    return wide.withColumns(
        {
            "truth_effect": at("none", "rate") - at("truth_steering", "rate"),
            "deception_effect": at("deception_steering", "rate") - at("none", "rate"),
            "bidirectional_gap": at("deception_steering", "rate") - at("truth_steering", "rate"),
            "max_invalid_rate": F.greatest(*[at(a, "invalid") for a in ARMS]),
        }
    )
