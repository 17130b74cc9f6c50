"""Transfer models on Spark ML: features fitted on the training part only, metrics from this package.

Spark ML has no liblinear, XGBoost or randomized PCA: logistic regression (L-BFGS), gradient-boosted trees and exact
PCA stand in for them, which gives like, not equal, numbers.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, CountVectorizer, Imputer, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import any_of
from ..functions.intervals import finite
from .metrics import balanced_threshold, confusion, prevalence_threshold, ranking
from .select import first_per


def tfidf(train: DataFrame, apply_to: DataFrame, key: str, text: str, most_terms: int = 20_000) -> DataFrame:
    """key, term, weight of `apply_to`: 1- and 2-grams, 1 + ln(tf), smoothed idf of the training rows, length one.

    The vocabulary is the most frequent terms of the training rows; all is long tables and joins on terms.
    """
    words = lambda df: df.select(key, F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.col("w")[i - 1], F.try_element_at("w", i + 1)))
    grams = lambda df: words(df).select(key, F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    seen = grams(train)
    n = train.select(key).distinct().count()
    terms = seen.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(most_terms)
    idf = F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    weighted = grams(apply_to).join(terms, "term").withColumn("x", (1 + F.ln(F.col("tf"))) * idf)
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("x") / norm).alias("weight"))


def text_vectors(train: DataFrame, text: str, most_terms: int = 20_000) -> PipelineModel:
    """A fitted pipeline from text to counts of 1- and 2-grams, for estimators that take vectors."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern="\\W+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_one", vocabSize=most_terms),
        CountVectorizer(inputCol="_pairs", outputCol="_two", vocabSize=most_terms),
        VectorAssembler(inputCols=["_one", "_two"], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


def reduced(train: DataFrame, columns: list[str], k: int) -> PipelineModel:
    """Median imputing, standardising and PCA, fitted on the training rows."""
    filled = [f"_{c}" for c in columns]
    stages = [
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        PCA(k=k, inputCol="_scaled", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


def fitted(train: DataFrame, label: str, family: str = "logreg", features: str = "features", seed: int = 0, **parameters):
    """A classifier with classes weighted to balance."""
    counts = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.5
    weight = F.when(F.col(label) == 1, 0.5 / max(counts, 1e-9)).otherwise(0.5 / max(1 - counts, 1e-9))
    rows = train.withColumn("_weight", weight).withColumn(label, F.col(label).cast("double"))
    if family == "logreg":
        return LogisticRegression(featuresCol=features, labelCol=label, weightCol="_weight", **parameters).fit(rows)
    return GBTClassifier(featuresCol=features, labelCol=label, weightCol="_weight", seed=seed, **parameters).fit(rows)


def scored(model, rows: DataFrame, score: str = "score") -> DataFrame:
    out = model.transform(rows).withColumn(score, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def weights(model, names: list[str]) -> list[tuple[str, float]]:
    """Features by absolute coefficient or importance."""
    values = model.coefficients.toArray() if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(names, values.tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def transfer_plan(envs: list[str], protocol: str) -> list[tuple[list[str], str]]:
    """(train environments, test environment): one_out trains on all others, single_source on one other."""
    if protocol == "one_out":
        return [([e for e in envs if e != t], t) for t in envs]
    if protocol == "single_source":
        return [([s], t) for s in envs for t in envs if s != t]
    raise ValueError(f"unknown protocol: {protocol}")


def transfer(rows: DataFrame, env: str, label: str, columns: list[str], envs: list[str], protocol: str = "one_out", family: str = "logreg", **parameters) -> DataFrame:
    """train, test, n, positive_rate, auroc, average_precision of each part of the plan."""
    out = None
    for sources, target in transfer_plan(envs, protocol):
        train, test = rows.where(F.col(env).isin(sources)), rows.where(F.col(env) == target)
        assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
        model = fitted(assemble.transform(train), label, family, **parameters)
        table = ranking(scored(model, assemble.transform(test)).withColumn("k", F.lit(1)), ["k"], label, "score").drop("k")
        table = table.select(F.lit("+".join(sources)).alias("train"), F.lit(target).alias("test"), "*")
        out = table if out is None else out.unionByName(table)
    return out


def evaluate_features(rows: DataFrame, env: str, label: str, columns: list[str], envs: list[str], mode: str = "fixed", threshold: float = 0.5, family: str = "logreg", **parameters) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    """For each environment a classifier on its rows, judged on these and on every other's: train, test, role, threshold
    and its metrics; and (train, feature, weight) of each. mode: `fixed`, `train_prevalence_match` or
    `train_balanced_accuracy`, by the scores of the training rows."""
    out, learned = None, []
    for source in envs:
        assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
        train = assemble.transform(rows.where(F.col(env) == source))
        model = fitted(train, label, family, **parameters)
        learned += [(source, f, w) for f, w in weights(model, columns)]
        made = scored(model, assemble.transform(rows.where(F.col(env).isin(envs)))).select(F.col(env).alias("test"), label, "score")
        at = decision_threshold(made.where(F.col("test") == source), label, "score", mode, threshold)
        cut = F.col("score") >= F.lit(at)
        table = ranking(made, ["test"], label, "score").join(confusion(made, ["test"], label, cut), "test")
        role = F.when(F.col("test") == source, "train").otherwise("ood")
        table = table.select(F.lit(source).alias("train"), "test", role.alias("role"), F.lit(at).alias("threshold"), *[c for c in table.columns if c != "test"])
        out = table if out is None else out.unionByName(table)
    return out, learned


def decision_threshold(scores: DataFrame, label: str, score: str, mode: str, default: float) -> float:
    if mode == "fixed":
        return float(default)
    if mode == "train_prevalence_match":
        return float(prevalence_threshold(scores, [], label, score, default).first()["threshold"])
    if mode == "train_balanced_accuracy":
        best = balanced_threshold(scores, [], label, score).first()
        return float(best["threshold"]) if best and best["threshold"] is not None else float(default)
    raise ValueError(f"unknown mode: {mode}")


def transfer_summary(table: DataFrame) -> DataFrame:
    """Mean, least and deviation of the metrics over other environments, and their mean at home, of a table of
    `evaluate_features`; NULL and NaN don't count."""
    out = []
    for m in ("auroc", "average_precision", "balanced_accuracy"):
        v = F.when(F.col("role") == "ood", finite(F.col(m)))
        out += [F.avg(v).alias(f"mean_ood_{m}"), F.min(v).alias(f"min_ood_{m}"), F.stddev_pop(v).alias(f"std_ood_{m}"), F.avg(F.when(F.col("role") == "train", finite(F.col(m)))).alias(f"mean_train_{m}")]
    return table.agg(*out)


def shared_vocabulary(names: DataFrame, env: str, feature: str, place: str, envs: list[str]) -> DataFrame:
    """feature, at, mode: the features of all environments in the order of the first one; if there are none, those of any,
    in the order of first sight. `at` counts from 0."""
    first = F.element_at(F.map_from_arrays(F.array(*map(F.lit, envs)), F.array(*[F.lit(i) for i in range(len(envs))])), F.col(env))
    known = names.where(F.col(env).isin(envs)).groupBy(feature).agg(F.count_distinct(env).alias("n"), F.min(F.struct(first.alias("e"), F.col(place).alias("p"))).alias("seen"))
    common = known.agg(F.coalesce(F.count_if(F.col("n") == len(envs)) > 0, F.lit(False)).alias("some"))
    kept = known.crossJoin(F.broadcast(common)).where(~F.col("some") | (F.col("n") == len(envs)))
    # a vocabulary: a list of names, not data
    return kept.select(feature, (F.row_number().over(Window.orderBy("seen")) - 1).alias("at"), F.when(F.col("some"), "intersection").otherwise("union_fallback").alias("mode"))


def aligned_rows(weights_: DataFrame, key: str, feature: str, weight: str, vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, indices, values of the wanted keys: their rows over the shared vocabulary; unknown features are left out, and
    keys without any have empty rows."""
    placed = weights_.join(vocabulary.select(feature, "at"), feature)
    entry = F.array_sort(F.collect_list(F.struct("at", F.col(weight).alias("w"))))
    rows = placed.groupBy(key).agg(entry.alias("_e"))
    return wanted.select(key).join(rows, key, "left").select(key, F.coalesce(F.col("_e.at"), F.array().cast("array<int>")).alias("indices"), F.coalesce(F.col("_e.w"), F.array().cast("array<double>")).alias("values"))


#: Objectives: which of a candidate's numbers decide, the most important first; then few features, then a simple model.
OBJECTIVES = {
    "mean_ood_auroc_oracle": ["oracle_mean_ood_auroc", "oracle_mean_ood_average_precision", "source_val_auroc", "source_val_average_precision"],
    "source_val_auroc": ["source_val_auroc", "source_val_average_precision", "source_val_balanced_accuracy"],
}


def best_candidates(candidates: DataFrame, keys: list[str], objective: str, ties: list[str] = ()) -> DataFrame:
    """The best candidate of each key; a number that is not finite counts as the worst."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    order = [F.desc_nulls_last(f"_{i}") for i, _ in enumerate(OBJECTIVES[objective])]
    made = candidates.withColumns({f"_{i}": finite(F.col(c)) for i, c in enumerate(OBJECTIVES[objective])})
    best = first_per(made, keys, [*order, F.asc("feature_count"), F.asc("candidate_complexity"), *ties])
    return best.drop(*[f"_{i}" for i, _ in enumerate(order)])


def run_specs(envs: list[str], protocols: list[str]) -> list[dict]:
    """What is trained on what and judged on which: single_source_ood and holdout_env_ood."""
    out = []
    for protocol in protocols:
        if protocol == "single_source_ood":
            out += [{"scenario": protocol, "label": e, "sources": [e], "ood": [o for o in envs if o != e], "heldout": None} for e in envs]
        elif protocol == "holdout_env_ood":
            out += [{"scenario": protocol, "label": f"All except {e}", "sources": [o for o in envs if o != e], "ood": [e], "heldout": e} for e in envs]
        else:
            raise ValueError(f"unknown protocol: {protocol}")
    return out


def coefficient_summary(coefficients: DataFrame, ranking_: DataFrame, keys: list[str], feature: str = "feature", source: str = "train_env") -> DataFrame:
    """For each key and feature the mean, mean absolute and largest absolute coefficient and the number of sources, with the
    feature's columns of the ranking, whose first row for each feature (by its place) counts."""
    rows = coefficients.groupBy(*keys, feature).agg(
        F.avg("coefficient").alias("mean_coefficient"),
        F.avg(F.abs("coefficient")).alias("mean_abs_coefficient"),
        F.max(F.abs("coefficient")).alias("max_abs_coefficient"),
        F.count_distinct(source).alias("selected_in_sources"),
    )
    return rows.join(first_per(ranking_, [feature], ["place"]), feature, "left")


def best_of_panels(summaries: DataFrame, panels: DataFrame, keys: list[str], order: list[str] = ("mean_ood_auroc", "min_ood_auroc", "source_val_auroc"), ties: list[str] = ()) -> DataFrame:
    """For each row of the panels the best summary with the same keys; panels without any have no row."""
    made = panels.withColumn("_panel", F.monotonically_increasing_id()).join(summaries, keys)
    return first_per(made, ["_panel"], [*[F.desc_nulls_last(c) for c in order], *ties]).drop("_panel")


def nearest_dumps(selected: DataFrame, dumps: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """For each chosen (env, alpha, length) the first dump, by path, of that environment and length whose alpha is the same
    to the tolerance. Alphas meet by their rounded values and those beside."""
    step = 10 * tolerance
    cell = lambda c: F.floor(c / step).cast("long")
    asked = selected.withColumn("_cell", F.explode(F.array(*[cell(F.col("alpha")) + d for d in (-1, 0, 1)])))
    held = dumps.select("env", F.col("alpha").alias("_alpha"), "length", "path").withColumn("_cell", cell(F.col("_alpha")))
    met = asked.join(held, ["env", "length", "_cell"]).where(F.abs(F.col("alpha") - F.col("_alpha")) < tolerance)
    return met.groupBy("env", "alpha", "length").agg(F.min("path").alias("path"))


#: Families of features by prefix, names of token counts, and what a summary adds to a name.
CHANGE = ["delta_", "devrun_", "logratio_prev_", "slope3_", "min_gap_", "max_gap_"]
NORMALIZED = ["z_", "pct_"]
CONCENTRATION = ["entropy_", "top1_", "top5_", "top10_", "herfindahl_", "effective_support_"]
TOKEN_COUNTS = ["token_count", "context_token_count", "prompt_token_count", "raw_text_context_token_count", "available_token_count", "prior_all_token_count", "previous_sentence_token_count", "recent_token_count", "early_token_count"]
SUMMARY, BLOCK = "__(layer_\\w+)$", "_b(\\d+)$"


def feature_parts(name: Column) -> Column:
    """struct(root, summary) of a feature's name: a summary over layers, a block, or none."""
    layer, block = F.regexp_extract(name, SUMMARY, 1), F.regexp_extract(name, BLOCK, 1)
    root = F.when(layer != "", F.regexp_replace(name, SUMMARY, "")).otherwise(F.regexp_replace(name, BLOCK, ""))
    return F.struct(root.alias("root"), F.when(layer != "", layer).when(block != "", F.concat(F.lit("block_b"), block)).otherwise(F.lit("")).alias("summary"))


def feature_family(name: Column) -> Column:
    """The family of a feature, by the prefix or the name of its root."""
    root = feature_parts(name)["root"]
    begins = lambda *prefixes: any_of([F.startswith(root, F.lit(p)) for p in prefixes])
    out = F.when(begins(*CHANGE), "change").when(begins(*NORMALIZED), "normalized").when(begins("geom_"), "geometry").when(begins("dyn_"), "dynamics")
    out = out.when(F.endswith(root, F.lit("_token_count")) | root.isin(TOKEN_COUNTS), "token_count").when(root.isin("start_token", "end_token"), "token_position")
    out = out.when(begins("act_") | root.contains("_act_"), "activation").when(begins("g_"), "grounding")
    return out.when(begins(*CONCENTRATION), "concentration").otherwise("other")
