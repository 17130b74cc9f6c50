"""Smaller operators of the trace pipeline: vector slots, token spans, choices per group, ledgers, recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import first_per, random_key


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """With new columns that are computed once for each row, whatever uses them behind: the optimizer puts plain columns
    into each place that names them, which multiplies work inside lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def vector_variant(slots: Column, filled: Column, variant: str = "final") -> Column:
    """Of slots of vectors, newest first: the newest; its change from the one before; its change from the mean of the
    filled ones before. A change without anything before it is zero."""
    newest = slots[0]
    if variant == "final":
        return newest
    zero = F.transform(newest, lambda x: x * 0)
    if variant == "delta_last":
        return F.when(F.coalesce(F.try_element_at(filled, F.lit(2)), F.lit(False)), F.zip_with(newest, F.try_element_at(slots, F.lit(2)), lambda a, b: a - b)).otherwise(zero)
    if variant != "delta_mean":
        raise ValueError(f"unknown variant: {variant}")
    older = F.transform(F.filter(F.arrays_zip(F.slice(slots, 2, 100).alias("v"), F.slice(filled, 2, 100).alias("f")), lambda s: s["f"]), lambda s: s["v"])
    n = F.size(older)
    total = F.aggregate(older, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(n > 0, F.zip_with(newest, total, lambda a, t: a - t / n)).otherwise(zero)


def tokens_in_span(offsets: Column, start: Column, end: Column) -> Column:
    """Indices of tokens whose midpoint is in [start, end); else of those that overlap it. Offsets are structs (s, e)."""
    at = F.sequence(F.lit(0), F.greatest(F.size(offsets) - 1, F.lit(0)))
    middle = F.filter(at, lambda i: ((offsets[i]["s"] + offsets[i]["e"]) / 2 >= start) & ((offsets[i]["s"] + offsets[i]["e"]) / 2 < end) & (offsets[i]["e"] > offsets[i]["s"]))
    over = F.filter(at, lambda i: (offsets[i]["s"] < end) & (offsets[i]["e"] > start) & (offsets[i]["e"] != offsets[i]["s"]))
    return F.when(F.size(offsets) == 0, F.array().cast("array<int>")).otherwise(F.when(F.size(middle) > 0, middle).otherwise(over))


def tokens_before(offsets: Column, boundary: Column) -> Column:
    return F.size(F.filter(offsets, lambda o: o["e"] <= boundary))


def primary_choice(df: DataFrame, keys: list[str], order: list, deceptive: Column, valid: Column) -> DataFrame:
    """One row of each key: the first deceptive one, else the first valid one, else the first."""
    tier = F.when(valid & deceptive, 0).when(valid, 1).otherwise(2)
    return first_per(df.withColumn("_tier", tier), keys, ["_tier", *order]).drop("_tier")


def mixed_sample(df: DataFrame, keys: list[str], deceptive: str, identity: str, seed: int, most_deceptive: int = 2, total: int = 4) -> DataFrame:
    """Up to `most_deceptive` deceptive rows of each key, truthful ones up to `total`, and deceptive ones to fill up."""
    w = Window.partitionBy(*keys, deceptive).orderBy("_key", identity)
    ranked = df.withColumn("_key", random_key(seed, identity)).withColumn("_r", F.row_number().over(w))
    few = ranked.where(F.col("_r") <= total)
    tier = F.when(F.col(deceptive) & (F.col("_r") <= most_deceptive), 0).when(~F.col(deceptive), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_tier", "_r"))
    return few.withColumn("_tier", tier).withColumn("_p", place).where(F.col("_p") <= total).drop("_key", "_r", "_tier", "_p")


def until_quotas(df: DataFrame, label: str, order: str, targets: dict) -> DataFrame:
    """Rows in order up to the one with which every label has met its target; all rows if one never does.

    The place of each label's target row comes from a rank filter, so there is no running sum over the table.
    """
    w = Window.partitionBy(label).orderBy(order)
    wanted = F.coalesce(*[F.when(F.col(label) == k, F.lit(n)) for k, n in targets.items()])
    first = df.where(F.col(label).isin(list(targets))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(targets.values(), default=0))
    met = first.where(F.col("_n") == wanted)
    stop = met.agg(F.count("*").alias("_met"), F.max(order).alias("_stop"))
    return df.crossJoin(F.broadcast(stop)).where((F.col("_met") < len(targets)) | (F.col(order) <= F.col("_stop"))).drop("_met", "_stop")


def ledger(df: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """Running balance, its peak so far and the fall from it, for each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("balance", F.sum(amount).over(w))
    return out.withColumn("peak", F.max("balance").over(w)).withColumn("drawdown", F.col("peak") - F.col("balance"))


def seen_before(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The sorted set of a key's values in the rows before each row.

    A value is in it from the row after its first one: only first rows add anything to the running list.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    again = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) > 1
    marked = df.withColumn("_new", F.when(~again, F.col(value)))
    return marked.withColumn("seen", F.array_sort(F.collect_list("_new").over(w.rowsBetween(Window.unboundedPreceding, -1)))).drop("_new")


def answer_probability(tokens: Column, answers: dict[str, list[str]]) -> Column:
    """From an array of structs (token, logprob): the probability of each answer's tokens, scaled to sum to one."""

    def mass_of(words: list[str]) -> Column:
        kept = F.filter(tokens, lambda t: F.lower(F.trim(t["token"])).isin(words))
        return F.aggregate(kept, F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))

    mass = {a: mass_of(words) for a, words in answers.items()}
    total = sum(mass.values())
    return F.struct(*[F.when(total > 0, m / total).alias(a) for a, m in mass.items()])


def option_id(raw: Column, ids: Column) -> Column:
    """An option's id from an id in any case, a place from 1, "Option N", or text that names exactly one id."""
    text = F.lower(F.trim(raw))
    same = F.filter(ids, lambda i: F.lower(i) == text)
    number = F.regexp_extract(text, "^(?:option\\s*)?(\\d+)$", 1).try_cast("int")
    named = F.filter(ids, lambda i: text.contains(F.lower(i)))
    return F.coalesce(F.try_element_at(same, F.lit(1)), F.when((number >= 1) & (number <= F.size(ids)), F.try_element_at(ids, F.greatest(number, F.lit(1)))), F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1))))


def spaced(n: int, k: int) -> list[int]:
    """k places evenly from 0 to n - 1, rounded half to even, each once."""
    if n < 1 or k < 1:
        return []
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]


def matched_controls(df: DataFrame, chosen: Column, stratum: str, identity: str, seed: int) -> DataFrame:
    """As many rows of each stratum as are chosen there, at random from those that are not."""
    counts = df.where(chosen).groupBy(stratum).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(stratum).orderBy("_key", identity)
    others = df.where(~chosen).withColumn("_key", random_key(seed, identity)).withColumn("_r", F.row_number().over(w))
    return others.join(counts, stratum).where(F.col("_r") <= F.col("_k")).drop("_key", "_r", "_k")


def score_table(df: DataFrame, cells: list[str], y: str, scores: list[str]) -> DataFrame:
    """For each score column its AUROC over all rows, and the mean of the cells' AUROCs."""
    from .metrics import ranking

    long = df.select(*cells, y, F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("v")) for s in scores])).alias("s")).select(*cells, y, "s.*")
    pooled = ranking(long, ["score_name"], y, "v").select("score_name", F.col("auroc").alias("pooled"))
    macro = ranking(long, ["score_name", *cells], y, "v").groupBy("score_name").agg(F.avg("auroc").alias("macro"))
    return pooled.join(macro, "score_name")


def vector_faults(df: DataFrame, vector: str, length: int) -> DataFrame:
    """How many vectors are missing, of another length, not finite, or zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.agg(
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(F.size(v) != length).alias("wrong_length"),
        F.count_if(~finite).alias("not_finite"),
        F.count_if(finite & ~F.exists(v, lambda x: x != 0)).alias("zero"),
        F.count("*").alias("n"),
    )


def worked_examples(df: DataFrame, keys: tuple[str, str], identity: str, kinds: dict[str, tuple[Column, Column]]) -> list:
    """One row for each kind (predicate, score): the best of a new cell and model, else of a new cell, else of any."""
    out, cells, models = [], set(), set()
    cell, model = keys
    for name, (test, score) in kinds.items():
        pool = df.where(test).withColumn("_s", score)
        tiers = [pool.where(~F.concat_ws("|", cell, model).isin([f"{a}|{b}" for a, b in cells] or [""]) & ~F.col(model).isin(list(models) or [""])), pool.where(~F.concat_ws("|", cell, model).isin([f"{a}|{b}" for a, b in cells] or [""])), pool]
        best = next((r for r in (t.orderBy(F.desc("_s"), identity).first() for t in tiers) if r), None)
        if best:
            out.append((name, best[identity], best["_s"]))
            cells.add((best[cell], best[model]))
            models.add(best[model])
    return out
