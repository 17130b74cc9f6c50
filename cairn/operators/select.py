"""Selection: first rows, label balance, quotas, splits, shards, top-k, sampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared


def first_per(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each key. The rank filter is pushed below the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def last_per(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate: duplicates of a build side, of which the last wins."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")


def balance_split(mixed: int, fixed_true: int, fixed_false: int, target_true: int | None = None, target_false: int | None = None) -> int:
    """How many of the ids with both labels go to true.

    Without targets: the most even totals, then nearest to half of the mixed ids. With targets: as much of them as can be
    covered, then even cover, then even totals. Of equals the least. Every measure is linear between few points, so the
    best is at one of them or beside it.
    """
    targets = target_true is not None or target_false is not None

    def key(x: int) -> tuple:
        true, false = fixed_true + x, fixed_false + mixed - x
        if not targets:
            return -abs(true - false), min(true, false), -abs(x - mixed // 2)
        here, there = (min(n, t) if t is not None else n for n, t in ((true, target_true), (false, target_false)))
        return here + there, -abs(here - there), -abs(true - false)

    goal_true, goal_false = (n if n is not None else 0 for n in (target_true, target_false))
    turns = [0, mixed, mixed // 2, (mixed + fixed_false - fixed_true) // 2]  # the ends, the middle, even totals
    turns += [goal_true - fixed_true, fixed_false + mixed - goal_false]  # a target is met
    turns += [goal_false - fixed_true, fixed_false + mixed - goal_true]  # what is covered is even
    some = sorted({min(mixed, max(0, t + step)) for t in turns for step in (-1, 0, 1)})
    return max(some, key=lambda x: (key(x), -x))


def balanced_labels(df: DataFrame, key: str, label: str, order: list, **targets) -> DataFrame:
    """One row for each key: the first of its label; keys with both labels are assigned so that labels balance.

    Only the three counts reach the driver. Of the keys with both labels the first x, in the order in which keys are
    first seen, become true.
    """
    labelled = df.where(F.col(label).isNotNull())
    firsts = first_per(labelled, [key, label], order)
    kinds = firsts.groupBy(key).agg(F.bool_or(label).alias("has_true"), F.bool_and(label).alias("all_true"))
    kinds = kinds.select(key, F.when(F.col("all_true"), "true").when(~F.col("has_true"), "false").otherwise("mixed").alias("kind"))
    counts = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    x = balance_split(counts.get("mixed", 0), counts.get("true", 0), counts.get("false", 0), **targets)
    seen = first_per(df.join(kinds.where("kind = 'mixed'").select(key), key, "left_semi"), [key], order)
    mixed = placed(seen, order, "_seen").select(key, (F.col("_seen") < x).alias("want"))
    chosen = kinds.where("kind <> 'mixed'").select(key, (F.col("kind") == "true").alias("want")).unionByName(mixed)
    return firsts.join(chosen, key).where(F.col(label) == F.col("want")).drop("want")


def dedup_statistics(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row: rows dropped as duplicates of a key, keys with several rows, and keys with both labels."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(F.col("labels") > 1).alias("conflicting_groups"))


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """With the place of each row, from 0, in one order of the whole table, whatever its size: rows are range-partitioned
    and sorted, numbered within their partition, and partitions offset by the sizes of those before them."""
    part, at = f"{name}_part", f"{name}_at"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered_ = sorted_.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = shared.kept(numbered_, "placed")  # ranges are sampled: written once, so that sizes and rows agree
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select(part, before.alias("_before"))), part).withColumn(name, F.col("_before") + F.col(at)).drop(part, at, "_before")


def numbered(*order) -> Column:
    """Place of each row, from 0, in one order of the whole table: for catalogues and lists of keys, in one task."""
    return F.row_number().over(Window.orderBy(*order)) - 1


def quota(df: DataFrame, label: str, order: list, per_label: dict, total: int | None = None) -> DataFrame:
    """Up to a quota of rows for each label, in order; nothing behind the row that meets the last quota, nor `total` rows.

    The largest quota is a plain limit on ranks, which Spark applies before the shuffle too.
    """
    w = Window.partitionBy(label).orderBy(*order)
    limit = F.coalesce(*[F.when(F.col(label) == k, F.lit(n)) for k, n in per_label.items()])
    most = df.where(F.col(label).isin(list(per_label))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(per_label.values(), default=0))
    kept = most.where(F.col("_n") <= limit).drop("_n")
    return kept.orderBy(*order).limit(total) if total is not None else kept


def fill_splits(groups: DataFrame, size: str, order: list, targets: list[tuple[str, int]], rest: str = "unused") -> DataFrame:
    """Whole groups into splits: in order, each split takes groups until it holds its target.

    `groups` has a row for each group, not for each member. A split's last group may pass its target, and the next
    split begins behind it, so the bounds are found one after the other.
    """
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_before", F.coalesce(F.sum(size).over(running), F.lit(0)))
    bound, split, start = F.lit(None).cast("string"), None, F.lit(0)
    whole = Window.partitionBy()
    for name, target in targets:
        here = (F.col("_before") >= start) & (F.col("_before") < start + target)
        split = F.when(here, name) if split is None else split.when(here, name)
        placed = placed.withColumn(f"_end_{name}", F.max(F.when(here, F.col("_before") + F.col(size))).over(whole))
        start = F.coalesce(F.col(f"_end_{name}"), start)
    out = placed.withColumn("split", split.otherwise(F.lit(rest)) if split is not None else bound)
    return out.drop("_before", *[f"_end_{n}" for n, _ in targets])


def shard(df: DataFrame, order: list, shard_id: int, shards: int) -> DataFrame:
    """Rows whose place in the order is shard_id modulo shards (a file list or a job list)."""
    return df.withColumn("_place", numbered(*order)).where(F.pmod(F.col("_place"), F.lit(shards)) == shard_id).drop("_place")


def batches(df: DataFrame, order: list, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(numbered(*order) / size).cast("int"))


def random_key(seed: int, *columns) -> Column:
    """A shuffle key that depends on the row's columns and the seed alone, on any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_per(df: DataFrame, keys: list[str], k: int, seed: int, *identity: str) -> DataFrame:
    """k rows of each key, by hash: the same ones on every run."""
    return first_per(df.withColumn("_key", random_key(seed, *identity)), keys, ["_key", *identity], k).drop("_key")


def resampled(df: DataFrame, order: list, count: int, seed: int) -> DataFrame:
    """Exactly `count` rows drawn with replacement, with new ids: a join on drawn places (for lists of pairs)."""
    import numpy as np

    n = df.count()
    if not n or not count:
        return df.limit(0).withColumn("resample_id", F.lit(None).cast("int"))
    draws = np.random.default_rng(seed).integers(0, n, count)
    drawn = df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(draws)], "_place int, resample_id int")
    return df.withColumn("_place", numbered(*order)).join(drawn, "_place").drop("_place")


def best_with_fallback(df: DataFrame, k: str, gain: str, least: float, tolerance: float) -> DataFrame:
    """The smallest k whose gain reaches `least`; else the first from which the next gains no more than `tolerance`; else the best."""
    w = Window.orderBy(k)
    ahead = df.withColumn("_more", F.lead(gain).over(w) - F.col(gain))
    return ahead.agg(
        F.coalesce(
            F.min(F.when(F.col(gain) >= least, F.col(k))),
            F.min(F.when(F.col("_more") <= tolerance, F.col(k))),
            F.max_by(k, F.struct(gain, -F.col(k))),
        ).alias("chosen")
    )


def donor_rank(words: Column, length: Column, wanted: int = 12) -> list:
    """Order of donors: words nearest to the wanted number, then the shortest."""
    return [F.abs(words - wanted).asc(), length.asc()]
