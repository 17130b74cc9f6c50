"""Joins of the pipeline. Sides are broadcast by Spark where their size is known to be small; nothing is hinted
that grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import last_per


def lookup(facts: DataFrame, build: DataFrame, key: str, order: str, columns: list[str], how: str = "inner") -> DataFrame:
    """Facts with columns of a build side of which the last row of each key counts."""
    return facts.join(last_per(build, [key], order, columns), key, how)


def coalesced(facts: DataFrame, sources: list[tuple[str, DataFrame, str]], key: str, out: str) -> DataFrame:
    """The first value found in several sources (name, table, column), and the name of that source."""
    for i, (_, table, column) in enumerate(sources):
        facts = facts.join(table.select(key, F.col(column).alias(f"_v{i}")), key, "left")
    value = F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])
    name = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, (n, _, _) in enumerate(sources)])
    return facts.withColumns({out: value, f"{out}_source": name}).drop(*[f"_v{i}" for i in range(len(sources))])


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that are not done yet: what a resumed run has to do."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def within(items: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(index.select(*keys).distinct(), keys, "left_semi")


def paired_by_place(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The i-th row of each key on the left with the i-th on the right, up to the shorter side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    number = lambda df, side: df.select(*keys, (F.row_number().over(w) - 1).alias("place"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return number(left, "left").join(number(right, "right"), [*keys, "place"])


def donors(targets: DataFrame, pool: DataFrame, group: str, order: list[str], k: int = 1) -> DataFrame:
    """For each target the first k of the pool, in order, that are not of its group.

    Of each group only its first k rows can answer, and of these only those of the k + 1 groups that begin best: at
    most one of them is a target's own. So no target meets the whole pool.
    """
    inside, ranked = Window.partitionBy(group).orderBy(*order), Window.partitionBy(*targets.columns).orderBy(*[f"donor_{o}" for o in order])
    firsts = pool.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k)
    lead = firsts.where("_r = 1").orderBy(*order).limit(k + 1).select(group)
    short = firsts.join(lead, group, "left_semi").select(*[F.col(c).alias(f"donor_{c}") for c in pool.columns])
    met = targets.join(F.broadcast(short), F.col(group) != F.col(f"donor_{group}"))  # short has at most k * (k + 1) rows
    return met.withColumn("donor_rank", F.row_number().over(ranked)).where(F.col("donor_rank") <= k)


def spans_of_points(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, keys: list[str], width: int) -> DataFrame:
    """Points and the spans [start, end) of the same keys that hold them: an equi-join on cells of `width`, then the exact
    condition, so a long key is not joined with itself. Each pair comes once: a span is in every cell it meets, a point
    in one."""
    celled = spans.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    held = points.withColumn("_cell", F.floor(F.col(at) / width))
    return held.join(celled, [*keys, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def near_equal(left: DataFrame, right: DataFrame, a: str, b: str, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """Rows whose numbers differ by less than eps: joined on rounded cells and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / (2 * eps)).cast("long")
    spread = right.withColumn("_cell", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    return left.withColumn("_cell", cell(a)).join(spread, [*keys, "_cell"]).where(F.abs(F.col(a) - F.col(b)) < eps).drop("_cell")


def branches(pairs: DataFrame, keys: list[str], columns: dict[str, str], name: str = "branch", value: str = "value") -> DataFrame:
    """A row for each branch of a pair."""
    return pairs.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.col(c).alias(value)) for n, c in columns.items()])).alias("b")).select(*keys, f"b.{name}", f"b.{value}")


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every combination of two short lists (layers, conditions)."""
    return left.crossJoin(F.broadcast(right))


def one_to_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing where a key stands in more than one row."""
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return counted.where(F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("key repeats:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")).otherwise(True)).drop("_n")
