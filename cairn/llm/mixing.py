"""Mixing sources to target weights by weighted fair queueing, in Spark SQL functions only.

Each source's documents stand in an order shuffled by md5. A document's virtual finish time is the words of
its source up to and with it, divided by the source's target. Copies of all sources are sorted by that time
over the whole table, and the mix ends where its words reach the total budget. A source that has to give more
than it holds begins again, in the same order, up to three times.

Prefix sums are taken by hash cell (within a source) and by time cell (over all), so no task holds a source
or the whole order: a small table of cell sums gives each cell its offset.

Nulls: a null text has no words; a null source is a source, the last. Repeated rows are queued one after the
other; ties of the shuffle are broken by doc_id and size; rows equal in these have places of their own, dealt among them.
Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, written

WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
#: Cells of a source: so many leading hex digits of the shuffle key. Cells of one unit of virtual time.
CELL_DIGITS, TIME_CELLS = 3, 65536
#: What orders copies: all of these differ from null.
ORDER = ["finish", "source_rank", "shuffle", "doc_key", "size", "epoch"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHT_CYCLE, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_rank, source_size, target: the budget (all sizes) by weight, no target above `most` times its source.

    In order of cap / weight, the first k sources are held at their caps, with the least k at which the level
    of the others, (budget - caps held) / weights left, is within the next source's cap. One row a source:
    the windows over it hold as many rows as there are sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("source_rank", rank)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ratio = (F.col("source_size") * most).cast("double") / F.col("w")
    weighted = ranked.withColumn("w", w).withColumn("ratio", ratio).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    earlier = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0))
    levelled = weighted.withColumn("level", left.cast("double") / w_left)
    fits = F.col("level") <= F.col("ratio")
    level = F.min(F.when(fits, F.struct("ratio", "source_rank", "level"))).over(everything)["level"]
    return levelled.select("source", "source_rank", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def queued(sized: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size of every row; source_size, target; `upto`: the words of its source up to and with it."""
    # the size tells rows of one doc_id, null above all, apart: one id may stand in very many rows
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")))
    keyed = sized.withColumn("shuffle", shuffle).withColumn("doc_key", F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")))
    keyed = keyed.withColumn("cell", F.substring("shuffle", 1, CELL_DIGITS))
    sources = source_targets(sized).select(F.col("source").alias("s"), "source_rank", "source_size", "target")
    keyed = keyed.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = keyed.groupBy("source_rank", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("source_rank", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("source_rank", "cell").orderBy("shuffle", "doc_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("within", F.sum("size").over(here))
    return summed.join(offsets, ["source_rank", "cell"]).withColumn("upto", F.col("before") + F.col("within")).drop("cell", "before", "within")


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def _epochs(most: int) -> Column:
    """How often a document may come before its source passes its target, and once more."""
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")).cast("int") + 2)).otherwise(0)


def cut_point(placed: DataFrame, most: int = MAX_EPOCHS) -> DataFrame:
    """One row: the place, in order of finish time, of the last copy with which the words are within the budget.

    slice: the last time cell of which anything is taken; at: the last copy in it, null if the cell is taken whole.
    """
    spread = placed.withColumn("epoch", F.explode(F.slice(F.array(*map(F.lit, range(most))), F.lit(1), _epochs(most))))
    # at time t each source lacks at most one document of its t targets, and these documents together at most the budget:
    # by time 2 the budget is reached, whatever the sources, so there are 2 * TIME_CELLS cells at most
    timed = spread.withColumn("finish", _finish(F.col("epoch"))).where("finish <= 2").withColumn("slice", F.floor(F.col("finish") * TIME_CELLS).cast("long"))
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each time cell in use
    cells = timed.groupBy("slice").agg(F.sum("size").alias("words")).select("slice", "words", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("before"))
    cells = cells.crossJoin(F.broadcast(budget)).where(F.col("before") < F.col("budget"))
    whole = cells.where(F.col("before") + F.col("words") <= F.col("budget")).agg(F.max("slice").alias("whole"))
    cut = cells.where(F.col("before") + F.col("words") > F.col("budget")).select("slice", "before", "budget")
    inner = Window.partitionBy("slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = timed.join(F.broadcast(cut), "slice").withColumn("run", F.col("before") + F.sum("size").over(inner)).where(F.col("run") <= F.col("budget"))
    at = inside.agg(F.max("slice").alias("part"), F.max(F.struct(*ORDER)).alias("at"))
    return whole.crossJoin(at).select(F.coalesce("part", "whole", F.lit(-1)).alias("cut_slice"), "at")


def taken_epochs(placed: DataFrame, most: int = MAX_EPOCHS) -> DataFrame:
    """Adds `epochs`: the array of epochs in which the row is within the budget."""
    cut = cut_point(placed, most)

    def within(e: Column) -> Column:
        cell = F.floor(_finish(e) * TIME_CELLS).cast("long")
        place = F.struct(_finish(e).alias("finish"), *[F.col(c) for c in ORDER[1:-1]], e.alias("epoch"))
        return (cell < F.col("cut_slice")) | ((cell == F.col("cut_slice")) & (F.col("at").isNull() | (place <= F.col("at"))))

    every = F.slice(F.array(*map(F.lit, range(most))), F.lit(1), _epochs(most))
    return placed.crossJoin(F.broadcast(cut)).withColumn("epochs", F.filter(every, within)).drop("cut_slice", "at")


def plan_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Every row's doc_id, source, size, source_size, target, upto, and the epochs in which the mix takes it."""
    # counting words reads all text; what follows reads these few columns several times
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    return taken_epochs(written(queued(sized, seed), "mix-queue"))


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: for each row the words that the mix takes of it, repeats counted."""
    return plan_mix(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("epochs")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs with all their columns, as often as taken, sorted by virtual finish time."""
    names = {k: fresh(docs.columns, k) for k in ("mix_key", "mix_rank", "mix_fates", "mix_finish", "mix_id")}
    key = lambda i, s, size: F.struct(i.alias("id"), s.alias("source"), size.alias("size")).alias(names["mix_key"])
    plan = plan_mix(docs, seed)
    # rows equal in these three have fates of their own: the k-th of them has the k-th fate
    fates = plan.groupBy(key(F.col("doc_id"), F.col("source"), F.col("size"))).agg(
        F.array_sort(F.collect_list(F.transform("epochs", lambda e: _finish(e)))).alias(names["mix_fates"])
    )
    keyed = docs.select("*", key(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text"))))
    ranks = Window.partitionBy(names["mix_key"]).orderBy(F.xxhash64("text"))
    ranked = keyed.withColumn(names["mix_rank"], F.row_number().over(ranks))
    finish = F.explode(F.element_at(F.col(names["mix_fates"]), F.col(names["mix_rank"])))
    taken = ranked.join(fates, names["mix_key"]).withColumn(names["mix_finish"], finish).withColumn(names["mix_id"], F.col(names["mix_key"])["id"])
    return taken.orderBy(names["mix_finish"], names["mix_id"]).select(*docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sized GROUP BY source),
weighted AS (SELECT *, source_rank % 3 + 1 AS w, CAST(source_size * 3 AS DOUBLE) / (source_rank % 3 + 1) AS ratio, source_size * 3 AS cap FROM totals),
levelled AS (
  SELECT *, CAST(SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (SUM(w) OVER () - COALESCE(SUM(w) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighted),
chosen AS (SELECT level AS found FROM levelled WHERE level <= ratio ORDER BY ratio, source_rank LIMIT 1),
targets AS (SELECT source, source_rank, source_size, LEAST(CAST(cap AS DOUBLE), COALESCE((SELECT found FROM chosen) * w, CAST(cap AS DOUBLE))) AS target FROM weighted),
queued AS (
  SELECT d.doc_id, d.size, t.source_rank, t.source_size, t.target, md5('7:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.size) AS shuffle,
    SUM(d.size) OVER (PARTITION BY t.source_rank ORDER BY md5('7:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.size), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e.epoch, CAST(e.epoch * q.source_size + q.upto AS DOUBLE) / q.target AS finish
  FROM queued q, (VALUES (0), (1), (2)) e(epoch) WHERE q.size > 0 AND q.target > 0 AND e.epoch < FLOOR(q.target / q.source_size) + 2),
run AS (SELECT doc_id, size, SUM(size) OVER (ORDER BY finish, source_rank, shuffle, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS running FROM copies),
got AS (SELECT doc_id, CAST(SUM(size) AS BIGINT) AS taken FROM run WHERE running <= (SELECT SUM(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(g.taken, 0) AS taken FROM queued q LEFT JOIN got g ON q.doc_id = g.doc_id
"""
