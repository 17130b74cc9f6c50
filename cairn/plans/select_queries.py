"""Selection, sets, splits, joins and ranking metrics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, intervals, text
from ..operators import curves, joins, metrics, select, summaries
from .registry import PROBES, micros, query, r6, rounded, table


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_first_per_label(spark, d):
    return select.first_per(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_LABELLED = "SELECT user_id AS id, event_type = 'error' AS label, event_id FROM events WHERE event_type IN ('error', 'click') AND user_id IS NOT NULL"


@query(
    f"""WITH e AS ({_LABELLED}), firsts AS (SELECT * FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY id, label ORDER BY event_id) = 1),
k AS (SELECT id, CASE WHEN bool_and(label) THEN 'true' WHEN NOT bool_or(label) THEN 'false' ELSE 'mixed' END AS kind FROM firsts GROUP BY id),
c AS (SELECT COUNT(*) FILTER (WHERE kind = 'mixed') AS m, COUNT(*) FILTER (WHERE kind = 'true') AS t, COUNT(*) FILTER (WHERE kind = 'false') AS f FROM k),
x AS (SELECT r.range AS x FROM c, range(0, 1000000) r WHERE r.range <= c.m ORDER BY abs((c.t + r.range) - (c.f + c.m - r.range)), -LEAST(c.t + r.range, c.f + c.m - r.range), abs(r.range - floor(c.m / 2)), r.range LIMIT 1),
seen AS (SELECT id, MIN(event_id) AS first_at FROM e GROUP BY 1),
chosen AS (SELECT id, kind = 'true' AS want FROM k WHERE kind <> 'mixed'
  UNION ALL SELECT id, ROW_NUMBER() OVER (ORDER BY first_at) - 1 < (SELECT x FROM x) FROM k JOIN seen USING (id) WHERE kind = 'mixed')
SELECT firsts.id, label, event_id FROM firsts JOIN chosen USING (id) WHERE label = want"""
)
def mixed_label_balance(spark, d):
    rows = table(spark, d, "events").where("event_type in ('error', 'click') and user_id is not null")
    rows = rows.select(F.col("user_id").alias("id"), (F.col("event_type") == "error").alias("label"), "event_id")
    return select.balanced_labels(rows, "id", "label", ["event_id"])


@query("SELECT event_type, event_id FROM events WHERE event_type IN ('error', 'click') QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) <= CASE event_type WHEN 'error' THEN 40 ELSE 60 END")
def quota_per_label(spark, d):
    return select.quota(table(spark, d, "events"), "event_type", ["event_id"], {"error": 40, "click": 60}).select("event_type", "event_id")


@query("SELECT source, doc_id FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def first_per_path(spark, d):
    return select.first_per(table(spark, d, "documents"), ["source"], ["doc_id"]).select("source", "doc_id")


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect_roots(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("(SELECT 'missing' AS side, p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) UNION ALL (SELECT DISTINCT 'unexpected', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))")
def set_difference_sites(spark, d):
    want, have = table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    side = lambda df, n: df.select(F.lit(n).alias("side"), "k")
    return side(want.join(have, "k", "left_anti"), "missing").unionByName(side(have.join(want, "k", "left_anti"), "unexpected"))


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, NULL, NULL FROM documents")
def union_padded(spark, d):
    return table(spark, d, "labels").unionByName(table(spark, d, "documents").select("doc_id"), allowMissingColumns=True)


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def topk_pairs(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "user_id", "value")


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 12), length(p_name), p_partkey) <= 2")
def best_donor_topn(spark, d):
    order = [*select.donor_rank(F.col("p_size"), F.length("p_name")), "p_partkey"]
    return select.first_per(table(spark, d, "part"), ["p_brand"], order, 2).select("p_brand", "p_partkey", "p_size")


@query(
    """WITH g AS (SELECT user_id, COUNT(*) AS n, md5('7|' || user_id) AS k FROM events GROUP BY 1),
c AS (SELECT *, COALESCE(SUM(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
t AS (SELECT MAX(before + n) AS e FROM c WHERE before < 100), v AS (SELECT MAX(before + n) AS e FROM c WHERE before >= (SELECT e FROM t) AND before < (SELECT e FROM t) + 150)
SELECT user_id, n, CASE WHEN before < 100 THEN 'test' WHEN before >= (SELECT e FROM t) AND before < (SELECT e FROM t) + 150 THEN 'validation'
  WHEN before >= (SELECT e FROM v) AND before < (SELECT e FROM v) + 400 THEN 'train' ELSE 'unused' END AS split FROM c"""
)
def group_split_cumulative(spark, d):
    groups = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("k", select.random_key(7, "user_id"))
    return select.fill_splits(groups, "n", ["k"], [("test", 100), ("validation", 150), ("train", 400)]).select("user_id", "n", "split")


@query("WITH o AS (SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey FROM o WHERE k % 7 = 3")
def shard_modulo(spark, d):
    return select.shard(table(spark, d, "part").select("p_partkey"), ["p_partkey"], 3, 7)


@query("SELECT s_suppkey, CAST(floor((ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1) / 8) AS INT) AS batch FROM supplier")
def fixed_batches(spark, d):
    return select.batches(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 8)


@query("SELECT source, doc_id FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) <= 4")
def sample_per_cell(spark, d):
    return select.sample_per(table(spark, d, "documents").select("source", "doc_id"), ["source"], 4, 3, "doc_id")


@query("SELECT o_orderpriority, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_per_group_multikey(spark, d):
    best = select.first_per(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"])
    return best.select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")


@query(
    """WITH g AS (SELECT l_linenumber AS k, round(SUM(l_discount), 4) AS gain FROM lineitem GROUP BY 1), x AS (SELECT *, LEAD(gain) OVER (ORDER BY k) - gain AS more FROM g)
SELECT COALESCE(MIN(k) FILTER (WHERE gain >= 1e9), MIN(k) FILTER (WHERE more <= 0.0), arg_max(k, gain)) AS chosen FROM x"""
)
def circuit_topk_choice(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.sum("l_discount"), 4).alias("gain"))
    return select.best_with_fallback(g, "k", "gain", 1e9, 0.0)


_SCORED = "SELECT 'm' || l.doc_id % 3 AS m, l.toxic AS y, l.quality, CAST(d.n_chars % 97 AS DOUBLE) / 97 AS score FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL"


def _scored(spark, d):
    score = (F.col("n_chars") % 97).cast("double") / 97
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").where("toxic is not null")
    return joined.select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("m"), F.col("toxic").alias("y"), "quality", score.alias("score"))


@query(
    f"""WITH s AS ({_SCORED}), r AS (SELECT *, RANK() OVER (PARTITION BY m ORDER BY score) + (COUNT(*) OVER (PARTITION BY m, score) - 1) / 2.0 AS rk FROM s)
SELECT m, COUNT(*) AS n, round((SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y))), 6) AS auroc FROM r GROUP BY m"""
)
def auroc_rank(spark, d):
    return metrics.ranking(_scored(spark, d), ["m"], "y", "score").select("m", "n", r6("auroc").alias("auroc"))


@query(
    f"""WITH s AS ({_SCORED}), c AS (SELECT m, score, SUM(y) AS p, COUNT(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT m, p, SUM(p) OVER w AS tp, SUM(n) OVER w AS k, SUM(p) OVER (PARTITION BY m) AS total FROM c WINDOW w AS (PARTITION BY m ORDER BY score DESC))
SELECT m, round(SUM(CAST(p AS DOUBLE) * tp / k) / MAX(total), 6) AS average_precision FROM t GROUP BY m"""
)
def average_precision(spark, d):
    return metrics.ranking(_scored(spark, d), ["m"], "y", "score").select("m", r6("average_precision").alias("average_precision"))


@query(
    f"""WITH s AS ({_SCORED}), c AS (SELECT m, COUNT(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, COUNT(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, COUNT(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp FROM s GROUP BY m) SELECT *, round(CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp), 6) AS accuracy FROM c"""
)
def confusion_counts(spark, d):
    out = metrics.confusion(_scored(spark, d), ["m"], "y", F.col("score") >= 0.5)
    return rounded(out.drop("balanced_accuracy"), "accuracy")


@query(f"WITH s AS ({_SCORED}) SELECT m, round((AVG(CASE WHEN y = 1 THEN CAST(score >= 0.5 AS INT) END) + AVG(CASE WHEN y = 0 THEN CAST(score < 0.5 AS INT) END)) / 2, 6) AS balanced_accuracy FROM s GROUP BY m")
def balanced_accuracy(spark, d):
    return rounded(metrics.confusion(_scored(spark, d), ["m"], "y", F.col("score") >= 0.5).select("m", "balanced_accuracy"), "balanced_accuracy")


@query(
    f"""WITH s AS ({_SCORED}), c AS (SELECT unnest([0.5, 0.8, 0.9, 0.95]) AS recall, unnest(quantile_cont(score, [0.5, 0.2, 0.1, 0.05])) AS cut FROM s WHERE quality = 1)
SELECT CAST(recall AS DOUBLE) AS recall, round(AVG(CASE WHEN score >= cut - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM s, c WHERE quality = 0 GROUP BY 1"""
)
def fpr_at_recall(spark, d):
    rows = _scored(spark, d).withColumn("score", F.col("score") + F.when(F.col("quality") == 0, 1e-12).otherwise(0.0))
    return rounded(metrics.fpr_at_recall(rows, [], "quality", "score"), "fpr")


@query(f"WITH s AS ({_SCORED}), p AS (SELECT m, AVG(y) AS p FROM s GROUP BY m) SELECT m, CASE WHEN MAX(p) <= 0 THEN CAST('inf' AS DOUBLE) WHEN MAX(p) >= 1 THEN CAST('-inf' AS DOUBLE) ELSE round(list_sort(list(score))[1 + CAST(floor((1 - MAX(p)) * (COUNT(*) - 1)) AS INT)] + ((1 - MAX(p)) * (COUNT(*) - 1) - floor((1 - MAX(p)) * (COUNT(*) - 1))) * (list_sort(list(score))[LEAST(COUNT(*), 2 + CAST(floor((1 - MAX(p)) * (COUNT(*) - 1)) AS INT))] - list_sort(list(score))[1 + CAST(floor((1 - MAX(p)) * (COUNT(*) - 1)) AS INT)]), 6) END AS threshold FROM s JOIN p USING (m) GROUP BY m")
def threshold_prevalence(spark, d):
    return rounded(metrics.prevalence_threshold(_scored(spark, d), ["m"], "y", "score"), "threshold")


@query(
    f"""WITH s AS ({_SCORED}), t AS (SELECT DISTINCT m, score AS t FROM s),
b AS (SELECT t.m, t.t, round(COALESCE((AVG(CASE WHEN y = 1 THEN CAST(score >= t AS INT) END) + AVG(CASE WHEN y = 0 THEN CAST(score < t AS INT) END)) / 2, AVG(CASE WHEN (score >= t) = (y = 1) THEN 1.0 ELSE 0.0 END)), 12) AS b FROM t JOIN s ON s.m = t.m GROUP BY 1, 2)
SELECT m, round(t, 6) AS threshold, round(b, 6) AS balanced_accuracy FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY m ORDER BY b DESC, t) = 1"""
)
def threshold_balanced(spark, d):
    return rounded(metrics.balanced_threshold(_scored(spark, d), ["m"], "y", "score"), "threshold", "balanced_accuracy")


_LONG = "SELECT 'env' || o_custkey % 4 AS env, f.feature, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, f.x FROM orders, LATERAL (SELECT unnest(['price', 'key', 'day']) AS feature, unnest([o_totalprice, CAST(o_orderkey % 101 AS DOUBLE), CAST(day(o_orderdate) AS DOUBLE)]) AS x) f"


def _long(spark, d):
    named = lambda n, c: F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x"))
    o = table(spark, d, "orders")
    values = F.array(named("price", F.col("o_totalprice")), named("key", F.col("o_orderkey") % 101), named("day", F.dayofmonth("o_orderdate")))
    return o.select(F.concat(F.lit("env"), F.col("o_custkey") % 4).alias("env"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.explode(values).alias("f")).select("env", "y", "f.feature", "f.x")


_EFFECTS = f"l AS ({_LONG}), e AS (SELECT env, feature, (AVG(x) FILTER (WHERE y = 1) - AVG(x) FILTER (WHERE y = 0)) / stddev_pop(x) AS effect FROM l GROUP BY 1, 2)"


@query(f"WITH {_EFFECTS} SELECT env, feature, round(effect, 6) AS effect FROM e")
def standardized_effects(spark, d):
    return rounded(metrics.standardized_effects(_long(spark, d), ["env", "feature"], "y", "x"), "effect")


@query(
    f"""WITH {_EFFECTS}, f AS (SELECT feature, COUNT(effect) AS groups, CASE WHEN MIN(effect) > 0 AND COUNT(effect) = COUNT(*) THEN 'positive' WHEN MAX(effect) < 0 AND COUNT(effect) = COUNT(*) THEN 'negative' ELSE 'mixed' END AS direction,
  MIN(abs(effect)) AS least, AVG(abs(effect)) AS mean, median(abs(effect)) AS med, stddev_pop(effect) AS spread FROM e GROUP BY 1)
SELECT feature, groups, direction, direction <> 'mixed' AS same_sign, round(least, 6) AS least, round(mean, 6) AS mean, round(med, 6) AS median, round(spread, 6) AS spread, round(least + 0.35 * mean - 0.25 * spread, 6) AS score,
  ROW_NUMBER() OVER (ORDER BY round(least + 0.35 * mean - 0.25 * spread, 9) DESC, round(least, 9) DESC, round(mean, 9) DESC, round(spread, 9), feature) AS place FROM f WHERE groups > 0"""
)
def consistency_rank(spark, d):
    effects = metrics.standardized_effects(_long(spark, d), ["env", "feature"], "y", "x")
    return rounded(metrics.consistency(effects, "feature"), "least", "mean", "median", "spread", "score")


@query("SELECT o_orderpriority AS train, round(AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1")
def transfer_pivot(spark, d):
    cells = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("train"), F.col("o_orderstatus").alias("test")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return summaries.pivoted(cells, ["train"], "test", ["F", "O", "P"], "v")


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT label, vec_id AS base, e AS be FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT v.label, base, v.vec_id, round(list_dot_product(v.e, be) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(be, be))), 6) AS cosine FROM v JOIN b USING (label) WHERE v.vec_id <> base)
SELECT label, base, vec_id, cosine FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= 5"""
)
def cosine_top_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    base = select.first_per(v, ["label"], ["vec_id"]).select("label", F.col("vec_id").alias("base"), F.col("embedding").alias("be"))
    near = v.join(F.broadcast(base), "label").where("vec_id <> base").select("label", "base", "vec_id", r6(metrics.cosine(F.col("embedding"), F.col("be"))).alias("cosine"))
    return select.first_per(near, ["label"], [F.desc("cosine"), "vec_id"], 5)


@query(
    """WITH x AS (SELECT label, unnest(range(64)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, k, AVG(x) AS mean FROM x GROUP BY 1, 2)
SELECT a.label, CAST(a.k AS INT) AS "at", round(a.mean - b.mean, 6) + 0.0 AS difference FROM m a JOIN m b ON a.k = b.k AND b.label = 0 WHERE a.label <> 0"""
)
def mean_vector_difference(spark, d):
    means = metrics.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding")
    zero = means.where("label = 0").select("at", F.col("mean").alias("base"))
    return means.where("label <> 0").join(zero, "at").select("label", "at", r6(F.col("mean") - F.col("base")).alias("difference"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM v)
SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(GREATEST(x, 1e-6)))) / ln(len(p)), 6) AS entropy, round((list_sum(list_transform(p, lambda x: x * x)) - 1.0 / len(p)) / (1 - 1.0 / len(p)), 6) AS herfindahl,
  round((1 / list_sum(list_transform(p, lambda x: x * x)) - 1) / (len(p) - 1), 6) AS support, round(list_sum(list_reverse_sort(p)[1:8]), 6) AS top8 FROM p"""
)
def entropy_herfindahl(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    x = F.col("a")
    return a.select("vec_id", r6(metrics.normalized_entropy(x)).alias("entropy"), r6(metrics.herfindahl(x)).alias("herfindahl"), r6(metrics.effective_support(x)).alias("support"), r6(metrics.top_mass(x, 8)).alias("top8"))


@query(
    """WITH b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, [e[1:22], e[23:43], e[44:64]] AS parts FROM b)
SELECT vec_id, round(list_avg(parts[1]), 6) + 0.0 AS early_mean, round(list_max(parts[2]), 6) AS middle_most, round(list_stddev_pop(parts[3]), 6) AS late_spread FROM s"""
)
def layer_band_summary(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", metrics.layer_bands(F.transform("embedding", lambda x: x.cast("double"))).alias("b"))
    return e.select("vec_id", r6(F.col("b")[0]["mean"]).alias("early_mean"), r6(F.col("b")[1]["most"]).alias("middle_most"), r6(F.col("b")[2]["spread"]).alias("late_spread"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join_lookup(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    build = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", "o_orderstatus", "o_totalprice")
    return joins.lookup(facts, build, "k", "o_orderdate", ["o_orderstatus", "o_totalprice"]).withColumnRenamed("k", "l_orderkey")


@query(
    """SELECT d.doc_id, COALESCE(l.toxic, CASE WHEN b.item_id IS NOT NULL THEN 2 END) AS v, CASE WHEN l.toxic IS NOT NULL THEN 'labels' WHEN b.item_id IS NOT NULL THEN 'benchmark' END AS v_source
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id"""
)
def left_join_coalesce(spark, d):
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(2).alias("two"))
    return joins.coalesced(table(spark, d, "documents").select("doc_id"), [("labels", table(spark, d, "labels"), "toxic"), ("benchmark", bench, "two")], "doc_id", "v")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_pending(spark, d):
    return joins.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_index(spark, d):
    return joins.within(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query(
    """WITH a AS (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'error')
SELECT user_id, place, a.event_id AS left_event_id, b.event_id AS right_event_id FROM a JOIN b USING (user_id, place)"""
)
def positional_pairing(spark, d):
    e = table(spark, d, "events")
    return joins.paired_by_place(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], ["event_id"], ["event_id"])


@query(
    """SELECT t.s_suppkey, t.s_nationkey, p.s_suppkey AS donor_s_suppkey, p.s_nationkey AS donor_s_nationkey, p.rank AS donor_rank FROM supplier t, LATERAL (
  SELECT s_suppkey, s_nationkey, ROW_NUMBER() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier s WHERE s.s_nationkey <> t.s_nationkey) p WHERE p.rank <= 2"""
)
def donor_theta_join(spark, d):
    s = table(spark, d, "supplier")
    targets = s.select("s_suppkey", "s_nationkey")
    out = joins.donors(targets, s.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", ["s_acctbal", "s_suppkey"], 2)
    return out.select("s_suppkey", "s_nationkey", "donor_s_suppkey", "donor_s_nationkey", "donor_rank")


@query(
    """WITH s AS (SELECT user_id, event_id, epoch(ts) AS a, epoch(ts) + 3600 * (1 + event_id % 5) AS b FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_type = 'error')
SELECT p.event_id AS point, s.event_id AS span FROM p JOIN s ON p.user_id = s.user_id AND p.t >= s.a AND p.t < s.b"""
)
def range_join_spans(spark, d):
    at = micros("ts").cast("double") / 1e6
    e = table(spark, d, "events").withColumn("t", at)
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("t").alias("a"), (F.col("t") + 3600 * (1 + F.col("event_id") % 5)).alias("b"))
    points = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("point"), "t")
    return joins.spans_of_points(points, "t", spans, "a", "b", ["user_id"], 7200).select("point", "span")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 0.05")
def near_equal_join(spark, d):
    p = table(spark, d, "part")
    left, right = p.select("p_brand", F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("x")), p.select("p_brand", F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("y"))
    return joins.near_equal(left, right, "x", "y", ["p_brand"], 0.05).where("a < b").select("a", "b")


@query("SELECT r_name, event_type FROM region, (SELECT DISTINCT event_type FROM events)")
def condition_grid(spark, d):
    return joins.grid(table(spark, d, "region").select("r_name"), table(spark, d, "events").select("event_type").distinct())


_ARMS = "c AS (SELECT 'run' || user_id % 6 AS run, user_id, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'steered' END AS arm, COUNT(*) AS n, COUNT(*) FILTER (WHERE event_type <> 'view') AS valid, COUNT(*) FILTER (WHERE event_type = 'error') AS deceptive FROM events GROUP BY 1, 2, 3)"


def _arms(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("run"), F.col("user_id") % 6).alias("run"), "user_id", F.when(F.col("event_id") % 2 == 0, "base").otherwise("steered").alias("arm"), "event_type")
    out = summaries.outcome_counts(e, ["run", "user_id", "arm"], F.col("event_type") != "view", F.col("event_type") == "error")
    return out


@query(
    f"""WITH {_ARMS} SELECT run, arm, COUNT(*) AS units, CAST(SUM(valid) AS BIGINT) AS valid, CAST(SUM(deceptive) AS BIGINT) AS deceptive, round(AVG(CASE WHEN valid > 0 THEN CAST(deceptive AS DOUBLE) / valid END), 6) AS macro,
  round(stddev_samp(CASE WHEN valid > 0 THEN CAST(deceptive AS DOUBLE) / valid END), 6) AS spread, round(CASE WHEN SUM(valid) > 0 THEN CAST(SUM(deceptive) AS DOUBLE) / SUM(valid) END, 6) AS pooled FROM c GROUP BY 1, 2"""
)
def pooled_and_macro_rates(spark, d):
    return rounded(summaries.pooled_and_macro(_arms(spark, d), ["run", "arm"], "user_id"), "macro", "spread", "pooled")


@query(f"WITH {_ARMS}, r AS (SELECT run, arm, round(CAST(SUM(deceptive) AS DOUBLE) / SUM(valid), 6) AS rate FROM c GROUP BY 1, 2) SELECT run, MAX(rate) FILTER (WHERE arm = 'base') AS base, MAX(rate) FILTER (WHERE arm = 'steered') AS steered FROM r GROUP BY run")
def pivot_conditions(spark, d):
    rates = summaries.pooled_and_macro(_arms(spark, d), ["run", "arm"], "user_id").select("run", "arm", r6("pooled").alias("rate"))
    return summaries.pivoted(rates, ["run"], "arm", ["base", "steered"], "rate")


@query(
    f"""WITH {_ARMS}, p AS (SELECT a.run, a.user_id, a.valid AS v0, a.deceptive AS d0, b.valid AS v1, b.deceptive AS d1 FROM c a JOIN c b ON a.run = b.run AND a.user_id = b.user_id AND a.arm = 'base' AND b.arm = 'steered')
SELECT run, COUNT(*) AS units, round(CAST(SUM(d0) AS DOUBLE) / SUM(v0), 6) AS rate_base, round(CAST(SUM(d1) AS DOUBLE) / SUM(v1), 6) AS rate_steered, round(CAST(SUM(d1) AS DOUBLE) / SUM(v1) - CAST(SUM(d0) AS DOUBLE) / SUM(v0), 6) + 0.0 AS effect FROM p GROUP BY run"""
)
def paired_delta(spark, d):
    pairs = summaries.paired_arms(_arms(spark, d), ["run"], "user_id", "arm", ("base", "steered"))
    out = summaries.paired_effect(pairs, ["run"], ("base", "steered")).select("run", "units", "rate_base", "rate_steered", "effect")
    return rounded(out, "rate_base", "rate_steered", "effect")


@query()
def paired_bootstrap_interval(spark, d):
    pairs = summaries.paired_arms(_arms(spark, d), ["run"], "user_id", "arm", ("base", "steered"))
    return summaries.paired_bootstrap(pairs, "run", "user_id", ("base", "steered"))


@query("SELECT p_type, p_size, p_brand AS label, n, n >= 3 AS in_vocabulary FROM (SELECT p_type, p_size, MIN(p_brand) AS p_brand, COUNT(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1, 2 HAVING MIN(p_brand) = MAX(p_brand))")
def lenient_keys_unanimous(spark, d):
    return summaries.unanimous(table(spark, d, "part"), ["p_type", "p_size"], "p_brand", 3)


@query(f"WITH {PROBES} SELECT trace, round(SUM(r * nv) / SUM(nv), 6) AS weighted, round(100 * (1 - exp(-SUM(r))), 6) AS reduction FROM p GROUP BY trace")
def weighted_scores(spark, d):
    p = curves.clean(curves.probes_from_events(table(spark, d, "events")))
    return p.groupBy("trace").agg(r6(summaries.weighted_mean(F.col("r"), F.col("nv"))).alias("weighted"), r6(intervals.percent_reduction(F.sum("r"))).alias("reduction"))


@query("SELECT conv_id, list(role ORDER BY turn)[1] AS first_role, COUNT(*) FILTER (WHERE role = 'assistant') * 2 > COUNT(*) AS mostly_assistant FROM conversations GROUP BY conv_id")
def majority_vote(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.col("t")[0]["role"].alias("first_role"), F.coalesce(summaries.majority(F.transform("t", lambda t: t["role"] == "assistant")), F.lit(False)).alias("mostly_assistant"))


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('error') THEN TRUE WHEN lower(trim(event_type)) IN ('view') THEN FALSE END AS label FROM events WHERE event_type IN ('error', 'view')")
def label_filter_deceptive(spark, d):
    mapped = F.when(F.col("event_type") == "error", "Deceptive ").when(F.col("event_type") == "view", "no")
    e = table(spark, d, "events").select("event_id", coerce.label(mapped).alias("label"))
    return e.where(coerce.label_filter("deceptive_only", F.col("label")) | coerce.label_filter("truthful_only", F.col("label")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 2, 4) THEN TRUE WHEN o_orderkey % 7 IN (1, 3, 5) THEN FALSE END AS label FROM orders")
def label_tristate(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["TRUE", "0", " yes", "f", "Deceptive", "no ", "2"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", coerce.label(raw).alias("label"))


@query("SELECT DISTINCT text FROM benchmark")
def distinct_texts(spark, d):
    return table(spark, d, "benchmark").select("text").distinct().where(text.count_words(F.col("text")) >= 0)
