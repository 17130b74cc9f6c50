"""Smaller operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import details
from .curve_queries import trace_index
from .registry import PROBES, query, r6, table

_SLOTS = "s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, LAG(CAST(embedding AS DOUBLE[])) OVER w AS b, LAG(CAST(embedding AS DOUBLE[]), 2) OVER w AS c FROM embeddings WHERE embedding IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


@query(
    f"""WITH {_SLOTS} SELECT vec_id, round(list_sum(v), 6) + 0.0 AS final, round(CASE WHEN b IS NULL THEN 0.0 ELSE list_sum(v) - list_sum(b) END, 6) + 0.0 AS delta_last,
  round(CASE WHEN b IS NULL THEN 0.0 WHEN c IS NULL THEN list_sum(v) - list_sum(b) ELSE list_sum(v) - (list_sum(b) + list_sum(c)) / 2 END, 6) + 0.0 AS delta_mean FROM s"""
)
def activation_variants(spark, d):
    embeddings, places = table(spark, d, "embeddings").where("embedding IS NOT NULL"), F.col("embedding")
    w = Window.partitionBy("label").orderBy("vec_id").rowsBetween(-2, 0)
    v = F.transform(places, lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", "label", v.alias("v")).withColumn("slots", F.reverse(F.collect_list("v").over(w)))
    filled = F.transform("slots", lambda s: F.lit(True))
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    return rows.select("vec_id", *[total(details.vector_variant(F.col("slots"), filled, k)).alias(k) for k in ("final", "delta_last", "delta_mean")])


@query(
    """WITH o AS (SELECT item_id, length(text) AS n, list_transform(range(CAST(ceil(length(text) / 4.0) AS INT)), lambda i: {'s': 4 * i, 'e': LEAST(length(text), 4 * i + 4)}) AS t FROM benchmark)
SELECT item_id, len(list_filter(t, lambda x: (x.s + x.e) / 2.0 >= 10 AND (x.s + x.e) / 2.0 < 37)) AS inside, len(list_filter(t, lambda x: x.e <= 21)) AS before FROM o"""
)
def token_span_alignment(spark, d):
    n = F.length("text")
    offsets = F.transform(F.sequence(F.lit(0), F.ceil(n / 4).cast("int") - 1), lambda i: F.struct((4 * i).alias("s"), F.least(n, 4 * i + 4).alias("e")))
    rows = table(spark, d, "benchmark").select("item_id", offsets.alias("t"))
    return rows.select("item_id", F.size(details.tokens_in_span(F.col("t"), F.lit(10), F.lit(37))).cast("long").alias("inside"), details.tokens_before(F.col("t"), F.lit(21)).cast("long").alias("before"))


@query(
    """SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'view' AND value > 10 THEN 0 WHEN event_type <> 'view' THEN 1 ELSE 2 END, event_id) = 1"""
)
def primary_action(spark, d):
    out = details.primary_choice(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("value") > 10, F.col("event_type") != "view")
    return out.select("user_id", "event_id")


@query(
    """WITH r AS (SELECT user_id, event_id, event_type = 'error' AS dec, ROW_NUMBER() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY md5('5|' || event_id), event_id) AS r FROM events),
t AS (SELECT *, CASE WHEN dec AND r <= 2 THEN 0 WHEN NOT dec THEN 1 ELSE 2 END AS tier FROM r WHERE r <= 4)
SELECT user_id, event_id FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY tier, r) <= 4"""
)
def mixed_generation_sample(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("dec"))
    return details.mixed_sample(rows, ["user_id"], "dec", "event_id", 5).select("user_id", "event_id")


@query(
    """WITH c AS (SELECT event_id, event_type, SUM(CAST(event_type = 'error' AS INT)) OVER w AS e, SUM(CAST(event_type = 'click' AS INT)) OVER w AS c FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, event_type FROM c WHERE COALESCE(e, 0) < 50 OR COALESCE(c, 0) < 100"""
)
def scan_until_quotas(spark, d):
    return details.until_quotas(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", {"error": 50, "click": 100})


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, SUM(round(o_totalprice - 200000, 2)) OVER w AS balance FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, round(balance, 2) AS balance, round(MAX(balance) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, b.o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS peak FROM b JOIN (SELECT o_orderkey, o_orderdate FROM orders) USING (o_orderkey)"""
)
def running_ledger(spark, d):
    o = table(spark, d, "orders").withColumn("amount", F.round(F.col("o_totalprice") - 200000, 2))
    out = details.ledger(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "amount")
    return out.select("o_orderkey", F.round("balance", 2).alias("balance"), F.round("peak", 2).alias("peak"))


@query(
    """SELECT event_id, array_to_string(list_sort(list_distinct(COALESCE(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []))), ',') AS seen FROM events"""
)
def disclosed_before(spark, d):
    out = details.seen_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("event_id", F.array_join("seen", ",").alias("seen"))


@query(
    """WITH m AS (SELECT l_orderkey, SUM(exp(-l_discount * 10)) FILTER (WHERE l_returnflag IN ('A', 'R')) AS yes, SUM(exp(-l_discount * 10)) FILTER (WHERE l_returnflag = 'N') AS no FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(COALESCE(yes, 0.0) / (COALESCE(yes, 0.0) + COALESCE(no, 0.0)), 6) AS yes FROM m"""
)
def first_token_probability(spark, d):
    tokens = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("token"), (-F.col("l_discount") * 10).alias("logprob"))).alias("t"))
    return tokens.select("l_orderkey", r6(details.answer_probability(F.col("t"), {"yes": ["a", "r"], "no": ["n"]})["yes"]).alias("yes"))


@query("SELECT l_orderkey, round(exp(AVG(-l_tax)), 6) AS mean_prob, round(exp(SUM(-l_tax)), 6) AS total_prob FROM lineitem GROUP BY 1")
def sentence_log_probs(spark, d):
    lp = -F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.exp(F.avg(lp))).alias("mean_prob"), r6(F.exp(F.sum(lp))).alias("total_prob"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fund_a' WHEN 1 THEN 'fund_b' WHEN 2 THEN 'fund_b' WHEN 3 THEN 'fund_a' END AS option FROM part")
def option_recovery(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["FUND_A", "2", "Option 2", "I say fund_a now", "fund_a or fund_b"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", details.option_id(raw, F.array(F.lit("fund_a"), F.lit("fund_b"))).alias("option"))


@query("SELECT n_nationkey, 'id_' || (n_nationkey * 2) AS second FROM nation")
def option_map_from_prompt(spark, d):
    prompt = F.concat(F.lit("Choose:\n- Option 1 (id_x)\n- Option 2 (id_"), (F.col("n_nationkey") * 2).cast("string"), F.lit(")\n"))
    return table(spark, d, "nation").select("n_nationkey", jsonx.option_map(prompt)[2].alias("second"))


@query(
    """WITH c AS (SELECT p_brand, COUNT(*) AS k FROM part WHERE p_size >= 45 GROUP BY 1)
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY md5('11|' || p_partkey), p_partkey) AS r FROM part WHERE p_size < 45) JOIN c USING (p_brand) WHERE r <= k"""
)
def matched_random_controls(spark, d):
    return details.matched_controls(table(spark, d, "part"), F.col("p_size") >= 45, "p_brand", "p_partkey", 11).select("p_brand", "p_partkey")


def _auroc(keys: str) -> str:
    return f"""SELECT {keys}, (SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y))) AS auroc
FROM (SELECT *, RANK() OVER (PARTITION BY {keys} ORDER BY v) + (COUNT(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0 AS rk FROM l) GROUP BY {keys}"""


@query(
    f"""WITH l AS (SELECT 'e' || o_custkey % 3 AS env, CAST(o_orderstatus = 'F' AS INT) AS y, unnest(['price', 'key']) AS score_name, unnest([o_totalprice, CAST(o_orderkey % 101 AS DOUBLE)]) AS v FROM orders),
a AS ({_auroc('score_name')}), b AS ({_auroc('score_name, env')})
SELECT a.score_name, round(MAX(a.auroc), 6) AS pooled, round(AVG(b.auroc), 6) AS macro FROM a JOIN b USING (score_name) GROUP BY 1"""
)
def score_table_auroc(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("e"), F.col("o_custkey") % 3).alias("env"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 101).cast("double").alias("key"))
    return details.score_table(o, ["env"], "y", ["price", "key"]).select("score_name", r6("pooled").alias("pooled"), r6("macro").alias("macro"))


@query("SELECT COUNT(*) FILTER (WHERE embedding IS NULL) AS missing, COUNT(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length, 0 AS not_finite, 0 AS zero, COUNT(*) AS n FROM embeddings")
def vector_validation(spark, d):
    return details.vector_faults(table(spark, d, "embeddings"), "embedding", 64)


@query(
    f"""WITH {PROBES}, t AS (SELECT trace, 'env' || trace % 5 AS env, 'm' || trace % 4 AS model, COUNT(*) AS np FROM p GROUP BY trace), x AS (SELECT t.*, env || '|' || model AS cell, jump FROM t LEFT JOIN firsts USING (trace)),
r AS (SELECT * FROM x WHERE jump > 0 ORDER BY jump DESC, trace LIMIT 1),
f AS (SELECT x.* FROM x LEFT JOIN r ON TRUE WHERE x.jump <= 0 ORDER BY CASE WHEN x.cell IS DISTINCT FROM r.cell AND x.model IS DISTINCT FROM r.model THEN 0 WHEN x.cell IS DISTINCT FROM r.cell THEN 1 ELSE 2 END, -x.jump DESC, x.trace LIMIT 1),
l AS (SELECT x.* FROM x LEFT JOIN r ON TRUE LEFT JOIN f ON TRUE ORDER BY CASE WHEN x.cell IS DISTINCT FROM r.cell AND x.cell IS DISTINCT FROM f.cell AND x.model IS DISTINCT FROM r.model AND x.model IS DISTINCT FROM f.model THEN 0
  WHEN x.cell IS DISTINCT FROM r.cell AND x.cell IS DISTINCT FROM f.cell THEN 1 ELSE 2 END, x.np DESC, x.trace LIMIT 1)
SELECT 'rise' AS kind, trace, round(jump, 6) AS score FROM r UNION ALL SELECT 'fall', trace, round(-jump, 6) FROM f UNION ALL SELECT 'long', trace, CAST(np AS DOUBLE) FROM l"""
)
def worked_example_choice(spark, d):
    """The steepest rise, the steepest fall and the longest trace, from different cells where there are any."""
    index = trace_index(spark, d)
    rise, fall = F.col("direction") == "rise", F.col("direction") == "fall"
    rows = details.worked_examples(index, ("env", "model"), "trace", {"rise": (rise, F.col("jdelta")), "fall": (fall, -F.col("jdelta")), "long": (F.lit(True), F.col("np").cast("double"))})
    return spark.createDataFrame([(kind, trace, round(score, 6)) for kind, trace, score in rows], "kind string, trace long, score double")
