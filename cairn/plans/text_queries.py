"""Text, JSON, labelling rules, dialogue, sources, streams and models on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce, jsonx, text
from ..operators import labels, models, select, summaries
from ..sources import readers, shared, sinks
from ..streaming import incremental
from .registry import micros, query, r6, rounded, table


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS words, len(regexp_extract_all(text, '[A-Za-z]+')) AS alpha, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS apostrophes FROM documents WHERE text IS NOT NULL")
def word_counts(spark, d):
    t = F.col("text")
    out = _docs(spark, d).select("doc_id", text.count_words(t).alias("words"), text.count_alpha_words(t).alias("alpha"), text.count_alpha_words(t, True).alias("apostrophes"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("words", "alpha", "apostrophes")})


@query(
    """SELECT doc_id, CASE WHEN regexp_extract(trim(text), '(?s)^(.+?[.!?]["'')\\]]*)(?:\\s+|$)(.*)', 1) <> '' THEN regexp_extract(trim(text), '(?s)^(.+?[.!?]["'')\\]]*)(?:\\s+|$)(.*)', 1) ELSE trim(text) END AS first,
  length(trim(regexp_extract(trim(text), '(?s)^(.+?[.!?]["'')\\]]*)(?:\\s+|$)(.*)', 2))) AS rest FROM documents WHERE text IS NOT NULL"""
)
def first_sentence(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.first_sentence(t).alias("first"), F.length(text.after_first_sentence(t)).cast("long").alias("rest"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^[ .!?"'']+|[ .!?"'']+$', '', 'g') AS normalized FROM documents WHERE text IS NOT NULL""")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(
    """SELECT conv_id, turn, concat_ws('/', 'run1', 'conversation_' || conv_id, 'turn_' || turn, CASE WHEN trim(role) <> '' THEN 'sample_' || regexp_replace(trim(role), '[^A-Za-z0-9._-]+', '_', 'g') END) AS record_id FROM conversations"""
)
def record_id_compose(spark, d):
    none = F.lit(None).cast("string")
    made = text.record_id(F.lit("run1"), F.col("turn"), F.col("conv_id"), none, F.col("turn"), none, F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", made.alias("record_id"))


@query("SELECT conv_id, turn, conv_id || '/sent_' || lpad(CAST(turn AS VARCHAR), 4, '0') AS sentence_id FROM conversations")
def sentence_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.sentence_id(F.col("conv_id"), F.col("turn")).alias("sentence_id"))


#: White space as Unicode has it, for an engine whose own class is ASCII.
_WS = "[ \\x09-\\x0d\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '{_WS}', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    return _docs(spark, d).select("doc_id", text.count_sentences(F.col("text")).cast("long").alias("sentences"))


@query()
def sentence_unnest(spark, d):
    """Sentences of every document by their spans: a text does not travel with each of its sentences."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(text.spans_udf("text")).alias("k", "s"))
    return rows.select("doc_id", text.sentence_id(F.col("doc_id"), F.col("k")).alias("sentence_id"), "s.start", "s.end")


@query(f"SELECT doc_id, COALESCE(list_max(list_transform(regexp_split_to_array(text, '{_WS}'), lambda x: length(x))), 0) AS longest FROM documents WHERE text IS NOT NULL")
def lossy_runs(spark, d):
    return _docs(spark, d).select("doc_id", text.longest_run(F.col("text")).cast("long").alias("longest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, 'note ' || event_id AS before, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def last_json_object(spark, d):
    return _last_objects(table(spark, d, "events"))


def _last_objects(events):
    said = F.concat(F.lit("note "), F.col("event_id").cast("string"), F.lit(" {bad} "), F.col("props"), F.lit(" end"))
    rows = events.select("event_id", said.alias("t"))
    found = rows.select("event_id", F.trim(F.split_part("t", F.lit("{"), F.lit(1))).alias("before"), jsonx.object_udf("last")("t").alias("j"))
    return found.select("event_id", "before", F.get_json_object("j", "$.k").cast("long").alias("k"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, 'page=(\\d+)', 1) AS page, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def regex_contexts(spark, d):
    out = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "page=(\\d+)", 1).alias("page"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))
    return out


@query("SELECT doc_id, len(regexp_extract_all(text, '\\$\\s?\\d[\\d,]*(?:\\.\\d+)?')) AS amounts, lower(text) LIKE '%license%' OR lower(text) LIKE '%copyright%' OR lower(text) LIKE '%rights%' AS legal FROM documents WHERE text IS NOT NULL")
def keyword_and_currency(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.currency_mentions(t).cast("long").alias("amounts"), text.contains_any(t, ["license", "copyright", "rights"]).alias("legal"))


_ISSUES = {"brakes": ["the", "and"], "engine": ["that", "with"], "title": ["license"]}


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN lower(text) LIKE '%the%' OR lower(text) LIKE '%and%' THEN 'brakes' END, CASE WHEN lower(text) LIKE '%that%' OR lower(text) LIKE '%with%' THEN 'engine' END,
  CASE WHEN lower(text) LIKE '%license%' THEN 'title' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents WHERE text IS NOT NULL"""
)
def keyword_issue_match(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.keyword_ids(F.col("text"), _ISSUES), ",").alias("issues"))


@query("SELECT doc_id, CASE WHEN len(list_distinct(regexp_extract_all(lower(text), 'mit|apache|gpl|cc by'))) = 1 THEN regexp_extract_all(lower(text), 'mit|apache|gpl|cc by')[1] END AS only FROM documents WHERE text IS NOT NULL")
def mention_unique(spark, d):
    return _docs(spark, d).select("doc_id", text.only_mention(F.col("text"), "mit|apache|gpl|cc by").alias("only"))


_ISLANDS = """i AS (SELECT conv_id, turn, role, text, SUM(CASE WHEN role IS NOT DISTINCT FROM prev AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island
  FROM (SELECT *, LAG(role) OVER w AS prev, ROW_NUMBER() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))),
g AS (SELECT conv_id, island, role, MIN(turn) AS first_at, COUNT(*) AS turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY 1, 2, 3)"""


def _islands(spark, d):
    return summaries.islands(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")


@query(f"WITH {_ISLANDS} SELECT conv_id, CAST(island AS BIGINT) AS island, role, first_at, turns, text FROM g")
def dialogue_islands(spark, d):
    return _islands(spark, d)


@query(f"WITH {_ISLANDS}, k AS (SELECT * FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY island DESC) <= 3) SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY island) AS block FROM k GROUP BY 1")
def last_n_turns(spark, d):
    return summaries.last_turns(_islands(spark, d), ["conv_id"], "role", "text", 3)


_NUMBERS = ["1,234", "95k", "true", "none", "-3.9", "7.0", " 12 "]


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1234 WHEN 1 THEN 95 WHEN 4 THEN -3 WHEN 5 THEN 7 WHEN 6 THEN 12 END AS n FROM orders")
def optional_ints(spark, d):
    raw = F.element_at(F.array(*map(F.lit, _NUMBERS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", coerce.optional_int(raw).cast("int").alias("n"))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, COUNT(*) AS n, round(SUM(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_window_ext(spark, d):
    out = incremental.windowed(table(spark, d, "events"))
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "total")


@query(
    """WITH e AS (SELECT *, SUM(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, CAST(epoch_us(MIN(ts)) AS BIGINT) AS start, COUNT(*) AS n, COUNT(*) FILTER (WHERE event_type = 'error') AS errors FROM e GROUP BY user_id, s"""
)
def session_window_ext(spark, d):
    return incremental.sessions(table(spark, d, "events")).select("user_id", micros("start").alias("start"), "n", "errors")


@query("SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 5) AS valid, COUNT(*) FILTER (WHERE value > 20) AS deceptive FROM events GROUP BY 1")
def stream_running_counts(spark, d):
    """The events as a stream of micro-batches: the state of the last batch is the batch result."""
    events = table(spark, d, "events")
    source, out, mark = (shared.path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    events.select("event_type", "value").repartition(3).write.parquet(source)
    stream = incremental.stream_of(spark, source, spark.read.parquet(source).schema)
    counts = incremental.running_counts(stream, ["event_type"], F.col("value") > 5, F.col("value") > 20)
    incremental.run_all(counts, lambda batch, _: batch.write.mode("overwrite").parquet(out), mark, "complete")
    return spark.read.parquet(out)


@query(
    """WITH RECURSIVE w(node, steps) AS (SELECT 0, 0 UNION ALL SELECT b.k, steps + 1 FROM w JOIN (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS k FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 2) % 25 FROM nation) b ON b.a = w.node WHERE steps < 6)
SELECT CAST(node AS BIGINT) AS node, MIN(steps) AS steps FROM w GROUP BY 1"""
)
def recursive_bfs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    edges = n.select("a", ((F.col("a") * 2 + 1) % 25).alias("b")).union(n.select("a", ((F.col("a") * 3 + 2) % 25).alias("b"))).distinct()
    return incremental.distances(edges, 0, 6)


@query()
def adaptive_probe_search(spark, d):
    """Traces of events searched with a sampler that reads a fixed curve: what a model would answer."""
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("trace")).agg(F.count("*").cast("int").alias("n"))

    def sampler(trace, boundary, samples):
        return samples, samples if boundary < 1 + trace % 9 else 0

    return incremental.localize(n, sampler, samples=10)


@query("SELECT range AS job, ['a', 'b', 'c'][1 + CAST(range % 3 AS INT)] AS scenario, CAST(floor(range / 3) AS BIGINT) AS number FROM range(50)")
def job_round_robin(spark, d):
    return incremental.job_list(spark, 50, ["a", "b", "c"])


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def jsonl_round_trip(spark, d):
    """Documents as JSON lines, written and read with an explicit schema."""
    path = shared.path(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars"), path)
    return readers.read_jsonl(spark, path, "doc_id long, source string, n_chars long")


@query("SELECT lang, source, COUNT(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1, 2")
def cell_files_round_trip(spark, d):
    """Files by language; reading one language reads its folder only."""
    path = shared.path(spark, "cells")
    sinks.write_cells(table(spark, d, "documents").select("doc_id", "lang", "source"), path, ["lang"], "parquet")
    return spark.read.parquet(path).where("lang = 'fr'").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT 'run_' || user_id % 3 AS run_id, CASE WHEN event_type = 'error' THEN TRUE WHEN event_type = 'click' THEN FALSE END AS label, COUNT(*) AS n FROM events GROUP BY 1, 2")
def mined_scan_round_trip(spark, d):
    """The layout of mined samples made from events, scanned again: run ids from paths, labels coerced."""
    root = shared.path(spark, "mined")
    kind = F.when(F.col("event_type") == "error", "yes").when(F.col("event_type") == "click", "truthful")
    rows = table(spark, d, "events").select(F.concat(F.lit("run_"), F.col("user_id") % 3).alias("run"), F.col("event_id").cast("string").alias("sample_id"), kind.alias("deceptive"))
    for run in ("run_0", "run_1", "run_2"):
        part = rows.where(F.col("run") == run).drop("run")
        part.coalesce(1).write.json(f"{root}/tmp-{run}")
        _move_single(spark, f"{root}/tmp-{run}", f"{root}/{run}/deception_samples.jsonl")
    return readers.mined_records(spark, root).groupBy("run_id", "label").agg(F.count("*").alias("n"))


def _move_single(spark: SparkSession, folder: str, to: str) -> None:
    """The one part file of a folder under another name, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    fs.mkdirs(path(to).getParent())
    fs.rename(part, path(to))
    fs.delete(path(folder), True)


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS held FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, held, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w),
tf AS (SELECT doc_id, held, term, COUNT(*) AS tf FROM g GROUP BY ALL), n AS (SELECT COUNT(DISTINCT doc_id) AS n FROM w WHERE NOT held),
terms AS (SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM tf WHERE NOT held GROUP BY 1 ORDER BY total DESC, term LIMIT 2000),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM tf JOIN terms USING (term), n WHERE held)
SELECT doc_id, term, round(x / sqrt(SUM(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x"""
)
def tfidf_weights(spark, d):
    """Weights of the held-out documents by the vocabulary of the others."""
    docs = _docs(spark, d).select("doc_id", "text", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2").alias("held"))
    return models.tfidf(docs.where("not held"), docs.where("held"), "doc_id", "text", 2000).withColumn("weight", r6("weight"))


@query()
def transfer_one_out(spark, d):
    """Classifiers of long documents, trained on all languages but one and tested on it."""
    docs = _docs(spark, d).select("lang", F.length("text").alias("a"), text.count_words(F.col("text")).cast("double").alias("b"), (F.col("n_chars") > 2000).cast("int").alias("y"))
    docs = docs.withColumn("a", F.col("a").cast("double") % 1000)
    return models.transfer(docs, "lang", "y", ["a", "b"], ["de", "en", "es", "fr"], maxIter=10)


@query()
def principal_components(spark, d):
    """Four components of the embeddings, fitted on the even vectors."""
    from pyspark.ml.functions import vector_to_array

    e = table(spark, d, "embeddings").where("embedding is not null")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(size)])
    model = models.reduced(e.where("vec_id % 2 = 0"), [f"x{i}" for i in range(size)], 4)
    return model.transform(e).select("vec_id", vector_to_array("features").alias("features"))


@query(
    """WITH r AS (SELECT o_custkey, list(CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 END * CAST(o_totalprice AS DOUBLE) / 100000 ORDER BY o_orderdate, o_orderkey) AS r FROM orders GROUP BY 1)
SELECT o_custkey, round(list_reduce(list_concat([CAST(50.0 AS DOUBLE)], r), lambda s, x: GREATEST(0.0, LEAST(100.0, s + CASE WHEN x < 0 THEN -LEAST(10.0, abs(x) * 1.5 + 0.5) ELSE LEAST(4.0, x * 0.9 + 0.4) END))), 6) AS reputation FROM r"""
)
def reputation_recurrence(spark, d):
    """A reputation folded over each customer's orders, taken as monthly returns."""
    returns = F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0) * F.col("o_totalprice").cast("double") / 100000
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey", returns.alias("x")).alias("t"))
    folded = labels.reputation(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]))
    return o.groupBy("o_custkey").agg(folded.alias("reputation")).select("o_custkey", r6("reputation").alias("reputation"))


@query("SELECT doc_id, md5(source || '|' || doc_id) AS key FROM documents")
def hashed_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("key"))


@query("SELECT doc_id, CAST('0x' || substr(sha256(doc_id || '|' || source), 1, 12) AS BIGINT) AS seed FROM documents")
def deterministic_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", text.seed_from(F.col("doc_id").cast("string"), F.col("source")).alias("seed"))


@query("SELECT source, pi, COUNT(*) AS n FROM (SELECT source, DENSE_RANK() OVER (PARTITION BY source ORDER BY lang) - 1 AS pi FROM documents) GROUP BY 1, 2")
def prompt_dictionary(spark, d):
    rows, _ = sinks.prompts_by_index(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source"], "lang")
    return rows.groupBy("source", "pi").agg(F.count("*").alias("n"))


@query("SELECT lang, COUNT(*) AS n, MIN(doc_id) AS first FROM documents GROUP BY lang")
def nested_payload_round_trip(spark, d):
    rows = table(spark, d, "documents").select("lang", F.lit("c").alias("condition"), F.lit(1).alias("one"), "doc_id")
    nested = sinks.nested_payloads(rows, ["lang"], "condition", ["one"], ["doc_id"])
    items = F.col("conditions")["c"]["items"]
    return nested.select("lang", F.size(items).cast("long").alias("n"), items[0]["doc_id"].alias("first"))


@query("SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id HAVING COUNT(*) > 4")
def long_dialogues(spark, d):
    sized = select.last_per(table(spark, d, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))), ["conv_id"], "turn", ["n"])
    return sized.where("n > 4")
