"""Scans of the pipeline's files: explicit schemas, paths as columns, tolerant and strict modes.

Layouts: mined samples `<root>/.../deception_samples.jsonl` with an optional `meta.json` beside them; localized traces
`<root>/<env>/<model>/localization/*.json[.gz]`, one document a file; feature tables as Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import label as coerce_label
from ..functions.coerce import label_filter
from ..functions.jsonx import object_udf
from ..functions.text import record_id

PROBE = "sentence_end_idx int, sentence_idx_inclusive int, sentence_text string, prefix_text string, char_span array<long>, deception_rate double, num_valid long, num_truthful long, ci_low double, ci_high double, generations array<struct<gen_text:string,full_generation_text:string,is_truthful:boolean,deceptive:boolean,parse_error:string>>"
TRACE = f"example_id string, game string, prompt string, raw_text string, is_truthful boolean, history array<struct<{PROBE.replace(' int', ':int').replace(' string', ':string').replace(' array', ':array').replace(' double', ':double').replace(' long', ':long').replace(', ', ',')}>>"
MINED = "conversation_id string, game_id string, turn_id string, state_id string, sample_id string, game_type string, model string, deceptive string, is_truthful string, action_reasoning string, reasoning string, prompt string, action string, truth_context string, timestamp double"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a bad line raises, or is dropped if not strict. Blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str, recursive: str | None = None) -> DataFrame:
    """path, line_num (from 1) and text of each line that is not blank.

    Files are read in splits like any text. A line's number is its place in its file, by the split's start and the place
    in it; no file is ever one row.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", recursive)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
    numbered = lines.withColumn("line_num", F.row_number().over(Window.partitionBy("path").orderBy("_start", "_at")))
    return numbered.where(F.trim("text") != "").select("path", "line_num", "text")


def run_info(path: Column, root: str) -> dict[str, Column]:
    """run_id (the folder below the root), gpu and run_date as parts of the path."""
    base = re.sub(r"/+$", "", root)
    relative = F.regexp_replace(F.regexp_replace(path, f"^(file:)?/*{re.escape(base.lstrip('/').removeprefix('file:').lstrip('/'))}/*", ""), "/?[^/]*$", "")
    parts = F.split(relative, "/")
    return {
        "run_id": F.when(relative == "", F.lit(".")).otherwise(relative),
        "gpu": F.try_element_at(F.filter(parts, lambda p: p.startswith("gpu_")), F.lit(1)),
        "run_date": F.try_element_at(F.filter(parts, lambda p: p.rlike("^\\d{4}-\\d{2}-\\d{2}$")), F.lit(1)),
    }


def mined_records(spark: SparkSession, root: str, keep: str = "all", strict: bool = True, meta: str | None = None) -> DataFrame:
    """The main scan: all mined samples below a root, with run information, meta columns, a composed id and a label filter."""
    lines = read_lines(spark, root, "deception_samples.jsonl")
    schema = T.StructType.fromDDL(f"{MINED}, _corrupt_record string")
    rows = lines.withColumn("j", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("j._corrupt_record").isNotNull() | F.col("j").isNull()
    if strict:
        fine = F.when(bad, F.raise_error(F.concat_ws(":", F.lit("bad JSON at "), "path", F.col("line_num").cast("string"))).cast("boolean")).otherwise(True)
        rows = rows.where(fine)
    else:
        rows = rows.where(~bad)
    rows = rows.select("path", "line_num", *[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields[:-1]]).withColumns(run_info(F.col("path"), root))
    rows = rows.withColumn("record_id", record_id(F.col("run_id"), F.col("line_num"), F.col("conversation_id"), F.col("game_id"), F.col("turn_id"), F.col("state_id"), F.col("sample_id")))
    rows = rows.withColumn("label", F.coalesce(coerce_label(F.col("deceptive")), ~coerce_label(F.col("is_truthful"))))
    if meta:
        info = spark.read.schema(meta).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(root)
        named = info.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("_dir"), *[F.col(c).alias(f"meta_{c}") for c in info.columns])
        rows = rows.withColumn("_dir", F.regexp_replace("path", "/[^/]*$", "")).join(named, "_dir", "left").drop("_dir")
    return rows.where(label_filter(keep, F.col("label")))


def traces(spark: SparkSession, root: str) -> DataFrame:
    """Localized traces of all environments and models, plain or gzipped, one document a file, env and model from the path."""
    docs = spark.read.schema(TRACE).option("multiLine", True).json(f"{root}/*/*/localization/*.json*")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return docs.select(F.col("_metadata.file_path").alias("path"), F.element_at(parts, -4).alias("env"), F.element_at(parts, -3).alias("model"), *docs.columns)


def damaged_traces(spark: SparkSession, glob: str) -> DataFrame:
    """The first complete document of each file, whatever stands behind it."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), object_udf("document")("value").alias("raw"))
    return files.where("raw is not null").select("path", F.from_json("raw", T.StructType.fromDDL(TRACE)).alias("d")).select("path", "d.*")


def probes(documents: DataFrame, outer: bool = False) -> DataFrame:
    """One row for each probe of each trace, with its place in the history; `outer` keeps traces without any."""
    explode = F.posexplode_outer if outer else F.posexplode
    carried = [c for c in ("env", "model", "example_id", "path") if c in documents.columns]
    return documents.select(*carried, explode("history").alias("sentence_pos", "p")).select(*carried, "sentence_pos", "p.*")


def generations(probe_rows: DataFrame) -> DataFrame:
    carried = [c for c in probe_rows.columns if c != "generations"]
    return probe_rows.select(*carried, F.posexplode("generations").alias("gen_idx", "g")).select(*carried, "gen_idx", "g.*")


def label_map(examples: DataFrame, order: str) -> DataFrame:
    """example_id -> label and its source; the last row of an id wins."""
    own, other = coerce_label(F.col("deceptive"), "bool"), ~coerce_label(F.col("is_truthful"), "bool")
    rows = examples.withColumns({"label": F.coalesce(own, other), "source": F.when(own.isNotNull(), "deceptive").when(other.isNotNull(), "is_truthful")})
    return rows.groupBy("example_id").agg(F.max_by(F.struct("label", "source"), order).alias("r")).select("example_id", "r.*")


def parquet_columns(spark: SparkSession, path: str, required: list[str], optional: dict[str, str]) -> DataFrame:
    """Required columns, and optional ones (name: type) as NULL where the files lack them. Only these are read."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*required, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])


def feature_roots(df: DataFrame) -> dict[str, list[str]]:
    """Columns named root_l<k>, by root, in order of layer; from the schema alone."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in df.columns:
        if m := re.fullmatch(r"(.+)_l(\d+)", c):
            found.setdefault(m[1], []).append((int(m[2]), c))
    return {k: [c for _, c in sorted(v)] for k, v in found.items()}


def common_roots(frames: list[DataFrame]) -> list[str]:
    """Roots that all frames have, in the order of the first."""
    roots = [feature_roots(f) for f in frames]
    return [r for r in roots[0] if all(r in other for other in roots[1:])] if roots else []


def newest(listing: DataFrame) -> DataFrame:
    """The preferred artifact of a listing: default ones first, then the newest."""
    return listing.orderBy(F.desc("is_default"), F.desc("modified"), "path").limit(1)


def vectors(spark: SparkSession, path: str, scale: DataFrame | None = None) -> DataFrame:
    """Vectors by layer and head; keys of the form layer_L_head_H are read; an optional multiplier for each site."""
    rows = spark.read.parquet(path)
    if "key" in rows.columns:
        pair = "^layer_(\\d+)_head_(\\d+)$"
        rows = rows.select(F.regexp_extract("key", pair, 1).cast("int").alias("layer"), F.regexp_extract("key", pair, 2).cast("int").alias("head"), "vec")
    if scale is None:
        return rows
    scaled = rows.join(scale.select("layer", "head", "scale"), ["layer", "head"], "left")
    return scaled.select("layer", "head", F.transform("vec", lambda x: x * F.coalesce("scale", F.lit(1.0))).alias("vec"))


def numbered_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """A row ordinal over an explicit order, for sources whose first row matters."""
    return df.withColumn("row_idx", F.row_number().over(Window.orderBy(*order)) - 1)
