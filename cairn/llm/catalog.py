"""The queries of this subpackage: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, mixing, neighbours, secrets, sharding, simhash, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER_FILE))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = tokenizer_path()
    return chat.read_back(chat.format_chats(chats.unionByName(extra), path), path)


def _chat_oracle() -> str:
    rest = "|".join("".join(f"\\{c}" if c in "|[]" else c for c in s[1:]) for s in chat.CONTROL)
    escaped = lambda c: f"len(regexp_replace({c}, '([<\\[])(\\\\*(?:{rest}))', '\\1#\\2', 'g'))"
    return f"""
WITH said AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
whole AS (
  SELECT conv_id, COUNT(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
    COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{chat.LOSS_ROLE}'), '') AS loss,
    SUM({escaped('role')} + {escaped('text')} + {sum(map(len, chat.MARKS))}) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM whole
"""


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_secret_scan": op3_secret_scan,
        "op4_sharding": op4_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_token_output": op7_token_output,
        "op8_language_id": op8_language_id,
        "op9_simhash": op9_simhash,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.oracle(), "op6_mixing": mixing.ORACLE, "op10_chat_format": _chat_oracle()}
