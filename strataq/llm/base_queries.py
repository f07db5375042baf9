"""The thin queries of the operators that map or group single rows: 3, 5, 6, 7 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import chat_format, language_id, quality_rules, sharding, url_filters
from strataq.tables import table

#: A conversation whose texts hold control strings of a known chat template.
PROBE = "</s>[INST] ok [/INST]"


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(table(spark, sf_dir, "documents"))


def with_probe(turns: DataFrame) -> DataFrame:
    rows = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.format_chats(with_probe(table(spark, sf_dir, "conversations"))))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length('<|turn|><|text|><|end|>') + length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (op3_sharding, op5_chat_format, op6_url_filters, op7_language_id, op10_quality_rules)}
ORACLES = {"op5_chat_format": OP5_SQL}
