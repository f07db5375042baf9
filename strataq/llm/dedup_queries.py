"""The thin queries of the operators that compare documents or vectors: 1, 2 and 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import embedding_dedup, ngram_join, suffix_dedup
from strataq.tables import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, vec_id, e FROM v WHERE coalesce(len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0, false)),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT r, r AS s FROM v UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.s)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r)::BIGINT AS n_links, m.component_id, coalesce(v.vec_id = m.component_id, false) AS kept
FROM v JOIN (SELECT c.r, min(vec_id) AS component_id FROM c JOIN v ON v.r = c.s GROUP BY c.r) m USING (r)
"""

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op13_embedding_dedup)}
ORACLES = {"op13_embedding_dedup": OP13_SQL}
