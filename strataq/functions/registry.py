"""The library's functions by name for SQL: scalar functions, and one that returns a table."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataq.functions.english import stems


@F.udtf(returnType="marker int, claim string")
class CitedClaims:
    """SELECT * FROM cited_claims(answer): each citation of an answer with the sentence it stands in."""

    def eval(self, answer: str | None) -> Iterator[tuple[int, str]]:
        for claim in re.split(r"(?<=[.!?])\s+", answer or ""):
            for marker in re.findall(r"\[(\d{1,3})\]", claim):
                yield int(marker), claim.strip()


#: SQL functions made of others, as (parameters, body); they stay in the JVM.
SQL_FUNCTIONS = {
    "strataq_tokens": ("text STRING", "INT", "CAST(ceil(length(text) / 4) AS INT)"),
    "strataq_lexemes": ("text STRING", "ARRAY<STRING>", "regexp_extract_all(lower(text), '\\\\p{L}+|\\\\p{N}+', 0)"),
    "strataq_rrf": ("position INT, weight DOUBLE", "DOUBLE", "coalesce(weight / (60 + position), 0.0)"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark.sql`` in this session."""
    spark.udf.register("strataq_stems", stems)
    spark.udtf.register("cited_claims", CitedClaims)
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

