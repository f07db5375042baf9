"""The thin query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm.packing import pack
from strataq.tables import table


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
