"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents, whatever their names. A row with a null doc_id can't be named as a copy
or as a leak and stays; a null text has no letter, so language ID drops it. :func:`run` writes each stage's result to shared storage, as the
next one's input, so a lost executor costs at most part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import decontamination, language_id, ngram_join, packing, suffix_dedup
from strataq.llm.textblocks import named
from strataq.tables import discard, table, written

#: Cosine with the best language below which a text counts as none of them. Measured on 3,358 held-out documents of sf0.1 and on
#: their shapes filled with random letters: the lowest cosine of a document is 0.090 (four letters), the median of random letters 0.06.
MIN_SCORE = 0.08
#: Ids that are broadcast to be left out; more of them are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Texts in one batch that an executor hands to a Python worker: both hold it in memory beside Spark's own heap.
BATCH_ROWS = 1_000


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with the session set to hand over small batches while its result is computed."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``dropped``; a null doc_id stays."""
    dropped = written(dropped.select(F.col("doc_id").alias("dropped doc_id")).distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped, docs["doc_id"] == dropped["dropped doc_id"], "left_anti")


@in_small_batches
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that are like none of the languages learned."""
    names, protos = language_id.learn(docs.where(language_id.fold_of(F.col("doc_id")) != 1))
    # a struct, so that no name clashes; the text goes beside it, once
    record = F.struct(*(named(docs, c) for c in docs.columns if c != "text")).alias("record")
    told = language_id.predict(docs.select(record, "text"), names, protos, ["record", "text"])
    kept = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*(F.col("text") if c == "text" else F.col("record")[c].alias(c) for c in docs.columns))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of linked ones."""
    found = ngram_join.ngram_join(docs)
    return without(docs, found.where("doc_id != component_id"))


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes that repeat earlier ones; a document of which nothing is left but white space goes."""
    done = suffix_dedup.suffix_dedup(docs, text=True)
    left = F.col("kept")
    cut = F.col("n_removed") > 0
    columns = {c: F.col("record")[c] for c in docs.columns if c != "text"}
    columns |= {"text": F.when(cut, left).otherwise(F.col("whole"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return done.where(~cut | (F.regexp_replace(left, r"\s+", "") != "")).select(*(columns[c].alias(c) for c in docs.columns))


@in_small_batches
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or enough of it."""
    return without(docs, decontamination.contaminated_pairs(docs, table(spark, sf_dir, "benchmark")))


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [("language_id", languages), ("ngram_join", near_duplicates), ("suffix_dedup", repeated_passages), ("decontamination", benchmark_leaks), ("packing", packed)]

#: SQL can express neither the language profiles nor the tokens; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
