"""Searching a corpus as a whole: who may see what, the stored index, one search, and searches in several hops.

Everything works on any number of questions at once. A search that fails raises; one that finds nothing says so in a row of
its own, so that a broken search is never taken for an empty corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.config import DEFAULTS, Settings
from strataq.functions import english
from strataq.functions import text as T
from strataq.operators import retrieval as R
from strataq.operators import scope
from strataq.operators.audit import ledger
from strataq.operators.dml import keep_best
from strataq.tables import written

#: The most passages that one search returns, and the characters of each.
MOST_PASSAGES, PASSAGE_CHARS = 15, 4_000


def permitted(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """What each request (request_id, owner_id, requested) may search, as a relation: (request_id, document_id).

    Ready documents that nothing supersedes, public ones and the owner's own, narrowed to the requested ids where there are some. A
    request that may see nothing has no row: a missing list is never everything. This is the rule that the arms apply to scoped questions.
    """
    held = documents.where("superseded_by is null and status = 'ready'").select("document_id", F.col("owner_id").alias("holder"))
    q = asked.select(F.col("request_id").alias("question_id"), *scope.asked_columns(asked))
    frames = [scope.permissions(held, block) for block in R.question_blocks(q, R.MOST_VECTORS)] or [scope.permissions(held, [])]
    return R.united(frames).withColumnRenamed("question_id", "request_id")


def search(passages: DataFrame, chunks: DataFrame, questions: DataFrame, top_k: int = 6, settings: Settings = DEFAULTS) -> DataFrame:
    """One search for each question: the arms, reranking, neighbours, and numbers to cite.

    ``passages`` (doc_id, document_id, ordinal, text, embedding), ``chunks`` (document_id, ordinal, content) and ``questions``
    (question_id, question, vector, identifiers). Questions with owner_id and requested find only what they may see: ``passages`` are then
    those of :func:`strataq.operators.scope.searchable`, and neighbours are lines of documents that were found, so of no others. Rows
    question_id, found, marker, doc_id, relevance, content; a question without any passage has one row with found 0.
    """
    weighted = F.concat_ws(" ", "question", *[F.array_join("identifiers", " ")] * 2)
    found = R.hybrid(passages, questions.withColumn("question", weighted), settings)
    texts = passages.select("doc_id", "document_id", "ordinal", "text")
    rows = found.select("question_id", "doc_id", "position", "rrf").join(texts, "doc_id").join(questions.select("question_id", "question"), "question_id")
    best = R.rerank(rows, R.overlap_score(F.col("question"), F.col("text")), min(top_k, MOST_PASSAGES), settings.min_rerank_score)
    best = written(best.select("question_id", "doc_id", "document_id", "ordinal", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("position")), "best")
    seen = ledger(best.select("question_id", F.col("doc_id").alias("chunk_id"), F.col("position").alias("arrival"), "score"), "question_id")
    whole = R.expand_neighbours(best, chunks, settings.neighbour_window).join(seen.select("question_id", F.col("chunk_id").alias("doc_id"), "marker"), ["question_id", "doc_id"])
    rows = whole.withColumn("found", F.count("*").over(W.partitionBy("question_id")))
    content = F.substring("expanded", 1, PASSAGE_CHARS)
    return questions.select("question_id").join(rows.select("question_id", "found", "marker", "doc_id", F.round("score", 3).alias("relevance"), content.alias("content")), "question_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages (question_id, marker, ...) that an answer (question_id, answer) cites, in the order of their markers.

    Markers beyond the passages that a question has are no citations.
    """
    most = passages.groupBy("question_id").agg(F.max("marker").alias("most"))
    cited = answers.join(most, "question_id").select("question_id", F.explode(T.markers(F.col("answer"), F.col("most"))).alias("marker"))
    return cited.join(passages, ["question_id", "marker"]).withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("marker")))


def in_hops(questions: DataFrame, find: Callable[[DataFrame, int], DataFrame], grade: Callable[[DataFrame], DataFrame], most: int = DEFAULTS.max_hops) -> DataFrame:
    """What all hops of each question found, the best score of each passage and the hop it came from first.

    ``find(questions, hop)`` returns question_id, doc_id, score; ``grade(rows)`` returns question_id, sufficient, refined. A question
    goes on with its refined wording while it isn't answered sufficiently and has one, ``most`` hops at the most.
    """
    pool = None
    for hop in range(most):
        rows = written(find(questions, hop).select("question_id", "doc_id", "score", F.lit(hop).alias("hop")), "hop")
        pool = rows if pool is None else written(keep_best(pool.unionByName(rows).withColumn("found", F.struct("question_id", "doc_id")), "found", "score", "hop").drop("found"), "pool")
        if hop + 1 == most:
            break
        again = grade(rows).where("not sufficient and refined is not null and trim(refined) <> ''").select("question_id", F.col("refined").alias("question"))
        questions = written(questions.drop("question").join(again, "question_id"), "refined")
        if questions.isEmpty():
            break
    return pool


def scored_by(scorer: Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]]) -> Callable[[Column, Column], Column]:
    """A reranker's column function from any model: an iterator over batches of (questions, texts) that yields logits.

    The iterator form loads a model once for each task; the scores are the logits' sigmoids.
    """

    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from scorer(batches)

    logits.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    model = F.pandas_udf(logits, "double")
    return lambda question, text: F.round(1 / (1 + F.exp(-model(question, text))), 6)


def overlap_logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Logits without a model: ten times the share of the question's words in the text, less five."""
    word = re.compile(r"[^\W\d_]+|\d+")
    for questions, texts in batches:
        asked = [set(word.findall(q.lower())) for q in questions]
        yield pd.Series([10.0 * len(q & set(word.findall((t or "").lower()))) / max(len(q), 1) - 5 for q, t in zip(asked, texts, strict=True)])


def keep_fused_order(rows: DataFrame, top_n: int = DEFAULTS.rerank_top_n) -> DataFrame:
    """The last resort without any reranker: the order of the fusion, its score as the reranker's."""
    return rows.where(F.col("position") <= top_n).withColumns({"rerank_score": F.col("rrf"), "rerank_rank": F.col("position")})


def may_store(answers: DataFrame, enabled: bool = True) -> DataFrame:
    """The answers (scope_ids, answer, citations, turns) that a cache may keep.

    It has to be on, and each answer non-blank, with a citation, about some documents and its conversation's only turn.
    """
    return answers.where(F.lit(enabled) & (F.size("scope_ids") > 0) & (F.trim("answer") != "") & (F.col("citations") >= 1) & (F.col("turns") == 1))


def dense_share(dense_rank: Column, sparse_rank: Column, rrf_k: int = DEFAULTS.rrf_k) -> Column:
    """The dense arm's part of what both arms gave; null if neither did."""
    dense, sparse = (F.coalesce(1 / (rrf_k + rank), F.lit(0.0)) for rank in (dense_rank, sparse_rank))
    return F.when(dense + sparse > 0, F.round(dense / (dense + sparse), 6))


def refused(answer: Column) -> Column:
    """Whether an answer says that the sources have nothing on the question."""
    return F.lower(answer).rlike(REFUSAL)


def as_expected(answer: Column, absent: Column, wanted: Column) -> Column:
    """A question that the corpus can't answer is to be refused; else all wanted strings are to be in the answer, case ignored."""
    low = F.lower(answer)
    return F.coalesce(F.when(absent, refused(answer)).otherwise(F.forall(F.coalesce(wanted, F.array().cast("array<string>")), lambda w: low.contains(F.lower(w)))), F.lit(False))


# Wordings that count as a refusal.
REFUSAL = r"not (say|cover|contain|include)|does not|no information|isn't in|is not in"
