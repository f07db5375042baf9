"""Ranking arms, their fusion, and what follows it, for batches of questions.

Questions are a stated set: (question_id, and text, vector or identifiers). They go to every task in blocks, one of which is on
the driver at a time; each arm keeps its best ``candidates`` per question by a ranking window that
Spark limits before the shuffle, so what is shuffled is bounded by questions times candidates per task.

Questions with an owner_id (and requested documents) are scoped: every arm leaves out what they may not see while it scans, and
asks passages for document_id and holder. See :mod:`strataq.operators.scope`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.config import DEFAULTS, Settings
from strataq.functions import text as T
from strataq.functions.english import content_words
from strataq.operators import scope
from strataq.tables import small_batches, written

MOST_BROADCAST = 100_000
#: Questions in one batch whose vectors or words go to every task.
MOST_VECTORS = 10_000
#: Cells (8 bytes each) of the matrix of words by questions that goes to every task, and of one batch's documents by words.
MOST_CELLS, BATCH_CELLS = 5_000_000, 2_000_000


def sent(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast ``small`` if it has few rows; else leave the join to Spark."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def scoped(rows: DataFrame, ids: Sequence | None, column: str = "doc_id") -> DataFrame:
    """Rows of the given documents; None is the whole corpus, an empty list is nothing."""
    if ids is None:
        return rows
    return rows.where(F.col(column).isin(list(ids))) if ids else rows.where(F.lit(False))


def visible(rows: DataFrame, owner: str | None) -> DataFrame:
    """Rows that everyone sees and the owner's own."""
    return rows.where(F.col("owner_id").isNull() | F.col("owner_id").eqNullSafe(F.lit(owner)))


def ranked(rows: DataFrame, score: str, limit: int, rank: str = "rank", key: str = "doc_id") -> DataFrame:
    order = W.partitionBy("question_id").orderBy(F.desc(score), key)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= limit)


def in_blocks(rows: list, most: int) -> list[list]:
    """Questions are independent, so any number of them is asked in blocks of ``most``; each block goes to every task."""
    return [rows[k : k + most] for k in range(0, len(rows), most)]


def word_blocks(rows: list, most: int, cells: int) -> Iterator[list]:
    """Blocks whose matrix of words by questions has at most ``cells`` cells (a single question may have more)."""
    block, words = [], set()
    for r in rows:
        if block and (len(block) == most or (len(words) + sum(w not in words for w in r.words)) * (len(block) + 1) > cells):
            yield block
            block, words = [], set()
        block.append(r)
        words |= set(r.words)
    if block:
        yield block


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold about ``limit`` bytes of text each (a longer text alone), so that what is made of them stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def question_blocks(asked: DataFrame, most: int) -> Iterator[list]:
    """The questions in blocks of ``most``; where there are more, they are dealt by a hash and one block is read at a time."""
    few = asked.limit(most + 1).collect()
    if len(few) <= most:
        yield from in_blocks(few, most)
        return
    n = -(-2 * asked.count() // most)  # twice the blocks that would do, as hashing fills them unevenly
    dealt = written(asked.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(n))), "questions")
    for k in range(n):
        yield from in_blocks(dealt.where(F.col("block") == k).drop("block").collect(), most)


def by_blocks(blocks: Iterator[list], score: Callable[[list], tuple[DataFrame, Broadcast]]) -> list[DataFrame]:
    """What ``score`` finds for each block. With several of them, each result is written and what was sent for it is given back."""
    done: list[DataFrame] = []
    frame, sent = None, None
    for block in blocks:
        if frame is not None:
            done.append(written(frame, "scored"))
            sent.destroy()
        frame, sent = score(block)
    return done if frame is None else [*done, written(frame, "scored") if done else frame]


def best_of_batch(ids: np.ndarray, scores: np.ndarray, asked: np.ndarray, candidates: int) -> pa.RecordBatch:
    """(question_id, doc_id, score) of each question's best in a batch (scores: documents by questions; below 0: no hit).

    All that could be among the ``candidates`` best after rounding to 6 digits are kept, so ranking stays exact.
    """
    if len(ids) > candidates:
        least = np.partition(scores, len(ids) - candidates, axis=0)[len(ids) - candidates]
        keep = (scores >= least - 2e-6) & (scores > -1.5)
    else:
        keep = scores > -1.5
    rows, columns = np.nonzero(keep)
    if len(rows) > 2 * candidates * len(asked):  # of many copies, which score alike, the first ones by id
        order = np.lexsort((ids[rows], scores[rows, columns], columns))
        rows, columns = rows[order], columns[order]
        value = scores[rows, columns]
        first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (columns[1:] != columns[:-1])]))
        among = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < candidates
        rows, columns = rows[among], columns[among]
    return pa.RecordBatch.from_arrays([pa.array(asked[columns], pa.int64()), pa.array(ids[rows], pa.int64()), pa.array(scores[rows, columns], pa.float64())], ["question_id", "doc_id", "score"])


def dense_arm(passages: DataFrame, questions: DataFrame, candidates: int = DEFAULTS.candidates) -> DataFrame:
    """question_id, doc_id, dense_score (cosine, 6 digits), dense_rank; passages without a vector are not seen.

    Exact: each batch of passages is one matrix product with the questions, and only its best rows are shuffled.
    """
    asked = questions.where("vector is not null").select("question_id", "vector", *scope.asked_columns(questions))
    frames = by_blocks(question_blocks(asked, MOST_VECTORS), lambda block: _dense_scores(passages, block, candidates))
    if not frames:
        return passages.sparkSession.createDataFrame([], "question_id long, doc_id long, dense_score double, dense_rank int")
    scored = united(frames)
    return ranked(scored.select("question_id", "doc_id", F.round("score", 6).alias("dense_score")), "dense_score", candidates, "dense_rank")


def scope_of(asked: list) -> scope.Scope | None:
    return scope.Scope(asked) if asked and "owner_id" in asked[0] else None


def within(scores: np.ndarray, part: pa.RecordBatch, seen: scope.Scope | None) -> np.ndarray:
    """``scores`` of a batch, below any score where a question may not see the row."""
    return scores if seen is None else np.where(seen.allowed(part.column("document_id"), part.column("holder")), scores, -2.0)


def _dense_scores(passages: DataFrame, asked: list, candidates: int) -> tuple[DataFrame, Broadcast]:
    seen = scope_of(asked)
    sent = passages.sparkSession.sparkContext.broadcast((np.array([r.question_id for r in asked], np.int64), unit(np.array([r.vector for r in asked], np.float64)), seen))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, seen = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield best_of_batch(part.column("doc_id").to_numpy(), within(unit(vectors(part.column("embedding"))) @ wanted.T, part, seen), names, candidates)

    return passages.where("embedding is not null").select("doc_id", "embedding", *(scope.HELD if seen else ())).mapInArrow(score, "question_id long, doc_id long, score double"), sent


def vectors(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of length 0 stays, so its cosine with anything is 0."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def lexical_arm(passages: DataFrame, questions: DataFrame, candidates: int = DEFAULTS.candidates, text: str = "text", words: Callable[[Column], Column] = content_words) -> DataFrame:
    """Passages with any of a question's words, by n / (n + 10) for n matching positions.

    That is cover density for a pure OR query. ``words`` makes a text's words: without stop words, or their stems too
    (:func:`strataq.functions.english.english`).
    """
    asked = questions.select("question_id", F.array_distinct(words(F.col("question"))).alias("words"), *scope.asked_columns(questions))
    # which words of a passage are stop words doesn't matter: no question asks for one
    own = T.lexemes if words is content_words else words
    held = passages.select("doc_id", F.coalesce(own(F.col(text)), F.array().cast("array<string>")).alias("words"), *(scope.HELD if scope.is_scoped(questions) else ()))
    return best_lexical(held, asked, candidates)


def best_lexical(held: DataFrame, asked: DataFrame, candidates: int = DEFAULTS.candidates) -> DataFrame:
    """The lexical arm on the words of passages (doc_id, words) and questions (question_id, words)."""
    n = lambda counts, _: counts
    blocks = (part for block in question_blocks(asked, MOST_VECTORS) for part in word_blocks(block, MOST_VECTORS, MOST_CELLS))
    frames = by_blocks(blocks, lambda block: _word_scores(held, block, candidates, n, lambda n: n / (n + 10)))
    scored = united(frames or [_word_scores(held, [], candidates, n, n)[0]])
    return ranked(scored.select("question_id", "doc_id", F.round("score", 6).alias("sparse_score")), "sparse_score", candidates, "sparse_rank")


def _word_scores(held: DataFrame, asked: list, candidates: int, weight: Callable, score: Callable, worth: dict[str, float] | None = None) -> tuple[DataFrame, Broadcast]:
    """(question_id, doc_id, score): each batch's best for each question.

    The counts of the questions' words, documents by words, are weighted (``weight`` of counts and lengths), multiplied with
    the words that each question has, each as much as it is ``worth``, and scored; only the batch's best rows are shuffled.
    """
    vocabulary = sorted({w for r in asked for w in r.words})
    place = {w: i for i, w in enumerate(vocabulary)}
    names = np.array([r.question_id for r in asked], np.int64)
    has = np.zeros((len(vocabulary), len(asked)))
    for j, r in enumerate(asked):
        has[[place[w] for w in r.words], j] = [worth.get(w, 0.0) for w in r.words] if worth else 1
    sent_words = held.sparkSession.sparkContext.broadcast((vocabulary, has, scope_of(asked)))
    rows = max(1, BATCH_CELLS // max(1, len(vocabulary)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix, seen = sent_words.value
        known, any_of = pa.array(words, pa.string()), (matrix != 0).astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("words")
                index, lengths = pc.index_in(lists.flatten(), value_set=known), np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(lists)), lengths)
                hit = index.is_valid().to_numpy(zero_copy_only=False)
                cells = owner[hit] * len(words) + index.drop_null().to_numpy()
                counts = np.bincount(cells, minlength=len(lists) * len(words)).reshape(len(lists), len(words)).astype(np.float64)
                found = (counts > 0).astype(np.float32) @ any_of > 0
                yield best_of_batch(part.column("doc_id").to_numpy(), within(np.where(found, score(weight(counts, lengths[:, None]) @ matrix), -2.0), part, seen), names, candidates)

    return small_batches(held).mapInArrow(scan, "question_id long, doc_id long, score double"), sent_words


def identifier_hits(passages: DataFrame, identifiers: list[str], text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ``carried``, identifier) for each identifier that a text holds (case ignored; ``_`` and ``%`` are wildcards).

    Each text is read once, whatever the number of identifiers: an Aho-Corasick automaton finds the parts between
    wildcards, and only where all parts of an identifier occur is its pattern tried.
    """
    parts, names = {i: [p for p in re.split("[_%]+", i.lower()) if p] for i in identifiers}, ["doc_id", *carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick  # needed by this arm alone

        automaton, owners = ahocorasick.Automaton(), defaultdict(set)
        for i, own in parts.items():
            for p in own:
                owners[p].add(i)
        for p in owners:
            automaton.add_word(p, p)
        if owners:
            automaton.make_automaton()
        any_of = [i for i, own in parts.items() if not own]  # nothing but wildcards
        pattern = {i: re.compile("".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in i.lower()), re.S) for i in parts}
        for batch in by_bytes(batches, "held"):
            out = []
            for k, held in enumerate(batch.column("held").to_pylist()):
                if held is None:
                    continue
                low = held.lower()
                there = {p for _, p in automaton.iter(low)} if owners else set()
                near = {i for p in there for i in owners[p] if all(x in there for x in parts[i])}
                out += [(k, i) for i in sorted([*near, *any_of]) if ("_" not in i and "%" not in i) or pattern[i].search(low)]
            columns = [batch.column(c).take(pa.array([k for k, _ in out], pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([i for _, i in out], pa.string())], [*names, "identifier"])

    schema = passages.select(*names).withColumn("identifier", F.lit("")).schema
    return small_batches(passages).select(*names, F.col(text).alias("held")).mapInArrow(scan, schema)


def asked_identifiers(questions: DataFrame) -> DataFrame:
    """(question_id, identifier, ...) for each different identifier of 2 to 64 characters."""
    ids = F.filter(F.transform("identifiers", lambda i: F.trim(i)), lambda i: F.length(i).between(2, 64))
    return questions.select("question_id", F.explode(F.array_distinct(ids)).alias("identifier"), *scope.asked_columns(questions))


def identifier_arm(passages: DataFrame, questions: DataFrame, candidates: int = DEFAULTS.candidates, text: str = "text") -> DataFrame:
    """Passages that hold a question's identifiers (2 to 64 characters), by how many."""
    q = asked_identifiers(questions)
    carried = scope.HELD if scope.is_scoped(questions) else ()
    names = q.select("identifier").distinct().withColumnRenamed("identifier", "question_id")
    frames = [identifier_hits(passages, [r[0] for r in block], text, carried) for block in question_blocks(names, MOST_BROADCAST)]
    if not frames:  # no text has to be read
        return passages.sparkSession.createDataFrame([], "question_id long, doc_id long, ident_score int, ident_rank int")
    return by_hits(united(frames), q, candidates)


def by_hits(found: DataFrame, asked: DataFrame, candidates: int) -> DataFrame:
    """The identifier arm's ranks from (doc_id, identifier) and what was asked, within each question's scope."""
    pairs = found.join(sent(asked), "identifier")
    hits = (pairs.where(scope.may_see()) if scope.is_scoped(asked) else pairs).groupBy("question_id", "doc_id").agg(F.count("*").cast("int").alias("ident_score"))
    return ranked(hits, "ident_score", candidates, "ident_rank")


def fuse(arms: dict[str, tuple[DataFrame, float]], rrf_k: int = DEFAULTS.rrf_k, limit: int = 40) -> DataFrame:
    """Weighted reciprocal rank fusion of arms {name: (frame, weight)}; a missing arm adds nothing and stays null.

    A union and one grouping, which for arms of unique ids equals the chain of full outer joins.
    """
    rows = None
    for name, (arm, _) in arms.items():
        own = arm.select("question_id", "doc_id", *(F.col(f"{n}_{c}").cast(t).alias(f"{n}_{c}") if n == name else F.lit(None).cast(t).alias(f"{n}_{c}") for n in arms for c, t in (("rank", "int"), ("score", "double"))))
        rows = own if rows is None else rows.unionByName(own)
    one = rows.groupBy("question_id", "doc_id").agg(*(F.max(f"{n}_{c}").alias(f"{n}_{c}") for n in arms for c in ("rank", "score")))
    rrf = sum((F.coalesce(F.lit(w) / (rrf_k + F.col(f"{n}_rank")), F.lit(0.0)) for n, (_, w) in arms.items()), F.lit(0.0))
    return ranked(one.withColumn("rrf", F.round(rrf, 9)), "rrf", limit, "position")


def hybrid(passages: DataFrame, questions: DataFrame, settings: Settings = DEFAULTS, limit: int = 40) -> DataFrame:
    """The three arms, fused; ids only: texts are joined to the few rows that remain."""
    n = settings.candidates
    return fuse({
        "dense": (dense_arm(passages, questions, n), settings.dense_weight),
        "sparse": (lexical_arm(passages, questions, n), settings.sparse_weight),
        "ident": (identifier_arm(passages, questions, n), settings.identifier_weight),
    }, settings.rrf_k, limit)


def fuse_queries(rows: DataFrame, rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Unweighted fusion over sub-queries: rows question_id, query, arrival, position, doc_id, rrf, scores.

    A question with a single sub-query keeps its own rrf. ``via`` lists the sub-queries that found a passage, and ``first_rank`` is
    the place it had in the first of them to arrive.
    """
    single = F.size(F.collect_set("query").over(W.partitionBy("question_id"))) == 1
    fused = rows.withColumn("single", single).groupBy("question_id", "doc_id").agg(
        F.round(F.when(F.first("single"), F.max("rrf")).otherwise(F.sum(1 / (rrf_k + F.col("position")))), 9).alias("rrf"),
        F.array_join(F.array_sort(F.collect_set("query")), "|").alias("via"),
        F.nullif(F.max(F.coalesce("dense_score", F.lit(0.0))), F.lit(0.0)).alias("dense_score"),
        F.nullif(F.max(F.coalesce("sparse_score", F.lit(0.0))), F.lit(0.0)).alias("sparse_score"), F.min_by("position", "arrival").alias("first_rank"),
    )
    return fused.withColumn("position", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("rrf"), "doc_id")))


def expand_neighbours(found: DataFrame, chunks: DataFrame, window: int = DEFAULTS.neighbour_window) -> DataFrame:
    """found (…, document_id, ordinal) with ``expanded``: the neighbours' content, in order, by blank lines."""
    want = found.withColumn("at", F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window))).where("at >= 0")
    near = want.join(chunks.select("document_id", F.col("ordinal").alias("at"), "content"), ["document_id", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n\n")
    return near.groupBy(*found.columns).agg(text.alias("expanded"))


def expand_every(chunks: DataFrame, window: int = DEFAULTS.neighbour_window) -> DataFrame:
    """Each chunk's (document_id, ordinal) with ``expanded`` as above; contents are shuffled once, however wide the window."""
    near = W.partitionBy("document_id").orderBy("ordinal").rangeBetween(-window, window)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content")).over(near)), lambda x: x["content"]), "\n\n")
    return chunks.select("document_id", "ordinal", text.alias("expanded"))


def fit_budget(rows: DataFrame, text: str = "text", budget: int = DEFAULTS.budget_tokens) -> DataFrame:
    """The unbroken run of first passages whose tokens fit; the first one always stays."""
    upto = W.partitionBy("question_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("tokens", T.tokens(F.col(text))).withColumn("running", F.sum("tokens").over(upto))
    rows = rows.withColumn("broken", F.max(F.when((F.col("running") > budget) & (F.col("position") > 1), 1).otherwise(0)).over(upto))
    return rows.where("broken = 0").drop("broken")


def attention_order(position: Column, n: Column) -> Column:
    """Place of the ranked passage 1..n: odd ranks go to the front in order, even ones to the end, reversed."""
    return F.when(n <= 2, position).when(position % 2 == 1, (position + 1) / 2).otherwise(n + 1 - position / 2).cast("int")


def diversify(rows: DataFrame, k: int = DEFAULTS.context_chunks, lam: float = DEFAULTS.mmr_lambda) -> DataFrame:
    """Maximal marginal relevance: rows question_id, doc_id, position, score, embedding; ``picked`` from 1.

    Greedy over the tens of candidates of one question; questions are independent groups.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "doc_id"], kind="stable").reset_index(drop=True)
        has = pdf.embedding.notna().to_numpy()
        if len(pdf) <= k or not has.any():
            chosen = list(range(min(k, len(pdf))))
        else:
            vectors = np.zeros((len(pdf), len(pdf.embedding[has.argmax()])))
            vectors[has] = np.stack(pdf.embedding[has].to_list())
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
            relevance = pdf.score.to_numpy(float) / max(pdf.score.max(), 1e-9)
            near, chosen = np.full(len(pdf), -np.inf), []
            while len(chosen) < k:
                value = lam * relevance - (1 - lam) * np.where(np.isfinite(near), near, 0)
                value[chosen] = -np.inf
                chosen.append(int(value.argmax()))
                near = np.maximum(near, np.where(has & has[chosen[-1]], vectors @ vectors[chosen[-1]], 0))
        out = pdf.loc[chosen, ["question_id", "doc_id", "score"]]
        return out.assign(picked=np.arange(1, len(out) + 1, dtype=np.int32))

    return rows.select("question_id", "doc_id", "position", "score", "embedding").groupBy("question_id").applyInPandas(pick, "question_id long, doc_id long, score double, picked int")


def overlap_score(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's words that the text has."""
    q = F.array_distinct(T.lexemes(question))
    return F.round(F.size(F.array_intersect(q, T.lexemes(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(rows: DataFrame, score: Column, top_n: int = DEFAULTS.rerank_top_n, floor: float = DEFAULTS.min_rerank_score) -> DataFrame:
    """The best ``top_n`` by score that reach the floor; the single best if none does. A lone candidate scores 1."""
    alone = F.count("*").over(W.partitionBy("question_id")) == 1
    rows = rows.withColumn("rerank_score", F.when(alone, 1.0).otherwise(score))
    rows = rows.withColumn("rerank_rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("rerank_score"), "position")))
    return rows.where((F.col("rerank_rank") <= top_n) & ((F.col("rerank_score") >= floor) | (F.col("rerank_rank") == 1)))


def rerank_listwise(rows: DataFrame, scores: DataFrame, top_n: int = DEFAULTS.rerank_top_n, floor: float = DEFAULTS.min_rerank_score) -> DataFrame:
    """Scores joined by position (missing: 0) with the same floor; if none survives, the first ``top_n`` without a score."""
    joined = rows.join(scores, ["question_id", "position"], "left").withColumn("given", F.coalesce("given", F.lit(0.0)))
    joined = joined.withColumn("any", F.max("given").over(W.partitionBy("question_id")) >= floor)
    order = W.partitionBy("question_id").orderBy(F.desc(F.when(F.col("any"), F.col("given"))), "position")
    joined = joined.withColumn("rerank_rank", F.row_number().over(order)).where((F.col("rerank_rank") <= top_n) & (~F.col("any") | (F.col("given") >= floor)))
    return joined.withColumn("rerank_score", F.when(F.col("any"), F.col("given"))).drop("any", "given")


def rerank_text(title: Column, path: Column, context: Column, content: Column, budget: int = DEFAULTS.rerank_chars) -> Column:
    """Breadcrumb, context and the content cut to what is left of the budget (200 characters at least)."""
    head = F.concat_ws("\n", T.breadcrumb(title, path), F.nullif(context, F.lit("")))
    return F.concat_ws("\n", head, F.substr(content, F.lit(1), F.greatest(F.lit(200), budget - F.length(head))))


def bm25(passages: DataFrame, questions: DataFrame, limit: int = DEFAULTS.candidates, k1: float = 1.2, b: float = 0.75, text: str = "text") -> DataFrame:
    """BM25 of each question's words: the passages' words are stored once, counted for each block of questions, then batches are scored.

    Passages that come with stored ``words`` aren't read as text at all.
    """
    carried = scope.HELD if scope.is_scoped(questions) else ()
    own = "words" if "words" in passages.columns else F.coalesce(T.lexemes(F.col(text)), F.array().cast("array<string>")).alias("words")
    held = written(passages.select("doc_id", own, *carried), "words")
    docs, mean = held.agg(F.count("*"), F.avg(F.size("words"))).first()
    q = questions.select("question_id", F.array_distinct(T.lexemes(F.col("question"))).alias("words"), *scope.asked_columns(questions))

    def weight(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return counts * (k1 + 1) / (counts + k1 * (1 - b + b * lengths / max(mean or 0, 1e-9)))

    def score(block: list) -> tuple[DataFrame, Broadcast]:
        df = document_counts(held, sorted({w for r in block for w in r.words}))
        return _word_scores(held, block, limit, weight, lambda x: x, {w: math.log(1 + (docs - n + 0.5) / (n + 0.5)) for w, n in df.items()})

    frames = by_blocks((part for block in question_blocks(q, MOST_VECTORS) for part in word_blocks(block, MOST_VECTORS, MOST_CELLS)), score)
    scored = united(frames or [_word_scores(held, [], limit, weight, lambda x: x)[0]])
    return ranked(scored.select("question_id", "doc_id", F.round("score", 6).alias("bm25")), "bm25", limit)


def document_counts(held: DataFrame, words: list[str]) -> dict[str, int]:
    """How many rows have each of some ``words``, counted by task."""
    sent_words = held.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent_words.value, pa.string())
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                lists = batch.column("words").slice(at, 500)
                index = pc.index_in(lists.flatten(), value_set=known)
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[index.is_valid().to_numpy(zero_copy_only=False)]
                total += np.bincount(np.unique(owner * len(known) + index.drop_null().to_numpy()) % max(len(known), 1), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["word", "n"])

    rows = held.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r.word]: r.n for r in rows}


def probe_cache(questions: DataFrame, cached: DataFrame, floor: float = DEFAULTS.cache_floor) -> DataFrame:
    """The nearest cached answer with the same owner, mode and scope, if it is near enough.

    The questions go to every task in blocks; a batch of answers is one matrix product for each owner, mode and scope in it,
    and only the batch's nearest answers of each question are shuffled.
    """
    group = lambda owner, mode, scope: F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("+"), owner), F.lit("-")), mode, scope)
    asked = questions.where("vector is not null and mode is not null and scope_key is not null").select("question_id", "vector", group("owner_id", "mode", "scope_key").alias("group"))
    held = cached.where("cached_vector is not null and cached_mode is not null and cached_scope is not null").select("cached_id", "cached_vector", group("cached_owner", "cached_mode", "cached_scope").alias("group"))
    frames = by_blocks(question_blocks(asked, MOST_VECTORS), lambda block: _nearest(held, block))
    kinds = [questions.schema["question_id"].dataType, cached.schema["cached_id"].dataType]
    if not frames:
        return cached.sparkSession.createDataFrame([], "question_id long, cached_id long, similarity double").select(F.col("question_id").cast(kinds[0]), F.col("cached_id").cast(kinds[1]), "similarity")
    best = W.partitionBy("question_id").orderBy(F.desc("similarity"), "cached_id")
    scored = united(frames).select(F.col("question_id").cast(kinds[0]), F.col("cached_id").cast(kinds[1]), F.round("similarity", 6).alias("similarity"))
    return scored.withColumn("rn", F.row_number().over(best)).where((F.col("rn") == 1) & (F.col("similarity") >= floor)).drop("rn")


def _nearest(held: DataFrame, asked: list) -> tuple[DataFrame, Broadcast]:
    places: dict[str, list[int]] = defaultdict(list)
    for k, r in enumerate(asked):
        places[r.group].append(k)
    names, wanted = np.array([r.question_id for r in asked], np.int64), unit(np.array([r.vector for r in asked], np.float64))
    sent_questions = held.sparkSession.sparkContext.broadcast((names, wanted, dict(places)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, places = sent_questions.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own_vectors = unit(vectors(part.column("cached_vector")))
                ids, groups = part.column("cached_id").cast(pa.int64()).to_numpy(), part.column("group").dictionary_encode()
                index = groups.indices.to_numpy()
                for k, name in enumerate(groups.dictionary.to_pylist()):
                    if own := places.get(name):
                        rows = np.flatnonzero(index == k)
                        found = best_of_batch(ids[rows], own_vectors[rows] @ wanted[own].T, names[own], 1)
                        yield found.rename_columns(["question_id", "cached_id", "similarity"])

    return held.mapInArrow(scan, "question_id long, cached_id long, similarity double"), sent_questions


def scope_key(ids: Column) -> Column:
    """A digest of a set of ids; their order doesn't matter."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 32)
