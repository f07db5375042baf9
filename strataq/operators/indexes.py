"""Stored indexes: vectors by cells, words by blocks of documents, identifiers by trigrams.

Each is written once and read by what a question needs: the cells near it, the blocks that can still hold one of its best
passages, the texts that have all of an identifier's rarest trigrams.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.config import DEFAULTS
from strataq.functions import english
from strataq.operators import retrieval as R
from strataq.operators import scope
from strataq.tables import small_batches, written

# ---- vectors

#: Vectors that centroids are fitted on, and centroids: both are bounded, whatever the size of the corpus.
MOST_SAMPLE, MOST_CELLS = 50_000, 4_096
#: Cells that a question looks into, and how many times as many if it is scoped (at most ``MOST_PROBES``).
PROBES, SCOPED_PROBES, MOST_PROBES = 8, 4, 800


def centroids(passages: DataFrame, cells: int | None = None, sample: int = MOST_SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centroids by k-means with cosines, fitted on the ``sample`` vectors that a hash puts first.

    ``cells`` is by default the square root of the number of vectors, ``MOST_CELLS`` at the most.
    """
    held = usable(passages)
    n = held.count()
    k = max(1, min(cells or int(n**0.5), MOST_CELLS, n))
    some = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if k < 2:  # k-means takes two centroids at least
        return R.unit(np.array([r.features.toArray() for r in some.limit(k).collect()] or np.zeros((1, 1))))
    model = KMeans(k=k, maxIter=rounds, seed=1, distanceMeasure="cosine").fit(written(some, "sample"))
    return R.unit(np.array(model.clusterCenters()))


def usable(passages: DataFrame) -> DataFrame:
    """Passages whose vector has a direction; the others are near nothing."""
    return passages.where(F.coalesce(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))


def write_vectors(passages: DataFrame, path: str, cells: int | None = None, sample: int = MOST_SAMPLE) -> None:
    """Stores every passage (doc_id, embedding, and what else it has) below its nearest centroid's cell, and the centroids beside them."""
    spark, middle = passages.sparkSession, centroids(passages, cells, sample)
    sent = spark.sparkContext.broadcast(middle)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((R.unit(np.stack(vectors.to_numpy()).astype(np.float64)) @ sent.value.T).argmax(axis=1))

    # a cell with a large part of the rows is split by Spark: rebalanced partitions are of like size
    usable(passages).withColumn("cell", nearest("embedding")).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(middle)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def probed_cells(path: str, questions: DataFrame, probes: int = PROBES) -> DataFrame:
    """(question_id, cells): the cells that each question (question_id, vector) looks into, nearest first."""
    middle = _centroids(questions.sparkSession, path)
    asked = questions.where("vector is not null").select("question_id", "vector")
    sent = questions.sparkSession.sparkContext.broadcast(middle)

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        likeness = R.unit(np.stack(vectors.to_numpy()).astype(np.float64)) @ sent.value.T
        return pd.Series(list(np.argsort(-likeness, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return asked.select("question_id", near("vector").alias("cells"))


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])


def near_arm(spark: SparkSession, path: str, questions: DataFrame, candidates: int = DEFAULTS.candidates, probes: int = PROBES) -> DataFrame:
    """The dense arm on a stored index: only the ``probes`` nearest cells of each question are read, and only it is compared with their rows.

    A scoped question looks into ``SCOPED_PROBES`` times as many, as what it may not see takes places. With as many probes as
    there are cells the rows are those of the exact arm.
    """
    middle, n_probes = _centroids(spark, path), probes
    if scope.is_scoped(questions):
        n_probes = min(max(MOST_PROBES, probes), probes * SCOPED_PROBES)
    asked = questions.where("vector is not null").select("question_id", "vector", *scope.asked_columns(questions))
    held = spark.read.parquet(f"{path}/cells")
    frames = R.by_blocks(R.question_blocks(asked, R.MOST_VECTORS), lambda block: _probe(held, middle, block, candidates, n_probes))
    if not frames:
        return spark.createDataFrame([], "question_id long, doc_id long, dense_score double, dense_rank int")
    scored = R.united(frames).select("question_id", "doc_id", F.round("score", 6).alias("dense_score"))
    return R.ranked(scored, "dense_score", candidates, "dense_rank")


def _probe(held: DataFrame, middle: np.ndarray, asked: list, candidates: int, probes: int) -> tuple[DataFrame, Broadcast]:
    wanted = R.unit(np.array([r.vector for r in asked], np.float64))
    near = np.argsort(-(wanted @ middle.T), axis=1, kind="stable")[:, :probes]
    by_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    seen = R.scope_of(asked)
    sent = held.sparkSession.sparkContext.broadcast((np.array([r.question_id for r in asked], np.int64), wanted, by_cell, seen))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, by_cell, seen = sent.value
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                rows = np.flatnonzero(cells == cell)
                for at in range(0, len(rows), 2000):
                    part, own = batch.take(pa.array(rows[at : at + 2000])), by_cell[int(cell)]
                    scores = R.unit(R.vectors(part.column("embedding"))) @ wanted[own].T
                    if seen is not None:
                        scores = np.where(seen.allowed(part.column("document_id"), part.column("holder"))[:, own], scores, -2.0)
                    yield R.best_of_batch(part.column("doc_id").to_numpy(), scores, names[own], candidates)

    columns = ["doc_id", "embedding", "cell", *(scope.HELD if seen else ())]
    return held.where(F.col("cell").isin(list(by_cell))).select(*columns).mapInArrow(score, "question_id long, doc_id long, score double"), sent


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall): how many of the exact rows (question_id, doc_id) were found."""
    keys = ["question_id", "doc_id"]
    hit = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hit.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))


def enough_probes(passages: DataFrame, path: str, questions: DataFrame, target: float = 0.95, most: int = 200, candidates: int = DEFAULTS.candidates) -> int:
    """The fewest probes, doubled from 1, by which ``most`` of the questions (those that a hash puts first) find ``target`` of their exact rows.

    Vectors in clusters need few; where they have no structure nearly all cells have to be read, and this says so.
    """
    some = written(questions.orderBy(F.xxhash64("question_id"), "question_id").limit(most), "asked")
    exact, cells, probes = written(R.dense_arm(passages, some, candidates), "exact"), len(_centroids(passages.sparkSession, path)), 1
    while probes < cells and recall(near_arm(passages.sparkSession, path, some, candidates, probes), exact).first().recall < target:
        probes *= 2
    return min(probes, cells)


# ---- words

#: Passages in one block of postings, and their words with repeats (a longer passage is a block alone).
BLOCK_ROWS, BLOCK_WORDS = 1_024, 1 << 20
#: Blocks of the highest bounds that each question reads first, for a score that the others have to reach.
FIRST_BLOCKS = 4
#: Words up to which they go into the scan's filter.
FEW_WORDS = 500


def with_lexemes(passages: DataFrame, words: Callable[[Column], Column] = english.english, text: str = "text") -> DataFrame:
    """``passages`` with their indexed words as a stored column, made once when they are written."""
    return passages.withColumn("lexemes", F.coalesce(words(F.col(text)), F.array().cast("array<string>")))


def by_length(batches: Iterator[pa.RecordBatch], rows: int, words: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``rows`` passages and ``words`` words whose lengths lie between the same powers of two; what is left goes together, longest first."""
    waiting: dict[int, list[pa.RecordBatch]] = defaultdict(list)
    for batch in batches:
        power = np.frexp(pc.list_value_length(batch.column("lexemes")).to_numpy(zero_copy_only=False).astype(np.float64))[1]
        for k in np.unique(power).tolist():
            part, most = batch.take(pa.array(np.flatnonzero(power == k))), max(1, min(rows, words >> k))
            while part.num_rows:
                room = most - sum(p.num_rows for p in waiting[k])
                waiting[k].append(part.slice(0, room))
                part = part.slice(room)
                if sum(p.num_rows for p in waiting[k]) == most:
                    yield pa.concat_batches(waiting.pop(k))
    block: list[pa.RecordBatch] = []
    held = 0
    for k in sorted(waiting, reverse=True):
        for part in waiting.pop(k):
            while part.num_rows:
                room = min(rows - sum(p.num_rows for p in block), (words - held) >> k)
                if room < 1 and block:
                    yield pa.concat_batches(block)
                    block, held = [], 0
                    continue
                block.append(part.slice(0, max(1, room)))
                held += int(pc.sum(pc.list_value_length(block[-1].column("lexemes"))).as_py())
                part = part.slice(max(1, room))
    if block:
        yield pa.concat_batches(block)


def postings(passages: DataFrame, rows: int = BLOCK_ROWS, words: int = BLOCK_WORDS) -> DataFrame:
    """(lexeme, block, most, ids, ns): for each word and block of passages those that have it, how often, and how often at the most.

    A task's passages (doc_id, lexemes) are put together by their length, so that blocks differ in what they can give; nothing is
    shuffled or sorted. Scoped ones carry document_id and holder along, as lists beside ``ids``. A doc_id is one passage.
    """
    carried = [c for c in scope.HELD if c in passages.columns]
    kinds = {c: passages.schema[c].dataType.simpleString() for c in ("doc_id", *carried)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part in enumerate(by_length(batches, rows, words)):
            lists = part.column("lexemes")
            coded = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            cells, ns = np.unique(coded.indices.to_numpy().astype(np.int64) * part.num_rows + doc, return_counts=True)
            word, doc = cells // part.num_rows, pa.array(cells % part.num_rows)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            offsets = pa.array(np.append(first, len(word)), pa.int32())
            block = (int(part.column("slice")[0].as_py()) << 32) + n
            columns = [coded.dictionary.cast(pa.string()), pa.array(np.full(len(first), block)), pa.array((np.maximum.reduceat(ns, first) if len(first) else ns).astype(np.int32))]
            columns += [pa.ListArray.from_arrays(offsets, part.column(c).take(doc)) for c in ("doc_id", *carried)]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(ns.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["lexeme", "block", "most", "ids", *(f"{c}s" for c in carried), "ns"])

    dealt = small_batches(passages).select("doc_id", "lexemes", *carried, F.spark_partition_id().alias("slice"))
    return dealt.mapInArrow(pack, f"lexeme string, block long, most int, ids array<{kinds['doc_id']}>, " + "".join(f"{c}s array<{kinds[c]}>, " for c in carried) + "ns array<int>")


def inverted_index(passages: DataFrame) -> DataFrame:
    """(lexeme, doc_id, n): how often each passage has each word; counted within the passage, so without a shuffle."""
    return postings(passages).select("lexeme", F.explode(F.arrays_zip("ids", "ns")).alias("one")).select("lexeme", F.col("one.ids").alias("doc_id"), F.col("one.ns").alias("n"))


def write_postings(blocks: DataFrame, path: str) -> None:
    """Stores postings, each file in order of its words, so that a reader skips all row groups without the words it asks for."""
    blocks.sortWithinPartitions("lexeme", "block").write.mode("overwrite").parquet(path)


def indexed_arm(blocks: DataFrame, questions: DataFrame, words: Callable[[Column], Column] = english.english, candidates: int = DEFAULTS.candidates, first: int = FIRST_BLOCKS) -> DataFrame:
    """The lexical arm on stored postings: the texts are not read, nor blocks that can't hold one of a question's best passages.

    A block can give a question at most the sum of its words' largest counts. The ``first`` blocks of the highest sums are scored,
    and then those that can reach the score of the last candidate found in them.
    """
    asked = questions.select("question_id", F.array_distinct(words(F.col("question"))).alias("words"), *scope.asked_columns(questions))
    blocks_of = (part for block in R.question_blocks(asked, R.MOST_VECTORS) for part in R.word_blocks(block, R.MOST_VECTORS, R.MOST_CELLS))
    frames = R.by_blocks(blocks_of, lambda block: _pruned(blocks, block, candidates, first))
    if not frames:
        return questions.sparkSession.createDataFrame([], "question_id long, doc_id long, sparse_score double, sparse_rank int")
    scored = R.united(frames).select("question_id", "doc_id", F.round(F.col("score") / (F.col("score") + 10), 6).alias("sparse_score"))
    return R.ranked(scored, "sparse_score", candidates, "sparse_rank")


def bounds(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, block, bound): what each block can give each question (question_id, lexeme) at the most; no list of postings is read."""
    return blocks.select("lexeme", "block", "most").join(asked, "lexeme").groupBy("question_id", "block").agg(F.sum("most").alias("bound"))


def _pruned(blocks: DataFrame, asked: list, candidates: int, first: int) -> tuple[DataFrame, Broadcast]:
    spark = blocks.sparkSession
    vocabulary = sorted({w for r in asked for w in r.words})
    place = {w: i for i, w in enumerate(vocabulary)}
    has = np.zeros((len(asked), len(vocabulary)))
    for k, r in enumerate(asked):
        has[k, [place[w] for w in r.words]] = 1
    seen = R.scope_of(asked)
    names = np.array([r.question_id for r in asked], np.int64)
    sent = spark.sparkContext.broadcast((vocabulary, has, names, seen))
    # a block of questions has a bounded number of words, so what is made of them is broadcast unseen
    pairs = F.broadcast(spark.createDataFrame(pd.DataFrame([(int(r.question_id), w) for r in asked for w in r.words], columns=["question_id", "lexeme"]), "question_id long, lexeme string"))
    few = F.broadcast(spark.createDataFrame(pd.DataFrame({"lexeme": vocabulary}, dtype=object), "lexeme string"))
    # few words are looked up by the row groups' statistics
    held = blocks.where(F.col("lexeme").isin(vocabulary)) if len(vocabulary) <= FEW_WORDS else blocks.join(few, "lexeme", "left_semi")
    order = W.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    bound = written(bounds(blocks, pairs).withColumn("place", F.row_number().over(order)), "bounds")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """The postings of one block, and the questions that look into it."""
        vocabulary, has, names, seen = sent.value
        out = pa.schema([("question_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        own = np.flatnonzero(np.isin(names, right.column("question_id").to_numpy()))
        ids, ns = left.column("ids").combine_chunks(), left.column("ns").combine_chunks()
        docs, at = np.unique(ids.flatten().to_numpy(), return_inverse=True)
        term = np.repeat(pc.index_in(left.column("lexeme").combine_chunks(), value_set=pa.array(vocabulary)).to_numpy(), np.diff(ids.offsets.to_numpy()))
        held = np.unique(term)
        # whole numbers in doubles, which are exact and multiply fast; a word has a passage once
        counts = np.zeros((len(docs), len(held)))
        counts[at, np.searchsorted(held, term)] = ns.flatten().to_numpy()
        scores = counts @ has[np.ix_(own, held)].T
        if seen is not None:
            _, one = np.unique(at, return_index=True)
            documents, holders = (left.column(c).combine_chunks().flatten().take(pa.array(one)) for c in ("document_ids", "holders"))
            scores = np.where(seen.allowed(documents, holders)[:, own], scores, 0)
        # equal scores by doc_id, of which ``docs`` has them in order: no more than the candidates leave a block, however many are alike
        keys = scores.astype(np.int64) * len(docs) + np.arange(len(docs) - 1, -1, -1)[:, None]
        least = np.partition(keys, len(docs) - candidates, axis=0)[len(docs) - candidates] if len(docs) > candidates else 0
        asks = dict(zip(right.column("question_id").to_pylist(), right.column("least").to_pylist(), strict=True))
        row, column = np.nonzero((keys >= least) & (scores > 0) & (scores >= np.array([asks[int(q)] for q in names[own]])))
        return pa.table([pa.array(names[own][column]), pa.array(docs[row]), pa.array(scores[row, column].astype(np.int64))], schema=out)

    def scored(wanted: DataFrame, name: str) -> DataFrame:
        columns = ["lexeme", "block", "ids", "ns", *(f"{c}s" for c in scope.HELD if seen)]
        lists = held.select(*columns).join(wanted.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(wanted.groupBy("block"))
        return written(lists.applyInArrow(score, "question_id long, doc_id long, score long"), name)

    top = scored(bound.where(F.col("place") <= first).select("block", "question_id", F.lit(0).cast("long").alias("least")), "first")
    worst = R.ranked(top, "score", candidates).where(F.col("rank") == candidates).select("question_id", F.col("score").alias("least"))
    rest = bound.where(F.col("place") > first).join(worst, "question_id", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).where("bound >= least").select("block", "question_id", "least")
    return top.unionByName(scored(rest, "others")), sent


# ---- identifiers

#: Trigrams of an identifier that are looked up, the rarest first.
RAREST = 3
#: Bytes of text that share a trigram's list of postings, and that are cut into trigrams at a time.
LIST_BYTES, CUT_BYTES = 4 << 20, 1 << 18
#: Identifiers in one block.
MOST_IDENTIFIERS = 500
#: Candidates up to which their ids go into the scan of the passages; more of them are joined.
MOST_LISTED = 10_000
#: The letters that lower-casing turns into ASCII ones.
_TO_ASCII = (("K", "k"), ("İ", "i"))


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of ASCII characters, lower-cased, of each text: their codes and the texts' places."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for letter, ascii_letter in _TO_ASCII:
        texts = pc.replace_substring(texts, letter, ascii_letter)
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if offsets[-1] - offsets[0] < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    whole = np.flatnonzero((owner[2:] == owner[:-2]) & ((data[2:] | data[1:-1] | data[:-2]) < 128))
    code = data[whole] << 14 | data[whole + 1] << 7 | data[whole + 2]
    pairs = np.unique(owner[whole].astype(np.int64) << 21 | code)
    return pairs & (1 << 21) - 1, pairs >> 21


def trigram_postings(passages: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n, ids): the passages of each trigram, in lists of those of ``LIST_BYTES`` of text; a passage's text is read once."""
    kind = passages.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.by_bytes(batches, "held", LIST_BYTES):
            found, at = [], 0
            for cut in R.by_bytes(iter([part]), "held", CUT_BYTES):
                code, owner = trigrams(cut.column("held"))
                found.append(code << 32 | owner + at)
                at += cut.num_rows
            pairs = np.sort(np.concatenate(found))
            code, owner = pairs >> 32, pairs & 0xFFFFFFFF
            first = np.flatnonzero(np.diff(code, prepend=-1))
            offsets = np.append(first, len(code))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), part.column("doc_id").take(pa.array(owner)))
            yield pa.RecordBatch.from_arrays([pa.array(code[first].astype(np.int32)), pa.array(np.diff(offsets).astype(np.int32)), lists], ["gram", "n", "ids"])

    return small_batches(passages).select("doc_id", F.col(text).alias("held")).mapInArrow(pack, f"gram int, n int, ids array<{kind}>")


def write_trigrams(lists: DataFrame, path: str) -> None:
    """Stores trigram postings, each file in order of its trigrams, so that a reader skips all row groups without those it asks for."""
    lists.sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def grams_of(identifier: str) -> set[int]:
    """The trigrams that any text with the identifier has: those between its wildcards and between its letters beyond ASCII."""
    parts = pa.array([p for p in re.split("[_%]+", identifier) if p] or [""])
    # a letter may be written as a longer one: what lower-casing changes in number is no part of a trigram
    return set(trigrams(pc.replace_substring_regex(parts, "[^\\x00-\\x7F]", "é"))[0].tolist())


def candidates_of(lists: DataFrame, grams: dict[str, set[int]], rarest: int = RAREST) -> DataFrame:
    """(doc_id, identifier): passages that have each of an identifier's rarest trigrams; a superset of those that hold it."""
    spark = lists.sparkSession
    asked = sorted({g for own in grams.values() for g in own})
    sizes = {r.gram: r.n for r in lists.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    chosen = [(i, g) for i, own in grams.items() if all(g in sizes for g in own) for g in sorted(own, key=lambda g: (sizes[g], g))[:rarest]]
    wanted = spark.createDataFrame(chosen, "identifier string, gram int")
    needed = wanted.groupBy("identifier").agg(F.count("*").alias("needed"))
    found = lists.where(F.col("gram").isin(sorted({g for _, g in chosen}))).join(F.broadcast(wanted), "gram").select("identifier", F.explode("ids").alias("doc_id"))
    return found.groupBy("identifier", "doc_id").agg(F.count("*").alias("held")).join(F.broadcast(needed), "identifier").where("held >= needed").select("doc_id", "identifier")


def indexed_identifiers(lists: DataFrame, passages: DataFrame, questions: DataFrame, candidates: int = DEFAULTS.candidates, text: str = "text") -> DataFrame:
    """The identifier arm on stored trigrams: only the texts that have an identifier's rarest trigrams are read.

    Whether they hold it is then looked up in the text itself, so the rows are the arm's. Identifiers without a trigram (two characters,
    wildcards, scripts beyond ASCII) are looked for in all texts.
    """
    q = R.asked_identifiers(questions)
    carried = scope.HELD if scope.is_scoped(questions) else ()
    names = q.select("identifier").distinct().withColumnRenamed("identifier", "question_id")
    frames = []
    for block in R.question_blocks(names, MOST_IDENTIFIERS):
        grams = {r[0]: grams_of(r[0]) for r in block}
        if known := {i: own for i, own in grams.items() if own}:
            near = written(candidates_of(lists, known).select("doc_id").distinct(), "candidates")
            few = near.limit(MOST_LISTED + 1).collect()
            texts = passages.where(F.col("doc_id").isin([r[0] for r in few])) if len(few) <= MOST_LISTED else passages.join(near, "doc_id", "left_semi")
            frames.append(R.identifier_hits(texts, list(known), text, carried))
        if rest := [i for i, own in grams.items() if not own]:
            frames.append(R.identifier_hits(passages, rest, text, carried))
    found = reduce(DataFrame.unionByName, frames) if frames else R.identifier_hits(passages, [], text, carried)
    return R.by_hits(found, q, candidates)
