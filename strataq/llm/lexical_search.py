"""Ranked lexical search: a blocked sparse product of items by terms and terms by documents, in 64-bit integers.

:func:`term_counts` reads every text once and writes how often it has each term that any item asks for: the rows of a
sparse matrix, documents by terms. The corpus counts (N, L and df) are sums over that table. :func:`search` then
multiplies: in a task, a block of documents is turned into terms by documents with each cell's impact, and for each item the rows of
its terms are merged (Gustavson), as many times as it has them. A task keeps each item's best rows so far, so what is
shuffled is bounded by items times ``top`` times tasks, and those are reduced twice.

Items are a stated set that goes to every task in blocks of at most ``MOST_ITEMS`` items and ``MOST_TERMS`` terms.

Defined results: a null or empty text has no term, counts in neither N nor L and is never found; an item without a term that any
document has gets no row. Rows of the items that repeat an item_id are one item with the terms of all of them; rows of the
documents that repeat a doc_id are documents of their own, next to each other in the ranks when their scores are equal; a null doc_id
comes last among equal scores. Texts of any length are read whole, and other columns, whatever their names, aren't read.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.textblocks import LOWER, blocks, flat, word_hashes, word_spans
from strataq.tables import discard, written

#: Items, and terms of items, in one block that goes to every task (a single item may have more terms).
MOST_ITEMS, MOST_TERMS = 5_000, 500_000
#: Documents in one block of the product.
BLOCK_ROWS = 8_192
#: Groups that an item's best rows are reduced in before they meet.
SALTS = 32
#: Letters, digits and whatever isn't ASCII, with A-Z lower-cased; all else is a blank.
FOLD = np.where([b >= 128 or chr(b).isalnum() for b in range(256)], LOWER, 32).astype(np.uint8)
_LEAST = np.iinfo(np.int64).min


def hashed_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of some texts, in order, and the n + 1 offsets of the texts in it."""
    buf, offsets = flat(texts)
    buf = FOLD[buf]
    starts, ends, owned = word_spans(buf, offsets)
    return word_hashes(buf, starts, ends), owned


def in_item_blocks(items: DataFrame, most: int = MOST_ITEMS) -> Iterator[pa.Table]:
    """The items (item_id, text) in blocks, all rows of an item in one; only one block is on the driver at a time."""
    items = items.select("item_id", "text")
    n = items.count()
    if n <= most:
        yield items.toArrow()
        return
    # twice the blocks that would do, as hashing fills them unevenly
    dealt = written(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(-(-2 * n // most)))), "items")
    for k in range(-(-2 * n // most)):
        yield dealt.where(F.col("block") == k).select("item_id", "text").toArrow()
    discard(dealt)


class Asked:
    """A block of items as a sparse matrix by rows: the terms of item i, each once, and how often it has them."""

    def __init__(self, block: pa.Table) -> None:
        names = block.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.names: pa.Array = names.dictionary
        hashes, owned = hashed_terms(block.column("text"))
        self.terms, at = np.unique(hashes, return_inverse=True)
        item = np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(owned))
        cells, self.times = np.unique(item * max(len(self.terms), 1) + at, return_counts=True)
        self.term = cells % max(len(self.terms), 1)
        self.offsets = np.searchsorted(cells // max(len(self.terms), 1), np.arange(len(self.names) + 1))

    def halves(self, block: pa.Table) -> list[pa.Table]:
        """The block's items in two halves, if they have more terms than a block may have."""
        if len(self.terms) <= MOST_TERMS or len(self.names) < 2:
            return []
        index = block.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return [block.filter(pa.array(index % 2 == k)) for k in (0, 1)]


def term_counts(documents: DataFrame, asked: Asked) -> DataFrame:
    """(doc_id, n, terms, tf) of each text with a term: n terms in all, and how often it has those that are asked for."""
    sent = documents.sparkSession.sparkContext.broadcast(asked.terms)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            for part in blocks(batch):
                hashes, owned = hashed_terms(part.column("text"))
                lengths = np.diff(owned)
                at = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
                hit = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
                doc = np.repeat(np.arange(part.num_rows), lengths)[hit]
                cells, tf = np.unique(doc * max(len(wanted), 1) + at[hit], return_counts=True)
                term, doc = cells % max(len(wanted), 1), cells // max(len(wanted), 1)
                offsets = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, tf)]
                made = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths), *lists], ["doc_id", "n", "terms", "tf"])
                yield made.filter(pa.array(lengths > 0))

    return documents.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def weights(counts: DataFrame, asked: Asked) -> tuple[int, int, np.ndarray]:
    """N, L, and the weight of each asked term by how many documents hold it."""
    n, words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    worth = held.select("term", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).toArrow()
    w = np.zeros(len(asked.terms), np.int64)
    w[worth.column("term").to_numpy()] = worth.column("w").to_numpy()
    return n, words, w


def merged(rows: np.ndarray, times: np.ndarray, offsets: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of some rows of a sparse matrix, each so many times: its columns in ascending order, and their sums."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - ends + sizes, sizes)
    columns, values = docs[at], impacts[at] * np.repeat(times, sizes)
    order = np.argsort(columns, kind="stable")
    columns = columns[order].astype(np.int64)
    first = np.flatnonzero(np.diff(columns, prepend=-1))
    return columns[first], np.add.reduceat(values[order], first) if len(first) else values


def best(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by ascending id, those without an id last."""
    if len(scores) > top:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], unnamed[near], -scores[near]))[:top]]


def products(asked: Asked, n: int, words: int, w: np.ndarray, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: each item's best documents of all its blocks."""
    names, offsets, term, times = asked.names, asked.offsets, asked.term, asked.times

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for part in (batch.slice(s, BLOCK_ROWS) for batch in batches for s in range(0, batch.num_rows, BLOCK_ROWS)):
            own = part.column("doc_id").cast(pa.int64())
            unnamed, ids = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
            lists = part.column("terms")
            doc = np.repeat(np.arange(part.num_rows, dtype=np.uint16), np.diff(lists.offsets.to_numpy()))
            terms, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(np.int64)
            m = 75 + (25 * part.column("n").to_numpy() * n) // words
            order = np.argsort(terms, kind="stable")
            terms, doc, tf = terms[order], doc[order], tf[order]
            impacts = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            held = np.searchsorted(terms, np.arange(len(w) + 1))
            for i in range(len(names)):
                mine = slice(offsets[i], offsets[i + 1])
                docs, scores = merged(term[mine], times[mine], held, doc, impacts)
                before, ids_before, unnamed_before = kept.get(i, (none, none, none.astype(bool)))
                least = max(1, int(before.min()) if len(before) == top else 1)
                found = np.flatnonzero(scores >= least)
                if len(found):
                    scores, docs = scores[found], docs[found]
                    scores, all_ids, all_unnamed = np.concatenate([before, scores]), np.concatenate([ids_before, ids[docs]]), np.concatenate([unnamed_before, unnamed[docs]])
                    first = best(scores, all_ids, all_unnamed, top)
                    kept[i] = scores[first], all_ids[first], all_unnamed[first]
        for i, (scores, ids, unnamed) in kept.items():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(scores), i))), pa.array(ids, mask=unnamed), pa.array(scores)], ["item_id", "doc_id", "score"])

    return multiply


def search(documents: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents (doc_id, text) for each item (item_id, text)."""
    spark = documents.sparkSession
    kinds = {"item_id": items.schema["item_id"].dataType.simpleString(), "doc_id": documents.schema["doc_id"].dataType.simpleString()}
    found = []
    todo = in_item_blocks(items)
    for whole in todo:
        open_blocks = [whole]
        while open_blocks:
            block = open_blocks.pop()
            asked = Asked(block)
            if halves := asked.halves(block):
                open_blocks += halves
                continue
            counts = written(term_counts(documents, asked), "counts")
            n, words, w = weights(counts, asked)
            if words:
                rows = counts.where("size(terms) > 0").mapInArrow(products(asked, n, words, w, top), f"item_id {kinds['item_id']}, doc_id long, score long")
                found.append(written(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "found"))
            discard(counts)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = spark.createDataFrame([], f"item_id {kinds['item_id']}, doc_id long, score long, salt long")
    for part in found:
        rows = rows.unionByName(part)
    some = rows.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranks = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranks.select("item_id", "rank", F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), "score")
