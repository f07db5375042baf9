"""Packing documents into fixed-length training sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. The remainders' lengths form a histogram of
bounded size (classes of ``width`` tokens), and only that histogram reaches the driver: a linear program
over patterns (how many remainders of each class share a sequence) is solved by column generation, a knapsack
by dynamic programming prices new patterns with the duals, and the patterns' counts are rounded down, with
what is left packed first-fit by falling length. Pieces are then ranked within their class, and each rank has one
place in one pattern's sequences, found by a join with the (bounded) list of pattern runs.

Ranks are counted within (class, salt) groups plus an offset for each group, so a length that a third of all
documents share is no hot spot.

Defined results: null and empty texts are the single end id; repeated rows are packed one by one; an empty table
gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from os.path import splitext

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.textblocks import blocks
from strataq.tables import written

SEQUENCE = 2048
END_ID = 1
WIDTH = 8
#: Pieces for each salt of a length class.
RANK_GROUP = 10_000
#: Column generation ends when at most this share of the sequences could still be saved.
GAP = 1e-4


def added_tokens(path: str) -> tuple[str, ...]:
    """The texts of the tokenizer's added tokens."""
    return tuple(token.content for token in tokenizers.Tokenizer.from_file(path).get_added_tokens_decoder().values())


def encoder(path: str, added: tuple[str, ...]) -> Callable[[str | None], np.ndarray]:
    """A function that gives a text's ids by the tokenizer's own file, and the end id, as little-endian unsigned 32-bit integers.

    The ranks file beside it gives the same ids faster where no added token is in the text; the tokenizer itself is
    read when a text needs it. A worker lives longer than a task, so neither is kept beyond the function.
    """
    with open(splitext(path)[0] + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast, own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), []

    def ids(text: str) -> np.ndarray:
        if not any(token in text for token in added):
            try:
                return fast.encode_to_numpy(text)
            except ValueError:  # its pattern backtracks too far on a run of some million blanks
                pass
        if not own:
            own.append(tokenizers.Tokenizer.from_file(path))
        return np.array(own[0].encode(text, add_special_tokens=False).ids)

    return lambda text: np.append(np.asarray(ids(text), "<u4") if text else np.zeros(0, "<u4"), np.uint32(END_ID)).astype("<u4")


@cache
def _kept_encoder(path: str) -> Callable[[str | None], np.ndarray]:
    return encoder(path, added_tokens(path))


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of one whole text and the end id."""
    return _kept_encoder(path)(text)


def cut(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, number (and ids, if asked for).

    ``number`` counts the pieces of a task, so that pieces that are alike can be told apart.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long" + ", ids array<int>" * with_ids

    added = added_tokens(tokenizer)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer, added), 0
        for batch in batches:
            for part in blocks(batch):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = encode(text.as_py())
                    for start in range(0, len(ids), length):
                        own = ids[start : start + length]
                        rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), number, *([own.astype(np.int32)] if with_ids else [])))
                        number += 1
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names[: len(kinds)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, fields)


def best_pattern(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest sum of duals that fits, by knapsack dynamic programming (unbounded)."""
    value, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        value[room], chosen[room] = value[room - 1], -1
        if n:
            gains = value[room - sizes[:n]] + duals[:n]
            if gains[k := int(gains.argmax())] > value[room] + 1e-12:
                value[room], chosen[room] = gains[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            pattern[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
    return float(value[capacity]), pattern


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns of a basis) and how often each is used in the linear program's optimum.

    Revised simplex: the basis starts with one pattern for each size, and pricing adds the best new one. With the
    best price v, no solution is below the present one divided by v, so it ends when v is close enough to 1.
    """
    basis = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1 / (capacity // sizes))
    used = inverse @ demand
    for _ in range(rounds):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9 or 1 - 1 / value < GAP:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        used = np.maximum(inverse @ demand, 0)
    return basis.astype(np.int64), used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of sequences, sizes, copies of each size in one of them) that together hold exactly the histogram."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes], np.int64)
    basis, used = generate_columns(sizes, left.astype(np.float64), capacity)
    runs = []
    for j in np.argsort(-used):
        pattern = basis[:, j]
        fit = pattern > 0
        if n := min(int(used[j] + 1e-6), int((left[fit] // pattern[fit]).min())):
            left -= n * pattern
            runs.append((n, sizes[fit], pattern[fit]))
    rooms: list[list[int]] = []  # first fit by falling size, over what rounding has left
    free: list[int] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(left[k]):
            at = next((i for i, r in enumerate(free) if r >= sizes[k]), None)
            if at is None:
                rooms.append([])
                free.append(capacity)
                at = len(free) - 1
            rooms[at].append(k)
            free[at] -= int(sizes[k])
    for held in rooms:
        which, n = np.unique(held, return_counts=True)
        runs.append((1, sizes[which], n))
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """All pieces with their sequence_id and their offset in it."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    size = F.ceil(F.col("length") / width).cast("int")
    # written: the pieces' numbers are those of one run of the tasks
    pieces = written(cut(docs, tokenizer, length, with_ids), "pieces")
    histogram = {r["size"]: r["n"] for r in pieces.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # length / width rows at most
    runs, first = [], 0
    taken = dict.fromkeys(histogram, 0)
    for n, sizes, copies in plan(histogram, length // width):
        for s, c in zip(sizes.tolist(), copies.tolist(), strict=True):
            runs.append((s, taken[s], taken[s] + n * c, c, first))
            taken[s] += n * c
        first += n
    places = spark.createDataFrame(runs, "size int, low long, high long, copies long, first long")
    salts = max(1, sum(histogram.values()) // RANK_GROUP)
    salted = pieces.withColumns({"size": size, "salt": F.pmod(F.xxhash64("doc_id", "start", "number"), F.lit(salts))})
    before = W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("size", "salt").orderBy(F.desc("length"), "doc_id", "start", "number")) - 1)
    ranked = ranked.join(F.broadcast(offsets) if salts * len(histogram) < 100_000 else offsets, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumnRenamed("size", "own")
    placed = ranked.join(F.broadcast(places), (F.col("own") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("copies"))).cast("long"))
    ahead = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(W.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset")]
    return placed.select(*columns, *["ids"] * with_ids)


def sequences(packed: DataFrame, length: int = SEQUENCE, pad: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to ``length`` except at a power of two; needs ``pack(..., with_ids=True)``."""
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    whole = packed.groupBy("sequence_id").agg(ids.alias("ids"))
    lack = F.when(F.expr("bit_count(size(ids))") == 1, 0).otherwise(length - F.size("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), lack)).alias("ids"))
