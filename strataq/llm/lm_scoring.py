"""Language-model scores by stupid backoff, computed relationally over all documents.

The n-gram count tables of all orders are partitioned by hash. Documents are dealt to chunks of bounded size, and
each chunk's distinct n-grams meet the count table as one row for each hash partition: a sorted, delta-coded block
of n-gram hashes with their counts in the chunk. A partition sums the blocks of all chunks (the count table)
and answers each chunk with the corpus counts of its n-grams; the answers are joined with the chunk's
documents and summed for each document. So an n-gram crosses the network once for each chunk it is in, in
about three bytes, and a frequent one is no hot spot. Texts travel to their chunks compressed, many in one row.

The score of a word after its context is count(context, word) / count(context) for the longest context (up to
``order`` - 1 words of the same text) with which it was seen at least ``least`` times in the corpus, times 0.4 for
each word that the context was shortened by; a word alone scores count(word) / number of words.

Defined results: texts without words (and null texts) have n_words 0, score 0 and no score per word; repeated rows
count as often as they occur; null doc_ids are scored like others; columns besides doc_id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.textblocks import flat, ngrams, word_hashes, word_spans
from strataq.tables import written

ORDER, LEAST, BACKOFF = 3, 2, 0.4
CHUNK_BYTES = 12 << 20
#: n-grams of all chunks that one hash partition counts.
PARTITION_GRAMS = 3_000_000


def gram_levels(texts: pa.Array, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word offsets of the texts, and for each order the hash (``bits`` bits) of the n-gram that starts at each word; 0 where none does."""
    buf, offsets = flat(texts)
    starts, ends, at = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends)
    levels = []
    for n in range(1, order + 1):
        h, first = (words, np.arange(len(words))) if n == 1 else ngrams(words, at, n)
        level = np.zeros(len(words), np.uint64)
        level[first] = np.maximum(h >> np.uint64(64 - bits), np.uint64(1))
        levels.append(level)
    return at, levels


def partition_bounds(partitions: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // partitions for k in range(partitions + 1)], np.uint64)


def distinct(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, n = np.unique(level, return_counts=True)
    none = int(len(grams) > 0 and grams[0] == 0)
    return grams[none:], n[none:]


def encode(values: np.ndarray) -> bytes:
    """Integers as byte planes, zstandard-compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def decode(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def bundle(dealt: DataFrame) -> DataFrame:
    """(chunk, texts): the rows of each chunk in a batch as one compressed Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            order = np.argsort(chunks, kind="stable")
            own, starts = np.unique(chunks[order], return_index=True)
            rows = pa.Table.from_batches([batch.select(["doc_id", "text"])])
            for chunk, at in zip(own, np.split(order, starts[1:]), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_table(rows.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])

    return dealt.mapInArrow(pack, "chunk int, texts binary")


def unbundle(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows.column("texts")])


def lm_scores(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, score (sum of logarithms), n_backed_off and score_per_word of every document."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, total // CHUNK_BYTES)
    grams = order * total // 6 + 1  # a guess that only sets sizes
    partitions = int(grams // PARTITION_GRAMS) + 1
    bits = min(62, math.ceil(math.log2(grams)) + 22)  # so that one n-gram in four million shares its hash
    bounds = partition_bounds(partitions, bits)
    # rows of one doc_id, and those without one, spread by their texts
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = bundle(docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def ask(rows: pa.Table) -> pa.Table:
        _, levels = gram_levels(unbundle(rows).column("text"), order, bits)
        out: list[tuple] = []
        for n, level in enumerate(levels, 1):
            found, counts = distinct(level)
            cuts = np.searchsorted(found, bounds)
            for k in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[k], cuts[k + 1])
                out.append((n * partitions + int(k), rows.column("chunk")[0].as_py(), encode(np.diff(found[own], prepend=np.uint64(0))), encode(counts[own])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "grams", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        asked = [np.cumsum(decode(x)) for x in rows.column("grams").to_pylist()]
        table, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(place, np.concatenate([decode(x) for x in rows.column("counts").to_pylist()]), len(table)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, asked)])
        blocks = [encode(counts[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([rows.column("chunk"), rows.column("part"), pa.array(blocks, pa.binary())], ["chunk", "part", "counts"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unbundle(rows)
        at, levels = gram_levels(rows.column("text"), order, bits)
        answers = answers.sort_by("part")
        known: list[np.ndarray] = []
        for n, level in enumerate(levels, 1):
            found, place = np.unique(level, return_inverse=True)
            own = answers.filter(pc.equal(pc.divide(answers.column("part"), pa.scalar(partitions, pa.int32())), n)).column("counts").to_pylist()
            counts = np.concatenate([np.zeros(0, np.uint64), *map(decode, own)]).astype(np.float64)
            if len(found) and found[0] == 0:
                counts = np.concatenate([[0.0], counts])
            known.append(counts[place] if len(found) else np.zeros(0))
        words = len(levels[0])
        index = np.arange(words) - np.repeat(at[:-1], np.diff(at))
        value, open_ = np.zeros(words), np.ones(words, bool)
        level_one, backed = np.zeros(words, bool), np.zeros(words, bool)
        longest = np.minimum(index + 1, order)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(order, 0, -1):
                ends = open_ & (longest >= n)
                seen = np.zeros(words)
                seen[n - 1 :] = known[n - 1][: words - n + 1]
                ends &= (seen >= least) if n > 1 else ends
                penalty = (longest - n) * math.log(backoff)
                if n > 1:
                    context = np.ones(words)
                    context[n - 1 :] = known[n - 2][: words - n + 1]
                    value[ends] = (np.log(seen / context) + penalty)[ends]
                else:
                    value[ends] = (np.log(seen) + penalty)[ends]
                    level_one = ends
                backed |= ends & (longest > n)
                open_ &= ~ends
        run = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        per = lambda x: np.array([x[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)])
        return pa.table([rows.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(per(value), pa.float64()), pa.array(run(level_one), pa.int64()), pa.array(run(backed), pa.int64())], ["doc_id", "n_words", "logs", "alone", "n_backed_off"])

    asks = dealt.groupBy("chunk").applyInArrow(ask, "part int, chunk int, grams binary, counts binary")
    answers = written(asks.groupBy("part").applyInArrow(answer, "chunk int, part int, counts binary"), "answers")
    scores = written(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, logs double, alone long, n_backed_off long"), "scores")
    words = scores.agg(F.sum("n_words")).first()[0] or 1
    value = F.col("logs") - F.col("alone") * math.log(words)
    return scores.select("doc_id", "n_words", value.alias("score"), "n_backed_off", F.when(F.col("n_words") > 0, value / F.col("n_words")).alias("score_per_word"))
