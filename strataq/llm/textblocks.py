"""Vectorised work on whole texts inside Arrow tasks: bytes, words, word hashes, n-gram hashes.

Every function takes flat arrays for a *block* of texts (a few MB), so a task's memory is bounded by
one block plus the longest single text, whatever the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Bytes of text that one block holds; a longer text is a block of its own. Temporary arrays take some 50 times that.
BLOCK_BYTES = 1 << 19
#: ASCII white space: space and TAB, LF, VT, FF, CR.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C55)
_M = np.uint64(0xD6E8FEB86659FD93)


def named(df: DataFrame, column: str) -> Column:
    """The column of just that name, dots and backticks included."""
    return df["`" + column.replace("`", "``") + "`"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    if n == 0 or data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the texts."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = solid[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, "left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, step: int = 100_000) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z lower-cased if asked for."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        part = buf[s[0] : e[-1]]
        if lower:
            part = LOWER[part]
        lengths = e - s
        place = np.arange(len(part), dtype=np.int64)
        own = np.repeat(np.arange(len(s)), np.diff(np.append(s, e[-1])))
        place -= (s - s[0])[own]
        inside = place < lengths[own]
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _P, np.uint64))
        value = (part.astype(np.uint64) + np.uint64(1)) * powers[np.where(inside, place, 0)]
        value[~inside] = 0
        out[i : i + step] = mix(np.add.reduceat(value, s - s[0]) + lengths.astype(np.uint64) * _M)
    return out


def ngrams(words: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the index of their first word; windows never cross texts."""
    total = len(words)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(word_offsets[1:], np.diff(word_offsets)) - np.arange(total)
    first = np.flatnonzero(left[: total - n + 1] >= n)
    h = np.full(total - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        h = mix(h * _M + words[k : total - n + 1 + k])
    return h[first], first


def short_hashes(words: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of 1 to n - 1 words: a hash of the whole sequence, and the texts' indexes."""
    counts = np.diff(word_offsets)
    found, which = [], []
    for c in range(1, n):
        rows = np.flatnonzero(counts == c)
        h = np.full(len(rows), np.uint64(c), np.uint64)
        for k in range(c):
            h = mix(h * _M + words[word_offsets[rows] + k])
        found.append(h)
        which.append(rows)
    return (np.concatenate(found), np.concatenate(which)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets; empty runs give 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
