"""Quality rules with compression bands.

Repetitive text compresses too well and noise too badly. A text's zstandard ratio (compressed bytes over
bytes) is held against limits for its length, over the whole text and over each chunk of it, so a long text
with one bad stretch is seen too: one bad chunk is enough. What is left after the last full chunk is judged
with the bytes before it, as the text's last chunk. Word and line rules come before that.

Defined results: a null text has no words and fails the base rules; an empty table gives no rows; repeated
rows are judged one by one; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from strataq.llm.textblocks import SPACE, blocks, flat, mix, ngrams, sums, word_hashes, word_spans

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits on compressed / raw bytes: (texts from so many bytes on, lowest, highest ratio).

    Short texts compress badly whatever they say, so the highest ratio falls with the length.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (256, 0.30, 0.90), (1024, 0.25, 0.80), (4096, 0.22, 0.70), (16384, 0.20, 0.65))
    #: Texts of so many bytes or more are judged by chunks too, each within the limits for its length.
    chunk_bytes: int = 4096
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.whole) if size >= least)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The word, symbol, line and repetition counts of each text."""
    buf, offsets = flat(texts)
    starts, ends, at = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends)
    counts = np.diff(at)
    solid = ~SPACE[buf]
    out = {
        "n_words": counts,
        "word_chars": sums(solid & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": sums(_SYMBOL[buf], offsets),
    }
    windows, first = ngrams(words, at, 3)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.zeros(len(words) + 1, np.int64)
    if len(windows):
        key = mix(windows + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hits = first[twice]
        for k in range(3):
            inside[hits + k] = 1
    out["n_repeat_words"] = sums(inside[:-1], at)
    raw, dup = buf.tobytes(), np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        seen: set[bytes] = set()
        for line in raw[offsets[i] : offsets[i + 1]].split(b"\n"):
            if line.strip(_BLANK):
                dup[i] += line in seen
                seen.add(line)
    return out | {"n_dup_lines": dup}


def chunks(text: memoryview, size: int) -> Iterator[memoryview]:
    """All full chunks of a text and, if bytes are left over, its last ``size`` bytes; none for a shorter text."""
    if len(text) >= size:
        for k in range(0, len(text) - size + 1, size):
            yield text[k : k + size]
        if len(text) % size:
            yield text[-size:]


def band_verdicts(texts: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    """Ratios of each text and of its chunks, and whether they lie within the bands."""
    buf, offsets = flat(texts)
    raw, squeeze = memoryview(buf.tobytes()), zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    n = len(offsets) - 1
    ratio, low, high, kept = (np.full(n, np.nan) for _ in range(4))
    for i in range(n):
        text = raw[offsets[i] : offsets[i + 1]]
        if not len(text):
            kept[i] = 1
            continue
        ratio[i] = len(squeeze.compress(text)) / len(text)
        least, most = bands.limits(len(text))
        fine = least <= ratio[i] <= most
        each = [len(squeeze.compress(c)) / len(c) for c in chunks(text, bands.chunk_bytes)]
        if each:
            low[i], high[i] = min(each), max(each)
            least, most = bands.limits(bands.chunk_bytes)
            fine &= least <= low[i] and high[i] <= most
        kept[i] = fine
    return {"ratio": ratio, "chunk_low": low, "chunk_high": high, "fine": kept.astype(bool)}


def quality_rules(docs: DataFrame, bands: Bands = Bands(), min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row for each document with its counts, ratios and verdict; a map without any shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                base, band = base_counts(part.column("text")), band_verdicts(part.column("text"), bands)
                failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
                cols = {"doc_id": part.column("doc_id").cast(pa.int64())}
                cols |= {k: pa.array(base[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                cols |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & band["fine"])}
                cols |= {k: pa.array(band[k], pa.float64(), from_pandas=True) for k in ("ratio", "chunk_low", "chunk_high")}
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
