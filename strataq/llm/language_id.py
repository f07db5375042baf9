"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a seed and its code point. A trigram's vector binds
its letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) its trigrams'
vectors; a language's prototype bundles its texts' vectors. A text gets the language whose prototype has
the largest cosine with it. Each task bundles its own texts into one vector for each language and only these are
added up, as whole numbers, so ``DIMENSIONS`` numbers for each language reach the driver, whatever the corpus.

Defined results: ``und`` with score 0 for texts that are null, empty or without a letter, and for all texts
if nothing could be learned; ties go to the language that sorts first; rows with null text or null language teach
nothing; columns besides the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.llm.textblocks import blocks, flat

UNDETERMINED = "und"
DIMENSIONS = 1024
#: Different trigrams of one language that a task counts before it adds their vectors up.
MOST_TRIGRAMS = 500_000


@cache
def _fold() -> np.ndarray:
    """Lower-cased letter for each code point of the basic plane; 0 for what isn't a letter."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, 0 between words, and the n + 1 offsets of the texts."""
    buf, offsets = flat(texts)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = _fold()[np.minimum(points, 0xFFFF)]
    if len(far := np.flatnonzero(points > 0xFFFF)):
        out[far] = [ord(ch.lower()[:1]) if (ch := chr(p)).isalpha() else 0 for p in points[far]]
    return out, starts


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all trigrams, the index of their text, and whether each text has a letter.

    Words are framed by one blank; a trigram has a letter in the middle and never crosses texts.
    """
    points, starts = letters(texts)
    n = len(starts) - 1
    has = np.add.reduceat(np.append(points > 0, False), starts[:-1]) > 0 if n else np.zeros(0, bool)
    has &= starts[1:] > starts[:-1]
    mid = np.flatnonzero(points)
    owner = np.searchsorted(starts, mid, "right") - 1
    padded = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)]).astype(np.uint64)
    left = np.where(mid == starts[owner], 0, padded[mid])
    right = np.where(mid + 1 == starts[owner + 1], 0, padded[mid + 2])
    return left << np.uint64(42) | padded[mid + 1] << np.uint64(21) | right, owner, has


@cache
def _letter(point: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([7, point]).integers(0, 2, dimensions, np.int8) * 2 - 1


def vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vector of each trigram code."""
    out = np.empty((len(codes), dimensions), np.float32)
    parts = [(codes >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)]
    known, place = np.unique(np.concatenate(parts), return_inverse=True)
    base = np.stack([_letter(int(p), dimensions) for p in known]) if len(known) else np.zeros((0, dimensions), np.int8)
    rolled = [np.roll(base, k, axis=1) for k in range(3)]
    a, b, c = np.split(place, 3)
    for i in range(0, len(codes), 1024):
        out[i : i + 1024] = rolled[0][a[i : i + 1024]] * rolled[1][b[i : i + 1024]] * rolled[2][c[i : i + 1024]]
    return out


def bundled(codes: np.ndarray, n: np.ndarray, dimensions: int) -> np.ndarray:
    """The sum of the trigrams' vectors, each as often as it occurs: whole numbers."""
    out = np.zeros(dimensions)
    for i in range(0, len(codes), 2048):
        out += n[i : i + 2048].astype(np.float64) @ vectors(codes[i : i + 2048], dimensions)
    return np.rint(out).astype(np.int64)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit length) from rows with ``text`` and ``lang``."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}

        def vector(name: str) -> pa.RecordBatch:
            found, n = sums.pop(name)
            return pa.RecordBatch.from_pydict({"lang": pa.array([name] * dimensions, pa.string()), "place": pa.array(np.arange(dimensions), pa.int32()), "value": pa.array(bundled(found, n, dimensions))})

        for batch in batches:
            for part in blocks(batch):
                codes, owner, _ = trigrams(part.column("text"))
                names = part.column("lang").dictionary_encode()
                index = names.indices.to_numpy(zero_copy_only=False)[owner]
                for k, name in enumerate(names.dictionary.to_pylist()):
                    found, n = np.unique(codes[index == k], return_counts=True)
                    if name in sums:
                        both = np.concatenate([sums[name][0], found])
                        found, place = np.unique(both, return_inverse=True)
                        n = np.bincount(place, np.concatenate([sums[name][1], n]), len(found)).astype(np.int64)
                    sums[name] = [found, n]
                    if len(found) > MOST_TRIGRAMS:
                        yield vector(name)
        for name in list(sums):
            yield vector(name)

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    table = rows.mapInArrow(bundle, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    protos = np.zeros((len(names), dimensions))
    protos[[names.index(x) for x in table.column("lang").to_pylist()], table.column("place").to_numpy()] = table.column("value").to_numpy()
    protos -= 0.5 * protos.mean(axis=0)  # half of what all languages share says nothing about one of them
    return names, (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def cosines(texts: pa.Array, protos: np.ndarray, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each text with each prototype, and whether the text has a letter."""
    codes, owner, has = trigrams(texts)
    out = np.zeros((len(has), len(protos)), np.float32)
    at = np.searchsorted(owner, np.arange(len(has) + 1))
    for i in range(0, len(has), rows):
        j = min(i + rows, len(has))
        found, place = np.unique(codes[at[i] : at[j]], return_inverse=True)
        counts = np.bincount((owner[at[i] : at[j]] - i) * len(found) + place, minlength=(j - i) * len(found)).reshape(j - i, len(found)).astype(np.float32)
        docs = np.zeros((j - i, protos.shape[1]), np.float32)
        for k in range(0, len(found), 2048):
            docs += counts[:, k : k + 2048] @ vectors(found[k : k + 2048], protos.shape[1])
        docs /= np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-12)
        out[i:j] = docs @ protos.T
    return out, has


def predict(docs: DataFrame, names: list[str], protos: np.ndarray, extra: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score: the cosine, cut to 0..1. ``extra`` columns pass through."""
    sent, extra = docs.sparkSession.sparkContext.broadcast(protos), extra if extra is not None else ["doc_id"]
    keep = list(dict.fromkeys([*extra, "text"]))
    fields = StructType([docs.schema[c] for c in extra]).add("lang_pred", "string").add("score", "double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*names, UNDETERMINED], object)
        for batch in batches:
            for part in blocks(batch):
                cos, has = cosines(part.column("text"), sent.value)
                if names:
                    best = np.where(has, cos.argmax(axis=1), len(names))
                    score = np.where(has, np.clip(cos.max(axis=1), 0, 1), 0)
                else:
                    best, score = np.zeros(len(has), int), np.zeros(len(has))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), pa.array(known[best], pa.string()), pa.array(score, pa.float64())], [*extra, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(label, fields)


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row."""
    # a null doc_id has no remainder: it is neither held out nor learned from
    names, protos = learn(docs.where(fold_of(F.col("doc_id")) != 1))
    held = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return predict(docs, names, protos).select("doc_id", held.alias("held_out"), "lang_pred", "score")
