"""Dedup of repeated strings by bucket-pointer refinement: removes bytes of strings that start earlier elsewhere.

A suffix array would sort all positions; here only the order's question is asked, whether a position's first
``length`` bytes also start at an earlier one. Positions are in buckets whose strings have their first bytes in common.
A bucket's identifier is a name that equal strings get in every task:

* initial buckets are those of q-grams, named by a hash of their bytes;
* a bucket of positions that agree in ``w`` bytes is refined by the identifiers of the positions ``w`` later: the pair
  (identifier here, identifier there) names a bucket of ``2 w`` bytes, and the names made so are used again for the next
  step (25, 50, 100 bytes). Each text's names are made where the text is; bytes are read for the q-grams only.

Which positions have to be sorted by their buckets is narrowed down, and only buckets that are still open go on:

1. Each string of ``length`` bytes is represented by one q-gram in it, the one of the smallest name (leftmost of
   equals), so equal strings have it at the same offset. Strings with the same such place are neighbours and one
   *unit*; a q-gram that occurs once closes the buckets of all its strings at once.
2. A unit's bucket is named by the identifiers of its first string and of the one ``n - 1`` later, its last. A unit that
   occurred before is removed whole; in it no single string is looked at again. A q-gram whose units are all alike is done.
3. What is left are q-grams with several different units, at the edges of repeats. The first place of each
   different unit is cut into parts of up to ``STEP`` neighbouring strings; a part that occurred before is removed whole.
4. The first place of each different part is refined by the bucket of the bytes that its strings have in common. Only
   where that occurs more than once are there single strings to be compared, by their full buckets.

First places are grouped minima, combined before the shuffle, and return by equi-joins that adaptive
execution splits, so neither a passage in a third of all documents nor thousands of copies meet in one task.
Units are told apart by two 64-bit names, the q-gram's and their own.

Defined results: null texts are empty; texts below ``length`` bytes lose nothing; rows that repeat
a doc_id and a text are the same place, so none of them is earlier than the other; different texts of one doc_id come one
after the other, by Spark's ``hash`` of the text; a null doc_id is no place: such rows lose nothing to others and remove
nothing; columns besides doc_id and text are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.llm.textblocks import blocks, flat, mix, named
from strataq.tables import discard, written

LENGTH = 100
Q = 25
STEP = 16
#: Bytes of text whose parts are made at a time; there can be one for each byte.
ASKED_BYTES = 1 << 18
_PART = 1 << 19
_P = 0x9E3779B97F4A7C55
_M = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 24) - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))])
    return ones(np.uint64(_P)), ones(np.uint64(pow(_P, -1, 1 << 64)))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def initial_buckets(part: np.ndarray, q: int) -> np.ndarray:
    """The identifiers of all q-grams of at most two ``_PART`` bytes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[part] * _powers(2 * _PART)[0][: len(part)])])
    n = len(part) - q + 1
    return mix((sums[q:] - sums[:n]) * _powers(2 * _PART)[1][:n])


def refine(ids: np.ndarray, have: int, width: int) -> np.ndarray:
    """Identifiers of ``width`` bytes from those of ``have``: pairs with the identifiers of later offsets, again and again."""
    while have < width:
        step = min(have, width - have)
        ids = mix(ids[:-step] * _M + ids[step:])
        have += step
    return ids


def bucket_ids(buf: np.ndarray, places: np.ndarray, width: int, q: int) -> np.ndarray:
    """Identifiers of the ``width`` bytes at all places."""
    out, i = np.empty(len(places), np.uint64), 0
    rise = np.argsort(places, kind="stable")
    places = places[rise]
    while i < len(places):
        base = int(places[i])
        j = int(np.searchsorted(places, base + _PART, "left"))
        part = buf[base : int(places[j - 1]) + width]
        out[rise[i:j]] = refine(initial_buckets(part, q), q, width)[places[i:j] - base]
        i = j
    return out


def run_ids(head: np.ndarray, tail: np.ndarray, lead: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of ``n`` neighbouring strings by those of the first and of the last one, and by the place of their q-gram."""
    return mix(mix(head * _M + tail) + (lead * length + n).astype(np.uint64))


def units(buf: np.ndarray, offsets: np.ndarray, length: int, q: int, named: bool = True) -> tuple[np.ndarray, ...]:
    """For each unit: its q-gram's identifier and place, the first of its strings and their number (flat places), its own identifier."""
    span = length - q + 1  # q-grams of a string
    room = np.zeros(len(buf) + 1, np.int64)  # starts of whole strings
    heads, tails = offsets[:-1], offsets[1:] - length + 1
    has = tails > heads
    np.add.at(room, heads[has], 1)
    np.add.at(room, tails[has], -1)
    valid = np.cumsum(room[:-1]) > 0
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(buf), _PART):
        last = min(at + _PART, len(buf) - length + 1)
        if last <= at or not valid[at:last].any():
            continue
        grams = initial_buckets(buf[at : last + length - 1], q)
        names = refine(grams, q, length) if named else grams
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: last - at], least[span - width : span - width + last - at])
        place = (least[: last - at] & _LOW).astype(np.int64)
        ok = valid[at:last]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
        inner = offsets[(offsets > at) & (offsets < last)] - at
        first[inner] = ok[inner]
        s = np.flatnonzero(first)
        count = np.add.reduceat(ok.astype(np.int64), s)
        found.append((grams[place[s]], place[s] + at, s + at, count, names[s], names[s + count - 1]))
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    gram, place, start, count, head, tail = (np.concatenate(x) for x in zip(*found, strict=True))
    same = np.zeros(len(place), bool)  # a unit that two parts share
    same[1:] = (place[1:] == place[:-1]) & (start[1:] == start[:-1] + count[:-1])
    keep = np.flatnonzero(~same)
    n = np.add.reduceat(count, keep) if len(keep) else count
    tail = tail[np.append(keep[1:], len(same)) - 1]
    return gram[keep], place[keep], start[keep], n, run_ids(head[keep], tail, place[keep] - start[keep], n, length)


def tag_of(text: Column) -> Column:
    """Tells the texts of rows that repeat a doc_id apart, and puts them in an order."""
    return F.hash(text)


def find_units(docs: DataFrame, length: int, q: int) -> DataFrame:
    """gram, unit (identifiers), doc_id, start (of the first string), tag, n (strings), lead (from start to the q-gram) of every unit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                buf, offsets = flat(part.column("text"))
                gram, place, start, n, own = units(buf, offsets, length, q)
                owner = np.searchsorted(offsets, start, "right") - 1
                ids, tags = (part.column(c).take(pa.array(owner)) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(own.view(np.int64)), ids, pa.array(start - offsets[owner]), tags, pa.array(n.astype(np.int32)), pa.array((place - start).astype(np.int32))], ["gram", "unit", "doc_id", "start", "tag", "n", "lead"])

    return docs.mapInArrow(scan, "gram long, unit long, doc_id long, start long, tag int, n int, lead int")


def find_grams(docs: DataFrame, length: int, q: int) -> DataFrame:
    """The gram of every unit alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(units(*flat(part.column("text")), length, q, named=False)[0].view(np.int64))], ["gram"])

    return docs.select("text").mapInArrow(scan, "gram long")


def refined(docs: DataFrame, open_: DataFrame, length: int, step: int, q: int) -> DataFrame:
    """gram, key, own (identifiers), doc_id, start, tag, n, lead of the parts of units (gram, doc_id, start, tag, n, lead).

    A part holds the strings whose distance to the q-gram is in one block of ``step``. Its key is the bucket of the
    bytes that all strings of that block have in common, ``own`` that of its own strings. With a step of 1 parts are
    single strings.
    """
    asks = open_.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "start", "n", "lead")).alias("asks"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=ASKED_BYTES):
                buf, offsets = flat(part.column("text"))
                lists = part.column("asks")
                asked, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                gram, begin, n, lead = (asked.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", "start", "n", "lead"))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                low, high = (lead - n + 1) // step, lead // step  # blocks of distances
                count = high - low + 1
                each = np.repeat(np.arange(len(n)), count)
                block = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                place = (begin + lead)[each]
                first = np.maximum(begin[each], place - block * step - step + 1)
                last = np.minimum((begin + n - 1)[each], place - block * step)
                base = offsets[owner[each]]
                key = own = mix(bucket_ids(buf, place - block * step + base, length - step + 1, q) + block.astype(np.uint64))
                if step > 1:
                    own = run_ids(*(bucket_ids(buf, x + base, length, q) for x in (first, last)), place - first, last - first + 1, length)
                ids, tags = (part.column(c).take(pa.array(owner[each])) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(gram[each]), pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), ids, pa.array(first), tags, pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32))], ["gram", "key", "own", "doc_id", "start", "tag", "n", "lead"])

    return docs.join(asks, ["doc_id", "tag"]).mapInArrow(scan, "gram long, key long, own long, doc_id long, start long, tag int, n int, lead int")


def _place() -> Column:
    return F.struct("doc_id", "tag", "start")


def several(firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Those keys that more than one row has."""
    return firsts.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").select(*keys)


def first_places(runs: DataFrame, keys: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """The first of the runs that are alike by their keys, and the byte ranges of all others."""
    firsts = written(runs.groupBy(*keys).agg(F.min(F.struct("doc_id", "tag", "start", "n", "lead")).alias("first"), F.count("*").alias("k")), "firsts")
    at = firsts.where("k > 1").select(*keys, F.struct("first.doc_id", "first.tag", "first.start").alias("at"))
    later = runs.join(at, keys).where(_place() > F.col("at"))
    ranges = written(later.select("doc_id", "tag", "start", (F.col("start") + F.col("n") + length - 1).alias("end")), "whole")
    return firsts.select(*keys, "first.*"), ranges


def repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Rows (doc_id, tag, ranges): byte ranges (start, end), perhaps overlapping, that together hold all repeated strings' bytes."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag_of(F.col("text")).alias("tag"))
    # 1. units whose q-gram occurs more than once
    shared = find_grams(docs, length, q).groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    open_ = written(find_units(docs, length, q).join(shared, "gram", "left_semi"), "units")
    # 2. the first place of each different unit; later ones are repeated whole
    firsts, whole = first_places(open_, ["gram", "unit"], length)
    discard(open_)
    # 3. q-grams with several different units: the first place of each different part
    edges = written(firsts.join(several(firsts, ["gram"]), "gram", "left_semi").drop("unit"), "edges")
    discard(firsts)
    parts = written(refined(docs, edges, length, STEP, q), "parts")
    discard(edges)
    firsts, again = first_places(parts, ["gram", "key", "own"], length)
    discard(parts)
    # 4. single strings
    some = written(firsts.join(several(firsts, ["gram", "key"]), ["gram", "key"], "left_semi").drop("key", "own"), "some")
    discard(firsts)
    strings = written(refined(docs, some, length, 1, q), "strings")
    discard(some)
    known = strings.groupBy("gram", "key").agg(F.min(_place()).alias("at"), F.count("*").alias("k")).where("k > 1").select("gram", "key", "at")
    single = strings.join(known, ["gram", "key"]).where(_place() > F.col("at")).select("doc_id", "tag", "start", (F.col("start") + length).alias("end"))
    # rows that are the same text of the same doc_id name the same ranges: a set, so that many such rows don't make a long list
    ranges = whole.unionByName(again).unionByName(single).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    ranges = written(ranges, "ranges")
    discard(whole, again, strings)
    return ranges


def runs_of(ranges: pa.StructArray) -> np.ndarray:
    """The maximal runs (start, end) that overlapping or touching ranges of one text make."""
    start, end = (ranges.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > upto[:-1]]))
    return np.stack([start[first], upto[np.append(first[1:], len(start)) - 1]], axis=1)


def cut_out(raw: bytes, runs: np.ndarray) -> bytes:
    """What is left of the bytes without the runs."""
    kept, at = [], 0
    for start, end in runs.tolist():
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, q: int = Q, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    With ``text`` also ``kept``, the text left (without parts of characters that a cut fell within), ``whole``, the text as it was, and
    ``record``, a struct of the row's other columns.
    """
    ranges = repeats(docs, length, q)
    others = F.struct(*(named(docs, c) for c in docs.columns if c != "text"))
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if text:
        schema = schema.add("kept", "string").add("whole", "string").add("record", docs.select(others.alias("record")).schema[0].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                lists, out = part.column("ranges"), {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for k, value in enumerate(part.column("text").to_pylist()):
                    raw = (value or "").encode()
                    runs = runs_of(lists[k].values) if lists[k].is_valid else np.zeros((0, 2), np.int64)
                    left = cut_out(raw, runs)
                    for name, x in zip(out, (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if text else None), strict=True):
                        out[name].append(x)
                columns = {"doc_id": part.column("doc_id")} | {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}
                if text:
                    columns |= {"kept": pa.array([x.decode("utf-8", "ignore") for x in out["kept"]], pa.string()), "whole": part.column("text"), "record": part.column("record")}
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag_of(F.col("text")).alias("tag"), *[others.alias("record")] * text)
    joined = rows.join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges", *["record"] * text)
    return joined.mapInArrow(apply, schema)
