"""The parts that several operators share, by themselves."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strataq.llm import textblocks
from strataq.llm.components import components
from strataq.tables import discard, shared_folder, written

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = ["a bc  a\n", None, "", " \t", "ñandú — 日本 a", "x" * 70, "A b\x0bC\x0cd e f g"]


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(r.randrange(100, 180), r.randrange(100, 180)) for _ in range(60)] + [(200, k) for k in range(201, 260)] + [(300, 300), (-5, 900), (900, -7)]
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in pair and pair[0] != pair[1] for pair in links)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_and_their_spans():
    buf, offsets = textblocks.flat(pa.array(TEXTS))
    starts, ends, at = textblocks.word_spans(buf, offsets)
    raw = buf.tobytes()
    assert [[raw[starts[k] : ends[k]].decode() for k in range(a, b)] for a, b in zip(at[:-1], at[1:], strict=True)] == [WORD.findall(t or "") for t in TEXTS]
    hashes = textblocks.word_hashes(buf, starts, ends, lower=True, step=3)
    words = [w.lower() if w.isascii() else w for t in TEXTS for w in WORD.findall(t or "")]
    assert len({w: h for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(hashes.tolist())) == len(set(words))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngrams_stay_within_their_text(n):
    lists = [[1, 2, 3, 1, 2, 3], [], [1, 2], [7] * 9]
    words, at = np.array([w for own in lists for w in own], np.uint64), np.cumsum([0, *map(len, lists)])
    hashes, first = textblocks.ngrams(words, at, n)
    expected = [tuple(own[k : k + n]) for own in lists for k in range(len(own) - n + 1)]
    assert len(hashes) == len(expected) == len(first)
    assert len(set(zip(hashes.tolist(), expected, strict=True))) == len(set(expected)) == len(set(hashes.tolist()))
    _, rows = textblocks.short_hashes(words, at, n)
    assert sorted(rows.tolist()) == [k for k, own in enumerate(lists) if 0 < len(own) < n]


def test_blocks_hold_all_rows_in_bounded_pieces():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 40] * 30 + [None, "y" * 500, "", "z"])})
    parts = list(textblocks.blocks(batch, limit=100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(len("".join(t or "" for t in p.column("text").to_pylist())) <= 100 or p.num_rows == 1 for p in parts)
    assert list(textblocks.blocks(batch.slice(0, 0))) == []


def test_written_tables_can_be_given_back(spark):
    df = written(spark.range(1000), "rows")
    assert df.count() == 1000 and all(f.startswith(shared_folder(spark)) for f in df.inputFiles())
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    summed = written(df.groupBy((df.id % 3).alias("k")).count(), "sums")
    discard(df)
    assert sorted(r["count"] for r in summed.collect()) == [333, 333, 334]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    assert spark.read.parquet(df.inputFiles()[0].rpartition("/")[0]).count() == 0 if df.inputFiles() else True
