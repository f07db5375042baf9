"""The pipeline's stages against brute force, over nulls, empty and repeated texts, and columns with odd names."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import joined_by_brute_force, leaks_by_brute_force

pipeline = pytest.importorskip("corpus_pipeline")

VOWELS = {"aa": "aei", "bb": "ouy"}


def documents():
    """Two made-up languages with near copies, shared passages, benchmark items, nulls, empty texts and texts of signs."""
    r = random.Random(21)

    def text(lang, n):
        return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice(VOWELS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    items = [(k, text("aa", 20)) for k in range(5)] + [(5, None), (6, "")]
    rows = [(lang, text(lang, r.randint(30, 120))) for lang in ("aa", "bb") for _ in range(40)]
    passage = text("bb", 40)
    rows += [("bb", f"{text('bb', 60)} {passage} {text('bb', 30)}") for _ in range(6)]
    base = rows[3][1].split(" ")
    rows += [("aa", " ".join(base[:k] + ["kikiki"] + base[k + 1 :])) for k in range(3)] + [rows[3], ("aa", rows[5][1]), (None, rows[5][1])]
    rows += [("aa", f"{text('aa', 50)} {items[2][1]} {text('aa', 50)}"), ("aa", items[4][1]), ("bb", None), ("bb", ""), ("aa", "1234 $$$ 99"), ("aa", "12 " * 60), (None, "\u4e00\u4e01")]
    rows = [(k, *row) for k, row in enumerate(rows)]
    return [*rows, rows[7], (None, *rows[8][1:])], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = documents()
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y") for i, lang, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, record string")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs.columns, items


def told(df):
    """All rows as tuples, in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The documents before and after each stage."""
    at, columns, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, at), name)
        assert docs.columns == columns
        out.append(docs)
    return out


def test_stages_call_the_operators_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "decontamination", "packing"]


def test_language_stage_keeps_all_that_is_like_a_language(steps):
    kept = told(steps[1])
    assert kept == sorted((r for r in told(steps[0]) if r[1] and re.search("[a-z]", r[1])), key=str)


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    before = told(steps[1])
    component = {i: c for i, _, c in joined_by_brute_force([r[:2] for r in before])}
    assert told(steps[2]) == [r for r in before if r[0] is None or component[r[0]] == r[0]]
    assert len(before) - len(told(steps[2])) >= 5


def test_passage_stage_cuts_what_repeats(spark, steps):
    tagged = sorted(steps[2].select("*", F.hash("text").alias("tag of text")).collect(), key=lambda r: str(tuple(r)[:-1]))
    rows = [(r[0], r[-1], r[1].encode()) for r in tagged]
    first = {}
    for i, g, raw in rows:
        for p in range(len(raw) - 99 if i is not None else 0):
            first[raw[p : p + 100]] = min(first.get(raw[p : p + 100], (i, g, p)), (i, g, p))
    expected = []
    for row, (i, g, raw) in zip(told(steps[2]), rows, strict=True):
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99 if i is not None else 0):
            if first[raw[p : p + 100]] < (i, g, p):
                gone[p : p + 100] = b"\x01" * 100
        left = bytes(c for c, gap in zip(raw, gone, strict=True) if not gap).decode()
        if not any(gone) or left.strip():
            expected.append((row[0], left, *row[2:4], len(left), *row[5:]))
    assert told(steps[3]) == sorted(expected, key=str)
    assert told(steps[3]) != told(steps[2])


def test_leak_stage_drops_what_holds_an_item(steps, folder):
    before = told(steps[3])
    leaks = {i for i, _ in leaks_by_brute_force([r[:2] for r in before], folder[2])}
    assert told(steps[4]) == [r for r in before if r[0] not in leaks]
    assert len(leaks) == 2


def test_run_packs_all_tokens_of_what_is_left(spark, steps, folder):
    from strataq.llm import packing

    path = packing.public_tokenizers.path("byte_bpe_50k.json")
    got = pipeline.run(spark, folder[0]).collect()
    pieces = sorted(((r.doc_id, r.start, r.length) for r in got), key=str)
    assert pieces == sorted(((r[0], 0, len(packing.encode(r[1], path))) for r in told(steps[4])), key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(p)[:k]) for p in by.values() for k, (o, _) in enumerate(sorted(p)))


def test_run_over_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_language_stage_drops_random_letters(spark, sf_dir):
    """The measured cut: no document falls below it, but most texts of random letters do."""
    r = random.Random(4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = [(10**6 + k, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), "xx", "noise", 400) for k in range(40)]
    # the noise has no label, so that its language isn't learned
    both = docs.unionByName(spark.createDataFrame(noise, docs.schema).withColumn("lang", F.lit(None).cast("string")))
    kept = [x.doc_id for x in pipeline.STAGES[0][1](spark, both, sf_dir).select("doc_id").collect()]
    assert sum(i >= 10**6 for i in kept) <= 10
    assert sorted(i for i in kept if i < 10**6) == sorted(x.doc_id for x in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect())
