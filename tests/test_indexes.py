"""Stored indexes give what the arms give, and read only a part; scoped questions find nothing that they may not see."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataq.functions.english import content_words
from strataq.operators import indexes, scope, search
from strataq.operators import retrieval as R
from strataq.tables import shared_folder

OWNERS = [None, "a", "b", "c"]


@pytest.fixture(scope="module")
def clusters(spark):
    """Vectors in 40 clusters, some of them broken; document and holder for scopes."""
    r = np.random.default_rng(4)
    middles = r.normal(size=(40, 12))
    rows = [(i, (middles[i % 40] + 0.15 * r.normal(size=12)).tolist(), i // 5, OWNERS[i // 5 % 4]) for i in range(4000)]
    rows += [(9000, None, 1, None), (9001, [0.0] * 12, 1, None), (9002, [1.0, None] + [0.0] * 10, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>, document_id long, holder string"), rows


@pytest.fixture(scope="module")
def asked(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=12).tolist(), [None, "a", "b", "z"][i % 4], None if i % 3 == 0 else [] if i % 3 == 1 else [i, i + 1, i + 2, 10**6]) for i in range(30)]
    return spark.createDataFrame(rows, "question_id long, vector array<double>, owner_id string, requested array<bigint>")


@pytest.fixture(scope="module")
def vector_index(clusters, spark):
    path = f"{shared_folder(spark)}/vectors-of-tests"
    indexes.write_vectors(clusters[0], path)
    return path


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_every_usable_vector_is_indexed(spark, clusters, vector_index):
    held = spark.read.parquet(f"{vector_index}/cells")
    assert sorted(r[0] for r in held.select("doc_id").collect()) == list(range(4000))
    assert held.select("cell").distinct().count() > 30


def test_few_cells_find_what_all_do(spark, clusters, asked, vector_index):
    near = clusters[0].where("doc_id < 30").select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("vector"))
    exact = R.dense_arm(clusters[0].where("doc_id < 9000"), near)
    cells = spark.read.parquet(f"{vector_index}/centroids").count()
    found = indexes.near_arm(spark, vector_index, near, probes=4)
    assert indexes.recall(found, exact).first().recall >= 0.95
    probed = indexes.probed_cells(vector_index, near, 4).collect()
    assert max(len(r.cells) for r in probed) == 4 < cells / 5  # a question reads less than a fifth of the partitions
    one = near.where("question_id = 3")
    held = spark.read.parquet(f"{vector_index}/cells")
    frame, _ = indexes._probe(held, indexes._centroids(spark, vector_index), one.withColumnRenamed("vector", "v").select("question_id", F.col("v").alias("vector")).collect(), 40, 4)
    assert "PartitionFilters: [cell" in frame._jdf.queryExecution().executedPlan().toString()
    assert indexes.enough_probes(clusters[0].where("doc_id < 9000"), vector_index, near) <= cells / 5


def test_all_cells_give_the_exact_arm(spark, clusters, asked, vector_index):
    for questions in (asked.drop("owner_id", "requested"), asked):
        exact = R.dense_arm(clusters[0].where("doc_id < 9000"), questions, 10)
        found = indexes.near_arm(spark, vector_index, questions, 10, probes=10**6)
        assert rows_of(found, "question_id", "doc_id", "dense_rank") == rows_of(exact, "question_id", "doc_id", "dense_rank")


def test_a_scope_probes_more_cells(spark, clusters, asked, vector_index, monkeypatch):
    seen = []
    probe = indexes._probe
    monkeypatch.setattr(indexes, "_probe", lambda held, middle, block, candidates, probes: (seen.append(probes), probe(held, middle, block, candidates, probes))[1])
    indexes.near_arm(spark, vector_index, asked, probes=3)
    indexes.near_arm(spark, vector_index, asked.drop("owner_id", "requested"), probes=3)
    assert seen == [12, 3]


def test_an_index_of_nothing(spark, clusters, asked):
    path = f"{shared_folder(spark)}/no-vectors"
    indexes.write_vectors(clusters[0].where("doc_id > 9000"), path)
    assert spark.read.parquet(f"{path}/centroids").count() == 1


TEXTS = ["Use ef_search=40 with HNSW", "EF_SEARCH and hnsw", "efXsearch", "a-b", "Ab", None, "", "naïve Café №5", "CAFÉ noir", "Kelvin scale", "kelvin", "İxyz", "100% sure", "x", "日本語テキスト abc", "zz zz zz", "q7", "back\\slash"]
IDENTIFIERS = [["ef_search", "hnsw"], ["ab", "a-b"], ["Café", "café noir"], ["kelvin"], ["ixyz", "xyz"], ["100%"], ["%", "__"], ["日本語", "本語テキスト"], [], None, ["missing thing"], ["x"], ["  hnsw  "], ["zz zz", "q7"], ["back\\slash"], ["a" * 65]]


@pytest.fixture(scope="module")
def named(spark):
    held = [(i, t, i // 2, OWNERS[i % 4]) for i, t in enumerate(TEXTS * 3)]
    questions = [(i, ids, ["a", None, "b"][i % 3], [0, 1, 2, 3] if i % 4 == 0 else None) for i, ids in enumerate(IDENTIFIERS)]
    return spark.createDataFrame(held, "doc_id long, text string, document_id long, holder string").repartition(3), spark.createDataFrame(questions, "question_id long, identifiers array<string>, owner_id string, requested array<bigint>")


def test_trigrams_give_the_identifier_arm(spark, named):
    passages, questions = named
    path = f"{shared_folder(spark)}/trigrams-of-tests"
    indexes.write_trigrams(indexes.trigram_postings(passages), path)
    for q in (questions.drop("owner_id", "requested"), questions):
        want = rows_of(R.identifier_arm(passages, q), "question_id", "doc_id", "ident_score", "ident_rank")
        assert want and rows_of(indexes.indexed_identifiers(spark.read.parquet(path), passages, q), "question_id", "doc_id", "ident_score", "ident_rank") == want


def test_only_texts_with_the_rarest_trigrams_are_read(spark, monkeypatch):
    r = random.Random(1)
    passages = spark.createDataFrame([(i, " ".join(r.choice(["common", "words", "here"]) for _ in range(20)) + (" rareId-77" if i % 100 == 3 else "")) for i in range(1000)], "doc_id long, text string")
    read, hits = [], R.identifier_hits
    monkeypatch.setattr(R, "identifier_hits", lambda texts, *rest: (read.append(texts.count()), hits(texts, *rest))[1])
    questions = spark.createDataFrame([(1, ["RAREID"])], "question_id long, identifiers array<string>")
    lists = indexes.trigram_postings(passages)
    assert [r[1] for r in rows_of(indexes.indexed_identifiers(lists, passages, questions), "question_id", "doc_id")] == list(range(3, 1000, 100))
    assert read == [10]
    monkeypatch.setattr(indexes, "MOST_LISTED", 3)  # joined instead of listed
    assert indexes.indexed_identifiers(lists, passages, questions).count() == 10


def test_trigrams_of_texts():
    code, owner = indexes.trigrams(pa.array(["ABCab", None, "né", "xaéabc", ""]))
    name = lambda c: chr(c >> 14) + chr(c >> 7 & 127) + chr(c & 127)
    assert sorted((int(o), name(int(c))) for c, o in zip(code, owner, strict=True)) == [(0, "abc"), (0, "bca"), (0, "cab"), (3, "abc")]
    assert indexes.grams_of("ab_cd%ef") == set() and {name(g) for g in indexes.grams_of("ABcéabcd")} == {"abc", "bcd"}


@pytest.fixture(scope="module")
def worded(spark):
    r = random.Random(9)
    words = [a + b for a in "bcdfgh" for b in "jklmnpqrxz"] + ["the", "of"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([3, 5, 8, 200]) if i % 50 else 0)) for i in range(600)]
    held = [(i, t if i % 77 else None, i // 3, OWNERS[i % 4]) for i, t in enumerate(texts)]
    questions = [(i, " ".join(r.choice(words) for _ in range(4)), [None, "a", "z"][i % 3], [i, i + 5, 100] if i % 2 else None) for i in range(25)] + [(99, "unknown", None, None), (98, "the of", None, None)]
    return spark.createDataFrame(held, "doc_id long, text string, document_id long, holder string").repartition(2), spark.createDataFrame(questions, "question_id long, question string, owner_id string, requested array<bigint>")


@pytest.mark.parametrize("scoped", [False, True])
def test_pruned_postings_give_the_lexical_arm(spark, worded, scoped):
    passages, questions = worded
    passages, questions = (passages, questions) if scoped else (passages.drop("document_id", "holder"), questions.drop("owner_id", "requested"))
    blocks = indexes.postings(indexes.with_lexemes(passages, content_words), rows=16)
    path = f"{shared_folder(spark)}/postings-{scoped}"
    indexes.write_postings(blocks, path)
    want = rows_of(R.lexical_arm(passages, questions, 5), "question_id", "doc_id", "sparse_score", "sparse_rank")
    assert want and rows_of(indexes.indexed_arm(spark.read.parquet(path), questions, content_words, 5, first=1), "question_id", "doc_id", "sparse_score", "sparse_rank") == want


def test_blocks_that_cannot_help_are_left_out(spark, worded, monkeypatch):
    passages, questions = worded[0].drop("document_id", "holder"), worded[1].where("question_id < 90").drop("owner_id", "requested")
    blocks = indexes.postings(indexes.with_lexemes(passages, content_words), rows=16)
    looked, keep = {}, indexes.written
    monkeypatch.setattr(indexes, "written", lambda df, name="step": looked.setdefault(name, keep(df, name)))
    indexes.indexed_arm(blocks, questions, content_words, 5).collect()
    first, others, wanted, every = {}, {}, 0, 0
    for rows, into in ((looked["first"], first), (looked["others"], others)):
        for r in rows.collect():
            into.setdefault(r.question_id, []).append(r.score)
    for q, scores in first.items():
        least = sorted(scores)[-5] if len(scores) >= 5 else 0
        rest = [r.bound for r in looked["bounds"].where(F.col("question_id") == q).collect() if r.place > indexes.FIRST_BLOCKS]
        near = [b for b in rest if b >= least]
        assert len(others.get(q, [])) <= 16 * len(near)  # nothing comes from another block
        assert max(others.get(q, [0])) <= max(rest, default=0)
        wanted, every = wanted + len(near), every + len(rest)
    assert every > 500 and wanted < every / 4


def may(question, holder, document):
    return (holder is None or holder == question.owner_id) and (not question.requested or document in question.requested)


def test_scopes_are_those_of_the_rule(spark, named, worded, clusters, asked):
    for rows, questions in ((worded[0].collect(), worded[1].collect()), (named[0].collect(), named[1].collect())):
        bits = scope.Scope(questions).allowed(pa.array([r.document_id for r in rows]), pa.array([r.holder for r in rows], pa.string()))
        assert bits.tolist() == [[may(q, r.holder, r.document_id) for q in questions] for r in rows]
    passages, questions = worded
    allowed = {(q.question_id, r.doc_id) for q in questions.collect() for r in passages.collect() if may(q, r.holder, r.document_id)}
    whole = R.lexical_arm(passages.drop("holder", "document_id"), questions.drop("owner_id", "requested"), 10**6)
    assert set(rows_of(R.lexical_arm(passages, questions, 10**6), "question_id", "doc_id")) == allowed & set(rows_of(whole, "question_id", "doc_id"))
    dense = R.dense_arm(clusters[0].where("doc_id < 200"), asked, 10**6)
    assert set(rows_of(dense, "question_id", "doc_id")) == {(q.question_id, r[0]) for q in asked.collect() for r in clusters[1][:200] if may(q, r[3], r[2])}
    ident = R.identifier_arm(named[0], named[1], 10**6)
    assert all((q, d) in {(q.question_id, r.doc_id) for q in named[1].collect() for r in named[0].collect() if may(q, r.holder, r.document_id)} for q, d in rows_of(ident, "question_id", "doc_id"))


def test_a_missing_list_is_not_everything(spark):
    documents = spark.createDataFrame([(1, None, "ready", None), (2, "a", "ready", None), (3, "b", "ready", None), (4, None, "failed", None), (5, "a", "ready", 6), (6, "a", "ready", None)], "document_id long, owner_id string, status string, superseded_by long")
    requests = spark.createDataFrame([(1, "a", None), (2, "a", []), (3, "a", [3]), (4, None, None), (5, "z", [2, 3, 4]), (6, "b", [3, 1, 99]), (7, "a", [None, 2])], "request_id long, owner_id string, requested array<bigint>")
    found = {}
    for r in search.permitted(requests, documents).collect():
        found.setdefault(r.request_id, set()).add(r.document_id)
    assert found == {1: {1, 2, 6}, 2: {1, 2, 6}, 4: {1}, 6: {1, 3}, 7: {2}}


def test_a_search_shows_no_foreign_document_nor_neighbour(spark, worded):
    passages, questions = worded
    documents = passages.select("document_id").distinct().withColumns({"owner_id": F.when(F.col("document_id") % 3 != 0, F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("document_id") % 3).cast("int"))), "status": F.when(F.col("document_id") % 10 == 9, "failed").otherwise("ready"), "superseded_by": F.lit(None).cast("long")})
    held = passages.select("doc_id", "document_id", (F.col("doc_id") % 3).cast("int").alias("ordinal"), "text", F.array(F.lit(1.0), F.col("doc_id") % 7 + F.lit(0.5)).alias("embedding"))
    seen = scope.searchable(held, documents)
    asked = questions.withColumns({"vector": F.array(F.lit(0.3), F.lit(1.0)), "identifiers": F.array(F.lit("bj"))})
    found = search.search(seen, held.select("document_id", "ordinal", F.concat(F.lit("d"), F.col("document_id").cast("string"), F.lit("d")).alias("content")), asked)
    owner = {r.document_id: (r.owner_id, r.status) for r in documents.collect()}
    wants = {r.question_id: r for r in questions.collect()}
    hits = [r for r in found.collect() if r.found]
    assert hits
    for r in hits:
        for document in {int(x) for x in r.content.replace("\n", "").split("d") if x}:
            assert owner[document][1] == "ready" and may(wants[r.question_id], owner[document][0], document)


def test_questions_come_in_blocks(spark, worded):
    q = worded[1].select("question_id")
    for most in (4, 1000):
        blocks = list(R.question_blocks(q, most))
        assert max(map(len, blocks)) <= most and sorted(r.question_id for b in blocks for r in b) == sorted(r[0] for r in q.collect())
    assert list(R.question_blocks(q.where("false"), 4)) == []


def test_many_copies_leave_a_batch_few_rows():
    scores = np.repeat(np.array([[0.5, 0.1], [0.7, 0.1], [-2.0, 0.1]]), 400, axis=0)
    ids = np.arange(1200)[::-1].copy()
    found = R.best_of_batch(ids, scores, np.array([10, 20]), 5).to_pylist()
    by = {q: sorted(r["doc_id"] for r in found if r["question_id"] == q and r["score"] == s) for q, s in ((10, 0.7), (20, 0.1))}
    assert by == {10: [400, 401, 402, 403, 404], 20: [0, 1, 2, 3, 4]}


def test_blocks_of_postings_hold_few_words_of_passages_of_like_length():
    r = random.Random(3)
    lengths = [r.choice([0, 1, 3, 40, 900, 5000]) for _ in range(700)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([["w"] * n for n in lengths])], ["doc_id", "lexemes"])
    blocks = list(indexes.by_length(iter([whole.slice(at, 90) for at in range(0, 700, 90)]), 64, 4096))
    assert sorted(i for b in blocks for i in b.column("doc_id").to_pylist()) == list(range(700))
    held = [[lengths[i] for i in b.column("doc_id").to_pylist()] for b in blocks]
    assert all(len(own) <= 64 and (sum(own) <= 4096 or len(own) == 1) for own in held)
    assert sum(max(own) >= 2 * max(1, min(own)) for own in held) < 10  # what was left at the end


def test_postings_are_packed_without_a_sort(spark, worded):
    plan = indexes.postings(indexes.with_lexemes(worded[0], content_words))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Sort" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 16 << 20
