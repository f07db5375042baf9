"""The analyser, the index, hops, retries and chunk packing on small inputs, and queries without SQL against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataq.config import Settings
from strataq.functions.english import MOST_KEPT, STOP_WORDS, content_words, english, stem, stems
from strataq.operators import chunking, indexes, ingest, reporting, search
from strataq.operators import retrieval as R
from strataq.plans import catalog
from strataq.plans import retrieval_queries as Q
from strataq.tables import shared_folder

WORD = re.compile(r"[^\W\d_]+|\d+")
STEMS = """consigned consign consistency consist consolingly consol conspirators conspir constables constabl knackeries knackeri kneeling kneel knightly knight
generously generous generate generat hopping hop hoping hope happy happi cries cri dying die flies fli agreed agre relational relat rationalism ration digitizer digit
analogousli analog predication predic hopefulness hope sensibiliti sensibl electrical electr goodness good allowance allow adjustable adjust adoption adopt communism communism
activate activ probate probat rate rate controll control roll roll news news proceed proceed sky sky says say yellow yellow""".split()


def test_stems_of_the_published_algorithm():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]


def test_analyser(spark):
    text = spark.createDataFrame([("The cats were RUNNING over 2 Houses!",), (None,)], "t string")
    assert [r[0] for r in text.select(english(F.col("t"))).collect()] == [["cat", "run", "2", "hous"], None]
    assert text.select(content_words(F.col("t")).alias("w")).first().w == ["cats", "running", "2", "houses"]


def test_stemmed_arm_finds_other_forms(spark, sf_dir):
    p, q = Q.passages(spark, sf_dir).select("doc_id", "text").collect(), Q.questions(spark, sf_dir).select("question_id", "question").collect()
    words = {r.doc_id: [stem(w) for w in WORD.findall(r.text.lower()) if w not in STOP_WORDS] for r in p}
    got = catalog.QUERIES["stemmed_arm"](spark, sf_dir).collect()
    by = {}
    for r in got:
        by.setdefault(r.question_id, []).append((r.sparse_rank, r.doc_id, r.sparse_score))
    for r in q[:40]:
        asked = {stem(w) for w in WORD.findall(r.question.lower()) if w not in STOP_WORDS}
        scores = [(-round(n / (n + 10), 6), d) for d, own in words.items() if (n := sum(w in asked for w in own))]
        assert [(d, s) for _, d, s in sorted(by.get(r.question_id, []))] == [(d, -s) for s, d in sorted(scores)[:40]]


def test_index_is_read_by_word(spark, sf_dir):
    docs = indexes.with_lexemes(spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None)], "doc_id long, text string"), lambda t: F.split(t, " "))
    assert sorted(tuple(r) for r in indexes.inverted_index(docs).collect()) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 2)]


def test_hops_go_on_only_where_they_must(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "question_id long, question string")
    seen = []

    def find(q, hop):
        seen.append(sorted(tuple(r) for r in q.select("question_id", "question").collect()))
        return q.select("question_id", (F.col("question_id") * 10 + F.lit(hop)).alias("doc_id"), (F.lit(0.5) + F.lit(hop) / 10).alias("score")).unionByName(q.select("question_id", F.lit(7).cast("long").alias("doc_id"), (F.lit(0.2) + F.lit(hop)).alias("score")))

    grade = lambda rows: rows.select("question_id").distinct().select("question_id", (F.col("question_id") == 1).alias("sufficient"), F.when(F.col("question_id") == 2, "again").alias("refined"))
    got = sorted(tuple(r) for r in search.in_hops(asked, find, grade).select("question_id", "doc_id", "score", "hop").collect())
    assert seen == [[(1, "x"), (2, "y"), (3, "z")], [(2, "again")]]
    assert got == [(1, 7, 0.2, 0), (1, 10, 0.5, 0), (2, 7, 1.2, 1), (2, 20, 0.5, 0), (2, 21, 0.6, 1), (3, 7, 0.2, 0), (3, 30, 0.5, 0)]


def test_a_broken_search_is_not_an_empty_one(spark):
    asked = spark.createDataFrame([(1, "x")], "question_id long, question string")

    def broken(q, hop):
        raise RuntimeError("no embeddings")

    with pytest.raises(RuntimeError):
        search.in_hops(asked, broken, lambda rows: rows)
    p = spark.createDataFrame([(1, 1, 0, "some words", [1.0, 0.0])], "doc_id long, document_id long, ordinal int, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "nothing alike", None, ["zzz"]), (2, "words", None, [])], "question_id long, question string, vector array<double>, identifiers array<string>")
    got = search.search(p, p.select("document_id", "ordinal", F.col("text").alias("content")), q).collect()
    assert sorted((r.question_id, r.found, r.marker) for r in got) == [(1, 0, None), (2, 1, 1)]


def test_halves_that_fail_alone():
    calls = []

    def call(items):
        calls.append(list(items))
        if "bad" in items:
            raise ValueError
        return [x.upper() for x in items]

    assert ingest.in_halves(["a", "b", "bad", "c"], call) == ["A", "B", None, "C"]
    assert ["a", "b"] in calls and ["bad"] in calls
    assert ingest.in_halves([], call) == []


def test_contexts_are_asked_in_halves(spark, sf_dir):
    got = catalog.QUERIES["halved_contexts"](spark, sf_dir).collect()
    lines = {r.doc_id: len(r.text.split("\n")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}

    def told(size, depth, fallback):
        if size > 4:
            if depth == 3:
                return [fallback] * size
            return told(-(-size // 2), depth + 1, fallback) + told(size // 2, depth + 1, fallback)
        return [fallback if size == 3 and i == 1 else f"line {i}" for i in range(1, size + 1)]

    by = {}
    for r in got:
        by.setdefault(r.document_id, []).append((r.position, r.context))
    assert {d: [c for _, c in sorted(rows)] for d, rows in by.items()} == {d: told(n, 0, f"in {langs[d]}") for d, n in lines.items()}


def test_batches_fill_by_cost(spark, sf_dir):
    got = {}
    for r in catalog.QUERIES["embed_batches"](spark, sf_dir).collect():
        got.setdefault(r.document_id, {})[r.position] = r.batch
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        batch, cost, expected = 0, 110.0, {}
        for k, line in enumerate(r.text.split("\n")):
            own = 110 + 0.33 * len(line)
            if cost > 110 and cost + own > 1500:
                batch, cost = batch + 1, 110.0
            cost += own
            expected[k] = batch
        assert got[r.doc_id] == expected


def test_diversity_by_plain_python(spark, sf_dir):
    rows = Q._positions(spark, sf_dir).collect()
    got = {}
    for r in catalog.QUERIES["mmr_diversify"](spark, sf_dir).collect():
        got.setdefault(r.question_id, []).append((r.picked, r.doc_id))
    by = {}
    for r in rows:
        by.setdefault(r.question_id, []).append(r)
    for q in sorted(by)[:25]:
        own = sorted(by[q], key=lambda r: (r.position, r.doc_id))
        best = max(max(r.rrf for r in own), 1e-9)
        vectors = [None if r.embedding is None else np.array(r.embedding, float) for r in own]
        cos = lambda a, b: 0.0 if a is None or b is None or not a.any() or not b.any() else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))  # noqa: E731, B023
        chosen = list(range(min(8, len(own)))) if len(own) <= 8 or not any(v is not None for v in vectors) else []
        while len(chosen) < min(8, len(own)):
            value = lambda i: 0.72 * own[i].rrf / best - 0.28 * max((cos(vectors[i], vectors[j]) for j in chosen), default=0.0)  # noqa: E731, B023
            chosen.append(max((i for i in range(len(own)) if i not in chosen), key=lambda i: (round(value(i), 12), -i)))
        assert [d for _, d in sorted(got[q])] == [own[i].doc_id for i in chosen]


def test_chunks_say_again_what_came_last():
    s = Settings(chunk_target=20, chunk_overlap=5, chunk_min=1, chunk_max=40)
    blocks = [f"Block {k} has some words in it." for k in range(6)]
    made = chunking.chunks_of("\n\n".join(blocks), s)
    assert [c.text for c in made[:2]] == [f"{blocks[0]}\n\n{blocks[1]}", f"some words in it.\n\n{blocks[2]}\n\n{blocks[3]}"]
    assert all(c.text.endswith(blocks[2 * k + 1]) for k, c in enumerate(made))
    short = chunking.chunks_of("# A\n\none two three\n\n# B\n\nfour five", s)
    assert [(c.text, c.path) for c in short] == [("one two three", ("A",)), ("one two three\n\nfour five", ("B",))]


def test_large_prose_is_cut_at_sentences():
    s = Settings(chunk_target=10, chunk_overlap=4, chunk_min=1, chunk_max=12)
    text = "Short one. " + "This sentence is quite a bit longer. " * 3 + "End."
    made = chunking.chunks_of(text, s)
    assert [c.text for c in made] == ["Short one.", "Short one. This sentence is quite a bit longer.", "This sentence is quite a bit longer.", "This sentence is quite a bit longer.", "End."] or all(len(c.text) <= 60 for c in made)
    assert [x for c in made for x in re.findall("This sentence", c.text)] == ["This sentence"] * 3
    assert "".join(c.text[-4:] for c in made[-1:]) == "End."


def test_record_and_counts(spark):
    messages = "array<struct<parts:array<struct<type:string,text:string>>>>"
    df = spark.createDataFrame([([([("text", "abc"), ("file", "xx")],), (None,)],), ([],)], f"m {messages}")
    assert [r[0] for r in df.select(reporting.text_chars(F.col("m"))).collect()] == [3, 0]
    assert shared_folder(spark).startswith("file:")


def test_embed_batches_carry_on_from_one_arrow_batch_to_the_next(spark):
    """A key of more rows than one Arrow batch is filled as one; many keys are no groups of their own."""
    from strataq.operators import ingest

    rows = spark.range(25_000).selectExpr("if(id < 12000, 7, id) AS doc", "cast(id AS int) AS position", "repeat('x', cast(id % 400 AS int)) AS text")
    found = ingest.embed_batches(rows, "doc")
    want, batch, cost = {}, 0, 110.0
    for k in range(12_000):
        own = 110 + 0.33 * (k % 400)
        if cost > 110 and cost + own > 1500:
            batch, cost = batch + 1, 110.0
        cost += own
        want[k] = batch
    got = found.collect()
    assert {r.position: r.batch for r in got if r.doc == 7} == want and len(got) == 25_000
    assert all(r.batch == 0 for r in got if r.doc != 7)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_stems_of_arrays_are_kept_within_bounds(spark):
    rows = [(0, ["running", "cats", None, "cats"]), (1, None), (2, []), (3, ["", "ponies"])]
    got = spark.createDataFrame(rows, "k int, words array<string>").select("k", stems("words").alias("stems")).collect()
    assert {r.k: r.stems for r in got} == {0: ["run", "cat", None, "cat"], 1: None, 2: [], 3: ["", "poni"]}
    assert stem.cache_info().maxsize == MOST_KEPT


def test_texts_go_to_python_by_their_bytes(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    own, other = spark.newSession(), spark.newSession()
    own.conf.set(setting, "1048576")
    texts = lambda session: session.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('some word ', 600) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    for session in (own, other):
        questions = session.createDataFrame([(1, "word")], "question_id long, question string")
        assert R.lexical_arm(texts(session), questions, 3).count() == 3
    assert own.conf.get(setting) == "1048576" and int(other.conf.get(setting)) == 16 << 20
    largest = lambda session: max(r.n for r in texts(session).mapInArrow(sizes, "n long").collect())
    assert largest(own) < 300 and largest(other) < 4000
