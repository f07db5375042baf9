"""Retrieval queries on the fixture tables, with their SQL.

Documents are passages and carry the vector of the same id where there is one; benchmark items are the questions,
with the vector of the same id and an identifier made from their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.english import STOP_WORDS
from strataq.operators import retrieval as R
from strataq.operators import search
from strataq.tables import table


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    held = F.concat(F.col("text"), F.lit(" KEY_"), (F.col("doc_id") % 97).cast("string"))
    return docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select("doc_id", "source", held.alias("text"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    q = items.join(vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    ids = F.array(F.concat(F.lit("KEY_"), (F.col("item_id") % 97).cast("string")))
    return q.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "vector", ids.alias("identifiers"))


P_SQL = """
p AS (SELECT d.doc_id, d.source, d.text || ' KEY_' || (d.doc_id % 97) AS text, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
q AS (SELECT b.item_id AS question_id, b.text AS question, e.embedding AS vector, 'KEY_' || (b.item_id % 97) AS identifier FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)
"""
DENSE_SQL = """
ds AS (SELECT question_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]), 6) AS dense_score FROM p, q WHERE embedding IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense_score DESC, doc_id)::INT AS dense_rank FROM ds) WHERE dense_rank <= 40)
"""
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
LEX_SQL = rf"""
ql AS (SELECT DISTINCT question_id, lexeme FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM q) WHERE lexeme NOT IN {STOP_SQL}),
pl AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM p),
pc AS (SELECT doc_id, lexeme, count(*) AS c FROM pl GROUP BY ALL),
ls AS (SELECT question_id, doc_id, round(sum(c) / (sum(c) + 10), 6) AS sparse_score FROM ql JOIN pc USING (lexeme) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sparse_score DESC, doc_id)::INT AS sparse_rank FROM ls) WHERE sparse_rank <= 40)
"""
ID_SQL = """
hs AS (SELECT question_id, doc_id, 1 AS ident_score FROM q, p WHERE p.text ILIKE '%' || identifier || '%'),
ident AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ident_score DESC, doc_id)::INT AS ident_rank FROM hs) WHERE ident_rank <= 40)
"""
FUSED_SQL = """
j AS (SELECT coalesce(d.question_id, s.question_id, i.question_id) AS question_id, coalesce(d.doc_id, s.doc_id, i.doc_id) AS doc_id,
        dense_rank, dense_score, sparse_rank, sparse_score, ident_rank, ident_score::DOUBLE AS ident_score,
        round(coalesce(0.5 / (60 + dense_rank), 0) + coalesce(0.5 / (60 + sparse_rank), 0) + coalesce(0.6 / (60 + ident_rank), 0), 9)::DOUBLE AS rrf
      FROM dense d FULL JOIN sparse s ON s.question_id = d.question_id AND s.doc_id = d.doc_id
      FULL JOIN ident i ON i.question_id = coalesce(d.question_id, s.question_id) AND i.doc_id = coalesce(d.doc_id, s.doc_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, doc_id)::INT AS position FROM j) WHERE position <= 40)
"""
ALL_SQL = f"WITH {P_SQL}, {DENSE_SQL}, {LEX_SQL}, {ID_SQL}, {FUSED_SQL}"


def hybrid_search(spark, sf_dir):
    p = passages(spark, sf_dir)
    found = R.hybrid(p, questions(spark, sf_dir))
    return found.join(p.select("doc_id", "source"), "doc_id").select("question_id", "doc_id", "source", "dense_rank", "dense_score", "sparse_rank", "sparse_score", "ident_rank", "ident_score", "rrf", "position")


def dense_arm(spark, sf_dir):
    return R.dense_arm(passages(spark, sf_dir), questions(spark, sf_dir))


def lexical_arm(spark, sf_dir):
    return R.lexical_arm(passages(spark, sf_dir), questions(spark, sf_dir))


def identifier_arm(spark, sf_dir):
    return R.identifier_arm(passages(spark, sf_dir), questions(spark, sf_dir))


def scoped_search(spark, sf_dir):
    """None is the whole corpus, a list is that list, an empty list is nothing."""
    docs = table(spark, sf_dir, "documents")
    counts = [R.scoped(docs, ids).agg(F.lit(name).alias("scope"), F.count("*").alias("n")) for name, ids in (("all", None), ("some", [1, 2, 3]), ("none", []))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def cross_query_rrf(spark, sf_dir):
    """The lexical and then the dense list of each question as two sub-queries; questions divisible by 5 have one."""
    p, q = passages(spark, sf_dir), questions(spark, sf_dir)
    none = F.lit(None).cast("double")
    a = R.dense_arm(p, q).select("question_id", F.lit("dense").alias("query"), F.lit(1).alias("arrival"), F.col("dense_rank").alias("position"), "doc_id", (1 / (60 + F.col("dense_rank"))).alias("rrf"), "dense_score", none.alias("sparse_score"))
    b = R.lexical_arm(p, q).where("question_id % 5 <> 0").select("question_id", F.lit("lexical").alias("query"), F.lit(0).alias("arrival"), F.col("sparse_rank").alias("position"), "doc_id", (1 / (60 + F.col("sparse_rank"))).alias("rrf"), none.alias("dense_score"), "sparse_score")
    return R.fuse_queries(a.unionByName(b))


CROSS_SQL = f"""WITH {P_SQL}, {DENSE_SQL}, {LEX_SQL},
u AS (SELECT question_id, 'dense' AS query, 1 AS arrival, dense_rank AS position, doc_id, dense_score, NULL::DOUBLE AS sparse_score FROM dense
      UNION ALL SELECT question_id, 'lexical', 0, sparse_rank, doc_id, NULL, sparse_score FROM sparse WHERE question_id % 5 <> 0),
f AS (SELECT question_id, doc_id, round(sum(1.0::DOUBLE / (60 + position)), 9) AS rrf, string_agg(query, '|' ORDER BY query) AS via,
        nullif(max(coalesce(dense_score, 0)), 0)::DOUBLE AS dense_score, nullif(max(coalesce(sparse_score, 0)), 0)::DOUBLE AS sparse_score, arg_min(position, arrival) AS first_rank FROM u GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, doc_id)::INT AS position FROM f"""


def neighbour_expansion(spark, sf_dir):
    """Lines of a document are its chunks; every one is expanded by one line each way, as what a search has found is."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    return R.expand_neighbours(lines.select("document_id", "ordinal"), lines)


def neighbour_expansion_whole(spark, sf_dir):
    """Every line of every document, expanded by one line each way."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    return R.expand_every(lines)


NEIGHBOUR_WHOLE_SQL = """
WITH l AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS parts FROM documents),
k AS (SELECT document_id, parts, unnest(range(0, len(parts)))::INT AS ordinal FROM l)
SELECT document_id, ordinal, array_to_string(parts[greatest(ordinal, 1):ordinal + 2], chr(10) || chr(10)) AS expanded FROM k
"""


def _positions(spark, sf_dir):
    p = passages(spark, sf_dir)
    return R.hybrid(p, questions(spark, sf_dir)).select("question_id", "doc_id", "position", "rrf").join(p.select("doc_id", "text", "embedding"), "doc_id")


def budget_fit(spark, sf_dir):
    return R.fit_budget(_positions(spark, sf_dir), budget=12_000).select("question_id", "doc_id", "position", "tokens", "running")


BUDGET_SQL = f"""{ALL_SQL},
t AS (SELECT f.question_id, f.doc_id, f.position, ceil(length(p.text) / 4.0)::INT AS tokens FROM fused f JOIN p USING (doc_id)),
r AS (SELECT *, (sum(tokens) OVER w)::BIGINT AS running FROM t WINDOW w AS (PARTITION BY question_id ORDER BY position)),
b AS (SELECT *, max(CASE WHEN running > 12000 AND position > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY position) AS broken FROM r)
SELECT question_id, doc_id, position, tokens, running FROM b WHERE broken = 0"""


def attention_order(spark, sf_dir):
    rows = R.hybrid(passages(spark, sf_dir), questions(spark, sf_dir), limit=10)
    n = F.max("position").over(R.W.partitionBy("question_id"))
    return rows.select("question_id", "doc_id", "position", R.attention_order(F.col("position"), n).alias("place"))


ATTENTION_SQL = f"""{ALL_SQL}, n AS (SELECT question_id, doc_id, position, max(position) OVER (PARTITION BY question_id) AS n FROM fused WHERE position <= 10)
SELECT question_id, doc_id, position, (CASE WHEN n <= 2 THEN position WHEN position % 2 = 1 THEN (position + 1) // 2 ELSE n + 1 - position // 2 END)::INT AS place FROM n"""


def mmr_diversify(spark, sf_dir):
    return R.diversify(_positions(spark, sf_dir).withColumnRenamed("rrf", "score"))


def rerank(spark, sf_dir):
    q = questions(spark, sf_dir).select("question_id", "question")
    rows = _positions(spark, sf_dir).join(q, "question_id")
    return R.rerank(rows, R.overlap_score(F.col("question"), F.col("text"))).select("question_id", "doc_id", "rerank_score", "rerank_rank")


RERANK_SQL = rf"""{ALL_SQL},
w AS (SELECT f.question_id, f.doc_id, f.position, list_distinct(regexp_extract_all(lower(question), '\p{{L}}+|\p{{N}}+')) AS ql, regexp_extract_all(lower(p.text), '\p{{L}}+|\p{{N}}+') AS tl
      FROM fused f JOIN p USING (doc_id) JOIN q USING (question_id)),
s AS (SELECT question_id, doc_id, position, round(len(list_intersect(ql, tl)) / greatest(len(ql), 1), 6) AS rerank_score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, position)::INT AS rerank_rank FROM s)
SELECT question_id, doc_id, rerank_score, rerank_rank FROM r WHERE rerank_rank <= 10 AND (rerank_score >= 0.015 OR rerank_rank = 1)"""


def rerank_listwise(spark, sf_dir):
    """A scorer that answers for even positions only, and not at all for questions divisible by 3."""
    rows = R.hybrid(passages(spark, sf_dir), questions(spark, sf_dir)).select("question_id", "doc_id", "position", "rrf")
    scores = rows.where("position % 2 = 0 and question_id % 3 <> 0").select("question_id", "position", F.round((F.col("doc_id") % 100) / 100, 2).alias("given"))
    return R.rerank_listwise(rows, scores).select("question_id", "doc_id", "position", "rerank_score", "rerank_rank")


LISTWISE_SQL = f"""{ALL_SQL},
g AS (SELECT question_id, doc_id, position, CASE WHEN position % 2 = 0 AND question_id % 3 <> 0 THEN round((doc_id % 100) / 100.0, 2)::DOUBLE ELSE 0.0 END AS given FROM fused),
a AS (SELECT *, max(given) OVER (PARTITION BY question_id) >= 0.015 AS ok FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY (CASE WHEN ok THEN given END) DESC NULLS LAST, position)::INT AS rerank_rank FROM a)
SELECT question_id, doc_id, position, CASE WHEN ok THEN given END AS rerank_score, rerank_rank FROM r WHERE rerank_rank <= 10 AND (NOT ok OR given >= 0.015)"""


def rerank_text(spark, sf_dir):
    text = R.rerank_text(F.col("source"), F.array("lang"), F.lit("In short."), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("document"))


RERANK_TEXT_SQL = """
WITH h AS (SELECT doc_id, text, source || ' > ' || lang || chr(10) || 'In short.' AS head FROM documents)
SELECT doc_id, head || chr(10) || substring(text, 1, greatest(200, 1400 - length(head))::INT) AS document FROM h
"""


def bm25(spark, sf_dir):
    return R.bm25(passages(spark, sf_dir), questions(spark, sf_dir))


def cache_probe(spark, sf_dir):
    """Even vectors are cached questions; each vector asks, in the scope of its label."""
    v = table(spark, sf_dir, "embeddings")
    owner = lambda i: F.when(F.col(i) % 3 != 0, F.concat(F.lit("o"), (F.col(i) % 3).cast("string")))
    asked = v.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), owner("vec_id").alias("owner_id"), F.lit("pipeline").alias("mode"), F.col("label").cast("string").alias("scope_key"))
    held = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("cached_id"), F.col("embedding").alias("cached_vector"), owner("vec_id").alias("cached_owner"), F.lit("pipeline").alias("cached_mode"), F.col("label").cast("string").alias("cached_scope"))
    return R.probe_cache(asked, held, floor=0.5)


CACHE_SQL = """
WITH s AS (SELECT a.vec_id AS question_id, b.vec_id AS cached_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
           FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 2 = 0 AND a.vec_id % 3 = b.vec_id % 3),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, cached_id) AS rn FROM s)
SELECT question_id, cached_id, similarity FROM r WHERE rn = 1 AND similarity >= 0.5
"""


def scope_key(spark, sf_dir):
    ids = F.collect_list(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(R.scope_key(ids).alias("scope_key"))


def cache_store_gate(spark, sf_dir):
    """Which answers may be stored: non-blank, with a citation, and the only turn of their conversation."""
    c = table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.max_by("text", "turn").alias("answer"))
    cites = F.size(F.regexp_extract_all(F.col("answer"), F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))
    answers = per.select("conv_id", "answer", cites.alias("citations"), F.col("asked").alias("turns"), F.array("conv_id").alias("scope_ids"))
    return search.may_store(answers).select("conv_id", "citations")


CACHE_GATE_SQL = r"""
WITH p AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS asked, arg_max(text, turn) AS answer FROM conversations GROUP BY 1)
SELECT conv_id, len(regexp_extract_all(answer, '\p{Lu}\p{L}+'))::INT AS citations FROM p WHERE asked = 1 AND trim(answer) <> '' AND len(regexp_extract_all(answer, '\p{Lu}\p{L}+')) >= 1
"""


def arm_contribution(spark, sf_dir):
    rows = R.hybrid(passages(spark, sf_dir), questions(spark, sf_dir))
    share = search.dense_share(F.col("dense_rank"), F.col("sparse_rank"))
    return rows.select("question_id", "doc_id", share.alias("dense_share")).where("dense_share is not null")


ARM_SQL = f"""{ALL_SQL}, c AS (SELECT question_id, doc_id, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS d, coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS s FROM fused)
SELECT question_id, doc_id, round(d / (d + s), 6) AS dense_share FROM c WHERE d + s > 0"""

BM25_SQL = rf"""WITH {P_SQL},
ql AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(question), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM q),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+') AS words FROM p),
st AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM w),
tf AS (SELECT doc_id, lexeme, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(words) AS length, unnest(words) AS lexeme FROM w) GROUP BY doc_id, lexeme),
df AS (SELECT lexeme, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT question_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS bm25 FROM tf JOIN df USING (lexeme) JOIN ql USING (lexeme), st GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 40"""

QUERIES = {f.__name__: f for f in (hybrid_search, dense_arm, lexical_arm, identifier_arm, scoped_search, cross_query_rrf, neighbour_expansion, neighbour_expansion_whole, budget_fit, attention_order, mmr_diversify, rerank, rerank_listwise, rerank_text, bm25, cache_probe, scope_key, cache_store_gate, arm_contribution)}
ORACLES = {
    "hybrid_search": f"{ALL_SQL} SELECT f.question_id, f.doc_id, source, dense_rank, dense_score, sparse_rank, sparse_score, ident_rank, ident_score, rrf, position FROM fused f JOIN p USING (doc_id)",
    "dense_arm": f"WITH {P_SQL}, {DENSE_SQL} SELECT question_id, doc_id, dense_score, dense_rank FROM dense",
    "lexical_arm": f"WITH {P_SQL}, {LEX_SQL} SELECT question_id, doc_id, sparse_score, sparse_rank FROM sparse",
    "identifier_arm": f"WITH {P_SQL}, {ID_SQL} SELECT question_id, doc_id, ident_score, ident_rank FROM ident",
    "scoped_search": "SELECT 'all' AS scope, count(*) AS n FROM documents UNION ALL SELECT 'some', count(*) FROM documents WHERE doc_id IN (1, 2, 3) UNION ALL SELECT 'none', 0",
    "cross_query_rrf": CROSS_SQL, "neighbour_expansion": NEIGHBOUR_WHOLE_SQL, "neighbour_expansion_whole": NEIGHBOUR_WHOLE_SQL, "budget_fit": BUDGET_SQL, "attention_order": ATTENTION_SQL,
    "rerank": RERANK_SQL, "rerank_listwise": LISTWISE_SQL, "rerank_text": RERANK_TEXT_SQL, "bm25": BM25_SQL, "cache_probe": CACHE_SQL,
    "scope_key": "SELECT source, substring(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)), 1, 32) AS scope_key FROM documents GROUP BY 1",
    "cache_store_gate": CACHE_GATE_SQL, "arm_contribution": ARM_SQL,
}
