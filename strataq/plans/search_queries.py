"""The stored index, whole searches, checks of answers and the rest of ingest on the fixture tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataq.functions import english, registry
from strataq.functions import text as T
from strataq.operators import indexes, ingest, reporting, scope, search
from strataq.operators import planning as P
from strataq.operators import retrieval as R
from strataq.plans import ingest_queries as I
from strataq.plans import retrieval_queries as Q
from strataq.sources import loaders
from strataq.tables import shared_folder, table, written

#: Ten documents in a row are passages of one; one line each is what neighbours add.
PARENT = {"document_id": "doc_id DIV 10", "ordinal": "CAST(doc_id % 10 AS INT)"}


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def inverted_index(spark, sf_dir):
    """The index of all documents' content words, unstemmed."""
    return indexes.inverted_index(indexes.with_lexemes(table(spark, sf_dir, "documents"), english.content_words))


INDEX_SQL = rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM documents)
SELECT lexeme, doc_id, count(*)::INT AS n FROM w WHERE lexeme NOT IN {Q.STOP_SQL} GROUP BY ALL"""


def indexed_arm(spark, sf_dir):
    """The lexical arm's rows without reading a text: from stored postings, those of blocks that matter."""
    path = _fresh(spark, "postings")
    indexes.write_postings(indexes.postings(indexes.with_lexemes(Q.passages(spark, sf_dir), english.content_words)), path)
    return indexes.indexed_arm(spark.read.parquet(path), Q.questions(spark, sf_dir), english.content_words)


def _vectors(spark, sf_dir):
    path, p = _fresh(spark, "vectors"), Q.passages(spark, sf_dir).select("doc_id", "embedding")
    indexes.write_vectors(p, path)
    return p, path


def vector_index_arm(spark, sf_dir):
    """The dense arm's rows from the vector index, all cells of which are looked into."""
    return indexes.near_arm(spark, _vectors(spark, sf_dir)[1], Q.questions(spark, sf_dir), probes=indexes.MOST_CELLS)


def vector_index_recall(spark, sf_dir):
    """How many of the exact arm's rows all questions find by as many probes as some of them need for 95 %."""
    (p, path), q = _vectors(spark, sf_dir), Q.questions(spark, sf_dir)
    probes = indexes.enough_probes(p, path, q)
    return indexes.recall(indexes.near_arm(spark, path, q, probes=probes), R.dense_arm(p, q)).withColumn("probes", F.lit(probes)).withColumn("cells", F.lit(len(indexes._centroids(spark, path))))


def _named(spark, sf_dir):
    """Questions whose identifiers are three strings of their texts and one of two characters."""
    ids = [F.regexp_replace(F.substring("question", at, n), "[_%\\\\]", "") for at, n in ((1, 14), (30, 9), (60, 22))]
    return Q.questions(spark, sf_dir).withColumn("identifiers", F.array(*ids, F.concat(F.lit("q"), (F.col("question_id") % 10).cast("string"))))


def indexed_identifiers(spark, sf_dir):
    """The identifier arm from stored trigrams."""
    path, p = _fresh(spark, "trigrams"), Q.passages(spark, sf_dir)
    indexes.write_trigrams(indexes.trigram_postings(p), path)
    return indexes.indexed_identifiers(spark.read.parquet(path), p, _named(spark, sf_dir))


NAMED_SQL = rf"""WITH {Q.P_SQL},
i AS (SELECT DISTINCT question_id, identifier FROM (SELECT question_id, trim(unnest([regexp_replace(substring(question, 1, 14), '[_%\\]', '', 'g'), regexp_replace(substring(question, 30, 9), '[_%\\]', '', 'g'), regexp_replace(substring(question, 60, 22), '[_%\\]', '', 'g'), 'q' || (question_id % 10)])) AS identifier FROM q) WHERE length(identifier) BETWEEN 2 AND 64),
h AS (SELECT question_id, doc_id, count(*)::INT AS ident_score FROM i JOIN p ON contains(lower(p.text), lower(identifier)) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ident_score DESC, doc_id)::INT AS ident_rank FROM h) WHERE ident_rank <= 40"""


def stemmed_arm(spark, sf_dir):
    """The lexical arm on English stems."""
    return R.lexical_arm(Q.passages(spark, sf_dir), Q.questions(spark, sf_dir), words=english.english)


def _requests(items):
    """Owners of benchmark items and what they ask for: nothing named, an empty list, or ids of which some are others' or not there."""
    some = F.array(F.col("item_id"), F.col("item_id") * 2, F.col("item_id") + 7, F.lit(-1).cast("long"))
    return items.select("item_id", F.when(F.col("item_id") % 11 != 0, F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string"))).alias("owner_id"), F.when(F.col("item_id") % 3 == 1, some).when(F.col("item_id") % 3 == 2, F.array().cast("array<bigint>")).alias("requested"))


def permitted_scope(spark, sf_dir):
    """What each request may search: all that its owner sees where none are requested, be it by null or an empty list."""
    docs = I.ingest.chain_versions(I.docs(spark, sf_dir))
    return search.permitted(_requests(table(spark, sf_dir, "benchmark")).withColumnRenamed("item_id", "request_id"), docs)


MAY_SQL = f"""{I.D_SQL}, {I.V_SQL}, s AS (SELECT document_id, owner_id FROM v WHERE superseded_by IS NULL AND status = 'ready'),
a AS (SELECT item_id, CASE WHEN item_id % 11 <> 0 THEN 'src' || (item_id % 7) END AS owner, CASE WHEN item_id % 3 = 1 THEN [item_id, item_id * 2, item_id + 7, -1] WHEN item_id % 3 = 2 THEN []::BIGINT[] END AS requested FROM benchmark),
may AS (SELECT item_id AS request_id, document_id FROM a JOIN s ON (s.owner_id IS NULL OR coalesce(s.owner_id = a.owner, false)) AND (coalesce(len(requested), 0) = 0 OR list_contains(requested, document_id)))"""
PERMITTED_SQL = f"WITH {MAY_SQL} SELECT request_id, document_id FROM may"


def _parents(p):
    return p.select("doc_id", "text", "embedding", *(F.expr(e).alias(n) for n, e in PARENT.items()))


def search_corpus(spark, sf_dir):
    """Whole searches by owners: six passages for each question of those that it may see, with their neighbours and numbers."""
    p = _parents(Q.passages(spark, sf_dir))
    docs = I.ingest.chain_versions(I.docs(spark, sf_dir))
    q = Q.questions(spark, sf_dir).withColumn("identifiers", F.array().cast("array<string>")).join(_requests(table(spark, sf_dir, "benchmark")).withColumnRenamed("item_id", "question_id"), "question_id")
    seen = written(scope.searchable(p, docs), "searchable")  # once, for all arms and what follows
    found = search.search(seen, seen.select("document_id", "ordinal", F.col("text").alias("content")), q)
    return found.select("question_id", "found", "marker", "doc_id", "relevance", F.length("content").alias("n_content"))


# ten passages of a document that may be seen or not as one; so the arms rank within (question, document) pairs that are permitted
SCOPED_SQL = f"""{MAY_SQL},
pp AS (SELECT p.*, doc_id // 10 AS document_id FROM p WHERE doc_id // 10 IN (SELECT document_id FROM s)),
ds AS (SELECT question_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]), 6) AS dense_score FROM q JOIN may ON request_id = question_id JOIN pp USING (document_id) WHERE embedding IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense_score DESC, doc_id)::INT AS dense_rank FROM ds) WHERE dense_rank <= 40),
ql AS (SELECT DISTINCT question_id, lexeme FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '\\p{{L}}+|\\p{{N}}+')) AS lexeme FROM q) WHERE lexeme NOT IN {Q.STOP_SQL}),
pc AS (SELECT doc_id, document_id, lexeme, count(*) AS c FROM (SELECT doc_id, document_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+')) AS lexeme FROM pp) GROUP BY ALL),
ls AS (SELECT question_id, doc_id, round(sum(c) / (sum(c) + 10), 6) AS sparse_score FROM ql JOIN pc USING (lexeme) JOIN may ON request_id = question_id AND may.document_id = pc.document_id GROUP BY question_id, doc_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sparse_score DESC, doc_id)::INT AS sparse_rank FROM ls) WHERE sparse_rank <= 40)"""
SEARCH_SQL = rf"""WITH {Q.P_SQL}, {SCOPED_SQL},
j AS (SELECT coalesce(d.question_id, s.question_id) AS question_id, coalesce(d.doc_id, s.doc_id) AS doc_id,
        round(coalesce(0.5 / (60 + dense_rank), 0) + coalesce(0.5 / (60 + sparse_rank), 0), 9)::DOUBLE AS rrf
      FROM dense d FULL JOIN sparse s ON s.question_id = d.question_id AND s.doc_id = d.doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, doc_id)::INT AS position FROM j) WHERE position <= 40),
w AS (SELECT f.question_id, f.doc_id, f.position, list_distinct(regexp_extract_all(lower(question), '\p{{L}}+|\p{{N}}+')) AS ql, regexp_extract_all(lower(p.text), '\p{{L}}+|\p{{N}}+') AS tl
      FROM fused f JOIN pp p USING (doc_id) JOIN q USING (question_id)),
sc AS (SELECT question_id, doc_id, position, round(len(list_intersect(ql, tl)) / greatest(len(ql), 1), 6) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position)::INT AS marker FROM sc),
b AS (SELECT * FROM r WHERE marker <= 6 AND (score >= 0.015 OR marker = 1)),
e AS (SELECT b.question_id, b.doc_id, least(4000, length(string_agg(p.text, chr(10) || chr(10) ORDER BY p.doc_id))) AS n_content
      FROM b JOIN pp p ON p.doc_id // 10 = b.doc_id // 10 AND p.doc_id BETWEEN b.doc_id - 1 AND b.doc_id + 1 GROUP BY ALL)
SELECT q.question_id, count(b.doc_id) OVER (PARTITION BY q.question_id) AS found, marker, b.doc_id, round(score, 3) AS relevance, n_content::INT AS n_content
FROM q LEFT JOIN b USING (question_id) LEFT JOIN e ON e.question_id = q.question_id AND e.doc_id = b.doc_id"""


def citations(spark, sf_dir):
    """Each question's fused passages and an answer that cites the first, a middle one and one that isn't there."""
    found = R.hybrid(Q.passages(spark, sf_dir), Q.questions(spark, sf_dir), limit=12).select("question_id", F.col("position").alias("marker"), "doc_id", F.col("rrf").alias("score"))
    answers = Q.questions(spark, sf_dir).select("question_id", F.concat(F.lit("So [1] and 【"), (F.col("question_id") % 15 + 1).cast("string"), F.lit("†L1】, but not [77].")).alias("answer"))
    return search.citations(answers, found)


def insert_documents(spark, sf_dir):
    """Odd documents are stored, even ones arrive."""
    docs = I.docs(spark, sf_dir)
    stored = ingest.chain_versions(docs.where("document_id % 2 = 1"))
    arriving = docs.where("document_id % 2 = 0").select("document_id", "owner_id", "source_uri", "title", "is_url")
    return ingest.new_rows(arriving, stored).select("document_id", "status", "version", "supersedes")


INSERT_SQL = f"""WITH {I.D_SQL.replace('FROM documents)', 'FROM documents WHERE doc_id % 2 = 1)')}, {I.V_SQL},
n AS (SELECT * FROM ({I.D_SQL[len('d AS ('):-1]}) WHERE document_id % 2 = 0),
p AS (SELECT n.document_id, v.version, v.document_id AS previous, row_number() OVER (PARTITION BY n.document_id ORDER BY v.version DESC NULLS LAST, v.document_id DESC) AS k
      FROM n LEFT JOIN v ON v.superseded_by IS NULL AND v.status = 'ready' AND v.source_uri = n.source_uri AND coalesce(v.owner_id, '') = coalesce(n.owner_id, '') AND v.is_url = n.is_url AND (n.is_url OR v.title = n.title))
SELECT document_id, 'parsing' AS status, coalesce(version, 0) + 1 AS version, previous AS supersedes FROM p WHERE k = 1"""


def hop_pool(spark, sf_dir):
    """Two hops: where the best passage scores below 0.6, the question's last 40 characters are searched for as well."""
    p, q = Q.passages(spark, sf_dir), Q.questions(spark, sf_dir).select("question_id", "question")
    find = lambda asked, hop: R.lexical_arm(p, asked, 10).select("question_id", "doc_id", F.col("sparse_score").alias("score"))
    grade = lambda rows: rows.groupBy("question_id").agg((F.max("score") >= 0.6).alias("sufficient")).join(q, "question_id").select("question_id", "sufficient", F.right("question", F.lit(40)).alias("refined"))
    return search.in_hops(q, find, grade)


HOP_SQL = rf"""WITH {Q.P_SQL},
pl AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM p), pc AS (SELECT doc_id, lexeme, count(*) AS c FROM pl GROUP BY ALL),
a0 AS (SELECT DISTINCT question_id, lexeme FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM q) WHERE lexeme NOT IN {Q.STOP_SQL}),
s0 AS (SELECT question_id, doc_id, round(sum(c) / (sum(c) + 10), 6) AS score FROM a0 JOIN pc USING (lexeme) GROUP BY ALL),
h0 AS (SELECT question_id, doc_id, score, 0 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rn FROM s0) WHERE rn <= 10),
a1 AS (SELECT DISTINCT question_id, lexeme FROM (SELECT question_id, unnest(regexp_extract_all(lower(right(question, 40)), '\p{{L}}+|\p{{N}}+')) AS lexeme FROM q JOIN (SELECT question_id FROM h0 GROUP BY 1 HAVING max(score) < 0.6) USING (question_id)) WHERE lexeme NOT IN {Q.STOP_SQL}),
s1 AS (SELECT question_id, doc_id, round(sum(c) / (sum(c) + 10), 6) AS score FROM a1 JOIN pc USING (lexeme) GROUP BY ALL),
h1 AS (SELECT question_id, doc_id, score, 1 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rn FROM s1) WHERE rn <= 10)
SELECT question_id, doc_id, score, hop FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, hop) AS k FROM (FROM h0 UNION ALL FROM h1)) WHERE k = 1"""


def rerank_fallback(spark, sf_dir):
    rows = R.hybrid(Q.passages(spark, sf_dir), Q.questions(spark, sf_dir))
    return search.keep_fused_order(rows).select("question_id", "doc_id", "rerank_score", "rerank_rank")


def rerank_scorer(spark, sf_dir):
    """Any model as a scorer: logits from an iterator over batches, sigmoids as scores."""
    rows = Q._positions(spark, sf_dir).join(Q.questions(spark, sf_dir).select("question_id", "question"), "question_id")
    score = search.scored_by(search.overlap_logits)
    return R.rerank(rows, score(F.col("question"), F.col("text"))).select("question_id", "doc_id", "rerank_score", "rerank_rank")


SCORER_SQL = rf"""{Q.ALL_SQL},
w AS (SELECT f.question_id, f.doc_id, f.position, list_distinct(regexp_extract_all(lower(question), '\p{{L}}+|\p{{N}}+')) AS ql, regexp_extract_all(lower(p.text), '\p{{L}}+|\p{{N}}+') AS tl
      FROM fused f JOIN p USING (doc_id) JOIN q USING (question_id)),
s AS (SELECT question_id, doc_id, position, round(1 / (1 + exp(5 - 10.0::DOUBLE * len(list_intersect(ql, tl)) / greatest(len(ql), 1))), 6) AS rerank_score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, position)::INT AS rerank_rank FROM s)
SELECT question_id, doc_id, rerank_score, rerank_rank FROM r WHERE rerank_rank <= 10 AND (rerank_score >= 0.015 OR rerank_rank = 1)"""


def answer_checks(spark, sf_dir):
    """Documents' texts as answers: to refuse, or to hold two words of the document three before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 4 == 0, " It does not say.").otherwise("")).alias("answer"), (F.col("doc_id") % 2 == 0).alias("absent"), F.array(F.initcap("lang"), F.concat(F.lit("S"), F.substring("text", 40, 2))).alias("wanted"))
    return rows.select("doc_id", search.refused(F.col("answer")).alias("refused"), search.as_expected(F.col("answer"), F.col("absent"), F.col("wanted")).alias("as_expected"))


CHECKS_SQL = r"""WITH a AS (SELECT doc_id, lower(text || CASE WHEN doc_id % 4 = 0 THEN ' It does not say.' ELSE '' END) AS answer, lang, lower('S' || substring(text, 40, 2)) AS w FROM documents),
r AS (SELECT *, regexp_matches(answer, 'not (say|cover|contain|include)|does not|no information|isn''t in|is not in') AS refused FROM a)
SELECT doc_id, refused, CASE WHEN doc_id % 2 = 0 THEN refused ELSE contains(answer, lower(lang)) AND contains(answer, w) END AS as_expected FROM r"""


def _variants(spark, sf_dir):
    p, asked = Q.passages(spark, sf_dir), Q.questions(spark, sf_dir)
    found = R.dense_arm(p, asked, 10).select(F.lit("vector").alias("variant"), "question_id", "doc_id", F.col("dense_rank").alias("position"))
    found = found.unionByName(R.lexical_arm(p, asked, 10).select(F.lit("lexical").alias("variant"), "question_id", "doc_id", F.col("sparse_rank").alias("position")))
    rows = found.join(p.select("doc_id", "source"), "doc_id")
    return rows.withColumn("is_relevant", reporting.relevant(F.col("source"), F.array(F.lit("x")), F.array(F.concat(F.lit("SRC"), (F.col("question_id") % 20).cast("string")))))


def metric_regressions(spark, sf_dir):
    return reporting.regressions(_variants(spark, sf_dir), "vector")


def eval_record(spark, sf_dir):
    """An evaluation's record, written as JSON and read again."""
    path = _fresh(spark, "record")
    reporting.write_record(reporting.ir_metrics(_variants(spark, sf_dir)), path, 3, {"embed": "given"})
    rows = spark.read.schema("variant string, k int, models map<string,string>, scores struct<hit_at_1:double,hit_rate:double,mrr:double,ndcg:double,n_questions:long>").json(path)
    return rows.select("variant", "k", F.col("models")["embed"].alias("embed"), "scores.*")


def failed_documents(spark, sf_dir):
    """A parser that takes no text of more than 3,000 characters and none without the letter b."""
    return ingest.captured(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id"), "document_id", "text", _strict)


def _strict(text):
    if len(text) > 3000:
        raise ValueError(f"{len(text)} characters are too many")
    if "b" not in text:
        raise ValueError("nothing to read")


def halved_contexts(spark, sf_dir):
    """Lines of documents in one group each; a reply to more than four excerpts has no usable line, one in seven lacks the first."""
    lines = I.chunks(spark, sf_dir).select(F.col("document_id").cast("string").alias("group"), F.col("ordinal").alias("position"), F.concat(F.lit("in "), F.element_at("heading_path", 1)).alias("fallback"))
    reply = F.array_join(F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda i: F.concat(i.cast("string"), F.lit("| "), F.when((i == 1) & (F.col("size") == 3), "").otherwise(F.concat(F.lit("line "), i.cast("string"))))), "\n")
    ask = lambda groups: groups.select("group", F.when(F.col("size") > 4, "sorry").otherwise(reply).alias("reply"))
    return ingest.contexts_in_halves(lines, ask).select(F.regexp_extract("group", r"^\d+", 0).cast("long").alias("document_id"), "position", "context")


def embed_with_retries(spark, sf_dir):
    """A model that fails on every batch with a long text: the others of the batch still get their vectors."""
    rows = ingest.embed(table(spark, sf_dir, "documents"), "doc_id", _model, 16)
    return rows.select("doc_id", F.size("vector").alias("width"), F.get("vector", 0).alias("n_chars"))


def _model(texts):
    if any(len(t) > 3000 for t in texts):
        raise RuntimeError("too long")
    return [[float(len(t)), 1.0] for t in texts]


def chunk_sink(spark, sf_dir):
    """Chunks appended in two runs, read again."""
    path = _fresh(spark, "chunks")
    c = I.chunks(spark, sf_dir).select("document_id", "ordinal", "content", F.when(F.col("ordinal") % 2 == 0, "").otherwise("about").alias("context"))
    for k in (0, 1):
        ingest.append_chunks(c.where(F.col("document_id") % 2 == k), path)
    return spark.read.parquet(path).select("id", F.length("content").alias("n_content"), "context")


def url_load(spark, sf_dir):
    """Pages as if they had been fetched as HTML, Markdown, text or something else."""
    kind = F.expr("CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/pdf' END")
    body = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("# Page "), F.col("page_id").cast("string"), F.lit("\n\nText."))).when(F.col("page_id") % 5 == 4, "plain").otherwise(F.col("html"))
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://h/p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".md?x=1").otherwise(".txt")).alias("url"), kind.alias("content_type"), F.encode(body, "utf-8").alias("content"))
    return loaders.by_content_type(rows).select("url", "format", F.when(F.col("format") != "html", F.col("title")).alias("title"), F.length("text").alias("n_text"))


URL_SQL = """WITH p AS (SELECT page_id, html, 'https://h/p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.md?x=1' ELSE '.txt' END AS url FROM pages), h AS (%s)
SELECT url, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'text' WHEN 3 THEN 'pdf' ELSE CASE WHEN page_id % 2 = 0 THEN 'markdown' ELSE 'text' END END AS format,
CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Page ' || page_id WHEN 3 THEN url ELSE 'p' || page_id END AS title,
(CASE page_id % 5 WHEN 0 THEN length(h.text) WHEN 1 THEN length('# Page ' || page_id || chr(10) || chr(10) || 'Text.') WHEN 2 THEN length(html) WHEN 4 THEN 5 END)::INT AS n_text FROM p JOIN h USING (page_id)"""


def newest_documents(spark, sf_dir):
    return reporting.newest(I.docs(spark, sf_dir).where("status = 'ready'"), 200).select("document_id", F.col("created_at").cast("string").alias("created_at"))


def largest_documents(spark, sf_dir):
    return reporting.largest_ready(I.docs(spark, sf_dir).withColumn("chunk_count", F.size(F.split("text", "\n")))).select("document_id", "chunk_count")


def pending_documents(spark, sf_dir):
    return reporting.pending(ingest.chain_versions(I.docs(spark, sf_dir)))


def conversation_chars(spark, sf_dir):
    parts = F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("file").alias("type"), F.lit("ignored").alias("text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(parts.alias("parts"))).alias("messages"))
    return rows.select("conv_id", reporting.text_chars(F.col("messages")).alias("n_chars"))


def finite_scores(spark, sf_dir):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'x' WHEN 3 THEN '-Infinity' ELSE CAST(round(value, 3) AS STRING) END")
    return table(spark, sf_dir, "events").select("event_id", reporting.finite(raw).alias("score"))


def sql_functions(spark, sf_dir):
    """The registered functions, called from SQL."""
    registry.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("strataq_docs")
    return spark.sql(r"""SELECT doc_id, strataq_tokens(text) AS tokens, size(strataq_lexemes(text)) AS n_lexemes, round(strataq_rrf(CAST(doc_id % 40 AS INT), 0.5D), 6) AS rrf, marker
        FROM strataq_docs, LATERAL cited_claims(concat('It is so [', CAST(doc_id % 9 AS STRING), ']. No more.'))""")


def lineage_of_owner(spark, sf_dir):
    """The lineage of each newest document where links to another owner's documents were made by mistake."""
    v = ingest.chain_versions(I.docs(spark, sf_dir))
    links = v.select("document_id", "supersedes").unionByName(v.where("document_id % 50 = 7").select("document_id", (F.col("document_id") + 1).alias("supersedes")))
    return ingest.lineage(links, v.where("superseded_by is null and supersedes is not null").select("document_id"), v.select("document_id", "owner_id"))


LINEAGE_SQL = f"""WITH RECURSIVE {I.D_SQL}, {I.V_SQL},
k AS (SELECT document_id, supersedes FROM v WHERE supersedes IS NOT NULL UNION ALL SELECT document_id, document_id + 1 FROM v WHERE document_id % 50 = 7),
o AS (SELECT k.* FROM k JOIN d a ON a.document_id = k.document_id JOIN d b ON b.document_id = k.supersedes WHERE coalesce(a.owner_id, '') = coalesce(b.owner_id, '')),
e AS (SELECT document_id AS x, supersedes AS y FROM o UNION SELECT supersedes, document_id FROM o),
l AS (SELECT document_id AS root, document_id FROM v WHERE superseded_by IS NULL AND supersedes IS NOT NULL UNION SELECT l.root, e.y FROM l JOIN e ON e.x = l.document_id) SELECT root, document_id FROM l"""

QUERIES = {f.__name__: f for f in (inverted_index, indexed_arm, vector_index_arm, vector_index_recall, indexed_identifiers, stemmed_arm, permitted_scope, search_corpus, citations, insert_documents, hop_pool, rerank_fallback, rerank_scorer, answer_checks, metric_regressions, eval_record, failed_documents, halved_contexts, embed_with_retries, chunk_sink, url_load, newest_documents, largest_documents, pending_documents, conversation_chars, finite_scores, sql_functions, lineage_of_owner)}
ORACLES = {
    "inverted_index": INDEX_SQL, "indexed_arm": Q.ORACLES["lexical_arm"], "vector_index_arm": Q.ORACLES["dense_arm"], "indexed_identifiers": NAMED_SQL, "permitted_scope": PERMITTED_SQL, "search_corpus": SEARCH_SQL, "insert_documents": INSERT_SQL,
    "citations": f"""{Q.ALL_SQL}, c AS (SELECT DISTINCT question_id, unnest([1, question_id % 15 + 1]) AS marker FROM q),
      r AS (SELECT c.question_id, c.marker::INT AS marker, doc_id, rrf AS score FROM c JOIN fused f ON f.question_id = c.question_id AND f.position = c.marker WHERE position <= 12)
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY marker)::INT AS place FROM r""",
    "hop_pool": HOP_SQL,
    "rerank_fallback": f"{Q.ALL_SQL} SELECT question_id, doc_id, rrf AS rerank_score, position AS rerank_rank FROM fused WHERE position <= 10",
    "rerank_scorer": SCORER_SQL, "answer_checks": CHECKS_SQL,
    "failed_documents": "SELECT doc_id AS document_id, CASE WHEN length(text) > 3000 OR NOT contains(text, 'b') THEN 'failed' ELSE 'ready' END AS status, CASE WHEN length(text) > 3000 THEN length(text) || ' characters are too many' WHEN NOT contains(text, 'b') THEN 'nothing to read' END AS error FROM documents",
    "embed_with_retries": "SELECT doc_id, CASE WHEN length(text) <= 3000 THEN 2 END AS width, CASE WHEN length(text) <= 3000 THEN length(text)::DOUBLE END AS n_chars FROM documents",
    "chunk_sink": f"WITH {I.D_SQL}, {I.C_SQL} SELECT document_id || ':' || ordinal AS id, length(content)::INT AS n_content, CASE WHEN ordinal % 2 = 1 THEN 'about' END AS context FROM c",
    "url_load": URL_SQL.replace("(%s)", "(" + I.ORACLES["html_load"] + ")"),
    "newest_documents": f"WITH {I.D_SQL} SELECT document_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM d WHERE status = 'ready' ORDER BY d.created_at DESC, document_id DESC LIMIT 200",
    "largest_documents": f"WITH {I.D_SQL} SELECT document_id, len(string_split(text, chr(10)))::INT AS chunk_count FROM d WHERE status = 'ready' ORDER BY 2 DESC, title, document_id LIMIT 3",
    "pending_documents": f"WITH {I.D_SQL}, {I.V_SQL} SELECT count(*) FILTER (WHERE status NOT IN ('ready', 'failed')) AS pending FROM v WHERE superseded_by IS NULL",
    "conversation_chars": "SELECT conv_id, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1",
    "finite_scores": "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN round(value, 3) END AS score FROM events",
    "sql_functions": r"SELECT doc_id, ceil(length(text) / 4)::INT AS tokens, len(regexp_extract_all(lower(text), '\p{L}+|\p{N}+'))::INT AS n_lexemes, round(0.5::DOUBLE / (60 + doc_id % 40), 6) AS rrf, (doc_id % 9)::INT AS marker FROM documents",
    "lineage_of_owner": LINEAGE_SQL,
    "metric_regressions": I.ORACLES["ir_metrics"].replace(" SELECT * FROM m", """, n AS (SELECT variant, question_id, CASE found WHEN 0 THEN 0 WHEN 1 THEN least(1, dcg) WHEN 2 THEN least(1, dcg / (1 + ln(2) / ln(3))) ELSE least(1, dcg / (1 + ln(2) / ln(3) + 0.5)) END AS ndcg FROM g)
SELECT l.variant, l.question_id, round(l.ndcg, 6)::DOUBLE AS ndcg, round(v.ndcg, 6)::DOUBLE AS base FROM n l JOIN n v ON v.question_id = l.question_id AND v.variant = 'vector' WHERE v.ndcg - l.ndcg > 0.01"""),
    "eval_record": I.ORACLES["ir_metrics"].replace("SELECT * FROM m", "SELECT variant, 3 AS k, 'given' AS embed, hit_at_1, hit_rate, mrr, ndcg, n_questions FROM m"),
}
