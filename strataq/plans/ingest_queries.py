"""Loading, ingest, changes, reports and streams on the fixture tables, with their SQL.

Document rows are made from ``documents`` by expressions that both Spark and the SQL use; a document's lines are its chunks.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataq.functions import text as T
from strataq.operators import chunking, dml, ingest, reporting
from strataq.operators import retrieval as R
from strataq.sources import loaders
from strataq.streaming import operators as streams
from strataq.tables import shared_folder, table, written

# Both engines evaluate these the same way.
DOC = {
    "document_id": "doc_id", "owner_id": "CASE WHEN source = 'src0' THEN NULL ELSE source END", "source_uri": "concat('u/', source, '/', CAST(doc_id % 40 AS string))",
    "title": "lang", "is_url": "doc_id % 80 >= 40", "status": "CASE doc_id % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'indexing' ELSE 'ready' END",
    "created_at": "timestamp '2024-01-01 00:00:00' + CAST(doc_id % 5000 AS int) * interval '37' minute", "text": "text", "lang": "lang", "n_chars": "n_chars",
}
D_SQL = "d AS (SELECT " + ", ".join(f"{e.replace('AS string', 'AS varchar')} AS {n}" for n, e in DOC.items()) + " FROM documents)"
C_SQL = "c AS (SELECT document_id, (unnest(range(len(ls))))::INT AS ordinal, unnest(ls) AS content, lang FROM (SELECT document_id, lang, string_split(text, chr(10)) AS ls FROM d))"
N_SQL = "n AS (SELECT document_id, count(*) AS lines FROM c GROUP BY 1)"
_SOURCE = "PARTITION BY coalesce(owner_id, ''), source_uri, CASE WHEN is_url THEN '' ELSE title END ORDER BY document_id ROWS BETWEEN"
_READY = "CASE WHEN status = 'ready' THEN document_id END"
V_SQL = f"""v AS (SELECT *, (count({_READY}) OVER b + 1)::INT AS version, max({_READY}) OVER b AS supersedes, CASE WHEN status = 'ready' THEN min({_READY}) OVER a END AS superseded_by
 FROM d WINDOW b AS ({_SOURCE} UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({_SOURCE} 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(*(F.expr(e).alias(n) for n, e in DOC.items()))


def chunks(spark, sf_dir):
    lines = docs(spark, sf_dir).select("document_id", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    return lines.select("document_id", "ordinal", "content", F.array("lang").alias("heading_path"), T.tokens(F.col("content")).alias("token_count"), "lang")


def html_load(spark, sf_dir):
    """Pages as Markdown."""
    page = loaders.html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", page["title"].alias("title"), page["text"].alias("text"))


def markdown_load(spark, sf_dir):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: \"T "), "source", F.lit("\"\ntags: x\n---\n"))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Head "), "lang", F.lit("\n"))).otherwise(""), "text")
    md = loaders.markdown(raw, F.concat("source", F.lit("_a-b.md")))
    return table(spark, sf_dir, "documents").select("doc_id", md["title"].alias("title"), F.length(md["text"]).alias("n_text"), F.coalesce(md["metadata"]["tags"], F.lit("")).alias("tags"))


def pdf_load(spark, sf_dir):
    """A document's lines as the pages of a PDF; where a character two thirds in is."""
    p = loaders.pages(F.split("text", "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    at = F.floor(F.length("p.text") * 2 / 3).cast("int")
    return rows.select("doc_id", F.length("p.text").alias("n_text"), F.size("p.page_breaks").alias("n_pages"), F.element_at("p.page_breaks", -1).alias("last_break"), loaders.page_of(F.col("p.page_breaks"), at).alias("page"))


def pdf_text(spark, sf_dir):
    raw = F.concat("text", F.lit("\nsoft-\nened text  here\nand more\n\n\n\nEnd "))
    return table(spark, sf_dir, "documents").select("doc_id", T.pdf_text(raw).alias("text"))


def titles(spark, sf_dir):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN '3f2a9c0d-11bb-4cde-8a77-0123456789ab.pdf' WHEN 1 THEN concat(source, '_guide.pdf') WHEN 2 THEN '.pdf' ELSE concat(lang, '-notes.v2.pdf') END")
    return table(spark, sf_dir, "documents").select("doc_id", T.title_of(name, F.col("source")).alias("file_title"), T.pdf_title(F.when(F.col("doc_id") % 5 == 0, "Meta title"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("1 2\n#"), name).alias("pdf_title"), T.normalise_title(F.col("text")).alias("short_title"), loaders.format_of(name, F.lit("text/html")).alias("format"))


def private_addresses(spark, sf_dir):
    a = F.col("event_id")
    part = lambda n: (F.floor(a / n) % 256).cast("string")
    ip = F.concat_ws(".", part(1), part(3), part(7), F.lit("9"))
    shown = F.when(a % 10 == 0, F.concat(F.lit("::ffff:"), ip)).when(a % 10 == 1, F.concat(F.lit("fe80::"), a.cast("string"))).when(a % 10 == 2, F.lit("2001:db8::1")).otherwise(ip)
    return table(spark, sf_dir, "events").select("event_id", T.is_private(shown).alias("is_private"))


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence")).select("doc_id", (F.col("place") + 1).alias("place"), "sentence")


def chunk_documents(spark, sf_dir):
    """Structural chunks of documents with a heading for every third line."""
    lines = F.split("text", "\n")
    text = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n\n"), x)).otherwise(x)), "\n")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), text.alias("text"), F.array(F.lit(0), F.lit(1000)).alias("page_breaks"))
    return chunking.chunk_documents(rows).withColumn("heading_path", F.array_join("heading_path", " > "))


def breadcrumbs(spark, sf_dir):
    path = F.array(F.upper("lang"), F.lit(""), "lang", "source", F.lit("**End**"))
    return table(spark, sf_dir, "documents").select("doc_id", T.breadcrumb(F.col("lang"), path).alias("crumb"), ingest.indexed_text(F.when(F.col("doc_id") % 2 == 0, "About it."), F.col("lang"), path, F.col("source")).alias("indexed_text"))


def boilerplate_sections(spark, sf_dir):
    head = F.expr("CASE doc_id % 4 WHEN 0 THEN 'References' WHEN 1 THEN 'see also' WHEN 2 THEN 'Sources of error' ELSE source END")
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(F.array(F.col("lang"), head), lambda h: F.trim(h).rlike(T.BOILERPLATE)).alias("is_boilerplate"))


def balanced_groups(spark, sf_dir):
    c = chunks(spark, sf_dir)
    n = F.count("*").over(R.W.partitionBy("document_id"))
    return c.select("document_id", "ordinal", ingest.balanced_group(F.col("ordinal"), n, 28).alias("group_no"))


def document_briefs(spark, sf_dir):
    outline = F.array("source", "lang", F.lit(""), "source")
    return table(spark, sf_dir, "documents").select("doc_id", ingest.document_brief(F.col("text"), outline, F.lit(100), F.lit(2000), 2000, 600).alias("brief"))


def context_replies(spark, sf_dir):
    reply = F.concat(F.lit("Sure:\n1| about "), "source", F.lit("\n 2 |  in "), "lang", F.lit("\n3|\n1| again "), "source")
    m = ingest.reply_lines(reply)
    return table(spark, sf_dir, "documents").select("doc_id", m[F.lit(1)].alias("first"), m[F.lit(2)].alias("second"), F.coalesce(F.try_element_at(m, F.lit(3)), F.col("lang")).alias("third"))


def duplicate_decisions(spark, sf_dir):
    """Even documents are stored, odd ones arrive."""
    d = docs(spark, sf_dir).withColumns({"checksum": F.sha2("text", 256), "chunk_count": (F.col("document_id") % 3).cast("int")})
    return ingest.decide_duplicates(d.where("document_id % 2 = 1").select("document_id", "owner_id", "checksum"), d.where("document_id % 2 = 0")).select("document_id", "decision", "stored_id")


def version_chains(spark, sf_dir):
    return ingest.chain_versions(docs(spark, sf_dir)).select("document_id", "version", "supersedes", "superseded_by")


def lineage_closure(spark, sf_dir):
    """All versions that are to go with the newest document of each source."""
    v = written(ingest.chain_versions(docs(spark, sf_dir)).select("document_id", "supersedes", "superseded_by"), "versions")
    return ingest.lineage(v.select("document_id", "supersedes"), v.where("superseded_by is null and supersedes is not null").select("document_id"))


def section_changes(spark, sf_dir):
    """A document against a later version whose sections are partly rewritten, new or gone."""
    c = chunks(spark, sf_dir).withColumn("heading_path", F.array(F.concat(F.lit("s"), (F.col("ordinal") % 5).cast("string"))))
    new = c.where("not (document_id % 2 = 0 and ordinal % 5 = 4)").withColumn("content", F.when((F.col("document_id") % 3 == 0) & (F.col("ordinal") % 5 == 1), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ingest.section_diff(c, new)


def embed_batches(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumnRenamed("ordinal", "position").withColumnRenamed("content", "text")
    return ingest.embed_batches(c, "document_id")


def model_prefixes(spark, sf_dir):
    m = F.expr("CASE doc_id % 3 WHEN 0 THEN 'x/BGE-base' WHEN 1 THEN 'e5-small' ELSE 'gte-small' END")
    return table(spark, sf_dir, "documents").select("doc_id", ingest.embed_prefix(m, True).alias("query_prefix"), ingest.embed_prefix(m, False).alias("passage_prefix"), ingest.pooling(m).alias("pooling"))


def ingest_budget(spark, sf_dir):
    return ingest.daily_budget(docs(spark, sf_dir).withColumn("chunk_count", (F.col("document_id") % 30).cast("int"))).select(F.col("day").cast("string").alias("day"), "used", "allowed")


def rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("request_id"), F.unix_timestamp("ts").alias("at"))
    return ingest.rate_windows(e, "user_id", 2, 86400).select("user_id", "request_id", "window_start", "n_in_window", "allowed")


def latest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_id", F.col("event_type").alias("stage"), F.round("value", 2).alias("progress"))
    return dml.latest(e, "document_id", "event_id")


def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dml.upsert(c, c.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("renamed")), "c_custkey")


def insert_or_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dml.insert_ignore(c.where("c_custkey % 2 = 0"), c, "c_custkey")


def copy_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return dml.copy_table(v, v.where("vec_id % 3 = 0"), "vec_id", "embedding").select("vec_id", F.size("embedding").alias("width"))


def save_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    stored = c.where("id % 2 = 0").withColumn("owner_id", F.concat(F.lit("o"), (F.col("id") % 3).cast("string")))
    return dml.save_conversations(stored, c.withColumn("owner_id", F.lit("o0"))).select("id", "action")


def delete_owned(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("owner_id", F.concat(F.lit("o"), (F.col("id") % 3).cast("string")))
    return dml.delete_owned(c, c.where("id % 2 = 0").withColumn("owner_id", F.lit("o0")))


def answer_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return dml.hit_counts(e.select(F.col("user_id").alias("id")).distinct(), e.where("event_type = 'click'").select(F.col("user_id").alias("id")))


def query_log(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.concat(F.lit("A "), "text").alias("answer"))
    return dml.query_log(rows.where("id % 2 = 0"), True).unionByName(dml.query_log(rows.where("id % 2 = 1"), False))


def merge_metadata(spark, sf_dir):
    m = dml.merge_metadata(F.create_map(F.lit("a"), "source", F.lit("b"), "lang"), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", *(F.col("m")[k].alias(k) for k in "abc"))


def supersede(spark, sf_dir):
    v = ingest.chain_versions(docs(spark, sf_dir)).select("document_id", "status", "supersedes")
    return dml.supersede(v).select("document_id", "superseded_by")


def keep_best(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 0).alias("score"))
    return dml.keep_best(e, "user_id", "score", "event_id")


def list_documents(spark, sf_dir):
    return reporting.list_documents(ingest.chain_versions(docs(spark, sf_dir)))


def searchable_documents(spark, sf_dir):
    return reporting.searchable(ingest.chain_versions(docs(spark, sf_dir)), "src3")


def corpus_stats(spark, sf_dir):
    return reporting.corpus_stats(ingest.chain_versions(docs(spark, sf_dir)), chunks(spark, sf_dir), "src3")


def conversation_list(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = c.groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select("conv_id", reporting.conversation_title(F.col("turns")).alias("title"), F.size("turns").alias("n_turns"))


def integrity_report(spark, sf_dir):
    d = ingest.chain_versions(docs(spark, sf_dir)).withColumns({"chunk_count": F.when(F.col("document_id") % 7 == 0, 0).otherwise(F.size(F.split("text", "\n"))), "updated_at": F.col("created_at")})
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    c = chunks(spark, sf_dir).join(v, "document_id", "left").withColumn("context", F.when((F.col("document_id") + F.col("ordinal")) % 29 != 0, "about"))
    conv = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n_messages"))
    return reporting.integrity(d, c, conv, F.expr("timestamp '2024-02-01 00:00:00'"), 64)


def read_sections(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("heading_path", F.array("lang", F.concat(F.lit("s"), (F.col("ordinal") % 2).cast("string"))))
    return reporting.read_section(c)


def ir_metrics(spark, sf_dir):
    """Two arms as variants; a document is relevant to a question if its source's number is the question's, mod 20."""
    from strataq.plans import retrieval_queries as q

    p, asked = q.passages(spark, sf_dir), q.questions(spark, sf_dir)
    found = R.dense_arm(p, asked, 10).select(F.lit("vector").alias("variant"), "question_id", "doc_id", F.col("dense_rank").alias("position"))
    found = found.unionByName(R.lexical_arm(p, asked, 10).select(F.lit("lexical").alias("variant"), "question_id", "doc_id", F.col("sparse_rank").alias("position")))
    rows = found.join(p.select("doc_id", "source"), "doc_id").withColumn("is_relevant", reporting.relevant(F.col("source"), F.array(F.lit("x")), F.array(F.concat(F.lit("SRC"), (F.col("question_id") % 20).cast("string")))))
    return reporting.ir_metrics(rows)


def metric_lift(spark, sf_dir):
    return reporting.lift(ir_metrics(spark, sf_dir), "vector")


def relative_times(spark, sf_dir):
    age = F.lit(1706745600) - F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("event_id", age.alias("age"), reporting.relative_time(age, F.col("ts")).alias("label"))


def required_keys(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("stage"), F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'delta' ELSE 'local' END").alias("backend"))
    keys = spark.createDataFrame([("alpha", "ALPHA_API_KEY"), ("beta", "BETA_API_KEY"), ("gamma", "GAMMA_API_KEY"), ("delta", "DELTA_API_KEY")], "backend string, key string")
    return reporting.required_keys(s, keys)


def trace_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), (F.col("event_id") % 6).alias("span_id"), F.col("event_type").alias("stage"), F.round("value", 2).alias("ms"), F.col("event_id").alias("arrival"))
    return reporting.trace_summary(e, ["view", "click", "signup", "purchase"])


#: Parts in which events arrive, one after the other.
PARTS = 6


def _streamed(spark, sf_dir, make, name, mode="append"):
    """A stream over the events, run to its end into shared storage; its rows with the micro-batch that gave them.

    The events arrive in parts by their time. Each part's files are written side by side, and the stream goes on from its checkpoint with all
    of them as one micro-batch; what a part's watermark closes comes with the next part, and after the last one by itself.
    """
    folder, run = shared_folder(spark), uuid.uuid4().hex
    events, at = _at(table(spark, sf_dir, "events")), F.col("ts")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    cuts = [F.timestamp_micros(F.lit(first + (last - first) * k // PARTS)) for k in range(1, PARTS)] if first is not None else []
    for k in range(len(cuts) + 1):
        part = reduce(lambda x, y: x & y, [*([at >= cuts[k - 1]] if k else []), *([at < cuts[k]] if k < len(cuts) else [])], F.lit(True))
        events.where(part).write.mode("append").parquet(f"{folder}/arriving-{run}")
        stream = make(streams.events_stream(spark, f"{folder}/arriving-{run}", events))
        streams.run_once(stream, streams.by_batch(f"{folder}/{name}-{run}"), f"{name}-{run}", mode, close=k == len(cuts))
    return spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).option("basePath", f"{folder}/{name}-{run}").parquet(f"{folder}/{name}-{run}/batch=*")


def _at(events):
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_first_seen(spark, sf_dir):
    """The users of each kind of event, by their first one within the watermark."""
    found = _streamed(spark, sf_dir, lambda e: streams.first_seen(e.select("ts", "user_id", "event_type"), ["user_id", "event_type"], "90 days"), "first-seen").drop("batch")
    return found.groupBy("event_type").agg(F.count("*").alias("n_users"))


def request_rates(spark, sf_dir):
    """Rates of all hours: the last that the stream told of each, those that are still open among them."""
    told = _streamed(spark, sf_dir, streams.request_rates, "rates", "update")
    return told.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("last")).select("start", "event_type", "last.*")


def event_sessions(spark, sf_dir):
    """Sessions that the watermark has closed; the others are still open."""
    return _streamed(spark, sf_dir, lambda e: streams.sessions(e, gap="6 hours"), "sessions").drop("batch")


def stream_rate_limit(spark, sf_dir):
    """The rate limit's rows from state that is kept from micro-batch to micro-batch."""
    return _streamed(spark, sf_dir, lambda e: streams.limited(e.select("user_id", F.col("event_id").alias("request_id"), "ts"), "user_id", 2, 86400), "limits").drop("batch")


def stream_ingest(spark, sf_dir):
    """A stream of events as arriving documents: each batch is checked for what is stored already and appended."""
    stored = f"{shared_folder(spark)}/ingested-{uuid.uuid4().hex}"
    like = table(spark, sf_dir, "events")
    arriving = spark.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = arriving.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("checksum"), F.col("event_id").alias("document_id"))
    streams.ingest(rows, stored, f"ingest-{uuid.uuid4().hex}")
    return spark.read.schema("checksum string, document_id long").parquet(stored)


def _html_sql() -> str:
    """The page loader's steps, nested as SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    swap = lambda x, p, by: f"regexp_replace({x}, {quote(p)}, {quote(by.replace('$', chr(92)))}, 'g')"

    def entities(x: str) -> str:
        for name, char in loaders.ENTITIES:
            x = f"replace({x}, {quote(name)}, {quote(char)})"
        return x

    raw, text = "html", "body"
    for tag in loaders.DROPPED:
        raw = swap(raw, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    raw = swap(raw, r"(?s)<!--.*?-->", "")
    for pattern, by in loaders.MARKUP:
        text = swap(text, pattern, by)
    inside = ", ".join("nullif(regexp_extract(raw, " + quote(rf"(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|$)") + ", 1), '')" for t in ("article", "main", "body"))
    title = entities("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")
    return f"WITH r AS (SELECT page_id, html, {raw} AS raw FROM pages), b AS (SELECT page_id, html, coalesce({inside}, raw) AS body FROM r) SELECT page_id, nullif({_title_sql(title)}, '') AS title, " + swap(entities(text), r"^\s+|\s+$", "") + " AS text FROM b"


def _title_sql(raw: str) -> str:
    """A title of at most 120 characters."""
    flat = f"trim(regexp_replace({raw}, '\\s+', ' ', 'g'))"
    cut = f"substring({flat}, 1, 120)"
    first, words = f"regexp_extract({cut}, '^(.*?[.!?])\\s', 1)", f"regexp_extract({cut}, '^(.*) ', 1)"
    return f"CASE WHEN length({flat}) <= 120 THEN {flat} WHEN length({first}) > 30 THEN {first} ELSE rtrim(CASE WHEN length({words}) > 40 THEN {words} ELSE {cut} END) || '…' END"


def _oracles() -> dict[str, str]:
    from strataq.plans import retrieval_queries as q

    metrics = f"""WITH {q.P_SQL}, {q.DENSE_SQL}, {q.LEX_SQL},
u AS (SELECT 'vector' AS variant, question_id, doc_id, dense_rank AS position FROM dense WHERE dense_rank <= 10 UNION ALL SELECT 'lexical', question_id, doc_id, sparse_rank FROM sparse WHERE sparse_rank <= 10),
r AS (SELECT u.*, contains(lower(p.source || ' x'), 'src' || (question_id % 20)) AS rel FROM u JOIN p USING (doc_id)),
g AS (SELECT variant, question_id, max((rel AND position = 1)::INT) AS hit1, max((rel AND position <= 3)::INT) AS hit, min(position) FILTER (WHERE rel) AS first, coalesce(sum(ln(2) / ln(position + 1)) FILTER (WHERE rel AND position <= 3), 0) AS dcg, count(*) FILTER (WHERE rel AND position <= 3) AS found FROM r GROUP BY ALL),
m AS (SELECT variant, round(avg(hit1), 6) AS hit_at_1, round(avg(hit), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
 round(avg(CASE found WHEN 0 THEN 0 WHEN 1 THEN least(1, dcg) WHEN 2 THEN least(1, dcg / (1 + ln(2) / ln(3))) ELSE least(1, dcg / (1 + ln(2) / ln(3) + 0.5)) END), 6) AS ndcg, count(*) AS n_questions FROM g GROUP BY 1)"""
    owned = "(owner_id IS NULL OR owner_id = 'src3') AND superseded_by IS NULL"
    name = "CASE doc_id % 4 WHEN 0 THEN '3f2a9c0d 11bb 4cde 8a77 0123456789ab' WHEN 1 THEN source || ' guide' WHEN 2 THEN '' ELSE lang || ' notes.v2' END"
    line = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 8 AND length(x) < 120 AND regexp_matches(x, '[a-zA-Z]'))[1]"
    return {
        "html_load": _html_sql(),
        "titles": f"""WITH n AS (SELECT *, {name} AS name, CASE WHEN doc_id % 3 = 0 THEN {line} END AS line FROM documents)
SELECT doc_id, CASE WHEN name = '' THEN 'Untitled' ELSE name END AS file_title, CASE WHEN doc_id % 5 = 0 THEN 'Meta title' WHEN line IS NOT NULL THEN line WHEN doc_id % 4 IN (0, 2) THEN 'Untitled PDF' ELSE name END AS pdf_title, {_title_sql('text')} AS short_title, 'pdf' AS format FROM n""",
        "markdown_load": """WITH b AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN '# Head ' || lang || chr(10) ELSE '' END || text AS body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T ' || source WHEN doc_id % 3 = 0 THEN 'Head ' || lang ELSE source || ' a b' END AS title, length(body)::INT AS n_text, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS tags FROM b""",
        "pdf_load": r"""WITH b AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]{2,}', ' ', 'g'))) AS ps FROM documents),
s AS (SELECT doc_id, ps, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i - 1], lambda p: length(p) + 2))) AS br, array_to_string(ps, chr(10) || chr(10)) AS t FROM b),
z AS (SELECT doc_id, t, list_transform(br, lambda x: coalesce(x, 0)::INT) AS br FROM s)
SELECT doc_id, length(t)::INT AS n_text, len(br)::INT AS n_pages, br[-1] AS last_break, greatest(1, len(list_filter(br, lambda x: x <= floor(length(t) * 2 / 3))))::INT AS page FROM z""",
        "pdf_text": r"""WITH b AS (SELECT doc_id, text || chr(10) || 'soft-' || chr(10) || 'ened text  here' || chr(10) || 'and more' || repeat(chr(10), 4) || 'End ' AS r FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '-\n([a-z])', '\1', 'g'), '([^\n.!?:;])\n([a-z(])', '\1 \2', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""",
        "private_addresses": """WITH b AS (SELECT event_id, event_id % 256 AS a, event_id // 3 % 256 AS b FROM events)
SELECT event_id, CASE event_id % 10 WHEN 1 THEN true WHEN 2 THEN false ELSE a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224 END AS is_private FROM b""",
        "sentence_split": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([\p{Lu}"''(\[]|[0-9]+\.)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM documents)
SELECT doc_id, unnest(range(1, len(ss) + 1))::INT AS place, unnest(ss) AS sentence FROM s""",
        "breadcrumbs": """SELECT doc_id, lang || ' > ' || source || ' > **End**' AS crumb, CASE WHEN doc_id % 2 = 0 THEN 'About it.' || chr(10) || chr(10) ELSE '' END || lang || ' > ' || source || ' > End' || chr(10) || chr(10) || source AS indexed_text FROM documents""",
        "boilerplate_sections": "SELECT doc_id, doc_id % 4 < 2 AS is_boilerplate FROM documents",
        "balanced_groups": f"WITH {D_SQL}, {C_SQL}, {N_SQL} SELECT document_id, ordinal, floor(ordinal / ceil(lines / ceil(lines / 28)))::INT AS group_no FROM c JOIN n USING (document_id)",
        "document_briefs": """WITH b AS (SELECT doc_id, source, lang, text, greatest(0, least(750, length(text) - 600))::INT AS s FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE 'Section outline:' || chr(10) || '- ' || source || chr(10) || '- ' || lang || chr(10) || chr(10) || 'Nearby text:' || chr(10) || '…' || substring(text, s + 1, 600) || '…' END AS brief FROM b""",
        "context_replies": "SELECT doc_id, 'again ' || source AS first, 'in ' || lang AS second, lang AS third FROM documents",
        "duplicate_decisions": f"""WITH {D_SQL}, k AS (SELECT sha256(text) AS checksum, coalesce(owner_id, '') AS owner, bool_or(status = 'ready' AND document_id % 3 > 0) AS usable, min(document_id) AS stored_id FROM d WHERE document_id % 2 = 0 GROUP BY ALL)
SELECT document_id, CASE WHEN stored_id IS NULL THEN 'new' WHEN usable THEN 'duplicate' ELSE 'replace' END AS decision, stored_id FROM d LEFT JOIN k ON checksum = sha256(text) AND owner = coalesce(owner_id, '') WHERE document_id % 2 = 1""",
        "version_chains": f"WITH {D_SQL}, {V_SQL} SELECT document_id, version, supersedes, superseded_by FROM v",
        "lineage_closure": f"""WITH RECURSIVE {D_SQL}, {V_SQL}, e AS (SELECT document_id AS x, supersedes AS y FROM v WHERE supersedes IS NOT NULL UNION SELECT supersedes, document_id FROM v WHERE supersedes IS NOT NULL),
l AS (SELECT document_id AS root, document_id FROM v WHERE superseded_by IS NULL AND supersedes IS NOT NULL UNION SELECT l.root, e.y FROM l JOIN e ON e.x = l.document_id) SELECT root, document_id FROM l""",
        "section_changes": f"""WITH {D_SQL}, {C_SQL},
o AS (SELECT document_id, ordinal % 5 AS s, trim(regexp_replace(string_agg(content, '' ORDER BY ordinal), '\\s+', ' ', 'g')) AS t FROM c GROUP BY ALL),
w AS (SELECT document_id, ordinal % 5 AS s, trim(regexp_replace(string_agg(content || CASE WHEN document_id % 3 = 0 AND ordinal % 5 = 1 THEN '!' ELSE '' END, '' ORDER BY ordinal), '\\s+', ' ', 'g')) AS t FROM c WHERE NOT (document_id % 2 = 0 AND ordinal % 5 = 4) GROUP BY ALL),
x AS (SELECT document_id, count(*) FILTER (WHERE w.t IS NULL) AS removed, count(*) FILTER (WHERE o.t <> w.t) AS changed FROM o LEFT JOIN w USING (document_id, s) GROUP BY 1)
SELECT document_id, 0::BIGINT AS added, removed, changed, removed = 0 AND changed > 0 AS body_only, CASE WHEN removed + changed = 0 THEN 'no section-level changes' ELSE concat_ws(', ', CASE WHEN changed > 0 THEN changed || CASE WHEN changed = 1 THEN ' section rewritten' ELSE ' sections rewritten' END END, CASE WHEN removed > 0 THEN removed || ' removed' END) END AS description FROM x""",
        "model_prefixes": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Represent this sentence for searching relevant passages: ' WHEN 1 THEN 'query: ' ELSE '' END AS query_prefix, CASE WHEN doc_id % 3 = 1 THEN 'passage: ' ELSE '' END AS passage_prefix, CASE WHEN doc_id % 3 = 0 THEN 'cls' ELSE 'mean' END AS pooling FROM documents",
        "ingest_budget": f"WITH {D_SQL} SELECT created_at::DATE::VARCHAR AS day, sum(document_id % 30)::BIGINT AS used, sum(document_id % 30) < 600 AS allowed FROM d GROUP BY 1",
        "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec FROM events),
w AS (SELECT user_id, min(sec) AS s FROM e GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(sec) FROM e WHERE e.user_id = w.user_id AND e.sec >= w.s + 86400) FROM w WHERE w.s IS NOT NULL),
j AS (SELECT e.*, (SELECT max(s) FROM w WHERE w.user_id = e.user_id AND s <= e.sec) AS window_start FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY sec, event_id)::INT AS n_in_window FROM j)
SELECT user_id, event_id AS request_id, window_start, n_in_window, n_in_window <= 2 AS allowed FROM n""",
        "latest_status": "SELECT user_id AS document_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS stage, round(arg_max(value, event_id), 2) AS progress FROM events GROUP BY 1",
        "upsert_rows": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS c_name FROM customer",
        "insert_or_ignore": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 <> 0",
        "copy_vectors": "SELECT vec_id, len(embedding)::INT AS width FROM embeddings WHERE vec_id % 3 <> 0",
        "save_conversations": "SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 6 = 0 THEN 'update' ELSE 'insert' END AS action FROM conversations",
        "delete_owned": "SELECT DISTINCT conv_id AS id, 'o' || (conv_id % 3) AS owner_id FROM conversations WHERE conv_id % 6 <> 0",
        "answer_hits": "SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'click') AS hits FROM events GROUP BY 1",
        "query_log": "SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN text ELSE '' END AS query, CASE WHEN item_id % 2 = 0 THEN 'A ' || text ELSE '' END AS answer FROM benchmark",
        "merge_metadata": "SELECT doc_id, source AS a, 'new' AS b, lang AS c FROM documents",
        "supersede": f"WITH {D_SQL}, {V_SQL} SELECT v.document_id, n.document_id AS superseded_by FROM v LEFT JOIN v n ON n.supersedes = v.document_id AND n.status = 'ready'",
        "keep_best": "SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn FROM (SELECT user_id, event_id, round(value, 0) AS score FROM events)) WHERE rn = 1",
        "list_documents": f"WITH {D_SQL}, {V_SQL} SELECT document_id, title, owner_id IS NULL AS shared, (SELECT count(*) FROM v o WHERE o.superseded_by IS NOT NULL AND o.source_uri = v.source_uri AND o.owner_id IS NOT DISTINCT FROM v.owner_id) AS prior_versions FROM v WHERE superseded_by IS NULL",
        "searchable_documents": f"WITH {D_SQL}, {V_SQL} SELECT document_id FROM v WHERE {owned} AND status = 'ready'",
        "corpus_stats": f"WITH {D_SQL}, {V_SQL}, {C_SQL}, o AS (SELECT * FROM v WHERE {owned}) SELECT (SELECT count(*) FROM o WHERE status = 'ready') AS documents, count(*) AS chunks, coalesce(sum(ceil(length(content) / 4)), 0)::BIGINT AS tokens FROM c WHERE document_id IN (SELECT document_id FROM o)",
        "conversation_list": """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS t, count(*) AS n FROM conversations GROUP BY 1), g AS (SELECT conv_id, n, trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g')) AS t FROM f)
SELECT conv_id, CASE WHEN t = '' THEN 'Untitled conversation' WHEN length(t) > 70 THEN rtrim(substring(t, 1, 70)) || '…' ELSE t END AS title, n::INT AS n_turns FROM g""",
        "integrity_report": f"""WITH {D_SQL}, {V_SQL}, {C_SQL}, {N_SQL}, k AS (SELECT c.*, e.embedding, (document_id + ordinal) % 29 = 0 AS bare FROM c LEFT JOIN embeddings e ON e.vec_id = document_id)
SELECT 'total' AS level, 'documents' AS name, count(*) AS n FROM d UNION ALL SELECT 'total', 'chunks', count(*) FROM c
UNION ALL SELECT 'fail', 'missing_context', count(*) FROM k JOIN v USING (document_id) WHERE bare AND superseded_by IS NULL
UNION ALL SELECT 'fail', 'ready_empty', count(*) FROM d WHERE status = 'ready' AND document_id % 7 = 0
UNION ALL SELECT 'warn', 'stuck', count(*) FROM d WHERE status = 'indexing' AND created_at < timestamp '2024-01-31 23:30:00'
UNION ALL SELECT 'fail', 'chunk_drift', count(*) FROM d WHERE status = 'ready' AND document_id % 7 = 0
UNION ALL SELECT 'fail', 'duplicate_current', count(*) FROM (SELECT 1 FROM v WHERE superseded_by IS NULL AND status = 'ready' GROUP BY source_uri, coalesce(owner_id, ''), title HAVING count(*) > 1)
UNION ALL SELECT 'fail', 'width_mismatch', count(*) FROM k WHERE len(embedding) <> 64
UNION ALL SELECT 'fail', 'hollow_conversation', count(*) FROM (SELECT 1 FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0)
UNION ALL SELECT 'fail', 'null_vector', count(*) FROM k WHERE embedding IS NULL""",
        "read_sections": f"WITH {D_SQL}, {C_SQL} SELECT document_id, lang || ' > s' || (ordinal % 2) AS section, substring(string_agg(content, chr(10) || chr(10) ORDER BY ordinal), 1, 8000) AS text, count(*) AS n_chunks FROM c GROUP BY 1, 2",
        "ir_metrics": f"{metrics} SELECT * FROM m",
        "metric_lift": f"{metrics} SELECT variant, ndcg, round((ndcg - (SELECT ndcg FROM m WHERE variant = 'vector')) / nullif((SELECT ndcg FROM m WHERE variant = 'vector'), 0), 6) AS lift, ndcg = (SELECT max(ndcg) FROM m) AS is_best FROM m",
        "relative_times": "WITH a AS (SELECT event_id, ts, 1706745600 - floor(epoch(ts))::BIGINT AS age FROM events) SELECT event_id, age, CASE WHEN age < 90 THEN 'just now' WHEN age < 3600 THEN floor(age / 60 + 0.5)::BIGINT || 'm ago' WHEN age < 86400 THEN floor(age / 3600 + 0.5)::BIGINT || 'h ago' WHEN age < 604800 THEN floor(age / 86400 + 0.5)::BIGINT || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM a",
        "required_keys": "SELECT CASE n_nationkey % 5 WHEN 0 THEN 'ALPHA_API_KEY' WHEN 1 THEN 'BETA_API_KEY' WHEN 2 THEN 'GAMMA_API_KEY' ELSE 'DELTA_API_KEY' END AS key, string_agg(n_name, ', ' ORDER BY n_name) AS stages FROM nation WHERE n_nationkey % 5 < 4 GROUP BY 1",
        "trace_spans": """WITH s AS (SELECT user_id AS trace_id, event_id % 6 AS span_id, arg_max(event_type, event_id) AS stage, round(arg_max(value, event_id), 2) AS ms, min(event_id) AS began FROM events GROUP BY ALL)
SELECT trace_id, span_id, stage, ms, row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(list_position(['view', 'click', 'signup', 'purchase'], stage), 5), began)::INT AS place, round(ms / greatest(max(ms) OVER (PARTITION BY trace_id), 1e-9), 6) AS share FROM s""",
        "stream_first_seen": "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
        "stream_ingest": "SELECT event_type || '/' || user_id AS checksum, min(event_id) AS document_id FROM events GROUP BY 1",
        "request_rates": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
        "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + interval '6' hour THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + interval '6' hour AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + interval '6' hour <= (SELECT max(ts) - interval '10' minute FROM events)""",
    }


QUERIES = {f.__name__: f for f in (html_load, markdown_load, pdf_load, pdf_text, titles, private_addresses, sentence_split, chunk_documents, breadcrumbs, boilerplate_sections, balanced_groups, document_briefs, context_replies, duplicate_decisions, version_chains, lineage_closure, section_changes, embed_batches, model_prefixes, ingest_budget, rate_limit, latest_status, upsert_rows, insert_or_ignore, copy_vectors, save_conversations, delete_owned, answer_hits, query_log, merge_metadata, supersede, keep_best, list_documents, searchable_documents, corpus_stats, conversation_list, integrity_report, read_sections, ir_metrics, metric_lift, relative_times, required_keys, trace_spans, stream_first_seen, stream_ingest, request_rates, event_sessions, stream_rate_limit)}
ORACLES = _oracles()
ORACLES["stream_rate_limit"] = ORACLES["rate_limit"]
