"""Reports on the corpus and on retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.config import DEFAULTS


def newest(rows: DataFrame, limit: int, time: str = "created_at", key: str = "document_id") -> DataFrame:
    """The last ``limit`` rows, newest first; equal times by the larger key."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def largest_ready(docs: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` ready documents with the most chunks, and by title among equals."""
    return docs.where("status = 'ready'").orderBy(F.desc("chunk_count"), "title", "document_id").limit(n)


def pending(docs: DataFrame) -> DataFrame:
    """How many current documents are neither ready nor failed."""
    return docs.where("superseded_by is null").agg(F.count_if(~F.col("status").isin("ready", "failed")).alias("pending"))


def text_chars(messages: Column) -> Column:
    """The characters of all text parts of messages (parts (type, text))."""
    return F.aggregate(F.flatten(F.transform(messages, lambda m: F.coalesce(m["parts"], F.array().cast("array<struct<type:string,text:string>>")))), F.lit(0).cast("long"), lambda n, p: n + F.when(p["type"] == "text", F.length(p["text"])).otherwise(0))


def finite(value: Column) -> Column:
    """A number as double; null for what isn't a finite one."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def list_documents(docs: DataFrame) -> DataFrame:
    """Current documents with whether they are shared and how many versions of their source are older."""
    older = docs.where("superseded_by is not null").groupBy("source_uri", F.coalesce("owner_id", F.lit("")).alias("owner")).agg(F.count("*").alias("prior_versions"))
    rows = docs.where("superseded_by is null").withColumn("owner", F.coalesce("owner_id", F.lit("")))
    return rows.join(older, ["source_uri", "owner"], "left").select("document_id", "title", F.col("owner_id").isNull().alias("shared"), F.coalesce("prior_versions", F.lit(0)).alias("prior_versions"))


def searchable(docs: DataFrame, owner: str | None) -> DataFrame:
    return docs.where((F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(owner))) & F.col("superseded_by").isNull() & (F.col("status") == "ready")).select("document_id")


def corpus_stats(docs: DataFrame, chunks: DataFrame, owner: str | None) -> DataFrame:
    """Ready documents, and chunks and tokens of all the owner's current documents, as one row."""
    own = docs.where((F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(owner))) & F.col("superseded_by").isNull())
    held = chunks.join(own.select("document_id"), "document_id", "left_semi").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    return own.agg(F.count_if(F.col("status") == "ready").alias("documents")).crossJoin(held)


def conversation_title(turns: Column) -> Column:
    """The first user text, white space collapsed, cut at 70 characters."""
    first = F.trim(F.regexp_replace(F.coalesce(F.get(F.filter(turns, lambda t: t["role"] == "user"), 0)["text"], F.lit("")), r"\s+", " "))
    return F.when(first == "", "Untitled conversation").when(F.length(first) > 70, F.concat(F.rtrim(F.substring(first, 1, 70)), F.lit("…"))).otherwise(first)


def integrity(docs: DataFrame, chunks: DataFrame, conversations: DataFrame, now: Column, dimensions: int = DEFAULTS.dimensions) -> DataFrame:
    """Findings (level, name, n) of eight checks and two totals."""
    current = docs.where("superseded_by is null")
    held = chunks.groupBy("document_id").agg(F.count("*").alias("held"))
    drift = docs.where("status = 'ready'").join(held, "document_id", "left").where(F.col("chunk_count") != F.coalesce("held", F.lit(0)))
    twice = current.where("source_uri is not null and status = 'ready'").groupBy("source_uri", F.coalesce("owner_id", F.lit("")), "title").count().where("count > 1")
    checks = {
        ("total", "documents"): docs, ("total", "chunks"): chunks,
        ("fail", "missing_context"): chunks.where("context is null").join(current.select("document_id"), "document_id", "left_semi"),
        ("fail", "ready_empty"): docs.where("status = 'ready' and chunk_count = 0"),
        ("warn", "stuck"): docs.where(~F.col("status").isin("ready", "failed") & (F.col("updated_at") < now - F.expr("interval 30 minutes"))),
        ("fail", "chunk_drift"): drift, ("fail", "duplicate_current"): twice,
        ("fail", "width_mismatch"): chunks.where(F.size("embedding") != dimensions),
        ("fail", "hollow_conversation"): conversations.where("n_messages = 0"),
        ("fail", "null_vector"): chunks.where("embedding is null"),
    }
    out = None
    for (level, name), rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def read_section(chunks: DataFrame, cap: int = 8000) -> DataFrame:
    """document_id, section and its text in order, cut at ``cap`` characters."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n\n")
    return chunks.groupBy("document_id", F.array_join("heading_path", " > ").alias("section")).agg(F.substring(text, 1, cap).alias("text"), F.count("*").alias("n_chunks"))


def relevant(title: Column, path: Column, labels: Column, exact: bool = False) -> Column:
    """Whether any label is part of the title and headings, case ignored; or, ``exact``, the whole of one of them.

    As parts, labels also match longer headings that have them in it, such as those of distractors.
    """
    if exact:
        names = F.transform(F.concat(F.array(title), F.coalesce(path, F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)))
        return F.exists(labels, lambda label: F.coalesce(F.array_contains(names, F.lower(F.trim(label))), F.lit(False)))
    where = F.lower(F.concat_ws(" ", title, path))
    return F.exists(labels, lambda label: where.contains(F.lower(label)))


def per_question(ranked: DataFrame, k: int = 3) -> DataFrame:
    """hit1, hit, reciprocal rank and ndcg of each variant and question from rows variant, question_id, position, is_relevant.

    The ideal order of nDCG is the relevant passages found within k, moved to the top.
    """
    gain = lambda at: F.log(F.lit(2.0)) / F.log(at + F.lit(1.0))  # noqa: E731  1 / log2(position + 1)
    top = F.col("position") <= k
    per = ranked.groupBy("variant", "question_id").agg(
        F.max((F.col("is_relevant") & (F.col("position") == 1)).cast("int")).alias("hit1"), F.max((F.col("is_relevant") & top).cast("int")).alias("hit"),
        F.min(F.when(F.col("is_relevant"), F.col("position"))).alias("first"), F.sum(F.when(F.col("is_relevant") & top, gain(F.col("position"))).otherwise(0.0)).alias("dcg"),
        F.count_if(F.col("is_relevant") & top).alias("found"),
    )
    ideal = F.when(F.col("found") > 0, F.aggregate(F.sequence(F.lit(1), F.col("found").cast("int")), F.lit(0.0), lambda s, i: s + gain(i)))
    return per.withColumns({"ndcg": F.when(F.col("found") > 0, F.least(F.lit(1.0), F.col("dcg") / ideal)).otherwise(0.0), "reciprocal": F.coalesce(1 / F.col("first"), F.lit(0.0))})


def ir_metrics(ranked: DataFrame, k: int = 3) -> DataFrame:
    """hit_at_1, hit_rate, mrr and ndcg of each variant."""
    named = {"hit1": "hit_at_1", "hit": "hit_rate", "reciprocal": "mrr", "ndcg": "ndcg"}
    return per_question(ranked, k).groupBy("variant").agg(*(F.round(F.avg(c), 6).alias(n) for c, n in named.items()), F.count("*").alias("n_questions"))


def regressions(ranked: DataFrame, baseline: str, k: int = 3, least: float = 0.01) -> DataFrame:
    """The questions on which a variant's nDCG is below the baseline's by more than ``least``."""
    per = per_question(ranked, k).select("variant", "question_id", "ndcg")
    base = per.where(F.col("variant") == baseline).select("question_id", F.col("ndcg").alias("base"))
    return per.join(base, "question_id").where(F.col("base") - F.col("ndcg") > least).select("variant", "question_id", F.round("ndcg", 6).alias("ndcg"), F.round("base", 6).alias("base"))


def write_record(metrics: DataFrame, path: str, k: int, about: dict[str, str] | None = None) -> None:
    """An evaluation's result as JSON lines: each variant's scores with k and what it was made with."""
    made = F.create_map(*(F.lit(x) for pair in (about or {"": ""}).items() for x in pair))
    scores = F.struct(*(F.col(c) for c in metrics.columns if c != "variant"))
    metrics.select("variant", F.lit(k).alias("k"), made.alias("models"), scores.alias("scores")).write.mode("overwrite").json(path)


def lift(metrics: DataFrame, baseline: str) -> DataFrame:
    """Change of each variant's nDCG against a baseline, and whether it is the best."""
    base = metrics.where(F.col("variant") == baseline).select(F.col("ndcg").alias("base"))
    best = metrics.agg(F.max("ndcg").alias("best"))
    return metrics.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best)).select("variant", "ndcg", F.when(F.col("base") > 0, F.round((F.col("ndcg") - F.col("base")) / F.col("base"), 6)).alias("lift"), (F.col("ndcg") == F.col("best")).alias("is_best"))


def relative_time(seconds: Column, at: Column) -> Column:
    """just now, minutes, hours or days ago, then the date."""
    unit = lambda n, s: F.concat(F.floor(seconds / n + 0.5).cast("string"), F.lit(s))
    return F.when(seconds < 90, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).when(seconds < 604800, unit(86400, "d ago")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def required_keys(stages: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key that a stage's backend needs, with the stages that need it.

    ``keys`` (backend, key) says which backend needs which; one that isn't there, such as a local one, needs none.
    """
    return stages.join(keys, "backend").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("stage")), ", ").alias("stages"))


def trace_summary(spans: DataFrame, stages: list[str]) -> DataFrame:
    """The last row of each span, in causal order (stage, then arrival), with its share of the slowest one."""
    rank = F.coalesce(F.element_at(F.create_map(*(x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i)))), F.col("stage")), F.lit(len(stages)))
    last = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct("stage", "ms", "arrival"), "arrival").alias("s"), F.min("arrival").alias("began")).select("trace_id", "span_id", "s.stage", "s.ms", "began")
    w = W.partitionBy("trace_id")
    return last.withColumn("place", F.row_number().over(w.orderBy(rank, "began"))).withColumn("share", F.round(F.col("ms") / F.greatest(F.max("ms").over(w), F.lit(1e-9)), 6)).drop("began")
