"""What is decided about a question before anything is searched, as columns over a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.config import DEFAULTS, Settings
from strataq.functions import text as T


def signals(question: Column) -> dict[str, Column]:
    return {
        "has_identifier": question.rlike(T.IDENTIFIER), "has_quoted": question.rlike(T.QUOTED),
        "is_comparison": question.rlike(T.COMPARISON), "is_summary": question.rlike(T.SUMMARY), "n_words": T.word_count(question),
    }


def route(question: Column, n_queries: Column, n_keywords: Column) -> Column:
    """compare, summarize, lookup or explore, in this order of precedence."""
    s = signals(question)
    exact = (n_keywords > 0) | s["has_identifier"] | s["has_quoted"]
    return F.when(s["is_comparison"] | (n_queries > 1), "compare").when(s["is_summary"], "summarize").when(exact & (s["n_words"] <= 8), "lookup").otherwise("explore")


def strategies(spark, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each route, for a broadcast join."""
    c = settings.candidates
    half_up = lambda x: int(x + 0.5)
    rows = [
        ("compare", half_up(1.25 * c), 0.5, 0.5, True, True, settings.neighbour_window),
        ("summarize", c, 0.7, 0.3, True, True, settings.neighbour_window + 1),
        ("lookup", half_up(0.6 * c), 0.3, 0.7, False, False, settings.neighbour_window),
        ("explore", c, settings.dense_weight, settings.sparse_weight, True, True, settings.neighbour_window),
    ]
    return spark.createDataFrame(rows, "route string, candidates int, dense_weight double, sparse_weight double, rerank boolean, hyde boolean, neighbour_window int")


def fast_plan(question: Column, history: Column) -> Column:
    """The keywords of a question that needs no planning, else null: the first 8, then made distinct."""
    s = signals(question)
    quiet = (F.coalesce(history, F.lit("")) == "") & (s["n_words"] <= 8) & ~s["is_comparison"] & ~s["is_summary"] & (s["has_identifier"] | s["has_quoted"])
    found = F.filter(F.transform(F.concat(T.identifiers(question), T.quoted(question)), lambda k: F.trim(k)), lambda k: k != "")
    return F.when(quiet & (F.size(found) > 0), F.array_distinct(F.slice(found, 1, 8)))


def finish_plan(question: Column, standalone: Column, queries: Column, hypotheticals: Column) -> Column:
    """standalone, queries and hypotheticals of a model's plan, with its gaps filled."""
    alone = F.coalesce(F.nullif(F.trim(standalone), F.lit("")), question)
    kept = F.filter(F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q != "")
    own = F.when(F.size(kept) > 1, kept).otherwise(F.array(alone))
    aligned = F.transform(own, lambda _, i: F.coalesce(F.trim(F.get(hypotheticals, i)), F.lit("")))
    return F.struct(alone.alias("standalone"), own.alias("queries"), aligned.alias("hypotheticals"))


def verbatim_plan(question: Column) -> Column:
    """The plan where planning failed: the question as it is, without keywords or hypotheticals."""
    none = F.array().cast("array<string>")
    return F.struct(F.lit("factual").alias("intent"), question.alias("standalone"), F.array(question).alias("queries"), none.alias("keywords"), F.array(F.lit("")).alias("hypotheticals"))


def vector_text(query: Column, hypothetical: Column, hyde: Column, hop: Column) -> Column:
    """What is embedded: the hypothetical answer on the first hop if the route wants it, else the query."""
    return F.when(hyde & (hop == 0) & (F.coalesce(hypothetical, F.lit("")) != ""), hypothetical).otherwise(query)


def lexical_text(query: Column, keywords: Column) -> Column:
    return F.array_join(F.concat(F.array(query), keywords), " ")


def transcript(turns: DataFrame, limit: int = 6, cap: int = 1200) -> DataFrame:
    """conv_id and its last ``limit`` turns before the newest one, each cut to ``cap`` characters, blank ones dropped."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    said = F.substring("text", 1, cap)
    rows = turns.withColumn("back", back).where(f"back between 2 and {limit + 1}").withColumn("said", said).where("said <> ''")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "said"))), lambda x: F.concat(x["role"], F.lit(": "), x["said"]))
    return rows.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("transcript"))


def model_spec(spec: Column, default: str = "gateway") -> Column:
    """backend and id of ``backend:id``; an id keeps its own colons, and no known backend means the default one."""
    known = F.array(*map(F.lit, ("gateway", "google", "llm", "local", "ollama", "supabase")))
    head = F.substring_index(spec, ":", 1)
    has = spec.contains(":") & F.array_contains(known, head)
    return F.struct(F.when(has, head).otherwise(default).alias("backend"), F.when(has, F.substr(spec, F.length(head) + 2)).otherwise(spec).alias("model"))
