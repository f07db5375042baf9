"""Source divergence audit: how far each source's words are from those of the other sources of its language.

Relational throughout: regular-expression matches are exploded and counted by language, source and term; each language keeps the terms
that enough of its documents have; groups are crossed with their language's kept terms, so that terms they never use count
as zero; the dense table joins itself on the term, and sums and window ranks follow. The counts are combined before
they are shuffled, so a hot source is no hot spot. A probability is a whole number of billionths with one added to each count, and a
divergence a whole number too: all arithmetic is exact in 64 bits (up to 9 * 10^15 terms in a group).

Defined results: a null text, language or source reads as ''. Each row is a document, repeated rows too; a text of any length is read whole.
A source whose documents have no kept term is a group all the same, with the smoothed zero everywhere; a language
that keeps no term has pairs of value 0 and no terms. Equal values rank by the item's UTF-8 bytes. An empty table
has no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.tables import discard, written

#: What stands between terms, which are letters and whatever isn't ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups (a few numbers each) that are broadcast; more of them are joined in ``SALTS`` parts of each language.
MOST_GROUPS, SALTS = 20_000, 64


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def billionths(part: Column, whole: Column) -> Column:
    """floor(10^9 * part / whole) for 0 <= part <= whole, three digits at a time, so that no step leaves 64 bits."""
    out, rest = F.lit(0).cast("long"), part
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, whole), rest % whole
    return out


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in each group, and how many of its documents hold the term."""
    own = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    # what lies between the matches of BETWEEN are the terms; sorted, so that a document's first one of each kind is known
    text = F.coalesce("text", F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # in ASCII only A-Z are changed
    rows = documents.select(*own, F.sort_array(F.split(low, BETWEEN)).alias("all"))
    pairs = F.arrays_zip(F.col("all").alias("term"), F.concat(F.array(F.lit("")), "all").alias("before"))
    terms = rows.select("lang", "source", F.explode(pairs).alias("pair")).where("pair.term <> ''")
    return terms.groupBy("lang", "source", F.col("pair.term").alias("term")).agg(F.count("*").alias("n"), F.count_if(F.col("pair.term") != F.col("pair.before")).alias("docs"))


def crossed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each kept term of a language with each of its groups."""
    if groups.count() <= MOST_GROUPS:
        return kept.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kept.withColumn("salt", F.pmod("term_id", F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def divergences(documents: DataFrame, min_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``documents`` (text, lang, source).

    Part ``pair``: the chi-squared divergence from each other source of the language, over all kept terms. Part ``term``: the ``most_terms`` terms that a
    source has most above its language.
    """
    counts = written(term_counts(documents), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs)
    kept = written(kept.select(F.monotonically_increasing_id().alias("term_id"), "lang", "term", "total"), "kept")
    groups = written(documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct().select(F.monotonically_increasing_id().alias("group"), "lang", "source"), "groups")
    few = groups.count() <= MOST_GROUPS
    small = F.broadcast if few else (lambda df: df)
    used = written(counts.join(kept.select("lang", "term", "term_id"), ["lang", "term"]).join(small(groups), ["lang", "source"]).select("term_id", "group", "n"), "used")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_words"))
    stats = groups.join(used.groupBy("group").agg(F.sum("n").alias("words")), "group", "left").join(per_lang, "lang", "left")
    stats = written(stats.select("group", "lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), F.coalesce("lang_words", F.lit(0)).alias("lang_words")), "stats")
    discard(counts)

    own = crossed(kept.select("term_id", "lang", "total"), stats.select("group", "lang", "words", "vocabulary", "lang_words")).join(used, ["term_id", "group"], "left")
    n = F.coalesce("n", F.lit(0))
    p, q = (1 + billionths(count + 1, words + F.col("vocabulary")) for count, words in ((n, F.col("words")), (F.col("total"), F.col("lang_words"))))
    dense = written(own.select("term_id", "group", n.alias("n"), p.alias("p"), q.alias("q")), "dense")

    other = dense.select("term_id", F.col("group").alias("other"), F.col("p").alias("other_p"))
    sums = dense.select("term_id", "group", "p").join(other, "term_id").where("group <> other").groupBy("group", "other").agg(F.sum(divergence(F.col("p"), F.col("other_p"))).alias("value"))
    names = stats.select("group", "lang", "source")
    others = names.select(F.col("group").alias("other"), "lang", F.col("source").alias("item"))
    # pairs of groups of a language are the result's own rows
    pairs = names.join(small(others), "lang").where("group <> other").join(sums, ["group", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    above = dense.where("n > 0 and p > q").select("group", "term_id", divergence(F.col("p"), F.col("q")).alias("value"))
    above = above.join(kept.select("term_id", F.col("term").alias("item")), "term_id").join(small(names), "group").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(ranked)
