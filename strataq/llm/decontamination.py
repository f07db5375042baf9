"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become words; numbers, capitalised words and units after a number are replaced by typed placeholders, so
a question asked again with other numbers or names keeps its template. Windows of ``window`` placeholders and
words are hash-joined with the benchmark's windows. For each document, item and alignment that met, the values
in the slots are compared: the same value of the item must stand for one value of the document throughout.
A pair is reported if enough of the item is covered by consistent windows.

A template with fewer than ``LITERALS`` plain words says too little (nouns are capitalised in German, tables are all
numbers, a passage in capitals all names): such windows are joined by their words as they stand, case ignored, with which all
windows of items are known too. So are items of fewer words than a window, as a whole. In scripts without blanks each character is a word.
The benchmark is broadcast in blocks of at most ``MOST_BROADCAST`` windows, each with a pass over the documents.

Defined results: null and empty texts match nothing; an item of a single word is found wherever the word is, unless ``shortest``
says that items need more words to be looked for; rows that repeat a doc_id or an item_id are taken together; null ids match nothing; columns besides the ids and
texts are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.tables import written

WINDOW = 8
LITERALS = 4
MOST_BROADCAST = 500_000
#: Fixed list of unit words; only after a number are they units.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "miles", "mile", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "liters", "meters", "kilometers", "grams", "kilograms")
#: Scripts that are written without blanks: Thai and Lao, Burmese, Khmer, kana, Han. As ranges, which are looked up faster than scripts.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}"
_WORD = r"\p{N}[\p{N}.,]*|[\p{L}\p{M}]+"


def words_of(text: Column) -> Column:
    """Numbers and letter runs of a text, and each letter of a script without blanks."""
    text = F.coalesce(text, F.lit(""))
    unspaced = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{_UNSPACED}]")
    spaced = F.when(unspaced, F.regexp_replace(text, rf"([{_UNSPACED}&&\p{{L}}]\p{{M}}*)", " $1 ")).otherwise(text)
    return F.regexp_extract_all(spaced, F.lit(_WORD), F.lit(0))


def is_number(word: Column) -> Column:
    return word.substr(1, 1).between("0", "9")


def canonical(words: Column) -> Column:
    """The words with typed placeholders."""

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        unit = low.isin(*UNITS) & is_number(F.coalesce(F.get(words, i - 1), F.lit("")))
        return F.when(is_number(w), F.lit("#n")).when(w.substr(1, 1) != low.substr(1, 1), F.lit("#a")).when(unit, F.lit("#u")).otherwise(low)

    return F.transform(words, one)


def windows(rows: DataFrame, key: str, window: int, shorter: list[int], both: bool = False) -> DataFrame:
    """(key, at, h): a 64-bit hash of each window of ``canon``, and of each of ``shorter`` words; ``at`` counts words from 0.

    With ``both`` a window that is rich in plain words has one more of its words as they stand.

    Doubling: a window of 2k is one of k and the one k places later, so few steps make a long window. Each
    step is a column of its own, since an expression that is used twice would be computed twice.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    rows = rows.select(key, "words", F.transform("canon", lambda w: F.xxhash64(w)).alias("h"), F.transform("canon", lambda w: F.when(w.startswith("#"), 0).otherwise(1)).alias("plain"))
    k = 1
    while k < window:
        whole = F.greatest(F.size("h") - k, F.lit(0))
        here, later = (lambda c: F.slice(c, F.lit(1), whole)), (lambda c: F.slice(c, F.lit(k + 1), whole))
        rows = rows.select(key, "words", F.zip_with(here("h"), later("h"), lambda a, b: F.xxhash64(a, b)).alias("h"), F.zip_with(here("plain"), later("plain"), lambda a, b: a + b).alias("plain"))
        k *= 2
    as_they_stand = lambda i, n: F.xxhash64(F.lit(n), F.lower(F.array_join(F.slice("words", i + 1, n), " ")))
    # zipped: what a function looks up for each element would be computed for each, if it is an expression of this query
    own = F.transform(F.arrays_zip("h", "plain"), lambda x, i: F.struct(i.alias("at"), F.when(x["plain"] >= LITERALS, x["h"]).otherwise(as_they_stand(i, window)).alias("h")))

    def whole(n: int) -> Column:
        places = F.sequence(F.lit(0), F.size("words") - n)
        return F.when(F.size("words") >= n, F.transform(places, lambda i: F.struct(i.alias("at"), as_they_stand(i, n).alias("h")))).otherwise(F.array())

    short = [whole(n) for n in shorter]
    if both:
        short.append(F.filter(F.transform("plain", lambda p, i: F.when(p >= LITERALS, F.struct(i.alias("at"), as_they_stand(i, window).alias("h")))), lambda x: x.isNotNull()))
    rows = rows.select(key, (F.concat(own, *short) if short else own).alias("all"))
    # the outer form: for the other one a filter on the array's size would be computed apart, from the words on
    return rows.select(key, F.explode_outer("all").alias("one")).where("one is not null").select(key, "one.at", "one.h")


def _tokens(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(key, words_of(F.col("text")).alias("words")).select(key, "words", canonical(F.col("words")).alias("canon"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, enough: int = 30, consistency: float = 0.75, shortest: int = 1) -> DataFrame:
    """doc_id, item_id, n_words (of the item, covered), coverage and consistency of each pair to be reported.

    A pair is reported if ``coverage`` of the item's words, or ``enough`` of them, are covered.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _tokens(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id")
    length = F.size("words")
    shorter = sorted(r[0] for r in items.where(length.between(shortest, window - 1)).select(length).distinct().collect())  # fewer than a window's words
    # of an item that is shorter than a window only the whole is looked for
    known = [windows(items, "item_id", window, [], both=True), *(windows(items.where(length == n), "item_id", window, [n]) for n in shorter)]
    known = written(reduce(DataFrame.unionByName, known).select("h", "item_id", F.col("at").alias("item_at")).distinct(), "known")
    parts = known.count() // MOST_BROADCAST + 1
    hits = []
    for k in range(parts):
        some = F.broadcast(known.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k))
        found = windows(_tokens(docs, "doc_id"), "doc_id", window, shorter).join(some, "h")
        hits.append(written(found.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("places")), "hits"))
    hits = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "item_id", "shift").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))

    # slot values of the words under the windows that met
    again = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    said = again.select("doc_id", words_of(F.col("text")).alias("doc_words"))
    lined = hits.join(said, "doc_id").join(items.select("item_id", F.col("words").alias("item_words"), "canon"), "item_id")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, F.least(p + window, F.size("canon")) - 1))))
    lined = lined.withColumn("covered", covered)
    slots = F.filter("covered", lambda i: F.get("canon", i).startswith("#"))
    values = F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("item_words", i).alias("item"), F.get("doc_words", (i + F.col("shift")).cast("int")).alias("doc"))))
    lined = lined.withColumn("values", values)
    kept = F.size(F.array_distinct(F.transform("values", lambda v: v["item"])))
    lined = lined.withColumn("consistency", F.when(F.size("values") == 0, 1.0).otherwise(kept / F.size("values"))).where(F.col("consistency") >= consistency)
    pairs = lined.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_words"), F.max(F.size("canon")).alias("of"), F.min("consistency").alias("consistency"))
    share = F.col("n_words") / F.col("of")
    return pairs.where((share >= coverage) | (F.col("n_words") >= enough)).select("doc_id", "item_id", F.col("n_words").cast("long"), share.alias("coverage"), "consistency")
