"""Ingest decisions over document rows: identity, versions, changes, contexts, batches and limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.config import DEFAULTS
from strataq.functions import text as T
from strataq.operators.graph import connected
from strataq.tables import written

#: A tile of a lineage: about so many starts at most with so many documents, both of one component, before they become rows.
TILE_ROOTS, TILE_DOCUMENTS = 256, 1024


def decide_duplicates(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """arriving (checksum, owner_id, …) with ``decision``: duplicate, replace or new, and the stored document's id.

    Same bytes of the same owner; a stored document counts if it is ready and holds chunks, else it is replaced.
    """
    usable = (F.col("status") == "ready") & (F.col("chunk_count") > 0)
    known = stored.groupBy("checksum", F.coalesce("owner_id", F.lit("")).alias("owner")).agg(F.max(usable).alias("usable"), F.min("document_id").alias("stored_id"))
    rows = arriving.withColumn("owner", F.coalesce("owner_id", F.lit(""))).join(known, ["checksum", "owner"], "left")
    decision = F.when(F.col("stored_id").isNull(), "new").when(F.col("usable"), "duplicate").otherwise("replace")
    return rows.withColumn("decision", decision).drop("owner", "usable")


def chain_versions(docs: DataFrame) -> DataFrame:
    """version, supersedes and superseded_by of documents (owner_id, source_uri, title, is_url, status, document_id).

    One source of one owner; uploads also need the same title, a page may change it. Only a document that is ready is a
    version that others follow: one that failed or isn't indexed yet names its predecessor but retires nothing.
    """
    key = [F.coalesce("owner_id", F.lit("")), F.col("source_uri"), F.when(F.col("is_url"), F.lit("")).otherwise(F.col("title"))]
    before = W.partitionBy(*key).orderBy("document_id").rowsBetween(W.unboundedPreceding, -1)
    # what follows, by going backwards: a frame that ends with the group would be read anew for each row
    after = W.partitionBy(*key).orderBy(F.desc("document_id")).rowsBetween(W.unboundedPreceding, -1)
    ready = F.when(F.col("status") == "ready", F.col("document_id"))
    return docs.withColumns({
        "version": (F.count(ready).over(before) + 1).cast("int"), "supersedes": F.max(ready).over(before),
        "superseded_by": F.when(F.col("status") == "ready", F.min(ready).over(after)),
    })


def new_rows(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append for arriving documents (document_id, owner_id, source_uri, title, is_url, ...): with status, version and supersedes.

    The predecessor is the latest version of the same source among stored documents that are current and ready.
    """
    key = lambda: [F.coalesce("owner_id", F.lit("")).alias("owner key"), F.col("source_uri").alias("source key"), F.when(F.col("is_url"), F.lit("")).otherwise(F.col("title")).alias("title key"), F.col("is_url").alias("url key")]
    current = stored.where("superseded_by is null and status = 'ready'").select(*key(), "document_id", "version")
    last = current.groupBy("owner key", "source key", "title key", "url key").agg(F.max(F.struct("version", "document_id")).alias("last"))
    rows = arriving.select("*", *key()).join(last, ["owner key", "source key", "title key", "url key"], "left")
    return rows.select(*arriving.columns, F.lit("parsing").alias("status"), (F.coalesce("last.version", F.lit(0)) + 1).cast("int").alias("version"), F.col("last.document_id").alias("supersedes"))


def lineage(links: DataFrame, start: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(root, document_id): all documents that a chain of links (document_id, supersedes) joins with each start.

    The links' components are found by doubling, so long chains take few rounds; each start then has its component's documents. With
    ``owners`` (document_id, owner_id) a chain never leaves the owner's documents.

    The rows are starts times documents of a component. They are dealt out as tiles and told document by document with the same few
    starts again and again, which a file's encoding keeps in a small part of the bytes that all documents in turn would take.
    """
    links = links.where("supersedes is not null")
    if owners is not None:
        mine, theirs = (owners.select(F.col("document_id").alias(k), F.coalesce("owner_id", F.lit("")).alias(f"{k} owner")) for k in ("document_id", "supersedes"))
        links = links.join(mine, "document_id").join(theirs, "supersedes").where(F.col("document_id owner") == F.col("supersedes owner"))
    members = connected(links.select(F.col("document_id").alias("a"), F.col("supersedes").alias("b")))
    roots = start.select(F.col("document_id").alias("root")).distinct()
    told = roots.join(members, F.col("root") == F.col("node"), "left").select("root", "component")

    def blocks(rows: DataFrame, column: str, most: int) -> DataFrame:
        # dealt by hash into as many as their number asks for, so that no component is sorted as one group
        number = rows.groupBy("component").agg(F.ceil(F.count("*") / most).alias("blocks"))
        block = F.pmod(F.xxhash64(column), "blocks").alias(f"{column} block")
        return rows.join(number, "component").groupBy("component", block).agg(F.sort_array(F.collect_list(column)).alias(f"{column}s"))

    documents = blocks(members.withColumnRenamed("node", "document_id"), "document_id", TILE_DOCUMENTS)
    tiles = documents.join(blocks(told.where("component is not null"), "root", TILE_ROOTS), "component")
    # By number, as partitions that are put together by their bytes would be one task's: a tile is small, and its rows are not. By a
    # hash of the block, as a repartition by the columns that it was grouped by is left out.
    dealt = tiles.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("component", "document_id block"))
    joined = dealt.select("roots", F.explode("document_ids").alias("document_id")).select(F.explode("roots").alias("root"), "document_id")
    return joined.unionByName(told.where("component is null").select("root", F.col("root").alias("document_id")))


def section_diff(before: DataFrame, after: DataFrame, key: str = "document_id") -> DataFrame:
    """Counts of added, removed and changed sections of chunks (key, ordinal, heading_path, content), and a description."""

    def sections(chunks: DataFrame, name: str) -> DataFrame:
        path = F.coalesce(F.nullif(F.array_join("heading_path", " > "), F.lit("")), F.lit("(opening)"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "")
        return chunks.groupBy(key, path.alias("section")).agg(F.trim(F.regexp_replace(whole, r"\s+", " ")).alias(name))

    both = sections(before, "old").join(sections(after, "new"), [key, "section"], "full_outer")
    n = both.groupBy(key).agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("changed"))
    return n.select(key, "added", "removed", "changed", ((F.col("added") == 0) & (F.col("removed") == 0) & (F.col("changed") > 0)).alias("body_only"), describe(F.col("changed"), F.col("added"), F.col("removed")).alias("description"))


def describe(changed: Column, added: Column, removed: Column) -> Column:
    text = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), what))
    parts = F.concat_ws(", ", text(changed, F.when(changed == 1, " section rewritten").otherwise(" sections rewritten")), text(added, F.lit(" added")), text(removed, F.lit(" removed")))
    return F.when(parts == "", "no section-level changes").otherwise(parts)


def balanced_group(index: Column, n: Column, most: int = DEFAULTS.context_batch) -> Column:
    """Group (from 0) of the item ``index`` (from 0) of n, in groups of nearly the same size."""
    return F.floor(index / F.ceil(n / F.ceil(n / most))).cast("int")


def document_brief(text: Column, outline: Column, first: Column, last: Column, limit: int = DEFAULTS.brief_chars, window: int = DEFAULTS.brief_window) -> Column:
    """A short text as it is; of a long one, its outline (60 distinct paths) and a window around the group's middle."""
    middle = F.floor((first + last) / 2)
    start = F.greatest(F.lit(0), F.least(middle - window // 2, F.length(text) - window)).cast("int")
    near = F.concat(F.lit("…"), F.substr(text, start + 1, F.lit(window)), F.lit("…"))
    heads = F.slice(F.array_distinct(F.filter(outline, lambda h: h != "")), 1, 60)
    listed = F.array_join(F.transform(heads, lambda h: F.concat(F.lit("- "), h)), "\n")
    return F.when(F.length(text) <= limit, text).when(listed != "", F.concat(F.lit("Section outline:\n"), listed, F.lit("\n\nNearby text:\n"), near)).otherwise(near)


def reply_lines(reply: Column) -> Column:
    """``n| text`` lines of a model's reply as map<int, string>; the last line of a number wins."""
    lines = F.filter(F.split(reply, "\n"), lambda x: x.rlike(r"^\s*\d+\s*\|\s*\S"))
    number = lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int")
    last = F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, i + 2, F.size(lines)), lambda y: number(y) == number(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(number(x), F.trim(F.regexp_extract(x, r"^\s*\d+\s*\|(.*)$", 1)))))


def contexts_in_halves(excerpts: DataFrame, ask: Callable[[DataFrame], DataFrame], depth: int = 3) -> DataFrame:
    """excerpts (group, position, fallback) with ``context``: a model's line for each, else the fallback.

    ``ask(groups)`` gets (group, size) and returns (group, reply). A group whose reply has no usable line is asked again as
    two halves, ``depth`` times at most; a line that is missing or blank is never another excerpt's.
    """
    order = W.partitionBy("group").orderBy("position")
    open_, done = written(excerpts.withColumns({"n": F.row_number().over(order), "size": F.count("*").over(W.partitionBy("group"))}), "groups"), []
    for turn in range(depth + 1):
        replies = ask(open_.select("group", "size").distinct()).select("group", reply_lines(F.coalesce("reply", F.lit(""))).alias("lines"))
        rows = written(open_.join(replies, "group", "left").withColumn("line", F.try_element_at("lines", "n")), "replies")
        empty = (F.coalesce(F.size("lines"), F.lit(0)) <= 0) & (F.col("size") > 1) & F.lit(turn < depth)
        done.append(rows.where(~empty).select(*excerpts.columns, F.coalesce(F.nullif("line", F.lit("")), "fallback").alias("context")))
        half = F.ceil(F.col("size") / 2)
        first = F.col("n") <= half
        name = F.concat(F.col("group").cast("string"), F.when(first, "a").otherwise("b"))
        rest = rows.where(empty).withColumns({"group": name, "n": F.when(first, F.col("n")).otherwise(F.col("n") - half).cast("int"), "size": F.when(first, half).otherwise(F.col("size") - half)})
        open_ = written(rest.select(*open_.columns), "groups")
        if turn < depth and open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def in_halves(items: list, call: Callable[[list], list]) -> list:
    """``call(items)``; where it fails, both halves are tried by themselves, and an item that fails alone is None."""
    try:
        return list(call(items)) if items else []
    except Exception:  # whatever a model raises
        if len(items) == 1:
            return [None]
        return [*in_halves(items[: len(items) // 2], call), *in_halves(items[len(items) // 2 :], call)]


def embed(rows: DataFrame, key: str, call: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """``key`` and its text's vector by a model's ``call``; texts that it always fails on have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [v for k in range(0, len(pdf), batch) for v in in_halves(pdf["text"].iloc[k : k + batch].to_list(), call)]
            yield pd.DataFrame({key: pdf[key], "vector": pd.Series(found, index=pdf.index, dtype=object)})

    return rows.select(key, "text").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


def captured(rows: DataFrame, key: str, column: str, work: Callable[[object], object]) -> DataFrame:
    """``key``, status and error of each row: an error of ``work`` fails its own row, not the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, value in zip(pdf[key], pdf[column], strict=True):
                try:
                    work(value)
                    out.append((name, "ready", None))
                except Exception as e:  # whatever a parser raises
                    out.append((name, "failed", str(e)[:500]))
            yield pd.DataFrame(out, columns=[key, "status", "error"])

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, status string, error string")


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Appends chunks (document_id, ordinal, content, context, indexed_text, ...) to the table at ``path``, each with its id."""
    name = F.concat_ws(":", F.col("document_id").cast("string"), F.col("ordinal").cast("string"))
    chunks.withColumns({"id": name, "context": F.nullif("context", F.lit(""))}).write.mode("append").parquet(path)


def indexed_text(context: Column, title: Column, path: Column, content: Column) -> Column:
    """Context, breadcrumb and content by blank lines, empty ones dropped."""
    crumb = T.breadcrumb(T.plain_text(title), F.transform(path, T.plain_text))
    return F.concat_ws("\n\n", F.nullif(F.trim(context), F.lit("")), F.nullif(crumb, F.lit("")), F.nullif(content, F.lit("")))


def embed_batches(rows: DataFrame, key: str, base: int = 110, each: int = 110, per_char: float = 0.33, most: int = 1500) -> DataFrame:
    """rows (key, position, text) with ``batch`` (from 0): filled in order while the estimated cost fits.

    Greedy within a key: a key's rows are sorted in one partition and taken as they come, any number of keys in a run and no key held whole.
    An item that alone costs more has a batch of its own.
    """

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, started, batch, cost = None, False, 0, float(base)
        for part in parts:
            out = []
            for name, n in zip(part.column(key).to_pylist(), part.column("chars").to_pylist(), strict=True):
                if not started or name != last:
                    last, started, batch, cost = name, True, 0, float(base)
                own = each + per_char * (float("nan") if n is None else n)
                if cost > base and cost + own > most:
                    batch, cost = batch + 1, float(base)
                cost += own
                out.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("position"), pa.array(out, pa.int32())], [key, "position", "batch"])

    kind = rows.schema[key].dataType.simpleString()
    sized = rows.select(key, F.col("position").cast("int").alias("position"), F.length("text").alias("chars"))
    return sized.repartition(key).sortWithinPartitions(key, "position").mapInArrow(fill, f"{key} {kind}, position int, batch int")


def embed_prefix(model: Column, query: bool) -> Column:
    """The instruction that a model family was trained with."""
    name = F.lower(model)
    bge, e5 = ("Represent this sentence for searching relevant passages: ", "query: ") if query else ("", "passage: ")
    return F.when(name.contains("bge-"), bge).when(name.contains("e5-"), e5).otherwise("")


def pooling(model: Column) -> Column:
    return F.when(F.lower(model).contains("bge-"), "cls").otherwise("mean")


def daily_budget(docs: DataFrame, budget: int = DEFAULTS.daily_chunks) -> DataFrame:
    """day, used chunks, and whether another ingest is still allowed that day."""
    used = F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long")
    return docs.groupBy(F.to_date(F.date_trunc("day", "created_at")).alias("day")).agg(used.alias("used")).withColumn("allowed", F.col("used") < budget)


def rate_windows(requests: DataFrame, key: str, limit: int, seconds: int = DEFAULTS.rate_seconds) -> DataFrame:
    """Requests (key, request_id, at in seconds) with their window's start, their number in it, and ``allowed``.

    A window begins at the first request after the last one ended. Keys are independent groups; a hot key is
    first reduced to seconds (one row for each), and only those are folded.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        start, out = None, []
        for at in pdf["at"]:
            if start is None or at >= start + seconds:
                start = at
            out.append(start)
        return pdf[[key, "at"]].assign(window_start=pd.Series(out, index=pdf.index, dtype="int64"))

    kind = requests.schema[key].dataType.simpleString()
    starts = requests.select(key, "at").distinct().groupBy(key).applyInPandas(fold, f"{key} {kind}, at long, window_start long")
    rows = requests.join(starts, [key, "at"])
    number = F.row_number().over(W.partitionBy(key, "window_start").orderBy("at", "request_id"))
    return rows.withColumn("n_in_window", number).withColumn("allowed", F.col("n_in_window") <= limit)
