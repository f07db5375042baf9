"""Changes to tables of immutable files: events and latest-wins views in place of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.col(order)).alias("row")).select("row.*")


def upsert(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """All of ``arriving``, and of ``stored`` what has another key."""
    return stored.join(arriving.select(key), key, "left_anti").select(*stored.columns).unionByName(arriving)


def insert_ignore(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """The rows of ``arriving`` that are to be appended: those whose key isn't stored."""
    return arriving.join(stored.select(key), key, "left_anti").select(*arriving.columns)


def save_conversations(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """arriving (id, owner_id, …) with ``action``: update of the owner's own row, else insert as a new one."""
    own = stored.select("id", F.col("owner_id").alias("stored_owner"))
    return arriving.join(own, "id", "left").withColumn("action", F.when(F.col("stored_owner") == F.col("owner_id"), "update").otherwise("insert")).drop("stored_owner")


def delete_owned(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """What remains after deleting the rows named by (id, owner_id); others' rows stay, silently."""
    return stored.join(asked, ["id", "owner_id"], "left_anti").select(*stored.columns)


def hit_counts(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers (id) with the number of hit events."""
    return answers.join(hits.groupBy("id").agg(F.count("*").alias("hits")), "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def query_log(rows: DataFrame, keep_text: bool, texts: tuple[str, ...] = ("query", "answer")) -> DataFrame:
    """Log rows; their texts are blank unless keeping them was agreed to."""
    return rows if keep_text else rows.withColumns({c: F.lit("") for c in texts})


def merge_metadata(metadata: Column, change: Column) -> Column:
    """A map with the entries of another one laid over it."""
    kept = F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(change), k))
    return F.map_concat(kept, change)


def supersede(docs: DataFrame) -> DataFrame:
    """superseded_by of each document: the successor that is ready, so nothing is retired before it can be replaced."""
    ready = docs.where("status = 'ready' and supersedes is not null").groupBy(F.col("supersedes").alias("document_id")).agg(F.max("document_id").alias("superseded_by"))
    return docs.join(ready, "document_id", "left")


def copy_table(source: DataFrame, target: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """Rows to append to ``target``; refused if the vectors' widths differ."""
    if vector:
        widths = source.select(F.size(vector).alias("w")).unionByName(target.select(F.size(vector).alias("w"))).where("w >= 0").distinct().limit(3).collect()
        if len(widths) > 1:
            raise ValueError(f"vector widths differ: {sorted(r['w'] for r in widths)}")
    return insert_ignore(target, source, key)


def keep_best(rows: DataFrame, key: str, score: str, arrival: str) -> DataFrame:
    """The row of the highest score of each key; the first one wins ties."""
    order = W.partitionBy(key).orderBy(F.desc_nulls_last(score), arrival)
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
