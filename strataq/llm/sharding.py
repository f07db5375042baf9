"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records over shards and, within a shard, uniformly over buckets of bounded expected size, by seeded
hashes of the whole record's doc_id and text. Pass two brings each bucket together, which fits into memory, permutes it
by seeded random numbers and writes it behind the shard's earlier buckets. Nothing larger than a bucket is ever in one
place, whatever repeats: copies differ in doc_id, rows of one doc_id in text, and rows that are alike in both
are scattered by their numbers if a bucket couldn't hold them.

The permutation sorts a bucket by random numbers in place of Fisher-Yates swaps: it is as uniform, it can spill, and the
numbers are hashes of the records, so it comes out the same however the input is partitioned (Spark's own
``shuffle`` would take its seed from the task's number); only where alike rows were scattered do slots depend on it.

The law is ``key``: doc_id and the shard count decide. A record goes to the shard whose seeded hash with
its doc_id is largest (rendezvous hashing), so one more shard takes records only into itself.

Defined results: null texts count as empty and their crc32 is 0; null doc_ids are hashed as the text
``null``; repeated rows get slots of their own; an empty table gives an empty result; other columns, whatever their
names, go along in :func:`write_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.tables import written

SHARDS = 24
BUCKET_BYTES = 4 << 20
SEED = 20240229
#: Marks of rows that are alike that are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 200_000


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash of (doc_id, shard, seed)."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.greatest(*(F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards)))["s"] if shards > 1 else F.lit(0)


def scatter(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Pass one: shard, bucket and random number of each record; ``record`` holds all its columns."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, round(total / shards / bucket_bytes))
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", F.lit(seed))
    rows = docs.select(F.struct("*").alias("record"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), mark.alias("mark"), size.alias("size"))
    # rows that are alike and don't fit into one bucket: fewer of them than there are buckets in all
    heavy = written(rows.groupBy("mark").agg(F.sum("size").alias("all"), F.count("*").alias("k")).where((F.col("all") > bucket_bytes) & (F.col("k") > 1)).select("mark"), "heavy")
    number = F.lit(0).cast("long")
    if n_heavy := heavy.count():
        alike = heavy.withColumn("alike", F.lit(True))
        rows = rows.join(F.broadcast(alike) if n_heavy <= MOST_BROADCAST else alike, "mark", "left")
        number = F.when(F.col("alike"), F.monotonically_increasing_id()).otherwise(0)
    spread = rows.withColumn("spread", F.xxhash64("mark", number))
    out = spread.select("record", "shard", F.pmod("spread", F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64("spread", F.lit("order")).alias("random"), "size")
    # rows' numbers must be those of one run of the tasks
    return written(out, "scattered") if "alike" in rows.columns else out


def gather(scattered: DataFrame) -> DataFrame:
    """Pass two: each bucket in a random order; ``slot`` is gapless from 0 within a shard.

    A bucket is permuted by one task as a whole, so a task that runs again replaces whole buckets.
    """
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("random")) - 1
    return scattered.withColumn("place", place).join(starts, ["shard", "bucket"]).select("shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "record", "size")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Writes all records, with ``slot``, below ``path/shard=k`` as Parquet."""
    gather(scatter(docs, shards, bucket_bytes, seed)).write.partitionBy("shard").parquet(path)


def assignment(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """The digest of every record: what :func:`write_shards` writes, with a checksum in place of the text."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = gather(scatter(slim, shards, bucket_bytes, seed))
    doc_id = F.col("record.doc_id")
    return rows.select(
        doc_id.alias("doc_id"), F.col("size"), F.crc32(F.col("record.text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", shard_of(doc_id, shards + 1, seed).alias("grown_shard"),
    )
