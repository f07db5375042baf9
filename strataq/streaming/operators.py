"""Structured Streaming forms of the corpus' event flows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strataq.config import DEFAULTS

from strataq.operators.dml import insert_ignore
from strataq.tables import shared_folder

#: The state store that stateful processors need: on local disk, with its changes in the checkpoint.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Parts of a stream's state for each core: each micro-batch opens and commits them all, however few rows came, and each takes some MB of disk.
PARTS_A_CORE = 1
#: Requests of a key that come back from Python as one row.
MOST_TOLD = 10_000


def events_stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files below ``path``, in the order in which they were written; ``files`` of them in a micro-batch."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def request_rates(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Requests and their mean value by tumbling window and kind; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen within the watermark's reach."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class RateWindow(StatefulProcessor):
    """Numbers the requests of a key within its window, which begins with the first request after the last one ended.

    The state of a key is its window's start and count, and a timer at the window's end takes it away; a key that asks no more
    leaves nothing behind. Rows of a micro-batch are taken in order of their time; one that comes in a later micro-batch than younger
    ones counts in the window that is open by then, as it does for whoever keeps the door.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.window.get()  # each call is a round trip to the JVM
        before, n = held if held else (None, 0)
        start, told = before, []
        for at, request_id in sorted((r.at, r.request_id) for r in rows):
            if start is None or at >= start + self.seconds:
                start, n = at, 0
            n += 1
            told.append((request_id, start, n))
            if len(told) == MOST_TOLD:
                yield self.row(key, told)
                told = []
        if told:
            yield self.row(key, told)
        self.window.update((start, n))
        if before != start:
            if before is not None:
                self.handle.deleteTimer((before + self.seconds) * 1000)
            self.handle.registerTimer((start + self.seconds) * 1000)

    def row(self, key: tuple, told: list[tuple]) -> Row:
        """Requests of a key as one row of lists, as each row that Python makes costs more than what it holds."""
        request_ids, starts, ns = zip(*told, strict=True)
        return Row(key=key[0], request_id=list(request_ids), window_start=list(starts), n_in_window=list(ns))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, limit: int, seconds: int = DEFAULTS.rate_seconds, late: str = "0 seconds") -> DataFrame:
    """The rate limit of :func:`strataq.operators.ingest.rate_windows` as a stream: requests (key, request_id, ts), append mode.

    The state is gone when the watermark has passed a window's end. The session has to have :data:`STATE_STORE`, see :func:`run_once`.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, "request_id")}
    rows = requests.withWatermark("ts", late).select(F.col(key).alias("key"), "request_id", "ts", F.unix_timestamp("ts").alias("at"))
    out = f"key {kinds[key]}, request_id array<{kinds['request_id']}>, window_start array<long>, n_in_window array<int>"
    told = rows.groupBy("key").transformWithState(RateWindow(seconds), out, "Append", "EventTime")
    each = told.select(F.col("key").alias(key), F.inline(F.arrays_zip("request_id", "window_start", "n_in_window")))
    return each.withColumn("allowed", F.col("n_in_window") <= limit)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch into a folder of its own, so that one that is run again replaces what it wrote."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def ingest(arriving: DataFrame, path: str, name: str) -> None:
    """Appends arriving documents (checksum, document_id, ...) whose checksum isn't stored at ``path`` yet, batch by batch.

    Of equal ones in a batch the smallest document_id stays. A batch that is run again finds its own rows stored.
    """

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("checksum").agg(F.min_by(F.struct(*batch.columns), "document_id").alias("row")).select("row.*")
        spark.createDataFrame([], batch.schema).write.mode("append").parquet(path)  # so that there is a table to look into
        known = spark.read.schema(batch.schema).parquet(path)
        insert_ignore(known, first, "checksum").write.mode("append").parquet(path)

    run_once(arriving, store, name)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, mode: str = "append", close: bool = True) -> list[dict]:
    """Processes what is there in micro-batches and stops; restarts go on from the checkpoint. Returns each micro-batch's progress.

    With ``close`` a last micro-batch without rows gives what the last rows' watermark closes; else the next run's first one gives it.
    """
    spark = stream.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_A_CORE * spark.sparkContext.defaultParallelism)
    own = dict((STATE_STORE, ("spark.sql.shuffle.partitions", str(parts)), ("spark.sql.streaming.noDataMicroBatches.enabled", str(close).lower())))
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{shared_folder(spark)}/stream-{name}").trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return [dict(p) for p in query.recentProgress]
