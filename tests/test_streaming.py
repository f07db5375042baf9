"""Streams over events in many files give what the same work gives in batch, keep no state for ever, and go on after a restart."""

import datetime as dt
import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F

from strataq.operators import ingest
from strataq.plans import catalog
from strataq.streaming import operators as streams
from strataq.tables import table

START = dt.datetime(2024, 1, 1)


def test_windowed_rates_stream_like_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = streams.request_rates(streams.events_stream(spark, str(tmp_path / "in"), events))
    streams.run_once(stream, lambda batch, _: batch.write.mode("append").parquet(out), f"rates-{uuid.uuid4().hex}")
    end = events.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    closed = streams.request_rates(events).where(F.col("start") + F.expr("interval 1 hour") <= F.lit(end))
    got = spark.read.parquet(out)
    assert got.count() > 0 and got.exceptAll(streams.request_rates(events)).count() == 0
    assert closed.exceptAll(got).count() == 0


def arrive(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, schema, make, name, out):
    """One micro-batch for each file; the rows that came out so far, and the progress."""
    stream = make(streams.events_stream(spark, path, spark.createDataFrame([], schema), 1))
    progress = streams.run_once(stream, streams.by_batch(out), name)
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*").drop("batch").collect()), progress


def test_late_rows_and_closed_windows(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    schema = "ts timestamp, event_type string, value double, user_id long"
    batches = [
        [(at(0), "a", 1.0, 1), (at(50), "a", 3.0, 1), (at(55), "b", 5.0, 2)],
        [(at(130), "a", 7.0, 1)],  # the watermark goes to 120 minutes, which closes the first hours
        [(at(130), "z", 0.0, 9)],  # by the next micro-batch rows of theirs are late
        [(at(58), "a", 100.0, 1), (at(119), "a", 100.0, 1), (at(125), "a", 9.0, 2)],  # hours that are closed; one that isn't
        [(at(400), "b", 2.0, 3)],
    ]
    arrive(spark, str(tmp_path / "in"), batches, schema)
    got, progress = run(spark, str(tmp_path / "in"), schema, streams.request_rates, f"late-{uuid.uuid4().hex}", str(tmp_path / "rates"))
    assert got == [(at(0), "a", 2, 2.0), (at(0), "b", 1, 5.0), (at(120), "a", 2, 8.0), (at(120), "z", 1, 0.0)]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 2
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the hour that is open yet
    got, progress = run(spark, str(tmp_path / "in"), schema, streams.sessions, f"gaps-{uuid.uuid4().hex}", str(tmp_path / "sessions"))
    # late rows whose session would have ended before the watermark are left out: that of 58 minutes
    assert got == [(1, at(0), at(30), 1), (1, at(50), at(80), 1), (1, at(119), at(160), 2), (2, at(55), at(85), 1), (2, at(125), at(155), 1), (9, at(130), at(160), 1)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def limited(requests):
    return streams.limited(requests, "ip", 3, 60)


def test_rate_limit_keeps_its_state_between_batches(spark, tmp_path):
    second = lambda s: START + dt.timedelta(seconds=s)
    schema = "ip string, request_id long, ts timestamp"
    times = {"x": [0, 10, 20, 30, 59, 60, 61, 200, 201, 202, 203, 204], "y": [5, 64, 65, 66, 67, 68, 69, 130], "z": [205]}
    rows = sorted((second(s), ip, k) for ip, own in times.items() for k, s in enumerate(own))
    cut = [rows[k : k + 4] for k in range(0, len(rows), 4)]
    arrive(spark, str(tmp_path / "in"), [[(ip, k, ts) for ts, ip, k in part] for part in cut[:3]], schema)
    name = f"limit-{uuid.uuid4().hex}"
    some, _ = run(spark, str(tmp_path / "in"), schema, limited, name, str(tmp_path / "out"))
    assert len(some) == 12
    arrive(spark, str(tmp_path / "in"), [[(ip, k, ts) for ts, ip, k in part] for part in cut[3:]], schema)  # a restart goes on
    got, progress = run(spark, str(tmp_path / "in"), schema, limited, name, str(tmp_path / "out"))
    requests = spark.createDataFrame([(ip, k, int(ts.timestamp())) for ts, ip, k in rows], "ip string, request_id long, at long")
    want = ingest.rate_windows(requests, "ip", 3, 60).select("ip", "request_id", "window_start", "n_in_window", "allowed")
    assert got == sorted(tuple(r) for r in want.collect())
    assert sum(not r[-1] for r in got) == 6
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 10
    # a minute after the last request of the others only the newest key has state
    arrive(spark, str(tmp_path / "in"), [[("new", 0, second(1000))], [("new", 1, second(1001))]], schema)
    run(spark, str(tmp_path / "in"), schema, limited, name, str(tmp_path / "out"))
    from strataq.tables import shared_folder

    state = spark.read.format("statestore").option("path", f"{shared_folder(spark)}/stream-{name}").option("stateVarName", "window").load()
    assert [r.key[0] for r in state.select("key").collect()] == ["new"]


def test_rates_and_limits_of_events_of_several_months(spark, tmp_path):
    """Every hour is told, the last ones too; events that arrive by their time are never late, whatever their day of the month."""
    rows = [(k, dt.datetime(2024, 1 + k % 3, 1 + k % 28, k % 24, k % 60), k % 5, "view", float(k), "{}") for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    events = spark.read.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["request_rates"](spark, str(tmp_path))
    want = events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    assert catalog.QUERIES["stream_rate_limit"](spark, str(tmp_path)).count() == 300


def test_state_parts_follow_the_cores_and_only_the_last_part_is_closed_by_itself(spark, tmp_path, monkeypatch):
    rows = [(k, START + dt.timedelta(hours=k), k % 5, "view", 1.0, "{}") for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    runs, run_once, key = [], streams.run_once, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(streams, "run_once", lambda *a, **k: runs.append(run_once(*a, **k)) or runs[-1])
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        got = catalog.QUERIES["event_sessions"](spark, str(tmp_path))
        assert spark.conf.get(key) == "40"
    finally:
        spark.conf.set(key, before)
    # 5 users, each with one event every 5 hours: one session each, which the watermark doesn't close but for gaps of 6 hours
    assert got.count() == 0 and [len(r) for r in runs] == [1] * 5 + [2]
    parts = {s["numShufflePartitions"] for r in runs for p in r for s in p["stateOperators"]}
    assert parts == {streams.PARTS_A_CORE * spark.sparkContext.defaultParallelism}


def test_requests_of_a_key_leave_python_in_lists(monkeypatch):
    class Held:
        def get(self):
            return (100, 1)

        def update(self, value):
            self.value = value

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), []

        def getValueState(self, *_):
            return self.held

        def deleteTimer(self, at):
            self.timers.append(("gone", at))

        def registerTimer(self, at):
            self.timers.append(("set", at))

    monkeypatch.setattr(streams, "MOST_TOLD", 4)
    window, handle = streams.RateWindow(60), Handle()
    window.init(handle)
    rows = [Row(key="x", request_id=k, at=at) for k, at in enumerate([160, 110, 159, 161, 219, 220])]
    got = list(window.handleInputRows(("x",), iter(rows), None))
    assert [(r.key, r.request_id, r.window_start, r.n_in_window) for r in got] == [("x", [1, 2, 0, 3], [100, 100, 160, 160], [2, 3, 1, 2]), ("x", [4, 5], [160, 220], [3, 1])]
    assert handle.held.value == (220, 1) and handle.timers == [("gone", 160_000), ("set", 280_000)]
