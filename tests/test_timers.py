"""Timers and expiring state of streams, across restarts."""

import datetime as dt
import time

import pytest

from dossier.streaming import timers

LOG = "file_path string, status string, at timestamp, error string"
T0 = dt.datetime(2024, 5, 1)


@pytest.fixture
def stored(spark):
    held = {k: spark.conf.get(k) for k in timers.STORE}
    for k, v in timers.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


class Stream:
    """Appends rows to a folder that a query reads, and keeps what it gives."""

    def __init__(self, spark, tmp_path, schema, work, every="1 second"):
        self.spark, self.schema, self.work, self.every = spark, schema, work, every
        self.source, self.state, self.out = (str(tmp_path / x) for x in ("in", "state", "out"))
        self.put([])

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def start(self):
        frame = self.work(self.spark.readStream.schema(self.schema).parquet(self.source))
        keep = lambda batch, _: batch.write.mode("append").parquet(self.out)
        self.query = frame.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", self.state).trigger(processingTime=self.every).start()

    def rows(self):
        try:
            return self.spark.read.parquet(self.out).collect()
        except Exception:
            return []

    def until(self, found, seconds=90):
        end = time.time() + seconds
        while time.time() < end and self.query.exception() is None:
            if found(rows := self.rows()):
                return rows
            time.sleep(0.5)
        raise AssertionError((self.query.exception(), self.rows()))


def test_stale_files_fail_by_the_timer(spark, stored, tmp_path):
    """No further row comes: the timer alone fails the file, also one that was registered before a restart."""
    s = Stream(spark, tmp_path, LOG, lambda log: timers.file_states(log, 4000))
    s.start()
    s.put([("a", "PROCESSING", T0, None), ("b", "PROCESSING", T0, None), ("b", "COMPLETED", T0 + dt.timedelta(seconds=12), None)])
    s.until(lambda rows: {r.file_path for r in rows} == {"a", "b"})
    s.query.stop()
    s.start()
    rows = s.until(lambda rows: any(r.status == "FAILED" for r in rows))
    (failed,) = [r for r in rows if r.status == "FAILED"]
    assert (failed.file_path, failed.error, failed.attempts) == ("a", "stale", 1)
    assert [(r.attempts, r.duration_seconds) for r in rows if r.status == "COMPLETED"] == [(1, 12.0)]
    s.put([("a", "PROCESSING", T0 + dt.timedelta(hours=1), None), ("a", "COMPLETED", T0 + dt.timedelta(hours=1, seconds=3), None)])
    rows = s.until(lambda rows: any(r.file_path == "a" and r.status == "COMPLETED" for r in rows))
    s.query.stop()
    assert [(r.attempts, r.duration_seconds, r.error) for r in rows if r.file_path == "a" and r.status == "COMPLETED"] == [(2, 3.0, None)]


def test_records_expire(spark, stored, tmp_path):
    s = Stream(spark, tmp_path, timers.LOOKED_UP, lambda rows: timers.looked_up(rows, 6000))
    s.start()
    s.put([("k", None, "first", T0), ("k", "q1", None, T0), ("k", None, "second", T0 + dt.timedelta(seconds=1)), ("none", "q2", None, T0)])
    rows = s.until(lambda rows: len(rows) >= 2)
    assert {(r.key, r.asked, r.record) for r in rows} == {("k", "q1", "first"), ("none", "q2", None)}
    s.put([("k", "q3", None, T0)])
    s.until(lambda rows: any(r.asked == "q3" for r in rows))
    time.sleep(8)
    s.put([("k", "q4", None, T0)])
    rows = {r.asked: r.record for r in s.until(lambda rows: any(r.asked == "q4" for r in rows))}
    s.query.stop()
    assert rows["q3"] in ("second", None) and rows["q4"] is None
