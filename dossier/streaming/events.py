"""Streams of events: windows with watermarks, sessions, last-write-wins state, and idempotent batches.

Late rows are those behind the watermark; they are dropped. On the same rows, all in time, each query gives what its batch
form gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window start and end, by, n: tumbling windows, or sliding ones."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(F.col(at), length, slide) if slide else F.window(F.col(at), length)
    return timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, at: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(F.col(at), gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def distinct_files(files: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files by content: each hash passes once, also over restarts of the stream."""
    return files.dropDuplicates([key])


#: status, attempts, seconds of a file from its log of events (file_path, status, at, error)
FILE_STATE = "file_path string, status string, attempts int, started_at timestamp, completed_at timestamp, duration_seconds double, error string"


def fold_files(log: DataFrame) -> DataFrame:
    """The state of each file after all its log rows, in batch: attempts count PROCESSING rows."""
    started = F.max(F.when(F.col("status") == "PROCESSING", F.col("at")))
    ended = F.max(F.when(F.col("status") != "PROCESSING", F.col("at")))
    last = F.max_by(F.struct("status", "error"), F.struct("at", F.col("status") != "PROCESSING"))
    state = log.groupBy("file_path").agg(last.alias("last"), F.count_if(F.col("status") == "PROCESSING").cast("int").alias("attempts"), started.alias("started_at"), ended.alias("_ended"))
    completed = F.when(F.col("last.status") != "PROCESSING", F.col("_ended"))
    seconds = F.round((F.unix_micros(completed) - F.unix_micros("started_at")) / 1e6, 1)
    return state.select("file_path", F.col("last.status").alias("status"), "attempts", "started_at", completed.alias("completed_at"), seconds.alias("duration_seconds"), F.col("last.error").alias("error"))


def file_states(log: DataFrame, stale_ms: int = 30 * 60 * 1000) -> DataFrame:
    """The state of each file whenever it changes; PROCESSING without a further row for stale_ms becomes FAILED."""
    names = ("status", "attempts", "started_at", "completed_at", "duration_seconds", "error")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, 0, None, None, None, None]
        if state.hasTimedOut:
            if held[0] == "PROCESSING":
                held[0], held[5] = "FAILED", "stale"
            state.remove()
        else:
            rows = pd.concat(list(batches))
            rows = rows.assign(final=rows["status"] != "PROCESSING").sort_values(["at", "final"])
            for r in rows.itertuples():
                held[0], held[5] = r.status, r.error
                if r.status == "PROCESSING":
                    held[1:5] = [held[1] + 1, r.at.to_pydatetime(), None, None]
                else:
                    held[3] = r.at.to_pydatetime()
                    held[4] = round((held[3] - held[2]).total_seconds(), 1) if held[2] else None
            state.update(tuple(held))
            if held[0] == "PROCESSING":
                state.setTimeoutDuration(stale_ms)
        yield pd.DataFrame([[key[0], *held]], columns=["file_path", *names])

    held = "status string, attempts int, started_at timestamp, completed_at timestamp, duration_seconds double, error string"
    return log.groupBy("file_path").applyInPandasWithState(step, FILE_STATE, held, "update", GroupStateTimeout.ProcessingTimeTimeout)


def trail(steps: DataFrame, key: str, slot: str, step: str, at: str, record: str) -> DataFrame:
    """Per key a map of slot to map of step to its last record."""
    last = steps.groupBy(key, slot, step).agg(F.max_by(record, at).alias("record"))
    slots = last.groupBy(key, slot).agg(F.map_from_entries(F.collect_list(F.struct(step, "record"))).alias("steps"))
    return slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(slot, "steps"))).alias("trail"))


def append_new(existing: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes rows whose key the target lacks: a repeated batch adds nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch.dropDuplicates([key]).join(existing().select(key), key, "left_anti"))

    return run


class Refreshed:
    """A frame that is loaded again when its table's fingerprint (rows and last change) differs."""

    def __init__(self, load: Callable[[], DataFrame], changed: str):
        self.load, self.changed, self.seen, self.frame = load, changed, None, None

    def get(self) -> DataFrame:
        table = self.load()
        mark = tuple(table.agg(F.count("*"), F.max(self.changed)).first())
        if self.frame is None or mark != self.seen:
            if self.frame is not None:
                self.frame.unpersist()
            self.seen, self.frame = mark, table.persist()
        return self.frame
