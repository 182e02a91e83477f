"""Streams with timers and expiring state: files that go stale without a further row, and lookups that age.

Both need the RocksDB state store (`STORE`), whose state, timers and times to live survive a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dossier.streaming.events import FILE_STATE

#: The session setting that these streams need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

HELD = "status string, attempts int, started_at timestamp, completed_at timestamp, duration_seconds double, error string"
LOOKED_UP = "key string, asked string, record string, at timestamp"


class FileStates(StatefulProcessor):
    """The state of a file after its log rows; a timer fails one that stays in PROCESSING for stale_ms."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", HELD)

    def _row(self, key: tuple, held: list) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *held]], columns=["file_path", "status", "attempts", "started_at", "completed_at", "duration_seconds", "error"]).astype({"attempts": "int32", "duration_seconds": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.state.get()) if self.state.exists() else [None, 0, None, None, None, None]
        log = pd.concat(list(rows))
        log = log.assign(final=log["status"] != "PROCESSING").sort_values(["at", "final"])
        for r in log.itertuples():
            held[0], held[5] = r.status, r.error if isinstance(r.error, str) else None
            if r.status == "PROCESSING":
                held[1:5] = [held[1] + 1, r.at.to_pydatetime(), None, None]
            else:
                held[3] = r.at.to_pydatetime()
                held[4] = round((held[3] - held[2].replace(tzinfo=None)).total_seconds(), 1) if held[2] else None
        self.state.update(tuple(held))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held[0] == "PROCESSING":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        yield self._row(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.state.get()) if self.state.exists() else None
        if held and held[0] == "PROCESSING":
            held[0], held[5] = "FAILED", "stale"
            self.state.update(tuple(held))
            yield self._row(key, held)

    def close(self) -> None:
        """Nothing is open."""


def file_states(log: DataFrame, stale_ms: int = 30 * 60 * 1000) -> DataFrame:
    """FILE_STATE of each file whenever its log (file_path, status, at, error) gains a row, and once it has gone stale.

    A failed file keeps its attempts, so a later PROCESSING row counts on.
    """
    return log.groupBy("file_path").transformWithStateInPandas(FileStates(stale_ms), outputStructType=FILE_STATE, outputMode="Update", timeMode="ProcessingTime")


class Lookups(StatefulProcessor):
    """The last record of a key, for ttl_ms after it was written."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "record string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "asked"], na_position="first")
        out = []
        for r in batch.itertuples():
            if isinstance(r.asked, str):
                out.append([key[0], r.asked, self.record.get()[0] if self.record.exists() else None, r.at])
            elif isinstance(r.record, str):
                self.record.update((r.record,))
            else:
                self.record.clear()
        yield pd.DataFrame(out, columns=["key", "asked", "record", "at"])

    def close(self) -> None:
        """Nothing is open."""


def looked_up(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """LOOKED_UP rows with the record of their key, null where it has none or its record is older than ttl_ms.

    rows: LOOKED_UP. One with `asked` asks; one without writes its record, or with a null record removes the key's. In a batch
    a key's rows go by time, writes before questions of the same time.
    """
    return rows.groupBy("key").transformWithStateInPandas(Lookups(ttl_ms), outputStructType=LOOKED_UP, outputMode="Update", timeMode="ProcessingTime")
