"""Alarms that a stream raises by itself, and a record of what its state drops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sitegauge.session import with_package
from sitegauge.streaming.progress import STALL_POLLS

#: State with timers needs this store; it is a setting of the session.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("silent", T.BooleanType())])
ALARMS = "last_progress timestamp, n long, idle_seconds long, state string"


class Silence(StatefulProcessor):
    """Per source: when rows came last, how many so far, and whether the alarm was raised.

    Every batch with rows of a source puts its timer off. A timer that runs out raises the alarm once; the next row of
    the source takes it back.
    """

    def __init__(self, keys: tuple[str, ...], limit_ms: int) -> None:
        self.keys, self.limit_ms = keys, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", _STATE)

    def _row(self, key: tuple, at: int, n: int, now: int, state: str) -> pd.DataFrame:
        return pd.DataFrame(
            {k: [v] for k, v in zip(self.keys, key, strict=True)}
            | {"last_progress": [pd.Timestamp(at, unit="ms")], "n": [n], "idle_seconds": [(now - at) // 1000], "state": [state]}
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        came = sum(len(part) for part in rows)
        at, n, silent = self.state.get() if self.state.exists() else (now, 0, False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.limit_ms)
        self.state.update((now, n + came, False))
        if silent:
            yield self._row(key, at, n + came, now, "resumed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        at, n, silent = self.state.get()
        if not silent:
            self.state.update((at, n, True))
            yield self._row(key, at, n, now, "silent")

    def close(self) -> None:
        pass


def silence_alarm(stream: DataFrame, keys: tuple[str, ...], polls: int = STALL_POLLS, poll_seconds: float = 60.0) -> DataFrame:
    """A row when a source has sent nothing for ``polls`` polls, and one when it is back.

    (keys, last_progress, n, idle_seconds, state): `state` is ``silent`` or ``resumed``; `n` counts the rows of the source
    so far. The clock is the cluster's: the stream goes on with empty batches, so no outside job is needed and the
    watermark plays no part. Only the keys of the rows are read and moved, and the state is one short row for each source.
    Set ``spark.sql.streaming.stateStore.providerClass`` to STATE_STORE.
    """
    fields = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    narrow = with_package(stream).select(*keys)
    return narrow.groupBy(*keys).transformWithStateInPandas(
        Silence(keys, int(polls * poll_seconds * 1000)), f"{fields}, {ALARMS}", "Update", "ProcessingTime"
    )


_DROPPED = "query string, batch long, operator string, at string, input_rows long, dropped_by_watermark long, state_rows long, state_bytes long"


class StateRecord(StreamingQueryListener):
    """What the state of each query holds, and what its watermark drops, as a table.

    ``spark.streams.addListener(record)`` starts it. A batch gives a row for each stateful operator. Rows are appended to
    ``out`` (a folder in any store) after ``every`` of them and at the end of a query, so at most that many are held here.
    """

    def __init__(self, spark: SparkSession, out: str, every: int = 100) -> None:
        self.spark, self.out, self.every = spark, out, every
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for s in p.stateOperators:
            self.rows.append((
                p.name or str(p.id), p.batchId, s.operatorName, p.timestamp, p.numInputRows, s.numRowsDroppedByWatermark, s.numRowsTotal, s.memoryUsedBytes,
            ))
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        held, self.rows = self.rows, []
        if held:
            self.spark.createDataFrame(held, _DROPPED).coalesce(1).write.mode("append").parquet(self.out)


def dropped_rows(record: DataFrame) -> DataFrame:
    """(query, operator, batches, dropped, state_rows, state_bytes) of a table of :class:`StateRecord`: totals, and the last state."""
    return record.groupBy("query", "operator").agg(
        F.count("*").alias("batches"), F.sum("dropped_by_watermark").alias("dropped"),
        F.max_by("state_rows", "batch").alias("state_rows"), F.max_by("state_bytes", "batch").alias("state_bytes"),
    )
