"""Batches under a deadline: a stream of what happens to batches, with a timer for each that may never end.

Each batch is a key with its own state: the requests it still owes, and whether it is closed. A timer is set when its first
request is submitted. Whatever comes first, the end of the batch or the timer, closes it, and what it still owes fails; a
result that comes later is ignored. State and timers are in the stream's checkpoint, so a restart goes on with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorate.config import EngineConfig

#: kind: `submitted` (a request of a batch), `result` (of a request), `ended` or `failed` (the batch).
EVENT = "batch_id string, kind string, custom_id string, status string, note int"
OUTCOME = "batch_id string, custom_id string, status string, note int, reason string"
#: How Spark must keep the state that has timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Batches(StatefulProcessor):
    def __init__(self, timeout_s: float) -> None:
        self.timeout_ms = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value a batch, read and written once a trigger: what it owes is at most what one call to the rater takes.
        self.life = handle.getValueState("life", "deadline long, closed boolean, owed array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (batch,) = key
        deadline, closed, owed = self.life.get() if self.life.exists() else (None, False, [])
        owed, out = dict.fromkeys(owed), []
        events = pd.concat(list(rows))
        # Within one trigger a batch is asked for before it answers, and answers before it ends.
        events = events.iloc[events["kind"].map({"submitted": 0, "result": 1}).fillna(2).argsort(kind="stable")]
        for kind, request, status, note in zip(events["kind"], events["custom_id"], events["status"], events["note"], strict=True):
            if closed:
                break
            if kind == "submitted":
                if deadline is None:
                    deadline = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
                    self.handle.registerTimer(deadline)
                owed[request] = None
            elif kind != "result":
                out += [(batch, i, "failed", None, kind) for i in owed]
                closed, owed = True, {}
            elif request in owed:
                del owed[request]
                out.append((batch, request, status, None if pd.isna(note) else int(note), "result"))
        self.life.update((deadline, closed, list(owed)))
        if closed and deadline is not None:
            self.handle.deleteTimer(deadline)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (batch,) = key
        deadline, closed, owed = self.life.get()
        self.life.update((deadline, True, []))
        if owed:
            yield self._frame([(batch, i, "failed", None, "deadline") for i in owed])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["batch_id", "custom_id", "status", "note", "reason"])
        return out.astype({"note": "Int32"})

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, timeout_s: float) -> DataFrame:
    """events (a stream of EVENT rows) -> OUTCOME rows: each request once, with its result, or failed when its batch ends,
    fails or passes timeout_s. Set STORE in the session before the query starts."""
    grouped = events.groupBy("batch_id")
    return grouped.transformWithStateInPandas(statefulProcessor=Batches(timeout_s), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime")


def watch(events: DataFrame, log: str, checkpoint: str, config: EngineConfig, once: bool = False) -> StreamingQuery:
    """Starts a stream that appends outcomes to the log (Parquet), looking every config.poll_s seconds and failing what takes
    longer than config.timeout_s; `once`: takes what there is, and ends. Started again with the same checkpoint, it goes on
    where it was."""
    events.sparkSession.conf.set(*STORE)
    out = outcomes(events, config.timeout_s).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
    # A query with timers of processing time never runs out of batches, so `once` is one batch.
    how = {"once": True} if once else {"processingTime": f"{config.poll_s} seconds"}
    return out.outputMode("append").trigger(**how).start()
