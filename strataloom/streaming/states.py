"""The way of each document through ingestion, as state of a stream with timers for those that get stuck."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.relational import latest

#: From each status the ones that may follow; a document begins queued, and may be queued anew once it failed.
NEXT = {"queued": ("parsing", "failed"), "parsing": ("ocr", "parsed", "failed"), "ocr": ("parsed", "failed"), "parsed": ("embedding", "failed"), "embedding": ("ready", "failed"), "ready": (), "failed": ("queued",)}
ORDER = {status: k for k, status in enumerate(NEXT)}
RESTING = ("ready", "failed")
OUT = "document long, version int, status string, ts timestamp, reason string, accepted boolean"
STATE = "version int, status string, at long"


def step(now: tuple[int, str] | None, version: int, status: str) -> str | None:
    """Why a report doesn't change a document's state, null if it does, ``repeated`` if it says what is known."""
    if status not in NEXT:
        return "unknown_status"
    if now is None or version > now[0]:
        return None if status == "queued" else "not_queued"
    if version < now[0]:
        return "superseded"
    if status == now[1]:
        return "repeated"
    return None if status in NEXT[now[1]] else "bad_transition"


class _Ingest(StatefulProcessor):
    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", STATE)

    def _timed(self, status: str, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status not in RESTING:
            self.handle.registerTimer(at + self.patience)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        own["_order"] = own["status"].map(ORDER).fillna(len(ORDER))
        own = own.sort_values(["version", "ts", "_order"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        now, at = ((held[0], held[1]), held[2]) if held else (None, 0)
        out, moved = [], False
        for r in own.itertuples():
            why = step(now, int(r.version), r.status)
            if why == "repeated":
                continue
            if why is None:
                now, at, moved = (int(r.version), r.status), int(r.ts.timestamp() * 1000), True
            out.append((int(key[0]), int(r.version), r.status, r.ts, why or r.reason, why is None))
        if moved:
            self.state.update((*now, at))
            self._timed(now[1], at)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, status, at = self.state.get()
        if status in RESTING or at + self.patience > expiredTimerInfo.getExpiryTimeInMs():
            return
        due = at + self.patience
        self.state.update((version, "failed", due))
        yield pd.DataFrame([(int(key[0]), version, "failed", pd.Timestamp(due, unit="ms"), f"stuck_{status}", True)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def ingest_states(reports: DataFrame, patience_seconds: int = 3600, late_seconds: int = 600) -> DataFrame:
    """What becomes of reports (document, version, status, ts, reason) of a stream, one row each but repeated ones.

    A report that the order of the stages allows changes the document's state (``accepted``); others are
    dead letters with the reason: unknown_status, not_queued (of a new version), superseded (by a newer
    version) or bad_transition.  A newer version replaces what is known of the document.  A document that
    rests in no end state and isn't heard of for ``patience_seconds`` of event time fails as stuck, and may
    be queued again.  Reports that come more than ``late_seconds`` late, or lack a document, version or
    time, are left out.  Within a batch reports count in the order of version, time and stage.  State is one
    row a document, kept by RocksDB, which the session's ``spark.sql.streaming.stateStore.providerClass``
    must name.
    """
    rows = reports.where("document is not null and version is not null and ts is not null").select(F.col("document").cast("long").alias("document"), F.col("version").cast("int").alias("version"), "status", F.col("ts").cast("timestamp").alias("ts"), F.col("reason").cast("string").alias("reason"))
    rows = rows.withWatermark("ts", f"{late_seconds} seconds")
    return rows.groupBy("document").transformWithStateInPandas(statefulProcessor=_Ingest(patience_seconds * 1000), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def start(reports: DataFrame, target: str, checkpoint: str, before: Callable[[int], None] = lambda number: None, **limits) -> StreamingQuery:
    """Write ``ingest_states`` to a folder a batch, until nothing new is there; a batch that is run again overwrites its own folder.

    ``before`` is called with the number of each batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        before(number)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = ingest_states(reports, **limits)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(history: DataFrame) -> DataFrame:
    """(document, version, status, ts, reason): the last accepted state of each document of the written history."""
    rows = history.where("accepted").withColumn("_stage", F.coalesce(*(F.when(F.col("status") == s, F.lit(k)) for s, k in ORDER.items())))
    return latest(rows, "document", F.desc("version"), F.desc("batch"), F.desc("ts"), F.desc("_stage")).select("document", "version", "status", "ts", "reason")


def dead_letters(history: DataFrame) -> DataFrame:
    return history.where("not accepted").select("document", "version", "status", "ts", "reason")
