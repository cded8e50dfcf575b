"""Streaming legs: new transcript files, and sessions that close after a gap that depends on their last record."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.turns import changed_files
from ..sources.jsonl import discover, parsed, read_lines, with_order
from ..sources.scratch import written


def ingest_stream(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of new files under root. Files that grew are not read again by a file stream; a batch leg finds
    them by size and time (operators.turns.changed_files)."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return lines.select("value", "_metadata")


def start_ingest(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "900 seconds"):
    """Starts the stream: `batch` gets the parsed records of each micro-batch and its number. Without an interval
    it takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(lambda lines, number: batch(parsed(with_order(lines)), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def ingest_file(spark: SparkSession, path: str) -> DataFrame:
    """The records of one named file, as when its session has just ended: no gate, no wait."""
    return parsed(read_lines(spark, path))


def ingest_changed(spark: SparkSession, roots: dict[str, list[str]], ledger: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The batch leg for files that a file stream has seen and that grew since. ledger: path, fingerprint, status, min_user_chars. The oldest `limit` files
    that are new or changed (with verdict and fingerprint), and their records. At most `limit` paths reach the driver."""
    todo = changed_files(discover(spark, roots), ledger).filter("verdict <> 'unchanged'")
    taken = written(todo.orderBy("mtime", "path").limit(limit))
    paths = [r["path"] for r in taken.select("path").collect()]
    records = parsed(read_lines(spark, *paths)) if paths else spark.createDataFrame([], "path string, line_ord struct<block:bigint,line:bigint>, v variant")
    return taken, records


class Closer(StatefulProcessor):
    """Per session the time of its last record and whether that leaves a turn running; a timer closes it."""

    def __init__(self, quiet_ms: int, busy_ms: int):
        self.quiet_ms, self.busy_ms = quiet_ms, busy_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, busy boolean, records long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get() if self.last.exists() else None
        at, busy, records, timer = tuple(held) if held else (-1, False, 0, -1)
        for part in rows:
            for ms, b in zip(part["ms"], part["busy"], strict=True):
                records += 1
                if ms >= at:
                    at, busy = int(ms), bool(b)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        due = at + (self.busy_ms if busy else self.quiet_ms)
        self.handle.registerTimer(due)
        self.last.update((at, busy, records, due))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, busy, records, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"session_id": [str(key[0])], "at_ms": [at], "busy": [busy], "records": [records]})

    def close(self) -> None:
        pass


def close_sessions_stream(records: DataFrame, quiet_ms: int = 120_000, busy_ms: int = 21_600_000) -> DataFrame:
    """records: session_id, ts, busy, with a watermark on ts. A row for each closed session, in event time. Needs
    the RocksDB state store provider."""
    keyed = records.select("session_id", "ts", F.unix_millis("ts").alias("ms"), "busy")
    return keyed.groupBy("session_id").transformWithStateInPandas(Closer(quiet_ms, busy_ms), "session_id string, at_ms long, busy boolean, records long", "Append", "EventTime")


class ClockCloser(StatefulProcessor):
    """Per session when it last spoke, whether its last deciding record leaves a turn running, and the timer that this sets. Timers run on the clock, so a stream that gets
    no further record closes its sessions all the same."""

    def __init__(self, quiet_ms: int, busy_ms: int):
        self.quiet_ms, self.busy_ms = quiet_ms, busy_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, busy boolean, place string, records long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get() if self.last.exists() else None
        at, busy, place, records, timer = tuple(held) if held else (-1, False, "", 0, -1)
        for part in rows:
            for ms, b, p in zip(part["ms"], part["busy"], part["place"], strict=True):
                records += 1
                if not pd.isna(ms):
                    at = max(at, int(ms))
                if b is not None and not pd.isna(b) and p >= place:
                    busy, place = bool(b), p
        if timer >= 0:
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        due = max(now + 1, at + (self.busy_ms if busy else self.quiet_ms))
        self.handle.registerTimer(due)
        self.last.update((at, busy, place, records, due))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, busy, _, records, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"session_id": [str(key[0])], "at_ms": [at], "busy": [busy], "records": [records]})

    def close(self) -> None:
        pass


def close_sessions_by_clock(marks: DataFrame, quiet_ms: int = 120_000, busy_ms: int = 21_600_000) -> DataFrame:
    """marks: path, line_ord, at, busy, a stream of sources.activity.marks. A row for each session that has been silent for as long as its last deciding record allows. Needs
    the RocksDB state store provider."""
    place = F.concat_ws(":", F.lpad(F.col("line_ord.block").cast("string"), 20, "0"), F.lpad(F.col("line_ord.line").cast("string"), 20, "0"))
    keyed = marks.select(F.col("path").alias("session_id"), F.unix_millis("at").alias("ms"), "busy", place.alias("place"))
    return keyed.groupBy("session_id").transformWithStateInPandas(ClockCloser(quiet_ms, busy_ms), "session_id string, at_ms long, busy boolean, records long", "Append", "ProcessingTime")
