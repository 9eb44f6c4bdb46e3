"""A capture: a stream of events through a pipeline into sinks, that can be started, paused, resumed, stopped and asked how it is."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CaptureError
from ..functions.scalars import lsn_parse
from ..operators.transforms import Pipeline
from .sinks import Delivered, to_callback, to_log, to_parquet
from .state import StateStore


class Capture:
    """events: a streaming frame of change events.  States: idle, streaming, paused, stopped, error."""

    def __init__(self, events: DataFrame, checkpoint: str, pipeline: Pipeline | None = None, store: StateStore | None = None, name: str = "capture", available_now: bool = False, interval: str = "1 second"):
        self.events, self.checkpoint, self.pipeline, self.store, self.name = events, checkpoint, pipeline, store, name
        self.trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        self.sinks: list[Callable[[DataFrame], None]] = []
        self.error_handlers: list[Callable[[Exception], None]] = []
        self.state, self.query, self.started, self.captured = "idle", None, None, 0

    def on_change(self, function) -> "Capture":
        self.sinks.append(to_callback(function))
        return self

    def on_error(self, function) -> "Capture":
        self.error_handlers.append(function)
        return self

    def into(self, path: str) -> "Capture":
        """Appends the events to a Parquet table."""
        self.sinks.append(to_parquet(path))
        return self

    def into_log(self, path: str) -> "Capture":
        """Appends the events to an ordered log, which an EventServer sends on."""
        self.sinks.append(to_log(path))
        return self

    def _deliver(self, batch: DataFrame, number: int = 0) -> None:
        live = self.pipeline.apply(batch) if self.pipeline else batch
        live = live.persist()
        try:
            position = live.agg(F.count("*").alias("n"), F.max_by(F.struct("source.lsn", "source.tx_id", "ts_ms"), place()).alias("last")).first()
            for sink in self.sinks:
                sink(live, number)
            self.captured += position["n"]
            if self.store and position["n"]:
                # after the sinks have taken the batch, never before
                last = position["last"]
                self.store.write_offset(last["lsn"] or "", last["tx_id"] or "", last["ts_ms"] or 0, False, self.name)
        finally:
            live.unpersist()

    def start(self) -> "Capture":
        if self.state == "streaming":
            raise CaptureError("the capture is running already")
        if self.state == "paused":
            raise CaptureError("the capture is paused: resume it")
        self.started = time.time()
        return self._run()

    def _run(self) -> "Capture":
        deliver = Delivered(self.store, self.name, self._deliver)
        self.query = self.events.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).foreachBatch(deliver).trigger(**self.trigger).start()
        self.state = "streaming"
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """Waits for the stream to end; an error goes to the handlers, or is raised if there are none."""
        try:
            return self.query.awaitTermination(seconds) if seconds is not None else self.query.awaitTermination() is None
        except Exception as e:
            self.state = "error"
            if not self.error_handlers:
                raise
            for handle in self.error_handlers:
                handle(e)
            return False

    def pause(self) -> None:
        if self.state != "streaming":
            raise CaptureError(f"a capture that is {self.state} can't be paused")
        self.query.stop()
        self.state = "paused"

    def resume(self) -> "Capture":
        if self.state != "paused":
            raise CaptureError(f"a capture that is {self.state} can't be resumed")
        return self._run()

    def stop(self) -> None:
        """Ends the stream and records where it stood as final."""
        if self.query is not None:
            self.query.stop()
        if self.store and self.state in ("streaming", "paused"):
            last = self.store.last_offset()
            if last is not None:
                self.store.write_offset(last["lsn"], last["tx_id"], last["ts_ms"], True, self.name)
        self.state = "stopped"

    def status(self) -> dict:
        progress = self.query.lastProgress if self.query is not None else None
        last = self.store.last_offset() if self.store else None
        return {
            "state": self.state,
            "events_captured": self.captured,
            "uptime_ms": int((time.time() - self.started) * 1000) if self.started else 0,
            "current_lsn": last["lsn"] if last else "",
            "rows_per_second": progress["processedRowsPerSecond"] if progress else 0.0,
            "status": "down" if self.state == "error" else "ok",
        }


def place() -> Column:
    """Where an event stands in its log: by the value of its position, not by its text or by a clock; events without a position come first."""
    s = F.col("source")
    return F.struct(F.coalesce(lsn_parse(s["lsn"]), F.lit(-1).cast("decimal(20,0)")).alias("lsn"), F.coalesce(s["binlog_file"], F.lit("")).alias("file"), F.coalesce(s["binlog_offset"], F.lit(-1)).alias("offset"), F.coalesce("ts_ms", F.lit(0)).alias("ts_ms"), F.length("id").alias("digits"), F.col("id"))


def after_snapshot(snapshot: DataFrame, stream: DataFrame, lsn: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot's events, and of the stream those past the snapshot's position."""
    return snapshot, stream.filter(lsn_parse(F.col("source.lsn")) > lsn_parse(F.lit(lsn)))


def deduplicated(stream: DataFrame, lateness: str = "10 minutes", time_column: str = "event_time") -> DataFrame:
    """Each id once within a window of lateness, so state doesn't grow without end."""
    return stream.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark(["id"])


def dead_letters(events: DataFrame, store: StateStore, position: str = "seq") -> DataFrame:
    """Events without an error; those with one go to the store's skipped positions, once each, and don't stop the rest.

    events should be persisted or stored: they are read once for each side.  A batch that is tried again adds nothing that is there already.
    """
    now = time.time_ns() // 1_000_000
    bad = events.filter("error is not null")
    rows = bad.select(F.lit(now).alias("seq"), F.col(position).cast("string").alias("position"), F.coalesce(F.col("tx_id"), F.lit("")).alias("tx_id"), "error", F.lit(now).alias("skipped_at"))
    names = ["position", "tx_id", "error"]
    rows = rows.dropDuplicates(names)
    known = store.table("skipped_positions").select(*names)
    same = [rows[n].eqNullSafe(known[n]) for n in names]
    store.extend("skipped_positions", rows.join(known, same, "left_anti"))
    return events.filter("error is null")
