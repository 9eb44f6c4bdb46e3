"""Where events go: server-sent-event frames, files, callbacks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the frames' events.
FRAMES = ("change", "heartbeat", "snapshot_start", "snapshot_progress", "snapshot_complete", "streaming_start", "error", "shutdown")


def frame(event: Column, data: Column, id: Column | None = None) -> Column:
    """A server-sent event: event, id (where there is one) and data lines, and an empty line."""
    line = F.when(id.isNotNull(), F.concat(F.lit("id: "), id, F.lit("\n"))).otherwise(F.lit("")) if id is not None else F.lit("")
    return F.concat(F.lit("event: "), event, F.lit("\n"), line, F.lit("data: "), data, F.lit("\n\n"))


def change_frames(events: DataFrame) -> DataFrame:
    """event, id, frame of each event (images as JSON text)."""
    from ..functions.json_text import json_of_event

    return events.select(F.lit("change").alias("event"), F.col("id"), frame(F.lit("change"), json_of_event(), F.col("id")).alias("frame"))


def lagged(skipped: Column) -> Column:
    """The frame that tells a slow consumer how many events it has missed."""
    return frame(F.lit("error"), F.concat(F.lit('{"code":"lagged","skipped":'), skipped.cast("string"), F.lit("}")))


def lag_frames(clients: DataFrame, sent: int, most_behind: int) -> DataFrame:
    """clients (client, at: how many events it has had) of a log of `sent` events -> client, skipped, resume_at, frame of those more than most_behind behind."""
    behind = clients.withColumn("skipped", F.lit(sent).cast("long") - F.col("at") - F.lit(most_behind)).filter("skipped > 0")
    return behind.select("client", "skipped", (F.col("at") + F.col("skipped")).alias("resume_at"), lagged(F.col("skipped")).alias("frame"))


def heartbeats(spark, every_ms: int = 30_000):
    """A stream with a heartbeat frame every so often."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", every_ms).load()
    return ticks.select(frame(F.lit("heartbeat"), F.concat(F.lit('{"ts_ms":'), F.unix_millis("timestamp").cast("string"), F.lit("}"))).alias("frame"))


def write_frames(events: DataFrame, path: str) -> None:
    """Appends the events' frames as text files (each row ends with a line break, which the empty line's own gives)."""
    frames = change_frames(events).select(F.regexp_replace("frame", r"\n$", "").alias("value"))
    frames.write.mode("append").text(path)


def write_text(text: str, path: str) -> None:
    """A file, or the standard output for `-`."""
    if path == "-":
        print(text, end="")
    else:
        Path(path).write_text(text)


class Delivered:
    """Runs each batch once: several sinks from one ordered source.  A batch that was delivered before a restart isn't delivered again.

    The numbers of delivered batches are kept beside the sinks; writing them and the sinks isn't one step, so sinks see a batch at least once.
    """

    def __init__(self, store, name: str, *sinks):
        self.store, self.name, self.sinks = store, name, sinks

    def __call__(self, batch: DataFrame, number: int) -> None:
        last = self.store.info(f"delivered:{self.name}") if self.store else None
        if last is not None and number <= int(last):
            return
        batch = batch.persist()
        try:
            for sink in self.sinks:
                sink(batch, number)
        finally:
            batch.unpersist()
        if self.store:
            self.store.set_info(f"delivered:{self.name}", str(number))


def to_parquet(path: str):
    return lambda batch, number=0: batch.write.mode("append").parquet(path)


def to_log(path: str):
    """Appends batches to a log: events as text, with batch (the batch's number, a folder each) and place (from 0, by position within the batch).

    A batch that is written again replaces itself.  Batches only ever come behind those that are there, so a reader that has come to (batch, place)
    misses nothing, however late an event's own time is.
    """
    from ..schema import to_json_text
    from .capture import place

    def send(batch: DataFrame, number: int = 0) -> None:
        order = Window.orderBy(place())  # of one micro-batch, which is bounded by the source's limit
        to_json_text(batch).withColumn("place", F.row_number().over(order) - 1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return send


def to_callback(function, most: int = 10_000):
    """Hands events to a function, in a bounded number of rows at a time, in order of position within a batch."""
    from .capture import place

    def send(batch: DataFrame, number: int = 0) -> None:
        rows = []
        for row in batch.orderBy(place()).toLocalIterator():
            rows.append(row.asDict(recursive=True))
            if len(rows) == most:
                function(rows)
                rows = []
        if rows:
            function(rows)

    return send


def snapshot_frames(states: DataFrame, snapshot: str) -> DataFrame:
    """Frames of a snapshot's course from its chunks' states (chunk_states()): seq, event, frame; start, one progress frame for each completed chunk in order, complete if all are."""
    s = states.filter(F.col("snapshot_id") == snapshot)
    total = s.agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "completed").alias("done"), F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("rows_count"))), F.lit(0)).cast("long").alias("rows"))
    head = F.lit(f'{{"snapshot_id":"{snapshot}"')

    def one(seq: Column, event: str, *fields: tuple[str, str]) -> list[Column]:
        data = F.concat(head, *(F.concat(F.lit(f',"{k}":'), F.col(c).cast("string")) for k, c in fields), F.lit("}"))
        return [seq.cast("long").alias("seq"), F.lit(event).alias("event"), frame(F.lit(event), data).alias("frame")]

    steps = s.filter("status = 'completed'").select(*one(F.col("chunk") + 1, "snapshot_progress", ("chunk", "chunk"), ("rows", "rows_count")))
    return total.select(*one(F.lit(0), "snapshot_start", ("chunks", "chunks"))).unionByName(steps).unionByName(total.filter("done = chunks").select(*one(F.col("chunks") + 1, "snapshot_complete", ("rows", "rows"))))
