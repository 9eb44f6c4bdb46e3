"""Totals and latest-of folds over events and logs.

A log is append-only; the state of a key is a fold over its rows.  `max_by` needs no sort and combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals_by_op(events: DataFrame) -> DataFrame:
    return events.groupBy("op").agg(F.count("*").alias("n_events"))


def per_second(events: DataFrame, ts_ms: str = "ts_ms") -> DataFrame:
    """Events of each second that has any: second (since 1970), n_events."""
    return events.groupBy(F.call_function("div", F.col(ts_ms), F.lit(1000)).alias("second")).agg(F.count("*").alias("n_events"))


def distinct_events(events: DataFrame, id: str = "id") -> DataFrame:
    """Each event once, by its id.  Ids that all events of a transaction share, or random ones, must not be used here."""
    return events.dropDuplicates([id])


def last_offset(offsets: DataFrame, mode: str = "latest") -> DataFrame:
    """The offset to resume from: the one written last, or (reference) the last final one if there is any.  At most one row."""
    if mode not in ("latest", "reference"):
        raise ValueError(mode)
    order = F.struct("sequence") if mode == "latest" else F.struct("is_final", "sequence")
    return offsets.agg(F.max_by(F.struct(*offsets.columns), order).alias("o")).filter("o is not null").select("o.*")


def next_sequence(offsets: DataFrame) -> DataFrame:
    return offsets.agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).cast("long").alias("next_sequence"))


def snapshot_progress(log: DataFrame) -> DataFrame:
    """log (table_name, seq, last_key, rows, completed) -> each table's last row, completed if it ever was."""
    return log.groupBy("table_name").agg(F.max_by("last_key", "seq").alias("last_key"), F.max_by("rows", "seq").alias("rows"), F.bool_or("completed").alias("completed"))


def snapshot_status(log: DataFrame, table: str) -> DataFrame:
    """The latest row of a table (by started_at, then seq)."""
    return log.filter(F.col("table_name") == table).agg(F.max_by(F.struct(*log.columns), F.struct("started_at", "seq")).alias("s")).filter("s is not null").select("s.*")


def schema_versions(log: DataFrame) -> DataFrame:
    """log (table_name, seq, schema_hash) -> each table's schema in force and how often it was written."""
    return log.groupBy("table_name").agg(F.max_by("schema_hash", "seq").alias("schema_hash"), F.count("*").alias("version"))


def latest_values(log: DataFrame) -> DataFrame:
    """log (key, value, seq) -> each key's last value."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def chunk_states(log: DataFrame) -> DataFrame:
    """log (snapshot_id, table, chunk, seq, status, rows_count, error) -> each chunk's last state."""
    columns = [c for c in log.columns if c not in ("snapshot_id", "table", "chunk", "seq")]
    return log.groupBy("snapshot_id", "table", "chunk").agg(F.max_by(F.struct(*columns), "seq").alias("s")).select("snapshot_id", "table", "chunk", "s.*")


def chunk_rollup(states: DataFrame) -> DataFrame:
    """By snapshot: completed and other chunks, and the rows of the completed."""
    done = F.col("status") == "completed"
    return states.groupBy("snapshot_id").agg(
        F.count_if(done).alias("n_completed"),
        F.count_if(~done).alias("n_incomplete"),
        F.coalesce(F.sum(F.when(done, F.col("rows_count"))), F.lit(0)).cast("long").alias("total_rows"),
    )


def columns_by_table(columns: DataFrame) -> DataFrame:
    """columns (table_name, position, name, type) -> each table's columns in order."""
    one = F.array_sort(F.collect_list(F.struct("position", "name", "type")))
    return columns.groupBy("table_name").agg(F.transform(one, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"))).alias("columns"))


def health(events: DataFrame, uptime_ms: int, state: str = "streaming", now_ms: int | None = None, late_ms: int = 60_000) -> DataFrame:
    """One row: status, uptime_ms, events_captured, current_lsn, lag_ms, state.  The position is the greatest by value, not by its text."""
    from ..functions.scalars import lsn_parse

    lag = F.greatest(F.lit(0).cast("long"), F.lit(now_ms).cast("long") - F.max("ts_ms")) if now_ms is not None else F.lit(0).cast("long")
    out = events.agg(F.count("*").alias("events_captured"), F.coalesce(F.max_by("source.lsn", lsn_parse(F.col("source.lsn"))), F.lit("")).alias("current_lsn"), F.coalesce(lag, F.lit(0)).cast("long").alias("lag_ms"))
    status = F.when(F.lit(state) == "error", "down").when(F.col("lag_ms") > late_ms, "degraded").otherwise("ok")
    return out.select(status.alias("status"), F.lit(uptime_ms).cast("long").alias("uptime_ms"), "events_captured", "current_lsn", "lag_ms", F.lit(state).alias("state"))
