"""The state store: append-only Parquet tables in one folder, read through folds.

Spark's checkpoint is what a stream resumes from; these tables keep the same facts where they can be queried.  Small writes
come from the driver, one at a time, as a capture makes them.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MigrationFailed, StateCorruption, StateLocked
from ..operators import aggregates
from ..sources import chunks

#: The position before all others.
BEGINNING = "0/0"
#: Layout of the tables; a folder with a later one is refused.
VERSION = 2
TABLES = {
    "offsets": "sequence long, lsn string, tx_id string, ts_ms long, is_final boolean, adapter string",
    "snapshots": "table_name string, seq long, last_key string, rows long, completed boolean, started_at long",
    "schema_cache": "table_name string, seq long, schema_hash string, schema_json string, keys_json string",
    "skipped_positions": "seq long, position string, tx_id string, error string, skipped_at long",
    "instance_info": "key string, value string, seq long",
    "snapshot_chunks": "snapshot_id string, table string, chunk long, seq long, status string, rows_count long, error string, start_key long, end_key long",
    "layout": "version long",
}
#: Tables that each version added.
ADDED = {1: ("offsets", "snapshots", "schema_cache", "skipped_positions", "instance_info"), 2: ("snapshot_chunks",)}


class StateStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._seq, self._owns = 0, False
        self.migrate()

    # --- tables

    def table(self, name: str) -> DataFrame:
        """The table's rows; none if nothing was written yet."""
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def extend(self, name: str, rows: DataFrame) -> None:
        """Appends a frame's rows, which have the table's columns."""
        kinds = T._parse_datatype_string(TABLES[name])
        rows.select(*(F.col(f.name).cast(f.dataType) for f in kinds.fields)).write.mode("append").parquet(f"{self.folder}/{name}")

    # --- one writer

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def lock(self, owner: str) -> "StateStore":
        """Claims the folder for one writer; a folder that another holds raises.  The claim is a file that only one can create."""
        fs, path = self._file("_writer")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            raise StateLocked(f"{self.folder} is in use by another capture: {path.toString()} exists") from e
        out.write(bytearray(owner.encode()))
        out.close()
        self._owns = True
        return self

    def unlock(self) -> None:
        if self._owns:
            fs, path = self._file("_writer")
            fs.delete(path, False)
            self._owns = False

    def _next(self) -> int:
        """A number above all that this store gave out, also over restarts."""
        self._seq = max(self._seq + 1, time.time_ns() // 1000)
        return self._seq

    def version(self) -> int:
        return self.table("layout").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def migrate(self) -> None:
        """Brings the folder to VERSION, forward only, a version at a time."""
        have = self.version()
        if have > VERSION:
            raise MigrationFailed(f"the state has layout {have}, this program knows up to {VERSION}")
        for v in range(have + 1, VERSION + 1):
            self.append("layout", (v,))

    def check(self) -> None:
        """Reads every table; a file that can't be read raises."""
        for name in TABLES:
            try:
                self.table(name).agg(F.count("*")).collect()
            except Exception as e:
                raise StateCorruption(f"{name}: {str(e).splitlines()[0]}") from e

    def _clear(self, name: str) -> None:
        fs, path = self._file(name)
        fs.delete(path, True)

    # --- offsets

    def write_offset(self, lsn: str, tx_id: str = "", ts_ms: int = 0, is_final: bool = False, adapter: str = "") -> int:
        sequence = aggregates.next_sequence(self.table("offsets")).first()[0]
        self.append("offsets", (sequence, lsn, tx_id, ts_ms, is_final, adapter))
        return sequence

    def last_offset(self, mode: str = "latest"):
        return aggregates.last_offset(self.table("offsets"), mode).first()

    def clear_offsets(self) -> None:
        self._clear("offsets")

    # --- snapshots and chunks

    def write_progress(self, table: str, last_key: str | None, rows: int, completed: bool = False) -> None:
        now = self._next()
        self.append("snapshots", (table, now, last_key, rows, completed, now // 1_000_000))

    def progress(self) -> DataFrame:
        return aggregates.snapshot_progress(self.table("snapshots"))

    def tables_to_read(self, tables: list[str]) -> list[str]:
        """Those whose snapshot isn't complete."""
        done = {r["table_name"] for r in self.progress().filter("completed").collect()}
        return [t for t in tables if t not in done]

    def write_plan(self, snapshot: str, plan: DataFrame) -> None:
        """Stores a plan's chunks with their bounds; those that are there already stay as they are."""
        known = self.table("snapshot_chunks").filter(F.col("snapshot_id") == snapshot).select("table", "chunk").distinct()
        now = self._next()
        rows = plan.join(known, ["table", "chunk"], "left_anti").select(F.lit(snapshot), "table", "chunk", F.lit(now), F.lit("pending"), F.lit(0), F.lit(None), "start_key", "end_key").collect()
        if rows:
            self.append("snapshot_chunks", *map(tuple, rows))

    def write_chunk(self, snapshot: str, table: str, chunk: int, status: str, rows: int = 0, error: str | None = None) -> None:
        self.append("snapshot_chunks", (snapshot, table, chunk, self._next(), status, rows, error, None, None))

    def chunks(self, snapshot: str, table: str | None = None) -> DataFrame:
        log = self.table("snapshot_chunks").filter(F.col("snapshot_id") == snapshot)
        log = log if table is None else log.filter(F.col("table") == table)
        bounds = log.groupBy("table", "chunk").agg(F.max("start_key").alias("start_key"), F.max("end_key").alias("end_key"))
        states = aggregates.chunk_states(log.drop("start_key", "end_key"))
        return states.join(bounds, ["table", "chunk"]).orderBy("table", "chunk")

    def pending_chunks(self, snapshot: str) -> DataFrame:
        """Chunks that are left to read, with the bounds of the stored plan, however the table's range has moved since."""
        states = self.chunks(snapshot)
        return chunks.pending(states.select("table", "chunk", "start_key", "end_key", "status"), states).orderBy("table", "chunk")

    def chunk_totals(self, snapshot: str):
        return aggregates.chunk_rollup(self.chunks(snapshot)).first()

    def run_id(self) -> str:
        """The snapshot that has chunks left, else a new id."""
        states = aggregates.chunk_states(self.table("snapshot_chunks").drop("start_key", "end_key"))
        left = states.filter("status != 'completed'").agg(F.max("snapshot_id")).first()[0]
        return left or uuid.uuid4().hex

    # --- the rest

    def cache_schema(self, table: str, schema_hash: str, schema_json: str, keys_json: str = "[]") -> None:
        self.append("schema_cache", (table, self._next(), schema_hash, schema_json, keys_json))

    def cached_schema(self, table: str):
        """schema_hash, version, schema_json and keys of a table; None if there is none."""
        import json

        log = self.table("schema_cache").filter(F.col("table_name") == table)
        row = log.groupBy("table_name").agg(F.max_by("schema_hash", "seq").alias("schema_hash"), F.max_by("schema_json", "seq").alias("schema_json"), F.max_by("keys_json", "seq").alias("keys_json"), F.count("*").alias("version")).first()
        if row is None:
            return None
        try:
            keys = json.loads(row["keys_json"])
        except ValueError as e:
            raise StateCorruption(f"keys of {table}: {e}") from e
        return {"schema_hash": row["schema_hash"], "schema_json": row["schema_json"], "version": row["version"], "keys": keys}

    def skip(self, position: str, tx_id: str, error: str) -> None:
        now = self._next()
        self.append("skipped_positions", (now, position, tx_id, error, now // 1000))

    def set_info(self, key: str, value: str) -> None:
        self.append("instance_info", (key, value, self._next()))

    def info(self, key: str) -> str | None:
        row = aggregates.latest_values(self.table("instance_info").filter(F.col("key") == key)).first()
        return row and row["value"]


def start_position(asked: str | None, saved: str | None, snapshot: str | None = None) -> str:
    """Where to begin: at the snapshot's position if one was made, else where asked, else where the last run ended, else at the beginning."""
    return snapshot or asked or saved or BEGINNING


def checkpoint_position(committed: str | None, stream: str | None, first_event: str | None) -> str | None:
    """What to record after a batch."""
    return committed or stream or first_event


def start_positions(asked: Column, saved: Column, snapshot: Column) -> Column:
    """start_position() of columns; the empty text counts as none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (snapshot, asked, saved)), F.lit(BEGINNING))


def checkpoint_positions(committed: Column, stream: Column, first_event: Column) -> Column:
    """checkpoint_position() of columns; the empty text counts as none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (committed, stream, first_event)))
