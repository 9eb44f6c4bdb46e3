"""Snapshots: every row of a table as a read event.

Partitions of the scan take the place of workers.  A row stays a typed struct until the events are written, so
columns that no later step uses are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..functions.json_text import canonical_json
from ..functions.scalars import snapshot_id
from ..schema import source

#: JSON text of a row longer than this many bytes is flagged.
LARGE_ROW = 1 << 20


def snapshot_events(df: DataFrame, db: str, schema: str, table: str, keys: list[str], ts_ms: int, lsn: str = "0/0", order: bool = False) -> DataFrame:
    """Read events of df's rows; ids are made of the keys, so a second run gives the same ids."""
    out = df.orderBy(*keys) if order and keys else df
    return out.select(
        F.lit("r").alias("op"),
        F.lit(None).cast(df.schema).alias("before"),
        F.struct(*df.columns).alias("after"),
        source(db, table, schema=schema, lsn=lsn, tx_id="0", ts_ms=ts_ms, snapshot=True).alias("source"),
        F.lit(ts_ms).cast("long").alias("ts_ms"),
        snapshot_id(schema, table, keys).alias("id"),
    )


def mysql_snapshot_events(df: DataFrame, db: str, table: str, keys: list[str], ts_ms: int, binlog_file: str, binlog_offset: int) -> DataFrame:
    """Read events at a binlog position.  A table without keys has no chunks and is refused."""
    if not keys:
        raise SnapshotError(f"{db}.{table} has no primary key")
    return df.select(
        F.lit("r").alias("op"),
        F.lit(None).cast(df.schema).alias("before"),
        F.struct(*df.columns).alias("after"),
        source(db, table, schema="", binlog_file=binlog_file, binlog_offset=binlog_offset, tx_id="0", ts_ms=ts_ms, snapshot=True).alias("source"),
        F.lit(ts_ms).cast("long").alias("ts_ms"),
        snapshot_id(db, table, keys).alias("id"),
    )


def as_text(events: DataFrame) -> DataFrame:
    """Events with their images as canonical JSON text, so that several tables fit one frame."""
    return events.withColumns({c: canonical_json(F.col(c), events.schema[c].dataType) for c in ("before", "after")})


def snapshot_tables(tables: dict[str, tuple[DataFrame, list[str]]], db: str, ts_ms: int, lsn: str = "0/0") -> DataFrame:
    """One frame of the events of several tables (qualified name -> frame, keys), images as JSON text."""
    from ..functions.scalars import qualified

    if not tables:
        raise SnapshotError("no tables to read")
    parts = [as_text(snapshot_events(df, db, *qualified(name), keys, ts_ms, lsn)) for name, (df, keys) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def table_totals(events: DataFrame) -> DataFrame:
    """Rows read of each table."""
    return events.groupBy(F.col("source.schema").alias("schema_name"), F.col("source.table").alias("table_name")).agg(F.count("*").alias("total_rows"))


def snapshot_result(events: DataFrame, snapshot: str, position: str) -> DataFrame:
    """One row: snapshot_id, position, total_rows, tables_snapshotted."""
    name = F.concat_ws(".", "source.schema", "source.table")
    return events.agg(F.count("*").alias("total_rows"), F.count_distinct(name).alias("tables_snapshotted")).select(F.lit(snapshot).alias("snapshot_id"), F.lit(position).alias("position"), "total_rows", "tables_snapshotted")


def with_row_size(events: DataFrame, limit: int = LARGE_ROW) -> DataFrame:
    """Events (images as text) with row_bytes and large_row; large rows stay."""
    size = F.octet_length(F.coalesce("after", F.lit("")))
    return events.withColumns({"row_bytes": size, "large_row": size > limit})


def select_tables(names: list[str], known: list[str]) -> list[str]:
    """The tables to read: those named, or all that are known, once each, in order of name."""
    return sorted(set(names or known))


def discovered(known: DataFrame, names: list[str] = ()) -> DataFrame:
    """known (schema_name, table_name, ...) rows of a catalog or publication -> the tables to read, once each, by name: those named (schema.table, or table for any schema), or all."""
    full = F.concat_ws(".", "schema_name", "table_name")
    rows = known.filter(full.isin(*names) | F.col("table_name").isin(*names)) if names else known
    return rows.select(full.alias("qualified"), "schema_name", "table_name").dropDuplicates(["qualified"]).orderBy("qualified")


def missing_tables(known: DataFrame, names: list[str]) -> DataFrame:
    """Of the names (schema.table) those that the catalog's rows don't have."""
    asked = known.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "qualified string")
    return asked.join(known.select(F.concat_ws(".", "schema_name", "table_name").alias("qualified")), "qualified", "left_anti")


def chunk_predicates(key: str, bounds: list[tuple[int | None, int | None]]) -> list[str]:
    """SQL of each chunk's rows, as the database gets it."""
    from ..functions.scalars import quote_ident

    k = quote_ident(key)
    return [" AND ".join(x for x in (f"{k} >= {a}" if a is not None else "", f"{k} < {b}" if b is not None else "") if x) or "1 = 1" for a, b in bounds]


def read_chunk(spark: SparkSession, url: str, table: str, key: str, start: int | None, end: int | None, fetch_size: int = 1000, order: list[str] = (), **options) -> DataFrame:
    """A chunk over JDBC; the predicate runs in the database and rows come in batches; `order` sorts them by those columns."""
    from .chunks import in_chunk

    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_size, **options)
    rows = reader.load().filter(in_chunk(F.col(key), start, end))
    return rows.orderBy(*order) if order else rows


def read_chunks(spark: SparkSession, url: str, table: str, key: str, bounds: list[tuple[int | None, int | None]], fetch_size: int = 1000, properties: dict | None = None) -> DataFrame:
    """All chunks of a table over JDBC, a partition each."""
    return spark.read.jdbc(url, table, predicates=chunk_predicates(key, bounds), properties={"fetchsize": str(fetch_size)} | (properties or {}))
