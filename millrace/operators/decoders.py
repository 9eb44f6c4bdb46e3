"""Decoders by the name of the output plugin that wrote a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..schema import COLUMNS, source
from . import pgoutput, wal2json


def as_events(decoded: DataFrame) -> DataFrame:
    """pgoutput.decode()'s flat rows as change events (images as JSON text); rows with an error are left out."""
    s = source(F.col("db"), F.col("table_name"), schema=F.col("schema_name"), lsn=F.col("lsn"), tx_id=F.col("tx_id"), ts_ms=F.col("ts_ms"))
    return decoded.filter("error is null").withColumn("source", s).select(*COLUMNS)


def decode_log(plugin: str, payloads: DataFrame, db: str) -> DataFrame:
    """Events of payloads (slot, seq, payload) of a plugin, pgoutput or wal2json."""
    if plugin == "pgoutput":
        return as_events(pgoutput.decode(payloads, db))
    if plugin == "wal2json":
        return wal2json.decode(payloads, db).filter("error is null").select(*COLUMNS)
    raise ConfigError(f"unknown output plugin {plugin!r}: pgoutput or wal2json")
