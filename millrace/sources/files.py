"""Events and log payloads kept in files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DecodeError, InputOutputError
from ..schema import OPERATIONS, SOURCE, envelope

#: A raw log message: the slot it came from, its place in the slot, its bytes.
PAYLOAD = T.StructType([T.StructField("slot", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("payload", T.BinaryType())])


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder with one JSON event in each file; images stay JSON text."""
    return spark.read.schema(envelope()).option("mode", "FAILFAST").option("multiLine", True).json(folder)


def list_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """name and size of the folder's .json files, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")).orderBy("name")


def check_fixture(path: str) -> dict:
    """The event of a file, or an error that says what is wrong with it."""
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise InputOutputError(f"{path}: {e}") from e
    try:
        event = json.loads(text)
    except ValueError as e:
        raise DecodeError(f"{path}: invalid event JSON: {e}") from e
    problem = event_problem(event)
    if problem:
        raise DecodeError(f"{path}: invalid event JSON: {problem}")
    return event


def event_problem(event) -> str | None:
    """What keeps a value read from JSON from being an event."""
    if not isinstance(event, dict):
        return "not an object"
    for name, kind in (("op", str), ("source", dict), ("ts_ms", int), ("id", str)):
        if name not in event:
            return f"missing field `{name}`"
        if not isinstance(event[name], kind) or isinstance(event[name], bool):
            return f"field `{name}` has the wrong type"
    if event["op"] not in OPERATIONS:
        return f"invalid operation code: {event['op']}"
    optional = {"lsn", "binlog_file", "binlog_offset", "snapshot"}
    missing = [f.name for f in SOURCE.fields if f.name not in optional and f.name not in event["source"]]
    return f"missing field `source.{missing[0]}`" if missing else None


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw log messages (PAYLOAD) of Parquet files."""
    return spark.read.schema(PAYLOAD).parquet(path)


def stream_payloads(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream; files_per_trigger bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(PAYLOAD)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
