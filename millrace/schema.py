"""The change event: a fixed envelope around two row images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = {"c": "create", "u": "update", "d": "delete", "r": "read"}

SOURCE = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("lsn", T.StringType()),
        T.StructField("binlog_file", T.StringType()),
        T.StructField("binlog_offset", T.LongType()),
        T.StructField("tx_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("snapshot", T.BooleanType()),
    ]
)


def envelope(image: T.DataType | None = None) -> T.StructType:
    """Schema of an event whose images have that type (JSON text by default)."""
    image = image or T.StringType()
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("source", SOURCE),
            T.StructField("ts_ms", T.LongType()),
            T.StructField("id", T.StringType()),
        ]
    )


COLUMNS = envelope().fieldNames()


def source(db, table, schema="", lsn=None, binlog_file=None, binlog_offset=None, tx_id=None, ts_ms=None, snapshot=None) -> Column:
    """The source struct; text given as str is a literal."""

    def col(x, kind):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    values = {"db": db, "schema": schema, "table": table, "lsn": lsn, "binlog_file": binlog_file, "binlog_offset": binlog_offset, "tx_id": tx_id, "ts_ms": ts_ms, "snapshot": snapshot}
    return F.struct(*(col(values[f.name], f.dataType).alias(f.name) for f in SOURCE.fields))


def known_op(op: Column) -> Column:
    return op.isin(*OPERATIONS)


def op_error(op: Column) -> Column:
    """Why an operation code is refused, else null."""
    return F.when(op.isNull(), F.lit("missing operation")).when(~known_op(op), F.concat(F.lit("invalid operation code: "), op))


def to_json_text(events: DataFrame) -> DataFrame:
    """Events whose images are structs, with the images as canonical JSON text instead."""
    from .functions.json_text import canonical_json

    return events.withColumns({c: canonical_json(F.col(c), events.schema[c].dataType) for c in ("before", "after") if not isinstance(events.schema[c].dataType, T.StringType)})


def event_json(pretty: bool = False) -> Column:
    """An event (images as JSON text or structs) as one JSON text, keys in order, absent source fields left out, null images kept."""
    from .functions.json_text import json_of_event

    return json_of_event(pretty)
