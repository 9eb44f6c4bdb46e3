"""Canonical JSON text: keys sorted, nulls kept, no spaces; numbers as the shortest digits that read back.

A double is written in full from 1e-5 up to 1e16 and with an exponent (1e16, 2.5e-7) outside; a double that is not finite is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def string_json(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def double_json(c: Column) -> Column:
    size = F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,21)").cast("string"), r"0+$", ""), r"\.$", ".0")
    short = F.regexp_replace(F.lower(c.cast("string")), r"\.0e", "e")
    finite = c.isNotNull() & ~F.isnan(c) & (size != F.lit(float("inf")))
    return F.when(~finite, F.lit("null")).when(c == 0, F.lit("0.0")).when((size >= 1e-5) & (size < 1e16), plain).otherwise(short)


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """JSON text of a value of that type; null at the top stays null."""
    return F.when(c.isNotNull(), value_json(c, kind))


def value_json(c: Column, kind: T.DataType) -> Column:
    """JSON text of a value; null is the text null."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(quoted(f.name) + ":"), value_json(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.map_entries(c))
        body = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(string_json(e["key"].cast("string")), F.lit(":"), value_json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: value_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        body = double_json(c.cast("double"))
    elif isinstance(kind, T.BooleanType | T.IntegralType | T.DecimalType):
        body = c.cast("string")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        body = string_json(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(kind, T.BinaryType):
        body = string_json(F.concat(F.lit("\\x"), F.lower(F.hex(c))))
    elif isinstance(kind, T.VariantType):
        body = F.to_json(c)
    elif isinstance(kind, T.NullType):
        body = null
    else:
        body = string_json(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), body), null)


def quoted(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def json_of_event(pretty: bool = False) -> Column:
    """JSON text of the event in the columns op, before, after (JSON text), source, ts_ms, id."""
    s = F.col("source")
    kinds = {"binlog_file": "s", "binlog_offset": "n", "db": "s", "lsn": "s", "schema": "s", "snapshot": "n", "table": "s", "ts_ms": "n", "tx_id": "s"}
    optional = {"binlog_file", "binlog_offset", "lsn", "snapshot"}
    gap, start, end = (": ", "{\n    ", "\n  }") if pretty else (":", "{", "}")
    fields = []
    for name in sorted(kinds):
        value = string_json(s[name]) if kinds[name] == "s" else F.coalesce(s[name].cast("string"), F.lit("null"))
        text = F.concat(F.lit(quoted(name) + gap), value)
        fields.append(F.when(s[name].isNotNull(), text) if name in optional else text)
    inner = F.concat(F.lit(start), F.concat_ws(",\n    " if pretty else ",", *fields), F.lit(end))
    parts = {
        "after": F.coalesce(F.col("after"), F.lit("null")),
        "before": F.coalesce(F.col("before"), F.lit("null")),
        "id": string_json(F.col("id")),
        "op": string_json(F.col("op")),
        "source": inner,
        "ts_ms": F.coalesce(F.col("ts_ms").cast("string"), F.lit("null")),
    }
    joint = ",\n  " if pretty else ","
    body = F.concat_ws(joint, *(F.concat(F.lit(quoted(k) + gap), v) for k, v in parts.items()))
    return F.concat(F.lit("{\n  " if pretty else "{"), body, F.lit("\n}" if pretty else "}"))
