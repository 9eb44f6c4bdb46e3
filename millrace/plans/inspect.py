"""Types of tables as TypeScript and JSON Schema, from Spark schemas or from a catalog's type names."""

from __future__ import annotations

import json

from pyspark.sql import types as T

#: The TypeScript type of catalog type names; others are unknown.
TS_TYPES = {
    "number": [
        "integer", "int", "int4", "smallint", "int2", "bigint", "int8", "smallserial", "serial", "bigserial", "serial8",
        "real", "float4", "double precision", "float8", "numeric", "decimal", "money", "oid",
    ],
    "boolean": ["boolean", "bool"],
    "string": [
        "character varying", "varchar", "character", "char", "text", "citext", "name", "bpchar",
        "timestamp", "timestamp without time zone", "timestamp with time zone", "timestamptz", "date", "time", "time without time zone", "time with time zone", "timetz",
        "interval", "uuid", "bytea", "inet", "cidr", "macaddr", "macaddr8", "point", "line", "lseg", "box", "path", "polygon", "circle", "xml", "tsvector", "tsquery",
    ],
    "any": ["json", "jsonb"],
    "unknown[]": ["array"],
}
_TS = {name: ts for ts, names in TS_TYPES.items() for name in names}

#: The types that every generated file ends with.
EVENT_TYPES = """// Change events
export type Operation = "c" | "u" | "d" | "r";

export interface SourceMetadata {
  db: string;
  schema: string;
  table: string;
  lsn: string;
  txId: string;
  tsMs: number;
  snapshot?: boolean;
}

export interface ChangeEvent {
  op: Operation;
  before: Record<string, unknown> | null;
  after: Record<string, unknown> | null;
  source: SourceMetadata;
  tsMs: number;
  id: string;
}
"""


def ts_type(name: str) -> str:
    """TypeScript type of a catalog type name (ARRAY in either case is an array)."""
    return _TS.get(name.lower(), "unknown")


def catalog_name(kind: T.DataType) -> str:
    """A catalog's name for a Spark type."""
    names = {T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double precision", T.BooleanType: "boolean", T.StringType: "text", T.BinaryType: "bytea", T.DateType: "date", T.TimestampType: "timestamp with time zone", T.TimestampNTZType: "timestamp without time zone", T.VariantType: "jsonb", T.StructType: "jsonb", T.MapType: "jsonb", T.ArrayType: "array"}
    return "numeric" if isinstance(kind, T.DecimalType) else names.get(type(kind), "text")


def columns_of(schema: T.StructType) -> list[tuple[str, str, bool]]:
    """name, catalog type, nullable of each column."""
    return [(f.name, catalog_name(f.dataType), f.nullable) for f in schema.fields]


def interface_name(table: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in table.replace(".", "_").split("_"))


def typescript(tables: dict[str, list[tuple[str, str, bool]]]) -> str:
    """Type definitions of tables (name -> columns), by name."""
    out = ["// Generated type definitions of captured tables.", ""]
    for table in sorted(tables):
        out += [f"export interface {interface_name(table)} {{", *(f"  {name}{'?' if null else ''}: {ts_type(kind)};" for name, kind, null in tables[table]), "}", ""]
    return "\n".join(out) + "\n" + EVENT_TYPES


def json_schema(tables: dict[str, list[tuple[str, str, bool]]]) -> dict:
    """A JSON Schema object for each table."""
    out = {}
    for table in sorted(tables):
        properties = {}
        for name, kind, _ in tables[table]:
            simple = ts_type(kind)
            properties[name] = {"type": simple if simple in ("number", "boolean") else "string", "description": f"Column type: {kind}"}
        out[table] = {"type": "object", "title": table, "properties": properties, "required": [name for name, _, null in tables[table] if not null]}
    return out


def json_schema_text(tables: dict[str, list[tuple[str, str, bool]]]) -> str:
    return json.dumps(json_schema(tables), indent=2, sort_keys=True) + "\n"
