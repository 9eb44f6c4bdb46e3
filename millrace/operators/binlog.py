"""Row events of a binlog, parsed into rows of before and after images, into change events; values by column type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import double_json, string_json
from ..functions.scalars import mysql_datetime, mysql_time, text_or_base64, to_boolean
from ..schema import source

#: The data type of each column type, and what kind of JSON value a column of it becomes.
COLUMN_TYPES = {
    "tinyint": ("TINY", "number"),
    "smallint": ("SHORT", "number"),
    "mediumint": ("INT24", "number"),
    "int": ("LONG", "number"),
    "integer": ("LONG", "number"),
    "bigint": ("LONGLONG", "number"),
    "float": ("FLOAT", "number"),
    "double": ("DOUBLE", "number"),
    "decimal": ("NEWDECIMAL", "string"),
    "numeric": ("NEWDECIMAL", "string"),
    "char": ("STRING", "default"),
    "varchar": ("VARCHAR", "default"),
    "binary": ("BLOB", "default"),
    "varbinary": ("VARCHAR", "default"),
    "tinyblob": ("TINY_BLOB", "default"),
    "tinytext": ("TINY_BLOB", "default"),
    "blob": ("BLOB", "default"),
    "text": ("BLOB", "default"),
    "mediumblob": ("MEDIUM_BLOB", "default"),
    "mediumtext": ("MEDIUM_BLOB", "default"),
    "longblob": ("LONG_BLOB", "default"),
    "longtext": ("LONG_BLOB", "default"),
    "json": ("JSON", "default"),
    "enum": ("ENUM", "default"),
    "set": ("SET", "default"),
    "date": ("DATE", "default"),
    "time": ("TIME", "default"),
    "datetime": ("DATETIME", "default"),
    "timestamp": ("TIMESTAMP", "default"),
    "year": ("YEAR", "number"),
    "bit": ("BIT", "number"),
    "geometry": ("GEOMETRY", "default"),
}


def column_type(data_type: Column) -> Column:
    """The column type of a data type; an unknown one counts as STRING."""
    table = F.create_map(*(F.lit(x) for k, (t, _) in COLUMN_TYPES.items() for x in (k, t)))
    return F.coalesce(F.try_element_at(table, F.lower(data_type)), F.lit("STRING"))


def json_target(data_type: Column, unsigned: Column) -> Column:
    """number, string or default: what a column becomes in JSON.  Numbers that a double can't hold become strings."""
    table = F.create_map(*(F.lit(x) for k, (_, t) in COLUMN_TYPES.items() for x in (k, t)))
    kind = F.coalesce(F.try_element_at(table, F.lower(data_type)), F.lit("default"))
    return F.when((F.lower(data_type) == "bigint") & unsigned, "string").otherwise(kind)


#: A value as the binlog has it: one of these fields is set, none for NULL.
VALUE = "struct<bytes: binary, int: bigint, uint: decimal(20,0), float: float, double: double, date: timestamp_ntz, time: struct<negative: boolean, days: int, hours: int, minutes: int, seconds: int, micros: int>>"


def value_json(v: Column, target: Column) -> Column:
    """JSON text of a value for a column with that target (number, string, boolean or default)."""
    t = v["time"]
    temporal = F.coalesce(mysql_datetime(v["date"]), F.when(t.isNotNull(), mysql_time(t["negative"], t["days"], t["hours"], t["minutes"], t["seconds"], t["micros"])))

    def text_json(c: Column) -> Column:
        return F.when(c.isNotNull(), string_json(c))

    def real(c: Column) -> Column:
        text = double_json(c.cast("double"))
        return F.when(c.isNotNull(), F.when(text == "null", "0").otherwise(text))

    number = F.coalesce(v["int"].cast("string"), v["uint"].cast("string"), real(v["float"]), real(v["double"]))
    plain = F.coalesce(text_json(text_or_base64(v["bytes"])), number, text_json(temporal))
    as_text = F.coalesce(text_json(v["bytes"].cast("string")), text_json(F.coalesce(v["int"].cast("string"), v["uint"].cast("string"))), text_json(F.regexp_replace(real(v["float"]), r"\.0$", "")), text_json(F.regexp_replace(real(v["double"]), r"\.0$", "")), text_json(temporal))
    boolean = F.coalesce(to_boolean(v["int"], "integer"), to_boolean(v["uint"], "integer"), to_boolean(v["float"], "float"), to_boolean(v["double"], "double"), to_boolean(v["bytes"].cast("string"), "text"), to_boolean(temporal, "temporal"))
    return F.coalesce(F.when(target == "string", as_text).when(target == "boolean", boolean.cast("string")).otherwise(plain), F.lit("null"))


def row_json(values: Column, names: Column, targets: Column | None = None) -> Column:
    """JSON text of a row (array of VALUE) under its columns' names; null if their numbers differ."""
    pairs = F.arrays_zip(names.alias("n"), values.alias("v"), (targets if targets is not None else F.transform(names, lambda _: F.lit("default"))).alias("t"))
    body = F.array_join(F.transform(F.array_sort(pairs, lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)), lambda p: F.concat(string_json(p["n"]), F.lit(":"), value_json(p["v"], p["t"]))), ",")
    return F.when(F.size(values) == F.size(names), F.concat(F.lit("{"), body, F.lit("}")))


def column_names(names: Column, count: Column) -> Column:
    """Names of a table's columns: as the table map has them, _col_i where it has none."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.coalesce(F.get(names, i), F.concat(F.lit("_col_"), i.cast("string"))))


def decode(events: DataFrame, partial_as: str = "u") -> DataFrame:
    """Row events (type, rows array<struct<before, after>>, source struct) -> change events, one for each row.

    type: write, update, delete (also with _v1, the events of older servers, which hold the same rows) or partial_update; others (table maps, rotations,
    queries, commits) give none.  A partial update is an update; partial_as="c" makes it a create without a before image.  An id is file:offset:transaction:row.
    """
    kind, r = F.regexp_replace(F.lower("type"), "_v1$", ""), F.col("_r")
    op = F.when(kind == "write", "c").when(kind == "update", "u").when(kind == "delete", "d").when(kind == "partial_update", partial_as)
    one = events.filter(op.isNotNull()).select(op.alias("op"), "source", F.posexplode("rows").alias("row", "_r"))
    s = F.col("source")
    return one.select(
        "op",
        F.when(F.col("op") != "c", r["before"]).alias("before"),
        F.when(F.col("op") != "d", r["after"]).alias("after"),
        source(s["db"], s["table"], schema="", binlog_file=s["binlog_file"], binlog_offset=s["binlog_offset"], tx_id=s["tx_id"], ts_ms=s["ts_ms"], snapshot=s["snapshot"]).alias("source"),
        s["ts_ms"].alias("ts_ms"),
        F.concat_ws(":", s["binlog_file"], s["binlog_offset"].cast("string"), s["tx_id"], F.col("row").cast("string")).alias("id"),
    )


def with_table_map(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Row events (table_id, seq, ...) with the table map (table_id, seq, columns, ...) in force; events before any map of their table are dropped."""
    from .lookup import as_of

    return as_of(rows, maps, ["table_id"], "seq", "table_map").filter("table_map is not null")


#: Settings that row capture needs, and what they must be.
SETTING_RULES = (
    # name, test on the value, error or warning
    ("log_bin", "upper(value) IN ('ON', '1')", "error"),
    ("binlog_format", "upper(value) = 'ROW'", "error"),
    ("binlog_row_image", "upper(value) = 'FULL'", "warning"),
    ("binlog_checksum", "upper(value) IN ('CRC32', 'NONE')", "error"),
    ("version", "value RLIKE '^(5[.]7|8[.]0)'", "error"),
    ("binlog_expire_logs_seconds", "try_cast(value AS BIGINT) = 0 OR try_cast(value AS BIGINT) >= 86400", "warning"),
)


def check_settings(settings: DataFrame) -> DataFrame:
    """settings (name, value) of a server -> name, value, level (error or warning) of the ones that row capture can't or shouldn't run with."""
    out = None
    for name, test, level in SETTING_RULES:
        rule = settings.sparkSession.createDataFrame([(name, level)], "name string, level string")
        found = rule.join(settings, "name", "left").filter(~F.coalesce(F.expr(test), F.lit(False))).select("name", "value", "level")
        out = found if out is None else out.unionByName(found)
    return out


#: Privileges that following a binlog needs.
PRIVILEGES = ("REPLICATION SLAVE", "REPLICATION CLIENT")


def missing_privileges(grants: DataFrame, db: str) -> DataFrame:
    """grants (user, grant: the server's text) -> user, privilege: what each user lacks for reading that database's log and tables."""
    text = F.upper(F.array_join(F.collect_list("grant"), " "))
    held = grants.groupBy("user").agg(text.alias("text"))
    has = {name: F.contains("text", F.lit(name)) for name in PRIVILEGES}
    has[f"SELECT on {db}"] = F.contains("text", F.lit(f"SELECT ON `{db.upper()}`")) | F.contains("text", F.lit("SELECT ON *.*"))
    every = F.contains("text", F.lit("ALL PRIVILEGES ON *.*"))
    lacking = F.array(*(F.when(~(every | ok), name) for name, ok in has.items()))
    return held.select("user", F.explode(F.filter(lacking, lambda x: x.isNotNull())).alias("privilege"))
