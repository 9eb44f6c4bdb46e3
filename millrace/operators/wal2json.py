"""Transactions as JSON text (one object with a list of changes) into change events.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import string_json
from ..functions.scalars import wal2json_ts
from ..schema import source

TRANSACTION = (
    "xid string, timestamp string, change array<struct<kind: string, schema: string, table: string, columnnames: array<variant>, columnvalues: array<variant>, "
    "oldkeys: struct<keynames: array<variant>, keyvalues: array<variant>>>>"
)
#: Kinds of change that are events, and their operations.
KINDS = {"insert": "c", "update": "u", "delete": "d"}


def zipped(names: Column, values: Column) -> Column:
    """JSON text of the object of names and values: null without names, {} without values, null for a value too few; names that aren't text are left out."""

    def pair(i: Column) -> Column:
        name, value = F.get(names, i), F.get(values, i)
        return F.struct(F.try_variant_get(name, "$", "string").alias("k"), F.coalesce(F.to_json(value), F.lit("null")).alias("v"))

    numbers = F.when(F.size(names) > 0, F.sequence(F.lit(0), F.size(names) - 1)).otherwise(F.array().cast("array<int>"))
    named = F.filter(numbers, lambda i: F.schema_of_variant(F.get(names, i)) == "STRING")
    body = F.array_join(F.transform(F.array_sort(F.transform(named, pair)), lambda p: F.concat(string_json(p["k"]), F.lit(":"), p["v"])), ",")
    return F.when(names.isNull(), F.lit(None).cast("string")).when(values.isNull(), F.lit("{}")).otherwise(F.concat(F.lit("{"), body, F.lit("}")))


def decode(payloads: DataFrame, db: str, payload: str = "payload", keep: list[str] = (), mode: str = "unique") -> DataFrame:
    """payloads with a column of JSON text -> events (images as JSON text), columns of keep, and error (null for an event).

    Empty payloads are dropped.  A payload that isn't a transaction gives one row with an error, as does a transaction with a change without kind or table.
    mode: `unique` ids are xid:idx, `shared` ones the xid alone, the same for all of a transaction's events.
    """
    if mode not in ("unique", "shared"):
        raise ValueError(mode)
    text = F.col(payload).cast("string")
    rows = payloads.filter(F.length(F.trim(text)) > 0).withColumn("_t", F.from_json(text, TRANSACTION)).withColumn("_v", F.try_parse_json(text))
    change = F.col("_t.change")
    kind = F.try_variant_get("_v", "$.change", "array<variant>")
    bad = F.exists(change, lambda c: c["kind"].isNull() | (c["kind"].isin(*KINDS) & c["table"].isNull()))
    ts = wal2json_ts(F.col("_t.timestamp"))
    error = (
        F.when(F.col("_v").isNull(), "invalid JSON")
        .when(kind.isNull() | change.isNull(), "missing change array")
        .when(F.coalesce(bad, F.lit(False)), "change without kind or table")
        .when(ts.isNull(), F.concat(F.lit("unable to parse timestamp: "), F.col("_t.timestamp")))
    )
    # one pass: a transaction that can't be read is exploded like the others, into one row without a change
    marked = F.transform(change, lambda c, i: F.struct(i.alias("idx"), c.alias("c")))
    known = F.filter(marked, lambda x: x["c"]["kind"].isin(*KINDS))
    rows = rows.withColumns({"error": error, "_ts": ts})
    rows = rows.select(*keep, "_t.xid", "_ts", "error", F.explode_outer(F.when(F.col("error").isNull(), known)).alias("_x")).filter("_x is not null or error is not null")
    c, fine = F.col("_x.c"), F.col("error").isNull()
    op = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[c["kind"]]
    unique = F.concat_ws(":", "xid", F.col("_x.idx").cast("string")) if mode == "unique" else F.col("xid")
    return rows.select(
        op.alias("op"),
        F.when(op != "c", zipped(c["oldkeys"]["keynames"], c["oldkeys"]["keyvalues"])).alias("before"),
        F.when(op != "d", zipped(c["columnnames"], c["columnvalues"])).alias("after"),
        F.when(fine, source(db, c["table"], schema=F.coalesce(c["schema"], F.lit("public")), tx_id=F.coalesce("xid", F.lit("")), ts_ms=F.col("_ts"))).alias("source"),
        F.when(fine, F.col("_ts")).alias("ts_ms"),
        F.when(fine, F.when(F.col("xid").isNotNull(), unique).otherwise(F.uuid())).alias("id"),
        *keep,
        "error",
    )
