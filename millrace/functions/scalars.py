"""Scalar functions over columns: log positions, times, values, hashes, names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- log positions


def lsn_parse(text: Column) -> Column:
    """`X/Y` (hex halves of at most 32 bits) as DECIMAL(20,0); null if it isn't one."""
    hi, lo = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))

    def number(half: Column) -> Column:
        return F.conv(F.ltrim(F.regexp_replace(half, r"^\+?0*", "")), 16, 10).cast("decimal(20,0)")

    def value(half: Column) -> Column:
        return F.when(half.rlike(r"^\+?0+$"), F.lit(0).cast("decimal(20,0)")).otherwise(number(half))

    ok = text.rlike(r"^\+?0*[0-9A-Fa-f]{1,8}/\+?0*[0-9A-Fa-f]{1,8}$")
    return F.when(ok, (value(hi) * F.lit(4294967296).cast("decimal(10,0)") + value(lo)).cast("decimal(20,0)"))


def lsn_format(number: Column) -> Column:
    """A position (BIGINT, or DECIMAL for the full range) as text."""
    wide = number.cast("decimal(20,0)")
    hi = F.floor(wide / F.lit(4294967296).cast("decimal(10,0)")).cast("long")
    lo = F.pmod(wide, F.lit(4294967296).cast("decimal(10,0)")).cast("long")
    return F.concat(F.hex(hi), F.lit("/"), F.lpad(F.hex(lo), 8, "0"))


def lsn_format_long(number: Column) -> Column:
    """lsn_format for positions under 2**63, in integer arithmetic."""
    return F.concat(F.hex(F.shiftrightunsigned(number, 32)), F.lit("/"), F.lpad(F.hex(number.bitwiseAND(F.lit(4294967295))), 8, "0"))


# --- times

#: Milliseconds from 1970-01-01 to 2000-01-01.
PG_EPOCH_MS = 946_684_800_000


def pg_us_to_unix_ms(us: Column) -> Column:
    """Microseconds since 2000 as milliseconds since 1970, not under 0."""
    thousand = F.lit(1000).cast("long")
    whole = F.when(us < 0, -((-us - F.pmod(-us, thousand)) / thousand)).otherwise((us - F.pmod(us, thousand)) / thousand)
    return F.greatest(F.lit(0).cast("long"), whole.cast("long") + F.lit(PG_EPOCH_MS))


_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$"


def iso_ms(text: Column) -> Column:
    """An ISO timestamp (space or T, fraction or none, Z, +00, +0000, +00:00 or no zone for UTC) as milliseconds; null if it isn't one.  Needs session time zone UTC."""
    t = F.replace(text, F.lit(" "), F.lit("T"))
    zoned = F.regexp_replace(F.regexp_replace(t, r"([+-][0-9]{2})$", "$1:00"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    # a date's day has the form of a zone
    at = F.when(t.rlike(r"T.*[+-][0-9]{2}(:?[0-9]{2})?$"), zoned).otherwise(t)
    return F.when(t.rlike(_TIME), F.unix_millis(F.try_to_timestamp(at)))


def wal2json_ts(text: Column) -> Column:
    """iso_ms, 0 for a missing timestamp."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(iso_ms(text))


def mysql_datetime(ts: Column) -> Column:
    """A date and time as a row event writes it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def mysql_snapshot_datetime(ts: Column) -> Column:
    """As a snapshot writes it: the date alone at midnight."""
    return F.when(ts == F.date_trunc("day", ts), F.date_format(ts, "yyyy-MM-dd")).otherwise(mysql_datetime(ts))


def mysql_time(negative: Column, days: Column, hours: Column, minutes: Column, seconds: Column, micros: Column) -> Column:
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.format_string("P%dDT%02d:%02d:%02d.%06d", days, hours, minutes, seconds, micros))


# --- values


def inferred(text: Column) -> Column:
    """What kind of JSON value a text column value becomes: struct(kind, whole, real), kind one of null, integer, real, string."""
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    real = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    real = F.when(F.abs(real) < F.lit(float("inf")), real)
    kind = F.when(text.isNull(), "null").when(whole.isNotNull(), "integer").when(real.isNotNull(), "real").otherwise("string")
    return F.struct(kind.alias("kind"), whole.alias("whole"), F.when(whole.isNull(), real).alias("real"))


def inferred_json(text: Column) -> Column:
    from .json_text import double_json, string_json

    v = inferred(text)
    return F.when(v["kind"] == "null", "null").when(v["kind"] == "integer", v["whole"].cast("string")).when(v["kind"] == "real", double_json(v["real"])).otherwise(string_json(text))


def bytea_hex(data: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(data)))


def text_or_base64(data: Column) -> Column:
    """Bytes as text where they are UTF-8, else in base64."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.base64(data))


def to_boolean(c: Column, kind: str) -> Column:
    """kind: integer, float, double, text or temporal."""
    if kind == "integer":
        return c != 0
    if kind in ("float", "double"):
        return F.abs(c) > F.lit(2.0**-23 if kind == "float" else 2.0**-52)
    if kind == "text":
        return ~c.isin("", "0", "false")
    return F.when(c.isNotNull(), F.lit(True))


# --- hashes


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Lower-case hex of HMAC-SHA-256 of UTF-8 text, all in built-in functions."""
    if not key:
        raise ValueError("a key is needed")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


# --- names

#: Fixed value: the DDL statements that change a table's schema.
DDL = r"(?i)^\s*(ALTER|CREATE|DROP|TRUNCATE|RENAME)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:`?(\w+)`?\.)?`?(\w+)`?"


def ddl_table(schema: Column, query: Column) -> Column:
    """struct(db, table) that a DDL statement changes, or null."""
    db = F.regexp_extract(query, DDL, 2)
    return F.when(query.rlike(DDL), F.struct(F.when(db != "", db).otherwise(schema).alias("db"), F.regexp_extract(query, DDL, 3).alias("table")))


def qualified(name: str, default: str = "public") -> tuple[str, str]:
    """schema and table of a name; the first dot parts them."""
    schema, dot, table = name.partition(".")
    return (schema, table) if dot else (default, name)


def qualified_column(name: Column, default: str = "public") -> Column:
    dot = F.instr(name, ".")
    return F.when(dot > 0, F.struct(F.substring(name, F.lit(1), dot - 1).alias("schema"), F.substring(name, dot + 1, F.length(name)).alias("table"))).otherwise(F.struct(F.lit(default).alias("schema"), name.alias("table")))


def mysql_qualified(name: Column, db: Column) -> Column:
    """One part: the table; two: database and table; more: the whole text is the table."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("db"), parts[1].alias("table"))).otherwise(F.struct(db.alias("db"), name.alias("table")))


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def identifier_ok(name: Column) -> Column:
    """Letters and digits of any script, _ and . only, and at least one of them."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_.]+$"), F.lit(False))


def redacted_uri(uri: Column) -> Column:
    """A connection URI without its password."""
    return F.regexp_replace(uri, r"(://[^:/@]*):[^@]*@", "$1:****@")


# --- event ids


def snapshot_id(schema: str, table: str, keys: list[str], row=None) -> Column:
    """`snap:schema.table:key=value...` (NULL for null); a table without keys gets random ids."""
    if not keys:
        return F.concat(F.lit(f"snap:{schema}.{table}:"), F.uuid())
    at = row or F.col
    return F.concat_ws(":", F.lit(f"snap:{schema}.{table}"), *(F.concat(F.lit(f"{k}="), F.coalesce(at(k).cast("string"), F.lit("NULL"))) for k in keys))


def event_id(source: Column) -> Column:
    """An id from the source: position and transaction of a log, else random (a snapshot's ids come from keys)."""
    return (
        F.when(source["binlog_file"].isNotNull(), F.concat_ws(":", source["binlog_file"], source["binlog_offset"].cast("string"), source["tx_id"]))
        .when(source["lsn"].isNotNull() & ~F.coalesce(source["snapshot"], F.lit(False)), F.concat_ws(":", source["lsn"], source["tx_id"]))
        .when(source["snapshot"], F.concat_ws(":", F.lit("snap"), F.concat_ws(".", source["schema"], source["table"]), F.uuid()))
        .otherwise(F.uuid())
    )


# --- backoff


def backoff_ms(attempt: Column, initial: int = 500, most: int = 30_000, tries: int = 10) -> Column:
    """Milliseconds to wait before a try, doubling up to a limit; null when the tries are used up."""
    doubled = F.when(attempt >= 40, F.lit(float(most))).otherwise(F.pow(F.lit(2.0), attempt) * initial)
    return F.when(attempt < tries, F.least(doubled, F.lit(float(most))).cast("long"))
