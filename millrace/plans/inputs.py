"""Inputs of the queries, derived from the driver's tables: a change log, row events, log messages, state logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lsn_format_long
from ..operators.lookup import ordinals
from ..schema import source

#: A clock for everything that a query stamps.
TS_MS = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change log: flat, four events a transaction."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    e = e.select("event_id", "user_id", "value", "props", "event_type", op.alias("op"), F.call_function("div", F.col("event_id"), F.lit(4)).alias("xid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    e = e.withColumn("lsn_num", F.lit(16777216) + F.col("xid") * 256)
    # dealt out to all cores: decoding and masking are costly for their bytes, by which alone Spark would put small logs into one task
    e = e.repartition(spark.sparkContext.defaultParallelism, "xid")
    return ordinals(e, "xid", "event_id").withColumn("lsn", lsn_format_long(F.col("lsn_num")))


def cdc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with typed images: an insert has no before image, a delete no after image."""
    c = changes(spark, sf_dir)
    before, after = F.struct("event_id", "user_id"), F.struct("event_id", "user_id", "value", "props")
    return c.select(
        "op",
        F.when(F.col("op") != "c", before).alias("before"),
        F.when(F.col("op") != "d", after).alias("after"),
        source("shop", "events", schema="public", lsn=F.col("lsn"), tx_id=F.col("xid"), ts_ms=F.col("ts_ms")).alias("source"),
        "ts_ms",
        F.concat_ws(":", "lsn", F.col("xid").cast("string"), F.col("idx").cast("string")).alias("id"),
    )


#: The same in SQL: c has the columns of changes() and id.
CDC_SQL = """
c AS (SELECT event_id, user_id, value, props, event_type,
  CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
  event_id // 4 AS xid, 16777216 + (event_id // 4) * 256 AS lsn_num, epoch_us(ts) // 1000 AS ts_ms,
  row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) - 1 AS idx,
  format('{:X}/{:08X}', (16777216 + (event_id // 4) * 256) >> 32, (16777216 + (event_id // 4) * 256) & 4294967295) AS lsn
  FROM events),
cdc AS (SELECT *, lsn || ':' || xid || ':' || idx AS id FROM c)
"""


def wal2json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as JSON text, a transaction a row: seq, payload."""
    c = changes(spark, sf_dir)
    names, values = F.array(*map(F.lit, ("event_id", "user_id", "value"))), F.array(*(F.col(x).cast("string") for x in ("event_id", "user_id", "value")))
    kind = F.create_map(F.lit("c"), F.lit("insert"), F.lit("u"), F.lit("update"), F.lit("d"), F.lit("delete"))[F.col("op")]

    def listed(items) -> F.Column:
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    quoted = F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"')))
    new = F.concat(F.lit(',"columnnames":'), listed(quoted), F.lit(',"columnvalues":'), listed(values))
    old = F.concat(F.lit(',"oldkeys":{"keynames":'), listed(F.slice(quoted, 1, 2)), F.lit(',"keyvalues":'), listed(F.slice(values, 1, 2)), F.lit("}"))
    change = F.concat(F.lit('{"kind":"'), kind, F.lit('","schema":"public","table":"events"'), F.when(F.col("op") != "d", new).otherwise(F.lit("")), F.when(F.col("op") != "c", old).otherwise(F.lit("")), F.lit("}"))
    at = F.date_format(F.timestamp_millis(F.min("ts_ms")), "yyyy-MM-dd HH:mm:ss.SSS")
    one = F.transform(F.array_sort(F.collect_list(F.struct("idx", change.alias("c")))), lambda x: x["c"])
    grouped = c.groupBy("xid").agg(one.alias("list"), at.alias("at"))
    text = F.concat(F.lit('{"xid":'), F.col("xid").cast("string"), F.lit(',"timestamp":"'), "at", F.lit('+00","change":'), listed(F.col("list")), F.lit("}"))
    return grouped.select(F.col("xid").alias("seq"), text.alias("payload"))


def pgoutput_payloads(spark: SparkSession, sf_dir: str, slots: int = 8, kind: str = "plain") -> DataFrame:
    """The change log as binary messages, a transaction a row: slot, seq, payload.  Transactions are dealt out to slots.

    kind: `extra` adds messages that are no events, and one of an unknown type at a transaction's end; `open` leaves out the commit of each slot's last
    transaction; `bad` puts a change of an unknown relation into every fiftieth transaction.
    """
    import pandas as pd

    from ..operators import pgoutput as pg

    c = changes(spark, sf_dir)
    last = c.agg(F.max("xid")).first()[0] if kind == "open" else None
    c = c.groupBy("xid").agg(F.first("lsn_num").alias("lsn"), F.array_sort(F.collect_list(F.struct("idx", "op", "event_id", "user_id", "value"))).alias("rows"))
    columns = [("event_id", 20), ("user_id", 20), ("value", 701)]

    def write(batches):
        for pdf in batches:
            out = []
            for xid, lsn, rows in zip(pdf["xid"], pdf["lsn"], pdf["rows"]):
                parts = [pg.relation(7, "public", "events", columns), pg.begin(int(lsn) - 128, 0, int(xid))]
                for r in rows:
                    new, old = [r["event_id"], r["user_id"], repr(float(r["value"]))], [r["event_id"], r["user_id"], None]
                    parts.append({"c": lambda: pg.insert(7, new), "u": lambda: pg.update(7, new, old), "d": lambda: pg.delete(7, old)}[r["op"]]())
                    if kind == "extra":
                        parts += [pg.type_name(701, "pg_catalog", "float8"), pg.origin(int(lsn), "other"), pg.truncate(7, 8)]
                if kind == "bad" and xid % 50 == 0:
                    parts.append(pg.insert(99, [1]))
                if kind != "open" or xid <= last - slots:
                    parts.append(pg.commit(int(lsn), 0))
                if kind == "extra":
                    parts.append(b"?")
                out.append((f"slot{int(xid) % slots}", int(xid), b"".join(parts)))
            yield pd.DataFrame(out, columns=["slot", "seq", "payload"])

    return c.mapInPandas(write, "slot string, seq long, payload binary")


def binlog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as row events, those of a transaction and kind together: type, rows, source."""
    c = changes(spark, sf_dir)
    kind = F.create_map(F.lit("c"), F.lit("write"), F.lit("u"), F.lit("update"), F.lit("d"), F.lit("delete"))[F.col("op")]
    image = F.struct("event_id", "user_id")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", image.alias("image")))), lambda x: F.struct(x["image"].alias("before"), x["image"].alias("after")))
    g = c.groupBy("xid", "lsn_num", kind.alias("type")).agg(rows.alias("rows"), F.min("ts_ms").alias("ts_ms"))
    return g.select("type", "rows", source("shop", "events", binlog_file="binlog.000001", binlog_offset=F.col("lsn_num"), tx_id=F.concat(F.lit("GTID-"), F.col("xid").cast("string")), ts_ms=F.col("ts_ms")).alias("source"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset for each hundredth event; every seventh of them final."""
    c = changes(spark, sf_dir).filter("event_id % 100 = 0")
    n = F.call_function("div", F.col("event_id"), F.lit(100))
    return c.select((n + 1).alias("sequence"), "lsn", F.col("xid").cast("string").alias("tx_id"), "ts_ms", (F.pmod(n, F.lit(7)) == 0).alias("is_final"))


OFFSETS_SQL = "o AS (SELECT event_id // 100 + 1 AS sequence, lsn, CAST(xid AS VARCHAR) AS tx_id, ts_ms, (event_id // 100) % 7 = 0 AS is_final FROM cdc WHERE event_id % 100 = 0)"


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of 16 chunks: events by user, the last one of each chunk decides."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("in_progress")
    return e.select(F.concat(F.lit("run"), F.pmod("user_id", F.lit(3)).cast("string")).alias("snapshot_id"), F.lit("events").alias("table"), F.pmod("user_id", F.lit(16)).alias("chunk"), F.col("event_id").alias("seq"), status.alias("status"), F.when(status == "completed", F.col("event_id") % 1000).otherwise(0).alias("rows_count"), F.lit(None).cast("string").alias("error"))


CHUNK_LOG_SQL = """
l AS (SELECT 'run' || (user_id % 3) AS snapshot_id, user_id % 16 AS chunk, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status,
  CASE event_type WHEN 'purchase' THEN event_id % 1000 ELSE 0 END AS rows_count FROM events),
s AS (SELECT snapshot_id, chunk, arg_max(status, seq) AS status, arg_max(rows_count, seq) AS rows_count FROM l GROUP BY 1, 2)
"""
