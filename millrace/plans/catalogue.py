"""Queries over the driver's tables, each with the SQL that gives the same rows.

Results are flat.  Queries run over whole tables; nothing random or of the wall clock gets into what is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.json_text import canonical_json
from ..operators import aggregates as A
from ..operators import binlog, lookup, pgoutput, transforms, wal2json
from ..operators.predicates import after, before, keeps, op_is_not, outcome, subscribed, where
from ..operators.transforms import Filter, Map, Mask, Pipeline
from ..schema import source
from ..sources import chunks, snapshot
from .inputs import CDC_SQL, CHUNK_LOG_SQL, OFFSETS_SQL, TS_MS, binlog_events, cdc_events, changes, chunk_log, offsets, pgoutput_payloads, table, wal2json_payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = b"a key for the queries"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("@cdc", CDC_SQL).replace("@offsets", OFFSETS_SQL).replace("@chunks", CHUNK_LOG_SQL)
        return f

    return add


def hmac_sql(text: str, key: bytes = KEY) -> str:
    """SQL of the lower-case hex HMAC-SHA-256 of a text."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


FLAT = ["op", "id", "ts_ms"]

# --- snapshots


@query("""SELECT 'r' AS op, c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal, 'shop' AS db, 'public' AS schema_name, 'customer' AS table_name,
  '0' AS tx_id, '0/0' AS lsn, true AS snapshot, 1700000000000 AS ts_ms, 'snap:public.customer:c_custkey=' || c_custkey AS id FROM customer""")
def snapshot_customer_events(spark, sf):
    e = snapshot.snapshot_events(table(spark, sf, "customer"), "shop", "public", "customer", ["c_custkey"], TS_MS)
    s = F.col("source")
    return e.select("op", F.col("after.c_custkey").alias("custkey"), F.col("after.c_name").alias("name"), F.col("after.c_acctbal").alias("acctbal"), s["db"].alias("db"), s["schema"].alias("schema_name"), s["table"].alias("table_name"), s["tx_id"].alias("tx_id"), s["lsn"].alias("lsn"), s["snapshot"].alias("snapshot"), "ts_ms", "id")


@query("SELECT 'r' AS op, 'snap:public.conversations:conv_id=' || conv_id || ':turn=' || turn AS id, text FROM conversations")
def snapshot_composite_pk_ids(spark, sf):
    e = snapshot.snapshot_events(table(spark, sf, "conversations"), "shop", "public", "conversations", ["conv_id", "turn"], TS_MS)
    return e.select("op", "id", F.col("after.text").alias("text"))


@query("""SELECT 'region' AS table_name, 'snap:public.region:r_regionkey=' || r_regionkey AS id, '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS image FROM region
UNION ALL SELECT 'nation', 'snap:public.nation:n_nationkey=' || n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' FROM nation
UNION ALL SELECT 'part', 'snap:public.part:p_partkey=' || p_partkey, '{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' FROM part""")
def snapshot_multi_table_union(spark, sf):
    tables = {"public.region": (table(spark, sf, "region"), ["r_regionkey"]), "public.nation": (table(spark, sf, "nation"), ["n_nationkey"]), "public.part": (table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"])}
    return snapshot.snapshot_tables(tables, "shop", TS_MS).select(F.col("source.table").alias("table_name"), "id", F.col("after").alias("image"))


@query(" UNION ALL ".join(f"SELECT 'public' AS schema_name, '{t}' AS table_name, count(*) AS total_rows FROM {t}" for t in ("customer", "nation", "orders", "region", "supplier")))
def snapshot_table_totals(spark, sf):
    names = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "region": "r_regionkey", "supplier": "s_suppkey"}
    return snapshot.table_totals(snapshot.snapshot_tables({f"public.{t}": (table(spark, sf, t).select(k), [k]) for t, k in names.items()}, "shop", TS_MS))


@query("SELECT 'run1' AS snapshot_id, '0/1000' AS position, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS total_rows, 2 AS tables_snapshotted")
def snapshot_result_row(spark, sf):
    events = snapshot.snapshot_tables({"public.region": (table(spark, sf, "region"), ["r_regionkey"]), "public.nation": (table(spark, sf, "nation"), ["n_nationkey"])}, "shop", TS_MS)
    return snapshot.snapshot_result(events, "run1", "0/1000")


@query("SELECT 'binlog.000007:4711' AS snapshot_id, 'snap:shop.orders:o_orderkey=' || o_orderkey AS id, 'binlog.000007' AS binlog_file, 4711 AS binlog_offset, '' AS schema_name FROM orders")
def snapshot_mysql_orders(spark, sf):
    e = snapshot.mysql_snapshot_events(table(spark, sf, "orders"), "shop", "orders", ["o_orderkey"], TS_MS, "binlog.000007", 4711)
    s = F.col("source")
    return e.select(F.concat_ws(":", s["binlog_file"], s["binlog_offset"].cast("string")).alias("snapshot_id"), "id", s["binlog_file"].alias("binlog_file"), s["binlog_offset"].alias("binlog_offset"), s["schema"].alias("schema_name"))


@query("SELECT doc_id, octet_length(encode(text)) AS text_bytes, octet_length(encode(text)) > 16384 AS large_row FROM documents")
def row_size_flags(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("after"))
    return snapshot.with_row_size(docs, 16384).select("doc_id", F.col("row_bytes").cast("long").alias("text_bytes"), "large_row")


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\",\"text\":' || to_json(text) || '}' AS image FROM documents")
def row_json_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    e = snapshot.snapshot_events(d, "shop", "public", "documents", ["doc_id"], TS_MS)
    return e.select(F.col("after.doc_id").alias("doc_id"), canonical_json(F.col("after"), e.schema["after"].dataType).alias("image"))


# --- chunks


@query("SELECT 'orders' AS table_name, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders UNION ALL SELECT 'customer', min(c_custkey), max(c_custkey) FROM customer UNION ALL SELECT 'part', min(p_partkey), max(p_partkey) FROM part")
def pk_min_max(spark, sf):
    parts = [chunks.key_range(table(spark, sf, t), k).select(F.lit(t).alias("table_name"), "min_key", "max_key") for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bounds(spark, sf, t, key):
    r = chunks.key_range(table(spark, sf, t), key).first()
    return r["min_key"], r["max_key"]


def plan_sql(t: str, key: str, n: int) -> str:
    return f"""WITH b AS (SELECT min({key}) AS lo, max({key}) AS hi, max({key}) - min({key}) + 1 AS len FROM {t}),
p AS (SELECT i AS chunk, lo, hi, greatest(1, len // {n}) AS size, CASE WHEN len >= {n} THEN len % {n} ELSE 0 END AS extra FROM b, range({n}) AS r(i)),
q AS (SELECT chunk, hi, lo + chunk * size + least(chunk, extra) AS start_key, size + CASE WHEN chunk < extra THEN 1 ELSE 0 END AS width FROM p)
SELECT '{t}' AS table_name, chunk, start_key, CASE WHEN start_key + width <= hi THEN start_key + width END AS end_key FROM q"""


def plan(spark, sf, t, key, n):
    return chunks.chunk_plan(spark, t, *bounds(spark, sf, t, key), n).select(F.col("table").alias("table_name"), "chunk", "start_key", "end_key")


@query(plan_sql("orders", "o_orderkey", 8))
def chunk_plan_orders(spark, sf):
    return plan(spark, sf, "orders", "o_orderkey", 8)


@query(plan_sql("region", "r_regionkey", 8))
def chunk_plan_small_range(spark, sf):
    return plan(spark, sf, "region", "r_regionkey", 8)


@query(f"WITH plan AS ({plan_sql('orders', 'o_orderkey', 8)}) SELECT 'orders' AS table_name, p.chunk, count(o.o_orderkey) AS n_rows FROM plan p LEFT JOIN orders o ON o.o_orderkey >= p.start_key AND (p.end_key IS NULL OR o.o_orderkey < p.end_key) GROUP BY 1, 2")
def chunk_row_counts(spark, sf):
    return chunks.count_rows(table(spark, sf, "orders"), "o_orderkey", *bounds(spark, sf, "orders", "o_orderkey"), 8, "orders").select(F.col("table").alias("table_name"), "chunk", "n_rows")


@query(f"""WITH plan AS ({plan_sql('events', 'user_id', 16)}),
n AS (SELECT p.chunk, count(e.user_id) AS n_rows FROM plan p LEFT JOIN events e ON e.user_id >= p.start_key AND (p.end_key IS NULL OR e.user_id < p.end_key) GROUP BY 1)
SELECT 'events' AS table_name, count(*) AS n_chunks, round(avg(n_rows), 6) AS mean_rows, round(stddev_pop(n_rows), 6) AS stddev_rows, count(*) > 1 AND avg(n_rows) > 0 AND stddev_pop(n_rows) > 2 * avg(n_rows) AS skewed FROM n""")
def chunk_skew_report(spark, sf):
    counts = chunks.count_rows(table(spark, sf, "events"), "user_id", *bounds(spark, sf, "events", "user_id"), 16, "events")
    return chunks.skew(counts).select(F.col("table").alias("table_name"), "n_chunks", F.round("mean_rows", 6).alias("mean_rows"), F.round("stddev_rows", 6).alias("stddev_rows"), "skewed")


@query(f"WITH plan AS ({plan_sql('orders', 'o_orderkey', 8)}) SELECT * FROM plan WHERE chunk NOT IN (0, 2)")
def chunk_resume_pending(spark, sf):
    full = chunks.chunk_plan(spark, "orders", *bounds(spark, sf, "orders", "o_orderkey"), 8)
    log = spark.createDataFrame([("orders", 0, "completed"), ("orders", 2, "completed"), ("orders", 3, "failed")], "table string, chunk long, status string")
    return chunks.pending(full, log).select(F.col("table").alias("table_name"), "chunk", "start_key", "end_key")


@query(f"""WITH plan AS ({plan_sql('orders', 'o_orderkey', 8)}) SELECT chunk, 'o_orderkey >= ' || start_key || CASE WHEN end_key IS NULL THEN '' ELSE ' AND o_orderkey < ' || end_key END AS predicate FROM plan""")
def chunk_where_clauses(spark, sf):
    p = chunks.chunk_plan(spark, "orders", *bounds(spark, sf, "orders", "o_orderkey"), 8)
    return p.select("chunk", chunks.where_clause(F.lit("o_orderkey"), F.col("start_key"), F.col("end_key")).alias("predicate"))


@query("WITH @chunks SELECT snapshot_id, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status <> 'completed') AS n_incomplete, CAST(coalesce(sum(rows_count) FILTER (status = 'completed'), 0) AS BIGINT) AS total_rows FROM s GROUP BY 1")
def chunk_status_rollup(spark, sf):
    return A.chunk_rollup(A.chunk_states(chunk_log(spark, sf)))


@query("WITH @chunks SELECT snapshot_id, chunk, CASE status WHEN 'completed' THEN 'completed (' || rows_count || ' rows)' WHEN 'failed' THEN 'failed: lost' ELSE status END AS status_text FROM s")
def chunk_status_text(spark, sf):
    s = A.chunk_states(chunk_log(spark, sf))
    return s.select("snapshot_id", "chunk", chunks.status_text(F.col("status"), F.col("rows_count"), F.lit("lost")).alias("status_text"))


# --- scalars


@query("WITH @cdc SELECT event_id, lsn, format('{:X}/{:08X}', event_id * 7919 * 65537 >> 32, event_id * 7919 * 65537 & 4294967295) AS wide FROM cdc")
def lsn_format(spark, sf):
    n = F.col("event_id") * 7919 * 65537
    return changes(spark, sf).select("event_id", S.lsn_format(F.col("lsn_num")).alias("lsn"), S.lsn_format_long(n).alias("wide"))


@query("WITH @cdc SELECT event_id, lsn_num, lsn_num > 16777216 + 4194304 AS later, lsn > '1/00000000' AS later_as_text FROM cdc")
def lsn_parse_order(spark, sf):
    n = S.lsn_parse(F.col("lsn"))
    return changes(spark, sf).select("event_id", n.cast("long").alias("lsn_num"), (n > S.lsn_parse(F.lit("0/1400000"))).alias("later"), (F.col("lsn") > "1/00000000").alias("later_as_text"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 WHEN event_id % 3 = 1 THEN 0 ELSE 946684800000 - (event_id // 1000) END AS unix_ms FROM events""")
def pg_epoch_to_unix_ms(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(S.PG_EPOCH_MS * 1000)
    k = F.pmod("event_id", F.lit(3))
    value = F.when(k == 0, us).when(k == 1, F.lit(-(10**17))).otherwise(-F.col("event_id"))
    return table(spark, sf, "events").select("event_id", S.pg_us_to_unix_ms(value).alias("unix_ms"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE epoch_us(ts) // 1000 END AS ms FROM events")
def wal2json_timestamp_parse(spark, sf):
    ts = F.col("ts").cast("timestamp")
    k = F.pmod("event_id", F.lit(5))
    text = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS'+00'"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
        .when(k == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(F.lit("yesterday"))
    )
    return table(spark, sf, "events").select("event_id", S.wal2json_ts(text).alias("ms"))


@query("WITH @cdc SELECT event_id, id FROM cdc")
def event_id_streaming(spark, sf):
    c = changes(spark, sf)
    return c.select("event_id", F.concat_ws(":", "lsn", F.col("xid").cast("string"), F.col("idx").cast("string")).alias("id"))


@query("WITH @cdc SELECT event_id, lsn || ':' || xid AS log_id, 'binlog.000001:' || lsn_num || ':GTID-' || xid AS binlog_id FROM cdc")
def event_id_builder(spark, sf):
    c = changes(spark, sf)
    log = source("shop", "events", schema="public", lsn=F.col("lsn"), tx_id=F.col("xid"))
    row = source("shop", "events", binlog_file="binlog.000001", binlog_offset=F.col("lsn_num"), tx_id=F.concat(F.lit("GTID-"), F.col("xid").cast("string")))
    return c.select("event_id", S.event_id(log).alias("log_id"), S.event_id(row).alias("binlog_id"))


@query("WITH @cdc SELECT event_id, xid, idx FROM cdc")
def txn_ordinal(spark, sf):
    return changes(spark, sf).select("event_id", "xid", F.col("idx").cast("long").alias("idx"))


@query("SELECT user_id, count(*) AS n_events FROM events GROUP BY 1 HAVING count(*) > 12")
def txn_size_limit(spark, sf):
    return lookup.too_large(table(spark, sf, "events"), "user_id", 12)


@query(r"""WITH v(t) AS (VALUES ('42'), ('-7'), ('+5'), ('007'), ('9223372036854775807'), ('9223372036854775808'), ('3.14'), ('1e3'), ('-2.5E-3'), ('.5'), ('5.'), (' 42'), ('3.14d'), ('t'), ('f'), (''), ('inf'), ('NaN'), ('1e999'), ('Widget'), ('1_000'), ('0x10'), (NULL)),
a AS (SELECT t FROM v UNION ALL SELECT c_name FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer),
b AS (SELECT t, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS whole,
  CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END AS r FROM a)
SELECT t, CASE WHEN t IS NULL THEN 'null' WHEN whole IS NOT NULL THEN 'integer' WHEN r IS NOT NULL THEN 'real' ELSE 'string' END AS kind, whole, CASE WHEN whole IS NULL THEN r END AS real_value FROM b""")
def infer_text_value(spark, sf):
    values = ["42", "-7", "+5", "007", "9223372036854775807", "9223372036854775808", "3.14", "1e3", "-2.5E-3", ".5", "5.", " 42", "3.14d", "t", "f", "", "inf", "NaN", "1e999", "Widget", "1_000", "0x10", None]
    c = table(spark, sf, "customer")
    a = spark.createDataFrame([(v,) for v in values], "t string").union(c.select("c_name")).union(c.select(F.col("c_custkey").cast("string")))
    v = S.inferred(F.col("t"))
    return a.select("t", v["kind"].alias("kind"), v["whole"].alias("whole"), v["real"].alias("real_value"))


@query("SELECT p_partkey, '\\x' || lower(hex(encode(p_name))) AS name_hex FROM part")
def bytea_hex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.bytea_hex(F.col("p_name").cast("binary")).alias("name_hex"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE base64(unhex('FF') || encode(p_name)) END AS name_text FROM part")
def text_or_base64(spark, sf):
    data = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.col("p_name").cast("binary")).otherwise(F.concat(F.lit(b"\xff"), F.col("p_name").cast("binary")))
    return table(spark, sf, "part").select("p_partkey", S.text_or_base64(data).alias("name_text"))


@query(f"SELECT c_custkey, {hmac_sql('c_name')} AS mac FROM customer")
def hmac_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.hmac_sha256(F.col("c_name"), KEY).alias("mac"))


STATEMENTS = ["ALTER TABLE users ADD x int", "create table if not exists `shop`.`orders` (id int)", "DROP TABLE IF EXISTS shop.items", "  truncate table events", "RENAME TABLE a TO b", "INSERT INTO users VALUES (1)", "ALTER VIEW v AS SELECT 1", "CREATE TABLE shop.`big one` (id int)"]


@query("WITH q(query) AS (VALUES " + ", ".join("('" + s.replace("'", "''") + "')" for s in STATEMENTS) + r"""),
m AS (SELECT query, regexp_matches(query, '(?i)^\s*(ALTER|CREATE|DROP|TRUNCATE|RENAME)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:`?(\w+)`?\.)?`?(\w+)`?') AS hit,
  regexp_extract(query, '(?i)^\s*(ALTER|CREATE|DROP|TRUNCATE|RENAME)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:`?(\w+)`?\.)?`?(\w+)`?', ['verb', 'db', 'tab']) AS g FROM q)
SELECT query, CASE WHEN hit THEN coalesce(nullif(g.db, ''), 'main') END AS db, CASE WHEN hit THEN g.tab END AS table_name FROM m""")
def ddl_detect(spark, sf):
    d = S.ddl_table(F.lit("main"), F.col("query"))
    return spark.createDataFrame([(s,) for s in STATEMENTS], "query string").select("query", d["db"].alias("db"), d["table"].alias("table_name"))


@query("WITH v(name) AS (VALUES ('users'), ('public.users'), ('a.b.c'), ('sales.orders')) SELECT name, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE 'public' END AS schema_name, CASE WHEN contains(name, '.') THEN substr(name, instr(name, '.') + 1) ELSE name END AS table_name, CASE WHEN len(string_split(name, '.')) = 2 THEN split_part(name, '.', 2) ELSE name END AS mysql_table FROM v")
def qualified_names(spark, sf):
    v = spark.createDataFrame([("users",), ("public.users",), ("a.b.c",), ("sales.orders",)], "name string")
    q, m = S.qualified_column(F.col("name")), S.mysql_qualified(F.col("name"), F.lit("shop"))
    return v.select("name", q["schema"].alias("schema_name"), q["table"].alias("table_name"), m["table"].alias("mysql_table"))


@query("WITH v(uri) AS (VALUES ('postgres://bob:secret@db:5432/shop'), ('mysql://root@h/x'), ('mysql://a:b:c@h:1/x')) SELECT regexp_replace(uri, '(://[^:/@]*):[^@]*@', '\\1:****@') AS uri FROM v")
def redacted_uris(spark, sf):
    return spark.createDataFrame([("postgres://bob:secret@db:5432/shop",), ("mysql://root@h/x",), ("mysql://a:b:c@h:1/x",)], "uri string").select(S.redacted_uri(F.col("uri")).alias("uri"))


@query("SELECT i AS attempt, CASE WHEN i < 10 THEN CAST(least(500 * pow(2, i), 30000) AS BIGINT) END AS wait_ms FROM range(12) AS r(i)")
def backoff_schedule(spark, sf):
    return spark.range(12).select(F.col("id").alias("attempt"), S.backoff_ms(F.col("id")).alias("wait_ms"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS row_text, CASE WHEN o_orderdate = date_trunc('day', o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END AS snapshot_text, (CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '' END) || format('P{:d}DT{:02d}:{:02d}:{:02d}.{:06d}', o_orderkey % 30, o_orderkey % 24, o_orderkey % 60, o_orderkey % 59, o_orderkey % 1000000) AS time_text FROM orders")
def mysql_datetime_format(spark, sf):
    k = F.col("o_orderkey")
    parts = [F.pmod(k, F.lit(n)).cast("int") for n in (30, 24, 60, 59, 1000000)]
    return table(spark, sf, "orders").select("o_orderkey", S.mysql_datetime(F.col("o_orderdate")).alias("row_text"), S.mysql_snapshot_datetime(F.col("o_orderdate")).alias("snapshot_text"), S.mysql_time(F.pmod(k, F.lit(2)) == 1, *parts).alias("time_text"))


@query("""WITH t(data_type, column_type, target) AS (VALUES
  ('tinyint', 'TINY', 'number'), ('smallint', 'SHORT', 'number'), ('mediumint', 'INT24', 'number'), ('int', 'LONG', 'number'), ('integer', 'LONG', 'number'), ('bigint', 'LONGLONG', 'number'),
  ('float', 'FLOAT', 'number'), ('double', 'DOUBLE', 'number'), ('decimal', 'NEWDECIMAL', 'string'), ('numeric', 'NEWDECIMAL', 'string'),
  ('char', 'STRING', 'default'), ('varchar', 'VARCHAR', 'default'), ('binary', 'BLOB', 'default'), ('varbinary', 'VARCHAR', 'default'),
  ('tinyblob', 'TINY_BLOB', 'default'), ('tinytext', 'TINY_BLOB', 'default'), ('blob', 'BLOB', 'default'), ('text', 'BLOB', 'default'),
  ('mediumblob', 'MEDIUM_BLOB', 'default'), ('mediumtext', 'MEDIUM_BLOB', 'default'), ('longblob', 'LONG_BLOB', 'default'), ('longtext', 'LONG_BLOB', 'default'),
  ('json', 'JSON', 'default'), ('enum', 'ENUM', 'default'), ('set', 'SET', 'default'), ('date', 'DATE', 'default'), ('time', 'TIME', 'default'), ('datetime', 'DATETIME', 'default'),
  ('timestamp', 'TIMESTAMP', 'default'), ('year', 'YEAR', 'number'), ('bit', 'BIT', 'number'), ('geometry', 'GEOMETRY', 'default'), ('hyperspace', 'STRING', 'default'))
SELECT data_type, unsigned, column_type, CASE WHEN data_type = 'bigint' AND unsigned THEN 'string' ELSE target END AS json_target FROM t, (VALUES (true), (false)) AS u(unsigned)""")
def mysql_json_target(spark, sf):
    v = spark.createDataFrame([(k, u) for k in [*binlog.COLUMN_TYPES, "hyperspace"] for u in (True, False)], "data_type string, unsigned boolean")
    return v.select("data_type", "unsigned", binlog.column_type(F.col("data_type")).alias("column_type"), binlog.json_target(F.col("data_type"), F.col("unsigned")).alias("json_target"))


@query("""SELECT o_orderkey, '{"big":"' || o_orderkey || '","flag":' || CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END || ',"n":' || o_orderkey % 7 || ',"none":null,"s":"' || o_orderstatus || '"}' AS image FROM orders""")
def mysql_row_json(spark, sf):
    null = {"bytes": "binary", "int": "bigint", "uint": "decimal(20,0)", "float": "float", "double": "double", "date": "timestamp_ntz", "time": "struct<negative: boolean, days: int, hours: int, minutes: int, seconds: int, micros: int>"}

    def value(**given):
        return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in null.items()))

    k = F.col("o_orderkey")
    values = F.array(value(uint=k), value(int=F.pmod(k, F.lit(3))), value(int=F.pmod(k, F.lit(7))), value(), value(bytes=F.col("o_orderstatus").cast("binary")))
    names, targets = F.array(*map(F.lit, ("big", "flag", "n", "none", "s"))), F.array(*map(F.lit, ("string", "boolean", "number", "default", "default")))
    return table(spark, sf, "orders").select("o_orderkey", binlog.row_json(values, names, targets).alias("image"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS from_int, abs(c_acctbal) > 2.220446049250313e-16 AS from_double, c_mktsegment NOT IN ('', '0', 'false') AS from_text FROM customer")
def boolean_coercion(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.to_boolean(F.pmod("c_custkey", F.lit(3)), "integer").alias("from_int"), S.to_boolean(F.col("c_acctbal"), "double").alias("from_double"), S.to_boolean(F.col("c_mktsegment"), "text").alias("from_text"))


# --- filters


def flat(events: DataFrame) -> DataFrame:
    return events.select("op", "id", "ts_ms")


def filtered(spark, sf, test) -> DataFrame:
    e = cdc_events(spark, sf)
    return flat(e.filter(keeps(test, e)))


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc WHERE op <> 'd'")
def filter_not_delete(spark, sf):
    return filtered(spark, sf, op_is_not("d"))


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc WHERE op = 'd' OR coalesce(value > 50, false)")
def filter_after_threshold(spark, sf):
    return filtered(spark, sf, after("value") > 50)


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc WHERE op = 'c' OR user_id = 7")
def filter_absent_image_passes(spark, sf):
    return filtered(spark, sf, before("user_id") == 7)


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc WHERE op = 'd'")
def filter_missing_leaf_drops(spark, sf):
    return filtered(spark, sf, after("status") == "active")


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc WHERE op = 'c' AND value > 20 OR op <> 'c' AND (op = 'd' OR value > 80)")
def filter_and_or(spark, sf):
    return filtered(spark, sf, (where("op = 'c'") & (after("value") > 20)) | (where("op <> 'c'") & (after("value") > 80)))


@query("WITH @cdc SELECT op, CASE WHEN op = 'd' THEN 'error' WHEN value > 50 THEN 'pass' ELSE 'dropped' END AS outcome, count(*) AS n FROM cdc GROUP BY ALL")
def filter_outcomes(spark, sf):
    e = cdc_events(spark, sf)
    return e.select("op", outcome(after("value") > 50, e).alias("outcome")).groupBy("op", "outcome").agg(F.count("*").alias("n"))


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc WHERE op IN ('c', 'u') AND (lsn_num, idx) > (16777216 + 25600, 1)")
def subscribe_filter(spark, sf):
    e = cdc_events(spark, sf).withColumns({"lsn_num": S.lsn_parse(F.col("source.lsn")).cast("long"), "idx": F.split_part("id", F.lit(":"), F.lit(-1)).cast("long")})
    return flat(subscribed(e, ["public.events"], ["c", "u"], (16777216 + 25600, 1), ["lsn_num", "idx"]))


# --- maps


def mapped(spark, sf, change, *columns) -> DataFrame:
    return Pipeline([Map(change)]).apply(cdc_events(spark, sf)).select("op", "id", *columns)


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN value * 2 END AS doubled FROM cdc")
def map_add_field(spark, sf):
    return mapped(spark, sf, lambda e: {"after": e["after"].withField("doubled", e["after"]["value"] * 2)}, F.col("after.doubled").alias("doubled"))


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' END AS image FROM cdc")
def map_remove_field(spark, sf):
    out = Pipeline([Map(lambda e: {"after": e["after"].dropFields("props", "value")})]).apply(cdc_events(spark, sf))
    return out.select("op", "id", canonical_json(F.col("after"), out.schema["after"].dataType).alias("image"))


@query("WITH @cdc SELECT CASE WHEN op = 'u' THEN 'c' ELSE op END AS op, id FROM cdc")
def map_change_op(spark, sf):
    return mapped(spark, sf, lambda e: {"op": F.when(e["op"] == "u", "c").otherwise(e["op"])})


@query("WITH @cdc SELECT op, id, 'archive' AS table_name FROM cdc")
def map_change_table(spark, sf):
    return mapped(spark, sf, lambda e: {"source": e["source"].withField("table", F.lit("archive"))}, F.col("source.table").alias("table_name"))


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN user_id END AS who FROM cdc")
def map_replace_after(spark, sf):
    return mapped(spark, sf, lambda e: {"after": F.when(e["after"].isNotNull(), F.struct(e["after"]["user_id"].alias("who")))}, F.col("after.who").alias("who"))


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'c' THEN -user_id END AS before_user FROM cdc")
def map_edit_before(spark, sf):
    return mapped(spark, sf, lambda e: {"before": e["before"].withField("user_id", -e["before"]["user_id"])}, F.col("before.user_id").alias("before_user"))


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN value + 1 END AS value, false AS failed FROM cdc")
def map_python_function(spark, sf):
    """The way out: a Python function over the JSON event."""

    def change(event):
        if event["after"]:
            event["after"]["value"] += 1
        return event

    e = cdc_events(spark, sf)
    text = e.withColumns({c: canonical_json(F.col(c), e.schema[c].dataType) for c in ("before", "after")})
    out = transforms.mapped(change, text)
    return out.select("op", "id", F.get_json_object("after", "$.value").cast("double").alias("value"), F.col("_error").isNotNull().alias("failed"))


# --- masks


def customers(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("profile"))
    return snapshot.snapshot_events(c, "shop", "public", "customer", ["c_custkey"], TS_MS)


def masked(spark, sf, paths, strategy="redact", key=None) -> DataFrame:
    out = Pipeline([Mask(paths, strategy, key)]).run(customers(spark, sf))
    return out.select("id", F.col("after.c_name").alias("name"), F.col("after.profile.segment").alias("segment"), (F.col("_outcome") == "modified").alias("modified"))


CUSTOMER_SQL = "SELECT 'snap:public.customer:c_custkey=' || c_custkey AS id, {name} AS name, {segment} AS segment, {modified} AS modified FROM customer"


@query(CUSTOMER_SQL.format(name="'***REDACTED***'", segment="c_mktsegment", modified="true"))
def mask_redact(spark, sf):
    return masked(spark, sf, ["c_name"])


@query(CUSTOMER_SQL.format(name="CAST(NULL AS VARCHAR)", segment="c_mktsegment", modified="true"))
def mask_null(spark, sf):
    return masked(spark, sf, ["c_name"], "null")


@query(CUSTOMER_SQL.format(name=hmac_sql("'\"' || c_name || '\"'"), segment="c_mktsegment", modified="true"))
def mask_hash(spark, sf):
    return masked(spark, sf, ["c_name"], "hash", KEY)


@query(CUSTOMER_SQL.format(name="c_name", segment=hmac_sql("'\"' || c_mktsegment || '\"'"), modified="true"))
def mask_nested_path(spark, sf):
    return masked(spark, sf, ["profile.segment"], "hash", KEY)


@query(CUSTOMER_SQL.format(name=hmac_sql("'\"' || c_name || '\"'"), segment="c_mktsegment", modified="true"))
def mask_duplicate_paths(spark, sf):
    return masked(spark, sf, ["c_name", "c_name", "c_name"], "hash", KEY)


@query(CUSTOMER_SQL.format(name="c_name", segment="c_mktsegment", modified="false"))
def mask_bad_paths_noop(spark, sf):
    return masked(spark, sf, ["", "a..b", ".c_name", "c_name.", "missing", "c_name.inner", "profile.missing"])


@query(f"WITH @cdc SELECT op, id, CASE WHEN op <> 'c' THEN {hmac_sql('CAST(user_id AS VARCHAR)')} END AS before_user, CASE WHEN op <> 'd' THEN {hmac_sql('CAST(user_id AS VARCHAR)')} END AS after_user FROM cdc")
def mask_before_and_after(spark, sf):
    out = Pipeline([Mask(["user_id"], "hash", KEY)]).apply(cdc_events(spark, sf))
    return out.select("op", "id", F.col("before.user_id").alias("before_user"), F.col("after.user_id").alias("after_user"))


@query(f"WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN '{{\"event_id\":' || event_id || ',\"user_id\":\"' || {hmac_sql('CAST(user_id AS VARCHAR)')} || '\"}}' END AS image FROM cdc")
def mask_json_text(spark, sf):
    """Images of unknown type, as JSON text."""
    e = cdc_events(spark, sf)
    text = F.when(F.col("after").isNotNull(), F.concat(F.lit('{"event_id":'), F.col("after.event_id").cast("string"), F.lit(',"user_id":'), F.col("after.user_id").cast("string"), F.lit("}")))
    e = e.withColumns({"after": text, "before": F.lit(None).cast("string")})
    return Pipeline([Mask(["user_id", "nowhere.at"], "hash", KEY)]).apply(e).select("op", "id", F.col("after").alias("image"))


# --- validation, routing, pipelines

BLANKS_SQL = """b AS (SELECT event_id, op, CASE WHEN event_id % 11 = 0 THEN '' ELSE id END AS new_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'shop' END AS db,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE 'public' END AS schema_name, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'events' END AS table_name, id FROM cdc),
e AS (SELECT *, CASE WHEN new_id = '' THEN 'event id is empty' WHEN db = '' THEN 'source.db is empty' WHEN schema_name = '' THEN 'source.schema is empty' WHEN table_name = '' THEN 'source.table is empty' END AS error FROM b)"""


def spoil(e):
    n = F.coalesce(e["after"]["event_id"], e["before"]["event_id"])

    def blank(c, k):
        return F.when(F.pmod(n, F.lit(k)) == 0, "").otherwise(c)

    s = e["source"]
    return {"id": blank(e["id"], 11), "source": s.withField("db", blank(s["db"], 13)).withField("schema", blank(s["schema"], 17)).withField("table", blank(s["table"], 19))}


@query(f"WITH @cdc, {BLANKS_SQL} SELECT event_id, error FROM e")
def validate_envelope_errors(spark, sf):
    e = cdc_events(spark, sf)
    made = spoil({c: F.col(c) for c in e.columns})
    return e.select(F.coalesce("after.event_id", "before.event_id").alias("event_id"), transforms.envelope_error(made["source"], made["id"]).alias("error"))


@query(f"WITH @cdc, {BLANKS_SQL} SELECT op, id, 'shop' AS db FROM e")
def route_errors_open(spark, sf):
    return Pipeline([Map(spoil)]).apply(cdc_events(spark, sf)).select("op", "id", F.col("source.db").alias("db"))


@query(f"WITH @cdc, {BLANKS_SQL} SELECT op, id, 'shop' AS db FROM e WHERE error IS NULL")
def route_errors_closed(spark, sf):
    return Pipeline([Map(spoil)], fail_closed=True).apply(cdc_events(spark, sf)).select("op", "id", F.col("source.db").alias("db"))


@query(f"WITH @cdc, {BLANKS_SQL} SELECT op, id, error, 0 AS step FROM e WHERE error IS NOT NULL")
def dead_letter_events(spark, sf):
    return Pipeline([Map(spoil)], fail_closed=True).dead_letters(cdc_events(spark, sf)).select("op", "id", "error", "step")


@query(f"SELECT 'r' AS op, 'snap:public.customer:c_custkey=' || c_custkey AS id, c_custkey AS custkey, {hmac_sql(chr(39) + chr(34) + chr(39) + ' || c_name || ' + chr(39) + chr(34) + chr(39))} AS name, c_acctbal > 0 AS in_credit FROM customer")
def pipeline_filter_map_mask(spark, sf):
    events = snapshot.snapshot_events(table(spark, sf, "customer"), "shop", "public", "customer", ["c_custkey"], TS_MS)
    steps = [Filter(op_is_not("d")), Map(lambda e: {"after": e["after"].withField("in_credit", e["after"]["c_acctbal"] > 0)}), Mask(["c_name"], "hash", KEY)]
    out = Pipeline(steps).apply(events)
    return out.select("op", "id", F.col("after.c_custkey").alias("custkey"), F.col("after.c_name").alias("name"), F.col("after.in_credit").alias("in_credit"))


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN '***REDACTED***' END AS props FROM cdc WHERE op <> 'c'")
def pipeline_from_configuration(spark, sf):
    made = transforms.pipeline_from_config({"failClosed": True, "pipeline": [{"type": "filter", "expression": "op <> 'c'"}, {"type": "map", "set": {"source.table": "'renamed'"}}, {"type": "mask", "fields": ["props"]}]})
    return made.apply(cdc_events(spark, sf)).select("op", "id", F.col("after.props").alias("props"))


# --- decoders


@query("""WITH @cdc, t AS (SELECT xid, min(ts_ms) AS t0 FROM cdc GROUP BY 1)
SELECT op, xid || ':' || idx AS id, 'public' AS schema_name, 'events' AS table_name, t0 AS ts_ms, CASE WHEN op <> 'd' THEN event_id END AS after_id, CASE WHEN op <> 'd' THEN value END AS after_value, CASE WHEN op <> 'c' THEN user_id END AS before_user, CAST(NULL AS VARCHAR) AS error FROM cdc JOIN t USING (xid)""")
def wal2json_decode(spark, sf):
    e = wal2json.decode(wal2json_payloads(spark, sf), "shop")
    return e.select("op", "id", F.col("source.schema").alias("schema_name"), F.col("source.table").alias("table_name"), "ts_ms", F.get_json_object("after", "$.event_id").cast("long").alias("after_id"), F.get_json_object("after", "$.value").cast("double").alias("after_value"), F.get_json_object("before", "$.user_id").cast("long").alias("before_user"), "error")


@query("SELECT * FROM (VALUES ('invalid JSON', 1), ('missing change array', 1), ('change without kind or table', 1), ('event', 1)) AS v(what, n)")
def wal2json_errors(spark, sf):
    texts = ['{"xid":1,', '{"xid":2}', '{"xid":3,"change":[{"kind":"insert"}]}', '{"xid":4,"timestamp":"2024-05-31 12:00:00+00","change":[{"kind":"insert","table":"t","columnnames":["a"],"columnvalues":[1]},{"kind":"message"}]}', "", "  "]
    e = wal2json.decode(spark.createDataFrame([(t,) for t in texts], "payload string"), "shop")
    return e.groupBy(F.coalesce("error", F.lit("event")).alias("what")).agg(F.count("*").alias("n"))


@query("""WITH @cdc, r AS (SELECT *, row_number() OVER (PARTITION BY xid, op ORDER BY idx) - 1 AS row FROM cdc)
SELECT op, 'binlog.000001:' || lsn_num || ':GTID-' || xid || ':' || row AS id, CASE WHEN op <> 'c' THEN user_id END AS before_user, CASE WHEN op <> 'd' THEN event_id END AS after_id, '' AS schema_name FROM r""")
def binlog_rows_to_events(spark, sf):
    e = binlog.decode(binlog_events(spark, sf))
    return e.select("op", "id", F.col("before.user_id").alias("before_user"), F.col("after.event_id").alias("after_id"), F.col("source.schema").alias("schema_name"))


PGOUTPUT_SQL = "WITH @cdc SELECT op, id, lsn, CAST(xid AS VARCHAR) AS tx_id, 'public' AS schema_name, 'events' AS table_name, CASE WHEN op <> 'd' THEN event_id END AS after_id, CASE WHEN op <> 'd' THEN value END AS after_value, CASE WHEN op <> 'c' THEN user_id END AS before_user, CAST(NULL AS VARCHAR) AS error FROM cdc"


def pgoutput_flat(e: DataFrame) -> DataFrame:
    return e.select("op", "id", "lsn", "tx_id", "schema_name", "table_name", F.get_json_object("after", "$.event_id").cast("long").alias("after_id"), F.get_json_object("after", "$.value").cast("double").alias("after_value"), F.get_json_object("before", "$.user_id").cast("long").alias("before_user"), "error")


@query(PGOUTPUT_SQL)
def pgoutput_decode_roundtrip(spark, sf):
    return pgoutput_flat(pgoutput.decode(pgoutput_payloads(spark, sf), "shop"))


@query("WITH r AS (SELECT event_id, user_id % 50 AS relation_id, event_type FROM events WHERE event_type = 'signup') SELECT e.event_id, e.user_id % 50 AS relation_id, r.event_id AS relation_seq FROM events e ASOF JOIN r ON e.user_id % 50 = r.relation_id AND e.event_id >= r.event_id WHERE e.event_type <> 'signup'")
def relation_asof_schema(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.pmod("user_id", F.lit(50)).alias("relation_id"), "event_type")
    relations = e.filter("event_type = 'signup'").select("relation_id", "seq", F.col("seq").alias("announced"))
    known, _ = lookup.with_relation(e.filter("event_type <> 'signup'"), relations)
    return known.select(F.col("seq").alias("event_id"), "relation_id", F.col("relation.announced").alias("relation_seq"))


@query("SELECT 1 AS table_id, 'id' AS key_name, 1 AS place UNION ALL SELECT 2, 'conv_id', 1 UNION ALL SELECT 2, 'turn', 2")
def primary_key_columns(spark, sf):
    indexes = spark.createDataFrame([(1, True, [1]), (1, False, [2]), (2, True, [2, 1])], "table_id int, is_primary boolean, key_places array<int>")
    attributes = spark.createDataFrame([(1, 1, "id"), (1, 2, "name"), (2, 1, "conv_id"), (2, 2, "turn"), (2, 3, "text")], "table_id int, place int, name string")
    keys = lookup.primary_keys(indexes, attributes)
    return keys.select("table_id", F.posexplode("keys").alias("p", "key_name")).select("table_id", "key_name", (F.col("p") + 1).alias("place"))


@query("WITH @cdc SELECT op, id FROM cdc")
def log_decoder_by_plugin(spark, sf):
    from ..operators.decoders import decode_log

    return decode_log("pgoutput", pgoutput_payloads(spark, sf), "shop").select("op", "id")


@query("""WITH m AS (SELECT event_id, user_id % 20 AS table_id, event_type FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id % 20 AS table_id, m.event_id AS map_seq FROM events e ASOF JOIN m ON e.user_id % 20 = m.table_id AND e.event_id >= m.event_id WHERE e.event_type = 'click'""")
def table_map_lookup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.pmod("user_id", F.lit(20)).alias("table_id"), "event_type")
    maps = e.filter("event_type = 'purchase'").select("table_id", "seq", F.col("seq").alias("map_seq"))
    return binlog.with_table_map(e.filter("event_type = 'click'"), maps).select(F.col("seq").alias("event_id"), "table_id", F.col("table_map.map_seq").alias("map_seq"))


@query("WITH @cdc SELECT op, id, CAST(ts_ms AS DOUBLE) AS ts, lsn FROM cdc")
def script_projection(spark, sf):
    from ..operators.projections import for_scripts

    return for_scripts(cdc_events(spark, sf)).select("op", "id", F.col("tsMs").alias("ts"), F.col("source.lsn").alias("lsn"))


@query("WITH @cdc SELECT 'r' AS op, lsn || ':' || xid AS id, event_id FROM cdc")
def built_events(spark, sf):
    from ..operators.projections import built

    e = cdc_events(spark, sf).drop("id", "op")
    return built(e).select("op", "id", F.coalesce("after.event_id", "before.event_id").alias("event_id"))


@query("SELECT 'customer' AS table_name, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS names UNION ALL SELECT 'region', 'r_regionkey,r_name'")
def columns_by_table(spark, sf):
    rows = [(t, i, f.name, f.dataType.simpleString()) for t in ("customer", "region") for i, f in enumerate(table(spark, sf, t).schema.fields)]
    cols = A.columns_by_table(spark.createDataFrame(rows[::-1], "table_name string, position int, name string, type string"))
    return cols.select("table_name", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"))


# --- state


@query("WITH @cdc, @offsets SELECT * FROM o ORDER BY is_final DESC, sequence DESC LIMIT 1")
def offset_last_reference(spark, sf):
    return A.last_offset(offsets(spark, sf), "reference")


@query("WITH @cdc, @offsets SELECT * FROM o ORDER BY sequence DESC LIMIT 1")
def offset_last_latest(spark, sf):
    return A.last_offset(offsets(spark, sf), "latest")


@query("WITH @cdc, @offsets SELECT coalesce(max(sequence), 0) + 1 AS next_sequence FROM o")
def offset_next_sequence(spark, sf):
    return A.next_sequence(offsets(spark, sf))


@query("SELECT 't' || (user_id % 20) AS table_name, CAST(arg_max(event_id, event_id) AS VARCHAR) AS last_key, count(*) AS rows, bool_or(event_type = 'purchase' AND value > 90) AS completed FROM events GROUP BY 1")
def snapshot_progress_fold(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    name = F.concat(F.lit("t"), F.pmod("user_id", F.lit(20)).cast("string"))
    running = F.row_number().over(Window.partitionBy("table_name").orderBy("event_id"))
    log = e.select(name.alias("table_name"), "event_id", "event_type", "value").select("table_name", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("last_key"), running.cast("long").alias("rows"), ((F.col("event_type") == "purchase") & (F.col("value") > 90)).alias("completed"))
    return A.snapshot_progress(log)


@query("SELECT event_type AS table_name, md5(CAST(max(event_id) AS VARCHAR)) AS schema_hash, count(*) AS version FROM events GROUP BY 1")
def schema_cache_version(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("table_name"), F.col("event_id").alias("seq"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("schema_hash"))
    return A.schema_versions(log)


@query("SELECT 'k' || (user_id % 10) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def instance_info_latest(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit("k"), F.pmod("user_id", F.lit(10)).cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return A.latest_values(log)


@query("WITH @cdc SELECT op, count(*) AS n_events FROM cdc GROUP BY 1")
def event_totals_by_op(spark, sf):
    return A.totals_by_op(cdc_events(spark, sf))


@query("WITH @cdc SELECT ts_ms // 1000 AS second, count(*) AS n_events FROM cdc GROUP BY 1")
def events_per_second(spark, sf):
    return A.per_second(cdc_events(spark, sf))


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc")
def dedup_by_event_id(spark, sf):
    e = flat(cdc_events(spark, sf))
    return A.distinct_events(e.unionByName(e))


@query("WITH @cdc SELECT 'ok' AS status, 5000 AS uptime_ms, count(*) AS events_captured, arg_max(lsn, lsn_num) AS current_lsn, 0 AS lag_ms, 'streaming' AS state FROM cdc")
def health_row(spark, sf):
    return A.health(cdc_events(spark, sf), 5000)


@query("""WITH @cdc SELECT 'change' AS event, id, 'event: change' || chr(10) || 'id: ' || id || chr(10) || 'data: {"after":' || CASE WHEN op = 'd' THEN 'null' ELSE '{"event_id":' || event_id || ',"user_id":' || user_id || '}' END || ',"before":' || CASE WHEN op = 'c' THEN 'null' ELSE '{"event_id":' || event_id || ',"user_id":' || user_id || '}' END ||
  ',"id":"' || id || '","op":"' || op || '","source":{"db":"shop","lsn":"' || lsn || '","schema":"public","table":"events","ts_ms":' || ts_ms || ',"tx_id":"' || xid || '"},"ts_ms":' || ts_ms || '}' || chr(10) || chr(10) AS frame FROM cdc""")
def sse_frames(spark, sf):
    from ..streaming.sinks import change_frames

    e = cdc_events(spark, sf)
    e = e.withColumn("after", e["after"].dropFields("value", "props"))
    return change_frames(e.withColumns({c: canonical_json(F.col(c), e.schema[c].dataType) for c in ("before", "after")}))


# --- inspection


@query("SELECT name, ts FROM (VALUES ('integer', 'number'), ('double precision', 'number'), ('boolean', 'boolean'), ('text', 'string'), ('uuid', 'string'), ('jsonb', 'any'), ('ARRAY', 'unknown[]'), ('hstore', 'unknown')) AS v(name, ts)")
def ts_type_map(spark, sf):
    from .inspect import ts_type

    return spark.createDataFrame([(n, ts_type(n)) for n in ("integer", "double precision", "boolean", "text", "uuid", "jsonb", "ARRAY", "hstore")], "name string, ts string")


@query("SELECT * FROM (VALUES ('binlog_format', 'STATEMENT', 'error'), ('binlog_row_image', 'MINIMAL', 'warning'), ('binlog_checksum', NULL, 'error')) AS v(name, value, level)")
def server_settings_check(spark, sf):
    have = [("log_bin", "ON"), ("binlog_format", "STATEMENT"), ("binlog_row_image", "MINIMAL"), ("version", "8.0.36"), ("binlog_expire_logs_seconds", "0")]
    return binlog.check_settings(spark.createDataFrame(have, "name string, value string"))


# --- streams


def folder_of(df: DataFrame, files: int) -> str:
    """The rows as a folder of files that a stream reads."""
    from ..storage import new_folder

    path = new_folder(df.sparkSession)
    df.repartition(files).write.parquet(path)
    return path


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over files gives when it has read them all."""
    from ..storage import new_folder

    spark = stream.sparkSession
    path = new_folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("WITH @cdc SELECT op, id, ts_ms FROM cdc")
def stream_dedup(spark, sf):
    from ..streaming.capture import deduplicated

    e = flat(cdc_events(spark, sf)).withColumn("event_time", F.timestamp_millis("ts_ms"))
    path = folder_of(e.unionByName(e), 4)
    return drained(deduplicated(spark.readStream.schema(e.schema).parquet(path), "3650 days")).select("op", "id", "ts_ms")


@query(PGOUTPUT_SQL)
def stream_txn_assembly(spark, sf):
    from ..sources.files import stream_payloads
    from ..streaming.decoding import decode_stream

    path = folder_of(pgoutput_payloads(spark, sf), 1)
    return pgoutput_flat(drained(decode_stream(stream_payloads(spark, path), "shop")))


@query("WITH @cdc SELECT op, id, CASE WHEN op <> 'd' THEN '***REDACTED***' END AS props FROM cdc WHERE op <> 'c'")
def stream_pipeline_parquet(spark, sf):
    from ..storage import new_folder
    from ..streaming.capture import Capture

    e = cdc_events(spark, sf)
    stream = spark.readStream.schema(e.schema).parquet(folder_of(e, 2))
    path = new_folder(spark)
    Capture(stream, f"{path}/checkpoint", Pipeline([Filter(op_is_not("c")), Mask(["props"])]), available_now=True, name=f"pipeline_{path[-8:]}").into(f"{path}/out").start().wait()
    return spark.read.parquet(f"{path}/out").select("op", "id", F.col("after.props").alias("props"))
