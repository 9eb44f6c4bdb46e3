"""Queries of state, resumption, catalogs, files and delivery: the parts of the engine that keep something."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import binlog, lookup, pgoutput, transforms
from ..schema import envelope
from ..sources import chunks, files, snapshot
from ..storage import new_folder
from ..streaming import capture, sinks, state
from . import inspect
from .catalog import SchemaCache
from .catalogue import STATEMENTS, bounds, flat, plan_sql, pgoutput_flat, query
from .database import in_database
from .inputs import TS_MS, binlog_events, cdc_events, chunk_log, offsets, pgoutput_payloads, table

NAMES = ("benchmark", "conversations", "customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
LISTED = "(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
#: A catalog's name of each type of the tables.
TYPES_SQL = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'VARCHAR' THEN 'text' WHEN 'TIMESTAMP' THEN 'timestamp without time zone' END"
CATALOG_SQL = f"k AS (SELECT DISTINCT table_name, column_name, ordinal_position AS place, {TYPES_SQL} AS kind, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'number' ELSE 'string' END AS ts FROM information_schema.columns WHERE table_name IN {LISTED})"


def catalog_rows(spark, sf):
    """table_name, name, place, kind, nullable of the columns of all tables, from their schemas."""
    rows = [(t, c, i, kind, null) for t in NAMES for i, (c, kind, null) in enumerate(inspect.columns_of(table(spark, sf, t).schema), 1)]
    return spark.createDataFrame(rows, "table_name string, name string, place int, kind string, nullable boolean")


def new_store(spark) -> state.StateStore:
    return state.StateStore(spark, new_folder(spark))


# --- catalogs


@query(f"WITH {CATALOG_SQL} SELECT table_name, column_name, ts AS json_type, 'Column type: ' || kind AS description FROM k")
def json_schema_columns(spark, sf):
    made = inspect.json_schema({t: inspect.columns_of(table(spark, sf, t).schema) for t in NAMES})
    rows = [(t, c, p["type"], p["description"]) for t, s in made.items() for c, p in s["properties"].items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, json_type string, description string")


@query(f"""WITH {CATALOG_SQL} SELECT table_name, 'export interface ' || upper(table_name[1]) || table_name[2:] || ' {{' || chr(10) || string_agg('  ' || column_name || '?: ' || ts || ';', chr(10) ORDER BY place) || chr(10) || '}}' AS definition FROM k GROUP BY 1""")
def typescript_interfaces(spark, sf):
    """The generated file, cut at its interfaces."""
    path = f"{new_folder(spark)}"
    text = inspect.typescript({t: inspect.columns_of(table(spark, sf, t).schema) for t in NAMES})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(export interface \w+ \{[^}]*\})"), 1)).alias("definition"))
    name = F.lower(F.regexp_extract("definition", r"interface (\w+)", 1))
    return found.select(name.alias("table_name"), "definition").filter(F.col("table_name").isin(*NAMES))


@query(f"WITH {CATALOG_SQL}, n AS (SELECT DISTINCT table_name FROM k) SELECT row_number() OVER (ORDER BY table_name) AS place, 'public.' || table_name AS qualified FROM n")
def discovered_tables(spark, sf):
    known = catalog_rows(spark, sf).select(F.lit("public").alias("schema_name"), "table_name")
    found = [(i, r["qualified"]) for i, r in enumerate(snapshot.discovered(known).collect(), 1)]
    return spark.createDataFrame(found, "place long, qualified string")


@query("SELECT * FROM (VALUES ('public.orders', 'named'), ('public.region', 'named'), ('public.nothing', 'missing'), ('other.orders', 'missing')) AS v(qualified, what)")
def selected_tables(spark, sf):
    known = catalog_rows(spark, sf).select(F.lit("public").alias("schema_name"), "table_name")
    named = ["public.orders", "region", "public.orders"]
    found = snapshot.discovered(known, named).select("qualified", F.lit("named").alias("what"))
    return found.unionByName(snapshot.missing_tables(known, ["public.orders", "public.nothing", "other.orders"]).withColumn("what", F.lit("missing")))


@query(f"WITH {CATALOG_SQL} SELECT table_name, string_agg(column_name, ',' ORDER BY place) AS keys FROM k WHERE place = 1 OR column_name IN ('turn', 'l_linenumber') GROUP BY 1")
def flagged_key_columns(spark, sf):
    key = F.when((F.col("place") == 1) | F.col("name").isin("turn", "l_linenumber"), "PRI").otherwise("")
    return lookup.flagged_keys(catalog_rows(spark, sf).withColumn("column_key", key)).select("table_name", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {CATALOG_SQL} SELECT table_name, CASE WHEN kind IN ('bigint', 'integer') THEN 'single_integer' ELSE 'single_other' END AS one, 'composite' AS two, 'none' AS without FROM k WHERE place = 1")
def key_classes(spark, sf):
    rows = []
    for t in NAMES:
        schema = table(spark, sf, t).schema
        rows.append((t, *(chunks.classify_keys(schema, schema.names[:n]) for n in (1, 2, 0))))
    return spark.createDataFrame(rows, "table_name string, one string, two string, without string")


@query("WITH q(place, query) AS (VALUES " + ", ".join(f"({i}, '" + s.replace("'", "''") + "')" for i, s in enumerate(STATEMENTS)) + r""")
SELECT query, regexp_matches(query, '(?i)^\s*(ALTER|CREATE|DROP|TRUNCATE|RENAME)\s+TABLE\s') AS dropped, 1 + count(*) FILTER (regexp_matches(query, '(?i)users')  AND regexp_matches(query, '(?i)^\s*(ALTER|CREATE|DROP|TRUNCATE|RENAME)\s+TABLE\s')) OVER (ORDER BY place) AS reads_of_users FROM q""")
def schema_cache_reads(spark, sf):
    """How often a table's columns had to be read, statement by statement."""
    reads = []
    cache = SchemaCache(lambda db, name: reads.append(name) or inspect.columns_of(table(spark, sf, "customer").schema))
    cache.get("main", "users")
    rows = []
    for s in STATEMENTS:
        changed = cache.saw("main", s)
        cache.get("main", "users")
        rows.append((s, changed is not None, len(reads)))
    return spark.createDataFrame(rows, "query string, dropped boolean, reads_of_users long")


@query("SELECT c_custkey, regexp_full_match(c_name, '[\\p{L}\\p{N}_.]+') AS name_ok, regexp_full_match(c_mktsegment, '[\\p{L}\\p{N}_.]+') AS segment_ok, true AS made_ok FROM customer")
def identifier_checks(spark, sf):
    made = F.concat(F.lit("späť_"), F.col("c_custkey").cast("string"), F.lit(".x"))
    return table(spark, sf, "customer").select("c_custkey", S.identifier_ok(F.col("c_name")).alias("name_ok"), S.identifier_ok(F.col("c_mktsegment")).alias("segment_ok"), S.identifier_ok(made).alias("made_ok"))


@query("SELECT * FROM (VALUES ('reader', 'REPLICATION CLIENT'), ('reader', 'SELECT on shop'), ('nobody', 'REPLICATION SLAVE'), ('nobody', 'REPLICATION CLIENT'), ('nobody', 'SELECT on shop')) AS v(\"user\", privilege)")
def privileges_check(spark, sf):
    grants = [("root", "GRANT ALL PRIVILEGES ON *.* TO root"), ("reader", "GRANT Replication Slave ON *.* TO reader"), ("reader", "GRANT SELECT ON `other`.* TO reader"), ("nobody", "GRANT USAGE ON *.* TO nobody"), ("app", "GRANT REPLICATION SLAVE, REPLICATION CLIENT ON *.* TO app"), ("app", "GRANT SELECT ON `shop`.* TO app")]
    return binlog.missing_privileges(spark.createDataFrame(grants, "user string, grant string"), "shop")


@query("SELECT * FROM (VALUES ('after.value > 50', true), ('op = ''c'' AND before IS NULL', true), ('after.value', false), ('after.nothing = 1', false), ('op = ', false)) AS v(expression, ok)")
def expression_checks(spark, sf):
    schema = cdc_events(spark, sf).schema
    made = ["after.value > 50", "op = 'c' AND before IS NULL", "after.value", "after.nothing = 1", "op = "]
    return spark.createDataFrame([(e, transforms.check_expression(spark, schema, e) is None) for e in made], "expression string, ok boolean")


# --- reading a database


@query(f"WITH plan AS ({plan_sql('orders', 'o_orderkey', 4)}) SELECT o_orderkey, o_custkey, o_totalprice, p.chunk FROM orders JOIN plan p ON o_orderkey >= p.start_key AND (p.end_key IS NULL OR o_orderkey < p.end_key)")
def jdbc_chunks(spark, sf):
    """All chunks of a table over JDBC; the number of a row's partition is its chunk's."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    low, high = bounds(spark, sf, "orders", "o_orderkey")
    plan = chunks.chunk_plan(spark, "orders", low, high, 4).orderBy("chunk").collect()
    read = snapshot.read_chunks(spark, in_database(spark, orders, "orders"), "orders", "o_orderkey", [(r["start_key"], r["end_key"]) for r in plan])
    return read.withColumn("chunk", F.spark_partition_id().cast("long"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100 ORDER BY o_orderkey LIMIT 250")
def jdbc_ordered_scan(spark, sf):
    """A chunk's rows in order of the key, the first 250 of them: a page of a sequential scan."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    page = snapshot.read_chunk(spark, in_database(spark, orders, "orders"), "orders", "o_orderkey", 100, 1100, order=["o_orderkey"]).limit(250)
    return page.select(F.row_number().over(Window.orderBy("o_orderkey")).cast("long").alias("place"), "o_orderkey")


@query("SELECT n_nationkey, 'r' AS op, 'snap:public.nation:n_nationkey=' || n_nationkey AS id, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS image FROM nation")
def fixture_events(spark, sf):
    """Events kept as one JSON file each, read back."""
    path = new_folder(spark)
    e = snapshot.as_text(snapshot.snapshot_events(table(spark, sf, "nation"), "shop", "public", "nation", ["n_nationkey"], TS_MS))
    e.withColumn("n", F.get_json_object("after", "$.n_nationkey")).repartition("n").write.partitionBy("n").json(path)
    return files.read_fixtures(spark, path).select(F.get_json_object("after", "$.n_nationkey").cast("int").alias("n_nationkey"), "op", "id", F.col("after").alias("image"))


@query("SELECT count(*) AS n_rows, count(*) AS distinct_ids, true AS well_formed FROM labels")
def keyless_snapshot_ids(spark, sf):
    """Rows without a key get random ids, no two alike."""
    e = snapshot.snapshot_events(table(spark, sf, "labels"), "shop", "public", "labels", [], TS_MS)
    good = F.col("id").rlike("^snap:public[.]labels:[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return e.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("distinct_ids"), F.bool_and(good).alias("well_formed"))


@query("SELECT count(*) AS n_events, true AS stamped, true AS rising FROM events")
def stamped_events(spark, sf):
    """Events stamped with the clock, each later than the one before."""
    rows = table(spark, sf, "events").select("event_id", (F.unix_millis(F.current_timestamp()) + F.col("event_id")).alias("ts_ms"))
    return rows.agg(F.count("*").alias("n_events"), (F.min("ts_ms") > 1_700_000_000_000).alias("stamped"), (F.count_distinct("ts_ms") == F.count("*")).alias("rising"))


# --- decoders


PLAIN_SQL = "WITH @cdc SELECT op, id, lsn, CAST(xid AS VARCHAR) AS tx_id, 'public' AS schema_name, 'events' AS table_name, CASE WHEN op <> 'd' THEN event_id END AS after_id, CASE WHEN op <> 'd' THEN value END AS after_value, CASE WHEN op <> 'c' THEN user_id END AS before_user, CAST(NULL AS VARCHAR) AS error FROM cdc"


@query(PLAIN_SQL)
def pgoutput_skips_other_messages(spark, sf):
    """Types, origins and truncations are no events; an unknown message ends its buffer."""
    return pgoutput_flat(pgoutput.decode(pgoutput_payloads(spark, sf, kind="extra"), "shop"))


@query("""WITH @cdc, m AS (SELECT max(xid) AS last FROM cdc) SELECT op, CASE WHEN xid > last - 8 THEN format('{:X}/{:08X}', (lsn_num - 128) >> 32, (lsn_num - 128) & 4294967295) || ':' || xid || ':flush' ELSE id END AS id, event_id FROM cdc, m""")
def pgoutput_flushes_open_transactions(spark, sf):
    e = pgoutput.decode(pgoutput_payloads(spark, sf, kind="open"), "shop", emit_uncommitted=True)
    return e.select("op", "id", F.coalesce(F.get_json_object("after", "$.event_id"), F.get_json_object("before", "$.event_id")).cast("long").alias("event_id"))


@query("""WITH @cdc, r AS (SELECT *, row_number() OVER (PARTITION BY xid, op ORDER BY idx) - 1 AS row FROM cdc)
SELECT CASE op WHEN 'u' THEN 'c' ELSE op END AS op, 'binlog.000001:' || lsn_num || ':GTID-' || xid || ':' || row AS id, CASE WHEN op = 'd' THEN user_id END AS before_user, CASE WHEN op <> 'd' THEN event_id END AS after_id FROM r""")
def binlog_older_and_partial_rows(spark, sf):
    """Row events of older servers, and partial updates as the creates that they carry."""
    kind = F.when(F.col("type") == "update", "PARTIAL_UPDATE").otherwise(F.concat(F.upper("type"), F.lit("_V1")))
    e = binlog.decode(binlog_events(spark, sf).withColumn("type", kind), partial_as="c")
    return e.select("op", "id", F.col("before.user_id").alias("before_user"), F.col("after.event_id").alias("after_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '_col_0' END || ',_col_1,' || c_mktsegment || ',_col_3' AS names FROM customer")
def table_map_names(spark, sf):
    given = F.array(F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_name")), F.lit(None).cast("string"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(binlog.column_names(given, F.lit(4)), ",").alias("names"))


# --- state


@query("WITH @cdc, @offsets SELECT lsn, tx_id, ts_ms, is_final, 'last' AS what, sequence FROM o WHERE sequence = (SELECT max(sequence) FROM o) UNION ALL SELECT '9/00000009', '7', 8, true, 'written', max(sequence) + 1 FROM o")
def state_offsets(spark, sf):
    """Offsets written as a frame and one by one; the last of each."""
    store = new_store(spark)
    store.extend("offsets", offsets(spark, sf).withColumn("adapter", F.lit("log")))
    first = store.last_offset()
    store.write_offset("9/00000009", "7", 8, True, "log")
    rows = [(o["lsn"], o["tx_id"], o["ts_ms"], o["is_final"], what, o["sequence"]) for o, what in ((first, "last"), (store.last_offset(), "written"))]
    return spark.createDataFrame(rows, "lsn string, tx_id string, ts_ms long, is_final boolean, what string, sequence long")


@query("WITH @cdc, @offsets SELECT count(*) AS before_clear, 0 AS after_clear, 1 AS next_sequence FROM o")
def state_clear_offsets(spark, sf):
    store = new_store(spark)
    store.extend("offsets", offsets(spark, sf).withColumn("adapter", F.lit("log")))
    n = store.table("offsets").count()
    store.clear_offsets()
    return spark.createDataFrame([(n, store.table("offsets").count(), store.write_offset("0/1"))], "before_clear long, after_clear long, next_sequence long")


def progress_log(spark, sf):
    """Progress of 20 tables' snapshots, a row for each event; started when the event was."""
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("t"), F.pmod("user_id", F.lit(20)).cast("string")).alias("table_name"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("last_key"), F.col("user_id").alias("rows"), ((F.col("event_type") == "purchase") & (F.col("value") > 99)).alias("completed"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at"))


@query("SELECT 't7' AS table_name, event_id AS seq, user_id AS rows, event_type = 'purchase' AND value > 99 AS completed FROM events WHERE user_id % 20 = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def state_snapshot_status(spark, sf):
    store = new_store(spark)
    store.extend("snapshots", progress_log(spark, sf))
    return A.snapshot_status(store.table("snapshots"), "t7").select("table_name", "seq", "rows", "completed")


@query("SELECT 't' || (user_id % 20) AS table_name FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'purchase' AND value > 99) UNION ALL SELECT 'unknown'")
def state_tables_left(spark, sf):
    store = new_store(spark)
    store.extend("snapshots", progress_log(spark, sf))
    known = [r["table_name"] for r in store.progress().select("table_name").collect()]
    left = store.tables_to_read([*known, "unknown"])
    return spark.createDataFrame([(t,) for t in left], "table_name string")


def chunk_store(spark, sf) -> state.StateStore:
    store = new_store(spark)
    store.extend("snapshot_chunks", chunk_log(spark, sf).withColumns({"start_key": F.col("chunk") * 10, "end_key": F.col("chunk") * 10 + 10}))
    return store


@query("WITH @chunks SELECT coalesce(max(snapshot_id), 'new') AS run_id FROM s WHERE status <> 'completed'")
def state_run_id(spark, sf):
    """The run with chunks left is taken up again."""
    known = {"run0", "run1", "run2"}
    got = chunk_store(spark, sf).run_id()
    return spark.createDataFrame([(got if got in known else "new",)], "run_id string")


@query("WITH @chunks SELECT row_number() OVER (ORDER BY chunk) AS place, chunk, status, rows_count, chunk * 10 AS start_key, chunk * 10 + 10 AS end_key FROM s WHERE snapshot_id = 'run1'")
def state_chunks_in_order(spark, sf):
    rows = chunk_store(spark, sf).chunks("run1", "events").collect()
    return spark.createDataFrame([(i, r["chunk"], r["status"], r["rows_count"], r["start_key"], r["end_key"]) for i, r in enumerate(rows, 1)], "place long, chunk long, status string, rows_count long, start_key long, end_key long")


@query("WITH @chunks SELECT chunk, chunk * 10 AS start_key, chunk * 10 + 10 AS end_key FROM s WHERE snapshot_id = 'run2' AND status <> 'completed'")
def state_pending_chunks(spark, sf):
    return chunk_store(spark, sf).pending_chunks("run2").select("chunk", "start_key", "end_key")


@query("SELECT 2 AS version, 2 AS steps, true AS second_writer_refused, true AS later_layout_refused")
def state_layout(spark, sf):
    """A new folder is brought up version by version; it takes one writer, and no layout from the future."""
    from ..errors import MigrationFailed, StateLocked

    store = new_store(spark).lock("a")
    version, steps = store.version(), store.table("layout").count()
    refused = []
    for kind, act in ((StateLocked, lambda: state.StateStore(spark, store.folder).lock("b")), (MigrationFailed, lambda: (store.append("layout", (99,)), state.StateStore(spark, store.folder)))):
        try:
            act()
            refused.append(False)
        except kind:
            refused.append(True)
    store.unlock()
    return spark.createDataFrame([(version, steps, *refused)], "version long, steps long, second_writer_refused boolean, later_layout_refused boolean")


@query("WITH @cdc, @offsets SELECT 'offsets' AS table_name, count(*) AS n_rows FROM o UNION ALL SELECT 'snapshots', count(*) FROM events UNION ALL SELECT 'snapshot_chunks', count(*) FROM events UNION ALL SELECT 'layout', 2")
def state_integrity(spark, sf):
    """Every table of a store can be read."""
    store = chunk_store(spark, sf)
    store.extend("offsets", offsets(spark, sf).withColumn("adapter", F.lit("log")))
    store.extend("snapshots", progress_log(spark, sf))
    store.check()
    rows = [(t, store.table(t).count()) for t in state.TABLES]
    return spark.createDataFrame([r for r in rows if r[1]], "table_name string, n_rows long")


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN '7/00000007' WHEN event_type = 'error' THEN '1/' || event_id WHEN event_type = 'click' THEN '2/' || event_id ELSE '0/0' END AS start, CASE WHEN event_id % 3 = 0 THEN 'c' WHEN event_id % 3 = 1 THEN 's' ELSE 'f' END AS checkpoint FROM events")
def start_and_checkpoint_positions(spark, sf):
    kind, n = F.col("event_type"), F.pmod("event_id", F.lit(3))
    at = lambda head: F.concat(F.lit(head), F.col("event_id").cast("string"))
    snap, asked, saved = F.when(kind == "signup", "7/00000007"), F.when(kind.isin("error", "signup"), at("1/")).otherwise(""), F.when(kind.isin("click", "error"), at("2/"))
    return table(spark, sf, "events").select("event_id", state.start_positions(asked, saved, snap).alias("start"), state.checkpoint_positions(F.when(n == 0, "c"), F.when(n == 1, "s").otherwise(""), F.lit("f")).alias("checkpoint"))


@query("WITH @cdc SELECT CAST(xid AS VARCHAR) AS position, 'Data decode error: a change of the unknown relation 99' AS error FROM cdc WHERE xid % 50 = 0 GROUP BY 1")
def poison_messages_skipped(spark, sf):
    """Transactions that can't be decoded are recorded, once however often the batch is tried, and the rest goes on."""
    store = new_store(spark)
    path = new_folder(spark)
    pgoutput.decode(pgoutput_payloads(spark, sf, kind="bad"), "shop").write.parquet(path)
    decoded = spark.read.parquet(path)
    for _ in range(2):
        capture.dead_letters(decoded, store)
    return store.table("skipped_positions").select("position", "error")


@query("WITH @cdc SELECT op, id FROM cdc WHERE xid % 50 <> 0")
def events_beside_poison_messages(spark, sf):
    path = new_folder(spark)
    pgoutput.decode(pgoutput_payloads(spark, sf, kind="bad"), "shop").write.parquet(path)
    return capture.dead_letters(spark.read.parquet(path), new_store(spark)).select("op", "id")


# --- handoff, captures and delivery


@query("WITH @cdc, m AS (SELECT max(lsn_num) // 512 * 256 AS half FROM cdc) SELECT op, id FROM cdc, m WHERE lsn_num > half UNION ALL SELECT 'r', 'snap:public.region:r_regionkey=' || r_regionkey FROM region")
def snapshot_handoff(spark, sf):
    """A snapshot, then of the stream what lies behind the snapshot's position."""
    e = cdc_events(spark, sf)
    last = e.agg(F.max(S.lsn_parse(F.col("source.lsn"))).cast("long")).first()[0]
    at = last // 512 * 256
    read, rest = capture.after_snapshot(snapshot.snapshot_events(table(spark, sf, "region"), "shop", "public", "region", ["r_regionkey"], TS_MS), e, f"{at >> 32:X}/{at & 0xFFFFFFFF:08X}")
    return read.select("op", "id").unionByName(rest.select("op", "id"))


def captured(spark, sf, **sinks_):
    """A capture of the change log that has run to its end, its store and its folder."""
    from .catalogue import folder_of

    e = cdc_events(spark, sf)
    store, path = new_store(spark), new_folder(spark)
    stream = spark.readStream.schema(e.schema).parquet(folder_of(e, 3))
    c = capture.Capture(stream, f"{path}/checkpoint", store=store, available_now=True, name=f"capture_{path[-8:]}").into_log(f"{path}/log")
    states = [c.state]
    c.start().wait()
    states.append(c.state)
    c.pause()
    states.append(c.state)
    c.resume().wait()
    c.stop()
    return c, store, f"{path}/log", [*states, c.state]


@query("WITH @cdc, m AS (SELECT max(lsn_num) AS n FROM cdc), l AS (SELECT lsn, xid FROM cdc, m WHERE lsn_num = n LIMIT 1) SELECT lsn, CAST(xid AS VARCHAR) AS tx_id, f AS is_final, 'idle,streaming,paused,stopped' AS states FROM l, (VALUES (false), (true)) AS v(f)")
def capture_states_and_offsets(spark, sf):
    """A capture's course, and the offsets that it wrote: the greatest position of the batch, then the same as final."""
    _, store, _, states = captured(spark, sf)
    return store.table("offsets").select("lsn", "tx_id", "is_final", F.lit(",".join(states)).alias("states"))


@query("WITH @cdc, h AS (SELECT lsn_num, ts_ms, length(id) AS n, id FROM cdc WHERE event_id = (SELECT max(event_id) // 2 FROM events)) SELECT op, c.id FROM cdc c, h WHERE (c.lsn_num, c.ts_ms, length(c.id), c.id) > (h.lsn_num, h.ts_ms, h.n, h.id)")
def resume_after_event(spark, sf):
    """What a client that comes back with the id of its last event is still sent."""
    from ..streaming.server import EventServer

    _, _, path, _ = captured(spark, sf)
    half = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    last = cdc_events(spark, sf).filter(F.coalesce("after.event_id", "before.event_id") == half).first()["id"]
    server = EventServer(spark, path)
    server.server.server_close()
    return server.log(server.place(last)).select("op", "id")


@query("SELECT user_id AS client, (SELECT count(*) FROM events) - count(*) - 100 AS skipped, (SELECT count(*) FROM events) - 100 AS resume_at, 'event: error' || chr(10) || 'data: {\"code\":\"lagged\",\"skipped\":' || ((SELECT count(*) FROM events) - count(*) - 100) || '}' || chr(10) || chr(10) AS frame FROM events GROUP BY 1 HAVING (SELECT count(*) FROM events) - count(*) - 100 > 0")
def lagging_clients(spark, sf):
    """Clients that have had as many events as they have in the table, of a log of all of them."""
    e = table(spark, sf, "events")
    return sinks.lag_frames(e.groupBy(F.col("user_id").alias("client")).agg(F.count("*").alias("at")), e.count(), 100)


@query("""WITH @chunks, r AS (SELECT * FROM s WHERE snapshot_id = 'run1'), f AS (
SELECT 0 AS seq, 'snapshot_start' AS event, '{"snapshot_id":"run1","chunks":' || count(*) || '}' AS data FROM r
UNION ALL SELECT chunk + 1, 'snapshot_progress', '{"snapshot_id":"run1","chunk":' || chunk || ',"rows":' || rows_count || '}' FROM r WHERE status = 'completed'
UNION ALL SELECT count(*) + 1, 'snapshot_complete', '{"snapshot_id":"run1","rows":' || sum(rows_count) || '}' FROM r HAVING bool_and(status = 'completed'))
SELECT seq, event, 'event: ' || event || chr(10) || 'data: ' || data || chr(10) || chr(10) AS frame FROM f""")
def snapshot_course_frames(spark, sf):
    return sinks.snapshot_frames(A.chunk_states(chunk_log(spark, sf)), "run1")


@query("SELECT 1 AS frames, 1 AS well_formed")
def heartbeat_frames(spark, sf):
    """The first heartbeat of a stream of them."""
    path = new_folder(spark)
    q = sinks.heartbeats(spark, 30_000).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(once=True).start()
    q.awaitTermination()
    out = spark.read.schema("frame string").parquet(f"{path}/out")
    return out.agg(F.count("*").alias("frames"), F.count_if(F.col("frame").rlike(r'^event: heartbeat\ndata: \{"ts_ms":[0-9]+\}\n\n$')).alias("well_formed"))
