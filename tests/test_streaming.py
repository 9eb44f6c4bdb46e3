import pytest
from pyspark.sql import functions as F

from millrace.errors import CaptureError, MigrationFailed
from millrace.operators import pgoutput as pg
from millrace.operators.predicates import op_is_not
from millrace.operators.transforms import Filter, Pipeline
from millrace.schema import envelope
from millrace.sources import chunks
from millrace.sources.files import PAYLOAD, stream_payloads
from millrace.streaming import sinks
from millrace.streaming.capture import Capture, after_snapshot, dead_letters
from millrace.streaming.decoding import decode_stream
from millrace.streaming.state import StateStore, checkpoint_position, start_position

REL = pg.relation(1, "public", "t", [("id", 23)])


def put(spark, path, *rows):
    spark.createDataFrame([(s, q, bytearray(p)) for s, q, p in rows], PAYLOAD).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, source, root):
    q = decode_stream(stream_payloads(spark, str(source)), "db").writeStream.format("parquet").option("path", str(root / "out")).option("checkpointLocation", str(root / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(root / "out"))


def test_restart_in_a_transaction(spark, tmp_path):
    """The relation and the open transaction survive a restart."""
    source = tmp_path / "in"
    put(spark, source, ("a", 1, REL), ("a", 2, pg.begin(1, 0, 7)), ("a", 3, pg.insert(1, [1])))
    assert run(spark, source, tmp_path).count() == 0
    put(spark, source, ("a", 4, pg.insert(1, [2])), ("a", 5, pg.commit(2, 0)))
    assert sorted(r["id"] for r in run(spark, source, tmp_path).collect()) == ["0/00000002:7:0", "0/00000002:7:1"]


def events(spark, n, first=0):
    rows = [("d" if i % 5 == 0 else "c", None, '{"k":%d}' % i, ("db", "public", "t", f"0/{i:08X}", None, None, str(i), i, None), i, f"e{i}") for i in range(first, first + n)]
    return spark.createDataFrame(rows, envelope())


def test_capture(spark, tmp_path):
    events(spark, 20).coalesce(1).write.parquet(str(tmp_path / "in"))
    store, seen = StateStore(spark, str(tmp_path / "state")), []
    stream = spark.readStream.schema(envelope()).parquet(str(tmp_path / "in"))
    c = Capture(stream, str(tmp_path / "cp"), Pipeline([Filter(op_is_not("d"))]), store, "one", available_now=True).into(str(tmp_path / "out")).on_change(seen.extend)
    assert c.status()["state"] == "idle"
    with pytest.raises(CaptureError):
        c.pause()
    c.start().wait()
    assert len(seen) == 16 and spark.read.parquet(str(tmp_path / "out")).count() == 16
    assert store.last_offset()["lsn"] == "0/00000013" and c.status()["events_captured"] == 16
    with pytest.raises(CaptureError):
        c.start()
    c.pause()
    events(spark, 5, 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c.resume().wait()
    c.stop()
    assert len(seen) == 20 and c.status()["state"] == "stopped" and store.last_offset()["is_final"]


def test_errors_reach_the_handlers(spark, tmp_path):
    events(spark, 3).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, caught = spark.readStream.schema(envelope()).parquet(str(tmp_path / "in")), []

    def fail(rows):
        raise RuntimeError("sink")

    c = Capture(stream, str(tmp_path / "cp"), name="bad", available_now=True).on_change(fail).on_error(caught.append)
    c.start().wait()
    assert caught and c.status()["status"] == "down"


def test_a_delivered_batch_is_not_delivered_again(spark, tmp_path):
    store, n = StateStore(spark, str(tmp_path / "s")), []
    for number in (0, 1, 1, 0, 2):
        sinks.Delivered(store, "x", lambda b, number: n.append(b.count()))(events(spark, 2), number)
    assert len(n) == 3


def test_handoff(spark):
    a, b = after_snapshot(events(spark, 2), events(spark, 10), "0/00000007")
    assert a.count() == 2 and b.count() == 2


def test_offsets(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    assert store.last_offset() is None
    for i, final in enumerate([False, False, True, False, False]):
        assert store.write_offset(f"0/{i}", is_final=final) == i + 1
    assert store.last_offset()["lsn"] == "0/4" and store.last_offset("reference")["lsn"] == "0/2"
    assert StateStore(spark, str(tmp_path / "s")).last_offset()["sequence"] == 5
    store.clear_offsets()
    assert store.last_offset() is None


def test_chunks_resume_from_stored_bounds(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    store.write_plan("r", chunks.chunk_plan(spark, "t", 1, 100, 4))
    store.write_plan("r", chunks.chunk_plan(spark, "t", 1, 900, 4))  # the range moved: the stored plan stays
    store.write_chunk("r", "t", 0, "completed", 25)
    store.write_chunk("r", "t", 1, "failed", 0, "lost")
    store.write_chunk("r", "t", 2, "in_progress")
    assert [(r["chunk"], r["start_key"], r["end_key"]) for r in store.pending_chunks("r").collect()] == [(1, 26, 51), (2, 51, 76), (3, 76, None)]
    t = store.chunk_totals("r")
    assert (t["n_completed"], t["n_incomplete"], t["total_rows"]) == (1, 3, 25)
    assert store.run_id() == "r"
    for c in (1, 2, 3):
        store.write_chunk("r", "t", c, "completed", 25)
    assert store.run_id() != "r" and store.pending_chunks("r").count() == 0


def test_the_rest_of_the_state(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    store.write_progress("t", "5", 5)
    store.write_progress("t", "9", 9, True)
    store.write_progress("t", "9", 9, False)
    store.write_progress("u", "1", 1)
    assert store.tables_to_read(["t", "u", "v"]) == ["u", "v"]
    store.cache_schema("t", "h1", "{}")
    store.cache_schema("t", "h2", "{}", '["id"]')
    assert store.cached_schema("t")["version"] == 2 and store.cached_schema("t")["keys"] == ["id"] and store.cached_schema("x") is None
    store.set_info("k", "1")
    store.set_info("k", "2")
    assert store.info("k") == "2" and store.info("none") is None
    store.skip("0/1", "tx", "bad")
    store.check()
    assert store.table("skipped_positions").count() == 1 and store.version() == 2
    store.append("layout", (99,))
    with pytest.raises(MigrationFailed):
        StateStore(spark, str(tmp_path / "s"))


def test_dead_letters(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "t", None), (2, None, "bad")], "seq long, tx_id string, error string")
    assert dead_letters(df, store).count() == 1
    assert store.table("skipped_positions").first()["error"] == "bad"


def test_positions():
    assert start_position("0/5", "0/3") == "0/5" and start_position(None, "0/3") == "0/3" and start_position(None, None) == "0/0" and start_position("0/5", None, "0/9") == "0/9"
    assert checkpoint_position(None, "0/2", "0/1") == "0/2"


def test_frames(spark):
    df = spark.createDataFrame([("x", "{}"), (None, "[1]")], "id string, data string")
    got = [r[0] for r in df.select(sinks.frame(F.lit("error"), F.col("data"), F.col("id"))).collect()]
    assert got == ["event: error\nid: x\ndata: {}\n\n", "event: error\ndata: [1]\n\n"]
    assert len(sinks.FRAMES) == 8
    assert spark.range(1).select(sinks.lagged(F.lit(3))).first()[0] == 'event: error\ndata: {"code":"lagged","skipped":3}\n\n'


def test_server(spark, tmp_path):
    import http.client

    from millrace.streaming.server import EventServer

    sinks.to_log(str(tmp_path / "out"))(events(spark, 7), 0)
    server = EventServer(spark, str(tmp_path / "out"), lambda: {"status": "ok", "state": "streaming"}, api_key="k", poll_s=0.05).start()
    try:

        def get(path, **headers):
            c = http.client.HTTPConnection("127.0.0.1", server.port, timeout=60)
            c.request("GET", path, headers=headers)
            return c.getresponse()

        assert get("/health").status == 200 and get("/status").status == 401 and get("/nothing", **{"X-Api-Key": "k"}).status == 404
        assert b"streaming" in get("/status", Authorization="Bearer k").read()
        r = get("/events", **{"X-Api-Key": "k", "Last-Event-ID": "e4"})
        lines = [r.readline().decode().strip() for _ in range(8)]
        assert [x for x in lines if x.startswith("id:")] == ["id: e5", "id: e6"] and lines[0] == "event: change"
    finally:
        server.stop()


def test_decoder_names(spark):
    from millrace.errors import ConfigError
    from millrace.operators.decoders import decode_log

    with pytest.raises(ConfigError):
        decode_log("test_decoding", spark.createDataFrame([], PAYLOAD), "db")
    text = '{"xid":1,"change":[{"kind":"insert","table":"t","columnnames":["a"],"columnvalues":[1]}]}'
    assert decode_log("wal2json", spark.createDataFrame([("s", 1, bytearray(text.encode()))], PAYLOAD), "db").first()["after"] == '{"a":1}'
    bad = spark.createDataFrame([(1,)], "ts_ms long").selectExpr("string(null) AS before", "string(null) AS after", "ts_ms")
    from millrace.operators.projections import built

    with pytest.raises(Exception, match="needs a source"):
        built(bad).collect()


def positioned(spark, *rows):
    return spark.createDataFrame([("c", None, None, ("db", "public", "t", lsn, None, None, "x", ts, None), ts, id) for lsn, ts, id in rows], envelope())


def test_recorded_position_is_the_greatest_by_value(spark, tmp_path):
    """Neither clocks that step back nor equal times, nor positions as text, decide."""
    positioned(spark, ("0/9", 50, "a"), ("0/10", 50, "b"), ("0/FFFFFFFF", 1, "c"), ("A/1", 3, "d"), ("9/FFFF", 70, "e")).coalesce(1).write.parquet(str(tmp_path / "in"))
    store, seen = StateStore(spark, str(tmp_path / "s")), []
    c = Capture(spark.readStream.schema(envelope()).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), store=store, name="pos", available_now=True).on_change(seen.extend)
    c.start().wait()
    assert store.last_offset()["lsn"] == "A/1" and store.last_offset()["ts_ms"] == 3
    assert [e["id"] for e in seen] == ["a", "b", "c", "e", "d"]


def test_late_events_are_sent_and_unknown_ids_told(spark, tmp_path):
    from millrace.streaming.server import EventServer

    path, log = str(tmp_path / "log"), sinks.to_log(str(tmp_path / "log"))
    server = EventServer(spark, path, most_behind=3)
    try:
        assert server.page(None) == [] and server.place("a") is None
        log(positioned(spark, ("0/1", 100, "a:10"), ("0/1", 100, "a:9")), 0)
        at = server.place("a:10")
        assert [r[2] for r in server.page(None)] == ["a:9", "a:10"]
        log(positioned(spark, ("0/2", 5, "late")), 1)
        log(positioned(spark, ("0/2", 5, "late")), 1)  # the batch is tried again
        assert [r[2] for r in server.page(at)] == ["late"]
        log(positioned(spark, *((f"0/{n}", n, f"e{n}") for n in range(3, 8))), 2)
        missed, to = server.skipped(at)
        assert missed == 3 and [r[2] for r in server.page(to)] == ["e5", "e6", "e7"]
        assert server.skipped(to) == (0, to)
        import io

        out, polls = io.BytesIO(), []
        server.poll_s = 0.01
        server.closing.wait = lambda s: polls.append(s) or server.closing.set()
        server._stream(out, at)
        assert out.getvalue().startswith(b'event: error\ndata: {"code":"lagged","skipped":3}') and out.getvalue().count(b"event: change") == 3
    finally:
        server.server.server_close()


def test_dead_letters_of_a_batch_that_is_tried_again(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "t", None), (2, None, "bad"), (2, None, "bad"), (None, "t", "worse")], "seq long, tx_id string, error string")
    for _ in range(2):
        dead_letters(df, store)
    assert sorted(r["error"] for r in store.table("skipped_positions").collect()) == ["bad", "worse"]


def test_one_writer(spark, tmp_path):
    from millrace.errors import StateLocked

    a = StateStore(spark, str(tmp_path / "s")).lock("a")
    with pytest.raises(StateLocked):
        StateStore(spark, str(tmp_path / "s")).lock("b")
    a.unlock()
    StateStore(spark, str(tmp_path / "s")).lock("b").unlock()


def test_shared_folder_must_be_set_on_a_cluster():
    from millrace.errors import ConfigError
    from millrace.storage import shared_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ConfigError):
        shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ConfigError):
        shared_dir(Session())
    Context.master = "local[4]"
    assert shared_dir(Session()).startswith("file://")
