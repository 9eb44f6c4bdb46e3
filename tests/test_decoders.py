import json
import struct

import pytest
from pyspark.sql import functions as F

from millrace.errors import DecodeError
from millrace.operators import binlog, lookup, pgoutput as pg, wal2json

COLUMNS = [("id", 23), ("name", 25), ("price", 1700), ("ok", 16)]
REL = pg.relation(1, "public", "products", COLUMNS)


def transaction(*changes, xid=200, lsn=0x60):
    return pg.begin(0x50, 0, xid) + b"".join(changes) + pg.commit(lsn, 1_000_000)


def test_transaction():
    d = pg.Decoder("db")
    out = d.decode(REL + transaction(pg.insert(1, [1, "a", "1.50", "t"]), pg.insert(1, [2, None, None, "f"]), pg.update(1, [1, "b", "2.0", "t"], [1, None, None, None]), pg.delete(1, [2, None, None, None])))
    assert [e["op"] for e in out] == ["c", "c", "u", "d"]
    assert [e["id"] for e in out] == [f"0/00000060:200:{i}" for i in range(4)]
    assert json.loads(out[0]["after"]) == {"id": 1, "name": "a", "ok": True, "price": "1.50"} and out[0]["before"] is None
    assert out[3]["after"] is None and json.loads(out[3]["before"])["id"] == 2
    assert out[0]["ts_ms"] == 946684801000 and out[0]["lsn"] == "0/00000060"


@pytest.mark.parametrize("marked", [True, False])
def test_update_with_and_without_marker(marked):
    out = pg.Decoder("db").decode(REL + transaction(pg.update(1, [1, "b", "2", "t"], [1, "a", "1", "f"], marked)))
    assert json.loads(out[0]["before"])["name"] == "a" and json.loads(out[0]["after"])["name"] == "b"


def test_values_by_look():
    d = pg.Decoder("db", "guessed")
    out = d.decode(REL + transaction(pg.insert(1, [b"\xff\xfe", "42", "19.99", "t"])))
    assert json.loads(out[0]["after"]) == {"id": "\\xfffe", "name": 42, "price": 19.99, "ok": "t"}


def test_relations_live_over_calls_and_change():
    d = pg.Decoder("db")
    assert d.decode(REL) == []
    assert len(d.decode(transaction(pg.insert(1, [1, "a", None, None])))) == 1
    d.decode(pg.relation(1, "public", "renamed", [("k", 23)]))
    out = d.decode(transaction(pg.insert(1, [5, "x"])))
    assert out[0]["table_name"] == "renamed" and json.loads(out[0]["after"]) == {"k": 5, "__col_1": "x"}


def test_errors_and_skips():
    d = pg.Decoder("db")
    with pytest.raises(DecodeError):
        d.decode(pg.begin(1, 0, 1) + pg.insert(9, [1]))
    with pytest.raises(DecodeError):
        pg.Decoder("db").decode(pg.commit(1, 0))
    with pytest.raises(DecodeError):
        pg.Decoder("db").decode(pg.begin(1, 0, 1)[:-2])
    with pytest.raises(DecodeError):
        pg.Decoder("db").decode(REL + pg.begin(1, 0, 1) + struct.pack(">cic", b"I", 1, b"Z"))
    d = pg.Decoder("db")
    skipped = struct.pack(">ci", b"Y", 5) + b"s\0t\0" + struct.pack(">cq", b"O", 7) + b"origin\0" + struct.pack(">cib2i", b"T", 2, 0, 1, 2)
    assert len(d.decode(REL + skipped + transaction(pg.insert(1, [1])))) == 1
    assert d.decode(b"?garbage") == [] and d.unknown == 1
    assert d.decode(b"") == []


def test_begin_discards_and_flush():
    d = pg.Decoder("db")
    d.decode(REL + pg.begin(0x10, 0, 1) + pg.insert(1, [1]))
    d.decode(pg.begin(0x20, 0, 2) + pg.insert(1, [2]))
    out = d.flush()
    assert [e["id"] for e in out] == ["0/00000020:2:flush"] and d.flush() == []


def test_transaction_limit(monkeypatch):
    monkeypatch.setattr(pg, "MOST_EVENTS", 3)
    with pytest.raises(DecodeError):
        pg.Decoder("db").decode(REL + transaction(*[pg.insert(1, [i]) for i in range(4)]))


def test_batch_decode_by_slot(spark):
    rows = [("a", 1, REL), ("a", 2, pg.begin(1, 0, 7)), ("a", 3, pg.insert(1, [1])), ("a", 4, pg.commit(2, 0)), ("b", 1, pg.insert(1, [1])), ("b", 2, b""), ("a", 5, None), ("b", 3, REL + transaction(pg.insert(1, [9])))]
    df = spark.createDataFrame([(s, q, None if p is None else bytearray(p)) for s, q, p in reversed(rows)], "slot string, seq long, payload binary").repartition(3)
    out = {(r["slot"], r["seq"]): r for r in pg.decode(df, "db").collect()}
    assert set(out) == {("a", 4), ("b", 1), ("b", 3)}
    assert "unknown relation" in out[("b", 1)]["error"] and out[("b", 3)]["op"] == "c"
    late = spark.createDataFrame([("a", 1, bytearray(REL + pg.begin(1, 0, 7) + pg.insert(1, [1])))], "slot string, seq long, payload binary")
    assert pg.decode(late, "db").count() == 0
    assert pg.decode(late, "db", emit_uncommitted=True).first()["id"] == "0/00000001:7:flush"


def test_wal2json(spark):
    texts = [
        '{"xid":123,"timestamp":"2024-05-31 12:00:00.123456+00","change":[{"kind":"insert","schema":"public","table":"users","columnnames":["id","name"],"columnvalues":[1,"Al \\"q\\""]}]}',
        '{"xid":456,"change":[{"kind":"update","table":"products","columnnames":["id","name","price"],"columnvalues":[1,"Super Widget"],"oldkeys":{"keynames":["id"],"keyvalues":[1]}},{"kind":"truncate","table":"x"}]}',
        '{"xid":789,"timestamp":"2024-05-31T12:00:00.5Z","change":[{"kind":"delete","schema":"s","table":"orders","oldkeys":{"keynames":["id"],"keyvalues":[99]}}]}',
        '{"xid":1,"timestamp":"soon","change":[]}',
        "nonsense",
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, payload string")
    out = {r["seq"]: r for r in wal2json.decode(df, "db", keep=["seq"]).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4]
    assert out[0]["id"] == "123:0" and json.loads(out[0]["after"]) == {"id": 1, "name": 'Al "q"'} and out[0]["ts_ms"] == 1717156800123
    assert json.loads(out[1]["after"]) == {"id": 1, "name": "Super Widget", "price": None} and json.loads(out[1]["before"]) == {"id": 1}
    assert out[1]["ts_ms"] == 0 and out[1]["source"]["schema"] == "public"
    assert out[2]["after"] is None and out[2]["ts_ms"] == 1717156800500
    assert "timestamp" in out[3]["error"] and out[4]["error"] == "invalid JSON"
    assert wal2json.decode(df, "db", keep=["seq"], mode="shared").filter("seq = 0").first()["id"] == "123"


def test_binlog(spark):
    source = "named_struct('db','test','schema','','table','users','lsn',string(null),'binlog_file','mysql-bin.000001','binlog_offset',42L,'tx_id','GTID-1','ts_ms',5L,'snapshot',boolean(null))"
    df = spark.sql(f"SELECT type, rows, {source} AS source FROM VALUES ('write', array(named_struct('before', string(null), 'after', 'a'), named_struct('before', null, 'after', 'b'))), ('update', array(named_struct('before', 'a', 'after', 'c'))), ('partial_update', array(named_struct('before', 'a', 'after', 'c'))), ('delete', array(named_struct('before', 'a', 'after', null))), ('table_map', array(named_struct('before', null, 'after', null))), ('xid', null) AS v(type, rows)")
    out = binlog.decode(df)
    assert sorted((r["op"], r["before"] or "", r["after"] or "") for r in out.collect()) == [("c", "", "a"), ("c", "", "b"), ("d", "a", ""), ("u", "a", "c"), ("u", "a", "c")]
    assert {r["id"] for r in out.filter("op = 'c'").collect()} == {"mysql-bin.000001:42:GTID-1:0", "mysql-bin.000001:42:GTID-1:1"}
    assert binlog.decode(df, partial_as="c").filter("op = 'c'").count() == 3
    names = spark.sql("SELECT array('id', null, 'x') AS n").select(binlog.column_names(F.col("n"), F.lit(4)).alias("n")).first()["n"]
    assert names == ["id", "_col_1", "x", "_col_3"]


def test_lookups(spark):
    changes = spark.createDataFrame([(1, 5, "x"), (1, 1, "early"), (2, 9, "none"), (1, 20, "y")], "relation_id int, seq int, v string")
    relations = spark.createDataFrame([(1, 3, "t1"), (1, 10, "t2")], "relation_id int, seq int, name string")
    known, unknown = lookup.with_relation(changes, relations)
    assert sorted((r["v"], r["relation"]["name"]) for r in known.collect()) == [("x", "t1"), ("y", "t2")]
    assert sorted(r["v"] for r in unknown.collect()) == ["early", "none"]


def test_as_of_over_stretches(spark):
    """A busy key, cut into stretches, with announcements that lie many stretches back, ties and rows before any."""
    import random

    from millrace.operators.lookup import as_of

    rng = random.Random(4)
    log = [(1, rng.randrange(2000), i) for i in range(6)] + [(2, 5, 100), (2, 5, 100)]
    rows = [(rng.choice((1, 1, 1, 2, 3)), rng.randrange(-50, 2000), i) for i in range(300)]
    said = spark.createDataFrame(log, "k int, seq long, v int")
    got = as_of(spark.createDataFrame(rows, "k int, seq long, n int"), said, ["k"], "seq", "found", stretch=64).collect()
    assert len(got) == 300
    for r in got:
        before = [x for x in log if x[0] == r["k"] and x[1] <= r["seq"]]
        assert (r["found"] and r["found"]["v"]) == (max(before, key=lambda x: x[1])[2] if before else None)


def test_wal2json_reads_its_payloads_once(spark):
    from millrace.operators import wal2json

    plan = wal2json.decode(spark.createDataFrame([("{}",)], "payload string"), "db")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
