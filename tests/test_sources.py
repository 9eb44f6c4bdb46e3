import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import DecodeError, InputOutputError, SnapshotError
from millrace.sources import chunks, files, snapshot


def starts(spark, *args):
    return [(r["start_key"], r["end_key"]) for r in chunks.chunk_plan(spark, "t", *args).orderBy("chunk").collect()]


def test_plans(spark):
    assert starts(spark, 1, 100, 4) == [(1, 26), (26, 51), (51, 76), (76, None)]
    assert [s for s, _ in starts(spark, 1, 120, 4)] == [1, 31, 61, 91]
    assert starts(spark, None, None, 4) == [(None, None)]
    assert starts(spark, 5, 5, 1) == [(5, None)]
    with pytest.raises(ValueError):
        chunks.chunk_plan(spark, "t", 1, 2, 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(-1000, 1000), st.integers(0, 500), st.integers(1, 40))
def test_assignment_is_the_plan(low, length, n):
    """The arithmetic of assign_chunk agrees with the bounds of the plan, in plain Python."""
    high = low + length
    size, extra = max(1, (length + 1) // n), (length + 1) % n if length + 1 >= n else 0
    for key in {low, high, low + length // 2, low + length // 3}:
        at, wide = key - low, (size + 1) * extra
        number = at // (size + 1) if at < wide else (at - wide) // size + extra
        number = max(0, min(number, n - 1))
        start = low + number * size + min(number, extra)
        end = start + size + (number < extra)
        assert start <= key and (key < end or end > high)


def test_counts_cover_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 333).alias("k"))
    counts = chunks.count_rows(df, "k", 0, 332, 10, "t")
    assert counts.agg(F.sum("n_rows")).first()[0] == 1000 and counts.count() == 10
    few = chunks.count_rows(spark.range(3).withColumnRenamed("id", "k"), "k", 0, 2, 8, "t")
    assert few.count() == 8 and few.filter("n_rows > 0").count() == 3


def test_large_keys(spark):
    low, high, n = 2**60, 2**60 + 10**15 + 6, 1000
    plan = {r["chunk"]: r for r in chunks.chunk_plan(spark, "t", low, high, n).collect()}
    keys = [k + d for r in plan.values() for k in (r["start_key"],) for d in (-1, 0, 1) if low <= k + d <= high] + [high]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", chunks.assign_chunk(F.col("k"), low, high, n).alias("c")).collect()
    for r in got:
        p = plan[r["c"]]
        assert p["start_key"] <= r["k"] and (p["end_key"] is None or r["k"] < p["end_key"])


def test_skew(spark):
    even = spark.createDataFrame([("a", 10), ("a", 10), ("b", 0), ("b", 0)] + [("c", 1000)] + [("c", 0)] * 20, "table string, n_rows long")
    assert {r["table"]: r["skewed"] for r in chunks.skew(even).collect()} == {"a": False, "b": False, "c": True}


def test_pending_keeps_stored_bounds(spark):
    plan = chunks.chunk_plan(spark, "t", 1, 100, 4)
    log = spark.createDataFrame([("t", 0, "completed"), ("t", 2, "completed"), ("t", 1, "failed"), ("other", 3, "completed")], "table string, chunk long, status string")
    assert [r["chunk"] for r in chunks.pending(plan, log).orderBy("chunk").collect()] == [1, 3]


def test_key_kinds(spark):
    schema = spark.createDataFrame([], "a int, b string").schema
    assert [chunks.classify_keys(schema, k) for k in ([], ["a"], ["b"], ["a", "b"])] == ["none", "single_integer", "single_other", "composite"]


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "alpha", None), (2, "bravo", 5)], "id int, name string, value long")
    e = snapshot.snapshot_events(df, "db", "public", "t", ["id"], 9)
    rows = e.orderBy("id").collect()
    assert [r["id"] for r in rows] == ["snap:public.t:id=1", "snap:public.t:id=2"] and rows[0]["before"] is None and rows[0]["source"]["snapshot"]
    both = snapshot.snapshot_tables({"b.t2": (df.select("id"), ["id"]), "t1": (df, ["id"])}, "db", 9)
    assert both.count() == 4 and json.loads(both.filter("source.table = 't1'").orderBy("id").first()["after"]) == {"id": 1, "name": "alpha", "value": None}
    with pytest.raises(SnapshotError):
        snapshot.snapshot_tables({}, "db", 9)
    with pytest.raises(SnapshotError):
        snapshot.mysql_snapshot_events(df, "db", "t", [], 9, "b", 1)
    assert snapshot.snapshot_events(df.limit(0), "db", "public", "t", ["id"], 9).count() == 0
    assert snapshot.select_tables(["b", "a", "b"], []) == ["a", "b"] and snapshot.select_tables([], ["y", "x"]) == ["x", "y"]


def test_masked_columns_are_not_read(spark, sf_dir):
    """A column that a step drops doesn't reach the scan."""
    from millrace.operators.transforms import Map, Pipeline

    e = snapshot.snapshot_events(spark.read.parquet(f"{sf_dir}/orders.parquet"), "db", "public", "orders", ["o_orderkey"], 9)
    out = Pipeline([Map(lambda e: {"after": F.struct(e["after"]["o_orderkey"].alias("k"))})]).apply(e).select("after.k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "o_totalprice" not in plan


EVENT = {"op": "c", "before": None, "after": {"id": 1}, "source": {"db": "d", "schema": "s", "table": "t", "tx_id": "1", "ts_ms": 1}, "ts_ms": 1, "id": "x"}


def test_fixtures(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(EVENT))
    (tmp_path / "a.json").write_text(json.dumps(EVENT | {"id": "y"}, indent=1))
    assert sorted(r["id"] for r in files.read_fixtures(spark, str(tmp_path)).collect()) == ["x", "y"]
    assert [r["name"] for r in files.list_fixtures(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    assert files.check_fixture(str(tmp_path / "a.json"))["id"] == "y"
    for bad in ("[]", "{", json.dumps(EVENT | {"op": "z"}), json.dumps({k: v for k, v in EVENT.items() if k != "id"}), json.dumps(EVENT | {"source": {}})):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(DecodeError):
            files.check_fixture(str(tmp_path / "bad.json"))
    with pytest.raises(InputOutputError):
        files.check_fixture(str(tmp_path / "none.json"))


def test_payload_files(spark, tmp_path):
    spark.createDataFrame([("a", 1, bytearray(b"x"))], files.PAYLOAD).write.parquet(str(tmp_path / "p"))
    assert files.read_payloads(spark, str(tmp_path / "p")).count() == 1
