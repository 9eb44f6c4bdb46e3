import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.functions.json_text import canonical_json, double_json
from millrace.operators.predicates import after, before, keeps, op_is_not, outcome, subscribed, where
from millrace.operators.transforms import REDACTED, Filter, Map, Mask, Pipeline, check_expression, clean_paths, compact, envelope_error, mapped, mask_json, pipeline_from_config
from millrace.schema import envelope, event_json, op_error, source

KEY = b"test"
IMAGE = "struct<id: int, status: string, amount: double, user: struct<email: string, name: string>>"
SOURCE = "named_struct('db', 'shop', 'schema', 'public', 'table', 't', 'lsn', '0/1', 'binlog_file', string(null), 'binlog_offset', bigint(null), 'tx_id', '1', 'ts_ms', 1L, 'snapshot', boolean(null))"


def events(spark):
    rows = [
        ("c", None, (1, "active", 100.5, ("a@x", "Al")), "1"),
        ("u", (2, "old", None, None), (2, "inactive", 10.0, ("b@x", None)), "2"),
        ("d", (3, "gone", 1.0, ("c@x", "Cy")), None, "3"),
        ("u", (4, None, 2.0, None), (4, None, None, None), "4"),
    ]
    df = spark.createDataFrame(rows, f"op string, before {IMAGE}, after {IMAGE}, id string")
    return df.selectExpr("op", "before", "after", f"{SOURCE} AS source", "7L AS ts_ms", "id")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "test, kept",
    [
        (op_is_not("d"), ["1", "2", "4"]),
        (after("status") == "active", ["1", "3"]),  # no after image: passes; null field: dropped
        (after("amount") > 50, ["1", "3"]),
        (after("nothing") == 1, ["3"]),
        (after("user.email") == "b@x", ["2", "3"]),
        (before("id") == 2, ["1", "2"]),
        (after("status") != "active", ["2", "3", "4"]),
        (~(after("status") == "active"), ["2", "3", "4"]),
        (where("op = 'c'") & (after("amount") > 200), []),
        (where("op <> 'd'") & (after("amount") > 50), ["1"]),  # false on the left decides
        ((after("amount") > 50) | where("op = 'u'"), ["1", "2", "3", "4"]),
        (after("status").isin("active", "inactive"), ["1", "2", "3"]),
        (where("CAST(NULL AS BOOLEAN)"), ["1", "2", "3", "4"]),
    ],
)
def test_filters(spark, test, kept):
    e = events(spark)
    assert ids(e.filter(keeps(test, e))) == kept
    assert ids(Pipeline([Filter(test)], fail_closed=True).apply(e)) == kept


def test_filter_over_json_text(spark):
    e = events(spark)
    e = e.withColumns({c: F.to_json(c) for c in ("before", "after")})
    assert ids(e.filter(keeps(after("user.email") == "b@x", e))) == ["2", "3"]
    assert ids(e.filter(keeps(after("amount") > 50, e))) == ["1", "3"]


def test_outcomes(spark):
    e = events(spark)
    got = {r["id"]: r["o"] for r in e.select("id", outcome(after("amount") > 50, e).alias("o")).collect()}
    assert got == {"1": "pass", "2": "dropped", "3": "error", "4": "dropped"}


def test_map_and_original_on_error(spark):
    e = events(spark)
    broken = Map(lambda e: {"id": F.when(e["op"] == "d", "").otherwise(e["id"]), "after": e["after"].withField("extra", F.lit(1))})
    out = {r["op"] + (r["id"] or ""): r for r in Pipeline([broken]).apply(e).collect()}
    assert out["d3"]["id"] == "3" and out["c1"]["after"]["extra"] == 1
    closed = Pipeline([broken], fail_closed=True)
    assert ids(closed.apply(e)) == ["1", "2", "4"]
    dead = closed.dead_letters(e).collect()
    assert [(r["id"], r["error"]) for r in dead] == [("3", "event id is empty")]


def test_two_maps_do_not_mix(spark):
    e = events(spark)
    first = Map(lambda e: {"source": e["source"].withField("table", F.concat(e["source"]["table"], F.lit("1")))})
    second = Map(lambda e: {"source": e["source"].withField("table", F.concat(e["source"]["table"], F.lit("2")))})
    assert {r[0] for r in Pipeline([first, second]).apply(e).select("source.table").collect()} == {"t12"}


def test_rejected_events_skip_later_steps(spark):
    e = events(spark)
    p = Pipeline([Map(lambda e: {"op": F.lit("x")}), Mask(["status"])], fail_closed=True)
    rows = p.run(e).collect()
    assert {r["_outcome"] for r in rows} == {"rejected"} and {r["_error"] for r in rows} == {"invalid operation code"}
    assert p.apply(e).count() == 0


def test_row_event_of_a_binlog_needs_no_schema(spark):
    e = events(spark).withColumn("source", F.col("source").withField("schema", F.lit("")).withField("binlog_file", F.lit("b.1")))
    assert {r[0] for r in e.select(envelope_error(F.col("source"), F.col("id"))).collect()} == {None}
    e = e.withColumn("source", F.col("source").withField("binlog_file", F.lit(None).cast("string")))
    assert {r[0] for r in e.select(envelope_error(F.col("source"), F.col("id"))).collect()} == {"source.schema is empty"}


@pytest.mark.parametrize("paths", [["status"], ["status", "status"], ["user.email"], ["user"], ["user", "user.email"], ["amount"], ["id"]])
@pytest.mark.parametrize("strategy", ["redact", "hash", "null"])
def test_typed_and_json_masks_agree(spark, paths, strategy):
    e = events(spark)
    typed = Pipeline([Mask(paths, strategy, KEY)]).run(e)
    typed = typed.select("id", canonical_json(F.col("after"), typed.schema["after"].dataType).alias("a"), (F.col("_outcome") == "modified").alias("m"))
    text = e.withColumns({c: canonical_json(F.col(c), e.schema[c].dataType) for c in ("before", "after")})
    plain = Pipeline([Mask(paths, strategy, KEY)]).run(text).select("id", F.col("after").alias("a"), (F.col("_outcome") == "modified").alias("m"))
    assert sorted(typed.collect()) == sorted(plain.collect())


def test_mask_values(spark):
    e = events(spark)
    row = Pipeline([Mask(["status", "amount"], "hash", KEY)]).apply(e).filter("id = '1'").first()["after"]
    assert row["status"] == hmac.new(KEY, b'"active"', hashlib.sha256).hexdigest()
    assert row["amount"] == hmac.new(KEY, b"100.5", hashlib.sha256).hexdigest()
    row = Pipeline([Mask(["status"])]).apply(e).filter("id = '4'").first()
    assert row["after"]["status"] == REDACTED and row["before"]["status"] == REDACTED


@pytest.mark.parametrize("paths", [[""], ["a..b"], [".status"], ["status."], ["missing"], ["status.inner"], []])
def test_bad_paths_leave_events_alone(spark, paths):
    e = events(spark)
    out = Pipeline([Mask(paths)]).run(e)
    assert {r["_outcome"] for r in out.collect()} == {"pass"}
    assert sorted(map(str, out.select("after").collect())) == sorted(map(str, e.select("after").collect()))


def test_json_mask_of_arrays_and_numbers(spark):
    texts = ['{"a":[{"b":1}]}', '{"a":{"b":"42"}}', '{"a":{"b":42}}', None, '{"a":null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = [r["m"] for r in df.select("i", mask_json(F.col("t"), ["a.b"], "hash", KEY).alias("m")).orderBy("i").collect()]
    assert got[0]["image"] == texts[0] and not got[0]["hit"]
    assert got[1]["hit"] and got[2]["hit"] and got[1]["image"] != got[2]["image"]
    assert got[3]["image"] is None and not got[4]["hit"]


def test_configuration():
    assert clean_paths(["b", "a.x", "a", "b", "", ".c"]) == ["a", "b"]
    with pytest.raises(ConfigError):
        Mask(["a"], "hash")
    with pytest.raises(ConfigError):
        Mask(["a"], "shred")
    with pytest.raises(ConfigError):
        pipeline_from_config({"pipeline": [{"type": "explode"}]})
    assert pipeline_from_config({"pipeline": [{"type": "mask", "fields": ["a"]}]}).steps[0].strategy == "redact"


def test_expression_check(spark):
    schema = events(spark).schema
    assert check_expression(spark, schema, "after.amount > 1") is None
    assert "boolean" in check_expression(spark, schema, "after.amount")
    assert check_expression(spark, schema, "after.amount >") and check_expression(spark, schema, "no_such > 1")


def test_python_function(spark):
    e = events(spark)
    text = e.withColumns({c: canonical_json(F.col(c), e.schema[c].dataType) for c in ("before", "after")})

    def change(event):
        if event["op"] == "d":
            raise ValueError("no")
        if event["id"] == "4":
            return None
        event["id"] += "x"
        return event

    out = {r["id"]: r["_error"] for r in mapped(change, text).collect()}
    assert out == {"1x": None, "2x": None, "3": "ValueError: no", "4": "not an object"}


def test_subscription(spark):
    e = events(spark)
    assert ids(subscribed(e)) == ["1", "2", "3", "4"]
    assert ids(subscribed(e, ["public.t"], ["u"])) == ["2", "4"]
    assert ids(subscribed(e, ["public.other"])) == []
    assert ids(subscribed(e, after_position=("2",), position=["id"])) == ["3", "4"]


@pytest.mark.parametrize("value, text", [(1.0, "1.0"), (19.99, "19.99"), (1e16, "1e16"), (1.5e300, "1.5e300"), (1e-5, "0.00001"), (2.5e-7, "2.5e-7"), (0.0, "0.0"), (-0.1, "-0.1"), (12345678.5, "12345678.5"), (1e15, "1000000000000000.0"), (float("nan"), "null"), (float("inf"), "null")])
def test_double_text(spark, value, text):
    assert spark.range(1).select(double_json(F.lit(value)).alias("t")).first()["t"] == text
    if value == value and abs(value) != float("inf"):
        assert compact(value) == text


def test_canonical_json(spark):
    df = spark.sql("SELECT named_struct('b', 'q\"\\\\\\té', 'a', array(1, null), 'm', map('z', true, 'y', false), 'n', cast(null as string), 's', named_struct('k', decimal(1.50))) AS v")
    text = df.select(canonical_json(F.col("v"), df.schema["v"].dataType).alias("t")).first()["t"]
    assert list(json.loads(text)) == ["a", "b", "m", "n", "s"] and json.loads(text)["n"] is None and json.loads(text)["b"] == 'q"\\\té'


def test_event_text(spark):
    e = events(spark)
    text = e.withColumns({c: canonical_json(F.col(c), e.schema[c].dataType) for c in ("before", "after")})
    one = json.loads(text.filter("id = '1'").select(event_json().alias("j")).first()["j"])
    assert one["before"] is None and one["after"]["user"]["email"] == "a@x" and "binlog_file" not in one["source"]
    pretty = text.filter("id = '1'").select(event_json(pretty=True).alias("j")).first()["j"]
    assert "\n  " in pretty and json.loads(pretty) == one


def test_operations(spark):
    df = spark.createDataFrame([("c",), ("x",), (None,)], "op string")
    assert [r[0] for r in df.select(op_error(F.col("op"))).collect()] == [None, "invalid operation code: x", "missing operation"]
    assert envelope().fieldNames() == ["op", "before", "after", "source", "ts_ms", "id"]
    assert spark.range(1).select(source("a", "b").alias("s")).first()["s"]["schema"] == ""
