import hashlib
import hmac

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.plans.backoff import Backoff, spread


def value(spark, column, **inputs):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())) if inputs else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, number", [("0/0", 0), ("0/ABCDEF", 0xABCDEF), ("1/0", 2**32), ("FFFFFFFF/FFFFFFFF", 2**64 - 1), ("16/B374D848", 0x16B374D848), ("00000016/b374d848", 0x16B374D848)])
def test_positions(spark, text, number):
    assert value(spark, S.lsn_parse(F.lit(text))) == number
    assert value(spark, S.lsn_format(F.lit(str(number)).cast("decimal(20,0)"))) == f"{number >> 32:X}/{number & 0xFFFFFFFF:08X}"


@pytest.mark.parametrize("text", ["", "0", "0/", "/0", "1/2/3", "G/0", "123456789/0", "0/123456789", "-1/0", None])
def test_bad_positions(spark, text):
    assert value(spark, S.lsn_parse(F.lit(text).cast("string"))) is None


@pytest.mark.parametrize("us, ms", [(0, 946684800000), (1_000_000, 946684801000), (3_600_000_000, 946688400000), (-1, 946684800000), (-1500, 946684799999), (-(10**17), 0)])
def test_pg_time(spark, us, ms):
    assert value(spark, S.pg_us_to_unix_ms(F.lit(us).cast("long"))) == ms


@pytest.mark.parametrize(
    "text, ms",
    [("2024-05-31T12:00:00.123456Z", 1717156800123), ("2024-05-31T12:00:00.5+00:00", 1717156800500), ("2024-05-31 12:00:00.123456+00", 1717156800123), ("2024-05-31 12:00:00", 1717156800000), ("2024-05-31T14:00:00+0200", 1717156800000), ("2024-05-31", None), ("x", None), (None, 0)],
)
def test_iso_time(spark, text, ms):
    assert value(spark, S.wal2json_ts(F.lit(text).cast("string"))) == ms


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=80), min_size=1, max_size=20), st.binary(min_size=1, max_size=100))
def test_hmac(spark, texts, key):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    if texts:
        got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(S.hmac_sha256(F.col("t"), key).alias("x")).collect()]
        assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_hmac_needs_a_key():
    with pytest.raises(ValueError):
        S.hmac_sha256(F.lit("x"), b"")


@pytest.mark.parametrize("text, json", [("42", "42"), ("-0", "0"), ("9223372036854775808", "9223372036854775808.0"), ("1e400", '"1e400"'), ("t", '"t"'), (None, "null"), ("3.14", "3.14"), (" 1", '" 1"')])
def test_inferred(spark, text, json):
    got = value(spark, S.inferred_json(F.lit(text).cast("string")))
    assert got == json or float(got) == float(json)


def test_names():
    assert S.qualified("a.b.c") == ("a", "b.c") and S.qualified("t") == ("public", "t")
    assert S.quote_ident('a"b') == '"a""b"'


def test_ids(spark):
    assert value(spark, S.snapshot_id("s", "t", ["k", "j"]), k=1, j=None) == "snap:s.t:k=1:j=NULL"
    df = spark.range(2).select(S.snapshot_id("s", "t", []).alias("x"))
    a, b = (r["x"] for r in df.collect())
    assert a != b and a.startswith("snap:s.t:")


def test_backoff():
    plain = Backoff(jitter=False)
    assert [plain.wait_ms(i) for i in range(11)] == [500, 1000, 2000, 4000, 8000, 16000, 30000, 30000, 30000, 30000, None]
    for i in range(10):
        assert 0.8 * plain.wait_ms(i) - 1 <= Backoff().wait_ms(i) <= min(30000, 1.2 * plain.wait_ms(i))
        assert -0.2 <= spread(i) <= 0.2
    with pytest.raises(Exception, match="retries exhausted"):
        plain.wait_or_fail(10)
