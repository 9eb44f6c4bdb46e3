import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from millrace.errors import SnapshotError
from millrace.plans.database import in_database

CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

name, sf, shared = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", json.dumps(sorted(map(list, entry.queries()[name](spark, sf).collect()))))
"""


def on_cluster(name, sf_dir, tmp_path):
    """Rows of a query whose executors are processes of their own."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in a folder of Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "shared").mkdir()
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", CLUSTER, name, sf_dir, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "ROWS " in done.stdout, done.stderr[-3000:]
    return json.loads(done.stdout.partition("ROWS ")[2].splitlines()[0])


def test_chunks_on_cluster(spark, sf_dir, tmp_path):
    got = on_cluster("jdbc_chunks", sf_dir, tmp_path)
    want = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").collect()
    assert [r[:3] for r in got] == sorted(map(list, want))
    assert [r[3] for r in got] == sorted(r[3] for r in got) and {r[3] for r in got} == {0, 1, 2, 3}


def test_page_on_cluster(spark, sf_dir, tmp_path):
    got = on_cluster("jdbc_ordered_scan", sf_dir, tmp_path)
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").filter("o_orderkey >= 100 AND o_orderkey < 1100").collect()]
    assert got == [[i, k] for i, k in enumerate(sorted(keys)[:250], 1)]


def test_rows_stay_as_they_are(spark, tmp_path):
    kind = "k long, n int, d double"
    rows = [(1, None, 0.1), (-(1 << 63), 2, None), (None, -3, 1e-300), ((1 << 63) - 1, 4, 1.7e308), (1, None, 0.1)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for some in (rows, []):
        url = in_database(spark, spark.createDataFrame(some, kind).repartition(3), "numbers")
        got = spark.read.jdbc(url, "numbers")
        assert got.dtypes == [("k", "bigint"), ("n", "int"), ("d", "double")]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(some, key=key)
    with pytest.raises(SnapshotError):
        in_database(spark, spark.sql("SELECT 'x' AS s"), "texts")


CLEARED = """
import json, os, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

sf, home = sys.argv[1:]
conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.local.dir": f"{home}/local", "spark.checkpoint.dir": f"file://{home}/shared é"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
entry.queries()["jdbc_chunks"](spark, sf).write.parquet(f"{home}/chunks")
os.rename(f"{home}/temp", f"{home}/gone")
print("ROWS", json.dumps([sorted(map(list, entry.queries()[name](spark, sf).collect())) for name in ("jdbc_ordered_scan", "jdbc_chunks")]))
"""


def test_own_temporary_folder_cleared(spark, sf_dir, tmp_path):
    """A query still reads its database when the process's own temporary folder went after the query before."""
    (tmp_path / "temp").mkdir()
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--driver-memory 600m --driver-java-options -Djava.io.tmpdir={tmp_path}/temp pyspark-shell"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", CLEARED, sf_dir, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "ROWS " in done.stdout, done.stderr[-3000:]
    page, rows = json.loads(done.stdout.partition("ROWS ")[2].splitlines()[0])
    orders = sorted(map(list, spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").collect()))
    assert [r[:3] for r in rows] == orders
    assert page == [[i, k] for i, k in enumerate([k for k, *_ in orders if 100 <= k < 1100][:250], 1)]
