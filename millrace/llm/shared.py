"""Tables in the folder that driver and executors share, and a few helpers that several operators use."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder

WORD = r"[^\x20\x09-\x0D]+"


#: Rows that Python workers get at once: texts are long, and each worker holds a batch or two.
BATCH = 1024


def bounded(spark: SparkSession) -> SparkSession:
    """spark, with small Arrow batches unless someone has chosen their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return spark


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read from there: lineage ends, and a lost executor costs no recomputation."""
    spark = bounded(df.sparkSession)
    path = new_folder(spark)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Rows up to which a list of keys with a number or two each (some 32 MB in memory) is broadcast.
LIST_ROWS = 1_000_000


def listed(df: DataFrame) -> DataFrame:
    """A stored list of keys, marked for broadcast if it is short enough; else it is joined as it is, with a shuffle."""
    return F.broadcast(df) if df.limit(LIST_ROWS + 1).count() <= LIST_ROWS else df


def drop(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_stored_at", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Stored tables that are deleted together, once what was made of them is stored."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def stored(self, df: DataFrame) -> DataFrame:
        self.held.append(stored(df))
        return self.held[-1]

    def drop(self) -> None:
        for df in self.held:
            drop(df)
        self.held.clear()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=32)
def part_names(parts: int) -> np.ndarray:
    """Names for parts such that a shuffle by name into as many partitions gives each partition one part.

    Numbers 0, 1, 2... would share partitions by chance, some tasks with several parts and some with none.
    """
    spark = SparkSession.getActiveSession()
    at = F.pmod(F.hash("id"), F.lit(parts))
    first = spark.range(0, 40 * parts + 1000, 1, 1).groupBy(at.alias("at")).agg(F.min("id").alias("name")).collect()
    names = {r["at"]: r["name"] for r in first}
    rest = iter(range(10**9, 10**9 + parts))
    return np.array([names.get(p, next(rest)) for p in range(parts)], np.int64)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus (a null id counts as the text '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
