"""Key-range chunks of a table: plan, row counts, skew, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAN = "table string, chunk long, start_key long, end_key long, status string"


def classify_keys(schema: T.StructType, keys: list[str]) -> str:
    """none, single_integer, single_other or composite."""
    if not keys:
        return "none"
    if len(keys) > 1:
        return "composite"
    return "single_integer" if isinstance(schema[keys[0]].dataType, T.IntegralType) else "single_other"


def key_range(df: DataFrame, key: str) -> DataFrame:
    """min_key and max_key; one row, nulls for an empty table."""
    return df.agg(F.min(key).cast("long").alias("min_key"), F.max(key).cast("long").alias("max_key"))


def chunk_plan(spark: SparkSession, table: str, low: int | None, high: int | None, n: int) -> DataFrame:
    """n chunks of low..high, start inclusive, end exclusive, the end open where it would pass high.

    Without a range (an empty table, keys that aren't integers) one chunk without bounds.
    """
    if n < 1:
        raise ValueError("at least one chunk is needed")
    if low is None or high is None or high < low:
        return spark.createDataFrame([(table, 0, None, None, "pending")], PLAN)
    size, extra = max(1, (high - low + 1) // n), (high - low + 1) % n if high - low + 1 >= n else 0
    start = F.lit(low) + F.col("id") * size + F.least("id", F.lit(extra))
    end = start + size + (F.col("id") < extra).cast("long")
    return spark.range(n).select(F.lit(table).alias("table"), F.col("id").alias("chunk"), start.alias("start_key"), F.when(end <= high, end).alias("end_key"), F.lit("pending").alias("status"))


def in_chunk(key: Column, start: int | None, end: int | None) -> Column:
    """The predicate of one chunk; true where both bounds are open."""
    out = F.lit(True)
    if start is not None:
        out = key >= start
    if end is not None:
        out = (key < end) if start is None else out & (key < end)
    return out


def where_clause(key: Column, start: Column, end: Column) -> Column:
    """A chunk's predicate as SQL text (TRUE where both bounds are open)."""
    low, high = F.concat(key, F.lit(" >= "), start.cast("string")), F.concat(key, F.lit(" < "), end.cast("string"))
    return F.coalesce(F.concat(low, F.lit(" AND "), high), low, high, F.lit("TRUE"))


def assign_chunk(key: Column, low: int, high: int, n: int) -> Column:
    """Number of the chunk of chunk_plan() that a key in the range falls in: arithmetic, no join."""
    length = high - low + 1
    size, extra = max(1, length // n), length % n if length >= n else 0
    at = key.cast("long") - low
    wide = (size + 1) * extra
    # whole-number division: a double would misplace keys beyond 2**53
    number = F.when(at < wide, F.call_function("div", at, F.lit(size + 1))).otherwise(F.call_function("div", at - wide, F.lit(size)) + extra)
    return F.greatest(F.lit(0).cast("long"), F.least(number, F.lit(n - 1).cast("long")))


def count_rows(df: DataFrame, key: str, low: int, high: int, n: int, table: str) -> DataFrame:
    """table, chunk, n_rows for every chunk, empty ones too.  The table is counted once, not once a chunk."""
    counts = df.groupBy(assign_chunk(F.col(key), low, high, n).alias("chunk")).agg(F.count("*").alias("n_rows"))
    plan = chunk_plan(df.sparkSession, table, low, high, n).select("table", "chunk")
    return plan.join(counts, "chunk", "left").select("table", "chunk", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def skew(counts: DataFrame, factor: float = 2.0) -> DataFrame:
    """Mean and deviation of n_rows by table, and whether the deviation passes factor times the mean."""
    out = counts.groupBy("table").agg(F.count("*").alias("n_chunks"), F.avg("n_rows").alias("mean_rows"), F.stddev_pop("n_rows").alias("stddev_rows"))
    return out.withColumn("skewed", (F.col("n_chunks") > 1) & (F.col("mean_rows") > 0) & (F.col("stddev_rows") > factor * F.col("mean_rows")))


def pending(plan: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks of a stored plan that the log (table, chunk, status) hasn't completed; the plan's own bounds stay."""
    return plan.join(log.filter("status = 'completed'").select("table", "chunk").distinct(), ["table", "chunk"], "left_anti")


def status_text(status: Column, rows: Column, message: Column) -> Column:
    """How a chunk's status reads."""
    return F.when(status == "completed", F.format_string("completed (%d rows)", rows)).when(status == "failed", F.concat(F.lit("failed: "), message)).otherwise(status)
