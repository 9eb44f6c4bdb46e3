"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled line of words, cut into blocks of equal length.  Slot i of the
schedule takes point i of a golden-ratio sequence, held as a 64-bit fraction; the source in whose share of the
cumulative targets the point falls gets the slot.  A source's r-th slot takes block r of its line, which starts anew at its
end, within a block if need be: each slot holds as many words, the last of the last pass excepted, and every stretch of the mix is close to the target shares.

Null text has size 0; a null source is a source of its own, after the others; an empty table gives no rows; equal
doc_ids are separate documents.  Other columns are ignored, or kept as they are if asked for.  The driver and each task hold one row per source and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, stored
from .text import chunks

GOLDEN = 0x9E3779B97F4A7C15
#: Slots that one row of the schedule's first pass counts.
STRETCH = 1 << 16


def word_counts(text: int):
    """Batches with the column size, the number of words of their column `text`, behind the others."""

    def count(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(text)):
                sizes[chunk.lo : chunk.hi] = np.diff(chunk.words().rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes)], names=[*batch.schema.names, "size"])

    return count


def summed_ahead(df: DataFrame, group: list[str], order: str, value: str, name: str, width: int = 1024) -> DataFrame:
    """df with the sum of `value` over the group's rows of smaller `order` (a whole number), in two levels: no task gets more than `width` rows of a group,
    or a row for each `width` of them."""
    level = F.floor(F.col(order) / F.lit(width)).alias("_level")
    tops = df.groupBy(*group, level).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*group, "_level", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy(*group, "_level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_level", level).join(tops, [*group, "_level"]).withColumn(name, F.col("_ahead") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_level", "_ahead")


def targets(sizes: dict, weights: tuple = (5, 2, 1), most: float = 3.0) -> dict:
    """Target of each source: shares by weight of all sizes, at most `most` times its size, the excess reshared by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = float(sum(sizes.values())), {}
    free = list(names)
    while free:
        left, by = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / by > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / by for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        free = [s for s in free if s not in set(over)]
    return out


def slots_of(first: int, n: int, ends: np.ndarray) -> np.ndarray:
    """Index of the source of each of the slots first .. first+n-1; ends: upper ends of the sources' shares as 64-bit fractions."""
    with np.errstate(over="ignore"):
        points = (np.arange(first, first + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    return np.minimum(np.searchsorted(ends, points, side="right"), len(ends) - 1)


def schedule(spark: SparkSession, n_slots: int, shares: list[float]) -> DataFrame:
    """slot, source (its index), rank (of the slot among the source's): the first n_slots of the sequence."""
    cumulative = np.cumsum(np.asarray(shares, float))
    ends = np.array([min(int(c / cumulative[-1] * 2**64), 2**64 - 1) for c in cumulative], np.uint64)
    stretches = -(-n_slots // STRETCH)

    def length(stretch):
        return min(STRETCH, n_slots - stretch * STRETCH)

    def count(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = np.bincount(slots_of(k * STRETCH, length(k), ends), minlength=len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), k)), pa.array(np.arange(len(ends), dtype=np.int32)), pa.array(found.astype(np.int64))], names=["stretch", "source", "n"])

    def deal(batches):
        for batch in batches:
            for k, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = np.array([x["before"] for x in sorted(before, key=lambda x: x["source"])], np.int64)
                of = slots_of(k * STRETCH, length(k), ends)
                order = np.argsort(of, kind="stable")
                firsts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ends)))[:-1]])
                rank = np.empty(len(of), np.int64)
                rank[order] = np.arange(len(of)) - firsts[of[order]] + before[of[order]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(of)) + k * STRETCH), pa.array(of.astype(np.int32)), pa.array(rank)], names=["slot", "source", "rank"])

    parts = min(stretches, 4 * spark.sparkContext.defaultParallelism) or 1
    counts = spark.range(0, stretches, 1, parts).mapInArrow(count, "stretch long, source int, n long")
    prefix = summed_ahead(counts, ["source"], "stretch", "n", "before")
    return prefix.groupBy("stretch").agg(F.collect_list(F.struct("source", "before")).alias("before")).mapInArrow(deal, "slot long, source int, rank long")


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0, block: int = 128, seed: int = 7, per_bucket: int = 256, keep: tuple = ()) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, size, source_size, target, taken, and the columns in keep.

    taken: words the mix takes of the document, repeats counted; at most `most` whole passes are made over a source.
    """
    spark = docs.sparkSession
    # the kept columns go under names of their own, so that none can clash
    kept = {c: f"kept_{i}" for i, c in enumerate(keep)}
    given = docs.select("doc_id", "source", "text", *(F.col(c).alias(n) for c, n in kept.items()))
    sized = given.mapInArrow(word_counts(2), given.withColumn("size", F.lit(0).cast("long")).schema).drop("text")
    whole = stored(sized.withColumn("row", F.monotonically_increasing_id()).withColumn("at", F.xxhash64("doc_id", "size", F.lit(seed))))
    sized = whole.drop(*kept.values())
    found = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    size = {s: x[0] for s, x in found.items()}
    aims, names = targets(size, weights, most), sorted(size, key=lambda s: (s is None, s or ""))
    buckets = max(1, -(-sum(x[1] for x in found.values()) // per_bucket))
    table = spark.createDataFrame([(i, s, size[s], float(aims[s])) for i, s in enumerate(names)], "source_no int, source string, source_size long, target double")
    placed = sized.join(table, sized["source"].eqNullSafe(table["source"])).select("doc_id", sized["source"], "size", "source_size", "target", "source_no", "row", "at", F.pmod("at", F.lit(buckets)).alias("bucket"))
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    sums = summed_ahead(sums, ["source_no"], "bucket", "words", "ahead").drop("words")
    inside = Window.partitionBy("source_no", "bucket").orderBy("at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = placed.join(sums, ["source_no", "bucket"]).withColumn("end", F.col("ahead") + F.sum("size").over(inside)).withColumn("start", F.col("end") - F.col("size"))
    # the line as often as it may be read, one pass after the other
    pieces = (
        line.filter("size > 0")
        .select("source_no", "row", "start", "end", F.explode(F.expr(f"transform(sequence(0, {int(most) - 1}), k -> k * source_size)")).alias("pass"))
        .select("source_no", "row", (F.col("start") + F.col("pass")).alias("start"), (F.col("end") + F.col("pass")).alias("end"))
        .select("source_no", "row", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))
        .select("source_no", "row", "block", F.expr(f"least(end, (block + 1) * {block}) - greatest(start, block * {block})").alias("words"))
    )
    total = sum(size.values())
    if total:
        slots = schedule(spark, -(-total // block), [aims[s] for s in names]).withColumnRenamed("source", "source_no")
        used = slots.select("source_no", F.col("rank").alias("block"))
        taken = pieces.join(used.hint("merge"), ["source_no", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
    else:
        taken = spark.createDataFrame([], "row long, taken long")
    out = placed.join(taken, "row", "left")
    if kept:
        out = out.join(whole.select("row", *kept.values()), "row")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(F.col(n).alias(c) for c, n in kept.items()))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")
