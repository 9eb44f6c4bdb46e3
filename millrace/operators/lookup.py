"""Lookups of what was last announced: the schema in force at a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Places that one stretch of a key's line covers.
STRETCH = 1 << 16


def as_of(rows: DataFrame, log: DataFrame, keys: list[str], order: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with the column `name`: the log's last row (a struct of its other columns) of the same keys at or before the row's place, a whole number; null if none.

    Both are laid in one line, cut into stretches of `stretch` places, and the last announcement is carried forward within each; what a stretch
    begins with comes from the last announcements of the stretches before it, of which there is one row each.  So a key's line is no one task's,
    however busy the key, and no join multiplies.
    """
    value = F.struct(*(c for c in log.columns if c not in {*keys, order}))
    said = log.select(*keys, F.col(order).cast("long").alias("_at"), F.lit(0).alias("_kind"), value.alias("_said"), F.lit(None).cast(rows.schema).alias("_row"))
    kind = said.schema["_said"].dataType
    asks = rows.select(*keys, F.col(order).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_said"), F.struct(*rows.columns).alias("_row"))
    line = said.unionByName(asks).withColumn("_stretch", F.floor(F.col("_at") / F.lit(stretch)))
    ends = line.groupBy(*keys, "_stretch").agg(F.max_by("_said", F.when(F.col("_said").isNotNull(), F.col("_at"))).alias("_said"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begin = ends.withColumn("_said", F.last("_said", ignorenulls=True).over(before)).filter("_said is not null")
    begin = begin.select(*keys, F.lit(None).cast("long").alias("_at"), F.lit(-1).alias("_kind"), "_said", F.lit(None).cast(rows.schema).alias("_row"), "_stretch")
    within = Window.partitionBy(*keys, "_stretch").orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.unionByName(begin).withColumn(name, F.last("_said", ignorenulls=True).over(within)).filter("_kind = 1").select("_row.*", name)


def with_relation(changes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes (relation_id, seq, ...) with the relation in force, and those whose relation was never announced."""
    found = as_of(changes, relations, ["relation_id"], "seq", "relation")
    return found.filter("relation is not null"), found.filter("relation is null").drop("relation")


def primary_keys(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Key columns of tables in order of their place: indexes (table_id, is_primary, key_places) and attributes (table_id, place, name)."""
    return indexes.filter("is_primary").join(attributes, "table_id").filter("array_contains(key_places, place)").groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("keys"))


def flagged_keys(columns: DataFrame) -> DataFrame:
    """Key columns of tables in order of their place: columns (table_name, name, place, column_key), PRI for a key's."""
    return columns.filter("column_key = 'PRI'").groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("keys"))


def ordinals(events: DataFrame, transaction: str = "xid", order: str = "seq") -> DataFrame:
    """events with idx: their place in their transaction, from 0."""
    return events.withColumn("idx", F.row_number().over(Window.partitionBy(transaction).orderBy(order)) - 1)


def too_large(events: DataFrame, transaction: str = "xid", most: int = 10_000) -> DataFrame:
    """Transactions with more than `most` events: transaction, n_events."""
    return events.groupBy(transaction).agg(F.count("*").alias("n_events")).filter(F.col("n_events") > most)
