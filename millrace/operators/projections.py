"""Shapes of events for programs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_scripts(events: DataFrame) -> DataFrame:
    """The event as a script's object: times as doubles, a missing position as the empty text, no binlog fields."""
    s = F.col("source")
    slim = F.struct(s["db"].alias("db"), s["schema"].alias("schema"), s["table"].alias("table"), F.coalesce(s["lsn"], F.lit("")).alias("lsn"), s["tx_id"].alias("txId"), s["ts_ms"].cast("double").alias("tsMs"), s["snapshot"].alias("snapshot"))
    return events.select("op", "before", "after", slim.alias("source"), F.col("ts_ms").cast("double").alias("tsMs"), "id")


def built(rows: DataFrame) -> DataFrame:
    """Rows (op?, before, after, source, ts_ms, id?) as events: a missing operation is a read, a missing id is made from the source; a row without a source is an error."""
    from ..functions.scalars import event_id
    from ..schema import COLUMNS, SOURCE

    have = set(rows.columns)
    missing = F.raise_error(F.lit("an event needs a source")).cast(SOURCE)
    op = F.coalesce(F.col("op"), F.lit("r")) if "op" in have else F.lit("r")
    given = F.when(F.col("source").isNull(), missing).otherwise(F.col("source")) if "source" in have else missing
    made = rows.withColumns({"op": op, "source": given})
    return made.withColumn("id", F.coalesce(F.col("id"), event_id(F.col("source"))) if "id" in have else event_id(F.col("source"))).select(*COLUMNS)
