"""The rank of each row in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.sources.scratch import settled


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """df with rank (int, from 1) by the order columns; equal rows in any order among themselves.

    Rows are sorted by ranges; a row's place in its task is known there, and the sizes of the tasks
    before it (one row each) are added.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = settled(placed)  # ranges are drawn once
    task, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each task
    sizes = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("n")).select("__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return placed.withColumn("__task", task).join(F.broadcast(sizes), "__task").withColumn("rank", (F.col("__before") + place + 1).cast("int")).select(*df.columns, "rank")
