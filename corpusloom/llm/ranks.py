"""Row numbers within groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import staged


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 by ``order`` within ``group``, and ``n``, the rows of the group.

    Rows are sorted over ranges and written with their places, and the groups' parts of
    the ranges, at most one a range and one a group, tell where each part begins. So a hot
    group spreads over as many tasks as it fills. ``group`` must not be null; rows that
    tie in everything are in any order, but keep it. No rows give no rows.
    """
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = staged(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return placed.join(parts, [*group, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "n")
