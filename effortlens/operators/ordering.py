"""Positions in a sorted order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortlens.operators.joins import join_lookup
from effortlens.session import materialise


def running_positions(
    frame: DataFrame, group: str, order: str, tie: str, gap: int = 0, start: int = 0
) -> DataFrame:
    """Add `rank` (from 1, within the group, ascending) and `position` (over all groups, stacked).

    The rows are range-partitioned by (group, order, tie), so equal values and
    large groups spread over many tasks, and written with the number of their
    range. Counts per range and group, a table as long as there are ranges,
    give each range its offset. `gap` positions stay free between two groups,
    `start` before the first.
    """
    sort = [group, order, F.xxhash64(tie), tie]
    ranged = materialise(
        frame.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    counts = ranged.groupBy("_range", group).agg(F.count("*").alias("_n"))
    before = Window.orderBy(group, "_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    groups = F.dense_rank().over(Window.orderBy(group)) - 1
    offsets = counts.select(
        "_range",
        group,
        F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_within"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + groups * gap + start).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_range", group).orderBy(*sort[1:]))
    placed = join_lookup(ranged.withColumn("_local", local), offsets, ["_range", group])
    return placed.select(
        *frame.columns,
        (F.col("_within") + F.col("_local")).alias("rank"),
        (F.col("_before") + F.col("_local")).alias("position"),
    )
