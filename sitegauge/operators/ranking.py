"""Row numbers and running sums over groups of any size.

A window partitioned by a publication tab or by an API name puts each whole
group into one task.  Here rows are range-partitioned on (group, order keys), so
a group that holds a third of the table is spread over many tasks.  Every task
numbers its own slice; the offsets of the slices come from one row per
(slice, group), which is at most slices + groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import reliable


def _sliced(df: DataFrame, group: list[str], order: list[Column], slices: int | None) -> DataFrame:
    keys = [F.col(g) for g in group] + order
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # Written out once: both passes below must see the same slices, and a lost
    # executor must not lead to another cut of the ranges.
    return reliable(
        ranged.withColumn("_slice", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )


def _with_offsets(rows: DataFrame, totals: DataFrame, group: list[str], extra: list[str]) -> DataFrame:
    """Join each row to the sum of the slices of its group that come before its own."""
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_slice").alias("_o_slice"),
        *[F.col(g).alias(f"_o_{g}") for g in group],
        F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"),
        *extra,
    )
    cond = F.col("_slice") == F.col("_o_slice")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return rows.join(offsets, cond)


def global_row_number(df: DataFrame, group: list[str], order: list[Column], name: str = "row_number",
                      slices: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without one task per group.

    ``order`` must end in a unique key.  Pass narrow rows (keys and order columns): they
    are written to the checkpoint folder once.
    """
    rows = _sliced(df, group, order, slices)
    sizes = rows.groupBy("_slice", *group).agg(F.count("*").alias("_part"), F.min("_pos").alias("_first"))
    joined = _with_offsets(rows, sizes, group, ["_first"])
    number = (F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast("long")
    return joined.select(*df.columns, number.alias(name))


def global_running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, name: str,
                       slices: int | None = None) -> DataFrame:
    """Running sum inside each group, by slice totals plus a window inside each slice."""
    rows = _sliced(df, group, order, slices)
    sums = rows.groupBy("_slice", *group).agg(F.sum(value).alias("_part"))
    inside = Window.partitionBy("_slice", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(inside))
    return _with_offsets(local, sums, group, []).select(
        *df.columns, (F.col("_offset") + F.col("_local")).alias(name)
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  The rank filter is applied before the shuffle
    too, so each task sends at most ``k`` rows of a group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
