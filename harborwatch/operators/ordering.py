"""Ordinals and running totals over groups of any size.

A plain ``row_number().over(partitionBy(group))`` sorts a whole group in one task, which fails when one
group holds a large share of the rows. Here rows are range-partitioned by the order columns, so a hot group
is spread over all partitions; totals inside a partition are then shifted by the totals of the partitions
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.session import cut_lineage

_PART = "_range_part"


def running_totals(
    df: DataFrame,
    order: list[str],
    totals: dict[str, tuple[list[str], Column]],
) -> DataFrame:
    """Add running sums (current row included) in ``order``.

    ``totals`` maps an output name to (group columns, value); group columns must not be NULL. ``order`` must be
    a total order within each group for the result to be unique. The range partitions are checkpointed because the partition number is
    used twice and a recomputed sample could move the borders.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = cut_lineage(
        df.repartitionByRange(n_parts, *order).withColumn(_PART, F.spark_partition_id())
    )
    by_group: dict[tuple[str, ...], dict[str, Column]] = {}
    for name, (group, value) in totals.items():
        by_group.setdefault(tuple(group), {})[name] = value

    result = tagged
    for group, columns in by_group.items():
        keys = [*group, _PART]
        inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        earlier = W.partitionBy(*(list(group) or [F.lit(0)])).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
        # One row per (group, range partition): small next to the data.
        shifts = tagged.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in columns.items()]).select(
            *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_shift_{n}") for n in columns])
        # The window already placed and sorted the rows by these keys, so the merge moves only the shifts. Without the hint
        # the rows may be taken for the small side and be sent to the driver and every task.
        result = (
            result.withColumns({n: F.sum(v).over(inside) for n, v in columns.items()})
            .join(shifts.hint("merge"), keys)
            .withColumns({n: F.col(n) + F.col(f"_shift_{n}") for n in columns})
            .drop(*[f"_shift_{n}" for n in columns])
        )
    return result.drop(_PART)


def ordinals(df: DataFrame, order: list[str], names: dict[str, list[str]]) -> DataFrame:
    """Add 1-based row numbers in ``order``; ``names`` maps output name -> group columns."""
    return running_totals(df, order, {n: (g, F.lit(1).cast("long")) for n, g in names.items()})


def window_ordinals(windows: DataFrame, group: list[str], order: list[str], block: str, name: str) -> DataFrame:
    """Row numbers for tables that hold at most one day of windows per (group, block).

    Blocks are counted first, so each sort sees one block only. The windows lie sorted by these keys, so the merge moves
    only the counts; the windows are never the side that is sent to the driver and every task.
    """
    inside = W.partitionBy(*group, block).orderBy(*order)
    earlier = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    shift = (
        windows.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    return (
        windows.withColumn(name, F.row_number().over(inside))
        .join(shift.hint("merge"), [*group, block])
        .withColumn(name, (F.col(name) + F.col("_shift")).cast("long"))
        .drop("_shift")
    )
