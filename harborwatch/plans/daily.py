"""Daily path with cumulative history: a run reads its own days and a table of first sightings, not earlier logs.

The table has one row per (port, external address), in the folder of the day that saw the address first, and is bucketed by
that key. A run groups its days' addresses, deals these few rows to the buckets and anti-joins them; the table itself is not
shuffled, and folders of later days are not read. What remains is at once the table's growth and the number of new addresses of
each window. Running a day again replaces its folder. A day that arrives late is run like any other; features and folders of
days after it are right again once those days are run again, earliest first.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.operators import features, history
from harborwatch.schema import FEATURES, Params
from harborwatch.session import cut_lineage
from harborwatch.sources import tables


def _rows_of(conns: DataFrame, days: list[date], p: Params) -> DataFrame:
    """Connections of the days; the range reaches the scan, which a filter on the report day would not."""
    start, _ = features.f.day_bounds(min(days), p.report_tz)
    _, end = features.f.day_bounds(max(days), p.report_tz)
    rows = features.profiled_connections(features.between(conns, start, end, p), p)
    return rows.filter(F.col("day").isin([F.lit(d) for d in days]))


def record_first_seen(conns: DataFrame, days: list[date], name: str, p: Params) -> None:
    """Adds the addresses that ``days`` (together, one run) see first to the table ``name``.

    Other connections are ignored. What the table holds of the first of ``days`` and later is no history for them.
    """
    if not days:
        return
    spark = conns.sparkSession
    earlier = spark.table(name).filter(F.col("first_day") < F.lit(min(days)))
    found = history.unseen(history.first_sightings(_rows_of(conns, days, p)), earlier, tables.first_seen_buckets(spark, name))
    # Fixed before the table changes, which it is read from.
    tables.sink_first_seen(cut_lineage(found), days, name)


def recorded_features(conns: DataFrame, days: list[date], name: str, p: Params) -> DataFrame:
    """Sparse feature rows of ``days`` (at least one), whose first sightings are in the table ``name``."""
    rows, key = _rows_of(conns, days, p), features.KEY
    found = conns.sparkSession.table(name).filter(
        F.col("first_day").isin([F.lit(d) for d in days]) & F.col("port").isNotNull())
    new = found.groupBy(F.col("first_day").alias("day"), "timewindow", "port").agg(F.count(F.lit(1)).alias("_new"))
    counts = features.window_peers(rows).groupBy(*key).agg(
        F.count_if("external").alias("external_ips"), F.count_if(~F.col("external")).alias("internal_ips"))
    counts = counts.join(new, key, "left").withColumn("new_external_ips", F.coalesce("_new", F.lit(0).cast("long")))
    return features.traffic_statistics(rows).join(counts, key).select(*key, *FEATURES)
