"""Joins with a small table of counted keys, where a few keys hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that count as frequent.
FREQUENT = 4096


def frequency_split_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, frequent: int = FREQUENT) -> DataFrame:
    """``rows`` joined (inner) with ``table``, which has one row per key and in ``count`` at least its number of rows.

    Keys with more than one ``frequent``-th of all rows are fewer than ``frequent``, whatever the data: they are broadcast,
    and their rows stay where they are. All other keys are joined by shuffle; none of them has more than that share.
    ``rows`` and ``table`` are read twice, so they should be written tables or cheap. The result has the columns of a join
    with ``keys`` once. Keys must not be null.
    """
    least = (table.agg(F.sum(count)).first()[0] or 0) // frequent
    hot = F.broadcast(table.filter(F.col(count) > least))
    cold = rows.join(hot.select(*keys), keys, "left_anti")
    usual = cold.join(table.filter(F.col(count) <= least).hint("merge"), keys)
    return rows.join(hot, keys).unionByName(usual)
