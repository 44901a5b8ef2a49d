"""Running sums, ranks and running minima over keys of any size.

A window over a key sorts all its rows in one task. Here rows are dealt into ranges of (key, order) first, so that a key which
holds most of the rows spans many tasks; windows run within a range, and what lies before or behind it comes from one
number a range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import beside, settled

_RANGE = "_range"


def ranges(df: DataFrame, by: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` dealt into ranges of (``by``, ``order``), and settled; ``_range`` numbers them in that order.

    ``parts`` defaults to the session's shuffle partitions. Rows equal in all of these columns share a range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(parts, *by, *order).withColumn(_RANGE, F.spark_partition_id()))


def _by_range(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """One row a range and key of it: as many rows as there are ranges and keys."""
    return rows.groupBy(_RANGE, *by).agg(value.alias("_own"))


def running_sum(rows: DataFrame, by: list[str], order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """``rows`` of ``ranges`` with ``name``: the sum of ``amount`` over the key's rows that stand before (0 for the first)."""
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = _by_range(rows, by, F.sum(amount)).withColumn("_own", F.coalesce(F.sum("_own").over(earlier), F.lit(0)))
    within = Window.partitionBy(_RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return beside(local, sums, [_RANGE, *by]).withColumn(name, F.col(name) + F.col("_own")).drop("_own")


def least_behind(rows: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` of ``ranges`` with ``name``: the least ``value`` of the row and all of the key's rows behind it."""
    later = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(1, Window.unboundedFollowing)
    least = _by_range(rows, by, F.min(value)).withColumn("_own", F.min("_own").over(later))
    within = Window.partitionBy(_RANGE, *by).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = rows.withColumn(name, F.min(value).over(within))
    return beside(local, least, [_RANGE, *by]).withColumn(name, F.least(name, F.coalesce("_own", name))).drop("_own")
