"""Exclusive running totals per group that no hot group can overload.

A window over a whole group would put a group holding a third of all rows
into one task.  Here the n rows of a group are dealt by a uniform hash into
about sqrt(n) buckets of about sqrt(n) rows; the running sums of the buckets'
totals are their offsets, and only the rows of one bucket are ordered together.
Either window sees about sqrt(n) rows of a group of n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    rows: DataFrame, group: str, key: str, ties: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's earlier rows.

    The order within a group is (bucket, ``key``, ``ties``); ``key`` is a hash
    spread evenly over the longs.  Rows equal in all of these are
    interchangeable.  ``rows`` is read three times and should be a stage table.
    The number of groups must be bounded by the caller (curve cells, sources):
    the table of group sizes, 16 bytes a group, is broadcast.  ``group`` holds
    no nulls.
    """
    groups = rows.groupBy(group).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("_buckets"))
    dealt = rows.join(F.broadcast(groups), group).withColumn("_bucket", F.pmod(F.col(key), F.col("_buckets")))
    sums = dealt.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(group, "_bucket", (F.sum("_sum").over(before) - F.col("_sum")).alias("_offset"))
    inside = (
        Window.partitionBy(group, "_bucket").orderBy(key, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        dealt.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
        .join(offsets, [group, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside", "_bucket", "_buckets")
    )
