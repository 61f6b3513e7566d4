"""Exact places of rows in the order of their group, whatever the size of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import materialize

# monotonically_increasing_id() holds the number of the partition above these bits.
PART_BITS = 33


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with their ``position`` (from 0) in their ``group`` by ``order``, nulls first, and its ``size``.

    Rows are dealt out by ranges of (group, order), so a group of any size is spread over many tasks. The
    line number in the dealt table and one row for each group and partition (its first line, its rows) give the
    position; no window ever holds the rows of a group. Rows that are equal in ``order`` come in any order.
    """
    by = [F.asc_nulls_first(name) for name in (group, *order)]
    lined = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("line", F.monotonically_increasing_id())
    stored = materialize(lined).withColumn("part", F.shiftright("line", PART_BITS))
    runs = stored.groupBy(group, "part").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col(group).alias("_group"), F.col("part").alias("_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"),
        F.sum("n").over(Window.partitionBy(group)).alias("size"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))
    return stored.join(runs, same).select(*rows.columns, (F.col("line") + F.col("base")).alias("position"), "size")
