"""Joining rows with a lookup whose keys may each hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one part in this many, times the shuffle partitions, of all rows. At most so many
# keys can, which bounds what is broadcast.
SHARES = 4


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, heat: str, spread_by: str) -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has one row for each ``key`` and in ``heat`` its number of rows.

    The hot keys are read off ``heat`` and broadcast; their rows get a spread key that matches nothing in the shuffled join
    and so are dealt over all tasks by ``spread_by``. Rows without a match are kept with nulls.
    """
    values = [name for name in lookup.columns if name != key]
    parts = SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.agg(F.coalesce(F.sum(heat), F.lit(0)).alias("total"))
    hot = lookup.where(F.col(heat) * parts > total.scalar()).select(key, F.struct(*values).alias("_hot"))
    cold = lookup.select(key, F.lit(0).alias("_spread"), F.struct(*values).alias("_cold"))
    known = rows.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("_hot").isNull(), 0).otherwise((F.pmod(F.xxhash64(spread_by), F.lit(4 * parts)) + 1).cast("int"))
    joined = known.withColumn("_spread", spread).join(cold, [key, "_spread"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[name].alias(name) for name in values])
