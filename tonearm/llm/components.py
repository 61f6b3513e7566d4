"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tonearm.session import materialize

ROWS_A_TASK = 500_000


def _written(edges: DataFrame, tasks: int) -> tuple[DataFrame, tuple[int, int]]:
    """The edges from the shared folder, and their number and a sum of hashes, taken while writing."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0)).alias("mark"))
    stored = materialize(marked.coalesce(tasks))
    return stored, (seen.get["n"], seen.get["mark"])


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); a component is named by its smallest id.

    A large-star step links every id above another one with the smallest neighbour of that; a small-star step
    links what is below an id with the smallest below it. Either maps an edge to one edge, so they
    never grow; they stop when nothing changes. A step is one join of the edges with a minimum for each
    id, which is combined before the shuffle, and Spark splits the partition of a hub. Every step is written to
    the shared folder, which cuts the lineage, by as many tasks as there are rows for. Self links, repeated links and
    either direction are fine; rows with a null end are dropped.
    """
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // ROWS_A_TASK))
    ends = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, state = _written(ends.distinct(), tasks)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large, _ = _written(large, tasks)
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(
            F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges, after = _written(small, tasks)
        if after == state:
            break
        state = after
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")))
    return ids.distinct()
