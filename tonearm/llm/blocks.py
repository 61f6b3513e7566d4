"""Comparing the rows of a bucket with each other, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(rows: DataFrame, keys: list[str], member: str, size: int, least: int = 2) -> DataFrame:
    """Rows of buckets of ``least`` rows or more, dealt out so that every two rows of a bucket meet.

    A bucket of n rows is cut into n / ``size`` blocks by the hash of ``member``. Every pair of
    blocks is a group (``keys``, block_a, block_b) of its own with about 2 * ``size`` rows, so a hot bucket
    is spread over many tasks. ``in_a`` says of which of both blocks a row is.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_rows")).where(F.col("bucket_rows") >= least)
    blocks = F.ceil(F.col("bucket_rows") / size).cast("int")
    dealt = rows.join(sizes, keys).withColumn("own_block", F.pmod(F.xxhash64(member, F.lit(5)), blocks).cast("int"))
    dealt = dealt.withColumn("other_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(
        *rows.columns,
        F.least("own_block", "other_block").alias("block_a"),
        F.greatest("own_block", "other_block").alias("block_b"),
        (F.col("own_block") <= F.col("other_block")).alias("in_a"),
    )


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal ``keys`` in one partition and one after the other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups, and the offsets of the groups; the first ``keys`` columns tell groups apart."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if rest is None else pa.concat_batches([rest, batch])
        cuts = _cuts(table, keys)
        if len(cuts):
            yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            table = table.slice(cuts[-1])
        rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.concatenate([[0], _cuts(rest, keys), [rest.num_rows]]).astype(np.int64)


def _cuts(table: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows at which another group begins, but for the first."""
    new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for i in range(keys):
        column = table.column(i).to_numpy(zero_copy_only=False)
        new |= column[1:] != column[:-1]
    return np.flatnonzero(new) + 1


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes under the links (left, right)."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
