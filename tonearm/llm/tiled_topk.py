"""Exact top-k by inner product: tiled matrix products and merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.sign_hash import usable

K = 5
SHARD = 16_384  # candidates of a cell
BLOCK = 4_096  # queries of a cell
TILE = 128  # queries of one matrix product
FAN_IN = 16
_EXACT = float(1 << 53)


def whole_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id and the whole numbers floor(scale * x) of each usable vector, x in double precision."""

    def run(batches):
        for batch in batches:
            found = [(i, np.floor(scale * v)) for i, v in enumerate(usable(batch.column(1))) if v is not None]
            rows = pa.array([i for i, _ in found], pa.int64())
            blobs = pa.array([v.tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), blobs], ["id", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where("id is not null and vector is not null").mapInArrow(run, "id long, vector binary")


def _matrix(table: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids, and by dimension the rows and their matrix."""
    ids = table.column(2).to_numpy()
    blobs = table.column(3).to_pylist()
    lengths = np.array([len(b) // 8 for b in blobs])
    return ids, {int(d): (np.flatnonzero(lengths == d), np.frombuffer(b"".join(b for b in blobs if len(b) == 8 * d)).reshape(-1, d)) for d in np.unique(lengths)}


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: by doubles where every sum is exact, else by integers."""
    top = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if top < _EXACT:
        return (queries @ shard.T).astype(np.int64)
    return queries.astype(np.int64) @ shard.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller id, in order; ids ascend."""
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        rows, columns = np.nonzero(scores >= bound)
    else:
        rows, columns = np.nonzero(np.ones(scores.shape, dtype=bool))
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[place < k], columns[place < k]


def top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: float = 256.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of all other rows for each query.

    Queries are the rows whose vec_id is divisible by ``every``. Components become floor(scale * x); the score
    is the inner product of these. Ties go to the smaller vec_id. Candidates are dealt into shards
    and queries into blocks, both by hash; each cell of the grid is one task with tiled matrix products
    that keeps the k best of a query by partial selection. The lists are then merged in a tree of
    ``FAN_IN`` cells a step. Every pair is scored.

    A query doesn't meet rows of its own vec_id. Repeated rows of another vec_id count each; query rows
    that share a vec_id are asked together and have one list. Vectors of another length than the query's,
    and vectors that are null, empty or hold null or non-finite components, take no part; so do rows without
    a vec_id. Fewer than k candidates give fewer rows, an empty table none. Scores beyond 64 bits wrap.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale)
    ids = vectors.select(F.col("vec_id").cast("long").alias("id")).where("id is not null")
    count, asked = ids.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    cells = max(spark.sparkContext.defaultParallelism, -(-count // shard))
    groups = max(1, -(-asked // block))
    cell = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(cells)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int")
    candidates = rows.select(cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "vector")
    queries = rows.where(F.col("id") % every == 0).distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("at_cell"), group.alias("of_group"),
        F.col("id").alias("query"), F.col("vector").alias("query_vector"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            found = [out]
            left_ids, left_by = _matrix(left)
            right_ids, right_by = _matrix(right)
            for dim, (own, matrix) in right_by.items():
                if dim not in left_by:
                    continue
                at, shard_matrix = left_by[dim]
                shard_ids = left_ids[at]
                for low in range(0, len(own), TILE):
                    asking = right_ids[own[low : low + TILE]]
                    scores = _products(matrix[low : low + TILE], shard_matrix)
                    # One more than k where the query itself may be among the shard's rows.
                    mine = asking[:, None] == shard_ids[None, :]
                    extra = int(mine.sum(axis=1).max(initial=0))
                    r, c = _best(scores, shard_ids, k + extra)
                    other = asking[r] != shard_ids[c]
                    r, c = r[other], c[other]
                    place = np.arange(len(r)) - np.searchsorted(r, r, "left")
                    r, c = r[place < k], c[place < k]
                    found.append([asking[r], shard_ids[c], scores[r, c]])
            out = [np.concatenate(x) for x in zip(*found)]
        cell_no = int((left if left.num_rows else right).column(0)[0].as_py())
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2], "cell": pa.array(np.full(len(out[0]), cell_no), pa.int32())})

    lists = candidates.groupBy("cell", "group").cogroup(queries.groupBy("at_cell", "of_group")).applyInArrow(
        run, "query_id long, vec_id long, score long, cell int")
    while True:
        last = cells <= FAN_IN
        cells = -(-cells // FAN_IN)
        lists = lists.withColumn("cell", F.lit(0) if last else F.floor(F.col("cell") / FAN_IN).cast("int"))
        order = Window.partitionBy("query_id", "cell").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if last:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
