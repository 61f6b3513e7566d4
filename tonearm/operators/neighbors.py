"""Exact k nearest neighbours of all vectors by a tree of pivots, rings and balls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonearm import session
from tonearm.functions import arrays

# Pivots of one level of the tree, vectors of one block, and blocks of one leaf. Two levels of pivots give leaves of this
# size up to PIVOTS ** 2 * LEAF_BLOCKS * BLOCK_ROWS vectors (a thousand million); larger leaves are built in parts.
PIVOTS = 256
BLOCK_ROWS = 1024
LEAF_BLOCKS = 16
# Blocks of visitors that one task takes, and blocks that a vector looks at for its first bound.
VISITOR_BLOCKS = 4
FIRST_BLOCKS = 4
SLICE = 512
# Rows of one side of a tile where blocks would not save work, vectors that tell whether they do, and entries whose maximum
# stands for them in the first look for the best.
TILE_ROWS = 32768
PROBES = 256
GROUP = 128
SLACK = 1e-6  # rounding of distances

HOME = "struct<cell:int,leaf:int,chunk:int,part:int>"


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; on unit vectors they order like cosine and obey the triangle rule."""
    squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2.0 * left @ right.T
    return np.sqrt(np.maximum(squares, 0.0))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(np.float64)


def _top(similarity: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best entries per row; equal scores prefer the smaller id."""
    order = np.lexsort((np.broadcast_to(ids, similarity.shape), -similarity), axis=1)[:, :k]
    rows = np.repeat(np.arange(similarity.shape[0]), order.shape[1])
    return rows, order.ravel()


def _best(guests: np.ndarray, hosts: np.ndarray, rank_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the k best hosts of every guest; equal scores prefer the smaller rank.

    The k-th largest of the maxima of groups of hosts is no more than the k-th best, so only entries from there on are sorted.
    """
    found, groups = [], len(hosts) // GROUP
    for start in range(0, len(guests), SLICE):
        similarity = guests[start : start + SLICE] @ hosts.T
        bound = np.full(len(similarity), -np.inf)
        if groups > k:
            heads = similarity[:, : groups * GROUP].reshape(len(similarity), groups, GROUP).max(axis=2)
            bound = np.partition(heads, groups - k, axis=1)[:, groups - k]
        row, column = np.nonzero(similarity >= bound[:, None])
        score = similarity[row, column]
        order = np.lexsort((rank_of[column], -score, row))
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        found.append((row[order] + start, column[order], score[order]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _halves(unit: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in compact blocks of at most ``size``: halved at the median along the direction in which they spread most."""
    open_, done = [np.arange(len(unit))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = unit[rows] - unit[rows].mean(axis=0)
        direction = part[np.argmax((part**2).sum(axis=1))]
        for _ in range(3):
            direction = part.T @ (part @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = rows[np.argsort(part @ direction, kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def _bounds(unit: np.ndarray, blocks: list[np.ndarray], centers: np.ndarray, k: int) -> np.ndarray:
    """Of each row the distance of its k-th nearest among its own block and those nearest to it."""
    limit = np.full(len(unit), np.inf)
    near = np.argsort(_distances(centers, centers), axis=1, kind="stable")[:, :FIRST_BLOCKS]
    for i, rows in enumerate(blocks):
        pool = np.concatenate([rows, *(blocks[j] for j in near[i] if j != i)])
        for start in range(0, len(rows), SLICE):
            part = rows[start : start + SLICE]
            gaps = _distances(unit[part], unit[pool])
            gaps[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
            if len(pool) > k:
                limit[part] = np.partition(gaps, k - 1, axis=1)[:, k - 1]
    return limit


def _dealt(members: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """Members of cells (cell, n) with the ``chunk`` of about ``rows`` rows that a task takes."""
    chunks = F.ceil(F.col("n") / rows).cast("int")
    return members.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("vid"), chunks).cast("int")).drop("n")


def _copied(nodes: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """What a cell's tasks need, once for each chunk of the cell."""
    chunks = F.ceil(F.col("n") / rows).cast("int")
    every = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("node_chunk")
    return nodes.join(F.broadcast(sizes), "cell").select(F.col("cell").alias("node"), every, *[name for name in nodes.columns if name != "cell"])


def _placed(distinct: DataFrame, centers: np.ndarray, levels: int, pivots: int, leaf_rows: int, task_rows: int) -> DataFrame:
    """(vid, u, cell, leaf, gap): the nearest top pivot of every vector with its distance, and its nearest pivot in that cell."""

    def to_cells(batches):
        for pdf in batches:
            unit = _unit(_matrix(pdf["v"]))
            gaps = _distances(unit, centers)
            yield pd.DataFrame({"vid": pdf["vid"], "u": list(unit), "cell": gaps.argmin(axis=1), "leaf": 0, "gap": gaps.min(axis=1)})

    schema = "vid string, u array<double>, cell int, leaf int, gap double"
    placed = distinct.mapInPandas(to_cells, schema)
    if levels == 1:
        return placed
    placed = session.materialize(placed)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # Of each cell as many vectors, by a hash of the id, as it needs leaves.
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vid"), "vid"))
    some = placed.select("cell", "vid", "u", rank.alias("rank")).where(F.col("rank") <= pivots).join(sizes, "cell")
    some = some.where((F.col("rank") - 1) * leaf_rows < F.col("n")).select("cell", (F.col("rank") - 1).alias("at"), F.col("u").alias("pivot"))

    def to_leaves(members: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if members.empty:
            return pd.DataFrame({name: [] for name in ("vid", "u", "cell", "leaf", "gap")}, dtype=object)
        nearest = _distances(_matrix(members["u"]), _matrix(nodes["pivot"])).argmin(axis=1)
        kept = {name: members[name].to_numpy() for name in ("vid", "u", "cell", "gap")}
        return pd.DataFrame(kept | {"leaf": nodes["at"].to_numpy()[nearest]})[["vid", "u", "cell", "leaf", "gap"]]

    members = _dealt(placed, sizes, task_rows).groupBy("cell", "chunk")
    return members.cogroup(_copied(some, sizes, task_rows).groupBy("node", "node_chunk")).applyInPandas(to_leaves, schema)


def _blocked(placed: DataFrame, k: int, block_rows: int, leaf_rows: int) -> DataFrame:
    """Stored (vid, u, gap, home, limit, ball): block, first bound, and on one row of each block its center and radius."""
    placed = session.materialize(placed)
    sizes = placed.groupBy("cell", "leaf").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / (2 * leaf_rows)).cast("int")
    dealt = placed.join(sizes, ["cell", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("vid"), chunks).cast("int")).drop("n")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _matrix(pdf["u"])
        blocks = _halves(unit, block_rows)
        centers = np.array([unit[rows].mean(axis=0) for rows in blocks])
        home, ball = np.empty(len(pdf), dtype=object), np.empty(len(pdf), dtype=object)
        name = {key: int(pdf[key].iloc[0]) for key in ("cell", "leaf", "chunk")}
        for part, rows in enumerate(blocks):
            home[rows] = [name | {"part": part}] * len(rows)
            radius = np.linalg.norm(unit[rows] - centers[part], axis=1).max()
            ball[rows[0]] = {"center": centers[part].tolist(), "radius": float(radius)}
        limit = _bounds(unit, blocks, centers, k)
        kept = {name: pdf[name].to_numpy() for name in ("vid", "u", "gap")}
        return pd.DataFrame(kept | {"home": home, "limit": limit, "ball": ball})

    schema = f"vid string, u array<double>, gap double, home {HOME}, limit double, ball struct<center:array<double>,radius:double>"
    return session.materialize(dealt.groupBy("cell", "leaf", "chunk").applyInPandas(cut, schema))


def _visits(blocked: DataFrame, centers: np.ndarray, task_rows: int) -> DataFrame:
    """(vid, u, target): the blocks in which a vector may have one of its k nearest, its own one included."""
    # At most a row for each top pivot comes to the driver.
    cell = F.col("home.cell").alias("cell")
    spans = blocked.groupBy(cell).agg(F.min("gap").alias("low"), F.max("gap").alias("high")).orderBy("cell").toPandas()
    cells, low, high = (spans[name].to_numpy() for name in ("cell", "low", "high"))

    def reach(batches):
        for pdf in batches:
            gaps, limit = _distances(_matrix(pdf["u"]), centers[cells]), pdf["limit"].to_numpy()[:, None]
            row, at = np.nonzero((gaps - high <= limit + SLACK) & (low - gaps <= limit + SLACK))
            yield pd.DataFrame({name: pdf[name].to_numpy()[row] for name in ("vid", "u", "limit")} | {"cell": cells[at]})

    guests = blocked.select("vid", "u", "limit").mapInPandas(reach, "vid string, u array<double>, limit double, cell int")
    if len(cells) > 1:
        guests = session.materialize(guests)
    counts = guests.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    balls = blocked.where("ball is not null").select(cell, "home", "ball.center", "ball.radius")

    def descend(guests: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        found = []
        if not nodes.empty:
            pivots, radius, homes = _matrix(nodes["center"]), nodes["radius"].to_numpy(), nodes["home"].to_numpy()
            for start in range(0, len(guests), SLICE):
                part = guests.iloc[start : start + SLICE]
                gaps = _distances(_matrix(part["u"]), pivots) - radius
                row, at = np.nonzero(gaps <= part["limit"].to_numpy()[:, None] + SLACK)
                found.append(pd.DataFrame({"vid": part["vid"].to_numpy()[row], "u": part["u"].to_numpy()[row], "target": homes[at]}))
        return pd.concat(found) if found else pd.DataFrame({"vid": [], "u": [], "target": []}, dtype=object)

    dealt = _dealt(guests, counts, task_rows).groupBy("cell", "chunk")
    nodes = _copied(balls, counts, task_rows).groupBy("node", "node_chunk")
    return dealt.cogroup(nodes).applyInPandas(descend, f"vid string, u array<double>, target {HOME}")


def _blocks(distinct: DataFrame, n: int, sample: np.ndarray, k: int, pivots: int, block_rows: int) -> tuple[DataFrame, np.ndarray]:
    """Stored (vid, u, home, ...) of ``n`` vectors (vid, v), and the top pivots."""
    leaf_rows, task_rows = LEAF_BLOCKS * block_rows, VISITOR_BLOCKS * block_rows
    wanted = max(1, math.ceil(n / leaf_rows))
    levels = 1 if wanted <= pivots else 2
    centers = sample[: wanted if levels == 1 else min(pivots, math.ceil(math.sqrt(wanted)))]
    return _blocked(_placed(distinct, centers, levels, pivots, leaf_rows, task_rows), k, block_rows, leaf_rows), centers


def visits(distinct: DataFrame, n: int, sample: np.ndarray, k: int, pivots: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Stored (vid, u, home, ...) of ``n`` vectors (vid, v), and stored (vid, u, target) of the blocks that they visit."""
    blocked, centers = _blocks(distinct, n, sample, k, pivots, block_rows)
    return blocked, session.materialize(_visits(blocked, centers, VISITOR_BLOCKS * block_rows))


def _visits_of_one(blocked: DataFrame) -> float:
    """Blocks that a vector visits on average, by a bounded number of vectors against all balls."""
    probes = blocked.orderBy(F.xxhash64("vid"), "vid").select("u", "limit").limit(PROBES).collect()
    unit, limit = np.array([row["u"] for row in probes]), np.array([row["limit"] for row in probes])

    def count(batches):
        for pdf in batches:
            gaps = _distances(_matrix(pdf["center"]), unit) - pdf["radius"].to_numpy()[:, None]
            yield pd.DataFrame({"n": [int((gaps <= limit + SLACK).sum())]})

    balls = blocked.where("ball is not null").select("ball.center", "ball.radius")
    return balls.mapInPandas(count, "n long").agg(F.sum("n")).first()[0] / len(probes)


def _tiled(blocked: DataFrame, parts: int, k: int) -> DataFrame:
    """(vid, other, similarity): the k best of every vector in each of ``parts`` parts of all vectors."""
    part = F.pmod(F.xxhash64("vid"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    guests = blocked.select("vid", "u", part.alias("row"), every.alias("column"))
    hosts = blocked.select("vid", "u", every.alias("host_row"), part.alias("host_column"))

    def tile(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if guests.empty or hosts.empty:
            return pd.DataFrame({"vid": [], "other": [], "similarity": []}, dtype=object)
        ids = hosts["vid"].to_numpy()
        rows, columns, scores = _best(_matrix(guests["u"]), _matrix(hosts["u"]), np.argsort(np.argsort(ids)), k)
        return pd.DataFrame({"vid": guests["vid"].to_numpy()[rows], "other": ids[columns], "similarity": scores})

    pairs = guests.groupBy("row", "column").cogroup(hosts.groupBy("host_row", "host_column"))
    return pairs.applyInPandas(tile, "vid string, other string, similarity double")


def _visited(blocked: DataFrame, seen: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(vid, other, similarity): the k best of every vector in each of the blocks that it visits."""
    groups = seen.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / (VISITOR_BLOCKS * block_rows)).cast("int").alias("groups"))
    guests = seen.join(groups, "target").select("vid", "u", "target", F.pmod(F.xxhash64("vid"), F.col("groups")).cast("int").alias("group"))
    hosts = blocked.select("vid", "u", F.col("home").alias("target")).join(groups, "target")
    hosts = hosts.select("vid", "u", F.col("target").alias("host"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("host_group"))

    def visit(_key, guests: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if guests.empty or residents.empty:
            return pd.DataFrame({"vid": [], "other": [], "similarity": []}, dtype=object)
        guest_ids, ids = guests["vid"].to_numpy(), residents["vid"].to_numpy()
        similarity = _matrix(guests["u"]) @ _matrix(residents["u"]).T
        rank_of = np.argsort(np.argsort(ids))
        rows, columns = _top(similarity, rank_of, k)
        return pd.DataFrame({"vid": guest_ids[rows], "other": ids[columns], "similarity": similarity[rows, columns]})

    return guests.groupBy("target", "group").cogroup(hosts.groupBy("host", "host_group")).applyInPandas(
        visit, "vid string, other string, similarity double"
    )


def nearest_neighbors(
    vectors: DataFrame, k: int = 5, vector: str = "vector", key: str = "song_id",
    pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(song_id, neighbor_id, similarity, rank): the k nearest other vectors of every vector, exact.

    1. Copies of one vector are folded into one row that knows its k + 1 smallest ids.
    2. A tree: every vector goes to its nearest top pivot (a bounded sample) and, if that leaves too large cells, to the nearest
       of the cell's own pivots, of which it has one for each leaf. A leaf is halved along its widest direction down to
       compact blocks of ``block_rows`` vectors, each with its center and radius.
    3. In its own block and the nearest ones of the leaf each vector finds an upper bound for its k-th distance.
    4. A vector visits a block only if the block's ball is within that bound, by the triangle inequality; nothing nearer can be
       missed. It only meets the balls of cells whose ring around the top pivot it can reach. Visitors of a
       block are dealt to as many tasks as they need.

    Vectors without clusters would visit most blocks. If more copies of a vector would travel than tiles of
    ``TILE_ROWS`` rows need, all vectors are compared in such tiles instead, as exactly.
    """
    spark = vectors.sparkSession
    dense = vectors.select(F.col(key).alias("id"), arrays.finite(vector).alias("v"))
    order = Window.partitionBy("v").orderBy("id")
    copies = dense.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k + 1)
    distinct = copies.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = distinct.withColumn("vid", F.element_at("ids", 1))

    # At most ``pivots`` vectors come to the driver, whatever the data size.
    n = dense.count()
    sample = dense.orderBy(F.xxhash64("id"), "id").select("v").limit(min(pivots, max(1, math.ceil(n / block_rows)))).collect()
    if not sample:
        return spark.createDataFrame([], "song_id string, neighbor_id string, similarity double, rank int")
    found = _unit(np.array([row["v"] for row in sample], dtype=np.float64))
    _, first = np.unique(found, axis=0, return_index=True)
    blocked, centers = _blocks(distinct.select("vid", "v"), n, found[np.sort(first)], k, pivots, block_rows)
    parts = max(math.ceil(n / TILE_ROWS), math.ceil(math.sqrt(spark.sparkContext.defaultParallelism)))
    if _visits_of_one(blocked) > 2 * parts:
        found = _tiled(blocked, parts, k + 1)
    else:
        seen = session.materialize(_visits(blocked, centers, VISITOR_BLOCKS * block_rows))
        found = _visited(blocked, seen, k + 1, block_rows)
    # k + 1 distinct vectors (itself included) always cover the k nearest rows.
    near = Window.partitionBy("vid").orderBy(F.desc("similarity"), "other")
    kept = found.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= k + 1).drop("_rank")
    ids = distinct.select(F.col("vid").alias("other"), "ids")
    offered = kept.join(ids, "other").select("vid", "similarity", F.explode("ids").alias("neighbor_id"))
    lists = offered.groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "neighbor_id"))).alias("near")
    )
    # Every copy gets the list of its vector, without itself.
    owner = dense.join(distinct.select("v", "vid"), "v").select("id", "vid")
    others = owner.join(lists, "vid").withColumn(
        "near", F.slice(F.filter("near", lambda item: item["neighbor_id"] != F.col("id")), 1, k)
    )
    return others.select("id", F.posexplode("near").alias("pos", "item")).select(
        F.col("id").alias(key), F.col("item.neighbor_id").alias("neighbor_id"),
        (-F.col("item.minus")).alias("similarity"), (F.col("pos") + 1).alias("rank"),
    )
