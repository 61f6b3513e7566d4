"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import blocks
from tonearm.llm.components import connected
from tonearm.session import materialize

COSINE = 0.93
BLOCK = 1024
# Rows that a bucket should hold when vectors are evenly spread, and the chance that a pair just at
# the bound shares no table.
BUCKET_ROWS = 8
MISS = 0.002
_STEP = 1 << 20


def layout(rows: int, cosine: float) -> tuple[int, int]:
    """Bits of a table and number of tables for groups of ``rows`` vectors.

    A hyperplane parts two vectors at angle x with probability x / pi. The bits grow with the
    logarithm of the rows, so that buckets don't; the tables keep the chance of a miss.
    """
    bits = max(6, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, bits * tables))


def usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None if it is null or has null or non-finite components."""
    out = []
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, cuts = column.values, column.offsets.to_numpy()
    missing = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        a, b = cuts[i], cuts[i + 1]
        own = values[a:b]
        bad = not valid[i] or not len(own) or not np.isfinite(own).all() or missing is not None and missing[a:b].any()
        out.append(None if bad else own)
    return out


def _signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """Usable vectors at unit length with the digest of their components and their signs in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            kept, units, digests, signs, dims = [], [], [], [], []
            for i, vector in enumerate(usable(batch.column(2))):
                if vector is None:
                    continue
                vector = vector + 0.0  # -0.0 is 0.0
                top = np.abs(vector).max()
                if top == 0:
                    continue
                unit = vector / top
                unit /= np.sqrt(unit @ unit)
                dim = len(vector)
                if dim not in known:
                    known[dim] = _planes(dim, bits, tables)
                positive = (unit @ known[dim] > 0).reshape(tables, bits)
                kept.append(i)
                dims.append(dim)
                units.append(unit.tobytes())
                digests.append(hashlib.blake2b(vector.tobytes(), digest_size=16).digest())
                signs.append((positive @ weights).astype("<i8").tobytes())
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()),
                 pa.array(units, pa.binary()), pa.array(signs, pa.binary())],
                ["id", "label", "dim", "digest", "unit", "signs"],
            )

    return vectors.mapInArrow(run, "id long, label int, dim int, digest binary, unit binary, signs binary")


def _links(pairs: DataFrame, cosine: float, tables: int) -> DataFrame:
    """(id, n_links, root) for every row with a link in its group; root is linked to it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in blocks.runs(batches, 6):
            tables_at = rows.column(2).to_numpy()
            ids, copies = rows.column(6).to_numpy(), rows.column(7).to_numpy()
            in_a = rows.column(8).to_numpy(zero_copy_only=False)
            dims, same = rows.column(1).to_numpy(), (rows.column(4).to_numpy() == rows.column(5).to_numpy())
            unit, sign = rows.column(9), rows.column(10)
            out = [[], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                vectors = np.frombuffer(b"".join(unit.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, dims[a])
                signs = np.frombuffer(b"".join(sign.slice(a, b - a).to_pylist()), np.int64).reshape(b - a, tables)
                first = np.arange(b - a) if same[a] else np.flatnonzero(in_a[a:b])
                second = first if same[a] else np.flatnonzero(~in_a[a:b])
                i, j = _pairs(vectors, signs, first, second, same[a], cosine, int(tables_at[a]))
                if not len(i):
                    continue
                own = copies[a:b]
                count = np.bincount(i, own[j], b - a) + np.bincount(j, own[i], b - a)
                members = np.flatnonzero(count)
                root = blocks.roots(b - a, i, j)
                out[0].append(ids[a:b][members])
                out[1].append(count[members].astype(np.int64))
                out[2].append(ids[a:b][root[members]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["id", "n_links", "root"])

    return pairs.mapInArrow(run, "id long, n_links long, root long")


def _pairs(vectors, signs, first, second, same: bool, cosine: float, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the bound or above that share no table before ``table``."""
    left, right = [], []
    step = max(1, _STEP // max(1, len(second)))
    for at in range(0, len(first), step):
        rows = first[at : at + step]
        close = vectors[rows] @ vectors[second].T >= cosine
        i, j = np.nonzero(close)
        i, j = rows[i], second[j]
        if same:
            i, j = i[i < j], j[i < j]
        fresh = np.ones(len(i), dtype=bool)
        for earlier in range(table):
            fresh &= signs[i, earlier] != signs[j, earlier]
        left.append(i[fresh])
        right.append(j[fresh])
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of the same label and length are linked at a cosine of ``cosine`` or more. Exact copies
    are folded first and counted as links of each other; the rest are hashed by the signs of random
    projections in several tables, and within a bucket all pairs get their exact cosine, in blocks of
    bounded size. A pair counts in the first table that it shares, so n_links needs no list of pairs.
    Nothing is dropped from large buckets.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label is null,
    link with nothing: n_links 0, component_id their vec_id, kept true. A repeated row counts as
    another vector; rows that share a vec_id share its component. Where vec_id is null, component_id and kept
    are null and the row links with nothing. Other columns are not looked at, and an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable_rows = rows.where("id is not null and label is not null and vector is not null")
    largest = usable_rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = layout(largest, cosine)
    signed = materialize(_signed(usable_rows.select("id", "label", "vector"), bits, tables))
    key = ["label", "dim", "digest"]
    folded = materialize(signed.groupBy(*key).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("signs").alias("signs")))
    tabled = folded.select(
        "label", "dim", F.posexplode(_longs("signs", tables)).alias("at", "sign"), "digest", "id", "copies")
    group = ["label", "dim", "at", "sign"]
    dealt = blocks.paired(tabled.select(*group, "digest", "id", "copies"), group, "digest", BLOCK)
    dealt = dealt.join(folded.select(*key, "unit", "signs"), key)
    keys = [*group, "block_a", "block_b"]
    partial = materialize(_links(blocks.grouped(dealt.select(*keys, "id", "copies", "in_a", "unit", "signs"), keys), cosine, tables))
    counts = partial.groupBy("id").agg(F.sum("n_links").alias("links"))
    whole = connected(partial.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = folded.select(*key, "id", "copies").join(counts, "id", "left").join(whole, "id", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("class"))
    marked = signed.select("id", *key).join(classes, key).select("id", "n_links", "class")
    left_out = rows.select("id", "label", "vector").mapInArrow(_left_out, "id long").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class"))
    return marked.unionByName(left_out).select(
        F.col("id").alias("vec_id"), "n_links", F.col("class").alias("component_id"), (F.col("id") == F.col("class")).alias("kept"))


def _longs(column: str, n: int) -> F.Column:
    """The 64-bit numbers of a blob as an array."""
    text = F.hex(column)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, i * 16 + 1, F.lit(16)))


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the rows that take no part."""
    for batch in batches:
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        out = [i for i, v in enumerate(usable(batch.column(2))) if v is None or not known[i] or not v.any()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64()))], ["id"])
