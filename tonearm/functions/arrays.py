"""Array and vector expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.numbers import bind
from tonearm.functions.text import ColumnLike, col, no_items, safe_text, split_pipe


def unique_items(values: ColumnLike) -> Column:
    """First-seen distinct elements without nulls and blanks."""
    return F.array_distinct(F.filter(col(values), lambda item: item.isNotNull() & (item != "")))


def union_tags(*joined: ColumnLike) -> Column:
    """First-seen union of ``|``-joined tag columns."""
    return F.array_distinct(F.concat(*[split_pipe(item) for item in joined]))


def coerce_list(value: ColumnLike, is_array: bool) -> Column:
    """Trimmed non-blank items of an array or of a joined text; null gives an empty array."""
    if not is_array:
        return split_pipe(value)
    texts = F.transform(col(value), lambda item: safe_text(item))
    return F.coalesce(F.filter(texts, lambda item: item != ""), no_items())


def most_common(words: ColumnLike, limit: int) -> Column:
    """The most frequent elements of an array; equal counts keep first-appearance order, null gives an empty array.

    Words are counted inside the batch by an Arrow UDF: lambdas would cost several microseconds a word.
    """

    @F.arrow_udf("array<string>")
    def common(lists: pa.Array) -> pa.Array:
        return top_words(lists, limit)

    return common(col(words))


# Words that ``top_words`` counts at once, a long row aside.
COUNTED = 1_000_000


def top_words(lists: pa.ListArray, limit: int) -> pa.ListArray:
    """Of every list its ``limit`` most frequent words, ties by first appearance."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // COUNTED
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(lists)]
    parts = [_top_words(lists.slice(a, b - a), sizes[a:b], limit) for a, b in zip(edges, edges[1:]) if b > a]
    return pa.concat_arrays(parts) if parts else lists


def _top_words(lists: pa.ListArray, sizes: np.ndarray, limit: int) -> pa.ListArray:
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = max(1, len(coded.dictionary))
    keys, first, counts = np.unique(np.repeat(np.arange(len(lists)), sizes) * distinct + codes, return_index=True, return_counts=True)
    row = keys // distinct
    order = np.lexsort((first, -counts, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < limit
    words = coded.dictionary.take(pa.array(keys[order][kept] % distinct))
    lengths = np.bincount(row[kept], minlength=len(lists))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, words)


def top_labels(scores: ColumnLike, labels: Column, limit: int) -> Column:
    """(label, score) structs of the highest scores of a row, earlier labels first on ties."""
    ranked = F.zip_with(
        F.transform(col(scores), lambda score, index: F.struct((-score).alias("minus"), index.alias("index"))),
        labels,
        lambda score, label: F.struct(score["minus"].alias("minus"), score["index"].alias("index"), label.alias("label")),
    )
    best = F.slice(F.sort_array(ranked), 1, limit)
    return F.transform(best, lambda item: F.struct(item["label"].alias("label"), (-item["minus"]).alias("score")))


def finite(values: ColumnLike) -> Column:
    """Vector as doubles with NaN and infinities set to zero."""
    return F.transform(
        col(values).cast("array<double>"),
        lambda item: F.when(F.isnan(item) | (F.abs(item) == float("inf")), 0.0).otherwise(F.coalesce(item, F.lit(0.0))),
    )


def dot(left: ColumnLike, right: ColumnLike) -> Column:
    products = F.zip_with(col(left), col(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, item: total + item)


def constant_matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A constant array of vectors as one literal."""
    return F.from_json(F.lit(json.dumps([[float(x) for x in row] for row in rows])), "array<array<double>>")


def matrix_of(rows: DataFrame, vector: str, order: str) -> Column:
    """The vectors of a small table, one row for each label, in order, as a scalar subquery.

    Spark takes no subquery inside a lambda: put it into a column first.
    """
    listed = F.array_sort(F.collect_list(F.struct(order, F.col(vector).alias("v"))))
    return rows.agg(F.transform(listed, lambda row: row["v"]).alias("m")).scalar()


def l2_normalize(values: ColumnLike) -> Column:
    """Unit-length vector; the norm is kept away from zero by 1e-12."""
    return bind(
        finite(values),
        lambda vector: bind(
            F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12)),
            lambda norm: F.transform(vector, lambda item: item / norm),
        ),
    )


def max_scores(entries: ColumnLike) -> Column:
    """Highest score per (category, tag) with its distinct sources in first-seen order."""
    rows = col(entries)
    keys = F.array_distinct(
        F.transform(rows, lambda row: F.struct(row["category"].alias("category"), row["tag"].alias("tag")))
    )

    def merged(key: Column) -> Column:
        same = F.filter(rows, lambda row: (row["category"] == key["category"]) & (row["tag"] == key["tag"]))
        return F.struct(
            key["category"].alias("category"),
            key["tag"].alias("tag"),
            F.array_max(F.transform(same, lambda row: row["score"])).alias("score"),
            F.array_distinct(F.transform(same, lambda row: row["source"])).alias("sources"),
        )

    return F.transform(keys, merged)
