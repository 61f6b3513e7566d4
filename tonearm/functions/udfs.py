"""The few Arrow UDFs: measures that no built-in expression computes. Each is a small per-row helper."""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose text is harvested, keys searched for a marker.
HARVEST_KEYS = ("summary", "content", "text", "desc", "description", "title", "name")
MARKER_KEYS = ("message", "msg", "error")
# Of the trigram hash; products of code points with them stay below 2^63.
TRIGRAM_FACTOR, TRIGRAM_PRIME = 1_000_003, 2**31 - 1
TOGETHER = 1 << 20


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null where an input is null."""
    return pd.Series(
        [
            difflib.SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


# A filter on a deterministic measure would be moved below the distinct step and the union in front of it, where every copy of
# a pair is measured, and measured again behind them.
matching_blocks_ratio = matching_blocks_ratio.asNondeterministic()


# Pairs whose characters are counted at one time.
_PAIRS = 256


def _shared(left: list[str], right: list[str]) -> np.ndarray:
    """Characters that both strings of each pair have, counted as often as both have them."""
    both = left + right
    points = np.frombuffer("".join(both).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, unit = np.unique(points, return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(value) for value in both])
    counts = np.bincount(row * len(alphabet) + unit, minlength=len(both) * len(alphabet)).reshape(len(both), -1 if len(alphabet) else 0)
    return np.minimum(counts[: len(left)], counts[len(left) :]).sum(axis=1)


def ratio_at_least(bound: float):
    """As ``matching_blocks_ratio``, but pairs that cannot reach the bound give 0 without matching.

    Matched characters are at most the shared ones, which are counted for many pairs at once.
    """

    @F.pandas_udf(T.DoubleType())
    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        result = pd.Series(np.nan, index=left.index, dtype="float64")
        known = left.notna() & right.notna()
        if not known.any():
            return result
        a, b = left[known], right[known]
        hopeful = np.concatenate([
            2.0 * _shared(a.iloc[at : at + _PAIRS].tolist(), b.iloc[at : at + _PAIRS].tolist())
            >= bound * (a.str.len() + b.str.len()).to_numpy()[at : at + _PAIRS]
            for at in range(0, len(a), _PAIRS)
        ])
        result[known] = [
            difflib.SequenceMatcher(None, x, y).ratio() if possible else 0.0
            for x, y, possible in zip(a, b, hopeful)
        ]
        return result

    return measure.asNondeterministic()


def _leaves(node, keys: Sequence[str], key: str = "") -> Iterator[object]:
    """Leaf values under the given keys in document order; list items keep their parent's key."""
    stack = [(node, key)]
    while stack:
        item, name = stack.pop()
        if isinstance(item, dict):
            stack.extend((child, str(child_name)) for child_name, child in reversed(item.items()))
        elif isinstance(item, list):
            stack.extend((child, name) for child in reversed(item))
        elif name in keys:
            yield item


def _leaf_text(value: object) -> str:
    if value is None:
        return ""
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _parsed(document: str | None):
    try:
        return json.loads(document) if document else None
    except ValueError:
        return None


def _texts(node) -> list[str]:
    found = (_leaf_text(leaf).strip() for leaf in _leaves(node, HARVEST_KEYS) if leaf)
    return [item for item in found if item]


@F.pandas_udf(T.ArrayType(T.StringType()))
def harvest_texts(documents: pd.Series) -> pd.Series:
    """Texts under descriptive keys of a JSON document, in document order."""
    return documents.map(lambda document: _texts(_parsed(document)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def harvest_first_good(results: pd.Series) -> pd.Series:
    """Texts of the ``data`` of the first result in a JSON list that has no error and an object as its response."""

    def texts(listed: str | None) -> list[str]:
        parsed = _parsed(listed)
        for result in parsed if isinstance(parsed, list) else ():
            if isinstance(result, dict) and not result.get("error") and isinstance(result.get("response"), dict):
                return _texts(result["response"].get("data"))
        return []

    return results.map(texts)


def has_marker(document: Column | str, marker: str) -> Column:
    """A message leaf anywhere in the JSON document holds the marker."""

    @F.pandas_udf("boolean")
    def search(documents: pd.Series) -> pd.Series:
        return documents.map(
            lambda document: any(
                marker in _leaf_text(leaf) for leaf in _leaves(_parsed(document), MARKER_KEYS)
            )
        ).astype("bool")

    return search(document)


def hashing_encoder(dimension: int = 256) -> Callable[[Sequence[str]], np.ndarray]:
    """Default text encoder: hashed character trigrams of the lower-cased text between blanks, unit length.

    A trigram's place is ((a * M + b) * M + c) mod P mod ``dimension`` of its code points. Needs no model files. Texts
    are taken together up to a million characters, as one array of code points.
    """

    def counted(padded: Sequence[bytes]) -> np.ndarray:
        points = np.frombuffer(b"".join(padded), np.uint32).astype(np.int64)
        lengths = np.array([len(value) // 4 for value in padded])
        places = ((points[:-2] * TRIGRAM_FACTOR + points[1:-1]) * TRIGRAM_FACTOR + points[2:]) % TRIGRAM_PRIME % dimension
        row = np.repeat(np.arange(len(padded)), lengths)
        # A trigram lies in one text: its first and last character are of the same.
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * dimension + places[inside], minlength=len(padded) * dimension)
        return counts.reshape(len(padded), dimension)

    def encode(texts: Sequence[str]) -> np.ndarray:
        matrix = np.zeros((len(texts), dimension), dtype=np.float64)
        held, size, low = [], 0, 0
        for at, value in enumerate(texts):
            held.append(f" {value.lower()} ".encode("utf-32-le", "surrogatepass"))
            size += len(held[-1])
            if size >= 4 * TOGETHER or at == len(texts) - 1:
                matrix[low : at + 1] = counted(held)
                held, size, low = [], 0, at + 1
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.clip(norms, 1e-12, None)

    return encode


def _encoded(batches: Iterator[pd.Series], make_encoder: Callable[[], Callable]) -> Iterator[np.ndarray]:
    encoder = make_encoder()
    for batch in batches:
        yield np.asarray(encoder(batch.fillna("").tolist()), dtype=np.float64)


def encode_texts(value: Column | str, make_encoder: Callable[[], Callable] = hashing_encoder) -> Column:
    """Vectors of texts. ``make_encoder`` runs once per Python worker and returns texts -> matrix."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for matrix in _encoded(batches, make_encoder):
            yield pd.Series(list(matrix))

    return encode(value)


def encoded_scores(value: Column | str, label_vectors: np.ndarray, make_encoder: Callable[[], Callable] = hashing_encoder) -> Column:
    """Similarities of encoded texts to a few label vectors: one matrix product a batch, and no vector leaves the worker.

    They are rounded to twelve places, so that labels which are equally alike are ties, whatever the order of the sum.
    """
    turned = np.ascontiguousarray(np.asarray(label_vectors, dtype=np.float64).T)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for matrix in _encoded(batches, make_encoder):
            yield pd.Series(list(np.round(matrix @ turned, 12)))

    return score(value)


def segment_words(value: Column | str, make_segmenter: Callable[[], Callable[[str], list[str]]]) -> Column:
    """Words of a text from an optional segmenter, loaded once per Python worker."""

    @F.pandas_udf("array<string>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = make_segmenter()
        for batch in batches:
            yield batch.map(lambda item: list(cut(item)) if item else [])

    return segment(value)
