"""Words of Arrow string columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that one pass of the array code takes; bounds the memory of a task.
SLICE_BYTES = 4 << 20
# Bytes hashed at one time, with several 64-bit numbers for each.
HASH_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_tables: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WHITE = ~WHITE
# Letters and digits of ASCII, and every byte of a longer UTF-8 sequence.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def ascii_lower(text: Column) -> Column:
    """A text with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * _SPREAD
    return values ^ (values >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("power", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["power"][:n], _tables["inverse"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch whose last column is the text, or the row that holds it."""
    last = batch.column(batch.num_columns - 1)
    return pc.struct_field(last, "text") if pa.types.is_struct(last.type) else last


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each; a longer row has a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop
        row = stop


def lower(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z in lower case; with ``latin`` also the letters of Latin-1 (two bytes from 0xC3)."""
    out = _LOWER[data]
    if latin and len(out) > 1:
        high = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[high] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``inside`` bytes; runs end with their row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    within = inside[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = within & first[:-1]
    starts[1:] |= within[1:] & ~within[:-1]
    ends = within & first[1:]
    ends[:-1] |= within[:-1] & ~within[1:]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over its bytes, from prefix sums modulo 2^64."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(end, base + HASH_BYTES, "right")))
        part = data[base : end[stop - 1]]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        first, last = start[at:stop] - base, end[at:stop] - base
        out[at:stop] = (total[last] - total[first]) * inverse[first]
        at = stop
    return mix(out + (end - start).astype(np.uint64) * np.uint64(_BASE))


def ragged(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``chosen`` of a ragged array, one after the other, and their offsets."""
    lengths = (offsets[1:] - offsets[:-1])[chosen]
    out = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    index = np.arange(out[-1]) + np.repeat(offsets[:-1][chosen] - out[:-1], lengths)
    return values[index], out
