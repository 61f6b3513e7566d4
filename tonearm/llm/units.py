"""Token ids of whole texts from the ids of their distinct units."""

from __future__ import annotations

import numpy as np

from tonearm.llm import spans

# Units, and ids of units, that a worker remembers; beyond that it starts anew.
REMEMBERED = 1_500_000
REMEMBERED_IDS = 12_000_000
REMEMBERED_BYTES = 48_000_000


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class UnitEncoder:
    """Encodes each distinct unit of a text once and puts the ids of a text together from them.

    A subclass says what a unit is (``units``) and gives the little-endian 32-bit ids of one
    (``encode``). Units are found by a 64-bit hash and then compared byte by byte; texts in which two units share a hash are
    encoded unit by unit.
    """

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values, self.cuts = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.bytes, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def encode(self, unit: str) -> bytes:
        raise NotImplementedError

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every unit, in order of text."""
        return spans.words(data, offsets)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        coded = [self.encode(unit.decode()) for unit in units]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(units), np.uint8)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        rows = len(self.cuts) - 1 + np.arange(len(coded))
        self.values = np.concatenate([self.values, np.frombuffer(b"".join(coded), "<u4")])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(lengths)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))

    def _one_by_one(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known: dict[bytes, np.ndarray] = {}
        found = []
        for a, b in zip(start.tolist(), end.tolist()):
            unit = raw[a:b]
            if unit not in known:
                known[unit] = np.frombuffer(self.encode(unit.decode()), "<u4")
            found.append(known[unit])
        at = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=at[1:])
        return np.concatenate([np.zeros(0, "<u4"), *found]), at

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the offsets of the rows."""
        start, end, row = self.units(data, offsets)
        keys, first, which = np.unique(spans.hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED or len(self.values) > REMEMBERED_IDS or len(self.bytes) > REMEMBERED_BYTES:
            self._forget()
        new = self._missing(keys)
        raw = data.tobytes()
        old = np.delete(np.arange(len(keys)), new)
        held = self.rows[np.searchsorted(self.keys, keys[old])]
        copies = np.delete(np.arange(len(start)), first)
        told_apart = not _equal(data, start[copies], end[copies], data, start[first[which[copies]]], end[first[which[copies]]]) or not _equal(
            data, start[first[old]], end[first[old]], self.bytes, self.ends[held], self.ends[held + 1])
        if told_apart:
            ids, at = self._one_by_one(raw, start, end)
        else:
            self._learn(keys[new], [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            ids, at = spans.ragged(self.values, self.cuts, self.rows[np.searchsorted(self.keys, keys)][which])
        return ids, at[np.searchsorted(row, np.arange(len(offsets)), "left")]


def _equal(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> bool:
    """Whether each span of ``a`` has the bytes of its span of ``b``; compared in stretches of bounded size."""
    sizes = a_end - a_start
    if not np.array_equal(sizes, b_end - b_start):
        return False
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + spans.HASH_BYTES, "right")) - 1)
        place = np.arange(total[stop] - total[at])
        back = np.repeat(total[at:stop] - total[at], sizes[at:stop])
        if not np.array_equal(a[place + np.repeat(a_start[at:stop], sizes[at:stop]) - back], b[place + np.repeat(b_start[at:stop], sizes[at:stop]) - back]):
            return False
        at = stop
    return True
