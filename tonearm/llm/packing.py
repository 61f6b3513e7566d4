"""Cost-balanced packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import spans, units

LIMIT = 4096
END_ID = 2
# Parts of words whose ids a worker remembers; beyond that it starts anew.
PARTS = 400_000

# What the tokenizer's own pattern takes apart in the same way when letters are those of Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
_loaded: dict[str, Words] = {}


class Words(units.UnitEncoder):
    """Ids of a word-end BPE tokenizer, word by word.

    The tokenizer drops white space and never joins what white space parts, so the ids of a text
    are those of its words in turn and each distinct word is encoded once. The parts of a word of
    ASCII signs and Latin-1 letters go straight to the tokenizer's model; any other word passes the
    whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.parts: dict[str, bytes] = {}
        self.signs = units.byte_signs()
        probe = ["Abc", "déjà", "Ärger", "über.", "a,", "x?!", "ÞÿÖ;", "I'll", "###a1b22", "(x)'s", "a_b-c"]
        self.direct = all(b"".join(map(self._part, _PART.findall(w.lower()))) == self._whole(w) for w in probe)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            spelt = part if part.isascii() else "".join([self.signs[b] for b in part.encode()])
            found = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
        return found

    def encode(self, word: str) -> bytes:
        if self.direct and _PLAIN.fullmatch(word) and "<|" not in word:
            parts = _PART.findall(word.lower())
            return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self._part, parts))
        return self._whole(word)


def words_of(definition: str) -> Words:
    """The encoder of a tokenizer file's content, kept by the worker between its tasks."""
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = Words(definition)
    return _loaded[definition]


def capacities(total: int, limit: int) -> list[int]:
    """Lengths of the sequences for ``total`` tokens: full ones, then powers of two for the rest."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << b for b in range(limit.bit_length(), -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, limit: int, linear: float = 1.0, quadratic: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths.

    Stretches of a whole sequence are cut off first. What is left of the documents is taken in
    descending order of cost and goes to the cheapest sequence that still holds all of it, else is
    cut to fill the cheapest one with room. A piece of n tokens costs linear * n + quadratic *
    n^2 / limit. The sequences' lengths add up to the tokens, so none has padding.
    """
    room = np.array(capacities(int(lengths.sum()), limit), np.int64)
    used = np.zeros(len(room), np.int64)
    cost = np.zeros(len(room))
    pieces = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, int(used[seq])))
        used[seq] += n
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n / limit

    seq, rest = 0, []
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= limit:
            put(doc, start, limit, seq)
            start, seq = start + limit, seq + 1
        if n > start:
            rest.append((n - start, doc, start))
    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = np.flatnonzero(room >= n)
        while not len(fits):
            some = np.flatnonzero(room > 0)
            seq = int(some[np.argmin(cost[some])])
            part = int(room[seq])
            put(doc, start, part, seq)
            n, start = n - part, start + part
            fits = np.flatnonzero(room >= n)
        put(doc, start, n, int(fits[np.argmin(cost[fits])]))
    return pieces


def pack(docs: DataFrame, definition: str, limit: int = LIMIT, end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1.0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limit`` tokens (a power of two).

    ``definition`` is the content of a tokenizer file; ``end_id`` follows every document. Each
    group of about 4 MB of text that a task reads is packed on its own, inside that task: nothing
    is shuffled, and the sequences of a group have no padding. Returns doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    Null or empty texts are one piece of the end id alone. Very long texts fill sequences of their
    own. Repeated rows are packed each. A null doc_id stays null. Other columns are not looked at.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words_of(shared.value)
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = spans.utf8(batch.column(1))
            for low, high in spans.slices(offsets):
                doc_ids = batch.column(0).slice(low, high - low)
                part = data[offsets[low] : offsets[high]]
                ids, at = encoder.texts(part, offsets[low : high + 1] - offsets[low])
                lengths = np.diff(at) + 1
                pieces = assign(lengths, limit, linear, quadratic)
                doc, start, n, seq, offset = np.array(pieces, np.int64).T
                raw, last = ids.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
                begin, stop = (at[doc] + start) * 4, (at[doc] + start + n) * 4
                ends = start + n == lengths[doc]
                blobs = [raw[a : b - 4] + last if e else raw[a:b] for a, b, e in zip(begin.tolist(), stop.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(blobs, pa.binary()), pa.array(lengths[doc]),
                     pa.array(seq + sequence), pa.array(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                sequence += int(seq.max()) + 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
