"""Byte-level BPE as a deterministic automaton over tokens, compiled from the merges."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import spans, units

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Units that WORDS cuts into letters and marks.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
# Words, and pairs of tokens, that a worker remembers; beyond that it starts anew.
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 1_500_000
_WIDTH = 20  # bits of a token id in a pair
_BLOCK = 1 << 16


class Automaton:
    """Accepts exactly the token sequences that the merges produce; arcs carry tokens.

    It starts as one state with an arc for each byte and takes in the merges one by one. The gadget
    of merge u v -> w, number k, (1) takes arc v away from the state behind u, (2) gives each
    state that has an arc u into it an arc w, and (3) makes the state behind w a copy of the state
    behind v. Nothing is copied out: a token keeps the merge it was made by (``born``), the token
    whose incoming arcs its own were copied from (``source``) and the one whose outgoing arcs its
    state was copied from (``target``), and ``gone`` has the arcs taken away with their time. An arc
    is looked up by following the copies back; what was found is kept in a transition table.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels = labels
        self.born, self.source, self.target = [-1] * n, [-1] * n, [-1] * n
        self.gone: dict[int, int] = {}
        for time, (u, v, w) in enumerate(merges):
            self.gone.setdefault(u << _WIDTH | v, 2 * time)
            if self.born[w] < 0:
                self.born[w], self.source[w], self.target[w] = time, u, v
        self.table: dict[int, bool] = {}
        # Bytes to tokens: a trie of the labels as a transition table.
        self.step: dict[int, int] = {}
        self.token: list[int] = [-1]
        made = {w for _, _, w in merges}
        for token, label in enumerate(labels):
            if len(label) == 1 or token in made:
                state = 0
                for byte in label:
                    key = state << 8 | byte
                    if key not in self.step:
                        self.step[key] = len(self.token)
                        self.token.append(-1)
                    state = self.step[key]
                self.token[state] = token

    def arc(self, t: int, w: int) -> bool:
        """Whether the state behind token t has an arc w."""
        key = t << _WIDTH | w
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= REMEMBERED_PAIRS:
                self.table.clear()
            found = self.table[key] = self._resolve(t, w)
        return found

    def _resolve(self, t: int, w: int) -> bool:
        now = 2 * len(self.gone) + 2
        while True:
            if self.gone.get(t << _WIDTH | w, now) < now:
                return False
            before, after = self.born[t], self.born[w]
            if before < 0 and after < 0:
                return True
            if before <= after:  # the arc was copied after step (1) of its gadget
                w, now = self.source[w], 2 * after + 1
            else:  # the state was copied before it
                t, now = self.target[t], 2 * before

    def encode(self, word: bytes) -> list[int]:
        """The accepted path that spells the word.

        Every prefix has one accepted path, so a search by longest arcs first visits each
        position at most once.
        """
        get, tokens, table, n = self.step.get, self.token, self.table, len(word)
        path, options, dead = [], [], bytearray(n + 1)
        at = last = 0
        while True:
            arcs, state, end = [], 0, at
            while end < n:
                state = get(state << 8 | word[end])
                if state is None:
                    break
                end += 1
                token = tokens[state]
                if token >= 0:
                    arcs.append((token, end))
            options.append(arcs)
            while True:
                if not arcs:
                    options.pop()
                    path.pop()
                    arcs = options[-1]
                    last = path[-1] if path else 0
                    continue
                token, end = arcs.pop()
                if dead[end]:
                    continue
                if not path:
                    break
                known = table.get(last << _WIDTH | token)
                if known or known is None and self.arc(last, token):
                    break
            path.append(token)
            if end == n:
                return path
            dead[end] = 1
            at, last = end, token


class Encoder(units.UnitEncoder):
    """Encodes texts by the automaton, and decodes ids, for one tokenizer file's content."""

    def __init__(self, definition: str):
        super().__init__()
        described = json.loads(definition)
        model = described["model"]
        sign = {s: b for b, s in enumerate(units.byte_signs())}
        vocabulary = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        labels = [b""] * size
        for text, token in vocabulary.items():
            labels[token] = bytes(sign[c] for c in text)
        for text, token in self.special.items():
            labels[token] = text.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges])
        self.split = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        self.words: dict[str, bytes] = {}
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_cuts = np.concatenate([[0], np.cumsum([len(x) for x in labels])])

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED_WORDS:
                self.words.clear()
            found = self.words[word] = array("I", self.automaton.encode(word.encode())).tobytes()
        return found

    def encode(self, unit: str) -> bytes:
        plain = _PLAIN.fullmatch(unit)
        if plain:
            word, marks = plain.groups()
            return self._word(word) + self._word(marks) if marks else self._word(word)
        if self.split and self.split.search(unit):
            parts = [p for p in self.split.split(unit) if p]
            return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.encode(p) for p in parts)
        words = WORDS.findall(unit)
        return self._word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """White space with the word behind it, and white space at the end of a text.

        No word of ``WORDS`` reaches from a sign that isn't white space into white space. Texts
        with other white space than ASCII's are one unit each.
        """
        start, end, row = spans.words(data, offsets)
        whole = _odd_rows(data, offsets)
        if len(whole):
            keep = ~np.isin(row, whole)
            start, end, row = start[keep], end[keep], row[keep]
        start[1:] = np.where(row[1:] == row[:-1], end[:-1], offsets[row[1:]])
        start[:1] = offsets[row[:1]]
        done = offsets[:-1].copy()
        done[row] = end  # the last word of a row is written last
        rest = np.flatnonzero(done < offsets[1:])
        at = np.searchsorted(row, rest, "right")
        return np.insert(start, at, done[rest]), np.insert(end, at, offsets[1:][rest]), np.insert(row, at, rest)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after the other."""
        blocks = (spans.ragged(self.label_bytes, self.label_cuts, ids[i : i + _BLOCK])[0] for i in range(0, len(ids), _BLOCK))
        return b"".join(block.tobytes() for block in blocks)


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space, or what comes near it, outside [ \\t-\\r]."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    lead = lead[lead + 1 < len(data)]
    first, second = data[lead], data[lead + 1]
    third = data[np.minimum(lead + 2, len(data) - 1)]
    odd = (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & ((second == 0x9A) | (second == 0xA0))
    odd |= (first == 0xE2) & ((second == 0x80) & ((third <= 0x8F) | (third >= 0xA8) & (third <= 0xAF)) | (second == 0x81) & (third == 0x9F))
    odd |= (first == 0xE3) & (second == 0x80) & (third == 0x80)
    found.append(lead[odd])
    return np.unique(np.searchsorted(offsets, np.concatenate(found), "right") - 1)


_loaded: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The encoder of a tokenizer file's content, kept by the worker between its tasks."""
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = Encoder(definition)
    return _loaded[definition]


def encoded(encoder: Encoder, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids and offsets of groups of rows of a string column."""
    data, offsets = spans.utf8(column)
    for low, high in spans.slices(offsets):
        ids, at = encoder.texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        yield low, ids, at


def encode(docs: DataFrame, definition: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text of ``docs`` (doc_id, text).

    The ids are those of the tokenizer whose file's content is ``definition``, without added
    specials; the strings of specials inside a text give their ids. Null and empty texts have no
    ids. Repeated rows stay, other columns are not looked at, and an empty table gives no rows. Very long
    texts are encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for low, ids, at in encoded(encoder, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(at) - 1), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, definition: str) -> DataFrame:
    """doc_id and text of every row of ``coded`` (doc_id, ids): the labels of the ids in turn.

    Bytes that aren't UTF-8 become U+FFFD. Null or empty ids give an empty text. Other columns are
    not looked at.
    """
    shared = coded.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = [encoder.decode(np.array(row or [], np.int64)).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, definition: str) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens and the digests of both results.

    ``ids_sha256`` is taken over the decimal ids joined by commas, ``decoded_sha256`` over the UTF-8
    bytes of the decoded text; both in lowercase hexadecimal. Null texts count as empty.
    """
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        decimal = [b"%d" % i for i in range(len(encoder.automaton.labels))]
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for _, ids, at in encoded(encoder, batch.column(1)):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = ids[a:b]
                    digest = hashlib.sha256()
                    for i in range(0, b - a, _BLOCK):
                        digest.update((b"," if i else b"") + b",".join([decimal[x] for x in own[i : i + _BLOCK].tolist()]))
                    counts.append(b - a)
                    id_digests.append(digest.hexdigest())
                    text = encoder.decode(own)
                    try:
                        text.decode()
                    except UnicodeDecodeError:
                        text = text.decode("utf-8", "replace").encode()
                    text_digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
