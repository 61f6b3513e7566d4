"""Language identification: presence string kernels, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import spans

UNDETERMINED = "und"
WINDOW = 2048  # bytes of text that are one kernel point
GRAMS = (1, 2, 3)
SLOTS = 8192
LANDMARKS = 128
SAMPLE = 6000  # windows that the regression is fitted on, at most
RIDGE = 1e-2
SHARPNESS = 4.0
_ROWS = 128
_MULTIPLIER = np.uint32(2654435761)

# Letters of ASCII and bytes of longer sequences stay; anything else is a gap.
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x61, 0x7B), *range(0x80, 0x100)]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the windows of all rows, and the row of each window; a row is cut evenly."""
    lengths = np.diff(offsets)
    parts = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), parts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[row] + lengths[row] * place // np.maximum(parts[row], 1)
    return np.append(start, offsets[-1]), row


def presence(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row for each window (``cuts`` are its bounds in ``data``) with 1 at the slot of every n-gram in it."""
    n = len(cuts) - 1
    out = np.zeros((n, SLOTS), np.float32)
    flat = out.reshape(-1)
    own = np.repeat(np.arange(n, dtype=np.int64) * SLOTS, np.diff(cuts))
    text = _LETTERS[spans.lower(data[cuts[0] : cuts[-1]], latin=True)].astype(np.uint32)
    code = np.zeros(len(text), np.uint32)
    for size in range(1, max(GRAMS) + 1):
        code = code[: len(text) - size + 1] << np.uint32(8) | text[size - 1 :]
        if size in GRAMS and len(code):
            inside = own[: len(code)] == own[size - 1 :]
            slot = ((code + np.uint32(size << 26)) * _MULTIPLIER) >> np.uint32(19)
            flat[(own[: len(code)] + slot)[inside]] = 1
    return out


def kernel(points: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Cosines of presence rows with the landmarks, which have length 1."""
    return points @ landmarks.T / np.sqrt(np.maximum(points.sum(axis=1, keepdims=True), 1))


class Model:
    """Landmarks (unit rows) and, for each language, its weights of their kernel values."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Shares of the languages for each row: softmax of the mean over its windows, weighted by length."""
        cuts, row = windows(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for at in range(0, len(row), _ROWS):
            own = row[at : at + _ROWS]
            bounds = cuts[at : at + len(own) + 1]
            values = kernel(presence(data, bounds), self.landmarks) @ self.weights
            np.add.at(total, own, values * np.diff(bounds)[:, None])
        total *= SHARPNESS / np.maximum(np.diff(offsets), 1)[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each batch of (lang, text): the languages, the windows' bytes and cuts, and (row, key) of each window."""
    for batch in batches:
        data, offsets = spans.utf8(batch.column(1))
        cuts, row = windows(data, offsets)
        keys = spans.hashes(data, cuts[:-1], cuts[1:]) if len(row) else np.zeros(0, np.uint64)
        yield batch.column(0).to_pylist(), data, cuts, np.stack([row, (keys >> np.uint64(1)).astype(np.int64)])


def _sampled(docs: DataFrame, sample: int) -> list:
    """(lang, window) rows: at most ``sample``, evenly over the languages, of each the distinct windows least by hash.

    A window counts once in its language, however many copies of it there are. The first pass ships keys alone: of
    each task the least of each language; they give every language's greatest key that is taken. The second one ships
    the windows up to it, each at most once a task.
    """
    languages = docs.select("lang").distinct().count()
    if not languages:
        return []
    quota = max(1, sample // languages)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for langs, _data, _cuts, (row, keys) in _keys(batches):
            own = np.array(langs, dtype=object)[row]
            for lang in set(langs):
                mine = keys[own == lang]
                found[lang] = np.unique(np.append(found[lang], mine) if lang in found else mine)[:quota]
        for lang, keys in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys)], ["lang", "key"])

    texts = docs.select("lang", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    ranked = texts.mapInArrow(least, "lang string, key long").distinct().withColumn("place", place).where(F.col("place") <= quota)
    bounds = {r.lang: r.bound for r in ranked.groupBy("lang").agg(F.max("key").alias("bound")).collect()}

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for langs, data, cuts, (row, keys) in _keys(batches):
            bound = np.array([bounds.get(x, -1) for x in langs], np.int64)[row]
            kept = {(langs[row[i]], int(keys[i])): i for i in np.flatnonzero(keys <= bound)}
            new = [(lang, key, i) for (lang, key), i in kept.items() if (lang, key) not in seen]
            seen.update((lang, key) for lang, key, _ in new)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in new], pa.string()), pa.array([x[1] for x in new], pa.int64()),
                 pa.array([data[cuts[i] : cuts[i + 1]].tobytes() for *_, i in new], pa.binary())],
                ["lang", "key", "window"],
            )

    found = texts.mapInArrow(taken, "lang string, key long, window binary").groupBy("lang", "key").agg(F.min("window").alias("window"))
    return [(r.lang, bytes(r.window)) for r in found.orderBy("key", "lang").collect()]


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features of a bounded sample of windows."""
    rows = _sampled(labelled, sample)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    by_lang: dict[str, list[int]] = {x: [] for x in languages}
    for i, (lang, _) in enumerate(rows):
        by_lang[lang].append(i)
    # Landmarks in turn from each language, in the order of the hash.
    turns = sorted((place, i) for own in by_lang.values() for place, i in enumerate(own))
    marks = [i for _, i in turns[: max(landmarks, len(languages))]]

    def points(chosen: list[int]) -> np.ndarray:
        blobs = [rows[i][1] for i in chosen]
        return presence(np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]))

    base = points(marks)
    base /= np.sqrt(np.maximum(base.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    used = values > 1e-6 * values.max()
    root = vectors[:, used] / np.sqrt(values[used])
    blocks = [kernel(points(list(range(at, min(at + _ROWS, len(rows))))), base) for at in range(0, len(rows), _ROWS)]
    features = np.concatenate(blocks).astype(np.float64) @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    ridge = features.T @ features + RIDGE * len(rows) / len(root.T) * np.eye(root.shape[1])
    return Model(languages, base, (root @ np.linalg.solve(ridge, features.T @ target)).astype(np.float32))


def classify(docs: DataFrame, held_out: F.Column, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text of ``docs`` (doc_id, text, lang).

    With ``carry`` the whole row of ``docs`` comes along as the struct ``row``.

    Learns from the text and non-null lang of the rows where ``held_out`` is false, on a sample of at most
    ``sample`` distinct windows, the same number for each language (those with the least hashes). A text is cut into windows; a window's
    kernel point is the set of its byte n-grams of 1 to 3 (letters in lower case, all else a gap). The score
    is the share of the predicted language, from 0 to 1; of equal shares that of the first language in order of code points wins.

    A null text, or one without a letter, is ``und`` with score 0, and so is everything if there is nothing to learn
    from. Very long texts are read whole. Repeated rows stay; a null doc_id stays null; a null ``held_out``
    counts as false. Other columns are not looked at, and an empty table gives no rows.
    """
    hidden = F.coalesce(held_out, F.lit(False))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    model = fit(docs.where(~hidden & F.col("lang").isNotNull() & letter).select("lang", "text"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names = np.full(batch.num_rows, UNDETERMINED, dtype=object)
            scores = np.zeros(batch.num_rows)
            if model is not None:
                data, offsets = spans.utf8(spans.texts(batch))
                for low, high in spans.slices(offsets):
                    shares = model.scores(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    best = shares.argmax(axis=1)
                    names[low:high] = np.array(model.languages, dtype=object)[best]
                    scores[low:high] = shares[np.arange(high - low), best]
                names[~letters], scores[~letters] = UNDETERMINED, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), *batch.columns[3:][:carry]],
                ["doc_id", "held_out", "lang_pred", "score", "row"][: 4 + carry])

    rows = docs.select(F.col("doc_id").cast("long"), hidden.alias("held_out"), letter.alias("letter"), F.struct("*").alias("row") if carry else F.col("text"))
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double")
    return rows.mapInArrow(run, schema.add("row", docs.schema) if carry else schema)
