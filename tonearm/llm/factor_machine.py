"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import spans

SAMPLE = 10_000  # labelled rows of each class that the machine is fitted on, at most
LEAST_TEXTS = 5  # texts of the sample that a term must be in
LEAST_CHI2 = 15.0  # association with the label that a term must have
TERMS = 4096  # terms, at most
FACTORS = 4
EPOCHS = 80
RATE = 0.3
# Bytes of a word's stems.
STEMS = (4, 6, 8)
DECAY = 2e-6
FACTOR_DECAY = 1e-2
BATCH = 256
THRESHOLD = 0.7
_PLACES = 1 << 20


def terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, 32-bit hashes of distinct terms and row offsets of groups of rows.

    Terms are words (runs of letters and digits in lower case) and the stems of longer words: their first bytes.
    """
    data, offsets = spans.utf8(column)
    for low, high in spans.slices(offsets):
        text = spans.lower(data[offsets[low] : offsets[high]], latin=True)
        start, end, row = spans.words(text, offsets[low : high + 1] - offsets[low], spans.ALPHANUMERIC)
        rows, found = [row], [spans.hashes(text, start, end)]
        for size in STEMS:
            long = end - start > size
            rows.append(row[long])
            found.append(spans.mix(spans.hashes(text, start[long], start[long] + size) + np.uint64(size)))
        keys = np.unique(np.concatenate(rows).astype(np.uint64) << np.uint64(32) | np.concatenate(found) >> np.uint64(32))
        counts = np.searchsorted(keys >> np.uint64(32), np.arange(high - low + 1, dtype=np.uint64), "left")
        yield low, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts


class Machine:
    """Bias, and for each known term a weight and a vector of factors."""

    def __init__(self, known: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.known, self.bias, self.weights, self.factors = known, bias, weights, factors

    def place(self, found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms, and their row offsets."""
        at, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(found) if len(self.known) else 0, _PLACES):
            part = found[low : low + _PLACES]
            near = np.minimum(np.searchsorted(self.known, part), len(self.known) - 1)
            hit = np.flatnonzero(self.known[near] == part)
            at.append(near[hit])
            hits.append(hit + low)
        return np.concatenate(at), np.searchsorted(np.concatenate(hits), cuts)

    def margins(self, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """bias + sum of weights + sum over pairs of terms of the products of their factors."""
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        out = self.bias + np.bincount(row, self.weights[at], len(cuts) - 1)
        for k in range(self.factors.shape[1]):
            own = self.factors[at, k]
            out += 0.5 * (np.bincount(row, own, len(cuts) - 1) ** 2 - np.bincount(row, own * own, len(cuts) - 1))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chosen_terms(found: np.ndarray, cuts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Terms that are common enough and go with the label, in ascending order."""
    ordered = np.sort(found)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    texts = np.diff(np.append(first, len(ordered)))
    common = texts >= LEAST_TEXTS
    known, texts = ordered[first[common]], texts[common].astype(np.float64)
    del ordered, first
    marked = found[np.repeat(labels > 0, np.diff(cuts))]
    at, _ = Machine(known, 0.0, np.zeros(0), np.zeros((0, 0))).place(marked, np.zeros(1, np.int64))
    toxic = np.bincount(at, minlength=len(known)).astype(np.float64)
    n, positive = len(labels), labels.sum()
    expected = texts * positive / n
    spread = expected * (1 - positive / n) * (1 - texts / n) + 1e-12
    chi2 = (toxic - expected) ** 2 / spread
    good = np.flatnonzero(chi2 >= LEAST_CHI2)
    return known[np.sort(good[np.argsort(-chi2[good], kind="stable")[:TERMS]])]


def train(found: np.ndarray, cuts: np.ndarray, labels: np.ndarray, odds: float) -> Machine:
    """Fit by mini-batch gradients with per-weight rates; ``odds`` corrects the bias for the sample's classes."""
    known = chosen_terms(found, cuts, labels) if len(labels) else found
    random = np.random.default_rng(4)
    base = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    machine = Machine(known, base, np.zeros(len(known)), random.normal(0, 0.01, (len(known), FACTORS)))
    at, own = machine.place(found, cuts)
    squares = [1e-2, np.full(len(known), 1e-2), np.full(machine.factors.shape, 1e-2)]
    for _ in range(EPOCHS if len(known) else 0):
        order = random.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            part, bounds = spans.ragged(at, own, rows)
            error = sigmoid(machine.margins(part, bounds)) - labels[rows]
            of = np.repeat(np.arange(len(rows)), np.diff(bounds))
            sums = np.stack([np.bincount(of, machine.factors[part, k], len(rows)) for k in range(FACTORS)], axis=1)
            slope = error[of]
            linear = np.bincount(part, slope, len(known)) + DECAY * len(rows) * machine.weights
            pull = slope[:, None] * (sums[of] - machine.factors[part])
            crossed = np.stack([np.bincount(part, pull[:, k], len(known)) for k in range(FACTORS)], axis=1) + FACTOR_DECAY * len(rows) * machine.factors
            squares[0] += error.sum() ** 2
            squares[1] += linear**2
            squares[2] += crossed**2
            machine.bias -= RATE * error.sum() / np.sqrt(squares[0])
            machine.weights -= RATE * linear / np.sqrt(squares[1])
            machine.factors -= RATE * crossed / np.sqrt(squares[2])
    machine.bias += np.log(odds)
    return machine


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine for ``labels`` (doc_id, label 0 or 1), learnt on at most ``sample`` labelled rows of each class.

    The rows are chosen by a hash of doc_id; only their hashed terms reach the driver.
    """
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    # At most 2 * sample rows, so the join needs no shuffle of the texts.
    parts = [labels.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found, cuts in terms(batch.column(1)):
                blobs = [found[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(blobs)), pa.array(blobs, pa.binary())], ["label", "terms"])

    got = rows.select("label", "text").mapInArrow(run, "label int, terms binary").toArrow()
    blobs = got.column("terms").to_pylist()
    marks = got.column("label").to_numpy().astype(np.float64)
    # The order in which rows arrive depends on the cluster; theirs must not.
    order = sorted(range(len(blobs)), key=lambda i: (blobs[i], marks[i]))
    marks = marks[order]
    cuts = np.concatenate([[0], np.cumsum([len(blobs[i]) // 4 for i in order])]).astype(np.int64)
    found = np.frombuffer(b"".join([blobs[i] for i in order]), np.uint32)
    del got, blobs
    taken = [max(1.0, float((marks == y).sum())) for y in (0, 1)]
    odds = (max(counts.get(1, 0), 1) / taken[1]) / (max(counts.get(0, 0), 1) / taken[0])
    return train(found, cuts, marks, odds)


def score(docs: DataFrame, labels: DataFrame, held_out: F.Column, threshold: float = THRESHOLD, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of ``docs`` (doc_id, text).

    With ``carry`` the whole row of ``docs`` comes along as the struct ``row``.

    ``labels`` has doc_id and toxic; rows for which ``held_out`` holds are not learnt from, nor are nulls. A
    text is the set of its hashed terms. ``score`` is the probability of
    the label 1, ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts have no terms and get the probability without any. Very long texts are read whole.
    Repeated rows stay and, as repeated labels, count each in learning. A null doc_id stays null; a null ``held_out`` counts
    as false. Without labels the score is 0.5 for all. Other columns are not looked at, and an empty table gives no rows.
    """
    hidden = F.coalesce(held_out, F.lit(False))
    usable = labels.where(~hidden & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    machine = fit(docs, usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")), sample)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            scores = [sigmoid(machine.margins(*machine.place(found, cuts))) for _, found, cuts in terms(spans.texts(batch))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *batch.columns[2:][:carry]],
                ["doc_id", "held_out", "score", "predicted", "row"][: 4 + carry])

    rows = docs.select(F.col("doc_id").cast("long"), hidden.alias("held_out"), F.struct("*").alias("row") if carry else F.col("text"))
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int")
    return rows.mapInArrow(run, schema.add("row", docs.schema) if carry else schema)
