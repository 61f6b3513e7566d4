"""Near-duplicate texts: Order MinHash of word k-mers, banded alignment, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import blocks, spans
from tonearm.llm.components import connected
from tonearm.session import materialize

WORDS = 5  # words of a k-mer
SIMILARITY = 0.8
SKETCHES = 32
PICKS = 2  # minima of a sketch
# Bins of a text's word sketch, and the standard errors by which its estimate may fall short.
BINS = 256
ERRORS = 3.0
BLOCK = 1024
# Pairs of texts that are handed to a task at a time, and those whose words it holds.
PAIRS, HELD = 256, 32
_CELLS = 1 << 20
_STEP = np.random.default_rng(20).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_seeds = np.random.default_rng(21).integers(1, 1 << 63, (3, 256), dtype=np.uint64) | np.uint64(1)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and row offsets of groups of rows of a string column.

    Words are runs of letters and digits, in lower case (ASCII and Latin-1).
    """
    data, offsets = spans.utf8(column)
    for low, high in spans.slices(offsets):
        part = spans.lower(data[offsets[low] : offsets[high]], latin=True)
        start, end, row = spans.words(part, offsets[low : high + 1] - offsets[low], spans.ALPHANUMERIC)
        yield low, spans.hashes(part, start, end), np.searchsorted(row, np.arange(high - low + 1), "left")


def labelled(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers of a text in its order, each with the number of its occurrence.

    A text of fewer words than a k-mer has is one k-mer.
    """
    size = min(size, len(words))
    n = len(words) - size + 1
    grams = np.full(n, np.uint64(size))
    for i in range(size):
        grams += words[i : i + n] * _STEP[i % WORDS]
    grams = spans.mix(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    out = np.empty(n, np.uint64)
    out[order] = spans.mix(ordered + number.astype(np.uint64) * _seeds[2, 255])
    return out


def signatures(grams: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """A signature for each sketch.

    Each sketch orders the k-mers by a hash of its own, takes the ``picks`` smallest and keeps them
    in the order of the text.
    """
    out = np.empty(sketches, np.uint64)
    step = max(1, _CELLS // len(grams))
    picks = min(picks, len(grams))
    for at in range(0, sketches, step):
        use = np.arange(at, min(sketches, at + step))
        values = (grams[None, :] ^ _seeds[0, use][:, None]) * _seeds[1, use][:, None]
        values ^= values >> np.uint64(32)
        chosen = np.argpartition(values, picks - 1, axis=1)[:, :picks] if picks < len(grams) else np.broadcast_to(np.arange(picks), (len(use), picks))
        chosen = np.sort(chosen, axis=1)
        total = use.astype(np.uint64) * _seeds[2, 254]
        for i in range(picks):
            total = spans.mix(total + grams[chosen[:, i]] * _seeds[2, i])
        out[use] = total
    return out


def word_sketch(words: np.ndarray) -> np.ndarray:
    """One byte for each of BINS bins of the hash range: of the smallest occurrence-labelled word in it, 0 if none."""
    ordered = np.sort(labelled(words, 1))
    place = (ordered >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out = np.zeros(BINS, np.uint8)
    out[place[first]] = 1 + (ordered[first] % np.uint64(255)).astype(np.uint8)
    return out


def may_align(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether texts with these word sketches (rows) can have a similarity of ``least``, and how much alike the sketches are.

    Aligned words are words in common, so at the bound the two bags of words have a Jaccard similarity of
    least / (2 - least) or more. The sketches estimate it from the bins in use; a pair passes unless the
    estimate is short by more than ERRORS standard errors.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    share = least / (2 - least)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return same >= share * used - ERRORS * np.sqrt(share * (1 - share) * used), same / np.maximum(used, 1)


def common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence within ``band`` places of the diagonal.

    The rows of the alignment matrix are bits of one integer, of which only the band is held: a
    zero is a place of ``a`` at which the common length grows.
    """
    if len(a) > len(b):
        a, b = b, a
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    low, high, row, found = 0, 0, 0, 0
    for j, x in enumerate(b):
        to = min(len(a), j + band + 1)
        if to > high:
            row |= ((1 << (to - high)) - 1) << (high - low)
            high = to
        at = min(j - band, high)
        if at > low:
            found += (at - low) - (row & ((1 << (at - low)) - 1)).bit_count()
            row >>= at - low
            low = at
        match = places.get(x, 0) >> low
        if match:
            wide = (1 << (high - low)) - 1
            match &= row & wide
            row = ((row + match) | (row - match)) & wide
    return found + (high - low) - row.bit_count()


def similarity(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """2 * common / (words of a + words of b), 0 where it is below ``least``."""
    total = len(a) + len(b)
    if not total or 2 * min(len(a), len(b)) < least * total:
        return 0.0
    # A path to the bound leaves the diagonal by at most this many places.
    band = int(((1 - least) * total + abs(len(a) - len(b))) / 2) + 1
    found = 2 * common(a, b, band) / total
    return found if found >= least else 0.0


def _fingerprints(docs: DataFrame, size: int, sketches: int, picks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words, cuts in word_hashes(batch.column(1)):
                digests, signed, sketched = [], [], []
                counts = np.diff(cuts)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if a == b:
                        digests.append(None), signed.append(None), sketched.append(None)
                        continue
                    own = words[a:b]
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    signed.append(signatures(labelled(own, size), sketches, picks).view(np.int64))
                    sketched.append(word_sketch(own).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(counts)), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()),
                     pa.array(signed, pa.list_(pa.int64())), pa.array(sketched, pa.binary())],
                    ["id", "digest", "n_words", "signatures", "sketch"],
                )

    schema = "id long, digest binary, n_words long, signatures array<long>, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, schema)


def close_rows(left: pa.Array, right: pa.Array, least: float = SIMILARITY) -> list[int]:
    """Rows at which both columns' texts align at ``least`` or above; the words of a few texts are held at a time."""
    close = []
    for at in range(0, len(left), HELD):
        lists = []
        for column in (left, right):
            own = []
            for _, words, cuts in word_hashes(column.slice(at, HELD)):
                own += [words[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            lists.append(own)
        close += [at + row for row, (a, b) in enumerate(zip(*lists)) if similarity(a.tolist(), b.tolist(), least)]
    return close


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts align at ``least`` or above, stored. A batch holds two whole texts for each row, so it has few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(close_rows(batch.column(2), batch.column(3), least), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), batch_rows=PAIRS)


def _fitting(first: np.ndarray, second: np.ndarray, same: bool, words: np.ndarray, classes: np.ndarray, sketches: np.ndarray, least: float):
    """Pairs of a block pair across components whose lengths and word sketches can meet the bound."""
    ratio = least / (2 - least)
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for at in range(0, len(first), 256):
        part = first[at : at + 256]
        x, y = words[part][:, None], words[second][None, :]
        fit = (np.minimum(x, y) >= ratio * np.maximum(x, y)) & (classes[part][:, None] != classes[second][None, :])
        if same:
            fit &= part[:, None] < second[None, :]
        i, j = np.nonzero(fit)
        for low in range(0, len(i), _CELLS // 64):
            p, q = part[i[low : low + _CELLS // 64]], second[j[low : low + _CELLS // 64]]
            passed, alike = may_align(sketches[p], sketches[q], least)
            for place, values in enumerate((p, q, alike)):
                out[place].append(values[passed])
    return [np.concatenate(x) for x in out]


def _nearest(p: np.ndarray, q: np.ndarray, alike: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row outside the largest component its most alike partner: row, partner, likeness."""
    names, counts = np.unique(classes, return_counts=True)
    rows, partners, values = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([alike, alike])
    small = classes[rows] != names[counts.argmax()]
    rows, partners, values = rows[small], partners[small], values[small]
    order = np.lexsort((partners, -values, rows))
    rows, partners, values = rows[order], partners[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else rows
    return rows[first], partners[first], values[first]


def _first_shared(signed: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first signature that both texts of each pair have: of their buckets in common, one is theirs."""
    out = np.zeros(len(p), np.int64)
    for low in range(0, len(p), _CELLS // 64):
        a, b = signed[p[low : low + _CELLS // 64]], signed[q[low : low + _CELLS // 64]]
        out[low : low + len(a)] = a[np.arange(len(a)), (a == b).argmax(axis=1)]
    return out


def _open_pairs(rows: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Pairs of a bucket across components that can align; with ``nearest`` one for each text of the smaller components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in blocks.runs(batches, 3):
            ids, classes, words = (table.column(i).to_numpy() for i in (3, 4, 5))
            in_a = table.column(6).to_numpy(zero_copy_only=False)
            same = table.column(1).to_numpy() == table.column(2).to_numpy()
            blob = table.column(7).to_pylist()
            signed = table.column(8).flatten().to_numpy().reshape(table.num_rows, -1)
            buckets = table.column(0).to_numpy()
            out = [[], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                sketches = np.frombuffer(b"".join(blob[a:b]), np.uint8).reshape(b - a, BINS)
                first = np.arange(b - a) if same[a] else np.flatnonzero(in_a[a:b])
                second = first if same[a] else np.flatnonzero(~in_a[a:b])
                found = _fitting(first, second, bool(same[a]), words[a:b], classes[a:b], sketches, least)
                if nearest:
                    p, q, alike = _nearest(*found, classes[a:b])
                else:
                    p, q, alike = found
                    once = _first_shared(signed[a:b], p, q) == buckets[a]
                    p, q, alike = p[once], q[once], alike[once]
                for place, values in enumerate((ids[a:b][p], ids[a:b][q], alike)):
                    out[place].append(values)
            if out[0]:
                x, y, alike = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(x), pa.array(alike)], ["a", "b", "of", "alike"])

    found = rows.mapInArrow(run, "a long, b long, of long, alike double")
    if nearest:
        return found.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("alike", "a", "b")).alias("best")).select("best.*").distinct()
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, size: int = WORDS, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (the smallest id of its group), kept.

    Texts with the same words are folded. Each other text gets ``sketches`` Order MinHash signatures
    of its occurrence-labelled k-mers of ``size`` words; texts with a signature in common are
    candidates, and a pair is linked if the banded alignment of its words has a similarity of
    ``least`` or more: twice the words in common, in order, by the words of both. A signature agrees
    with a chance of about the square (for two picks) of the share of k-mers that two texts have in
    common in the same order.

    A bucket is not expanded into pairs. Its smallest id leads it, and a text is aligned with the leader of
    most of its buckets, and with its other leaders if that gives no link; that settles a group of
    copies. Buckets left with several components are gone through in blocks: first each text outside the
    largest component with its most alike partner, as long as most of these are links, then all pairs
    across components whose lengths and word sketches can meet the bound, so no link between candidates is lost
    to a large bucket.

    Null and empty texts and texts without a letter or digit are like no other: class_id is their id.
    Repeated rows share a group; rows with the same doc_id are one document. A null doc_id has class_id null
    and kept true. Other columns are not looked at; an empty table gives no rows. Texts are read whole.
    """
    prints = materialize(_fingerprints(docs, size, sketches, picks))
    present = prints.where("digest is not null and id is not null")
    folded = materialize(present.groupBy("digest").agg(F.min(F.struct("id", "n_words", "signatures", "sketch")).alias("own")).select("digest", "own.*"))
    members = folded.select("id", F.explode("signatures").alias("bucket"))
    leaders = materialize(members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialize(members.join(leaders, "bucket").select("bucket", "id", "leader", "n"))
    wanted = folded.select("id", "digest")
    # The leader that a text shares most signatures with; for a copy that is its group's smallest id.
    offers = shared.where("id != leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("signatures"))
    offers = materialize(offers.select(F.col("id").alias("a"), F.col("leader").alias("b"), "signatures"))
    best = materialize(offers.groupBy("a").agg(F.max_by("b", F.struct("signatures", -F.col("b"))).alias("b")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = materialize(texts.join(shared.select("id").distinct(), "id", "left_semi"))
    links = _verified(best, texts, least)
    # Texts that this left alone try their other leaders.
    linked = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    others = materialize(offers.join(linked, "a", "left_anti").select("a", "b").join(best, ["a", "b"], "left_anti"))
    links = materialize(links.unionByName(_verified(others, texts, least)))
    classes = materialize(connected(links))
    tried = best.unionByName(others)

    def opened(nearest: bool) -> DataFrame:
        known = shared.join(classes, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("class"))
        mixed = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("bucket")
        dealt = blocks.paired(known.join(mixed, "bucket"), ["bucket"], "id", BLOCK).join(folded.select("id", "n_words", "sketch", "signatures"), "id")
        keys = ["bucket", "block_a", "block_b"]
        rows = blocks.grouped(dealt.select(*keys, "id", "class", "n_words", "in_a", "sketch", "signatures"), keys)
        return materialize(_open_pairs(rows, least, nearest).join(tried, ["a", "b"], "left_anti"))

    nearest = True
    while True:
        pairs = opened(nearest)
        links = _verified(pairs, texts, least)
        n_pairs, n_links = pairs.count(), links.count()
        tried = tried.unionByName(pairs)
        if n_links:
            classes = materialize(connected(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)))
        if not nearest:
            break
        # Once few of the nearest partners are links, all pairs that are left across components are gone through.
        nearest = 2 * n_links > n_pairs
    named = wanted.join(classes, "id", "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    return prints.join(named, "digest", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("id") == F.coalesce("class_id", "id"), F.lit(True)).alias("kept"))
