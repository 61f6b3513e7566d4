"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import spans
from tonearm.session import materialize, spread

CHUNK_BYTES = 6 << 20  # text of one group of documents
CHUNKS_A_BUCKET = 8
FREQUENT = 16  # tokens that are a class of their own
SHAPES = 16  # classes of all other tokens
CLASSES = FREQUENT + SHAPES
SLOTS = 4096  # hashed contexts of one template
TEMPLATES = 3
ROUNDS = 2
RATE = 0.15
STEP_TOKENS = 1 << 15
NGRAM_BUCKETS = 3  # buckets of n-grams of one template for each bucket of words
TEXT_ROWS, GROUP_ROWS = 256, 8  # texts and groups of them that a Python step takes at a time
DOUBT = 2  # tokens that a context needs to count as much as the shorter one
_LOW = np.uint64(SHAPES - 1)
# An n-gram's key: 40 bits of its context, 23 of its token, and one that says whether it is learnt from.
_TAIL, _LEARNT = np.uint64((1 << 24) - 1), np.uint64(1)
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
# The end of a text, and what stands before its start.
END = np.uint64(0xE0D0_0000_0000_0000)
BEFORE = np.uint64(0xB0F0_0000_0000_0000)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows and their offsets: words parted by white space, A-Z lower-cased, then an end.

    The low bits of a word's hash are its shape, a hash of its last two bytes.
    """
    text = spans.lower(data)
    start, end, row = spans.words(text, offsets)
    last = text[end - 1].astype(np.uint64)
    before = np.where(end - start > 1, text[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    shape = spans.mix((last << np.uint64(8) | before) * _MIX[3]) & _LOW
    found = spans.hashes(text, start, end) & ~_LOW | shape
    n = len(offsets) - 1
    cuts = np.searchsorted(row, np.arange(n + 1), "left") + np.arange(n + 1)
    out = np.full(cuts[-1], END)
    keep = np.ones(len(out), dtype=bool)
    keep[cuts[1:] - 1] = False
    out[keep] = found
    return out, cuts


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of all batches, whose last column is the text, in groups of CHUNK_BYTES at most; a longer text is alone."""
    held, size = [], 0
    for batch in batches:
        offsets = spans.utf8(batch.column(batch.num_columns - 1))[1]
        offsets = offsets + 32 * np.arange(len(offsets))
        for low, high in spans.slices(offsets, CHUNK_BYTES):
            own = int(offsets[high] - offsets[low])
            if held and size + own > CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(low, high - low))
            size += own
    if held:
        yield pa.Table.from_batches(held)


_GROUPED = "chunk long, size long, ids array<long>, held_out array<boolean>, marks array<long>, lengths binary, words binary, which binary"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group of documents: its distinct tokens, and which of them stand in its texts."""
    task = TaskContext.get().partitionId() << 32
    for number, rows in enumerate(_groups(batches)):
        data, offsets = spans.utf8(rows.column("text"))
        found, cuts = tokens(data, offsets)
        words, which = _ranks(found)
        ends = pa.array([0, rows.num_rows], pa.int32())
        columns = [pa.array([task + number], pa.int64()), pa.array([len(data) + 32 * rows.num_rows], pa.int64())]
        columns += [pa.ListArray.from_arrays(ends, rows.column(name).combine_chunks()) for name in ("id", "held_out", "mark")]
        columns += [pa.array([x], pa.binary()) for x in (_planes(np.diff(cuts).astype("<u8")), _planes(_gaps(words)), _planes(which.astype("<u4")))]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "size", "ids", "held_out", "marks", "lengths", "words", "which"])


def _opened(groups: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of one group, the place of every token among them, the documents' offsets, and which are learnt from."""
    words = np.cumsum(_values(groups.column("words")[row].as_buffer(), "<u8"), dtype=np.uint64)
    which = _values(groups.column("which")[row].as_buffer(), "<u4")
    cuts = np.concatenate([[0], np.cumsum(_values(groups.column("lengths")[row].as_buffer(), "<u8").astype(np.int64))])
    return words, which, cuts, ~groups.column("held_out")[row].values.to_numpy(zero_copy_only=False)


def _requested(groups: Iterator[pa.RecordBatch], request) -> Iterator[pa.RecordBatch]:
    """What request() asks for each group: the number of its first bucket, and the keys and counts of all its buckets."""
    for batch in groups:
        for row in range(batch.num_rows):
            first, keys, counts, at = request(*_opened(batch, row))
            parts = list(zip(at[:-1].tolist(), at[1:].tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array(range(first, first + len(parts)), pa.int32()), pa.array([batch.column("chunk")[row].as_py()] * len(parts), pa.int64()),
                pa.array([_planes(_gaps(keys[a:b])) for a, b in parts], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in parts], pa.binary()),
            ], ["bucket", "chunk", "keys", "counts"])


_REQUESTED = "bucket int, chunk long, keys binary, counts binary"


def _buckets(words: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the buckets of ascending words: equal stretches of the hash range."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(words, edges, "left"), [len(words)]]).astype(np.int64)


def _requests(buckets: int):
    """Distinct tokens of every group of documents and how often its training documents have them."""

    def request(words, which, cuts, train):
        counts = np.bincount(which, np.repeat(train, np.diff(cuts)), len(words)).astype("<u4")
        return 0, words, counts, _buckets(words, buckets)

    return lambda groups: _requested(groups, request)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place of every key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    distinct = ordered[fresh]
    del ordered
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(fresh) - 1
    return distinct, ranks


def _asked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys of all requests of a bucket and the requests' offsets; the distinct keys, the place of every key among them, and their counts."""
    keys = [np.cumsum(_values(x.as_buffer(), "<u8"), dtype=np.uint64) for x in table.column("keys")]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
    keys = np.concatenate(keys)
    pa.default_memory_pool().release_unused()
    distinct, which = _ranks(keys)
    counts = np.concatenate([_values(x.as_buffer(), "<u4") for x in table.column("counts")])
    return keys, cuts, distinct, which, np.bincount(which, counts, len(distinct)).astype(np.int64)


def _count(table: pa.Table) -> pa.Table:
    """Counts over the corpus for every request of a bucket, and the bucket's totals and top tokens."""
    _, cuts, distinct, which, total = _asked(table)
    answer = total[which].astype("<u8" if total.max(initial=0) >> 32 else "<u4")
    known = total > 0
    shape = (distinct & _LOW).astype(np.int64)
    top = np.argsort(-total, kind="stable")[:FREQUENT]
    top = top[total[top] > 0]
    n = table.num_rows
    empty = [None] * n
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
        "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
        "counts": pa.array([_planes(answer[a:b]) for a, b in zip(cuts[:-1], cuts[1:])] + [None], pa.binary()),
        "wide": pa.array([answer.itemsize == 8] * n + [None], pa.bool_()),
        "shape_tokens": pa.array(empty + [np.bincount(shape, total, SHAPES).astype(np.int64)], pa.list_(pa.int64())),
        "shape_words": pa.array(empty + [np.bincount(shape[known], minlength=SHAPES).astype(np.int64)], pa.list_(pa.int64())),
        "top_words": pa.array(empty + [distinct[top].view(np.int64)], pa.list_(pa.int64())),
        "top_counts": pa.array(empty + [total[top]], pa.list_(pa.int64())),
    })


_COUNTED = "chunk long, bucket int, counts binary, wide boolean, shape_tokens array<long>, shape_words array<long>, top_words array<long>, top_counts array<long>"


def _before(found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before every token, and the second before."""
    place = np.arange(len(found)) - np.repeat(cuts[:-1], np.diff(cuts))
    one, two = np.full(len(found), BEFORE), np.full(len(found), BEFORE)
    one[1:] = np.where(place[1:] >= 1, found[:-1], BEFORE)
    two[2:] = np.where(place[2:] >= 2, found[:-2], BEFORE)
    return one, two


def ngrams(found: np.ndarray, cuts: np.ndarray, templates: range = range(TEMPLATES)) -> np.ndarray:
    """Keys of every token with its contexts, shorter ones first: the second token before alone, the one before, both."""
    one, two = _before(found, cuts)
    tail = spans.mix(found * _MIX[3]) & _TAIL & ~_LEARNT
    heads = (lambda: spans.mix(two * _MIX[2]), lambda: spans.mix(one * _MIX[0]), lambda: spans.mix(one * _MIX[1] + spans.mix(two)))
    return np.stack([spans.mix(heads[t]() + np.uint64(t)) & ~_TAIL | tail for t in templates])


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _planes(values: np.ndarray) -> bytes:
    """The values' size in bytes, then their bytes, all first ones first, compressed."""
    return values.nbytes.to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), "zstd", asbytes=True)


def _values(planes, kind: str) -> np.ndarray:
    packed, wide = pa.py_buffer(planes), np.dtype(kind).itemsize
    size = int.from_bytes(packed.slice(0, 8).to_pybytes(), "little")
    raw = np.frombuffer(pa.decompress(packed.slice(8), size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(kind).ravel()


def _ngram_requests(buckets: int, first_bucket: int, template: int):
    """Distinct n-grams of one template of every group of documents and how often its training documents have them."""

    def request(words, which, cuts, train):
        keys = ngrams(words[which], cuts, range(template, template + 1))[0] | np.repeat(train, np.diff(cuts)).astype(np.uint64)
        keys.sort()
        first = _starts(keys & ~_LEARNT)
        counts = np.add.reduceat((keys & _LEARNT).astype("<u4"), first, dtype="<u4")
        keys = keys[first] & ~_LEARNT
        return first_bucket, keys, counts, _buckets(keys, buckets)

    return lambda groups: _requested(groups, request)


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending distinct n-grams, how many tokens its context has, and how many in n-grams seen once."""
    first = _starts(keys & ~_TAIL)
    if not len(first):
        return counts, counts
    size = np.diff(np.append(first, len(keys)))
    return np.repeat(np.add.reduceat(counts, first), size), np.repeat(np.add.reduceat((counts == 1).astype(np.int64), first), size)


def shares(counts: np.ndarray, n: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each n-gram gets from its context, and what all of that context get together.

    A context of n tokens, of which some are in n-grams seen once, gives out (n - once) / (n + DOUBT) by
    relative frequency; a shorter context gives out the rest.
    """
    given = (n - once) / (n + DOUBT)
    return given * counts / np.maximum(n, 1), given


def _ngram_count(table: pa.Table) -> pa.Table:
    """Counts over the corpus for every request of a bucket; a context's totals stand at its first n-gram, one up, then zeros."""
    keys, cuts, distinct, which, total = _asked(table)
    n, once = totals(distinct, total)
    idle = n == once  # such a context gives nothing out, whatever its counts: zeros take no room
    total[idle], n[idle], once[idle] = 0, 0, 0
    kind = "<u8" if n.max(initial=0) >> 31 else "<u4"
    out = [[], [], []]
    for low, high in zip(cuts[:-1], cuts[1:]):
        place = which[low:high]
        first = _starts(keys[low:high] & ~_TAIL)
        out[0].append(_planes(total[place].astype(kind)))
        for column, values in zip(out[1:], (n, once)):
            spelt = np.zeros(len(place), kind)
            spelt[first] = values[place[first]] + 1
            column.append(_planes(spelt))
    return pa.table({
        "chunk": table.column("chunk"), "bucket": table.column("bucket"), "wide": pa.array([kind == "<u8"] * table.num_rows, pa.bool_()),
        **{name: pa.array(x, pa.binary()) for name, x in zip(("seen", "n", "once"), out)},
    })


def _shares_of(known: pa.Table, buckets: range) -> tuple[np.ndarray, np.ndarray]:
    """Shares from the counts of a group's buckets, in order of bucket; one bucket at a time to save memory."""
    place = {b: i for i, b in enumerate(known.column("bucket").to_pylist())}
    parts = []
    for i in (place[b] for b in buckets if b in place):
        kind = "<u8" if known.column("wide")[i].as_py() else "<u4"
        seen, n, once = (_values(known.column(c)[i].as_buffer(), kind) for c in ("seen", "n", "once"))
        first = np.maximum.accumulate(np.where(n > 0, np.arange(len(n)), 0))
        parts.append([x.astype(np.float32) for x in shares(seen, n[first].astype(np.int64) - 1, once[first].astype(np.int64) - 1)])
    return tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0, np.float32)]) for k in range(2))


class Corpus:
    """What scoring needs to know of the training tokens: bounded in size, whatever the corpus."""

    def __init__(self, shape_tokens: np.ndarray, shape_words: np.ndarray, top: list[tuple[int, int]]):
        self.n, self.v = int(shape_tokens.sum()), int(shape_words.sum())
        order = sorted((np.uint64(w & 0xFFFF_FFFF_FFFF_FFFF), c) for w, c in top)
        self.frequent = np.array([w for w, _ in order], np.uint64)
        frequent_counts = np.array([c for _, c in order], np.int64)
        shape = (self.frequent & _LOW).astype(np.int64)
        self.rest_tokens = shape_tokens - np.bincount(shape, frequent_counts, SHAPES).astype(np.int64)
        self.rest_words = shape_words - np.bincount(shape, minlength=SHAPES)
        share = np.zeros(CLASSES)
        share[: len(order)] = frequent_counts
        share[FREQUENT:] = self.rest_tokens
        share[FREQUENT:] += 1
        self.prior = np.full(CLASSES, -1e4)
        used = share > 0
        self.prior[used] = np.log(share[used] / share.sum())

    def classes(self, found: np.ndarray) -> np.ndarray:
        out = FREQUENT + (found & _LOW).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == found, at, out)
        return out


def contexts(found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Slots of the features of every token: the token before, the two before, and the second before alone."""
    one, two = _before(found, cuts)
    slots = np.uint64(SLOTS - 1)
    keys = (one * _MIX[0], one * _MIX[1] + spans.mix(two), two * _MIX[2])
    return np.stack([(spans.mix(k) & slots).astype(np.int64) + t * SLOTS for t, k in enumerate(keys)])


def _odds(weights: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Activations of the classes in each context, their exponentials and the sums of these; the weights' last row is the prior."""
    values = weights.take(features[0], axis=0)
    for row in features[1:]:
        values += weights.take(row, axis=0)
    values += weights[-1]
    ones = np.ones(values.shape[1], values.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        odds = np.exp(values)
        total = odds @ ones
    if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):
        values -= values.max(axis=1, keepdims=True)
        odds = np.exp(values)
        total = odds @ ones
    return values, odds, total


def _activations(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes in each context."""
    values, _, total = _odds(weights, features)
    return values - np.log(total)[:, None]


def _trained(weights: np.ndarray, corpus: Corpus, found: np.ndarray, cuts: np.ndarray, squares: np.ndarray) -> None:
    """Gradient steps with per-weight rates over the tokens, in place."""
    target, features = corpus.classes(found), contexts(found, cuts)
    for at in range(0, len(found), STEP_TOKENS):
        part = slice(at, at + STEP_TOKENS)
        _, error, total = _odds(weights, features[:, part])
        error /= total[:, None]
        error[np.arange(len(error)), target[part]] -= 1
        for row in features[:, part]:
            order = np.argsort((row % SLOTS).astype(np.uint16), kind="stable")
            ordered = row[order]
            first = _starts(ordered)
            gradient = np.add.reduceat(error.take(order, axis=0), first, axis=0)
            own = ordered[first]
            squares[own] += gradient * gradient
            weights[own] -= RATE * gradient / np.sqrt(squares[own] + 1e-6)


def _train(groups: DataFrame, corpus: Corpus, rounds: int) -> np.ndarray:
    """Weights of the class model: in each round every task steps over its share of the round's documents
    from the common weights, and the changes are averaged by tokens in a tree."""
    context = groups.sparkSession.sparkContext
    weights = np.zeros((TEMPLATES * SLOTS + 1, CLASSES), np.float32)
    weights[-1] = corpus.prior
    for number in range(rounds):
        shared = context.broadcast((weights, corpus))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, known = shared.value
            own, squares, n = start.copy(), np.full(start.shape, 1.0, np.float32), 0
            for batch in batches:
                for row in range(batch.num_rows):
                    words, which, cuts, train = _opened(batch, row)
                    marks = batch.column("marks")[row].values.to_numpy()
                    which, cuts = spans.ragged(which, cuts, np.flatnonzero(train & (marks % rounds == number)))
                    _trained(own, known, words[which], cuts, squares)
                    n += len(which)
            if n:
                change = ((own - start) * np.float32(n)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([change], pa.binary())], ["n", "change"])

        changes = groups.select("held_out", "marks", "lengths", "words", "which").mapInArrow(run, "n long, change binary").rdd.map(lambda r: (r.n, np.frombuffer(r.change, np.float32)))
        n, total = changes.treeAggregate((0, None), _added, _added, depth=3)
        if n:
            weights = weights + (total / n).reshape(weights.shape)
        shared.unpersist()
    return weights


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], b[1] if a[1] is None else a[1] if b[1] is None else a[1] + b[1]


def _scores(buckets: int, shared):
    """Scores of a group of documents, from the counts of its tokens and the model."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        weights, corpus = shared.value
        words, which, cuts, train = _opened(group, 0)
        pa.default_memory_pool().release_unused()
        known = answers.select(["bucket", "counts", "wide"]).filter(pc.is_valid(answers.column("counts")))
        parts = sorted(range(known.num_rows), key=lambda i: known.column("bucket")[i].as_py())
        counts = np.concatenate([_values(known.column("counts")[i].as_buffer(), "<u8" if known.column("wide")[i].as_py() else "<u4") for i in parts]).astype(np.float64)
        base_of = np.log10((counts + 1) / (corpus.n + corpus.v + 1))
        shape = (words & _LOW).astype(np.int64)
        within = np.log10((counts + 1) / (corpus.rest_tokens + corpus.rest_words + 1)[shape])
        within[np.isin(words, corpus.frequent)] = 0
        found = words[which]
        model, target, features = within[which], corpus.classes(words)[which], contexts(found, cuts)
        for low in range(0, len(found), STEP_TOKENS):
            part = slice(low, low + STEP_TOKENS)
            values, _, total = _odds(weights, features[:, part])
            model[part] += (values[np.arange(len(values)), target[part]] - np.log(total)) / np.log(10)
        del features
        chance = 10.0**model
        each = NGRAM_BUCKETS * buckets
        for template in range(TEMPLATES):
            seen, given = _shares_of(answers, range(buckets + template * each, buckets + (template + 1) * each))
            _, own = _ranks(ngrams(found, cuts, range(template, template + 1))[0])
            chance = seen[own] + (1 - given[own].astype(np.float64)) * chance
        of_row = lambda values: np.add.reduceat(values, cuts[:-1])
        return pa.table({
            "doc_id": group.column("ids")[0].values, "held_out": pa.array(~train), "n_tokens": pa.array(np.diff(cuts), pa.int64()),
            "n_known": pa.array(of_row((counts > 0).astype(np.int64)[which]), pa.int64()), "train_tokens": pa.array(np.full(len(train), corpus.n), pa.int64()),
            "base_score": pa.array(of_row(base_of[which]), pa.float64()), "score": pa.array(of_row(np.log10(chance)), pa.float64()),
        })

    return run


def _stored(df: DataFrame, batch_rows: int) -> DataFrame:
    """materialize(), and the shuffle files behind the stored table go at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialize(df, batch_rows)
    finally:
        conf.set(key, before)


def score(docs: DataFrame, held_out: F.Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Learns from the rows where ``held_out`` is false. Tokens are words parted by ASCII white space, A-Z
    lower-cased, and one end for each text. ``base_score`` is the log10 probability under add-one
    unigrams. ``score`` is that of all n-grams of the training texts (the second token before, the one before,
    both, each with the token): every context gives out a part of the probability by its counts, and
    what it leaves goes to the next shorter one (``shares``). The last one leaves its rest to
    the model p(class | context) p(token | class): the class factor is
    a softmax over hashed features (the token before, the two before, the second before alone), the
    token factor has token features only, whose maximum-entropy solution is the add-one share within
    the class; unseen tokens have one share of each class. The ``FREQUENT`` most common tokens are classes of
    their own, all others fall into classes by a hash of their last two bytes.

    Counts cover all training tokens. Texts are read and cut once: a task stores its documents in groups of bounded size, as
    distinct tokens and their places, and texts themselves are not shuffled. A group asks for the
    counts of its distinct tokens, bucket by bucket, and only the class totals and the most common
    tokens reach the driver. Gradients are summed in a tree. The n-grams are counted in buckets of their own, so that
    no task holds the table of all; they are compared by 40 bits of a hash of the context and 23 of the token.

    Null and empty texts are the end alone. Very long texts are scored whole. Repeated rows are scored and counted
    each. A null doc_id stays null; a null ``held_out`` counts as false. Without training
    rows counts are 0 and every token has an even share. Other columns are not looked at, and an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64("text").alias("mark"), "text")
    groups = _stored(spread(rows).mapInArrow(_tokenised, _GROUPED), TEXT_ROWS)
    size = groups.agg(F.sum("size")).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    buckets = max(min(chunks, spark.sparkContext.defaultParallelism), -(-chunks // CHUNKS_A_BUCKET))
    texts = groups.select("chunk", "held_out", "lengths", "words", "which")
    counted = _stored(texts.mapInArrow(_requests(buckets), _REQUESTED).groupBy("bucket").applyInArrow(_count, _COUNTED), GROUP_ROWS)
    totals = counted.where("chunk is null")
    shapes = totals.select(F.posexplode(F.arrays_zip("shape_tokens", "shape_words")).alias("shape", "x")).groupBy("shape").agg(
        F.sum("x.shape_tokens").alias("n"), F.sum("x.shape_words").alias("v")).collect()
    tops = totals.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("x")).select("x.*").orderBy(F.desc("top_counts"), "top_words").limit(FREQUENT).collect()
    tokens_of, words_of = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in shapes:
        tokens_of[r.shape], words_of[r.shape] = r.n, r.v
    corpus = Corpus(tokens_of, words_of, [(r.top_words, r.top_counts) for r in tops])
    weights = _train(groups, corpus, rounds)
    shared = spark.sparkContext.broadcast((weights, corpus))
    answers, each = counted.where("chunk is not null").select("chunk", "bucket", "counts", "wide"), NGRAM_BUCKETS * buckets
    for template in range(TEMPLATES):
        wanted = texts.mapInArrow(_ngram_requests(each, buckets + template * each, template), _REQUESTED)
        found = _stored(wanted.groupBy("bucket").applyInArrow(_ngram_count, "chunk long, bucket int, wide boolean, seen binary, n binary, once binary"), GROUP_ROWS)
        answers = answers.unionByName(found, allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return groups.select("chunk", "ids", "held_out", "lengths", "words", "which").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(buckets, shared), schema)
