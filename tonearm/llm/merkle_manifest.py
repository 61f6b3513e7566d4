"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled in the order in which they can be computed: by the last leaf below them, then by height. A
sweep in label order lets every node send its digest to its parent, whose label is greater; a priority queue
ordered by label holds the messages until the sweep gets there. The reversed sweep lets every parent
send its children what they need of a proof above them.

The queue is external. Trees are cut into blocks of ``ARITY ** CLIMB`` consecutive nodes; a block is swept by
one task with a small heap, and messages between blocks go through Spark's shuffle, sorted by label on disk, to the
next round. A round leaves one node of ``ARITY ** CLIMB``, so a source of any size needs a few
rounds and no task holds more than one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tonearm.llm import blocks, ranks
from tonearm.session import materialize

ARITY = 16
# Levels that a task climbs in one round.
CLIMB = 3
BLOCK = ARITY**CLIMB
# Rows with their proofs in one Arrow batch.
ROWS_A_BATCH = 512

PROOF = "array<struct<left string, right string>>"
_NODE = "tree string, position long, size long, digest string"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else the number of its UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Agenda:
    """Priority queue of messages to nodes, in the order of the receivers' labels."""

    def __init__(self):
        self.heap, self.sent = [], 0

    def send(self, label: tuple, message) -> None:
        heapq.heappush(self.heap, (label, self.sent, message))
        self.sent += 1

    def next_label(self) -> tuple | None:
        return self.heap[0][0] if self.heap else None

    def receive(self, label: tuple) -> list:
        """All messages to ``label``, which is the first receiver, in the order in which they were sent."""
        found = []
        while self.heap and self.heap[0][0] == label:
            found.append(heapq.heappop(self.heap)[2])
        return found


def height_of(size: int) -> int:
    """Levels above ``size`` nodes until one remains."""
    height = 0
    while size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


def _parent(label: tuple[int, int], leaves: int) -> tuple[int, int]:
    """Label (last leaf below, height) of the parent of a node in a block of ``leaves`` nodes."""
    last, height = label
    span = ARITY ** (height + 1)
    return min((last // span + 1) * span, leaves) - 1, height + 1


def climb(leaves: Sequence[str], height: int) -> tuple[str, dict[tuple, list[str]]]:
    """Forward sweep of a block: the digest of its top, and for each inner node the digests of its children."""
    agenda, children = Agenda(), {}

    def settle(until: tuple) -> None:
        while (label := agenda.next_label()) is not None and label < until:
            children[label] = agenda.receive(label)
            made = digest("".join(children[label]))
            if label[1] < height:
                agenda.send(_parent(label, len(leaves)), made)
            else:
                children["top"] = [made]

    if not height:
        return leaves[0], {}
    for place, found in enumerate(leaves):
        settle((place, 0))
        agenda.send(_parent((place, 0), len(leaves)), found)
    settle((len(leaves), 0))
    return children.pop("top")[0], children


def descend(leaves: Sequence[str], height: int, above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Reversed sweep of a block: the proof of each leaf, siblings left and right from the lowest level to the top.

    ``above`` is the proof of the block's top. Messages go down in descending order of labels.
    """
    if not height:
        return [above]
    _, children = climb(leaves, height)
    agenda, proofs = Agenda(), [[] for _ in leaves]
    agenda.send((1 - len(leaves), -height), above)
    while (label := agenda.next_label()) is not None:
        (rest,) = agenda.receive(label)
        last, level = -label[0], -label[1]
        if level == 0:
            proofs[last] = rest
            continue
        family = children[last, level]
        span = ARITY ** (level - 1)
        first = last // ARITY**level * ARITY**level
        for i in range(len(family)):
            step = ("".join(family[:i]), "".join(family[i + 1 :]))
            child = min(first + (i + 1) * span, len(leaves)) - 1
            agenda.send((-child, 1 - level), [step, *rest])
    return proofs


def _steps(proofs: list[list[tuple[str, str]]]) -> pa.Array:
    offsets = [0]
    for proof in proofs:
        offsets.append(offsets[-1] + len(proof))
    steps = [step for proof in proofs for step in proof]
    lefts, rights = pa.array([a for a, _ in steps], pa.string()), pa.array([b for _, b in steps], pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([lefts, rights], fields=list(_STEP)))


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / BLOCK))


def _raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, cuts in blocks.runs(batches, 2):
        names, places, sizes, digests = (table.column(i).to_pylist() for i in (0, 1, 3, 4))
        tops = [climb(digests[a:b], min(CLIMB, height_of(sizes[a])))[0] for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([
            pa.array([names[a] for a in cuts[:-1]], pa.string()), pa.array([places[a] for a in cuts[:-1]], pa.int64()),
            pa.array([-(-sizes[a] // BLOCK) for a in cuts[:-1]], pa.int64()), pa.array(tops, pa.string()),
        ], names=["tree", "position", "size", "digest"])


def _raise(nodes: DataFrame) -> DataFrame:
    """One round upwards: the top of each block, as a node of the next round."""
    dealt = _blocked(nodes).select("tree", "block", "position", "size", "digest")
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    return dealt.mapInArrow(_raised, _NODE)


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, cuts in blocks.runs(batches, 2):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # The message from above is first; it has no size.
            message, rows = table.slice(a, 1), table.slice(a + 1, b - a - 1)
            above = [(step["left"], step["right"]) for step in message.column(5)[0].as_py()]
            size = rows.column(3)[0].as_py()
            proofs = descend(rows.column(4).to_pylist(), min(CLIMB, height_of(size)), above)
            for start in range(0, len(proofs), ROWS_A_BATCH):
                part = rows.slice(start, ROWS_A_BATCH)
                said = [pa.array([message.column(i)[0].as_py()] * part.num_rows, pa.string()) for i in (6, 7)]
                arrays = [part.column(0), part.column(2), _steps(proofs[start : start + ROWS_A_BATCH]), *said, part.column(8)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "position", "proof", "subroot", "root", "row"])


def _lower(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """One round downwards: every node of a block gets its proof from the message to the block's top.

    ``nodes`` has a column ``row`` that is passed on; ``messages`` has tree, position (of the block), proof, subroot, root.
    """
    kind = nodes.schema["row"].dataType
    null = F.lit(None)
    own = _blocked(nodes).select(
        "tree", "block", "position", "size", "digest", null.cast(PROOF).alias("proof"),
        null.cast("string").alias("subroot"), null.cast("string").alias("root"), "row")
    sent = messages.select(
        "tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"), null.cast("long").alias("size"),
        null.cast("string").alias("digest"), "proof", "subroot", "root", null.cast(kind).alias("row"))
    dealt = own.unionByName(sent).repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    schema = StructType(
        [dealt.schema[name] for name in ("tree", "position", "proof", "subroot", "root")] + [StructField("row", kind)])
    return dealt.mapInArrow(_lowered, schema)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, from ``nodes`` to the tops of the trees."""
    rounds = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        rounds.append(materialize(_raise(rounds[-1])))
        largest = -(-largest // BLOCK)
    return rounds


def _proved(rounds: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Proofs of the nodes of the first round from the messages to the tops."""
    none = F.lit(None).cast("string")
    for nodes in reversed(rounds[1:-1]):
        messages = materialize(_lower(nodes.withColumn("row", none), messages).drop("row"))
    return _lower(rounds[0], messages)


def manifest(rows: DataFrame, tree: str, order: Sequence[str], digest: str = "leaf") -> DataFrame:
    """All columns of ``rows`` with ``position`` in its tree, ``subroot``, ``root`` and ``proof``.

    ``digest`` holds the leaf of a row; leaves of equal ``tree`` stand in the order of ``order``, nulls first, then by
    digest. While several nodes remain, 16 consecutive ones become the digest of their digests; a run at the end may be
    shorter, even a single node. What remains is ``subroot``; the subroots in the order of ``tree`` (null
    first, then by UTF-8 bytes) give ``root`` in the same way. ``proof`` lists, from the leaf up to the root, the digests of
    the run to the left and to the right of the node, so that
    ``aggregate(proof, leaf, (d, p) -> sha2(concat(p.left, d, p.right), 256))`` is the root.

    A null tree is a tree of its own. Rows that are equal in ``order`` and digest are leaves of their own;
    which of them comes first makes no difference. An empty table gives an empty table. ``rows`` may have columns
    with any names but the four added ones. It is read several times: give a stored slim table, not whole texts.
    """
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("tree"), F.col(digest).alias("digest"),
        *[F.col(name).alias(f"_{i}") for i, name in enumerate(order)], F.struct(*rows.columns).alias("row"))
    ranked = ranks.positions(named, "tree", [*(f"_{i}" for i in range(len(order))), "digest"])
    leaves = materialize(ranked.select("tree", "position", "size", "digest", "row"))
    rounds = _rounds(leaves)

    trees = rounds[-1].select(F.lit("").alias("all"), "tree", "digest")
    trees = ranks.positions(trees, "all", ["tree"])
    trees = materialize(trees.select(F.col("all").alias("tree"), "position", "size", "digest", F.col("tree").alias("row")))
    tops = _rounds(trees)
    nothing = F.array().cast(PROOF)
    messages = tops[-1].select(
        "tree", "position", nothing.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    sent = _proved(tops, messages).select(F.col("row").alias("tree"), F.lit(0).cast("long").alias("position"), "proof", "root")
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    sent = materialize(sent.join(subroots, "tree"))
    return _proved(rounds, sent).select("row.*", "position", "subroot", "root", "proof")


def manifest_sql() -> str:
    """The manifest of ``documents`` with its checks, level by level, in DuckDB's SQL."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")

    def made(text: str) -> str:
        values = [text if name == "text" else f"{name}::VARCHAR" for name in columns]
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, start: str) -> str:
        """Nodes of all levels and the runs that become one node."""
        return f"""{name}_up(tree, level, idx, digest, n) AS (
            {start}
            UNION ALL
            SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
            FROM {name}_up WHERE n > 1 GROUP BY tree, level, idx // 16, n
        ), {name}_runs AS (
            SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS d FROM {name}_up WHERE n > 1 GROUP BY ALL
        )"""

    def walk(name: str, start: str) -> str:
        """The siblings of a leaf on its way up, and the digest folded with them."""
        return f"""{name}_walk(line, tree, level, idx, folded, proof) AS (
            {start}
            UNION ALL
            SELECT w.line, w.tree, w.level + 1, w.idx // 16,
                sha256(array_to_string(d[1:w.idx % 16], '') || w.folded || array_to_string(d[w.idx % 16 + 2:], '')),
                w.proof || array_to_string(d[1:w.idx % 16], '') || array_to_string(d[w.idx % 16 + 2:], '')
            FROM {name}_walk w JOIN {name}_runs r ON w.tree = r.tree AND w.level = r.level AND w.idx // 16 = r.run
        ), {name}_top AS (
            SELECT line, tree, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM {name}_walk GROUP BY line, tree
        )"""

    return f"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), docs AS (
        SELECT row_number() OVER () AS line, *, coalesce('=' || source, '') AS tree, {made("text")} AS leaf, {made(lowered)} AS low,
            xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) AS sum
        FROM documents, crc
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
            count(*) OVER (PARTITION BY tree) AS n
        FROM docs
    ), {tree("a", "SELECT tree, 0, idx, leaf, n FROM placed")},
    subroots AS (
        SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM a_up WHERE n = 1
    ), {tree("b", "SELECT '', 0, idx, digest, n FROM subroots")},
    {walk("a", "SELECT line, tree, 0, idx, CASE WHEN sum % 5 = 0 THEN low ELSE leaf END, '' FROM placed")},
    {walk("b", "SELECT line, '', 0, s.idx, folded, proof FROM a_top JOIN subroots s USING (tree)")}
    SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
        folded = r.digest AS verified
    FROM placed p JOIN subroots s ON p.tree = s.tree JOIN b_top t ON p.line = t.line
    CROSS JOIN (SELECT digest FROM b_up WHERE n = 1) r"""
