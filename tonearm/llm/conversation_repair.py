"""Repair of the structure of conversations through an automaton that they all share.

Every row of a conversation becomes a symbol of its role and fault, every conversation a signature. Signatures that end
alike share the end: a node of the automaton is a suffix of signatures, and its arc leads to the suffix without the
first symbol. What a suffix costs from a state of the role grammar on, and the best edits for it, are the same for all
conversations, so they are computed once for each node and state, from the end. Signatures are dealt out by ranges of
their reversed text; a task then visits the automaton depth first and holds one path of it.

A conversation may have any number of rows. Positions come from a range sort, earlier equal rows from an aggregation, and a
signature is cut into pieces of ``PIECE`` symbols: the pieces' cost matrices give the costs at the end
of each piece, which then is a signature of its own that ends in these costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm import ranks
from tonearm.session import materialize

# Rows of a conversation that are one signature.
PIECE = 1024
# Bytes of repaired text of a long conversation that go from task to task as one row.
BLOB_BYTES = 1 << 20

# White space, marks that end a text, legal pairs of role initials, costs of the edits.
BLANK = "^[ \\x09-\\x0D]*$"
ENDED = "[.!?][ \\x09-\\x0D]*$"
LEGAL = "(?=su|ua|au)"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

# States of the grammar (s?(ua)+)?: start, after a system row, after user, after assistant.
FOLLOWS, TO = "uuau", (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
# Symbol of a row that must go; others are the role's initial (o: any other), in upper case for a truncated text.
GONE = "x"
NEVER = 1 << 40

# Costs, edits and last state from each state on.
Node = tuple[list[int], list[str], list[int]]


def node(symbol: str, after: Node) -> Node:
    """The node in front of ``after`` by ``symbol``. Of equal costs the edit with the least letter is taken."""
    costs, edits, ends = after
    best = []
    extra = TRUNCATED if symbol.isupper() else 0
    kind = symbol.lower()
    for state in range(4):
        found = [(DELETE + costs[state], "D", state)]
        if symbol != GONE:
            to = TO[state]
            found.append((REROLE + extra + costs[to], "R", to))
            if kind == FOLLOWS[state]:
                found.append((extra + costs[to], "K", to))
            elif kind == "s" and state == 0:
                found.append((extra + costs[1], "K", 1))
        cost, letter, to = min(found)
        best.append((cost, letter, letter + edits[to], ends[to]))
    return _with_inserts(best)


def _with_inserts(best: list[tuple[int, str, str, int]]) -> Node:
    """Take a row in before this place where that is cheaper, or as cheap and first by letter."""
    made: dict[int, tuple[int, str, int]] = {}
    for state in (2, 3):
        other = best[5 - state]
        made[state] = _cheaper(best[state], other[0], other[2], other[3])
    for state in (0, 1):
        made[state] = _cheaper(best[state], *made[2])
    return tuple([made[state][i] for state in range(4)] for i in range(3))


def _cheaper(own: tuple[int, str, str, int], cost: int, edits: str, end: int) -> tuple[int, str, int]:
    if (cost + INSERT, "I") < own[:2]:
        return cost + INSERT, "I" + edits, end
    return own[0], own[2], own[3]


# At the end of a conversation: nothing or whole pairs are fine, else what is missing is inserted.
END: Node = _with_inserts([(0, "", "", 0), (NEVER, "Z", "", 1), (NEVER, "Z", "", 2), (0, "", "", 3)])


def end_of_piece(costs: list[int]) -> Node:
    return costs, [""] * 4, [0, 1, 2, 3]


def matrix(signature: str) -> list[int]:
    """Least cost from each state before the rows to each state after them, row by row."""
    columns = []
    for last in range(4):
        at = end_of_piece([0 if state == last else NEVER for state in range(4)])
        for symbol in reversed(signature):
            at = node(symbol, at)
        columns.append(at[0])
    return [min(columns[last][state], NEVER) for state in range(4) for last in range(4)]


def decide(signature: str, edits: str, state: int) -> Iterator[tuple[int, str, str | None]]:
    """(row, inserted lines before it, new role or None) of every row that stays; last, if rows follow it, (-1, lines, None)."""
    row, lead = 0, []
    for letter in edits:
        if letter == "I":
            lead.append(NAMES[FOLLOWS[state]] + ":\n")
            state = TO[state]
            continue
        if letter != "D":
            kept_system = letter == "K" and signature[row].lower() == "s"
            yield row, "".join(lead), NAMES[FOLLOWS[state]] if letter == "R" else None
            lead = []
            state = 1 if kept_system else TO[state]
        row += 1
    if lead:
        yield -1, "".join(lead), None


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [matrix(signature) for signature in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv", "piece", "matrix"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from each state on at the end of every piece; pieces of a conversation come last first."""
    last, costs = None, []
    for batch in batches:
        out = []
        for conv, step in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if conv != last:
                last, costs = conv, END[0]
            out.append(costs)
            costs = [min(step[4 * state + to] + costs[to] for to in range(4)) for state in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv", "piece", "after"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the automaton along signatures in the order of their reversed text, with one path of nodes in hand."""
    path: list[Node] = []
    ending, walked = None, ""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        out = ([], [], [])
        for gap, back, after in zip(columns[0], columns[1], columns[4]):
            if gap != ending:
                ending, walked = gap, ""
                path = [END if after is None else end_of_piece([cost - min(after) for cost in after])]
            shared = 0
            for a, b in zip(walked, back):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for symbol in back[shared:]:
                path.append(node(symbol, path[-1]))
            walked = back
            for values, value in zip(out, path[-1]):
                values.append(value)
        base = [0 if after is None else min(after) for after in columns[4]]
        yield pa.RecordBatch.from_arrays([
            batch.column(2), batch.column(3), pa.array([back[::-1] for back in columns[1]], pa.string()),
            pa.array([b + costs[0] for b, costs in zip(base, out[0])], pa.int64()),
            pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int32())),
        ], names=["conv", "piece", "signature", "cost", "edits", "ends"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every piece for the state in which the pieces before it end."""
    last, state = None, 0
    for batch in batches:
        starts, audits = [], []
        for conv, edits, ends in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
            if conv != last:
                last, state = conv, 0
            starts.append(state)
            audits.append(edits[state])
            state = ends[state]
        arrays = [*(batch.column(i) for i in range(4)), pa.array(starts, pa.int32()), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", "piece", "signature", "cost", "start", "edits"])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [], [])
        for conv, piece, signature, start, edits in zip(*(batch.column(i).to_pylist() for i in range(5))):
            for row, lead, role in decide(signature, edits, start):
                place = piece * PIECE + (row if row >= 0 else len(signature) - 1)
                for values, value in zip(out, (conv, place, row >= 0, lead, role)):
                    values.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(out, (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()))],
            names=["conv", "position", "stays", "lead", "new_role"])


_HASHED = "conv string, piece long, seq long, blob binary, digest string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of (conversation, piece) in order: the digest of a conversation of one piece, else stretches of its text."""
    group, many, digest, blob, seq = None, False, None, [], 0

    def out(stretch: bool) -> pa.RecordBatch:
        found = [[group[0]], [group[1]], [seq], [b"\n".join(blob) if stretch else None], [None if stretch else digest.hexdigest()]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds)], names=["conv", "piece", "seq", "blob", "digest"])

    for batch in batches:
        for conv, piece, long, line in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
            if (conv, piece) != group:
                if group and (blob or not many):
                    yield out(many)
                group, many, digest, blob, seq, begun, size = (conv, piece), long, sha256(), [], 0, False, 0
            data = line.encode()
            if many:
                blob.append(data)
                size += len(data)
                if size >= BLOB_BYTES:
                    yield out(True)
                    blob, size, seq = [], 0, seq + 1
            else:
                digest.update(b"\n" + data if begun else data)
                begun = True
    if group and (blob or not many):
        yield out(many)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every long conversation from the stretches of its text in order."""
    last, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "digest"])

    for batch in batches:
        for conv, blob in zip(batch.column(0).to_pylist(), batch.column(3)):
            data = blob.as_buffer()
            if conv != last:
                if last is not None:
                    yield out()
                last, digest = conv, sha256()
            else:
                digest.update(b"\n")
            digest.update(data)
    if last is not None:
        yield out()


def _ordered(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _truth(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text): its faults and its cheapest repair.

    Rows stand in the order of turn, nulls first; rows of one turn by role and then by the sha256 of their text, so that
    equal rows are neighbours. The first fault of a row counts: blank, duplicate (role and text occurred before in the
    conversation) or truncated (the last character that isn't white isn't one of ``.!?``). Repairs keep (K), re-role (R), delete (D) or
    insert (I) rows until the initials of the roles are ``(s?(ua)+)?``; blank and duplicate rows must go. ``audit`` holds
    the letters of the cheapest edits, of several the least as ASCII, and ``cost`` what they cost.

    Returned: conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbours
    whose initials are not su, ua or au), cost, audit and repaired_sha256 of the repaired ``role:text`` lines.
    A null role or text counts as one space, a null conv_id is a conversation. A role is told by its first character, exactly; roles
    with another one, or without any, can't be kept. Texts of any length are read whole; a long conversation passes its
    digest's task as a stream. Other columns are not read; an empty table gives no rows.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    said = rows.select(
        conv.alias("conv"), "conv_id", "turn", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")])
    said = said.withColumn("mark", F.sha2("text", 256))
    initial = F.substring("role", 1, 1)
    slim = said.select(
        "conv", "conv_id", "turn", "role", "mark", F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("kind"))
    # Read three times below.
    placed = materialize(ranks.positions(slim, "conv", ["turn", "role", "mark"]))

    first = placed.groupBy("conv", "role", "mark").agg(F.min("position").alias("position")).select("conv", "position", F.lit(True).alias("first"))
    marked = placed.join(first, ["conv", "position"], "left")
    repeated = F.col("first").isNull() & ~F.col("blank")
    cut = F.col("cut") & F.col("first").isNotNull() & ~F.col("blank")
    symbol = F.when(F.col("blank") | repeated, GONE).when(cut, F.upper("kind")).otherwise(F.col("kind"))
    piece = F.floor(F.col("position") / PIECE).alias("piece")
    pieces = marked.groupBy("conv", piece).agg(
        F.sort_array(F.collect_list(F.struct("position", symbol.alias("symbol"), "kind"))).alias("found"),
        F.max("size").alias("size"), _truth(F.col("blank")).alias("blank"), _truth(repeated).alias("duplicate"), _truth(cut).alias("truncated"))
    pieces = pieces.withColumns({"signature": F.array_join("found.symbol", ""), "kinds": F.array_join("found.kind", "")}).drop("found")
    pieces = materialize(pieces)

    edits = _edits(pieces)
    audits = edits.groupBy("conv").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("piece", "edits")))["edits"], "").alias("audit"),
        F.max(F.when(F.col("piece") == 0, F.col("cost"))).alias("cost"))
    before = F.lag(F.right("kinds", F.lit(1))).over(Window.partitionBy("conv").orderBy("piece"))
    chain = F.concat(F.coalesce(F.col("before"), F.lit("")), F.col("kinds"))
    wrong = F.length(chain) - 1 - F.regexp_count(chain, F.lit(LEGAL))
    faults = pieces.withColumn("before", before).groupBy("conv").agg(
        F.sum(wrong).cast("long").alias("illegal"), *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")])
    turns = placed.groupBy("conv", "conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv", "conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    digests = _digests(said, placed, edits)
    found = turns.join(faults, "conv").join(audits, "conv").join(digests, "conv", "left")
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _edits(pieces: DataFrame) -> DataFrame:
    """(conv, piece, signature, size, cost, start, edits) of all pieces; the cost is right in the first one."""
    long = pieces.where(F.col("size") > PIECE)
    steps = long.select("conv", "piece", "signature").mapInArrow(_matrices, "conv string, piece long, matrix array<long>")
    ends = _ordered(steps, ["conv"], [F.desc("piece")]).mapInArrow(_ends, "conv string, piece long, after array<long>")
    known = pieces.select("conv", "piece", "signature", "size").join(ends, ["conv", "piece"], "left")
    # Pieces are walked together if their ends differ by a constant cost only.
    least = F.array_min("after")
    gap = F.coalesce(F.array_join(F.transform("after", lambda cost: (cost - least).cast("string")), ","), F.lit(""))
    by = ["gap", "back", "conv", "piece"]
    walks = known.select(gap.alias("gap"), F.reverse("signature").alias("back"), "conv", "piece", "after")
    walks = walks.repartitionByRange(*by).sortWithinPartitions(*by)
    solved = materialize(walks.mapInArrow(_solved, "conv string, piece long, signature string, cost long, edits array<string>, ends array<int>"))
    sized = solved.join(pieces.select("conv", "piece", "size"), ["conv", "piece"])
    alone = sized.where(F.col("size") <= PIECE).select(
        "conv", "piece", "signature", "cost", F.lit(0).alias("start"), F.col("edits")[0].alias("edits"))
    several = _ordered(sized.where(F.col("size") > PIECE).select(solved.columns), ["conv"], ["piece"]).mapInArrow(
        _chained, "conv string, piece long, signature string, cost long, start int, edits string")
    return materialize(alone.unionByName(several))


def _digests(said: DataFrame, placed: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, digest) of every conversation of which a row stays or is inserted."""
    chosen = edits.select("conv", "piece", "signature", "start", "edits").mapInArrow(
        _decisions, "conv string, position long, stays boolean, lead string, new_role string")
    rows = chosen.join(placed.select("conv", "position", "role", "mark", "size"), ["conv", "position"])
    # Rows that stay are the only ones of their role and text, so copies of a text are folded before it moves.
    texts = said.groupBy("conv", "role", "mark").agg(F.first("text").alias("text"))
    line = F.concat("lead", F.coalesce("new_role", "role"), F.lit(":"), "text")
    kept = rows.where("stays").join(texts, ["conv", "role", "mark"]).select("conv", "position", "size", F.lit(0).alias("part"), line.alias("line"))
    # Lines inserted at the end of a piece: the next line follows after a line feed of its own.
    tails = rows.where("not stays").select("conv", "position", "size", F.lit(1).alias("part"), F.regexp_replace("lead", "\n$", "").alias("line"))
    piece = F.floor(F.col("position") / PIECE).alias("piece")
    lines = kept.unionByName(tails).select("conv", piece, "position", "part", (F.col("size") > PIECE).alias("long"), "line")
    hashed = materialize(_ordered(lines, ["conv", "piece"], ["position", "part"]).mapInArrow(_joined, _HASHED))
    rest = _ordered(hashed.where("digest is null"), ["conv"], ["piece", "seq"]).mapInArrow(_digested, "conv string, digest string")
    return hashed.where("digest is not null").select("conv", "digest").unionByName(rest)
