"""Repairs against brute force over all edits, and against a plain forward search on whole tables."""

import functools
import itertools
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from tonearm.llm import conversation_repair as repair
from tonearm.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    """Fault of each (role, text): b, d, t or nothing."""
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        if not bare:
            found.append("b")
        elif (role, text) in seen:
            found.append("d")
        else:
            found.append("" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return found


def cheapest(rows, faults):
    """Least (cost, audit, lines) by a search over rows and the last two initials, with whole strings."""

    @functools.cache
    def best(i, last, inserted):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            (role, text), fault = rows[i], faults[i]
            cost, audit, lines = best(i + 1, last, 0)
            options.append((2 + cost, "D" + audit, lines))
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                for name, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if last + name[:1] in ("s", "u", "su", "ua", "au"):
                        cost, audit, lines = best(i + 1, name[:1], 0)
                        options.append((price + extra + cost, letter + audit, (f"{name}:{text}", *lines)))
        if inserted < 3:
            for name in ("user", "assistant"):
                if last + name[:1] in ("u", "su", "ua", "au"):
                    cost, audit, lines = best(i, name[:1], inserted + 1)
                    options.append((5 + cost, "I" + audit, (f"{name}:", *lines)))
        return min(options, default=(10**9, "Z", ()))

    return best(0, "", 0)


def judged(rows, solve=cheapest):
    """All results of one conversation from (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    plain = [(role, text) for _, role, text in rows]
    faults = faults_of(plain)
    cost, audit, lines = solve(plain, faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def every_edit(rows, faults):
    """All edits of a short conversation, with up to two inserted rows in each place."""
    found = []
    gaps = [()] + [c for n in (1, 2) for c in itertools.product(("user", "assistant"), repeat=n)]
    edits = [["D"] if fault in ("b", "d") else ["D", "K", "user", "assistant"] for fault in faults]
    for chosen in itertools.product(*edits):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                for name in inserted[i]:
                    cost, audit = cost + 5, audit + "I"
                    lines.append(f"{name}:")
                if i == len(rows):
                    break
                edit = chosen[i]
                if edit == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                cost += (5 if faults[i] == "t" else 0) + (edit != "K")
                audit += "K" if edit == "K" else "R"
                lines.append(f"{rows[i][0] if edit == 'K' else edit}:{rows[i][1]}")
            if re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)):
                found.append((cost, audit, tuple(lines)))
    return min(found)


def check(spark, rows):
    frame = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA + ", size string")
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = {row["conv_id"]: tuple(row)[1:] for row in repair.repair(frame).collect()}
    assert got == {conv: judged(rows) for conv, rows in want.items()}


def test_search_of_the_test_is_right():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b!", "c", "", "d?"])) for _ in range(rng.randrange(4))]
        faults = faults_of(rows)
        assert every_edit(rows, faults) == cheapest(rows, faults)


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = [
        (conv, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, " "]),
         rng.choice(["a.", "b!", "c", "", " \n", "d? ", "é.", None, "long " * rng.randrange(9) + "."]))
        for conv in [None, *range(400)] for _ in range(rng.randrange(1, 12))]
    check(spark, rows)


def test_a_conversation_of_several_pieces(spark):
    rng = random.Random(5)
    rows = [(1, n, rng.choice(["user", "assistant", "system"]), rng.choice([f"{n}.", f"{n}", "again.", "", "x" * rng.randrange(3000) + "!"])) for n in range(3 * repair.PIECE + 17)]
    rows += [(2, n, "user" if n % 2 == 0 else "assistant", f"{n}.") for n in range(repair.PIECE)]
    rows += [(3, n, "user", "the same.") for n in range(2 * repair.PIECE + 1)]
    got = {row["conv_id"]: tuple(row)[1:] for row in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    import sys

    sys.setrecursionlimit(50_000)
    for conv in (1, 2, 3):
        assert got[conv] == judged([row[1:] for row in rows if row[0] == conv], forward)


def forward(rows, faults):
    """As ``cheapest``, from the end and without recursion."""
    after = {last: (0, "", ()) if last in ("", "a") else (10**9, "Z", ()) for last in ("", "s", "u", "a")}

    def inserted(table):
        for _ in range(3):
            for last in table:
                name = "assistant" if last == "u" else "user"
                cost, audit, lines = table[name[0]]
                table[last] = min(table[last], (5 + cost, "I" + audit, (f"{name}:", lines)), key=lambda x: x[:2])
        return table

    after = inserted(after)
    for (role, text), fault in zip(reversed(rows), reversed(faults)):
        table = {}
        for last in after:
            cost, audit, lines = after[last]
            options = [(2 + cost, "D" + audit, lines)]
            if fault not in ("b", "d"):
                for name, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if last + name[:1] in ("s", "u", "su", "ua", "au"):
                        cost, audit, lines = after[name[:1]]
                        options.append((price + (5 if fault == "t" else 0) + cost, letter + audit, (f"{name}:{text}", lines)))
            table[last] = min(options, key=lambda x: x[:2])
        after = inserted(table)
    cost, audit, lines = after[""]
    flat = []
    while lines:
        flat.append(lines[0])
        lines = lines[1]
    return cost, audit, flat


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_on_whole_tables(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    want = defaultdict(list)
    for conv, turn, role, text in table:
        rows = want[conv]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    got = {row["conv_id"]: tuple(row)[1:] for row in queries.QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == {conv: judged(rows, forward) for conv, rows in want.items()}


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect() == []


def test_all_rows_dropped_and_null_ids(spark, tmp_path):
    gone = [(n, 0) for n in range(200) if zlib.crc32(f"{n}:0".encode()) % 20 == 0]
    rows = [(conv, turn, "user", "a.") for conv, turn in gone] + [(None, None, None, None), (None, 3, "user", "b.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {row["conv_id"]: tuple(row)[1:] for row in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {conv for conv, _ in gone} | {None}
    assert all(got[conv] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for conv, _ in gone)
