"""The manifest against trees that are built level by level in Python."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from tonearm.llm import merkle_manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def way(found, place):
    steps = []
    for nodes in found[:-1]:
        first = place // 16 * 16
        steps.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 16])))
        place //= 16
    return steps


def built(rows):
    """(tree, key, leaf) -> sorted list of (subroot, root, proof)."""
    trees = defaultdict(list)
    for tree, key, leaf in rows:
        trees[tree].append((key is not None, key or 0, leaf))
    names = sorted(trees, key=lambda name: (name is not None, (name or "").encode()))
    made = {}
    for name in names:
        trees[name].sort()
        made[name] = levels([leaf for _, _, leaf in trees[name]])
    top = levels([made[name][-1][0] for name in names])
    out = defaultdict(list)
    for at, name in enumerate(names):
        for place, (known, key, leaf) in enumerate(trees[name]):
            steps = way(made[name], place) + way(top, at)
            out[name, key if known else None, leaf].append((made[name][-1][0], top[-1][0], steps))
    return {key: sorted(value) for key, value in out.items()}


def check(spark, rows):
    frame = spark.createDataFrame([(*row, "extra") for row in rows], "source string, doc_id long, leaf string, tree string")
    got = defaultdict(list)
    for row in merkle_manifest.manifest(frame, "source", ["doc_id"]).collect():
        assert row["tree"] == "extra"
        proof = [(step["left"], step["right"]) for step in row["proof"]]
        folded = row["leaf"]
        for left, right in proof:
            folded = h(left + folded + right)
        assert folded == row["root"]
        got[row["source"], row["doc_id"], row["leaf"]].append((row["subroot"], row["root"], proof))
    assert {key: sorted(value) for key, value in got.items()} == built(rows)


@pytest.mark.parametrize("sizes", [[1], [2, 1, 16], [17, 256, 257, 1], [5000, 4096, 4097, 3]])
def test_trees_of_several_heights(spark, sizes):
    rows = [(f"s{i}é", n, h(f"{i} {n}")) for i, size in enumerate(sizes) for n in range(size)]
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 1, h("a")), ("", 1, h("b")), ("é", None, h("c")), ("z", None, h("d")), ("z", None, h("d")), ("z", 5, h("e")), ("z", 5, h("e")), ("z", 5, h("f"))]
    check(spark, rows + [("z", 7, h(str(i % 3))) for i in range(40)])


def test_many_trees(spark):
    check(spark, [(f"t{i:04d}", 0, h(str(i))) for i in range(600)])


def test_no_rows(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], "source string, doc_id long, leaf string"), "source", ["doc_id"]).collect() == []


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = [("s", n, h(str(n))) for n in range(300)]
    for row in merkle_manifest.manifest(spark.createDataFrame(rows, "source string, doc_id long, leaf string"), "source", ["doc_id"]).where("doc_id % 50 = 0").collect():
        folded = h("other")
        for step in row["proof"]:
            folded = h(step["left"] + folded + step["right"])
        assert folded != row["root"]


def test_leaf_of_nulls_and_long_texts(spark, odd_documents):
    values = ("doc_id", "source", "lang", "n_chars", "text")
    for row in odd_documents.select(*values, merkle_manifest.leaf(*map(F.col, values)).alias("leaf")).collect():
        parts = ["-" if row[name] is None else f"{len(str(row[name]).encode())}:{row[name]}" for name in values]
        assert row["leaf"] == h("".join(parts))
