"""Exact top-k and vector near-duplicates against brute force."""

import math

import numpy as np
import pytest

import compare
from tonearm.llm import queries, sign_hash, tiled_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell int"
NAN, INF = float("nan"), float("inf")


def vectors(n=700, dim=16):
    random = np.random.default_rng(5)
    base = random.standard_normal((n // 4, dim))
    rows = []
    for i in range(n):
        kind = i % 5
        v = base[i % len(base)] + random.standard_normal(dim) * (0, 0.05, 0.1, 0.2, 3)[kind]
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3, "x", 1))
    rows += [(1000 + i, rows[7][1], rows[7][2], "x", 1) for i in range(40)]  # exact copies
    rows += [(1100, None, 0, "x", 1), (1150, [], 0, "x", 1), (1200, [0.0] * dim, 0, "x", 1), (1250, [1.0, None] + [0.0] * (dim - 2), 0, "x", 1),
             (1300, [NAN] * dim, 0, "x", 1), (1350, [INF] + [0.0] * (dim - 1), 0, "x", 1), (1400, rows[7][1], None, "x", 1),
             (1450, [1.0, 2.0], 0, "x", 1), (1451, [1.0, 2.0], 0, "x", 1), (None, rows[7][1], 1, "x", 1), (5, rows[5][1], rows[5][2], "x", 1)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in tiled_topk.top_k(df, shard=100, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    coded = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and usable(v)]
    want = {}
    for q, a in coded:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in coded if i != q and len(a) == len(b))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_top_k_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare.difference(spark, compare.connect(folder), folder, queries.QUERIES["op8_tiled_topk"], queries.ORACLE["op8_tiled_topk"]) is None


def test_top_k_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [4e6, 1.0], 0, "x", 1), (1, [4e6, 1.0], 0, "x", 1), (2, [4e6, 2.0], 0, "x", 1)], SCHEMA)
    big = int(256 * 4e6)
    assert [(r.vec_id, r.score) for r in tiled_topk.top_k(df).orderBy("rank").collect()] == [(2, big * big + 256 * 512), (1, big * big + 256 * 256)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tiled_topk.top_k(df).count() == 0
    assert sign_hash.near_duplicates(df).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sign_hash, "BLOCK", block)
    rows = [r for r in vectors() if r[:2] != vectors()[5][:2]]
    got = {r.vec_id: r for r in sign_hash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect() if r.vec_id is not None}
    part = [(i, np.array(v, float), y) for i, v, y, *_ in rows if i is not None and y is not None and usable(v) and any(v)]
    links = {i: set() for i, *_ in rows if i is not None}
    for i, a, x in part:
        for j, b, y in part:
            if i < j and x == y and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    assert set(got) == set(links)
    total = sum(len(x) for x in links.values())
    assert all(got[i].n_links <= len(links[i]) for i in links)  # none below the bound
    assert sum(r.n_links for r in got.values()) >= 0.99 * total
    component = {}
    for i in sorted(links):
        todo = [] if i in component else [i]
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += links[j]
    same = sum(got[i].component_id == component[i] for i in links)
    assert same >= 0.99 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[1000].n_links >= 40 and got[1400].n_links == 0
