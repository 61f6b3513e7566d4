"""Connected components against union-find."""

import random

import pytest

from tonearm.llm import components


def smallest(links):
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: top(i) for i in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "mixed"])
def test_components(spark, shape):
    pick = random.Random(2)
    links = {
        "random": [(pick.randrange(400), pick.randrange(400)) for _ in range(260)],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(300)],
        "mixed": [(3, 3), (5, 4), (4, 5), (4, 5), (-7, 5), (9, 8)],
    }[shape]
    pick.shuffle(links)
    df = spark.createDataFrame(links + [(None, 1), (1, None)], "a long, b long")
    got = {r.id: r.component for r in components.connected(df).collect()}
    want = smallest([x for x in links if x[0] != x[1]])
    assert got == want


def test_no_links(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
