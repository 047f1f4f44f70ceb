"""Connected components against union-find, on stars, chains, cliques and random graphs."""

from __future__ import annotations

import random

from incidentlens.llm.components import components
from incidentlens.llm.tables import workspace


def test_components(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 60)]  # a star
    edges += [(i, i + 1) for i in range(100, 140)] + [(240 - i, 239 - i) for i in range(30)]  # chains
    edges += [(i, j) for i in range(300, 312) for j in range(300, 312)]  # a clique with loops, twice
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    edges += [(900, -5), (-5, 901), (901, 902)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), workspace(spark)).collect()}
    assert got == {x: find(x) for x in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long"), workspace(spark)).count() == 0
