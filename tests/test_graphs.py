"""Strong components and closures against brute force on random graphs."""

from __future__ import annotations

import random

import pytest

from heddle.operators import graph


def reach(edges, start):
    seen, work = set(), [start]
    while work:
        for a, b in edges:
            if a == work[0] and b not in seen:
                seen.add(b)
                work.append(b)
        work.pop(0)
    return seen


@pytest.mark.parametrize(("nodes", "many"), [(12, 14), (30, 33), (9, 40), (25, 24)])
def test_components_and_closure(spark, nodes, many):
    rng = random.Random(many)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(many)] + [(i, i + 1) for i in range(100, 106)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(edges + edges[:3], "src long, dst long")
    all_nodes = sorted({n for e in edges for n in e})
    reached = {n: reach(edges, n) for n in all_nodes}
    got = {r["node"]: r["component"] for r in graph.strong_components(df).collect()}
    for a in all_nodes:
        for b in all_nodes:
            together = a == b or (b in reached[a] and a in reached[b])
            if a in got and b in got:
                assert (got[a] == got[b]) is together
    assert set(got) == {n for e in edges if e[0] != e[1] for n in e}
    sources = [0, 1, 2, 100, 105, 106, 200, 300, 999]
    pairs = graph.closure(df, spark.createDataFrame([(s,) for s in sources + [0]], "node long")).collect()
    assert sorted(map(tuple, pairs)) == sorted((s, n) for s in sources for n in reached.get(s, ()))


def test_closure_sums(spark):
    """As counted from the closure, with no join of sources and nodes: what a source reaches is summed before sources meet it."""
    rng = random.Random(1)
    edges = [(rng.randrange(20), rng.randrange(40)) for _ in range(60)] + [(100, 101), (101, 100), (300, 300)]
    df, sources = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in [*range(22), 100, 300, 999]], "node long")
    want = {s: r for s in [*range(22), 100, 300, 999] if (r := reach(edges, s))}
    assert sorted(map(tuple, graph.closure_sums(df, sources).collect())) == sorted((s, len(r), sum(r)) for s, r in want.items())


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(none).count() == 0
    assert graph.closure(none, spark.createDataFrame([(1,)], "node long")).count() == 0
