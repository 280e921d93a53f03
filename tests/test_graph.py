import random

import pytest

from docweave.operators import graph


def _plain_members(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    reach = {}
    for a in to:
        seen, stack = set(), [a]
        while stack:
            for y in to.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        reach[a] = seen
    on = {a for a in to if a in reach[a]}
    return {a: min(b for b in on if b == a or (b in reach[a] and a in reach.get(b, ()))) for a in on}


@pytest.mark.parametrize("small", [0, 10_000])
def test_cycles(spark, small):
    rng = random.Random(small)
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (7, 7), (8, 9)] + [(rng.randint(20, 40), rng.randint(20, 40)) for _ in range(28)]
    got = {r.node: r.cycle for r in graph.cycle_members(spark.createDataFrame(edges, "src long, dst long"), small).collect()}
    assert got == _plain_members(edges)
    assert 3 not in got  # lies between two cycles


def test_no_cycle(spark):
    assert graph.cycle_members(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0
    assert graph.cycle_members(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cycles_where_every_node_has_one_edge(spark, seed):
    rng = random.Random(seed)
    edges = [(a, rng.randrange(30)) for a in range(30)] + [(k, k + 1) for k in range(100, 140)] + [(50, 50), (60, 61), (61, 60), (62, 60)]
    got = {r.node: r.cycle for r in graph.cycle_members(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == _plain_members(edges)


def test_reach_in_a_forest(spark):
    """Long chains, branches, and a ring that no root reaches; other graphs give the same level by level."""
    edges = [(k, k + 1) for k in range(0, 150)] + [(10, 1000), (1000, 1001), (300, 301), (400, 401), (401, 400)]
    df, roots = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (300,), (999,)], "node long")
    got = {(r.root, r.node, r.depth) for r in graph.reach(df, roots).collect()}
    want = {(0, k, k) for k in range(151)} | {(0, 1000, 11), (0, 1001, 12), (300, 300, 0), (300, 301, 1), (999, 999, 0)}
    assert got == want
    assert {(r.root, r.node, r.depth) for r in graph.reach(df, roots, max_depth=2).collect()} == {x for x in want if x[2] <= 2}


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.node, r.depth) for r in graph.reach(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
