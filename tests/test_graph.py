"""Reachability and strong components, both ways, against plain Python."""

import random

import pytest

from srcgraph.operators import graph as G


def naive(pairs):
    nodes = sorted({x for p in pairs for x in p})
    reach = {n: {n} for n in nodes}
    while True:
        new = {n: set().union(r, *({d for s, d in pairs if s in r},)) for n, r in reach.items()}
        if new == reach:
            break
        reach = new
    return reach, {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_strong_components(spark, one_task):
    rng = random.Random(4)
    pairs = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)})
    e = spark.createDataFrame(pairs, "src string, dst string")
    lone = spark.createDataFrame([("zz",)], "node string")
    got = {r.node: r.scc for r in G.strong_components(e, lone, one_task).collect()}
    assert got == naive(pairs)[1] | {"zz": "zz"}


def test_reachable(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("b", "c")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.node: r.depth for r in G.reachable(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "e": 3}


def test_reachable_has_no_end_of_its_own(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(102)], "src long, dst long").coalesce(1)
    got = {r.node: r.depth for r in G.reachable(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(103)}
