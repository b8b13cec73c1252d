"""Graph algorithms over (src, dst) edge relations: reachability and strongly connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph import runtime as R

#: Edges up to this many are condensed in one task; more take the distributed way. Results are the same.
ONE_TASK_EDGES = 1_000_000


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all that can be reached from ``roots`` (node), with the least depth; frontier by frontier."""
    e = edges.select("src", "dst").distinct()
    seen = R.cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        front = R.cut(front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = R.cut(seen.union(front))
    return seen


def components(out: dict[str, Iterable[str]]) -> dict[str, str]:
    """Each node's strong component, by its least member; ``out`` has every node and those it leads to."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    comp: dict[str, str] = {}
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    for w in members:
                        comp[w] = min(members)
    return comp


def _tarjan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: dict[str, list[str]] = {}
    for b in batches:
        for s, d in zip(b["src"], b["dst"]):
            out.setdefault(s, [])
            if d is not None:
                out.setdefault(d, [])
                out[s].append(d)
    comp = components(out)
    yield pd.DataFrame({"node": list(comp), "scc": list(comp.values())}, dtype=object)


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Least label along edges until nothing changes."""
    while True:
        new = labels.join(edges, labels.node == edges.src).select(F.col("dst").alias("node"), "label")
        after = R.cut(labels.union(new).groupBy("node").agg(F.min("label").alias("label")))
        if after.join(labels, ["node", "label"], "left_anti").isEmpty():
            return after
        labels = after


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, scc) for all ends of ``edges`` (src, dst) and all ``nodes`` (node): the least node of its component.

    Small graphs: Tarjan's algorithm in one task. Large ones: colouring (Orzan). Each node's colour is the least
    node that reaches it; those of a colour that reach its root form a component and leave.
    """
    e = R.cut(edges.select("src", "dst").distinct())
    ends = e.select(F.col("src").alias("node")).union(e.select("dst"))
    every = (ends.union(nodes.select("node")) if nodes is not None else ends).distinct()
    if e.count() <= one_task_edges:
        rows = e.union(every.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
        return rows.coalesce(1).mapInPandas(_tarjan, "node string, scc string")
    left, done = R.cut(every), None
    e = e.filter("src <> dst")
    while not left.isEmpty():
        colour = _spread(left.select("node", F.col("node").alias("label")), e)
        same = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("c2")), "dst").filter("c1 = c2")
        back = R.cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = _spread(colour.filter("node = label"), back).select("node", F.col("label").alias("scc"))
        done = R.cut(found if done is None else done.union(found))
        left = R.cut(left.join(found, "node", "left_anti"))
        e = R.cut(e.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return done if done is not None else every.select("node", F.col("node").alias("scc"))
