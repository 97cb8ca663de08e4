"""Connected components of an edge table: edges contracted within tasks, and pointers that jump to the parent's parent.

Edges lead from a larger to a smaller node. A round has two steps, and each keeps what is connected connected:

* contraction: a task replaces its edges by stars, each node of one of its components to the smallest one there. That is
  done before the shuffle by a, so a node with very many edges sends one row a task, and behind it;
* jump: every edge (a, b) becomes (a, parent of b), with a node's smallest neighbour as its parent. A node keeps the edge to its own
  parent's parent, so the nodes of a tree of parents stay one tree, of half the depth.

At the end each node has one edge, to the smallest node of its component. The join of the jump has two plain
exchanges over written tables, so Spark can split it at a node with many neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release_memory

#: Edges that a task contracts at once, and that a task of a round has on average at least.
EDGES = 1 << 18
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges that is not the smallest itself."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    top = np.arange(len(nodes))
    while True:
        least = np.minimum(top[left], top[right])
        before = top.copy()
        for side in (left, right):
            np.minimum.at(top, side, least)  # the nodes themselves
            np.minimum.at(top, before[side], least)  # and what they pointed to
        top = top[top]
        if (top == before).all():
            break
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _star_batches(size: int):
    def run(batches):
        held, n = [], 0

        def out():
            a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return [x for x in stars(a, b)]

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            n += len(held[-1][0])
            if n >= size:
                found = out()
                if 2 * len(found[0]) > n:  # too many stars to hold on to them
                    yield pa.record_batch([pa.array(x) for x in found], _PAIR)
                    held, n = [], 0
                else:
                    held, n = [found], len(found[0])
        if n:
            yield pa.record_batch([pa.array(x) for x in out()], _PAIR)
        held = []
        release_memory()

    return run


def _contracted(edges: DataFrame, tasks: int | None) -> DataFrame:
    kind = "a long, b long"
    if tasks == 1:
        return cut(edges.select("a", "b").coalesce(1).mapInArrow(_star_batches(EDGES), kind))
    some = edges.select("a", "b").mapInArrow(_star_batches(EDGES), kind)
    dealt = some.repartition(tasks, "a") if tasks else some.repartition("a")
    return cut(dealt.mapInArrow(_star_batches(EDGES), kind))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node that has an edge.

    edges: two columns a and b of longs without nulls; loops and repeated edges do no harm. Each round writes its edges to the
    shared folder; the driver sees counts only. The number of rounds is in the order of the logarithm of the
    largest distance to a root, counted in tasks. As soon as less than EDGES edges are left, one task finishes them.
    """
    now, tasks = edges.where("a <> b"), None
    while True:
        now = _contracted(now, tasks)
        n, starts = now.agg(F.count("*"), F.count_distinct("a")).first()
        if tasks == 1 or n == starts and _flat(now):
            break
        tasks = 1 + n // EDGES
        if tasks > 1:
            parents = cut(now.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("p")))
            now = now.join(parents, F.col("b") == F.col("_a"), "left").select("a", F.coalesce("p", "b").alias("b"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _flat(edges: DataFrame) -> bool:
    """Whether no node that edges lead to has an edge of its own."""
    inner = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return inner.isEmpty()
