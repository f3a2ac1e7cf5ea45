"""Connected components of a graph too large for one machine.

Edges are contracted in two ways that alternate until nothing changes. Within each
partition a union-find replaces the edges by stars to the smallest node it knows, which
shortens long chains at once. Then the large-star and small-star steps link every node to
the smallest node around it (Kiveris and others, 2014, "Connected Components in MapReduce
and Beyond"). A node's edges are dealt into ``PARTS`` parts by their other end: the minimum
around a node is taken by part first, and goes back to the edges by part, so that a hub's
edges are never gathered in one task.

Defined results: loops and repeated edges don't matter; an empty graph gives no rows; a
node without an edge is not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import staged

_EDGE = "u long, v long"
PARTS = 256


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    rows = [(x, find(x)) for x in list(parent)]
    rows = [(x, r) for x, r in rows if x != r]
    for start in range(0, len(rows), 50_000):
        part = rows[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*part)], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``u > v``."""
    down = edges.select("u", "v")
    around = down.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    around = around.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    by_part = around.groupBy("u", "part").agg(F.min("v").alias("m"))
    lowest = by_part.groupBy("u").agg(F.min("m").alias("m")).withColumn("m", F.least("u", "m"))
    linked = around.join(by_part.select("u", "part").join(lowest, "u"), ["u", "part"])
    moved = (
        linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if large
        else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
    )
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (u, v)``; component is the smallest node."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = staged(now.mapInArrow(_contract, _EDGE).distinct(), "components")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        if mark[0] == 0:
            break
        now = staged(_star(_star(now, True), False), "components")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
