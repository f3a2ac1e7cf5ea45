"""Link graphs: reachability, orphans, cycles. Iterations cut their lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import staged


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node, depth)`` of the nodes that can be reached from ``start (node)``.

    Edges are ``(u, v)``. The frontier is joined with the edges until it is empty; a cycle
    ends by itself as known nodes leave the frontier.
    """
    edges = staged(edges.select("u", "v").distinct(), "graph-edges")
    known = frontier = staged(start.select("node").distinct().withColumn("depth", F.lit(0)), "graph-known")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct()
        frontier = staged(step.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)), "graph-frontier")
        known = staged(known.unionByName(frontier), "graph-known")
    return known


def cyclic_residue(edges: DataFrame) -> DataFrame:
    """``(node)`` of the nodes from which a cycle can be reached, by peeling leaves."""
    left = staged(edges.select("u", "v").distinct(), "graph-left")
    count = left.count()
    while True:
        inner = staged(left.join(left.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "graph-left")
        now = inner.count()
        if now == count:
            return inner.select(F.col("u").alias("node")).distinct()
        left, count = inner, now


def page_links(pages: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Pages ``(page)`` and links ``(u, v)`` of texts with ``[[target]]`` links.

    A page is named by the last word of its first heading, a target by its last word.
    """
    head = F.regexp_extract(F.col(text), r"(?m)^\s*#{1,6}[ \u00a0]+([^\n\r]+)", 1)
    last = lambda c: F.lower(F.regexp_extract(c, r"([\p{L}\p{N}-]+)[^\p{L}\p{N}]*$", 1))
    named = pages.select(last(head).alias("page"), F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)).alias("l"))
    named = named.where("page <> ''")
    links = named.select(F.col("page").alias("u"), F.explode("l").alias("t")).select("u", last(F.col("t")).alias("v"))
    return named.select("page").distinct(), links.where("v <> ''").distinct()


def path_conflicts(paths: DataFrame, tree: str, path: str) -> DataFrame:
    """``(tree, parent, child)`` where a file's path is a folder of another file's.

    Every path is joined with the folders above the others, not with all paths.
    """
    rows = paths.select(F.col(tree).alias("tree"), F.col(path).alias("path")).distinct()
    parts = F.split("path", "/")
    folders = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    above = rows.select("tree", F.col("path").alias("child"), F.explode(folders).alias("parent"))
    return above.join(rows.select("tree", F.col("path").alias("parent")), ["tree", "parent"])
