"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import hot_keys, salted_join, save


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); a component is
    named by its smallest node.  Loops and repeated edges are ignored, nodes
    of loops alone have no row, and an empty table gives an empty one.

    Every round hooks each node to its smallest neighbour, if that is smaller; doubling
    the pointers takes each tree to its root; then the edges are relabelled by the
    roots.  A node that is a tree of its own has only neighbours that hook to smaller
    ones, so it hooks in the next round: two rounds halve the nodes at least, and a
    chain in order takes a single round with the logarithm of its length in doublings.
    Each step ends in a written table.  Nodes of many edges are dealt out in parts."""
    edges = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    labels = None
    while rows := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = save(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("c")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"), "c"), "cc-map")
        hot = hot_keys(seen, "node", 2 * rows)
        roots = _to_roots(seen.select("node", "root"))
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            sizes = labels.groupBy("component").agg(F.count("*").alias("c"))
            labels = save(_through(labels, "component", roots, hot_keys(sizes.withColumnRenamed("component", "node"), "node", labels.count()), F.col("__node")), "cc-labels")
        moved = _through(_through(edges, "a", roots, hot, F.col("b")), "b", roots, hot, F.col("a")).where("a <> b")
        edges = save(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _through(rows: DataFrame, column: str, roots: DataFrame, hot: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``column`` replaced by its root, where it has one."""
    moved = rows.select(*(F.col(c).alias("__node" if c == "node" else c) for c in rows.columns)).withColumn("node", F.col(column))
    joined = salted_join(moved, roots, "node", hot, by, "left").withColumn(column, F.coalesce("root", column)).drop("node", "root")
    return joined.withColumnRenamed("__node", "node")


def _to_roots(roots: DataFrame) -> DataFrame:
    """``roots`` (node, root), pointers to smaller nodes, with each led to its end."""
    while True:
        up = roots.where("node <> root").select(F.col("node").alias("n"), F.col("root").alias("r"))
        steps = roots.where("node <> root").join(up, F.col("root") == F.col("n"))
        if steps.isEmpty():
            return roots
        sizes = roots.groupBy("root").agg(F.count("*").alias("c"))
        hot = hot_keys(sizes, "root", roots.count())
        further = up.select(F.col("n").alias("root"), "r")
        roots = save(salted_join(roots, further, "root", hot, F.col("node"), "left").select("node", F.coalesce("r", "root").alias("root")), "cc-roots")
