"""Closures over parent and reference edges, by rounds of distributed joins.

Each round is one equi-join of the frontier with the edges; pairs already known are left out,
so cycles end. Rounds are cut by tables in the shared folder, which keeps plans short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiarium.scratch import materialize


def reach(edges: DataFrame, *, max_depth: int, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) of every node within ``max_depth`` edges (src, dst) of each root, at its least depth; roots are not their own."""
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    start = edges if roots is None else edges.join(roots.select(F.col(roots.columns[0]).alias("src")), "src", "left_semi")
    frontier = materialize(start.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth")), "reach")
    known = frontier
    for depth in range(2, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).filter("root <> node").distinct()
        step = step.join(known.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(step, "reach")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def inherit_nearest(nodes: DataFrame, *, node: str, parent: str, value: Column) -> DataFrame:
    """node, value, source: its own value or that of its nearest ancestor that has one (null if none).

    Pointer jumping: an undecided node looks at its pointer and takes its answer or its
    pointer, so a chain of n takes log n rounds, as many as any chain of the nodes can need; a
    cycle never decides and stays null.
    """
    state = nodes.select(F.col(node).alias("id"), value.alias("value"), F.when(value.isNotNull(), F.col(node)).alias("source"), F.when(F.col(parent) != F.col(node), F.col(parent)).alias("ptr"))
    state = materialize(state, "inherit")
    for _ in range(state.count().bit_length() + 1):
        up = state.select(F.col("id").alias("ptr"), F.col("value").alias("v2"), F.col("source").alias("s2"), F.col("ptr").alias("p2"))
        done = F.col("source").isNotNull()
        state = state.join(up, "ptr", "left").select("id", F.coalesce("value", "v2").alias("value"), F.coalesce("source", "s2").alias("source"), F.when(~done & F.col("s2").isNull(), F.col("p2")).alias("ptr"))
        state = materialize(state, "inherit")
        if state.filter("source is null and ptr is not null").isEmpty():
            break
    return state.select(F.col("id").alias(node), "value", "source")
