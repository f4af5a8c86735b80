"""Graph queries over an edge table (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans import cut


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node, in and out; 0 for isolated nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, neighbour, direction, type): what is one edge away from the ids of ``start``."""
    out = edges.join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction"), "type")
    into = edges.join(start.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.lit("in").alias("direction"), "type")
    return out.unionByName(into)


def trace(edges: DataFrame, start: DataFrame, types: list[str] | None = None, deepest: int | None = None) -> DataFrame:
    """(id, depth, via): what leads to the ids of ``start`` over edges of the allowed types, at its least depth.

    A level at a time: the frontier's incoming edges, less what was reached. via is the smallest next node on a
    shortest way. Stops when nothing new is reached; circles end by themselves. The start itself is not in the result.
    """
    allowed = edges if types is None else edges.where(F.col("type").isin(types))
    allowed = cut(allowed.select("src", "dst").distinct())
    reached = cut(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via")).distinct())
    frontier, depth = reached, 0
    while deepest is None or depth < deepest:
        depth += 1
        step = frontier.select(F.col("id").alias("dst")).join(allowed, "dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("via"))
        frontier = cut(step.join(reached.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 8 == 0:
            reached = cut(reached)
    return reached.where("depth > 0")


def frontier(reached: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The nodes of a trace into which no allowed edge leads from within it."""
    allowed = edges if types is None else edges.where(F.col("type").isin(types))
    inner = allowed.join(reached.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return reached.join(inner, "id", "left_anti")


def cross_group(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between nodes of different groups (id, grp), with both."""
    s, d = (groups.select(F.col("id").alias(c), F.col("grp").alias(f"{c}_grp")) for c in ("src", "dst"))
    return edges.join(s, "src").join(d, "dst").where("src_grp <> dst_grp")


def search(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(id, hit): nodes whose name holds ``text`` (two characters at least), and their neighbours."""
    if len(text) < 2:
        return nodes.select("id", F.lit(True).alias("hit")).limit(0)
    hits = nodes.where(F.contains(F.lower("name"), F.lit(text.lower()))).select("id")
    near = neighbours(edges, hits).select(F.col("neighbour").alias("id"), F.lit(False).alias("hit"))
    return hits.withColumn("hit", F.lit(True)).unionByName(near).groupBy("id").agg(F.max("hit").alias("hit"))


def by_group(reached: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n, least, deepest): what a trace reached, by the group (id, grp) of each node; null for nodes without one."""
    return reached.join(groups, "id", "left").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("least"), F.max("depth").alias("deepest"))


def group_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, n): the groups of ``nodes`` (id, grp) that have a node with an edge, with the number of such nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.where("grp is not null").join(ends, "id", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges): how many there are."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.join(F.broadcast(e), F.lit(True))  # one row each


def grid(nodes: DataFrame, group: str, order: list, width: int = 8, gap: int = 100) -> DataFrame:
    """``nodes`` with x and y on a grid per group, in order."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return nodes.withColumn("x", k % width * gap).withColumn("y", F.floor(k / width) * gap)
