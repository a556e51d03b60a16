"""Connected components and breadth-first frontiers over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.sources import tables


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, of all nodes that have edges.

    Alternating large and small stars: every round links each node's neighbours
    to the least of them, so a component of n nodes takes about log n rounds.
    Each round is a table in the shared folder, and the one before it goes; the
    rounds end when all edges lead from a leaf to its root.
    """
    e, old = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"), None
    own = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().filter("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = tables.settle(down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if old is not None:
            tables.discard(old)
        old = e
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty():
            break
    return own.join(e.withColumnRenamed("u", "node").withColumnRenamed("v", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def extend(known: DataFrame, edges: DataFrame, rank: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the components of the last run (``known``: node, root) with new edges, each named by its member of the least rank.

    Only new edges are walked.  A node that has some goes to the least of itself and
    its neighbours by them, which contracts stars in one aggregate; what is left is
    walked between those and the roots that nodes had.  Components that no new edge
    touches keep their rows.  ``rank`` (node, rank; one row a node, no two alike)
    says who stands for a component, by default the node itself.  A root is the best
    of its component, so the best of the roots and new nodes that meet is the best
    of all; the result of several runs is that of one over all edges.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(b, a))
    up = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.when(F.col("node").isNotNull(), F.least("node", "near")).alias("up"))
    up = tables.settle(up.join(known.select("node", "root"), "node", "left"), "ends")
    of = lambda end: up.select(F.col("node").alias(end), F.col("up").alias(f"__{end}"))
    met = edges.select(a, b).join(of(a), a).join(of(b), b).select(F.col(f"__{a}").alias("a"), F.col(f"__{b}").alias("b"))
    held, fresh = up.filter("root IS NOT NULL").select("up", "root").distinct(), up.filter("root IS NULL").select("node", "up")
    met = tables.settle(met.union(held).distinct(), "met")  # (x, x) too, so that every ``up`` has a group
    groups = tables.settle(components(met), "groups")
    some = fresh.select("up", "node").union(held)
    ranked = some.withColumn("rank", F.col("node")) if rank is None else some.join(rank.select("node", "rank"), "node", "left")
    first = ranked.groupBy("up").agg(F.min(F.struct(F.col("rank").isNull(), "rank", "node")).alias("best"))
    best = first.join(groups.withColumnRenamed("node", "up"), "up").groupBy("root").agg(F.min("best").alias("best"))
    moved = tables.settle(groups.join(best, "root").select(F.col("node").alias("root"), F.col("best.node").alias("best")), "moved")
    whole = known.select("node", "root").union(fresh)
    return whole.join(moved, "root", "left").select("node", F.coalesce("best", "root").alias("root"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds, each at its first step; the frontier is joined, the visited are anti-joined."""
    seen = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = front.select(F.col("node").alias(a)).join(edges.select(a, b), a).select(F.col(b).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        if d < depth:
            front = tables.settle(front, "frontier")
        seen = seen.unionByName(front)
    return seen
