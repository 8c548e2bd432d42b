"""Groups of records that are linked directly or over others.

Large-star and small-star rewrites of the edge list alternate until neither changes an edge; then each
record points at the least id of its group. Every rewrite is a distributed aggregation and a join.
Ids become whole numbers in their own order first, so that the rounds shuffle 16 bytes an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.session import Workspace, observed

MAX_ROUNDS = 200  # far beyond the logarithmic number that a graph needs; reaching it is an error


def connected_groups(edges: DataFrame, src_col: str, dst_col: str) -> DataFrame:
    """(node, group_id): every id at either end of an edge with both ends filled, and the least id of
    its group, compared by code point.

    Edges with a null end are left out, also their other end. Repeats and direction don't matter; an
    id that only points at itself is a group of its own. The empty string is an id. Other columns are
    ignored. An empty table gives no rows. Raises if the rewrites don't settle in MAX_ROUNDS rounds.
    """
    spark = edges.sparkSession
    work = Workspace(spark)
    pairs = edges.select(F.col(src_col).alias("s"), F.col(dst_col).alias("d")).where("s is not null and d is not null").distinct()
    pairs = work.keep(pairs)
    names = pairs.select(F.col("s").alias("node")).unionAll(pairs.select(F.col("d").alias("node"))).distinct()
    # a global sort, so the generated ids have the order of the names; written, so they stay
    nodes = work.keep(names.orderBy("node").select("node", F.monotonically_increasing_id().alias("nid")))
    ends = pairs.where("s <> d").join(nodes.select(F.col("node").alias("s"), F.col("nid").alias("a")), "s").join(nodes.select(F.col("node").alias("d"), F.col("nid").alias("b")), "d")
    graph = work.keep(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    for _ in range(MAX_ROUNDS):
        graph, large = _large_star(work, graph)
        graph, small = _small_star(work, graph)
        if not large and not small:
            break
    else:
        raise RuntimeError("the components did not settle")

    roots = graph.select(F.col("u").alias("nid"), "v")
    known = nodes.join(roots, "nid", "left").select("node", F.coalesce("v", "nid").alias("root"))
    heads = nodes.select(F.col("nid").alias("root"), F.col("node").alias("group_id"))
    return known.join(heads, "root").select("node", "group_id")


def _step(work: Workspace, old: DataFrame, new: DataFrame, seen: Observation) -> tuple[DataFrame, int]:
    kept = work.keep(new)
    moved = observed(seen, kept)
    work.drop(old)
    return kept, moved


def _large_star(work: Workspace, graph: DataFrame) -> tuple[DataFrame, int]:
    """Each node hands the least node of its neighbourhood, itself included, to its larger neighbours.

    ``graph`` holds each edge once as (u, v) with u > v.
    """
    lowest = graph.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")  # least neighbour below
    seen = Observation()
    moved = graph.join(lowest, "v", "left").select("u", F.coalesce("m", "v").alias("w"), (F.col("m").isNotNull()).alias("moves"))
    moved = moved.observe(seen, F.count_if("moves").alias("n")).select("u", F.col("w").alias("v")).distinct()
    return _step(work, graph, moved, seen)


def _small_star(work: Workspace, graph: DataFrame) -> tuple[DataFrame, int]:
    """Each node ties its smaller neighbours and itself to the least of them."""
    lowest = graph.groupBy("u").agg(F.min("v").alias("m"))
    seen = Observation()
    tied = graph.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("v") != F.col("m")).alias("moves"))
    tied = tied.observe(seen, F.count_if("moves").alias("n")).select("u", "v").distinct()
    return _step(work, graph, tied, seen)
