"""Research lines: connected investigations over several projects, and their threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import matched
from quillon.operators import edges as E
from quillon.operators import graph as G
from quillon.operators.ranking import first_k
from quillon.session import Workspace

NO_DATE = "9999-99-99"  # fixed value: sorts undated projects last


def memberships(citations: DataFrame, projects: DataFrame, min_members: int = 2) -> DataFrame:
    """(line_id, project_id, start): members of each line; they go by start date, undated last, then by id.

    The line is named after its first member.
    """
    labels = G.components(citations)
    dated = projects.groupBy("project_id").agg(F.min("start_date").alias("start"))
    member = labels.join(dated, F.col("node") == F.col("project_id"), "left").select("component", F.col("node").alias("project_id"), F.coalesce(F.col("start").cast("string"), F.lit(NO_DATE)).alias("start"))
    first = member.groupBy("component").agg(F.count("*").alias("k"), F.min_by("project_id", F.struct("start", "project_id")).alias("first")).where(F.col("k") >= min_members)
    return member.join(first, "component").select(F.concat(F.lit("line-"), "first").alias("line_id"), "project_id", "start")


def research_lines(projects: DataFrame, scores: DataFrame, reuse: DataFrame, project_authors: DataFrame, mentions: DataFrame, min_members: int = 2, min_cosine: float = 0.5, topics: bool = True, member: DataFrame | None = None, alike: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row for each line with its members, authors, handoffs, means and sums.

    Topic edges are counted but do not connect. Edges are handoffs by the strict reading. Means leave
    nulls out, sums count them as 0. ``member`` are the memberships and ``alike`` the classes of equal names and
    their pairs, if they are at hand.
    """
    citations = E.declared(reuse)
    authors = E.memberships(project_authors)
    member = memberships(citations, projects, min_members) if member is None else member
    attrs = projects.select("project_id", "start_date", "completion_date", F.coalesce("revision_depth", F.lit(0)).alias("revisions"), F.coalesce("notebook_count", F.lit(0)).alias("notebooks")).dropDuplicates(["project_id"])
    axes = ("depth", "breadth", "influence", "integration", "self_follow_on")
    marks = scores.select("project_id", *(f"{a}_score" for a in axes), "conclusion_count")
    wide = member.join(attrs, "project_id", "left").join(marks, "project_id", "left")
    order = F.sort_array(F.collect_list(F.struct("start", "project_id")))
    lines = wide.groupBy("line_id").agg(
        F.count("*").alias("member_count"), F.min("start_date").alias("earliest_start"), F.max("completion_date").alias("latest_completion"), *(F.avg(f"{a}_score").alias(f"{a}_mean") for a in axes),
        F.coalesce(F.sum("revisions"), F.lit(0)).alias("total_revisions"), F.coalesce(F.sum("conclusion_count"), F.lit(0)).alias("total_conclusions"), F.coalesce(F.sum("notebooks"), F.lit(0)).alias("total_notebooks"),
        F.transform(order, lambda m: m["project_id"]).alias("members"),
    )
    people = member.join(authors.withColumnRenamed("pid", "project_id"), "project_id").groupBy("line_id").agg(F.sort_array(F.collect_set("aid")).alias("line_authors"))
    at = member.select("line_id", F.col("project_id").alias("src"))
    inside = E.classify_edges(citations, authors).join(at, "src").join(member.select(F.col("line_id").alias("dst_line"), F.col("project_id").alias("dst")), "dst").where("line_id = dst_line")
    flows = inside.groupBy("line_id").agg(F.count_if("strict").alias("cross_author_handoffs"), F.count_if("shared").alias("self_iterations"), F.count("*").alias("citation_edge_count"))
    out = lines.join(people, "line_id", "left").join(flows, "line_id", "left")
    if topics:
        # counted by classes of projects with the same names, as the pairs may be far more than the projects
        of, pairs = alike or G.alike_sets(G.signatures(mentions), min_cosine)
        held = Workspace(member.sparkSession).keep(member.join(of.withColumnRenamed("pid", "project_id"), "project_id").groupBy("line_id", "cls").agg(F.count("*").alias("m")))
        across = G.pairs_in_groups(held, pairs, "line_id").select("line_id", (F.col("mx") * F.col("my")).alias("m"))
        within = held.select("line_id", F.expr("m * (m - 1) div 2").alias("m")).where(F.lit(min_cosine <= 1) & (F.col("m") > 0))
        out = out.join(across.unionAll(within).groupBy("line_id").agg(F.sum("m").alias("topic_edge_count")), "line_id", "left")
    else:
        out = out.withColumn("topic_edge_count", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "line_id", F.col("members")[0].alias("line_name"), "member_count", F.coalesce(F.size("line_authors"), F.lit(0)).cast("long").alias("distinct_author_count"), zero("cross_author_handoffs"), zero("self_iterations"), zero("citation_edge_count"),
        zero("topic_edge_count"), "earliest_start", "latest_completion", *(f"{a}_mean" for a in axes), "total_revisions", "total_conclusions", "total_notebooks", "members", F.coalesce("line_authors", F.expr("cast(array() as array<string>)")).alias("authors"),
    )


def thread_graph(citations: DataFrame, member: DataFrame, mentions: DataFrame, min_members: int = 5, min_cosine: float = 0.5, alike: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph within lines of ``min_members`` or more: (line_id, a, b, weight), 1 for each citation, both
    directions added; and the topic edges by classes of projects with the same names: (line_id, pid, cls)
    and (line_id, x, y, cosine). Projects of one class have cosine 1, so ``min_cosine`` is at most that."""
    large = member.groupBy("line_id").agg(F.count("*").alias("k")).where(F.col("k") >= min_members).select("line_id")
    inside = Workspace(member.sparkSession).keep(member.join(large, "line_id").select("line_id", "project_id"))
    one = inside.select("line_id", F.col("project_id").alias("a"))
    two = inside.select(F.col("line_id").alias("line_b"), F.col("project_id").alias("b"))
    cited = citations.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    edges = cited.join(one, "a").join(two, "b").where("line_id = line_b").groupBy("line_id", "a", "b").agg(F.count("*").cast("double").alias("weight"))
    of, pairs = alike or G.alike_sets(G.signatures(mentions), min_cosine)
    held = Workspace(member.sparkSession).keep(of.join(inside.withColumnRenamed("project_id", "pid"), "pid").select("line_id", "pid", "cls"))
    there = held.groupBy("line_id", "cls").agg(F.count("*").alias("m"))
    within = G.pairs_in_groups(there, pairs, "line_id").select("line_id", "x", "y", "cosine")
    return edges, held, within


def thread_members(citations: DataFrame, projects: DataFrame, mentions: DataFrame, min_members: int = 5, resolution: float = 1.5, seed: int = 42, member: DataFrame | None = None, alike: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(line_id, member, community): the communities in each large line, those of one project too."""
    member = memberships(citations, projects) if member is None else member
    return G.communities_by_class(*thread_graph(citations, member, mentions, min_members, alike=alike), "line_id", resolution, seed)


def sub_clusters(citations: DataFrame, projects: DataFrame, mentions: DataFrame, min_members: int = 5, resolution: float = 1.5, seed: int = 42, top: int = 5, member: DataFrame | None = None, alike: tuple[DataFrame, DataFrame] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(sub_id, line_id, sub_index, member_count, members, top_organisms, top_methods, top_databases):
    the communities of two or more projects in each large line, with their most mentioned entities. ``parts``
    are the thread members, if they are at hand."""
    parts = Workspace(mentions.sparkSession).keep(thread_members(citations, projects, mentions, min_members, resolution, seed, member, alike)) if parts is None else parts
    sized = parts.groupBy("line_id", "community").agg(F.count("*").alias("member_count"), F.sort_array(F.collect_list("member")).alias("members")).where("member_count >= 2")
    named = mentions.where(F.col("entity_kind").isin("organism", "method", "database") & matched(F.col("canonical_id"))).groupBy("project_id", "entity_kind", "canonical_id").agg(F.count("*").alias("n"))
    held = parts.join(named, F.col("member") == F.col("project_id")).groupBy("line_id", "community", "entity_kind", "canonical_id").agg(F.sum("n").alias("n"))
    # cut to the few before they are collected
    held = first_k(held, ["line_id", "community", "entity_kind"], [F.desc("n"), F.asc("canonical_id")], top)
    best = lambda k: F.sort_array(F.collect_list(F.when(F.col("entity_kind") == k, F.struct((-F.col("n")).alias("neg"), "canonical_id"))))
    tops = held.groupBy("line_id", "community").agg(*(F.transform(best(k), lambda x: F.struct(x["canonical_id"].alias("canonical_id"), (-x["neg"]).alias("n"))).alias(f"top_{k}s") for k in ("organism", "method", "database")))
    return sized.join(tops, ["line_id", "community"], "left").select(F.concat("line_id", F.lit("#sub-"), "community").alias("sub_id"), "line_id", F.col("community").alias("sub_index"), "member_count", "members", "top_organisms", "top_methods", "top_databases")
