"""Tables that are computed from others: scores, lines, threads; and stand-ins for those that the
delivered folders lack (notebooks, revisions, classifications), so that every view runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import matched
from quillon.operators import edges as E
from quillon.operators import graph as G
from quillon.operators import lines as L
from quillon.operators import scores as S
from quillon.operators.classify import EDGE_TYPES, REVISION_KINDS
from quillon.operators.pairs import underexplored_pairs
from quillon.sources.warehouse import Warehouse


def current_projects(w: Warehouse) -> DataFrame:
    """One row for each project: repeats differ in observed_at alone."""
    return w.table("projects").select("project_id", "revision_depth", "notebook_count", "start_date", "completion_date", "effective_completion_date", "last_touched", "total_bytes", "file_count").distinct()


def scores(w: Warehouse) -> DataFrame:
    raw = S.ingredients(current_projects(w), w.table("sections"), w.table("entity_mentions"), w.table("reuse_edges"), w.table("project_authors"))
    return S.axis_scores(raw, w.table("entity_mentions"))


def line_members(w: Warehouse) -> DataFrame:
    """(line_id, project_id, start), from the stored lines if there are any."""
    if w.has("research_lines"):
        start = current_projects(w).groupBy("project_id").agg(F.min("start_date").alias("start"))
        return w.table("research_lines").select("line_id", F.explode(F.from_json("member_ids", "array<string>")).alias("project_id")).join(start, "project_id", "left").select("line_id", "project_id", F.coalesce(F.col("start").cast("string"), F.lit(L.NO_DATE)).alias("start"))
    return L.memberships(E.declared(w.table("reuse_edges"), repeats=True), current_projects(w))


def topics_alike(w: Warehouse) -> DataFrame:
    """(pid, x) of projects and their classes of equal names, and (x, y, cosine) of the pairs of classes, where
    pid is null: lines and threads read both."""
    of, pairs = G.alike_sets(G.signatures(w.table("entity_mentions")), 0.5, False)
    return of.select("pid", F.col("cls").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("double").alias("cosine")).unionAll(pairs.select(F.lit(None).cast("string"), "x", "y", "cosine"))


def _alike(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    both = w.table("topics_alike")
    return both.where("y is null").select("pid", F.col("x").alias("cls")), both.where("y is not null").select("x", "y", "cosine")


def lines_alone(w: Warehouse) -> DataFrame:
    """The lines without the number of their threads, which takes the communities."""
    built = L.research_lines(current_projects(w), w.table("sophistication_composite"), w.table("reuse_edges"), w.table("project_authors"), w.table("entity_mentions"), member=w.table("line_members"), alike=_alike(w))
    return built.select("*", F.to_json("members").alias("member_ids"), F.to_json("authors").alias("distinct_author_ids"))


def lines(w: Warehouse) -> DataFrame:
    threads = w.table("research_line_subclusters").groupBy("line_id").agg(F.count("*").alias("sub_cluster_count"))
    return w.table("lines_alone").join(threads, "line_id", "left").withColumn("sub_cluster_count", F.coalesce("sub_cluster_count", F.lit(0)))


def thread_members(w: Warehouse) -> DataFrame:
    """(line_id, member, community) for readers that don't need what the threads mention."""
    return L.thread_members(E.declared(w.table("reuse_edges")), current_projects(w), w.table("entity_mentions"), member=w.table("line_members"), alike=_alike(w))


def threads(w: Warehouse) -> DataFrame:
    found = L.sub_clusters(E.declared(w.table("reuse_edges")), current_projects(w), w.table("entity_mentions"), parts=w.table("thread_members"))
    return found.select("sub_id", "line_id", "sub_index", "member_count", F.to_json("members").alias("member_ids"), *(F.to_json(c).alias(c) for c in ("top_organisms", "top_methods", "top_databases")))


def _nth(labels: list[str], i):
    return F.element_at(F.array(*map(F.lit, labels)), (i % len(labels) + 1).cast("int"))


def revisions(w: Warehouse) -> DataFrame:
    """Stand-in: as many revisions as a project says, evenly between its first and last date."""
    p = current_projects(w).where("revision_depth >= 1 and start_date is not null and completion_date is not null")
    each = p.select("*", F.explode(F.expr("sequence(1, revision_depth)")).alias("i"))
    day = F.when(F.col("revision_depth") == 1, F.col("completion_date")).otherwise(F.expr("date_add(start_date, cast((datediff(completion_date, start_date) * (i - 1)) div (revision_depth - 1) as int))"))
    return each.select(
        F.concat_ws(":", "project_id", F.lit("RESEARCH_PLAN"), F.concat(F.lit("v"), "i")).alias("revision_id"), "project_id", F.lit("RESEARCH_PLAN").alias("source_doc"), F.concat(F.lit("v"), "i").alias("version_label"),
        day.alias("version_date"), F.lit("day").alias("date_precision"), F.concat(F.lit("change "), "i").alias("change_description"),
    )


def notebooks(w: Warehouse) -> DataFrame:
    """Stand-in: as many notebooks as a project counts."""
    each = current_projects(w).where("notebook_count >= 1").select("project_id", F.explode(F.expr("sequence(1, notebook_count)")).alias("i"))
    i = F.col("i")
    return each.select(
        F.concat_ws(":", "project_id", i).alias("notebook_id"), "project_id", i.alias("notebook_number"), F.when(i % 3 == 0, F.lit("goal")).alias("goal_phrase"), (i * 7 % 11 + 2).alias("total_cells"), (i * 7 % 11).alias("code_cells"), F.lit(2).alias("markdown_cells"),
    )


def classified_edges(w: Warehouse) -> DataFrame:
    """Stand-in: a type and a confidence from the lengths of the ids."""
    rows = w.table("reuse_edges").where("confidence_tier = 'declared' and src_project_id is not null and dst_project_id is not null and edge_id is not null").groupBy("edge_id").agg(F.min(F.struct("src_project_id", "dst_project_id", "source_quote")).alias("e"))
    return rows.select("edge_id", "e.src_project_id", "e.dst_project_id", _nth(EDGE_TYPES, F.length("e.src_project_id") + F.length("e.dst_project_id")).alias("edge_type"), (F.length("edge_id") % 10 / 10.0).cast("double").alias("confidence"), F.lit("by length").alias("rationale"), "e.source_quote")


def classified_revisions(w: Warehouse) -> DataFrame:
    return w.table("project_revisions").select("revision_id", "project_id", _nth(REVISION_KINDS, F.length("revision_id")).alias("kind"), (F.length("revision_id") % 10 / 10.0).cast("double").alias("confidence"), F.lit("by length").alias("rationale"))


def plausibility(w: Warehouse) -> DataFrame:
    pairs = underexplored_pairs(w.table("entity_mentions"))
    return pairs.select("a_kind", "a_canonical", "b_kind", "b_canonical", ((F.length("a_canonical") + F.length("b_canonical")) % 10 / 10.0).cast("double").alias("plausibility"), F.lit("by length").alias("rationale"))


def _by_name(w: Warehouse, kind: str) -> DataFrame:
    named = w.table("entity_mentions").where((F.col("entity_kind") == kind) & matched(F.col("canonical_id")))
    return named.groupBy("canonical_id").agg(F.count("*").alias("n"))


def found(w: Warehouse) -> DataFrame:
    """Stand-in: one claim for each organism, ranked and capped like a model's."""
    from quillon.operators.ranking import rank_findings

    raw = _by_name(w, "organism").select(F.concat(F.col("canonical_id"), F.lit(" recurs")).alias("claim"), F.when(F.length("canonical_id") % 2 == 0, "action_indicated").otherwise("unsure").alias("so_what"), (F.col("n") / 100.0).cast("double").alias("confidence"), F.lit("{}").alias("evidence_json"))
    return rank_findings(raw).withColumns({"prompt_version": F.lit("v1"), "model_id": F.lit("stand-in"), "observed_at": F.lit(None).cast("timestamp_ntz"), "so_what_detail": F.lit("")})


def recommended(w: Warehouse) -> DataFrame:
    from quillon.operators.ranking import rank_recommendations

    raw = _by_name(w, "method").select(
        F.concat(F.lit("Try "), "canonical_id").alias("title"), F.lit("").alias("rationale"), F.when(F.col("n") % 3 == 0, "high").when(F.col("n") % 3 == 1, "medium").otherwise("low").alias("priority"), F.lit("other").alias("gap_type"),
        F.lit("{}").alias("evidence_json"), F.lit("medium").alias("estimated_effort"), (F.col("n") / 10.0).cast("double").alias("plausibility"),
    )
    return rank_recommendations(raw).withColumns({"prompt_version": F.lit("v1"), "model_id": F.lit("stand-in"), "observed_at": F.lit(None).cast("timestamp_ntz")})


DERIVED = {
    "line_members": line_members, "topics_alike": topics_alike, "thread_members": thread_members,
    "sophistication_composite": scores, "lines_alone": lines_alone, "research_lines": lines, "research_line_subclusters": threads, "project_revisions": revisions, "notebooks": notebooks, "edge_classifications": classified_edges,
    "revision_kinds": classified_revisions, "combination_plausibility": plausibility, "findings": found, "recommendations": recommended,
}


def delivered(spark, folder: str) -> Warehouse:
    """The warehouse over a delivered folder."""
    return Warehouse(spark, folder, DERIVED)
