"""The registry of metric views. A view is a builder over a warehouse with documented columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import claim_type, days_between, matched, month
from quillon.operators import edges as E
from quillon.sources.warehouse import Warehouse


@dataclass(frozen=True)
class View:
    name: str
    title: str
    category: str
    columns: dict[str, str]
    build: Callable[[Warehouse], DataFrame]
    min_rows: int = 0
    headline: bool = False


@dataclass
class ViewResult:
    view: View
    df: DataFrame | None
    row_count: int = 0
    sane: bool = False
    error: str | None = None


VIEWS: dict[str, View] = {}


def view(title: str, category: str, columns: str, min_rows: int = 0, headline: bool = False):
    """Registers a builder. ``columns`` names them in order, ``name: meaning`` divided by semicolons."""

    def register(build: Callable[[Warehouse], DataFrame]):
        meaning = dict(x.strip().split(": ", 1) if ": " in x else (x.strip(), x.strip().replace("_", " ")) for x in columns.split(";"))
        if build.__name__ in VIEWS:
            raise ValueError(f"two views {build.__name__}")
        VIEWS[build.__name__] = View(build.__name__, title, category, meaning, build, min_rows, headline)
        return build

    return register


def run_view(w: Warehouse, name: str) -> ViewResult:
    """A failing view reports its error and doesn't end the batch."""
    v = VIEWS[name]
    try:
        df = v.build(w).select(*v.columns)
        n = df.count()
    except Exception as e:
        return ViewResult(v, None, error=str(e))
    return ViewResult(v, df, n, n >= v.min_rows)


def run_all(w: Warehouse) -> list[ViewResult]:
    return [run_view(w, name) for name in VIEWS]


def provenance(spark: SparkSession, v: View) -> DataFrame:
    return spark.createDataFrame([(c, d, v.name) for c, d in v.columns.items()], "column_name string, definition string, sql_view string")


def one_row(*parts: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out


def ids(column: str = "project_id"):
    return F.sort_array(F.collect_list(column))


def distinct_ids(column: str = "project_id"):
    return F.sort_array(F.collect_set(column))


def percent(part, whole, digits: int = 1):
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def depth_bucket():
    d = F.col("revision_depth")
    return F.when(d.isNull(), "no-history").when(d == 1, "single-version").when(d.between(2, 3), "mid-2-3x").otherwise("deep-4plus")


BUCKETS = ["deep-4plus", "mid-2-3x", "single-version", "no-history"]  # fixed value: their order
PSEUDO_SECTIONS = ["__frontmatter__", "__preamble__"]
FAILURES = ["extraction_error", "parse_error"]
CLAIM_TYPES = ["descriptive", "mechanistic", "predictive", "methodological", "negative_result"]

# corpus and life cycle --------------------------------------------------------------------------


@view("Corpus in numbers", "corpus", "projects; sections; revisions; distinct_authors; distinct_orcids; notebooks; reuse_edge_rows; distinct_reuse_pairs: pairs of any tier; earliest_start; latest_completion", 1, True)
def corpus_summary(w: Warehouse) -> DataFrame:
    count = lambda t, c: w.table(t).agg(F.count("*").alias(c))
    return one_row(
        w.table("projects").agg(F.count("*").alias("projects"), F.min("start_date").alias("earliest_start"), F.max("completion_date").alias("latest_completion")),
        count("sections", "sections"),
        count("project_revisions", "revisions"),
        w.table("authors").agg(F.count_distinct("author_id").alias("distinct_authors"), F.count_distinct("orcid_id").alias("distinct_orcids")),
        count("notebooks", "notebooks"),
        w.table("reuse_edges").agg(F.count("*").alias("reuse_edge_rows"), F.count_distinct(F.struct("src_project_id", "dst_project_id")).alias("distinct_reuse_pairs")),
    )


@view("Projects", "lifecycle", "project_id; start_date; completion_date; revision_depth; review_date; review_reviewer; total_bytes; file_count; notebook_count; has_references_md; depth_bucket", 50, True)
def project_inventory(w: Warehouse) -> DataFrame:
    return w.table("projects").withColumn("depth_bucket", depth_bucket()).orderBy(F.desc_nulls_last("completion_date"), "project_id")


@view("Projects completed by month", "lifecycle", "year_month; projects_completed; project_ids", 2, True)
def project_completion_by_month(w: Warehouse) -> DataFrame:
    done = w.table("projects").where("completion_date is not null")
    return done.groupBy(month(F.col("completion_date")).alias("year_month")).agg(F.count("*").alias("projects_completed"), ids().alias("project_ids")).orderBy("year_month")


@view("Revision depth", "lifecycle", "depth_bucket; project_count; pct: share of all projects; project_ids: most revised first", 2, True)
def revision_depth_distribution(w: Warehouse) -> DataFrame:
    projects = w.table("projects")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce(-F.col("revision_depth"), F.lit(1)).alias("d"), "project_id")))
    by = projects.groupBy(depth_bucket().alias("depth_bucket")).agg(F.count("*").alias("project_count"), F.transform(order, lambda x: x["project_id"]).alias("project_ids"))
    whole = projects.agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("depth_bucket"))
    return by.crossJoin(F.broadcast(whole)).withColumn("pct", percent(F.col("project_count"), F.col("n"))).orderBy(rank)


@view("How methods evolved", "lifecycle", "project_id; version_label; version_date; date_precision; source_doc; change_description", 10, True)
def methodology_evolution_narration(w: Warehouse) -> DataFrame:
    deep = w.table("projects").where("revision_depth >= 3").select("project_id")
    return w.table("project_revisions").join(deep, "project_id", "left_semi").orderBy("project_id", F.asc_nulls_last("version_date"), F.asc_nulls_last("version_label"))


@view("Revisions for each active day", "lifecycle", "project_id; revision_depth; start_date; completion_date; days_active; revisions_per_day: null when all fell on one day", 5)
def iteration_density(w: Warehouse) -> DataFrame:
    days = days_between(F.col("start_date"), F.col("completion_date"))
    rate = F.round(F.col("revision_depth").cast("double") / F.nullif(days, F.lit(0)), 3)
    return w.table("projects").where("revision_depth >= 2").withColumns({"days_active": days, "revisions_per_day": rate}).orderBy(F.desc_nulls_last("revisions_per_day"), "project_id")


# citations --------------------------------------------------------------------------------------


def _classified(w: Warehouse):
    authors = E.memberships(w.table("project_authors"))
    return E.classify_edges(E.declared(w.table("reuse_edges")), authors), authors


@view("Most cited projects", "reuse", "dst_project_id; in_degree: all citing projects; cross_in_degree: citing projects that share no author; distinct_downstream_authors; downstream_author_ids; total_citing_sections; cited_by", 10, True)
def top_cited_projects(w: Warehouse) -> DataFrame:
    classified, authors = _classified(w)
    cited = classified.groupBy(F.col("dst").alias("pid")).agg(F.count("*").alias("in_degree"), F.count(F.when(F.col("loose"), F.col("src"))).alias("cross_in_degree"), distinct_ids("src").alias("cited_by"))
    reached = E.authors_across(classified, authors, True, False).groupBy("pid").agg(F.count("*").alias("distinct_downstream_authors"), ids("aid").alias("downstream_author_ids"))
    rows = w.table("reuse_edges").where("confidence_tier = 'declared'").groupBy(F.col("dst_project_id").alias("pid")).agg(F.count("*").alias("total_citing_sections"))
    return (
        cited.join(reached, "pid", "left")
        .join(rows, "pid", "left")
        .select(F.col("pid").alias("dst_project_id"), "in_degree", "cross_in_degree", F.coalesce("distinct_downstream_authors", F.lit(0)).alias("distinct_downstream_authors"), F.coalesce("downstream_author_ids", F.expr("cast(array() as array<string>)")).alias("downstream_author_ids"), F.coalesce("total_citing_sections", F.lit(0)).alias("total_citing_sections"), "cited_by")
        .orderBy(F.desc("in_degree"), F.asc_nulls_last("dst_project_id"))
    )


@view("Most citing projects", "reuse", "src_project_id; out_degree; total_citing_sections; cites", 10, True)
def top_citing_projects(w: Warehouse) -> DataFrame:
    rows = w.table("reuse_edges").where("confidence_tier = 'declared'")
    return rows.groupBy("src_project_id").agg(F.count_distinct("dst_project_id").alias("out_degree"), F.count("*").alias("total_citing_sections"), distinct_ids("dst_project_id").alias("cites")).orderBy(F.desc("out_degree"), F.asc_nulls_last("src_project_id"))


@view("Pairs of citing and cited projects", "reuse", "src_project_id; dst_project_id; citing_section_count; sections; docs; total_occurrences", 75, True)
def distinct_reuse_pairs(w: Warehouse) -> DataFrame:
    rows = w.table("reuse_edges").where("confidence_tier = 'declared'")
    rolled = rows.groupBy("src_project_id", "dst_project_id").agg(F.count("*").alias("citing_section_count"), distinct_ids("source_section").alias("sections"), distinct_ids("source_doc").alias("docs"), F.sum("occurrence_count").alias("total_occurrences"))
    return rolled.orderBy(F.asc_nulls_last("src_project_id"), F.asc_nulls_last("dst_project_id"))


@view("Amplification", "reuse", "total_projects; projects_with_declared_citation; amplification_pct", 1, True)
def amplification_rate(w: Warehouse) -> DataFrame:
    # one null source counts once, like any other
    citing = w.table("reuse_edges").where("confidence_tier = 'declared'").select("src_project_id").distinct().agg(F.count("*").alias("projects_with_declared_citation"))
    both = one_row(w.table("projects").agg(F.count("*").alias("total_projects")), citing)
    return both.withColumn("amplification_pct", percent(F.col("projects_with_declared_citation"), F.col("total_projects")))


# people -----------------------------------------------------------------------------------------


@view("Authors by projects", "authors", "canonical_name; orcid_id; project_count; projects", 5, True)
def authors_by_project_count(w: Warehouse) -> DataFrame:
    joined = w.table("authors").join(w.table("project_authors").select("author_id", "project_id"), "author_id")
    return joined.groupBy("canonical_name", "orcid_id").agg(F.count_distinct("project_id").alias("project_count"), distinct_ids().alias("projects")).orderBy(F.desc("project_count"), "canonical_name", F.asc_nulls_last("orcid_id"))


@view("Authors who worked together", "authors", "author_1; author_2; shared_projects; project_ids")
def coauthorship_edges(w: Warehouse) -> DataFrame:
    held = E.memberships(w.table("project_authors"))
    names = w.table("authors").select("author_id", "canonical_name").distinct()
    pairs = held.select("pid", F.col("aid").alias("a")).join(held.select("pid", F.col("aid").alias("b")), "pid").where("a < b")
    named = pairs.join(names.select(F.col("author_id").alias("a"), F.col("canonical_name").alias("author_1")), "a").join(names.select(F.col("author_id").alias("b"), F.col("canonical_name").alias("author_2")), "b")
    return named.groupBy("author_1", "author_2").agg(F.count_distinct("pid").alias("shared_projects"), distinct_ids("pid").alias("project_ids")).orderBy(F.desc("shared_projects"), "author_1", "author_2")


@view("Projects by number of authors", "authors", "n_authors; n_projects; projects", 1)
def projects_by_author_count(w: Warehouse) -> DataFrame:
    each = w.table("project_authors").groupBy("project_id").agg(F.count_distinct("author_id").alias("n_authors"))
    return each.groupBy("n_authors").agg(F.count("*").alias("n_projects"), ids().alias("projects")).orderBy("n_authors")


# documents --------------------------------------------------------------------------------------


@view("Depth of notebook pipelines", "notebooks", "project_id; notebook_count; max_nb_number; total_cells_across_notebooks; total_code_cells; total_markdown_cells; notebooks_with_goal; goal_coverage_pct", 30, True)
def notebook_pipeline_depth(w: Warehouse) -> DataFrame:
    goals = F.count("goal_phrase")
    return w.table("notebooks").groupBy("project_id").agg(
        F.count("*").alias("notebook_count"), F.max("notebook_number").alias("max_nb_number"), F.sum("total_cells").alias("total_cells_across_notebooks"), F.sum("code_cells").alias("total_code_cells"), F.sum("markdown_cells").alias("total_markdown_cells"),
        goals.alias("notebooks_with_goal"), percent(goals, F.count("*")).alias("goal_coverage_pct"),
    ).orderBy(F.desc("notebook_count"), "project_id")


def _real_sections(w: Warehouse) -> DataFrame:
    return w.table("sections").where(~F.col("h2_text").isin(PSEUDO_SECTIONS))


@view("Section titles by document", "structure", "source_doc; h2_text; section_count; mean_byte_size; max_byte_size", 20)
def h2_frequency_by_doc(w: Warehouse) -> DataFrame:
    rolled = _real_sections(w).groupBy("source_doc", "h2_text").agg(F.count("*").alias("section_count"), F.round(F.avg("byte_size"), 0).alias("mean_byte_size"), F.max("byte_size").alias("max_byte_size"))
    return rolled.where("section_count >= 3").orderBy("source_doc", F.desc("section_count"), "h2_text")


@view("Sections of each project", "structure", "project_id; total_sections; readme_sections; plan_sections; report_sections; review_sections; total_section_bytes", 30)
def sections_by_project(w: Warehouse) -> DataFrame:
    of = lambda doc: F.count_if(F.col("source_doc") == doc)
    return _real_sections(w).groupBy("project_id").agg(
        F.count("*").alias("total_sections"), of("README").alias("readme_sections"), of("RESEARCH_PLAN").alias("plan_sections"), of("REPORT").alias("report_sections"), of("REVIEW").alias("review_sections"), F.sum("byte_size").alias("total_section_bytes")
    ).orderBy(F.desc("total_sections"), "project_id")


# science portfolio ------------------------------------------------------------------------------


def top_entities(w: Warehouse, kind: str, limit: int = 50, source: bool = False) -> DataFrame:
    """The most mentioned vocabulary names of a kind; ties go by name."""
    named = w.table("entity_mentions").where((F.col("entity_kind") == kind) & matched(F.col("canonical_id")))
    extra = [F.max("extraction_source").alias("extraction_source")] if source else []
    rolled = named.groupBy("canonical_id").agg(F.count("*").alias("mention_count"), F.count_distinct("project_id").alias("project_count"), distinct_ids().alias("projects"), *extra)
    return rolled.orderBy(F.desc("mention_count"), "canonical_id").limit(limit)


_TOP = "canonical_id; mention_count; project_count; projects"


@view("Most mentioned organisms", "science", _TOP + "; extraction_source", 0, True)
def top_organisms_by_mention(w: Warehouse) -> DataFrame:
    return top_entities(w, "organism", source=True)


@view("Most used methods", "science", _TOP, 0, True)
def top_methods_by_mention(w: Warehouse) -> DataFrame:
    return top_entities(w, "method")


@view("Most cited journals", "science", _TOP)
def top_journals_by_mention(w: Warehouse) -> DataFrame:
    return top_entities(w, "journal")


@view("Most studied functions", "science", _TOP)
def top_functions_by_mention(w: Warehouse) -> DataFrame:
    return top_entities(w, "function")


@view("Most used databases", "science", _TOP, 0, True)
def top_databases_by_mention(w: Warehouse) -> DataFrame:
    return top_entities(w, "database")


@view("Question types", "science", "project_id; domain_label; mode_label; total_evidence", 0, True)
def question_type_portfolio(w: Warehouse) -> DataFrame:
    colon = F.instr("canonical_id", ":")
    votes = (
        w.table("entity_mentions").where("entity_kind = 'question_type' and canonical_id is not null")
        .select("project_id", F.expr("substring(canonical_id, 1, greatest(instr(canonical_id, ':') - 1, 0))").alias("axis"), F.substring("canonical_id", colon + 1, F.length("canonical_id")).alias("label"))
        .groupBy("project_id", "axis", "label").agg(F.count("*").alias("n"))
    )
    # of equally voted labels the first by name
    top = votes.groupBy("project_id", "axis").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.sum("n").alias("votes"))
    of = lambda axis: top.where(F.col("axis") == axis).select("project_id", F.col("label").alias(f"{axis}_label"), F.col("votes").alias(f"{axis}_votes"))
    return of("domain").join(of("mode"), "project_id", "left").withColumn("total_evidence", F.col("domain_votes") + F.coalesce("mode_votes", F.lit(0))).orderBy("project_id")


@view("Conclusions", "science", "project_id; total_conclusions; descriptive; mechanistic; predictive; methodological; negative_result")
def conclusions_per_project(w: Warehouse) -> DataFrame:
    claims = w.table("entity_mentions").where("entity_kind = 'conclusion'").select("project_id", claim_type(F.col("extra_json")).alias("t"))
    return claims.groupBy("project_id").agg(F.count("*").alias("total_conclusions"), *(F.count_if(F.col("t") == t).alias(t) for t in CLAIM_TYPES)).orderBy(F.desc("total_conclusions"), "project_id")


@view("Subjects several projects conclude on", "science", "subject_entity; converging_projects; total_claims; projects", 0, True)
def conclusion_subject_triangulation(w: Warehouse) -> DataFrame:
    subject = F.get_json_object("extra_json", "$.subject_entity")
    claims = w.table("entity_mentions").where("entity_kind = 'conclusion'").select("project_id", subject.alias("subject_entity")).where("subject_entity <> ''")
    rolled = claims.groupBy("subject_entity").agg(F.count_distinct("project_id").alias("converging_projects"), F.count("*").alias("total_claims"), distinct_ids().alias("projects"))
    return rolled.where("converging_projects >= 2").orderBy(F.desc("converging_projects"), F.desc("total_claims"), "subject_entity").limit(50)


@view("Names awaiting review", "science", "entity_kind; surface_form; occurrence_count; project_count; llm_proposed_canonical")
def drift_candidates_summary(w: Warehouse) -> DataFrame:
    rolled = w.table("drift_candidates").where(~F.col("entity_kind").isin(FAILURES)).groupBy("entity_kind", "surface_form").agg(F.count("*").alias("occurrence_count"), F.count_distinct("project_id").alias("project_count"), F.max("llm_proposed_canonical").alias("llm_proposed_canonical"))
    return rolled.where("occurrence_count >= 2").orderBy(F.desc("occurrence_count"), "entity_kind", F.asc_nulls_last("surface_form")).limit(100)


@view("Sections that could not be read", "science", "source_doc; source_section; failure_count; affected_projects; sample_error")
def extraction_errors_by_section(w: Warehouse) -> DataFrame:
    failed = w.table("drift_candidates").where(F.col("entity_kind").isin(FAILURES))
    return failed.groupBy("source_doc", "source_section").agg(F.count("*").alias("failure_count"), F.count_distinct("project_id").alias("affected_projects"), F.max("llm_notes").alias("sample_error")).orderBy(F.desc("failure_count"), F.asc_nulls_last("source_doc"), F.asc_nulls_last("source_section"))


# scores and lines -------------------------------------------------------------------------------


@view("Scores against revisions", "lifecycle", "project_id; revision_depth; depth_score; breadth_score; influence_score; integration_score; start_date; completion_date; completion_month; too_early; partial_phase_2b", 30, True)
def sophistication_vs_revisions(w: Warehouse) -> DataFrame:
    p = w.table("projects").where("revision_depth is not null").select("project_id", "revision_depth", "start_date", "completion_date", month(F.col("completion_date")).alias("completion_month"))
    s = w.table("sophistication_composite").where("depth_score is not null").drop("start_date", "completion_date")
    return p.join(s, "project_id").orderBy(F.asc_nulls_last("completion_date"), "project_id")


@view("Raw ingredients of the scores", "lifecycle", "project_id; revision_count; notebook_count; canonical_doc_bytes; days_active; conclusion_count; distinct_organism_count; distinct_method_count; distinct_database_count; in_degree: all citing projects; out_degree: all cited projects", 30)
def sophistication_ingredients(w: Warehouse) -> DataFrame:
    kind = lambda k: F.count_distinct(F.when(F.col("entity_kind") == k, F.col("canonical_id"))).alias(f"distinct_{k}_count")
    size = w.table("sections").groupBy("project_id").agg(F.sum("byte_size").alias("canonical_doc_bytes"))
    named = w.table("entity_mentions").groupBy("project_id").agg(F.count_if(F.col("entity_kind") == "conclusion").alias("conclusion_count"), kind("organism"), kind("method"), kind("database"))
    cited = E.declared(w.table("reuse_edges"))
    inward = cited.where("src is not null").groupBy(F.col("dst").alias("project_id")).agg(F.count("*").alias("in_degree"))
    outward = cited.where("dst is not null").groupBy(F.col("src").alias("project_id")).agg(F.count("*").alias("out_degree"))
    out = w.table("projects").select("project_id", F.col("revision_depth").alias("revision_count"), "notebook_count", days_between(F.col("start_date"), F.col("completion_date")).alias("days_active"))
    for part in (size, named, inward, outward):
        out = out.join(part, "project_id", "left")
    return out.select("project_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "project_id")).orderBy("project_id")


@view("Scores on five axes", "lifecycle", "project_id; depth_score; breadth_score; influence_score; integration_score; self_follow_on_score; too_early; partial_phase_2b", 0, True)
def sophistication_composite(w: Warehouse) -> DataFrame:
    return w.table("sophistication_composite").orderBy(F.desc_nulls_last("depth_score"), "project_id")


@view("Research lines", "lifecycle", "line_id; line_name; member_count; distinct_author_count; cross_author_handoffs; self_iterations; citation_edge_count; topic_edge_count; sub_cluster_count; earliest_start; latest_completion; depth_mean; breadth_mean; influence_mean; integration_mean; self_follow_on_mean; total_revisions; total_conclusions; total_notebooks; member_ids; distinct_author_ids")
def research_lines(w: Warehouse) -> DataFrame:
    return w.table("research_lines").orderBy(F.desc("member_count"), F.asc_nulls_last("earliest_start"), "line_id")


@view("Threads of research lines", "lifecycle", "sub_id; line_id; sub_index; member_count; member_ids; top_organisms; top_methods; top_databases")
def research_line_subclusters(w: Warehouse) -> DataFrame:
    return w.table("research_line_subclusters").orderBy("line_id", "sub_index")


# classified by a model --------------------------------------------------------------------------


@view("Kinds of citation", "lifecycle", "edge_id; src_project_id; dst_project_id; edge_type; confidence; rationale; source_quote")
def edge_classifications(w: Warehouse) -> DataFrame:
    return w.table("edge_classifications").orderBy(F.asc_nulls_last("edge_type"), F.desc_nulls_last("confidence"), "edge_id")


@view("Kinds of revision", "lifecycle", "revision_id; project_id; kind; confidence; rationale")
def revision_kinds(w: Warehouse) -> DataFrame:
    return w.table("revision_kinds").orderBy(F.asc_nulls_last("kind"), F.desc_nulls_last("confidence"), "revision_id")


@view("Plausible combinations", "science", "a_kind; a_canonical; b_kind; b_canonical; plausibility; rationale")
def combination_plausibility(w: Warehouse) -> DataFrame:
    return w.table("combination_plausibility").orderBy(F.desc_nulls_last("plausibility"), "a_canonical", "b_canonical")


@view("Findings", "science", "finding_index; claim; so_what; confidence; evidence_json; prompt_version; model_id; observed_at", 0, True)
def findings(w: Warehouse) -> DataFrame:
    return w.table("findings").orderBy("finding_index")


@view("Recommendations", "science", "rec_index; title; rationale; priority; gap_type; evidence_json; estimated_effort; plausibility; prompt_version; model_id; observed_at", 0, True)
def recommendations(w: Warehouse) -> DataFrame:
    return w.table("recommendations").orderBy("rec_index")


def summary_json(results: list[ViewResult]) -> str:
    ok = [r for r in results if not r.error]
    body = {
        "views_total": len(results), "views_ok": len(ok), "views_failed": len(results) - len(ok), "sanity_warnings": sum(not r.sane for r in ok),
        "views": [{"name": r.view.name, "title": r.view.title, "category": r.view.category, "rows": r.row_count, "sanity_passed": r.sane, "expected_min_rows": r.view.min_rows, "is_headline": r.view.headline, "error": r.error} for r in results],
    }
    return json.dumps(body, indent=2)
