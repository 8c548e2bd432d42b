"""The panels of the report as DataFrames; a list that a panel nests is a row of its own here or an
array of structs. JSON is made at the edge only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import claim_type, days_between, display_name, jitter, matched, month
from quillon.operators import edges as E
from quillon.operators import graph as G
from quillon.operators import intervals
from quillon.operators.pairs import cooccurrence, held, underexplored_gaps
from quillon.operators.ranking import first_k
from quillon.plans.derived import current_projects
from quillon.plans.views import BUCKETS, depth_bucket, distinct_ids, ids, one_row
from quillon.sources.warehouse import Warehouse

# fixed values: the axes of the question grid
DOMAINS = ["biochemistry-metabolism", "physiology-phenotype", "ecology-environment", "evolution-comparative-genomics", "biotechnology-application", "methodology-tools"]
MODES = ["discovery", "characterization", "mechanism", "prediction", "synthesis"]
POSITIVE = ["mechanistic", "predictive"]
NEGATIVE = ["negative_result"]


def _declared(w: Warehouse) -> DataFrame:
    return E.declared(w.table("reuse_edges"))


def _authors(w: Warehouse) -> DataFrame:
    return E.memberships(w.table("project_authors"))


def _people(w: Warehouse) -> DataFrame:
    """One name and iD for each author id, the least of its rows."""
    return w.table("authors").groupBy(F.col("author_id").alias("aid")).agg(F.min(F.struct("canonical_name", "orcid_id")).alias("p")).select("aid", "p.canonical_name", "p.orcid_id")


def _conclusions(w: Warehouse) -> DataFrame:
    return w.table("entity_mentions").where("entity_kind = 'conclusion'")


def _dated(w: Warehouse) -> DataFrame:
    """(project_id, day): the last sign of work, of projects that have one."""
    return current_projects(w).select("project_id", F.coalesce("effective_completion_date", "completion_date").alias("day")).where("day is not null")


def summary(w: Warehouse) -> DataFrame:
    return one_row(
        w.table("projects").agg(F.count("*").alias("projects"), F.min("start_date").alias("earliest"), F.max("completion_date").alias("latest")),
        w.table("authors").agg(F.count_distinct("author_id").alias("authors"), F.count_distinct("orcid_id").alias("orcids")),
        w.table("notebooks").agg(F.count("*").alias("notebooks")),
        _declared(w).agg(F.count("*").alias("reuse_pairs")),
        w.table("entity_mentions").agg(F.count("*").alias("mentions")),
    )


def completion_timeline(w: Warehouse) -> DataFrame:
    """By day, so the running total runs over days rather than over all projects."""
    days = w.table("projects").where("completion_date is not null").groupBy("completion_date").agg(F.count("*").alias("completed"), ids().alias("project_ids"))
    return days.withColumn("cumulative", F.sum("completed").over(Window.orderBy("completion_date")))


def top_cited(w: Warehouse, limit: int = 10) -> DataFrame:
    """By the strict reading, with a preview of three downstream authors."""
    authors = _authors(w)
    classified = E.classify_edges(_declared(w), authors)
    cited = classified.where("dst is not null").groupBy(F.col("dst").alias("pid")).agg(F.count("src").alias("in_degree"), F.count_if("strict").alias("cross_in_degree")).orderBy(F.desc("in_degree"), "pid").limit(limit)
    people = classified.where("strict").select(F.col("dst").alias("pid"), F.col("src").alias("other")).join(authors.withColumnRenamed("pid", "other"), "other").groupBy("pid").agg(distinct_ids("aid").alias("people"))
    out = cited.join(people, "pid", "left").withColumn("people", F.coalesce("people", F.expr("cast(array() as array<string>)")))
    return out.select(F.col("pid").alias("project_id"), "in_degree", "cross_in_degree", F.size("people").cast("long").alias("distinct_downstream_authors"), F.slice("people", 1, 3).alias("downstream_author_preview"))


def _line_members(w: Warehouse) -> DataFrame:
    """(line_id, line_name, member_count, project_id); a line bears the name of its first member."""
    held = w.table("line_members")
    size = held.groupBy("line_id").agg(F.count("*").alias("member_count"))
    return held.join(size, "line_id").select("line_id", F.substring("line_id", len("line-") + 1, 1 << 30).alias("line_name"), "member_count", "project_id")


def top_authors(w: Warehouse, limit: int = 10) -> DataFrame:
    """(author_id, canonical_name, orcid_id, project_count, line_id, member_count, role): a row for each
    line that an author of the leaderboard is in, one without line if none."""
    authors = _authors(w)
    counted = authors.groupBy("aid").agg(F.count("*").alias("project_count")).join(_people(w), "aid").orderBy(F.desc("project_count"), "aid").limit(limit)
    inside = authors.join(_line_members(w).withColumnRenamed("project_id", "pid"), "pid").join(counted.select("aid"), "aid", "left_semi")
    roles = inside.groupBy("aid", "line_id", "member_count").agg(F.when(F.max(F.col("pid") == F.col("line_name")), "founder").otherwise("participant").alias("role"))
    return counted.join(roles, "aid", "left").select(F.col("aid").alias("author_id"), "canonical_name", "orcid_id", "project_count", "line_id", "member_count", "role")


def depth_distribution(w: Warehouse) -> DataFrame:
    return w.table("projects").groupBy(depth_bucket().alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")))


def reuse_nodes(w: Warehouse) -> DataFrame:
    edges = _declared(w)
    inward = edges.groupBy(F.col("dst").alias("project_id")).agg(F.count("src").alias("in_degree"))
    outward = edges.groupBy(F.col("src").alias("project_id")).agg(F.count("dst").alias("out_degree"))
    out = current_projects(w).select("project_id").join(inward, "project_id", "left").join(outward, "project_id", "left")
    return out.select("project_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")))


def reuse_links(w: Warehouse) -> DataFrame:
    return _declared(w)


def sophistication(w: Warehouse) -> DataFrame:
    return w.table("sophistication_composite").select(
        "project_id", *(F.col(f"{a}_score").alias(a) for a in ("depth", "breadth", "influence", "integration", "self_follow_on")), "too_early", "partial_phase_2b", F.col("revision_count").alias("revisions"), F.col("notebook_count").alias("notebooks"),
        F.col("canonical_doc_bytes").alias("bytes"), F.col("conclusion_count").alias("conclusions"), "in_degree", "out_degree", F.col("self_in_degree").alias("self_in"), F.col("self_out_degree").alias("self_out"),
    )


def line_handoffs(w: Warehouse) -> DataFrame:
    """(line_id, src, dst, src_authors, dst_authors) of the strict edges within a line."""
    authors = _authors(w)
    strict = E.classify_edges(_declared(w), authors).where("strict").select("src", "dst")
    member = _line_members(w).select("line_id", "project_id")
    inside = strict.join(member.withColumnRenamed("project_id", "src"), "src").join(member.select(F.col("line_id").alias("line_b"), F.col("project_id").alias("dst")), "dst").where("line_id = line_b")
    who = authors.groupBy("pid").agg(distinct_ids("aid").alias("people"))
    return inside.join(who.select(F.col("pid").alias("src"), F.col("people").alias("src_authors")), "src").join(who.select(F.col("pid").alias("dst"), F.col("people").alias("dst_authors")), "dst").select("line_id", "src", "dst", "src_authors", "dst_authors")


def _lines_alone(w: Warehouse) -> DataFrame:
    """The lines for readers that don't need the number of threads."""
    return w.table("lines_alone" if "lines_alone" in w.derived and not w.has("research_lines") else "research_lines")


def research_lines(w: Warehouse) -> DataFrame:
    return _parsed_lines(w.table("research_lines"))


def lines_alone(w: Warehouse) -> DataFrame:
    return _parsed_lines(_lines_alone(w))


def _parsed_lines(df: DataFrame) -> DataFrame:
    parsed = df.withColumns({"members": F.from_json("member_ids", "array<string>"), "author_ids": F.from_json("distinct_author_ids", "array<string>")})
    return parsed.where("size(members) > 0").drop("member_ids", "distinct_author_ids")


def line_threads(w: Warehouse) -> DataFrame:
    return w.table("research_line_subclusters").withColumn("members", F.from_json("member_ids", "array<string>")).drop("member_ids")


def top_names(w: Warehouse, kind: str, limit: int = 15) -> DataFrame:
    named = w.table("entity_mentions").where((F.col("entity_kind") == kind) & matched(F.col("canonical_id")))
    return named.groupBy("canonical_id").agg(F.count("*").alias("mentions"), F.count_distinct("project_id").alias("projects")).orderBy(F.desc("mentions"), "canonical_id").limit(limit)


def database_matrix(w: Warehouse) -> DataFrame:
    """(project_id, database, n, project_total, database_total): the filled cells with the sums that
    order both axes. Empty cells are filled where the matrix is drawn, not stored."""
    cells = w.table("entity_mentions").where((F.col("entity_kind") == "database") & matched(F.col("canonical_id"))).groupBy("project_id", F.col("canonical_id").alias("database")).agg(F.count("*").alias("n"))
    return cells.join(cells.groupBy("project_id").agg(F.sum("n").alias("project_total")), "project_id").join(cells.groupBy("database").agg(F.sum("n").alias("database_total")), "database")


def question_grid(w: Warehouse) -> DataFrame:
    """(domain, mode, projects) for all 30 cells: projects with both labels."""
    said = w.table("entity_mentions").where("entity_kind = 'question_type'").select("project_id", F.get_json_object("extra_json", "$.axis").alias("axis"), F.substring("canonical_id", F.instr("canonical_id", ":") + 1, F.length("canonical_id")).alias("label"))
    d = said.where("axis = 'domain'").select("project_id", F.col("label").alias("domain")).distinct()
    m = said.where("axis = 'mode'").select("project_id", F.col("label").alias("mode")).distinct()
    counts = d.join(m, "project_id").groupBy("domain", "mode").agg(F.count("*").alias("n"))
    grid = w.spark.createDataFrame([(x, y) for x in DOMAINS for y in MODES], "domain string, mode string")
    return grid.join(counts, ["domain", "mode"], "left").select("domain", "mode", F.coalesce("n", F.lit(0)).alias("projects"))


def question_pairs(w: Warehouse) -> DataFrame:
    """(domain, mode, projects) of whatever labels occur."""
    said = w.table("entity_mentions").where("entity_kind = 'question_type'").select("project_id", F.substring_index("canonical_id", ":", 1).alias("axis"), F.substring("canonical_id", F.instr("canonical_id", ":") + 1, F.length("canonical_id")).alias("label")).distinct()
    d = said.where("axis = 'domain'").select("project_id", F.col("label").alias("domain"))
    m = said.where("axis = 'mode'").select("project_id", F.col("label").alias("mode"))
    return d.join(m, "project_id").groupBy("domain", "mode").agg(F.count("*").alias("projects"))


def discoveries_timeline(w: Warehouse) -> DataFrame:
    per = _conclusions(w).join(_dated(w), "project_id").groupBy(month(F.col("day")).alias("month"), F.coalesce(claim_type(F.col("extra_json")), F.lit("unclassified")).alias("claim_type")).agg(F.count("*").alias("n"))
    return per.select("month", "claim_type", F.sum("n").over(Window.partitionBy("claim_type").orderBy("month")).alias("cumulative"))


def topic_trends(w: Warehouse, kind: str = "organism", top: int = 10) -> DataFrame:
    best = top_names(w, kind, top).select("canonical_id")
    per = w.table("entity_mentions").where(F.col("entity_kind") == kind).join(best, "canonical_id", "left_semi").join(_dated(w), "project_id").groupBy("canonical_id", month(F.col("day")).alias("month")).agg(F.count("*").alias("n"))
    return per.select("canonical_id", "month", F.sum("n").over(Window.partitionBy("canonical_id").orderBy("month")).alias("cumulative"))


def claims_by_month(w: Warehouse, cap: int = 20) -> DataFrame:
    """Up to ``cap`` claims of each project in each month and type: a sample for reading."""
    rows = _conclusions(w).join(_dated(w), "project_id").select(
        month(F.col("day")).alias("month"), F.coalesce(claim_type(F.col("extra_json")), F.lit("unclassified")).alias("claim_type"), "project_id", "mention_id", "source_doc", "source_section",
        F.substring(F.coalesce("surface_form", F.lit("")), 1, 300).alias("claim_text"), F.substring(F.coalesce("source_quote", F.lit("")), 1, 400).alias("source_quote"),
    ).distinct()
    return first_k(rows, ["month", "claim_type", "project_id"], [F.asc("mention_id")], cap)


def dark_matter(w: Warehouse, limit: int = 30, kinds: tuple[str, ...] = ("organism", "method", "database")) -> DataFrame:
    """Vocabulary names mentioned once."""
    named = w.table("entity_mentions").where(F.col("entity_kind").isin(*kinds) & matched(F.col("canonical_id")))
    once = named.groupBy("canonical_id", "entity_kind").agg(F.count("*").alias("n"), F.min(F.struct("project_id", "source_doc", "source_section")).alias("at")).where("n = 1")
    return once.select("canonical_id", "entity_kind", "at.project_id", "at.source_doc", "at.source_section").orderBy("entity_kind", "canonical_id").limit(limit)


def gantt(w: Warehouse, top: int = 10) -> DataFrame:
    """(author_id, project_id, start, end, sub_row) of the authors with most projects."""
    authors = _authors(w)
    best = authors.groupBy("aid").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "aid").limit(top).select("aid")
    bars = authors.join(best, "aid", "left_semi").join(current_projects(w).where("start_date is not null"), F.col("pid") == F.col("project_id"))
    spans = bars.select(F.col("aid").alias("author_id"), "project_id", F.col("start_date").alias("start"), F.coalesce("effective_completion_date", "completion_date", "start_date").alias("end"))
    return intervals.sub_rows(spans, "author_id", "project_id")


def gantt_bars(w: Warehouse) -> DataFrame:
    """The bars with the number of others in their row that they touch."""
    placed = gantt(w)
    other = placed.select("author_id", "sub_row", F.col("project_id").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = placed.join(other, ["author_id", "sub_row"], "left").where("p <> project_id and s <= end and e >= start").groupBy("author_id", "project_id").agg(F.count("*").cast("int").alias("clashes"))
    return placed.join(met, ["author_id", "project_id"], "left").select("author_id", "project_id", "start", "end", F.coalesce("clashes", F.lit(0)).alias("clashes"))


def ring(w: Warehouse) -> DataFrame:
    return G.ring_layout(current_projects(w), "project_id")


def gantt_blocks(w: Warehouse) -> DataFrame:
    return intervals.row_blocks(gantt(w), "author_id")


def underexplored(w: Warehouse) -> DataFrame:
    return underexplored_gaps(w.table("entity_mentions"))


def thread_links(w: Warehouse) -> DataFrame:
    """(a, b, weight): citations between different threads, in either direction."""
    if "thread_members" in w.derived and not w.has("research_line_subclusters"):
        parts = w.table("thread_members")
        sized = parts.groupBy("line_id", "community").agg(F.count("*").alias("k")).where("k >= 2").select("line_id", "community")
        at = parts.join(sized, ["line_id", "community"]).select(F.concat("line_id", F.lit("#sub-"), "community").alias("sub_id"), F.col("member").alias("pid"))
    else:
        at = line_threads(w).select("sub_id", F.explode("members").alias("pid"))
    pairs = _declared(w).join(at.select(F.col("pid").alias("src"), F.col("sub_id").alias("x")), "src").join(at.select(F.col("pid").alias("dst"), F.col("sub_id").alias("y")), "dst").where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight"))


def topic_neighbourhoods(w: Warehouse, least: int = 2) -> DataFrame:
    """(neighbourhood, node, members): communities of three or more entities that occur together."""
    pairs = cooccurrence(w.table("entity_mentions"), ("organism", "method", "database"), least)
    labels = G.components(pairs, "a", "b")
    edges = pairs.join(labels.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "weight")
    found = G.communities(edges, "component")
    sized = found.groupBy("component", "community").agg(F.count("*").alias("members"))
    return found.join(sized, ["component", "community"]).where("members >= 3").select(F.concat_ws("#", "component", "community").alias("neighbourhood"), F.col("member").alias("node"), "members")


def author_links(w: Warehouse) -> DataFrame:
    """(a, b, weight): each strict edge adds 1 for each author of the one end and of the other."""
    authors = _authors(w)
    strict = E.classify_edges(_declared(w), authors).where("strict").select("src", "dst")
    both = strict.join(authors.select(F.col("pid").alias("src"), F.col("aid").alias("x")), "src").join(authors.select(F.col("pid").alias("dst"), F.col("aid").alias("y")), "dst")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight"))


def author_nodes(w: Warehouse) -> DataFrame:
    """Authors with a link or with two projects or more."""
    authors = _authors(w)
    counted = authors.groupBy("aid").agg(F.count("*").alias("projects"))
    linked = author_links(w)
    ends = linked.select(F.col("a").alias("aid")).unionAll(linked.select("b")).distinct().withColumn("linked", F.lit(True))
    out = counted.join(ends, "aid", "left").where("linked or projects >= 2").join(_people(w), "aid")
    return out.select(F.col("aid").alias("author_id"), display_name(F.col("canonical_name")).alias("display_name"), "projects", F.coalesce("linked", F.lit(False)).alias("linked"))


def edge_types(w: Warehouse) -> DataFrame:
    return w.table("edge_classifications").groupBy("edge_type").agg(F.count("*").alias("count"), F.avg("confidence").alias("avg_confidence"))


def edge_type_samples(w: Warehouse, k: int = 10) -> DataFrame:
    return first_k(w.table("edge_classifications").select("edge_type", "edge_id", "src_project_id", "dst_project_id", "confidence"), ["edge_type"], [F.desc_nulls_last("confidence"), F.asc("edge_id")], k)


def revision_kind_counts(w: Warehouse) -> DataFrame:
    return w.table("revision_kinds").groupBy("kind").agg(F.count("*").alias("count"), F.avg("confidence").alias("avg_confidence"))


def revision_kind_trend(w: Warehouse) -> DataFrame:
    """(month, kind, count, share): share of the month's revisions."""
    per = w.table("revision_kinds").join(w.table("project_revisions").select("revision_id", "version_date"), "revision_id").where("version_date is not null").groupBy(month(F.col("version_date")).alias("month"), "kind").agg(F.count("*").alias("count"))
    return per.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("month")))


def plausible(w: Warehouse) -> DataFrame:
    return w.table("combination_plausibility").select("a_kind", "a_canonical", "b_kind", "b_canonical", F.coalesce("plausibility", F.lit(0.0)).alias("plausibility"), F.coalesce("rationale", F.lit("")).alias("rationale"))


def findings(w: Warehouse) -> DataFrame:
    f = w.table("findings")
    detail = F.coalesce(F.col("so_what_detail"), F.lit("")) if "so_what_detail" in f.columns else F.lit("")
    return f.select("finding_index", "claim", F.coalesce("so_what", F.lit("watch_for_change")).alias("so_what"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), detail.alias("so_what_detail"))


def recommendations(w: Warehouse) -> DataFrame:
    return w.table("recommendations").select("rec_index", "title", F.coalesce("priority", F.lit("medium")).alias("priority"), F.coalesce("gap_type", F.lit("other")).alias("gap_type"), F.coalesce("estimated_effort", F.lit("medium")).alias("estimated_effort"), F.coalesce("plausibility", F.lit(0.0)).alias("plausibility"))


def cohort_means(w: Warehouse, least: int = 3) -> DataFrame:
    scored = current_projects(w).where("completion_date is not null").join(w.table("sophistication_composite").select("project_id", "depth_score", "too_early"), "project_id").where("not too_early")
    return scored.groupBy(month(F.col("completion_date")).alias("month")).agg(F.avg("depth_score").alias("mean_depth"), F.count("*").alias("n")).where(F.col("n") >= least).select("month", "mean_depth")


def cohort_slope(w: Warehouse) -> DataFrame:
    """(cohorts, slope): the trend of the months' mean depth over their order; null under two months."""
    x = F.row_number().over(Window.orderBy("month")) - 1
    fit = cohort_means(w).select("mean_depth", x.cast("double").alias("x")).agg(F.count("*").alias("cohorts"), F.regr_slope("mean_depth", "x").alias("slope"))
    return fit.select("cohorts", F.when(F.col("cohorts") >= 2, F.col("slope")).alias("slope"))


def cohort_trends(w: Warehouse, least: int = 3) -> DataFrame:
    """Within each month the trend of depth over revisions, where revisions differ."""
    p = current_projects(w).where("completion_date is not null and revision_depth is not null").select("project_id", "revision_depth", month(F.col("completion_date")).alias("month"))
    s = w.table("sophistication_composite").where("depth_score is not null").select("project_id", "depth_score")
    x = F.col("revision_depth").cast("double")
    fit = p.join(s, "project_id").groupBy("month").agg(F.count("*").alias("n"), F.regr_slope("depth_score", x).alias("slope"), F.regr_intercept("depth_score", x).alias("intercept"), F.var_pop(x).alias("spread"))
    return fit.where((F.col("n") >= least) & (F.col("spread") > 0)).select("month", "n", "slope", "intercept")


def metrics_to_watch(w: Warehouse) -> DataFrame:
    """(metric, value): the numbers behind the twelve indicators, one row each."""
    def row(name: str, df: DataFrame, value) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    s = w.table("sophistication_composite")
    scored = s.where("not too_early")
    p = current_projects(w)
    share = lambda cond: F.lit(100.0) * F.count_if(cond) / F.nullif(F.count("*"), F.lit(0))
    both = scored.select("project_id", "depth_score", "breadth_score").join(p.where("revision_depth >= 1").select("project_id", "revision_depth"), "project_id")
    pairs = held(w.table("entity_mentions"), ("database",))
    combos = pairs.select("pid", F.col("name").alias("a")).join(pairs.select("pid", F.col("name").alias("b")), "pid").where("a < b").select("a", "b").distinct()
    drift = w.table("drift_candidates").where("llm_decision = 'proposed'").select("entity_kind", "surface_form").distinct()
    refs = w.table("sections").where("source_doc = 'references_md'").select("project_id").distinct()
    parts = [
        # of computed lines the members tell the number
        row("01 research lines", w.table("research_lines") if w.has("research_lines") else w.table("line_members").select("line_id").distinct(), F.count("*")),
        row("01 projects in lines", _line_members(w).select("project_id").distinct(), F.count("*")),
        row("02 authors", w.table("authors").select("author_id").distinct(), F.count("*")),
        row("03 depth of 1 sigma, %", scored, share(F.col("depth_score") >= 1)),
        row("04 depth and breadth for each revision", both, (F.avg(F.coalesce("depth_score", F.lit(0.0)) + F.coalesce("breadth_score", F.lit(0.0))) / 2) / F.nullif(F.avg("revision_depth"), F.lit(0.0))),
        row("05 self follow-on of 1 sigma, %", scored, share(F.col("self_follow_on_score") >= 1)),
        row("06 projects with references", refs, F.count("*")),
        row("06 pairs of citation", _declared(w), F.count("*")),
        row("07 cited from outside, %", scored, share(F.col("in_degree") >= 1)),
        row("07 mean downstream authors", scored.where("cross_author_downstream > 0"), F.avg("cross_author_downstream")),
        row("08 exploratory citations, %", w.table("edge_classifications"), share(F.col("edge_type").isin("deepening", "branching"))),
        cohort_slope(w).select(F.lit("09 cohort slope").alias("metric"), F.col("slope").alias("value")),
        row("10 databases used", pairs.select("name").distinct(), F.count("*")),
        row("11 pairs of databases", combos, F.count("*")),
        row("12 names pending", drift, F.count("*")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def rate_by_month(w: Warehouse, types: list[str]) -> DataFrame:
    rows = _conclusions(w).join(_dated(w), "project_id").select(month(F.col("day")).alias("month"), claim_type(F.col("extra_json")).isin(types).alias("hit"))
    return rows.groupBy("month").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total")).withColumn("rate", F.round(F.col("hits") / F.col("total"), 4))


def rate_by_project(w: Warehouse, types: list[str]) -> DataFrame:
    rows = _conclusions(w).select("project_id", claim_type(F.col("extra_json")).isin(types).alias("hit"))
    return rows.groupBy("project_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total")).withColumn("rate", F.round(F.col("hits") / F.col("total"), 4))


def rate_samples(w: Warehouse, types: list[str], k: int = 10) -> DataFrame:
    rows = _conclusions(w).where(claim_type(F.col("extra_json")).isin(types)).select("project_id", "mention_id", F.substring(F.coalesce("surface_form", F.lit("")), 1, 300).alias("text"), F.coalesce("source_section", F.lit("")).alias("source_section")).distinct()
    return first_k(rows, ["project_id"], [F.asc("mention_id")], k)


def _with_authors(w: Warehouse, df: DataFrame) -> DataFrame:
    who = _authors(w).join(_people(w), "aid").groupBy(F.col("pid").alias("project_id")).agg(distinct_ids("canonical_name").alias("author_names"))
    return df.join(who, "project_id", "left").withColumn("author_names", F.coalesce("author_names", F.expr("cast(array() as array<string>)")))


def untracked_projects(w: Warehouse) -> DataFrame:
    """Projects with conclusions and no date at all: no trend shows them."""
    n = _conclusions(w).groupBy("project_id").agg(F.count("*").alias("conclusion_count"))
    undated = current_projects(w).where("completion_date is null and effective_completion_date is null").select("project_id", "total_bytes", "file_count")
    return _with_authors(w, undated.join(n, "project_id"))


def stuck(w: Warehouse, as_of: str, days: int = 30) -> DataFrame:
    """Projects whose last revision is ``days`` or more before the day ``as_of``."""
    last = w.table("project_revisions").groupBy("project_id").agg(F.max("version_date").alias("last_revision_date"))
    return _with_authors(w, last.withColumn("days_since", days_between(F.col("last_revision_date"), F.lit(as_of).cast("date"))).where(F.col("days_since") >= days))


def reach(w: Warehouse) -> DataFrame:
    s = w.table("sophistication_composite").select("project_id", "in_degree", F.col("two_hop_in_degree").alias("two_hop"), F.col("cross_author_downstream").alias("downstream_authors"))
    return s.withColumns({"jitter_x": jitter(F.col("project_id"), "x"), "jitter_y": jitter(F.col("project_id"), "y")})


def weekly_pulse(w: Warehouse) -> DataFrame:
    week = lambda c: F.date_trunc("week", c).cast("date")
    p, r = current_projects(w), w.table("project_revisions").where("version_date is not null")
    spine = r.select(week("version_date").alias("week")).union(_dated(w).select(week("day"))).distinct()
    starts = p.where("start_date is not null").groupBy(week("start_date").alias("week")).agg(F.count("*").alias("starts"))
    revs = r.groupBy(week("version_date").alias("week")).agg(F.count("*").alias("revisions"))
    concl = _conclusions(w).join(_dated(w), "project_id").groupBy(week("day").alias("week")).agg(F.count("*").alias("conclusions"))
    out = spine.join(starts, "week", "left").join(revs, "week", "left").join(concl, "week", "left")
    return out.select("week", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("starts", "revisions", "conclusions")))


def project_details(w: Warehouse) -> DataFrame:
    """Neighbours and their authors, by strict and by other edges; edges without authors are with the others."""
    authors = _authors(w)
    e = E.classify_edges(_declared(w), authors)
    lists = lambda end, other, pre: e.groupBy(F.col(end).alias("project_id")).agg(distinct_ids_if(other, "strict").alias(f"cross_{pre}"), distinct_ids_if(other, "own").alias(f"self_{pre}"))
    people = lambda inward, name: e.where("strict").select(F.col("dst" if inward else "src").alias("project_id"), F.col("src" if inward else "dst").alias("pid")).join(authors, "pid").groupBy("project_id").agg(distinct_ids("aid").alias(name))
    out = current_projects(w).select("project_id", "start_date", "completion_date", "revision_depth", "notebook_count")
    for part in (lists("dst", "src", "cited_by"), lists("src", "dst", "cites"), people(True, "downstream_authors"), people(False, "upstream_authors"), authors.groupBy(F.col("pid").alias("project_id")).agg(distinct_ids("aid").alias("authors"))):
        out = out.join(part, "project_id", "left")
    arrays = [c for c, t in out.dtypes if t.startswith("array")]
    return out.select(*(c for c in out.columns if c not in arrays), *(F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c) for c in arrays))


def distinct_ids_if(column: str, flag: str):
    return F.sort_array(F.collect_set(F.when(F.col(flag), F.col(column))))


def entity_details(w: Warehouse, k: int = 20) -> DataFrame:
    """For each vocabulary name: kind (the first by name), mentions, projects, authors and up to ``k`` sections."""
    named = w.table("entity_mentions").where(matched(F.col("canonical_id")) & F.col("entity_kind").isin("organism", "method", "database", "journal", "function"))
    base = named.groupBy("canonical_id").agg(F.min("entity_kind").alias("entity_kind"), F.count("*").alias("mentions"), F.count_distinct("project_id").alias("projects"))
    where = first_k(named.select("canonical_id", "project_id", "source_doc", "source_section").distinct(), ["canonical_id"], [F.asc_nulls_last("project_id"), F.asc_nulls_last("source_doc"), F.asc_nulls_last("source_section")], k)
    place = F.struct(F.col("project_id").isNull().alias("a"), "project_id", F.col("source_doc").isNull().alias("b"), "source_doc", F.col("source_section").isNull().alias("c"), "source_section")
    listed = where.groupBy("canonical_id").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: F.concat_ws(" / ", x["project_id"], x["source_doc"], x["source_section"])).alias("sections"))
    who = named.select("canonical_id", F.col("project_id").alias("pid")).distinct().join(_authors(w), "pid").groupBy("canonical_id").agg(F.count_distinct("aid").alias("authors"))
    return base.join(listed, "canonical_id", "left").join(who, "canonical_id", "left").withColumn("authors", F.coalesce("authors", F.lit(0)))


def author_details(w: Warehouse) -> DataFrame:
    """For each author: projects, kinds of entity mentioned in them with their number, lines they are in."""
    authors = _authors(w)
    n = authors.groupBy("aid").agg(F.count("*").alias("projects"))
    kinds = authors.join(w.table("entity_mentions").groupBy(F.col("project_id").alias("pid"), "entity_kind").agg(F.count("*").alias("n")), "pid").groupBy("aid", "entity_kind").agg(F.sum("n").alias("n")).groupBy("aid").agg(F.sum("n").alias("mentions"), F.transform(F.sort_array(F.collect_list(F.struct("entity_kind", "n"))), lambda x: F.concat(x["entity_kind"], F.lit(": "), x["n"].cast("string"))).alias("kinds"))
    inside = authors.join(_line_members(w).select(F.col("project_id").alias("pid"), "line_id"), "pid").groupBy("aid").agg(distinct_ids("line_id").alias("lines"), F.count_distinct("pid").alias("projects_in_lines"))
    out = n.join(_people(w), "aid", "left").join(kinds, "aid", "left").join(inside, "aid", "left")
    return out.select(
        F.col("aid").alias("author_id"), display_name(F.col("canonical_name")).alias("display_name"), "projects", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("kinds", F.expr("cast(array() as array<string>)")).alias("kinds"), F.coalesce("lines", F.expr("cast(array() as array<string>)")).alias("lines"),
        (F.col("projects") - F.coalesce("projects_in_lines", F.lit(0))).alias("projects_outside_lines"),
    )
