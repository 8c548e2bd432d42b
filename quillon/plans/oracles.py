"""The SQL that the queries are held against, run by another engine over the same tables."""

from __future__ import annotations

from quillon.operators.scores import AXES, CONSTANT_ZERO, LOGGED
from quillon.plans.derived import EDGE_TYPES, REVISION_KINDS

_BUCKET = "CASE WHEN revision_depth IS NULL THEN 'no-history' WHEN revision_depth = 1 THEN 'single-version' WHEN revision_depth IN (2, 3) THEN 'mid-2-3x' ELSE 'deep-4plus' END"
_NAMED = "starts_with(canonical_id, 'proposed:') = FALSE"
_DAY = "coalesce(effective_completion_date, completion_date)"


def _nth(labels: list[str], i: str) -> str:
    return "CASE (" + i + f") % {len(labels)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(labels)) + " END"


def _score_sql() -> str:
    names = list(dict.fromkeys(n for w in AXES.values() for n in w))
    zero = "".join(f", 0 AS {n}" for n in CONSTANT_ZERO)
    value = {n: f"ln(1 + {n})" if n in LOGGED else n for n in names}
    stats = ", ".join(f"avg({value[n]}) AS m_{n}, stddev_pop({value[n]}) AS s_{n}" for n in names)
    z = {n: f"CASE WHEN coalesce(s_{n}, 0) = 0 THEN 0 ELSE ({value[n]} - m_{n}) / s_{n} END" for n in names}
    axes = ", ".join(f"CASE WHEN NOT too_early THEN ({' + '.join(f'({z[n]}) * {x}' for n, x in w.items())}) / {sum(w.values())} END AS {a}_score" for a, w in AXES.items())
    return f"""raw AS (
        SELECT p.project_id, coalesce(p.revision_depth, 0) revision_count, coalesce(p.notebook_count, 0) notebook_count, coalesce(b.b, 0) canonical_doc_bytes, coalesce(datediff('day', p.start_date, p.completion_date), 0) days_active,
               coalesce(e.c, 0) conclusion_count, coalesce(e.o, 0) distinct_organism_count, coalesce(e.m, 0) distinct_method_count, coalesce(e.d, 0) distinct_database_count,
               coalesce(i.n, 0) in_degree, coalesce(h.n, 0) two_hop_in_degree, coalesce(da.n, 0) cross_author_downstream, coalesce(o.n, 0) out_degree, coalesce(ua.n, 0) distinct_prior_authors, coalesce(si.n, 0) self_in_degree, coalesce(so.n, 0) self_out_degree{zero}
        FROM cur p
        LEFT JOIN (SELECT project_id, sum(byte_size) b FROM sections GROUP BY 1) b USING (project_id)
        LEFT JOIN (SELECT project_id, sum(CASE WHEN entity_kind = 'conclusion' THEN 1 ELSE 0 END) c, count(DISTINCT CASE WHEN entity_kind = 'organism' THEN canonical_id END) o, count(DISTINCT CASE WHEN entity_kind = 'method' THEN canonical_id END) m, count(DISTINCT CASE WHEN entity_kind = 'database' THEN canonical_id END) d FROM entity_mentions GROUP BY 1) e USING (project_id)
        LEFT JOIN (SELECT dst project_id, count(src) n FROM cls WHERE NOT shared GROUP BY 1) i USING (project_id)
        LEFT JOIN (SELECT dst project_id, count(src) n FROM cls WHERE shared GROUP BY 1) si USING (project_id)
        LEFT JOIN (SELECT src project_id, count(dst) n FROM cls WHERE NOT shared GROUP BY 1) o USING (project_id)
        LEFT JOIN (SELECT src project_id, count(dst) n FROM cls WHERE shared GROUP BY 1) so USING (project_id)
        LEFT JOIN (SELECT y.dst project_id, count(DISTINCT x.src) n FROM cls x, cls y WHERE x.dst = y.src AND NOT x.shared AND NOT y.shared AND x.src <> y.dst GROUP BY 1) h USING (project_id)
        LEFT JOIN (SELECT c.dst project_id, count(DISTINCT m.aid) n FROM cls c, mem m WHERE m.pid = c.src AND NOT c.shared AND c.dst_has GROUP BY 1) da USING (project_id)
        LEFT JOIN (SELECT c.src project_id, count(DISTINCT m.aid) n FROM cls c, mem m WHERE m.pid = c.dst AND NOT c.shared AND c.src_has GROUP BY 1) ua USING (project_id)),
    flagged AS (SELECT *, revision_count < 1 AND canonical_doc_bytes < 500 AS too_early FROM raw),
    stats AS (SELECT {stats} FROM flagged WHERE NOT too_early),
    sc AS (SELECT project_id, {axes}, too_early, (SELECT count(*) FROM entity_mentions) = 0 AS partial_phase_2b, {', '.join(names)} FROM flagged, stats)"""


# parts that other statements build on: name -> (needs, text)
_PARTS: dict[str, tuple[list[str], str]] = {
    "cur": ([], "cur AS (SELECT DISTINCT project_id, revision_depth, notebook_count, start_date, completion_date, effective_completion_date, last_touched, total_bytes, file_count FROM projects)"),
    "dated": (["cur"], f"dated AS (SELECT project_id, {_DAY} AS day FROM cur WHERE {_DAY} IS NOT NULL)"),
    "mem": ([], "mem AS (SELECT DISTINCT project_id pid, author_id aid FROM project_authors WHERE author_id IS NOT NULL)"),
    "dec": ([], "dec AS (SELECT DISTINCT src_project_id src, dst_project_id dst FROM reuse_edges WHERE confidence_tier = 'declared')"),
    "cls": (["mem", "dec"], "cls AS (SELECT src, dst, EXISTS (SELECT 1 FROM mem a JOIN mem b USING (aid) WHERE a.pid = src AND b.pid = dst) shared, src IN (SELECT pid FROM mem WHERE pid IS NOT NULL) IS TRUE src_has, dst IN (SELECT pid FROM mem WHERE pid IS NOT NULL) IS TRUE dst_has FROM dec)"),
    "ppl": ([], "ppl AS (SELECT author_id aid, first(canonical_name ORDER BY canonical_name NULLS FIRST, orcid_id NULLS FIRST) canonical_name, first(orcid_id ORDER BY canonical_name NULLS FIRST, orcid_id NULLS FIRST) orcid_id FROM authors GROUP BY 1)"),
    "sc": (["cur", "cls"], _score_sql()),
    "rev": (["cur"], """rev AS (SELECT project_id || ':RESEARCH_PLAN:v' || i AS revision_id, project_id, 'RESEARCH_PLAN' source_doc, 'v' || i AS version_label,
        CASE WHEN revision_depth = 1 THEN completion_date ELSE start_date + CAST((datediff('day', start_date, completion_date) * (i - 1)) // (revision_depth - 1) AS INTEGER) END AS version_date, 'day' date_precision, 'change ' || i AS change_description
        FROM (SELECT *, unnest(range(1, revision_depth + 1)) i FROM cur WHERE revision_depth >= 1 AND start_date IS NOT NULL AND completion_date IS NOT NULL))"""),
    "nb": (["cur"], "nb AS (SELECT project_id, i notebook_number, CASE WHEN i % 3 = 0 THEN 'goal' END goal_phrase, i * 7 % 11 + 2 total_cells, i * 7 % 11 code_cells, 2 markdown_cells FROM (SELECT project_id, unnest(range(1, notebook_count + 1)) i FROM cur WHERE notebook_count >= 1))"),
    "ec": ([], f"""ec AS (SELECT edge_id, src_project_id, dst_project_id, {_nth(EDGE_TYPES, 'length(src_project_id) + length(dst_project_id)')} edge_type, (length(edge_id) % 10) / 10.0::DOUBLE confidence, 'by length' rationale, source_quote
        FROM reuse_edges WHERE confidence_tier = 'declared' AND src_project_id IS NOT NULL AND dst_project_id IS NOT NULL AND edge_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY src_project_id, dst_project_id, source_quote NULLS FIRST) = 1)"""),
    "rk": (["rev"], f"rk AS (SELECT revision_id, project_id, {_nth(REVISION_KINDS, 'length(revision_id)')} kind, (length(revision_id) % 10) / 10.0::DOUBLE confidence, 'by length' rationale FROM rev)"),
    "named": ([], f"named AS (SELECT * FROM entity_mentions WHERE {_NAMED})"),
    "have": (["named"], "have AS (SELECT DISTINCT project_id pid, entity_kind kind, canonical_id name FROM named)"),
    "con": ([], "con AS (SELECT *, json_extract_string(extra_json, '$.claim_type') t FROM entity_mentions WHERE entity_kind = 'conclusion')"),
    "wcc": (["dec"], """e2 AS (SELECT src x, dst y FROM dec WHERE src IS NOT NULL AND dst IS NOT NULL),
        nei AS (SELECT x, y FROM e2 UNION SELECT y, x FROM e2 UNION SELECT x, x FROM e2 UNION SELECT y, y FROM e2),
        walk AS (SELECT x node, min(y) low, 0 step FROM nei GROUP BY x UNION ALL (SELECT n.x, min(r.low), any_value(r.step) + 1 FROM walk r JOIN nei n ON n.y = r.node WHERE r.step < 30 GROUP BY n.x)),
        wcc AS (SELECT node, min(low) component FROM walk GROUP BY 1)"""),
    "lm": (["wcc", "cur"], """lm0 AS (SELECT w.component, w.node project_id, coalesce(CAST(c.start AS VARCHAR), '9999-99-99') start FROM wcc w JOIN (SELECT component FROM wcc GROUP BY 1 HAVING count(*) >= 2) USING (component) LEFT JOIN (SELECT project_id, min(start_date) start FROM cur GROUP BY 1) c ON c.project_id = w.node),
        lm AS (SELECT 'line-' || first_value(project_id) OVER (PARTITION BY component ORDER BY start, project_id) line_id, project_id, start FROM lm0)"""),
    "cos": ([], f"""sig AS (SELECT DISTINCT project_id pid, left(entity_kind, 1) || ':' || canonical_id tok FROM entity_mentions WHERE entity_kind IN ('organism', 'method') AND {_NAMED}), sz AS (SELECT pid, count(*) n FROM sig GROUP BY 1),
        cos AS (SELECT a, b, k / sqrt(x.n * y.n) cosine FROM (SELECT p.pid a, q.pid b, count(*) k FROM sig p JOIN sig q USING (tok) WHERE p.pid < q.pid GROUP BY 1, 2) JOIN sz x ON x.pid = a JOIN sz y ON y.pid = b WHERE k / sqrt(x.n * y.n) >= 0.5)"""),
    "rl": (["lm", "sc", "cls", "cos"], """rl AS (SELECT l.line_id, l.members[1] line_name, l.member_count, coalesce(len(au.a), 0) distinct_author_count, coalesce(fl.h, 0) cross_author_handoffs, coalesce(fl.s, 0) self_iterations, coalesce(fl.c, 0) citation_edge_count, coalesce(tp.n, 0) topic_edge_count,
        l.earliest_start, l.latest_completion, depth_mean, breadth_mean, influence_mean, integration_mean, self_follow_on_mean, total_revisions, total_conclusions, total_notebooks, l.members, coalesce(au.a, []) line_authors
        FROM (SELECT line_id, list(project_id ORDER BY start, project_id) members, count(*) member_count, min(start_date) earliest_start, max(completion_date) latest_completion, avg(depth_score) depth_mean, avg(breadth_score) breadth_mean, avg(influence_score) influence_mean, avg(integration_score) integration_mean, avg(self_follow_on_score) self_follow_on_mean,
                     CAST(coalesce(sum(coalesce(revision_depth, 0)) FILTER (WHERE c.project_id IS NOT NULL), 0) AS BIGINT) total_revisions, CAST(coalesce(sum(conclusion_count), 0) AS BIGINT) total_conclusions, CAST(coalesce(sum(coalesce(c.notebook_count, 0)) FILTER (WHERE c.project_id IS NOT NULL), 0) AS BIGINT) total_notebooks
              FROM lm LEFT JOIN cur c USING (project_id) LEFT JOIN (SELECT project_id, depth_score, breadth_score, influence_score, integration_score, self_follow_on_score, conclusion_count FROM sc) s USING (project_id) GROUP BY 1) l
        LEFT JOIN (SELECT line_id, list(DISTINCT aid ORDER BY aid) a FROM lm JOIN mem ON pid = project_id GROUP BY 1) au USING (line_id)
        LEFT JOIN (SELECT x.line_id, sum(CASE WHEN NOT shared AND src_has AND dst_has THEN 1 ELSE 0 END)::BIGINT h, sum(CASE WHEN shared THEN 1 ELSE 0 END)::BIGINT s, count(*) c FROM cls JOIN lm x ON x.project_id = src JOIN lm y ON y.project_id = dst AND x.line_id = y.line_id GROUP BY 1) fl USING (line_id)
        LEFT JOIN (SELECT x.line_id, count(*) n FROM cos JOIN lm x ON x.project_id = a JOIN lm y ON y.project_id = b AND x.line_id = y.line_id GROUP BY 1) tp USING (line_id))"""),
}


def _sql(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _PARTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    head = ",\n".join(_PARTS[n][1] for n in order)
    return (("WITH RECURSIVE " if "wcc" in order else "WITH ") + head + "\n" if order else "") + body


def _top(kind: str, limit: int = 50, extra: str = "") -> str:
    return _sql("named", f"SELECT canonical_id, count(*) mention_count, count(DISTINCT project_id) project_count, list(DISTINCT project_id ORDER BY project_id) projects{extra} FROM named WHERE entity_kind = '{kind}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}")


def _names(kind: str, limit: int = 15) -> str:
    return _sql("named", f"SELECT canonical_id, count(*) mentions, count(DISTINCT project_id) projects FROM named WHERE entity_kind = '{kind}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}")


def _rate(by: str, types: str) -> str:
    hit = f"t IN ({types})"
    if by == "month":
        return _sql("con dated", f"SELECT strftime(day, '%Y-%m') AS month, sum(CASE WHEN {hit} THEN 1 ELSE 0 END)::BIGINT hits, count(*) total, round(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) / count(*), 4) rate FROM con JOIN dated USING (project_id) GROUP BY 1")
    return _sql("con", f"SELECT project_id, sum(CASE WHEN {hit} THEN 1 ELSE 0 END)::BIGINT hits, count(*) total, round(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) / count(*), 4) rate FROM con GROUP BY 1")


def _samples(types: str) -> str:
    return _sql("con", f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY mention_id) rn FROM (SELECT DISTINCT project_id, mention_id, left(coalesce(surface_form, ''), 300) AS text, coalesce(source_section, '') source_section FROM con WHERE t IN ({types}))) WHERE rn <= 10")


_GAPS = """pop AS (SELECT kind, name, count(*) n FROM have WHERE kind IN ({kinds}) GROUP BY 1, 2 HAVING count(*) >= 5),
    tog AS (SELECT a.kind ak, a.name an, b.kind bk, b.name bn, count(*) k FROM have a JOIN have b ON a.pid = b.pid AND a.kind < b.kind GROUP BY ALL),
    cand AS (SELECT x.kind a_kind, x.name a_canonical, x.n a_count, y.kind b_kind, y.name b_canonical, y.n b_count, coalesce(k, 0) actual FROM pop x JOIN pop y ON x.kind < y.kind LEFT JOIN tog ON ak = x.kind AND an = x.name AND bk = y.kind AND bn = y.name WHERE coalesce(k, 0) <= 1)"""
_K3, _K4 = "'organism', 'method', 'database'", "'organism', 'method', 'database', 'function'"
_CO = "co AS (SELECT a.kind || ':' || a.name a, b.kind || ':' || b.name b, count(*) weight FROM have a JOIN have b ON a.pid = b.pid AND a.kind || ':' || a.name < b.kind || ':' || b.name WHERE a.kind IN ({k}) AND b.kind IN ({k}) GROUP BY 1, 2 HAVING count(*) >= 2)"


def _with(needs: str, more: str, body: str) -> str:
    head = _sql(needs, "")
    return (head.rstrip() + ",\n" if head else "WITH ") + more + "\n" + body


VIEWS = {
    "corpus_summary": _sql("nb rev", """SELECT p.projects, s.n sections, r.n revisions, a.distinct_authors, a.distinct_orcids, n.n notebooks, e.reuse_edge_rows, e.distinct_reuse_pairs, p.earliest_start, p.latest_completion
        FROM (SELECT count(*) projects, min(start_date) earliest_start, max(completion_date) latest_completion FROM projects) p, (SELECT count(*) n FROM sections) s, (SELECT count(*) n FROM rev) r,
             (SELECT count(DISTINCT author_id) distinct_authors, count(DISTINCT orcid_id) distinct_orcids FROM authors) a, (SELECT count(*) n FROM nb) n, (SELECT count(*) reuse_edge_rows, count(DISTINCT (src_project_id, dst_project_id)) distinct_reuse_pairs FROM reuse_edges) e"""),
    "project_inventory": f"SELECT project_id, start_date, completion_date, revision_depth, review_date, review_reviewer, total_bytes, file_count, notebook_count, has_references_md, {_BUCKET} depth_bucket FROM projects",
    "project_completion_by_month": "SELECT strftime(completion_date, '%Y-%m') year_month, count(*) projects_completed, list(project_id ORDER BY project_id) project_ids FROM projects WHERE completion_date IS NOT NULL GROUP BY 1",
    "revision_depth_distribution": f"SELECT {_BUCKET} depth_bucket, count(*) project_count, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE pct, list(project_id ORDER BY revision_depth DESC NULLS LAST, project_id) project_ids FROM projects GROUP BY 1",
    "methodology_evolution_narration": _sql("rev", "SELECT project_id, version_label, version_date, date_precision, source_doc, change_description FROM rev WHERE project_id IN (SELECT project_id FROM projects WHERE revision_depth >= 3)"),
    "iteration_density": "SELECT project_id, revision_depth, start_date, completion_date, CAST(datediff('day', start_date, completion_date) AS INTEGER) days_active, round(revision_depth::DOUBLE / nullif(datediff('day', start_date, completion_date), 0), 3) revisions_per_day FROM projects WHERE revision_depth >= 2",
    "top_cited_projects": _sql("cls", """SELECT dst dst_project_id, count(*) in_degree, count(src) FILTER (WHERE NOT shared) cross_in_degree, coalesce(any_value(d.n), 0) distinct_downstream_authors, coalesce(any_value(d.l), []) downstream_author_ids, coalesce(any_value(t.n), 0) total_citing_sections, coalesce(list(DISTINCT src ORDER BY src) FILTER (WHERE src IS NOT NULL), []) cited_by
        FROM cls LEFT JOIN (SELECT c.dst d, count(DISTINCT aid) n, list(DISTINCT aid ORDER BY aid) l FROM cls c JOIN mem ON pid = c.src WHERE NOT shared AND c.dst IS NOT NULL GROUP BY 1) d ON d.d = dst LEFT JOIN (SELECT dst_project_id d, count(*) n FROM reuse_edges WHERE confidence_tier = 'declared' GROUP BY 1) t ON t.d = dst GROUP BY dst"""),
    "top_citing_projects": "SELECT src_project_id, count(DISTINCT dst_project_id) out_degree, count(*) total_citing_sections, coalesce(list(DISTINCT dst_project_id ORDER BY dst_project_id) FILTER (WHERE dst_project_id IS NOT NULL), []) cites FROM reuse_edges WHERE confidence_tier = 'declared' GROUP BY 1",
    "distinct_reuse_pairs": "SELECT src_project_id, dst_project_id, count(*) citing_section_count, coalesce(list(DISTINCT source_section ORDER BY source_section) FILTER (WHERE source_section IS NOT NULL), []) sections, coalesce(list(DISTINCT source_doc ORDER BY source_doc) FILTER (WHERE source_doc IS NOT NULL), []) docs, CAST(sum(occurrence_count) AS BIGINT) total_occurrences FROM reuse_edges WHERE confidence_tier = 'declared' GROUP BY 1, 2",
    "amplification_rate": _sql("dec", "SELECT p.n total_projects, c.n projects_with_declared_citation, round(100.0 * c.n / nullif(p.n, 0), 1)::DOUBLE amplification_pct FROM (SELECT count(*) n FROM projects) p, (SELECT count(*) n FROM (SELECT DISTINCT src FROM dec)) c"),
    "authors_by_project_count": "SELECT canonical_name, orcid_id, count(DISTINCT project_id) project_count, list(DISTINCT project_id ORDER BY project_id) projects FROM authors JOIN project_authors USING (author_id) GROUP BY 1, 2",
    "coauthorship_edges": _sql("mem", "SELECT x.n author_1, y.n author_2, count(DISTINCT a.pid) shared_projects, list(DISTINCT a.pid ORDER BY a.pid) project_ids FROM mem a JOIN mem b ON a.pid = b.pid AND a.aid < b.aid JOIN (SELECT DISTINCT author_id, canonical_name n FROM authors) x ON x.author_id = a.aid JOIN (SELECT DISTINCT author_id, canonical_name n FROM authors) y ON y.author_id = b.aid GROUP BY 1, 2"),
    "projects_by_author_count": "SELECT n_authors, count(*) n_projects, list(project_id ORDER BY project_id) projects FROM (SELECT project_id, count(DISTINCT author_id) n_authors FROM project_authors GROUP BY 1) GROUP BY 1",
    "notebook_pipeline_depth": _sql("nb", "SELECT project_id, count(*) notebook_count, max(notebook_number) max_nb_number, sum(total_cells)::BIGINT total_cells_across_notebooks, sum(code_cells)::BIGINT total_code_cells, sum(markdown_cells)::BIGINT total_markdown_cells, count(goal_phrase) notebooks_with_goal, round(100.0 * count(goal_phrase) / count(*), 1)::DOUBLE goal_coverage_pct FROM nb GROUP BY 1"),
    "h2_frequency_by_doc": "SELECT source_doc, h2_text, count(*) section_count, round(avg(byte_size), 0) mean_byte_size, max(byte_size) max_byte_size FROM sections WHERE h2_text NOT IN ('__frontmatter__', '__preamble__') GROUP BY 1, 2 HAVING count(*) > 2",
    "sections_by_project": "SELECT project_id, count(*) total_sections, count_if(source_doc = 'README') readme_sections, count_if(source_doc = 'RESEARCH_PLAN') plan_sections, count_if(source_doc = 'REPORT') report_sections, count_if(source_doc = 'REVIEW') review_sections, sum(byte_size)::BIGINT total_section_bytes FROM sections WHERE h2_text NOT IN ('__frontmatter__', '__preamble__') GROUP BY 1",
    "top_organisms_by_mention": _top("organism", extra=", max(extraction_source) extraction_source"),
    "top_methods_by_mention": _top("method"), "top_journals_by_mention": _top("journal"), "top_functions_by_mention": _top("function"), "top_databases_by_mention": _top("database"),
    "question_type_portfolio": """WITH v AS (SELECT project_id, split_part(canonical_id, ':', 1) axis, substr(canonical_id, instr(canonical_id, ':') + 1) label, count(*) n FROM entity_mentions WHERE entity_kind = 'question_type' AND canonical_id LIKE '%:%' GROUP BY 1, 2, 3),
        t AS (SELECT project_id, axis, first(label ORDER BY n DESC, label) label, sum(n)::BIGINT s FROM v GROUP BY 1, 2)
        SELECT d.project_id, d.label domain_label, m.label mode_label, d.s + coalesce(m.s, 0) total_evidence FROM t d LEFT JOIN t m ON m.project_id = d.project_id AND m.axis = 'mode' WHERE d.axis = 'domain'""",
    "conclusions_per_project": _sql("con", "SELECT project_id, count(*) total_conclusions, count_if(t = 'descriptive') descriptive, count_if(t = 'mechanistic') mechanistic, count_if(t = 'predictive') predictive, count_if(t = 'methodological') methodological, count_if(t = 'negative_result') negative_result FROM con GROUP BY 1"),
    "conclusion_subject_triangulation": _sql("con", "SELECT json_extract_string(extra_json, '$.subject_entity') subject_entity, count(DISTINCT project_id) converging_projects, count(*) total_claims, list(DISTINCT project_id ORDER BY project_id) projects FROM con WHERE json_extract_string(extra_json, '$.subject_entity') <> '' GROUP BY 1 HAVING count(DISTINCT project_id) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50"),
    "drift_candidates_summary": "SELECT entity_kind, surface_form, count(*) occurrence_count, count(DISTINCT project_id) project_count, max(llm_proposed_canonical) llm_proposed_canonical FROM drift_candidates WHERE entity_kind NOT LIKE '%\\_error' ESCAPE '\\' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 NULLS LAST LIMIT 100",
    "extraction_errors_by_section": "SELECT source_doc, source_section, count(*) failure_count, count(DISTINCT project_id) affected_projects, max(llm_notes) sample_error FROM drift_candidates WHERE entity_kind LIKE '%\\_error' ESCAPE '\\' GROUP BY 1, 2",
    "sophistication_vs_revisions": _sql("sc", "SELECT p.project_id, p.revision_depth, depth_score, breadth_score, influence_score, integration_score, p.start_date, p.completion_date, strftime(p.completion_date, '%Y-%m') completion_month, too_early, partial_phase_2b FROM projects p JOIN sc USING (project_id) WHERE depth_score IS NOT NULL AND p.revision_depth IS NOT NULL"),
    "sophistication_ingredients": _sql("dec", """SELECT p.project_id, coalesce(p.revision_depth, 0)::BIGINT revision_count, coalesce(p.notebook_count, 0)::BIGINT notebook_count, coalesce(b.b, 0)::BIGINT canonical_doc_bytes, coalesce(datediff('day', start_date, completion_date), 0)::BIGINT days_active, coalesce(e.c, 0)::BIGINT conclusion_count, coalesce(e.o, 0) distinct_organism_count, coalesce(e.m, 0) distinct_method_count, coalesce(e.d, 0) distinct_database_count, coalesce(i.n, 0) in_degree, coalesce(o.n, 0) out_degree
        FROM projects p LEFT JOIN (SELECT project_id, sum(byte_size) b FROM sections GROUP BY 1) b USING (project_id)
        LEFT JOIN (SELECT project_id, count_if(entity_kind = 'conclusion') c, count(DISTINCT canonical_id) FILTER (WHERE entity_kind = 'organism') o, count(DISTINCT canonical_id) FILTER (WHERE entity_kind = 'method') m, count(DISTINCT canonical_id) FILTER (WHERE entity_kind = 'database') d FROM entity_mentions GROUP BY 1) e USING (project_id)
        LEFT JOIN (SELECT dst project_id, count(src) n FROM dec GROUP BY 1) i USING (project_id) LEFT JOIN (SELECT src project_id, count(dst) n FROM dec GROUP BY 1) o USING (project_id)"""),
    "sophistication_composite": _sql("sc", "SELECT project_id, depth_score, breadth_score, influence_score, integration_score, self_follow_on_score, too_early, partial_phase_2b FROM sc"),
    "edge_classifications": _sql("ec", "SELECT edge_id, src_project_id, dst_project_id, edge_type, confidence, rationale, source_quote FROM ec"),
    "revision_kinds": _sql("rk", "SELECT revision_id, project_id, kind, confidence, rationale FROM rk"),
    "combination_plausibility": _with("have", _GAPS.format(kinds=_K4), "SELECT a_kind, a_canonical, b_kind, b_canonical, ((length(a_canonical) + length(b_canonical)) % 10) / 10.0::DOUBLE plausibility, 'by length' rationale FROM (SELECT * FROM cand ORDER BY a_count * b_count DESC, a_kind, a_canonical, b_kind, b_canonical LIMIT 40)"),
}

PANELS = {
    "panel_summary": _sql("nb dec", "SELECT p.*, a.*, (SELECT count(*) FROM nb) notebooks, (SELECT count(*) FROM dec) reuse_pairs, (SELECT count(*) FROM entity_mentions) mentions FROM (SELECT count(*) projects, min(start_date) earliest, max(completion_date) latest FROM projects) p, (SELECT count(DISTINCT author_id) authors, count(DISTINCT orcid_id) orcids FROM authors) a"),
    "panel_completion_timeline": "SELECT completion_date, count(*) completed, list(project_id ORDER BY project_id) project_ids, CAST(sum(count(*)) OVER (ORDER BY completion_date) AS BIGINT) cumulative FROM projects WHERE completion_date IS NOT NULL GROUP BY 1",
    "panel_top_cited": _sql("cls", """SELECT project_id, in_degree, cross_in_degree, coalesce(len(l), 0) distinct_downstream_authors, coalesce(l[1:3], []) downstream_author_preview FROM (SELECT dst project_id, count(src) in_degree, count_if(NOT shared AND src_has AND dst_has) cross_in_degree FROM cls WHERE dst IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        LEFT JOIN (SELECT dst project_id, list(DISTINCT aid ORDER BY aid) l FROM cls JOIN mem ON pid = src WHERE NOT shared AND src_has AND dst_has GROUP BY 1) USING (project_id)"""),
    "panel_depth_distribution": f"SELECT {_BUCKET} bucket, count(*) n FROM projects GROUP BY 1",
    "panel_reuse_nodes": _sql("cur dec", "SELECT project_id, coalesce(i.n, 0) in_degree, coalesce(o.n, 0) out_degree FROM cur LEFT JOIN (SELECT dst project_id, count(src) n FROM dec GROUP BY 1) i USING (project_id) LEFT JOIN (SELECT src project_id, count(dst) n FROM dec GROUP BY 1) o USING (project_id)"),
    "panel_reuse_links": _sql("dec", "SELECT src, dst FROM dec"),
    "panel_sophistication": _sql("sc", "SELECT project_id, depth_score depth, breadth_score breadth, influence_score influence, integration_score integration, self_follow_on_score self_follow_on, too_early, partial_phase_2b, revision_count revisions, notebook_count notebooks, canonical_doc_bytes bytes, conclusion_count conclusions, in_degree, out_degree, self_in_degree self_in, self_out_degree self_out FROM sc"),
    "panel_line_handoffs": _sql("lm cls", "SELECT x.line_id, src, dst, s.l src_authors, d.l dst_authors FROM cls JOIN lm x ON x.project_id = src JOIN lm y ON y.project_id = dst AND x.line_id = y.line_id JOIN (SELECT pid, list(aid ORDER BY aid) l FROM mem GROUP BY 1) s ON s.pid = src JOIN (SELECT pid, list(aid ORDER BY aid) l FROM mem GROUP BY 1) d ON d.pid = dst WHERE NOT shared"),
    "panel_research_lines": _sql("rl", "SELECT * EXCLUDE (line_authors), line_authors AS author_ids FROM rl"),
    "panel_database_matrix": _sql("named", "SELECT project_id, canonical_id AS \"database\", count(*) n, sum(count(*)) OVER (PARTITION BY project_id)::BIGINT project_total, sum(count(*)) OVER (PARTITION BY canonical_id)::BIGINT database_total FROM named WHERE entity_kind = 'database' GROUP BY 1, 2"),
    "panel_question_pairs": "WITH q AS (SELECT DISTINCT project_id, split_part(canonical_id, ':', 1) axis, substr(canonical_id, instr(canonical_id, ':') + 1) label FROM entity_mentions WHERE entity_kind = 'question_type') SELECT d.label AS domain, m.label AS mode, count(DISTINCT d.project_id) projects FROM q d JOIN q m USING (project_id) WHERE d.axis = 'domain' AND m.axis = 'mode' GROUP BY 1, 2",
    "panel_discoveries_timeline": _sql("con dated", "SELECT month, claim_type, CAST(sum(n) OVER (PARTITION BY claim_type ORDER BY month) AS BIGINT) cumulative FROM (SELECT strftime(day, '%Y-%m') AS month, coalesce(t, 'unclassified') claim_type, count(*) n FROM con JOIN dated USING (project_id) GROUP BY 1, 2)"),
    "panel_topic_trends": _sql("named dated", "SELECT canonical_id, month, CAST(sum(n) OVER (PARTITION BY canonical_id ORDER BY month) AS BIGINT) cumulative FROM (SELECT canonical_id, strftime(day, '%Y-%m') AS month, count(*) n FROM named JOIN dated USING (project_id) WHERE entity_kind = 'organism' AND canonical_id IN (SELECT canonical_id FROM named WHERE entity_kind = 'organism' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1, 2)"),
    "panel_claims_by_month": _sql("con dated", "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY month, claim_type, project_id ORDER BY mention_id) rn FROM (SELECT DISTINCT strftime(day, '%Y-%m') AS month, coalesce(t, 'unclassified') claim_type, project_id, mention_id, source_doc, source_section, left(coalesce(surface_form, ''), 300) claim_text, left(coalesce(source_quote, ''), 400) source_quote FROM con JOIN dated USING (project_id))) WHERE rn <= 20"),
    "panel_dark_matter": _sql("named", "SELECT canonical_id, entity_kind, any_value(project_id) project_id, any_value(source_doc) source_doc, any_value(source_section) source_section FROM named WHERE entity_kind IN ('organism', 'method', 'database') GROUP BY 1, 2 HAVING count(*) = 1 ORDER BY 2, 1 LIMIT 30"),
    "panel_underexplored": _with("have", _GAPS.format(kinds=_K3), f"SELECT a_kind, a_canonical, a_count, b_kind, b_canonical, b_count, actual, expected, expected - actual AS gap FROM (SELECT *, (a_count / tot) * (b_count / tot) * tot AS expected FROM cand, (SELECT count(DISTINCT pid) tot FROM have WHERE kind IN ({_K3}))) WHERE expected > actual AND tot > 1 ORDER BY gap DESC, 1, 2, 4, 5 LIMIT 20"),
    "panel_author_links": _sql("cls", "SELECT least(x.aid, y.aid) a, greatest(x.aid, y.aid) b, count(*) weight FROM cls JOIN mem x ON x.pid = src JOIN mem y ON y.pid = dst WHERE NOT shared GROUP BY 1, 2"),
    "panel_edge_types": _sql("ec", "SELECT edge_type, count(*) AS count, avg(confidence) avg_confidence FROM ec GROUP BY 1"),
    "panel_edge_type_samples": _sql("ec", "SELECT edge_type, edge_id, src_project_id, dst_project_id, confidence FROM ec QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY confidence DESC NULLS LAST, edge_id) <= 10"),
    "panel_revision_kinds": _sql("rk", "SELECT kind, count(*) AS count, avg(confidence) avg_confidence FROM rk GROUP BY 1"),
    "panel_revision_kind_trend": _sql("rk", "SELECT strftime(version_date, '%Y-%m') AS month, kind, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY strftime(version_date, '%Y-%m')) AS share FROM rk JOIN rev USING (revision_id) GROUP BY 1, 2"),
    "panel_cohort_slope": _sql("sc", "SELECT count(*) cohorts, CASE WHEN count(*) > 1 THEN regr_slope(m, x) END slope FROM (SELECT avg(depth_score) m, (row_number() OVER (ORDER BY strftime(c.completion_date, '%Y-%m')) - 1)::DOUBLE x FROM cur c JOIN sc USING (project_id) WHERE NOT too_early AND c.completion_date IS NOT NULL GROUP BY strftime(c.completion_date, '%Y-%m') HAVING count(*) > 2)"),
    "panel_cohort_trends": _sql("sc", "SELECT strftime(c.completion_date, '%Y-%m') AS month, count(*) n, regr_slope(depth_score, c.revision_depth) slope, regr_intercept(depth_score, c.revision_depth) intercept FROM cur c JOIN sc USING (project_id) WHERE c.completion_date IS NOT NULL AND c.revision_depth IS NOT NULL AND depth_score IS NOT NULL GROUP BY 1 HAVING count(*) > 2 AND var_pop(c.revision_depth) > 0"),
    "panel_negative_by_month": _rate("month", "'negative_result'"), "panel_negative_by_project": _rate("project", "'negative_result'"), "panel_negative_samples": _samples("'negative_result'"),
    "panel_positive_by_month": _rate("month", "'mechanistic', 'predictive'"), "panel_positive_by_project": _rate("project", "'mechanistic', 'predictive'"), "panel_positive_samples": _samples("'mechanistic', 'predictive'"),
    "panel_untracked_projects": _sql("cur mem ppl con", "SELECT project_id, total_bytes, file_count, n conclusion_count, coalesce(l, []) author_names FROM cur JOIN (SELECT project_id, count(*) n FROM con GROUP BY 1) USING (project_id) LEFT JOIN (SELECT pid project_id, list(DISTINCT canonical_name ORDER BY canonical_name) l FROM mem JOIN ppl USING (aid) GROUP BY 1) USING (project_id) WHERE completion_date IS NULL AND effective_completion_date IS NULL"),
    "panel_stuck": _sql("rev mem ppl", "SELECT project_id, last_revision_date, CAST(DATE '2026-12-31' - last_revision_date AS INTEGER) days_since, coalesce(l, []) author_names FROM (SELECT project_id, max(version_date) last_revision_date FROM rev GROUP BY 1) LEFT JOIN (SELECT pid project_id, list(DISTINCT canonical_name ORDER BY canonical_name) l FROM mem JOIN ppl USING (aid) GROUP BY 1) USING (project_id) WHERE DATE '2026-12-31' - last_revision_date >= 30"),
    "panel_reach": _sql("sc", "SELECT project_id, in_degree, two_hop_in_degree two_hop, cross_author_downstream downstream_authors, (('0x' || left(md5(project_id || ':x'), 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE - 0.5::DOUBLE) * 0.3::DOUBLE jitter_x, (('0x' || left(md5(project_id || ':y'), 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE - 0.5::DOUBLE) * 0.3::DOUBLE jitter_y FROM sc"),
    "panel_weekly_pulse": _sql("rev con dated", """SELECT CAST(week AS DATE) AS week, coalesce(s.n, 0) starts, coalesce(r.n, 0) revisions, coalesce(c.n, 0) conclusions FROM (SELECT date_trunc('week', version_date) AS week FROM rev UNION SELECT date_trunc('week', day) FROM dated)
        LEFT JOIN (SELECT date_trunc('week', start_date) AS week, count(*) n FROM cur WHERE start_date IS NOT NULL GROUP BY 1) s USING (week) LEFT JOIN (SELECT date_trunc('week', version_date) AS week, count(*) n FROM rev GROUP BY 1) r USING (week) LEFT JOIN (SELECT date_trunc('week', day) AS week, count(*) n FROM con JOIN dated USING (project_id) GROUP BY 1) c USING (week)"""),
    "panel_project_details": _sql("cur cls", """SELECT project_id, start_date, completion_date, revision_depth, notebook_count, coalesce(i.c, []) cross_cited_by, coalesce(i.o, []) self_cited_by, coalesce(x.c, []) cross_cites, coalesce(x.o, []) self_cites, coalesce(d.l, []) downstream_authors, coalesce(u.l, []) upstream_authors, coalesce(m.l, []) authors FROM cur
        LEFT JOIN (SELECT dst project_id, list(DISTINCT src ORDER BY src) FILTER (WHERE src IS NOT NULL AND NOT shared AND src_has AND dst_has) c, list(DISTINCT src ORDER BY src) FILTER (WHERE src IS NOT NULL AND NOT (NOT shared AND src_has AND dst_has)) o FROM cls GROUP BY 1) i USING (project_id)
        LEFT JOIN (SELECT src project_id, list(DISTINCT dst ORDER BY dst) FILTER (WHERE dst IS NOT NULL AND NOT shared AND src_has AND dst_has) c, list(DISTINCT dst ORDER BY dst) FILTER (WHERE dst IS NOT NULL AND NOT (NOT shared AND src_has AND dst_has)) o FROM cls GROUP BY 1) x USING (project_id)
        LEFT JOIN (SELECT dst project_id, list(DISTINCT aid ORDER BY aid) l FROM cls JOIN mem ON pid = src WHERE NOT shared AND dst_has GROUP BY 1) d USING (project_id) LEFT JOIN (SELECT src project_id, list(DISTINCT aid ORDER BY aid) l FROM cls JOIN mem ON pid = dst WHERE NOT shared AND src_has GROUP BY 1) u USING (project_id)
        LEFT JOIN (SELECT pid project_id, list(aid ORDER BY aid) l FROM mem GROUP BY 1) m USING (project_id)"""),
    "panel_entity_details": _sql("named mem", """SELECT canonical_id, entity_kind, mentions, projects, sections_shown, coalesce(n, 0) authors FROM (SELECT canonical_id, min(entity_kind) entity_kind, count(*) mentions, count(DISTINCT project_id) projects, least(20, count(DISTINCT (project_id, source_doc, source_section))) sections_shown FROM named WHERE entity_kind IN ('organism', 'method', 'database', 'journal', 'function') GROUP BY 1)
        LEFT JOIN (SELECT canonical_id, count(DISTINCT aid) n FROM named JOIN mem ON pid = project_id WHERE entity_kind IN ('organism', 'method', 'database', 'journal', 'function') GROUP BY 1) USING (canonical_id)"""),
    "panel_author_details": _sql("lm mem ppl", r"""SELECT aid author_id, CASE WHEN coalesce(c, '') = '' THEN '(unknown)' ELSE c END display_name, n.n projects, coalesce(k.m, 0) mentions, coalesce(k.k, 0) kinds, coalesce(i.l, []) AS lines, n.n - coalesce(i.p, 0) projects_outside_lines
        FROM (SELECT aid, count(*) n FROM mem GROUP BY 1) n LEFT JOIN (SELECT aid, trim(regexp_replace(regexp_replace(regexp_replace(canonical_name, '\([^)]*\)', ' ', 'g'), '\s*(—|–|\s-\s|\|).*$', '', 'g'), '\s+', ' ', 'g')) c FROM ppl) p USING (aid)
        LEFT JOIN (SELECT aid, count(*) m, count(DISTINCT entity_kind) k FROM mem JOIN entity_mentions ON project_id = pid GROUP BY 1) k USING (aid) LEFT JOIN (SELECT aid, list(DISTINCT line_id ORDER BY line_id) l, count(DISTINCT pid) p FROM mem JOIN lm ON project_id = pid GROUP BY 1) i USING (aid)"""),
    **{f"panel_top_{k}s": _names(k) for k in ("organism", "method", "journal", "function", "database")},
}
PANELS["panel_topic_links"] = _with("have", _CO.format(k=_K3), "SELECT a, b, weight FROM co")
PANELS["panel_topic_cosine"] = _sql("cos", "SELECT a, b, cosine FROM cos")
PANELS["panel_components"] = _sql("wcc", "SELECT node, component FROM wcc")

_DOMAINS, _MODES = "['biochemistry-metabolism', 'physiology-phenotype', 'ecology-environment', 'evolution-comparative-genomics', 'biotechnology-application', 'methodology-tools']", "['discovery', 'characterization', 'mechanism', 'prediction', 'synthesis']"
_SHOWN = r"CASE WHEN coalesce(d, '') = '' THEN '(unknown)' ELSE d END"
_CUT = r"trim(regexp_replace(regexp_replace(regexp_replace(canonical_name, '\([^)]*\)', ' ', 'g'), '\s*(—|–|\s-\s|\|).*$', '', 'g'), '\s+', ' ', 'g'))"
_FOUND = _sql("named", """SELECT (row_number() OVER (ORDER BY sure DESC, claim) - 1)::INTEGER finding_index, claim, CASE WHEN length(canonical_id) % 2 = 0 THEN 'action_indicated' ELSE 'watch_for_change' END so_what, sure confidence, '{}' evidence_json, 'v1' prompt_version, 'stand-in' model_id, CAST(NULL AS TIMESTAMP) observed_at
    FROM (SELECT canonical_id, canonical_id || ' recurs' claim, least(1.0::DOUBLE, count(*) / 100.0::DOUBLE) sure FROM named WHERE entity_kind = 'organism' GROUP BY 1) ORDER BY sure DESC, claim LIMIT 5""")
_ADVISED = _sql("named", """SELECT rec_index::INTEGER rec_index, title, '' rationale, CASE WHEN r = 0 AND rec_index < 3 THEN 'high' WHEN r = 2 THEN 'low' ELSE 'medium' END priority, 'other' gap_type, '{}' evidence_json, 'medium' estimated_effort, least(1.0::DOUBLE, n / 10.0::DOUBLE) plausibility, 'v1' prompt_version, 'stand-in' model_id, CAST(NULL AS TIMESTAMP) observed_at
    FROM (SELECT *, row_number() OVER (ORDER BY r, title) - 1 rec_index FROM (SELECT 'Try ' || canonical_id title, count(*) n, count(*) % 3 r FROM named WHERE entity_kind = 'method' GROUP BY canonical_id)) WHERE rec_index < 8""")
VIEWS["findings"], VIEWS["recommendations"] = _FOUND, _ADVISED
_SLOPE = "SELECT CASE WHEN count(*) > 1 THEN regr_slope(m, x) END slope FROM (SELECT avg(depth_score) m, (row_number() OVER (ORDER BY strftime(c.completion_date, '%Y-%m')) - 1)::DOUBLE x FROM cur c JOIN sc USING (project_id) WHERE NOT too_early AND c.completion_date IS NOT NULL GROUP BY strftime(c.completion_date, '%Y-%m') HAVING count(*) > 2)"
_WATCHED = {
    "01 research lines": "SELECT count(DISTINCT line_id) FROM lm", "01 projects in lines": "SELECT count(DISTINCT project_id) FROM lm", "02 authors": "SELECT count(*) FROM (SELECT DISTINCT author_id FROM authors)",
    "03 depth of 1 sigma, %": "SELECT avg(CASE WHEN depth_score >= 1 THEN 100.0::DOUBLE ELSE 0 END) FROM sc WHERE NOT too_early",
    "04 depth and breadth for each revision": "SELECT avg(coalesce(depth_score, 0) + coalesce(breadth_score, 0)) / 2 / nullif(avg(c.revision_depth), 0) FROM sc JOIN cur c USING (project_id) WHERE NOT too_early AND c.revision_depth >= 1",
    "05 self follow-on of 1 sigma, %": "SELECT avg(CASE WHEN self_follow_on_score >= 1 THEN 100.0::DOUBLE ELSE 0 END) FROM sc WHERE NOT too_early",
    "06 projects with references": "SELECT count(DISTINCT project_id) FROM sections WHERE source_doc = 'references_md'", "06 pairs of citation": "SELECT count(*) FROM dec",
    "07 cited from outside, %": "SELECT avg(CASE WHEN in_degree >= 1 THEN 100.0::DOUBLE ELSE 0 END) FROM sc WHERE NOT too_early", "07 mean downstream authors": "SELECT avg(cross_author_downstream) FROM sc WHERE NOT too_early AND cross_author_downstream > 0",
    "08 exploratory citations, %": "SELECT avg(CASE WHEN edge_type IN ('deepening', 'branching') THEN 100.0::DOUBLE ELSE 0 END) FROM ec", "09 cohort slope": _SLOPE,
    "10 databases used": "SELECT count(DISTINCT name) FROM have WHERE kind = 'database'", "11 pairs of databases": "SELECT count(DISTINCT (a.name, b.name)) FROM have a JOIN have b USING (pid) WHERE a.kind = 'database' AND b.kind = 'database' AND a.name < b.name",
    "12 names pending": "SELECT count(*) FROM (SELECT DISTINCT entity_kind, surface_form FROM drift_candidates WHERE llm_decision = 'proposed')",
}
PANELS |= {
    "panel_question_grid": f"""WITH s AS (SELECT DISTINCT project_id, json_extract_string(extra_json, '$.axis') axis, substr(canonical_id, instr(canonical_id, ':') + 1) x FROM entity_mentions WHERE entity_kind = 'question_type'),
        k AS (SELECT a.x a, b.x b, count(*) n FROM s a JOIN s b USING (project_id) WHERE a.axis = 'domain' AND b.axis = 'mode' GROUP BY 1, 2)
        SELECT d.x AS domain, m.x AS mode, coalesce(n, 0) projects FROM (SELECT unnest({_DOMAINS}) x) d CROSS JOIN (SELECT unnest({_MODES}) x) m LEFT JOIN k ON k.a = d.x AND k.b = m.x""",
    "panel_author_nodes": _with("cls ppl", "near AS (SELECT DISTINCT unnest([x.aid, y.aid]) aid FROM cls JOIN mem x ON x.pid = src JOIN mem y ON y.pid = dst WHERE NOT shared)", f"SELECT aid author_id, {_SHOWN} display_name, n projects, aid IN (SELECT aid FROM near) linked FROM (SELECT aid, count(*) n FROM mem GROUP BY 1) JOIN (SELECT aid, {_CUT} d FROM ppl) USING (aid) WHERE n >= 2 OR aid IN (SELECT aid FROM near)"),
    "panel_top_authors": _with("lm mem ppl", "best AS (SELECT aid, canonical_name, orcid_id, n FROM (SELECT aid, count(*) n FROM mem GROUP BY 1) JOIN ppl USING (aid) ORDER BY n DESC, aid LIMIT 10)", """SELECT aid author_id, canonical_name, orcid_id, n project_count, line_id, member_count, \"role\" FROM best LEFT JOIN
        (SELECT aid, l.line_id, any_value(k) member_count, CASE WHEN bool_or(pid = substr(l.line_id, 6)) THEN 'founder' ELSE 'participant' END AS \"role\" FROM mem JOIN lm l ON project_id = pid JOIN (SELECT line_id, count(*) k FROM lm GROUP BY 1) USING (line_id) GROUP BY 1, 2) USING (aid)""".replace("", "")),
    "panel_plausible": VIEWS["combination_plausibility"],
    "panel_findings": f"SELECT finding_index, claim, so_what, confidence, '' so_what_detail FROM ({_FOUND})",
    "panel_recommendations": f"SELECT rec_index, title, priority, gap_type, estimated_effort, plausibility FROM ({_ADVISED})",
    "panel_metrics_to_watch": _sql("lm sc dec ec have", " UNION ALL ".join(f"SELECT '{k}' metric, ({v})::DOUBLE AS value" for k, v in _WATCHED.items())),
    # as few rows as possible: as many as intervals lie over one start
    "panel_gantt_blocks": _with("cur mem", f"""bar AS (SELECT aid, project_id, start_date s, coalesce(effective_completion_date, completion_date, start_date) e FROM mem JOIN cur ON pid = project_id WHERE start_date IS NOT NULL AND aid IN (SELECT aid FROM mem GROUP BY 1 ORDER BY count(*) DESC, aid LIMIT 10)),
        high AS (SELECT aid, max(k)::INTEGER height FROM (SELECT x.aid, x.project_id, count(*) k FROM bar x JOIN bar y ON y.aid = x.aid AND y.s <= x.s AND y.e >= x.s GROUP BY 1, 2) GROUP BY 1)""", "SELECT aid author_id, height, coalesce(sum(height) OVER (ORDER BY aid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM high".replace("", "")),
    "panel_gantt_bars": _with("cur mem", "best AS (SELECT aid FROM mem GROUP BY 1 ORDER BY count(*) DESC, aid LIMIT 10)", "SELECT aid author_id, project_id, start_date AS start, coalesce(effective_completion_date, completion_date, start_date) AS \"end\", 0 AS clashes FROM mem JOIN best USING (aid) JOIN cur ON pid = project_id WHERE start_date IS NOT NULL".replace("", "")),
    "panel_ring": _sql("cur", "SELECT node, cos(2 * pi() * i / n) x, sin(2 * pi() * i / n) y FROM (SELECT project_id node, row_number() OVER (ORDER BY project_id) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT project_id FROM cur WHERE project_id IS NOT NULL ORDER BY 1 LIMIT 500))"),
    "panel_entity_details": _sql("named mem", """SELECT canonical_id, entity_kind, mentions, projects, coalesce(n, 0) authors, sections FROM (SELECT canonical_id, min(entity_kind) entity_kind, count(*) mentions, count(DISTINCT project_id) projects FROM named WHERE entity_kind IN ('organism', 'method', 'database', 'journal', 'function') GROUP BY 1)
        LEFT JOIN (SELECT canonical_id, count(DISTINCT aid) n FROM named JOIN mem ON pid = project_id WHERE entity_kind IN ('organism', 'method', 'database', 'journal', 'function') GROUP BY 1) USING (canonical_id)
        LEFT JOIN (SELECT canonical_id, list(t ORDER BY i) sections FROM (SELECT canonical_id, concat_ws(' / ', project_id, source_doc, source_section) t, row_number() OVER (PARTITION BY canonical_id ORDER BY project_id NULLS LAST, source_doc NULLS LAST, source_section NULLS LAST) i FROM (SELECT DISTINCT canonical_id, project_id, source_doc, source_section FROM named WHERE entity_kind IN ('organism', 'method', 'database', 'journal', 'function'))) WHERE i <= 20 GROUP BY 1) USING (canonical_id)"""),
    "panel_author_details": _sql("lm mem ppl", f"""SELECT aid author_id, {_SHOWN} display_name, n.n projects, coalesce(k.m, 0) mentions, coalesce(k.k, []) kinds, coalesce(i.l, []) AS lines, n.n - coalesce(i.p, 0) projects_outside_lines
        FROM (SELECT aid, count(*) n FROM mem GROUP BY 1) n LEFT JOIN (SELECT aid, {_CUT} d FROM ppl) p USING (aid)
        LEFT JOIN (SELECT aid, sum(n)::BIGINT m, list(entity_kind || ': ' || n ORDER BY entity_kind) k FROM (SELECT aid, entity_kind, count(*) n FROM mem JOIN entity_mentions ON project_id = pid GROUP BY 1, 2) GROUP BY 1) k USING (aid) LEFT JOIN (SELECT aid, list(DISTINCT line_id ORDER BY line_id) l, count(DISTINCT pid) p FROM mem JOIN lm ON project_id = pid GROUP BY 1) i USING (aid)"""),
}
