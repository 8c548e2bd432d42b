"""Single operators of loading, extraction and upkeep, each over the whole delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import parsing as P
from quillon.functions import text as X
from quillon.operators import edges as E
from quillon.operators import extraction as ex
from quillon.operators.scores import standardised
from quillon.plans.derived import delivered
from quillon.plans.oracles import _sql
from quillon.schemas import KEYS, SCHEMAS, key_violations, latest_rows
from quillon.sources import corpus
from quillon.sources.vocab import canonicalise, lookup
from quillon.sources.warehouse import enrich_projects, merge_name_only_authors, missing, upserted

_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[-_/]', '', 'g'), '\\s+', ' ', 'g'))"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '\\*(.+?)\\*', '\\1', 'g'), '__(.+?)__', '\\1', 'g'), '`(.+?)`', '\\1', 'g')"
_FORM = _NORM.format(_PLAIN.format("{}"))


def author_merge(s, sf) -> DataFrame:
    """Authors by their own iD or name; name-only ones move to the single iD of the same name."""
    w = delivered(s, sf)
    people = w.table("authors").select("author_id", "orcid_id", "canonical_name").distinct()
    _, links = merge_name_only_authors(people, w.table("project_authors").select("project_id", "author_id").distinct())
    return links.distinct()


def edge_summary(s, sf) -> DataFrame:
    """The five most cited and the five most citing projects."""
    e = E.declared(delivered(s, sf).table("reuse_edges"))
    top = lambda c, side: e.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("project_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_id").limit(5).select(F.lit(side).alias("side"), "project_id", "n")
    return top("dst", "cited").unionAll(top("src", "citing"))


def edge_classes(s, sf) -> DataFrame:
    w = delivered(s, sf)
    return E.classify_edges(E.declared(w.table("reuse_edges")), E.memberships(w.table("project_authors")))


def degree_table(s, sf) -> DataFrame:
    return E.degrees(edge_classes(s, sf).where("src is not null and dst is not null"))


def two_hop(s, sf) -> DataFrame:
    return E.two_hop(edge_classes(s, sf))


def normal_tokens(s, sf) -> DataFrame:
    d = delivered(s, sf).table("drift_candidates").where("surface_form is not null").select("surface_form").distinct()
    return d.select("surface_form", X.normal_token(F.col("surface_form")).alias("norm"), X.plain_markdown(F.col("surface_form")).alias("plain"))


def canonical_lookup(s, sf) -> DataFrame:
    w = delivered(s, sf)
    forms = lookup(w.table("vocab_entries"), "entity_kind", "entry_id")
    rows = w.table("drift_candidates").select("drift_id", "entity_kind", "surface_form", "llm_proposed_canonical").distinct()
    return canonicalise(rows, "entity_kind", ["llm_proposed_canonical", "surface_form"], forms).where("canonical_match is not null").select("drift_id", "entity_kind", "canonical_match")


def content_hashes(s, sf) -> DataFrame:
    c = delivered(s, sf).table("chunks").where("content is not null").select("section_id", "chunk_idx", "total_chunks", "content").distinct()
    digest = X.content_hash(F.col("content"), F.col("chunk_idx"), F.col("total_chunks"))
    return c.select("section_id", "chunk_idx", "total_chunks", digest.alias("content_hash"), X.cache_key(digest, F.lit("p1"), F.lit("v1"), F.lit("m1")).alias("cache_key"))


def chunk_counts(s, sf) -> DataFrame:
    """Invariants of the chunker: the pieces of a section are within the limit and join to its text."""
    c = delivered(s, sf).table("sections").select("section_id", "content").where("content is not null").distinct()
    keyed = c.select(F.sha2("content", 256).alias("digest"), "content").distinct()
    cut = ex.chunked(keyed, "content", ["digest"])
    back = cut.groupBy("digest").agg(F.count("*").alias("n"), F.sum(F.char_length("chunk")).alias("characters"), F.max(F.char_length("chunk")).alias("longest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda x: x["chunk"]), "").alias("joined"))
    return back.select("digest", F.sha2("joined", 256).alias("joined_digest"), "characters", (F.col("n") == 1).alias("one_piece"), (F.col("longest") <= 12_000).alias("within_limit"))


def cache_split(s, sf) -> DataFrame:
    """Chunks against a cache that has every second answer, one in five of them cut off."""
    keyed = content_hashes(s, sf)
    age = F.length("section_id")
    cache = keyed.where(age % 2 == 0).select("cache_key", "content_hash", F.lit("p1").alias("prompt_version"), F.lit("m1").alias("model_id"), F.lit("{}").alias("response_content"), F.when(age % 5 == 0, '{"finish_reason": "length"}').otherwise('{"finish_reason": "stop"}').alias("response_metadata")).dropDuplicates(["cache_key"])
    hits, misses = ex.cache_split(keyed, cache)
    return hits.select(F.lit("hit").alias("part"), "section_id", "chunk_idx").unionAll(misses.select(F.lit("miss"), "section_id", "chunk_idx")).distinct()


def drift_rolled(s, sf) -> DataFrame:
    w = delivered(s, sf)
    rolled = ex.drift_rollup(w.table("drift_candidates").where("entity_kind not in ('extraction_error', 'parse_error')"), 900, 3, 5.0)
    return rolled.select("entity_kind", "norm", "surface_form", "occurrence_count", "project_count", "file_count", "llm_decision", "llm_proposed_canonical", "llm_notes", "sample_projects")


def drift_quoted(s, sf) -> DataFrame:
    return ex.drift_quotes(delivered(s, sf).table("drift_candidates"))


def cache_figures(s, sf) -> DataFrame:
    keyed = content_hashes(s, sf)
    return ex.cache_stats(keyed.select("cache_key", "content_hash", F.lit("m1").alias("model_id"), F.lit("p1").alias("prompt_version"), F.lit(None).cast("timestamp_ntz").alias("cached_at"))).drop("first_cached", "last_cached")


def _sections(s, sf) -> DataFrame:
    return delivered(s, sf).table("sections").select("section_id", "project_id", F.regexp_replace("source_doc", r"\.md$", "").alias("source_doc"), "h2_text", "content").where("content is not null").distinct()


def parsed_references(s, sf) -> DataFrame:
    """The citations that the stored sections make."""
    found = corpus.references(_sections(s, sf), delivered(s, sf).table("projects"))
    return found.select("edge_id", "src_project_id", "dst_project_id", "source_doc", "source_section", "occurrence_count")


def parsed_documents(s, sf) -> DataFrame:
    """(doc_id, title, headings): the first-level title and the second-level headings of each document, in order."""
    docs = delivered(s, sf).table("documents").select(F.col("doc_id").cast("string").alias("project_id"), F.lit("README").alias("source_doc"), "text").where("text is not null")
    secs = corpus.sections(docs)
    head = F.when(~F.col("h2_text").isin(P.PREAMBLE, P.FRONT_MATTER), F.struct("start_offset", "h2_text"))
    return secs.groupBy(F.col("project_id").cast("long").alias("doc_id")).agg(F.max("h1_text").alias("title"), F.transform(F.sort_array(F.collect_list(head)), lambda x: x["h2_text"]).alias("headings"))


def parsed_bullets(s, sf) -> DataFrame:
    """Name, iD and affiliation of each author bullet that was quoted."""
    quoted = delivered(s, sf).table("project_authors").where("source_quote is not null").select("source_quote").distinct()
    fields = [T.StructField(n, T.StringType()) for n in ("name", "orcid_id", "affiliation")]
    return corpus.expand(quoted, ["source_quote"], fields, lambda r: P.authors(r["source_quote"]))


def parsed_notebooks(s, sf) -> DataFrame:
    """Title and cells of notebooks of one Markdown cell and one code cell."""
    docs = delivered(s, sf).table("documents").where("source = 'notebook_cell' and text is not null")
    cell = lambda kind, text: F.struct(F.lit(kind).alias("cell_type"), F.array(text).alias("source"))
    books = docs.select("doc_id", F.to_json(F.struct(F.array(cell("code", F.lit("x = 1")), cell("markdown", F.col("text"))).alias("cells"))).alias("text"))
    own = ("title_from_first_md_cell", "total_cells", "markdown_cells", "code_cells")
    return corpus.expand(books, ["doc_id"], [SCHEMAS["notebooks"][n] for n in own], lambda r: [P.notebook("01_x.ipynb", r["text"])])


def parsed_answers(s, sf) -> DataFrame:
    """Model answers made of the candidates, in a fence, with a comma too many, or as they are, read back."""
    d = delivered(s, sf).table("drift_candidates").where("entity_kind = 'organism' and surface_form is not null").select("drift_id", "surface_form", "llm_proposed_canonical").distinct()
    said = F.to_json(F.struct(F.array(F.struct("surface_form", F.col("llm_proposed_canonical").alias("canonical_name"))).alias("organisms")))
    way = F.length("drift_id") % 3
    text = F.when(way == 0, F.concat(F.lit("Here it is:\n```json\n"), said, F.lit("\n```"))).when(way == 1, F.concat(F.substring(said, F.lit(1), F.length(said) - 2), F.lit(",]}"))).otherwise(said)
    answers = d.select(F.col("drift_id").alias("section_id"), F.lit("p").alias("project_id"), F.lit("README").alias("source_doc"), F.lit("h").alias("h2_text"), F.lit(0).alias("chunk_idx"), text.alias("response_content"))
    return ex.parse_answers(answers).select(F.col("section_id").alias("drift_id"), "entity_kind", "surface", "proposed").distinct()


def drift_alias_lists(s, sf) -> DataFrame:
    return ex.drift_aliases(delivered(s, sf).table("drift_candidates").select("drift_id", "entity_kind", "surface_form", "llm_suggested_aliases").distinct())


def extractable_sections(s, sf) -> DataFrame:
    rows = delivered(s, sf).table("sections").select("section_id", "project_id", F.regexp_replace("source_doc", r"\.md$", "").alias("source_doc"), "h2_text", "content").distinct()
    return ex.to_extract(rows).select("section_id", "source_doc", "h2_text").distinct()


def display_names(s, sf) -> DataFrame:
    n = delivered(s, sf).table("authors").select("canonical_name").distinct()
    return n.select("canonical_name", X.display_name(F.col("canonical_name")).alias("display_name"))


def identifiers(s, sf) -> DataFrame:
    w = delivered(s, sf)
    e = w.table("reuse_edges").where("src_project_id is not null and dst_project_id is not null").select(F.lit("edge").alias("kind"), X.edge_id(F.col("src_project_id"), F.col("dst_project_id"), F.col("source_doc"), F.col("source_section")).alias("id"))
    a = w.table("authors").select(F.lit("author").alias("kind"), X.author_id(F.col("orcid_id"), F.col("canonical_name")).alias("id"))
    x = w.table("sections").select(F.lit("section").alias("kind"), X.section_id(F.col("project_id"), F.col("source_doc"), F.col("h2_text"), F.col("start_offset")).alias("id"))
    r = w.table("project_revisions").select(F.lit("revision").alias("kind"), X.revision_id(F.col("project_id"), F.col("source_doc"), F.col("version_label"), F.col("change_description")).alias("id"))
    return e.unionAll(a).unionAll(x).unionAll(r).distinct()


def violations(s, sf) -> DataFrame:
    w = delivered(s, sf)
    out = None
    for t in ("projects", "authors", "sections", "reuse_edges", "entity_mentions", "drift_candidates"):
        part = key_violations(w.table(t), KEYS[t]).select(F.lit(t).alias("table_name"), F.col(KEYS[t][0]).alias("key"), "n_rows", "reason")
        out = part if out is None else out.unionAll(part)
    return out


def current_rows(s, sf) -> DataFrame:
    return latest_rows(delivered(s, sf).table("projects"), ["project_id"]).select("project_id", "observed_at", "total_bytes", "revision_depth")


def upsert(s, sf) -> DataFrame:
    """Scores of projects with a revision history replace those of all projects."""
    p = delivered(s, sf).table("projects").select("project_id", "revision_depth").distinct()
    return upserted(p.select("project_id", F.lit(0).alias("v")), p.where("revision_depth is not null").select("project_id", F.col("revision_depth").alias("v")), ["project_id"])


def append_new(s, sf) -> DataFrame:
    """Edges whose citing project is not in the projects table: what an incremental run would still add."""
    w = delivered(s, sf)
    return missing(w.table("reuse_edges").where("src_project_id is not null").select(F.col("src_project_id").alias("project_id")).distinct(), w.table("projects"), ["project_id"])


def purge(s, sf) -> DataFrame:
    w = delivered(s, sf)
    return w.table("entity_mentions").select("mention_id", "section_id").distinct().join(w.table("sections").select("section_id").distinct(), "section_id", "left_semi")


def enriched(s, sf) -> DataFrame:
    w = delivered(s, sf)
    bare = w.table("projects").select("project_id", F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("completion_date"), F.lit(None).cast("int").alias("revision_depth"), F.lit(None).cast("date").alias("effective_completion_date")).distinct()
    return enrich_projects(bare, w.table("project_revisions"))


def standard_scores(s, sf) -> DataFrame:
    p = delivered(s, sf).table("projects").select("project_id", "total_bytes", "file_count").distinct()
    return standardised(p, ["total_bytes", "file_count"], F.col("file_count").isNotNull(), ("total_bytes",)).select("project_id", "z_total_bytes", "z_file_count")


QUERIES = {f.__name__: f for f in (
    author_merge, edge_summary, edge_classes, degree_table, two_hop, normal_tokens, canonical_lookup, content_hashes, chunk_counts, cache_split, drift_rolled, drift_quoted, drift_alias_lists, cache_figures, parsed_references, parsed_documents, parsed_bullets, parsed_notebooks, parsed_answers, extractable_sections, display_names, identifiers, violations, current_rows, upsert, append_new, purge, enriched, standard_scores,
)}

_HASH = "sha256(CASE WHEN total_chunks > 1 THEN content || '|chunk=' || chunk_idx || '/' || total_chunks ELSE content END)"
_CACHE = f"SELECT DISTINCT section_id, chunk_idx, total_chunks, {_HASH} content_hash, sha256({_HASH} || '|p1|v1|m1') cache_key FROM chunks WHERE content IS NOT NULL"
SQL = {
    "author_merge": """WITH a AS (SELECT DISTINCT author_id, orcid_id, canonical_name FROM authors), t AS (SELECT canonical_name, min(author_id) tgt FROM a WHERE orcid_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT author_id) = 1)
        SELECT DISTINCT p.project_id, coalesce(m.tgt, p.author_id) author_id FROM project_authors p LEFT JOIN (SELECT a.author_id, t.tgt FROM a JOIN t USING (canonical_name) WHERE a.orcid_id IS NULL) m USING (author_id)""",
    "edge_summary": _sql("dec", "SELECT * FROM (SELECT 'cited' side, dst project_id, count(*) n FROM dec WHERE dst IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'citing', src, count(*) n FROM dec WHERE src IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)"),
    "edge_classes": _sql("cls", "SELECT src, dst, shared, src_has, dst_has, NOT shared AS loose, NOT shared AND src_has AND dst_has AS strict, NOT (NOT shared AND src_has AND dst_has) AS own FROM cls"),
    "degree_table": _sql("cls", "SELECT pid, sum(i)::BIGINT in_degree, sum(o)::BIGINT out_degree, sum(si)::BIGINT self_in_degree, sum(so)::BIGINT self_out_degree FROM (SELECT dst pid, (NOT shared)::INT i, 0 o, shared::INT si, 0 so FROM cls WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT src, 0, (NOT shared)::INT, 0, shared::INT FROM cls WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY 1"),
    "two_hop": _sql("cls", "SELECT y.dst pid, count(DISTINCT x.src) two_hop_in_degree FROM cls x JOIN cls y ON x.dst = y.src WHERE NOT (x.shared OR y.shared) AND x.src <> y.dst GROUP BY 1"),
    "normal_tokens": f"SELECT DISTINCT surface_form, {_NORM.format('surface_form')} norm, {_PLAIN.format('surface_form')} plain FROM drift_candidates WHERE surface_form IS NOT NULL",
    "canonical_lookup": f"""WITH f AS (SELECT entity_kind kind, {_FORM.format('form')} norm, first(canonical ORDER BY entry_id, canonical) c FROM (SELECT entity_kind, entry_id, canonical, unnest(list_prepend(canonical, coalesce(aliases, []))) form FROM vocab_entries) GROUP BY 1, 2)
        SELECT DISTINCT drift_id, entity_kind, coalesce(a.c, b.c) canonical_match FROM drift_candidates d LEFT JOIN f a ON a.kind = entity_kind AND a.norm = {_FORM.format('llm_proposed_canonical')} LEFT JOIN f b ON b.kind = entity_kind AND b.norm = {_FORM.format('surface_form')} WHERE coalesce(a.c, b.c) IS NOT NULL""",
    "content_hashes": _CACHE,
    "chunk_counts": "SELECT DISTINCT sha256(content) digest, sha256(content) joined_digest, length(content) AS characters, length(content) <= 12000 AS one_piece, TRUE AS within_limit FROM sections WHERE content IS NOT NULL",
    "cache_split": f"WITH k AS ({_CACHE}), c AS (SELECT DISTINCT cache_key FROM k WHERE length(section_id) % 2 = 0 AND length(section_id) % 5 <> 0) SELECT DISTINCT CASE WHEN cache_key IN (SELECT cache_key FROM c) THEN 'hit' ELSE 'miss' END part, section_id, chunk_idx FROM k",
    "drift_rolled": f"SELECT entity_kind, {_NORM.format('surface_form')} norm, first(surface_form ORDER BY drift_id) surface_form, count(*) occurrence_count, count(DISTINCT project_id) project_count, count(DISTINCT project_id || '/' || source_doc) file_count, first(llm_decision ORDER BY drift_id) FILTER (WHERE llm_decision <> '') llm_decision, first(llm_proposed_canonical ORDER BY drift_id) FILTER (WHERE llm_proposed_canonical <> '') llm_proposed_canonical, first(llm_notes ORDER BY drift_id) FILTER (WHERE llm_notes <> '') llm_notes, list(DISTINCT project_id ORDER BY project_id)[1:5] sample_projects FROM drift_candidates WHERE surface_form IS NOT NULL AND entity_kind NOT IN ('extraction_error', 'parse_error') GROUP BY 1, 2 HAVING count(DISTINCT project_id || '/' || source_doc) >= 3 OR count(DISTINCT project_id) >= 3",
    "drift_quoted": f"SELECT entity_kind, norm, drift_id, source_quote FROM (SELECT DISTINCT entity_kind, {_NORM.format('surface_form')} norm, drift_id, source_quote FROM drift_candidates WHERE surface_form IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY entity_kind, norm ORDER BY drift_id, source_quote NULLS LAST) <= 3",
    "drift_alias_lists": f"""WITH r AS (SELECT DISTINCT drift_id, entity_kind, {_NORM.format('surface_form')} norm, CASE WHEN json_valid(llm_suggested_aliases) THEN json_extract_string(llm_suggested_aliases, '$[*]') END l FROM drift_candidates WHERE surface_form IS NOT NULL),
        e AS (SELECT entity_kind, norm, drift_id, unnest(l) alias, generate_subscripts(l, 1) i FROM r)
        SELECT entity_kind, norm, list(alias ORDER BY pos) aliases FROM (SELECT entity_kind, norm, alias, min((drift_id, i)) AS pos FROM e GROUP BY ALL) GROUP BY 1, 2""",
    "extractable_sections": "SELECT DISTINCT section_id, regexp_replace(source_doc, '\\.md$', '') AS source_doc, h2_text FROM sections WHERE regexp_replace(source_doc, '\\.md$', '') IN ('README', 'RESEARCH_PLAN', 'REPORT', 'REVIEW', 'references_md') AND h2_text NOT IN ('__frontmatter__', '__preamble__', 'Reproduction', 'Quick Links', 'Code Quality', 'Review Metadata', 'Project Structure', 'Dependencies', 'Acknowledgments', 'Data Availability') AND length(trim(content)) >= 80",
    "cache_figures": f"SELECT count(*) entries, count(DISTINCT content_hash) contents, count(DISTINCT 'm') models, count(DISTINCT 'p') prompts FROM ({_CACHE})",
    "parsed_references": """WITH s AS (SELECT DISTINCT section_id, project_id, regexp_replace(source_doc, '\\.md$', '') doc, h2_text, content FROM sections WHERE content IS NOT NULL), p AS (SELECT DISTINCT project_id AS id FROM projects),
        w AS (SELECT section_id, project_id, doc, h2_text, word, count(*) n FROM (SELECT section_id, project_id, doc, h2_text, unnest(string_split(content, '`')[2:-2]) word FROM s) GROUP BY ALL)
        SELECT project_id || '->' || concat_ws(':', word, doc, h2_text) edge_id, project_id src_project_id, word dst_project_id, doc AS source_doc, h2_text source_section, sum(n)::INTEGER occurrence_count FROM w JOIN p ON id = word WHERE word <> project_id GROUP BY ALL""",
    "parsed_documents": r"""SELECT doc_id, nullif(regexp_extract(text, '(?m)^#[\s\p{Z}]+(.+?)[\s\p{Z}]*$', 1), '') title, regexp_extract_all(text, '(?m)^##[\s\p{Z}]+(.+?)[\s\p{Z}]*$', 1) headings FROM documents WHERE trim(text, E' \n\r\t\f') <> ''""",
    "parsed_bullets": r"""SELECT DISTINCT source_quote, trim(regexp_replace(split_part(body, ',', 1), '\*{1,2}([^*]+)\*{1,2}', '\1', 'g')) AS name, nullif(o, '') orcid_id, nullif(trim(substr(body, instr(body, ',') + 1)), '') affiliation
        FROM (SELECT source_quote, regexp_extract(source_quote, '\d{4}-\d{4}-\d{4}-\d{3}[\dX]') o, trim(regexp_replace(regexp_replace(regexp_replace(source_quote, '^[-*]\s+', ''), '(https?://\S*?)?\d{4}-\d{4}-\d{4}-\d{3}[\dX]', ''), 'ORCID:\s*|\(\s*(ORCID:)?\s*\)', '', 'g')) || CASE WHEN contains(source_quote, ',') THEN '' ELSE ',' END body FROM project_authors WHERE source_quote IS NOT NULL)""",
    "parsed_notebooks": r"SELECT doc_id, nullif(regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1), '') title_from_first_md_cell, 2 total_cells, 1 markdown_cells, 1 code_cells FROM documents WHERE source = 'notebook_cell' AND text IS NOT NULL",
    "parsed_answers": "SELECT DISTINCT drift_id, 'organism' entity_kind, surface_form surface, coalesce(nullif(llm_proposed_canonical, ''), surface_form) proposed FROM drift_candidates WHERE entity_kind = 'organism' AND surface_form <> ''",
    "display_names": r"SELECT DISTINCT canonical_name, CASE WHEN coalesce(d, '') = '' THEN '(unknown)' ELSE d END display_name FROM (SELECT canonical_name, trim(regexp_replace(regexp_replace(regexp_replace(canonical_name, '\([^)]*\)', ' ', 'g'), '\s*(—|–|\s-\s|\|).*$', '', 'g'), '\s+', ' ', 'g')) d FROM authors)",
    "identifiers": _sql("rev", """SELECT DISTINCT kind, id FROM (SELECT 'edge' kind, src_project_id || '->' || concat_ws(':', dst_project_id, source_doc, source_section) id FROM reuse_edges WHERE src_project_id IS NOT NULL AND dst_project_id IS NOT NULL
        UNION ALL SELECT 'author', CASE WHEN orcid_id IS NULL THEN 'name:' || replace(lower(canonical_name), ' ', '_') ELSE 'orcid:' || orcid_id END FROM authors UNION ALL SELECT 'section', concat_ws(':', project_id, source_doc, h2_text, start_offset) FROM sections
        UNION ALL SELECT 'revision', concat_ws(':', project_id, source_doc, version_label) || '#' || left(sha256(change_description), 8) FROM rev)"""),
    "violations": " UNION ALL ".join(f"SELECT '{t}' table_name, {KEYS[t][0]} AS key, count(*) n_rows, CASE WHEN {KEYS[t][0]} IS NULL THEN 'null key' ELSE 'repeated key' END reason FROM {t} GROUP BY {KEYS[t][0]} HAVING count(*) > 1 OR {KEYS[t][0]} IS NULL" for t in ("projects", "authors", "sections", "reuse_edges", "entity_mentions", "drift_candidates")),
    "current_rows": "SELECT project_id, max(observed_at) observed_at, any_value(total_bytes) total_bytes, any_value(revision_depth) revision_depth FROM projects GROUP BY 1",
    "upsert": "SELECT DISTINCT project_id, coalesce(revision_depth, 0) v FROM projects",
    "append_new": "SELECT DISTINCT src_project_id project_id FROM reuse_edges WHERE src_project_id IS NOT NULL AND src_project_id NOT IN (SELECT project_id FROM projects WHERE project_id IS NOT NULL)",
    "purge": "SELECT DISTINCT section_id, mention_id FROM entity_mentions WHERE EXISTS (SELECT 1 FROM sections s WHERE s.section_id = entity_mentions.section_id)",
    "enriched": _sql("rev", "SELECT p.project_id, min(version_date) start_date, max(version_date) completion_date, nullif(count(version_date), 0)::INTEGER revision_depth, max(version_date) effective_completion_date FROM (SELECT DISTINCT project_id FROM projects) p LEFT JOIN rev USING (project_id) GROUP BY 1"),
    "standard_scores": "WITH p AS (SELECT DISTINCT project_id, ln(1 + total_bytes) b, file_count::DOUBLE f FROM projects), s AS (SELECT avg(b) mb, stddev_pop(b) sb, avg(f) mf, stddev_pop(f) sf FROM p WHERE f IS NOT NULL) SELECT project_id, CASE WHEN sb = 0 THEN 0 ELSE (b - mb) / sb END z_total_bytes, CASE WHEN sf = 0 THEN 0 ELSE (f - mf) / sf END z_file_count FROM p, s",
}
