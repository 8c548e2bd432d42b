"""The warehouse tables: columns, types and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "d": T.DateType(), "t": T.TimestampNTZType(), "f": T.FloatType(), "x": T.DoubleType()}

# fixed values: column names and types of the tables, as name:type, and the key in brackets
_TABLES = {
    "runs": "[run_id] run_id:s started_at:t finished_at:t projects_root:s project_count:i status:s notes:s",
    "projects": "[project_id] project_id:s root_path:s name:s last_touched:t is_git_repo:b repo_role:s total_bytes:l file_count:i has_notebooks:b notebook_count:i has_data_dir:b has_figures_dir:b has_references_md:b canonical_docs_present:s file_type_counts:s start_date:d completion_date:d effective_completion_date:d revision_depth:i review_date:d review_reviewer:s observed_at:t",
    "project_revisions": "[revision_id] revision_id:s project_id:s source_doc:s version_label:s version_date:d date_precision:s change_description:s source_quote:s observed_at:t",
    "authors": "[author_id] author_id:s orcid_id:s canonical_name:s affiliation:s first_seen_in_project_id:s observed_at:t",
    "project_authors": "[] project_id:s author_id:s role:s source_doc:s source_quote:s observed_at:t",
    "sections": "[section_id] section_id:s project_id:s source_doc:s h1_text:s h2_text:s content:s start_offset:i end_offset:i byte_size:i observed_at:t",
    "notebooks": "[notebook_id] notebook_id:s project_id:s notebook_number:i notebook_suffix:s filename:s relative_path:s title_from_first_md_cell:s goal_phrase:s total_cells:i markdown_cells:i code_cells:i raw_cells:i byte_size:l has_outputs:b first_mtime:t observed_at:t",
    "reuse_edges": "[edge_id] edge_id:s src_project_id:s dst_project_id:s confidence_tier:s source_doc:s source_section:s source_quote:s occurrence_count:i observed_at:t",
    "entities": "[entity_id] entity_id:s entity_kind:s canonical_id:s display_name:s observed_at:t",
    "entity_mentions": "[mention_id] mention_id:s project_id:s section_id:s source_doc:s source_section:s entity_kind:s canonical_id:s surface_form:s source_quote:s confidence:f extraction_source:s prompt_version:s vocab_version:s model_id:s extra_json:s observed_at:t",
    "drift_candidates": "[drift_id] drift_id:s project_id:s section_id:s source_doc:s source_section:s entity_kind:s surface_form:s source_quote:s llm_proposed_canonical:s llm_suggested_aliases:s llm_notes:s llm_decision:s vocab_version:s prompt_version:s model_id:s observed_at:t",
    "sophistication_composite": "[project_id] project_id:s depth_score:x breadth_score:x influence_score:x integration_score:x self_follow_on_score:x too_early:b partial_phase_2b:b revision_count:l notebook_count:l canonical_doc_bytes:l days_active:l conclusion_count:l distinct_organism_count:l distinct_method_count:l distinct_database_count:l in_degree:l two_hop_in_degree:l cross_author_downstream:l out_degree:l distinct_prior_authors:l self_in_degree:l self_out_degree:l observed_at:t",
    "research_lines": "[line_id] line_id:s line_name:s member_count:l distinct_author_count:l cross_author_handoffs:l self_iterations:l citation_edge_count:l topic_edge_count:l sub_cluster_count:l earliest_start:d latest_completion:d depth_mean:x breadth_mean:x influence_mean:x integration_mean:x self_follow_on_mean:x total_revisions:l total_conclusions:l total_notebooks:l member_ids:s distinct_author_ids:s observed_at:t",
    "research_line_subclusters": "[sub_id] sub_id:s line_id:s sub_index:i member_count:l member_ids:s top_organisms:s top_methods:s top_databases:s observed_at:t",
    "edge_classifications": "[edge_id] edge_id:s src_project_id:s dst_project_id:s edge_type:s confidence:x rationale:s source_quote:s prompt_version:s model_id:s observed_at:t",
    "revision_kinds": "[revision_id] revision_id:s project_id:s kind:s confidence:x rationale:s prompt_version:s model_id:s observed_at:t",
    "recommendations": "[rec_id] rec_id:s rec_index:i title:s rationale:s priority:s gap_type:s evidence_json:s estimated_effort:s plausibility:x prompt_version:s model_id:s observed_at:t",
    "findings": "[finding_id] finding_id:s finding_index:i claim:s so_what:s so_what_detail:s confidence:x evidence_json:s prompt_version:s model_id:s observed_at:t",
    "combination_plausibility": "[a_kind a_canonical b_kind b_canonical] a_kind:s a_canonical:s b_kind:s b_canonical:s plausibility:x rationale:s prompt_version:s model_id:s observed_at:t",
    "extraction_cache": "[cache_key] cache_key:s content_hash:s prompt_version:s vocab_version:s model_id:s response_content:s response_metadata:s cached_at:t",
    "vocab_entries": "[vocab_name canonical] entry_id:l vocab_name:s entity_kind:s canonical:s aliases:a doc_local_aliases:a notes:s vocab_version:i",
}

SCHEMAS: dict[str, T.StructType] = {}
KEYS: dict[str, list[str]] = {}
for _name, _text in _TABLES.items():
    _key, _columns = _text[1:].split("]", 1)
    KEYS[_name] = _key.split()
    SCHEMAS[_name] = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if t == "a" else _TYPES[t]) for c, t in (x.split(":") for x in _columns.split())])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns in order and type; a column that is missing is null, others go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, reason) of keys that are null in part or come more than once."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    counted = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return counted.where(missing | (F.col("n_rows") > 1)).withColumn("reason", F.when(missing, "null key").otherwise("repeated key"))


def latest_rows(df: DataFrame, keys: list[str], order_col: str = "observed_at") -> DataFrame:
    """One row for each key, the one observed last; among equals the greatest row, so the result is
    definite. Aggregated map-side, a key's rows are never gathered."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    best = F.max(F.struct(F.col(order_col), *(F.col(c) for c in rest)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))
