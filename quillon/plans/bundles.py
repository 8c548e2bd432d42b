"""What a model is given to read: the bundles, as tables with a part name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import matched
from quillon.operators.pairs import underexplored_pairs
from quillon.plans import panels
from quillon.plans.derived import delivered
from quillon.plans.oracles import _GAPS, _K4, _sql, _with
from quillon.plans.views import FAILURES
from quillon.sources.warehouse import Warehouse


def line_entities(w: Warehouse, lines: int = 10, top: int = 3) -> DataFrame:
    """(line_id, entity_kind, canonical_id, n): the most mentioned organisms and methods of the largest lines."""
    from quillon.operators.ranking import first_k

    held = panels._line_members(w)
    best = held.select("line_id", "member_count").distinct().orderBy(F.desc("member_count"), "line_id").limit(lines).select("line_id")
    member = held.join(best, "line_id", "left_semi").select("line_id", "project_id")
    named = w.table("entity_mentions").where(F.col("entity_kind").isin("organism", "method") & matched(F.col("canonical_id")))
    counted = named.join(member, "project_id").groupBy("line_id", "entity_kind", "canonical_id").agg(F.count("*").alias("n"))
    return first_k(counted, ["line_id", "entity_kind"], [F.desc("n"), F.asc("canonical_id")], top)


def drift_heavy(w: Warehouse, least: int = 3, top: int = 10) -> DataFrame:
    rolled = w.table("drift_candidates").where(~F.col("entity_kind").isin(FAILURES)).groupBy("entity_kind", "surface_form").agg(F.max("llm_proposed_canonical").alias("proposed_canonical"), F.count("*").alias("mentions"), F.count_distinct("project_id").alias("project_count"))
    return rolled.where(F.col("mentions") >= least).orderBy(F.desc("mentions"), "entity_kind", F.asc_nulls_last("surface_form")).limit(top)


def plausible(w: Warehouse, least: float = 0.5, top: int = 15) -> DataFrame:
    return w.table("combination_plausibility").where(F.col("plausibility") >= least).orderBy(F.desc("plausibility"), "a_canonical", "b_canonical").limit(top)


def axis_statistics(w: Warehouse) -> DataFrame:
    """(axis, n, sd, low, high, above, below): spread of each axis by the sample deviation, over scored projects."""
    scored = w.table("sophistication_composite").where("not too_early")
    axes = ("depth", "breadth", "influence", "integration", "self_follow_on")
    long = scored.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_score").alias("s")) for a in axes))).alias("x")).select("x.axis", "x.s")
    return long.groupBy("axis").agg(F.count("s").alias("n"), F.stddev_samp("s").alias("sd"), F.min("s").alias("low"), F.max("s").alias("high"), F.count_if(F.col("s") >= 1).alias("above"), F.count_if(F.col("s") <= -1).alias("below"))


def mixes(w: Warehouse) -> DataFrame:
    """(part, label, n): how citations and revisions divide among their kinds."""
    e = w.table("edge_classifications").groupBy(F.lit("edges").alias("part"), F.col("edge_type").alias("label")).agg(F.count("*").alias("n"))
    return e.unionAll(w.table("revision_kinds").groupBy(F.lit("revisions"), "kind").agg(F.count("*")))


def forward(w: Warehouse) -> dict[str, DataFrame]:
    """The bundle for recommendations."""
    kinds = ("organism", "method", "database", "function")
    return {**{f"top_{k}": panels.top_names(w, k, 10) for k in kinds}, "research_lines": w.table("research_lines").orderBy(F.desc("member_count"), "line_id").limit(10), "line_entities": line_entities(w), "dark_matter": panels.dark_matter(w, 20, kinds), "under_explored": plausible(w), "drift_candidates": drift_heavy(w)}


def backward(w: Warehouse) -> dict[str, DataFrame]:
    """The bundle for findings."""
    kinds = ("organism", "method", "database", "function")
    return {"summary": panels.summary(w), **{f"top_{k}": panels.top_names(w, k, 5) for k in kinds}, "research_lines": w.table("research_lines").orderBy(F.desc("member_count"), "line_id").limit(5), "mixes": mixes(w), "plausible": plausible(w), "axes": axis_statistics(w)}


def consistent(w: Warehouse, sampled: bool) -> bool:
    """Journals and functions come from one extraction: if one has mentions and the other has none, the
    extraction is half done, unless it is known to be a sample."""
    kinds = {r[0] for r in w.table("entity_mentions").where("entity_kind in ('journal', 'function')").select("entity_kind").distinct().collect()}
    return sampled or len(kinds) != 1


QUERIES = {
    "bundle_line_entities": lambda s, sf: line_entities(delivered(s, sf)), "bundle_drift": lambda s, sf: drift_heavy(delivered(s, sf)), "bundle_axes": lambda s, sf: axis_statistics(delivered(s, sf)), "bundle_mixes": lambda s, sf: mixes(delivered(s, sf)),
    "bundle_plausible": lambda s, sf: plausible(delivered(s, sf)).select("a_kind", "a_canonical", "b_kind", "b_canonical", "plausibility"),
    "bundle_candidate_pairs": lambda s, sf: underexplored_pairs(delivered(s, sf).table("entity_mentions")),
}
_AXES = " UNION ALL ".join(f"SELECT '{a}' axis, {a}_score s FROM sc WHERE NOT too_early" for a in ("depth", "breadth", "influence", "integration", "self_follow_on"))
SQL = {
    "bundle_line_entities": _sql("lm named", "SELECT line_id, entity_kind, canonical_id, n FROM (SELECT line_id, entity_kind, canonical_id, count(*) n FROM lm JOIN named USING (project_id) WHERE entity_kind IN ('organism', 'method') AND line_id IN (SELECT line_id FROM lm GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY line_id, entity_kind ORDER BY n DESC, canonical_id) <= 3"),
    "bundle_drift": "SELECT entity_kind, surface_form, max(llm_proposed_canonical) proposed_canonical, count(*) mentions, count(DISTINCT project_id) project_count FROM drift_candidates WHERE entity_kind NOT IN ('parse_error', 'extraction_error') GROUP BY 1, 2 HAVING count(*) > 2 ORDER BY 4 DESC, 1, 2 NULLS LAST LIMIT 10",
    "bundle_axes": _sql("sc", f"SELECT axis, count(s) n, stddev_samp(s) sd, min(s) low, max(s) high, count_if(s >= 1) above, count_if(s <= -1) below FROM ({_AXES}) GROUP BY 1"),
    "bundle_mixes": _sql("ec rk", "SELECT 'edges' part, edge_type AS label, count(*) n FROM ec GROUP BY 2 UNION ALL SELECT 'revisions', kind, count(*) FROM rk GROUP BY 2"),
    "bundle_plausible": _with("have", _GAPS.format(kinds=_K4), "SELECT * FROM (SELECT a_kind, a_canonical, b_kind, b_canonical, ((length(a_canonical) + length(b_canonical)) % 10) / 10.0::DOUBLE plausibility FROM (SELECT * FROM cand ORDER BY a_count * b_count DESC, a_kind, a_canonical, b_kind, b_canonical LIMIT 40)) WHERE plausibility >= 0.5 ORDER BY plausibility DESC, a_canonical, b_canonical LIMIT 15"),
    "bundle_candidate_pairs": _with("have", _GAPS.format(kinds=_K4), "SELECT a_kind, a_canonical, b_kind, b_canonical, a_count, b_count, actual FROM cand ORDER BY a_count * b_count DESC, a_kind, a_canonical, b_kind, b_canonical LIMIT 40"),
}
