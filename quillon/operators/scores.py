"""Standardised multi-axis scores of projects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import days_between
from quillon.operators import edges as E
from quillon.session import Workspace

# fixed values: the ingredients of each axis and their weights
AXES = {
    "depth": {"revision_count": 1.0, "notebook_count": 1.0, "canonical_doc_bytes": 1.0, "days_active": 1.0, "conclusion_count": 1.0},
    "breadth": {"distinct_organism_count": 1.0, "distinct_method_count": 1.0, "distinct_database_count": 1.0, "distinct_environment_count": 1.0, "journal_diversity": 1.0},
    "influence": {"in_degree": 1.0, "two_hop_in_degree": 0.5, "cross_author_downstream": 1.0},
    "integration": {"out_degree": 1.0, "distinct_prior_authors": 1.0, "shared_external_citation": 1.0},
    "self_follow_on": {"self_in_degree": 1.0, "self_out_degree": 1.0},
}
LOGGED = ("canonical_doc_bytes", "days_active", "distinct_organism_count")
#: Not collected yet; they are zero for all, but their weight counts in the axis.
CONSTANT_ZERO = ("distinct_environment_count", "journal_diversity", "shared_external_citation")


@dataclass
class ScoreConfig:
    axes: dict[str, dict[str, float]] = field(default_factory=lambda: {a: dict(w) for a, w in AXES.items()})
    logged: tuple[str, ...] = LOGGED
    min_revisions: int = 1
    min_bytes: int = 500


def ingredients(projects: DataFrame, sections: DataFrame, mentions: DataFrame, reuse: DataFrame, project_authors: DataFrame) -> DataFrame:
    """One row for each row of ``projects`` with all ingredients, 0 where there is nothing."""
    # rows of equal names are counted together first, so each row is read and moved once
    counted = F.col("entity_kind").isin("organism", "method", "database") & F.col("canonical_id").isNotNull()
    rolled = mentions.where(counted | (F.col("entity_kind") == "conclusion")).groupBy("project_id", "entity_kind", F.when(counted, F.col("canonical_id")).alias("name")).agg(F.count("*").alias("n"))
    is_kind = lambda k: F.col("entity_kind") == k
    kinds = {f"distinct_{k}_count": F.when(is_kind(k), 1) for k in ("organism", "method", "database")}
    counts = {"conclusion_count": F.when(is_kind("conclusion"), F.col("n"))} | kinds
    # both have the same columns, so that they are summed together and met once; the graph is counted meanwhile
    summed = ("canonical_doc_bytes", *counts)
    part = lambda df, found: df.select("project_id", *(found.get(n, F.lit(None)).cast("long").alias(n) for n in summed))
    found = part(sections, {"canonical_doc_bytes": F.col("byte_size")}).unionAll(part(rolled, counts)).groupBy("project_id").agg(*(F.sum(n).alias(n) for n in summed))
    graph = E.neighbourhoods(reuse, project_authors)
    base = projects.select(
        "project_id", F.coalesce("revision_depth", F.lit(0)).alias("revision_count"), F.coalesce("notebook_count", F.lit(0)).alias("notebook_count"), F.coalesce(days_between(F.col("start_date"), F.col("completion_date")), F.lit(0)).alias("days_active")
    )
    joined = base.join(found, "project_id", "left").join(graph.withColumnRenamed("pid", "project_id"), "project_id", "left")
    names = list(dict.fromkeys(n for w in AXES.values() for n in w))
    # written, as means and deviations and the scores themselves read it
    return Workspace(projects.sparkSession).keep(joined.select("project_id", *((F.lit(0) if n in CONSTANT_ZERO else F.coalesce(F.col(n), F.lit(0))).cast("long").alias(n) for n in names)))


def standardised(df: DataFrame, names: list[str], active: Column, logged: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a column z_<name> for each name: (x - mean) / population deviation over the active
    rows, 0 where all are equal. One aggregate row is computed, written and joined; no window over everything."""
    value = {n: (F.log1p(F.col(n)) if n in logged else F.col(n).cast("double")) for n in names}
    stats = df.where(active).agg(*(f(value[n]).alias(f"_{p}_{n}") for n in names for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    wide = df.crossJoin(F.broadcast(Workspace(df.sparkSession).keep(stats)))
    z = [F.when(F.coalesce(F.col(f"_s_{n}"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((value[n] - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).alias(f"z_{n}") for n in names]
    return wide.select(*df.columns, *z)


def axis_scores(raw: DataFrame, any_mentions: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """``raw`` with <axis>_score, too_early and partial_phase_2b.

    Projects that are too early take no part in means and deviations and have null scores. Components
    of weight 0 don't count. ``partial_phase_2b`` tells that ``any_mentions`` is empty.
    """
    config = config or ScoreConfig()
    names = list(dict.fromkeys(n for w in config.axes.values() for n in w))
    early = (F.col("revision_count") < config.min_revisions) & (F.col("canonical_doc_bytes") < config.min_bytes)
    scored = standardised(raw.withColumn("too_early", early), names, ~F.col("too_early"), config.logged)
    out = []
    for axis, weights in config.axes.items():
        used = {n: w for n, w in weights.items() if w}
        total = sum(used.values())
        score = sum((F.col(f"z_{n}") * w for n, w in used.items()), F.lit(0.0)) / total if total else F.lit(0.0)
        out.append(F.when(~F.col("too_early"), score).alias(f"{axis}_score"))
    return scored.select("project_id", *out, "too_early", F.lit(any_mentions.isEmpty()).alias("partial_phase_2b"), *names)
