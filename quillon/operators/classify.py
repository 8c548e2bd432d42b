"""Labelling rows by a model, once for each version of the prompt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.pairs import underexplored_pairs
from quillon.schemas import KEYS, conform
from quillon.session import Workspace
from quillon.sources.warehouse import Warehouse

# fixed values: the label sets of the classifiers
EDGE_TYPES = ["deepening", "branching", "synthesis", "other"]
REVISION_KINDS = ["scope_expansion", "bug_fix", "refactor", "new_result", "methodology_update", "clarification", "other"]


class Labeller(Protocol):
    model_id: str

    def label(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """(label, confidence, rationale) for each text."""


def unlabelled(rows: DataFrame, known: DataFrame, keys: list[str], prompt_version: str) -> DataFrame:
    """The rows that have no label by this version of the prompt."""
    done = known.where(F.col("prompt_version") == prompt_version).select(*keys)
    return rows.join(done, keys, "left_anti")


def label_rows(rows: DataFrame, text_col: str, keep: list[str], labels: list[str], labeller: Callable[[], Labeller], prompt_version: str, fallback: str = "other", batch_size: int = 64) -> DataFrame:
    """The kept columns with label, confidence, rationale, prompt_version and model_id.

    A label that isn't one of ``labels`` becomes ``fallback``; confidence is clamped to 0..1, null becomes
    0. The rows of a batch that fails are labelled one by one; a row that fails by itself has the fallback with
    confidence 0, the error as rationale and no prompt version, so the job goes on, and the row counts as
    unlabelled and is asked for again.
    """
    names = ["label", "confidence", "rationale", "prompt_version", "model_id"]
    schema = T.StructType([*(rows.schema[k] for k in keep), *(T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in names)])

    def answers(model: Labeller, texts: list[str]) -> list[tuple[str, float, str]]:
        try:
            return model.label(texts)
        except Exception as e:
            if len(texts) == 1:
                return [(None, 0.0, str(e)[:500])]
            return [x for t in texts for x in answers(model, [t])]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = labeller()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                got = answers(model, part["_text"].fillna("").tolist())
                out = part[keep].copy()
                out["label"] = [g[0] if g[0] in labels else fallback for g in got]
                out["confidence"] = [min(1.0, max(0.0, float(g[1] or 0))) for g in got]
                out["rationale"] = [g[2] for g in got]
                out["prompt_version"] = [None if g[0] is None else prompt_version for g in got]
                out["model_id"] = model.model_id
                yield out

    return rows.select(*keep, F.col(text_col).alias("_text")).mapInPandas(work, schema)


def edges_to_label(w: Warehouse) -> DataFrame:
    """The declared citations, one row an edge, and what a model is told of each."""
    whole = w.table("reuse_edges").where("confidence_tier = 'declared' and src_project_id is not null and dst_project_id is not null and edge_id is not null")
    one = whole.groupBy("edge_id").agg(F.min(F.struct("src_project_id", "dst_project_id", "source_quote")).alias("e")).select("edge_id", "e.*")
    quote = F.coalesce(F.nullif("source_quote", F.lit("")), F.lit("(none)"))
    return one.withColumn("text", F.concat(F.lit("citing project: "), "src_project_id", F.lit("\ncited project: "), "dst_project_id", F.lit("\nquote: "), quote))


def revisions_to_label(w: Warehouse) -> DataFrame:
    rows = w.table("project_revisions").where("change_description is not null and revision_id is not null")
    return rows.select("revision_id", "project_id", F.concat(F.lit("change: "), "change_description").alias("text")).dropDuplicates(["revision_id"])


def combinations_to_label(w: Warehouse) -> DataFrame:
    """Popular names of two kinds that hardly occur together: is their combination plausible?"""
    pairs = underexplored_pairs(w.table("entity_mentions"))
    side = lambda s: F.concat(F.col(f"{s}_kind"), F.lit(" "), F.col(f"{s}_canonical"), F.lit(", in "), F.col(f"{s}_count"), F.lit(" projects"))
    return pairs.withColumn("text", F.concat(side("a"), F.lit("\n"), side("b"), F.lit("\ntogether in "), F.col("actual")))


def classify_table(w: Warehouse, name: str, labeller: Callable[[], Labeller], prompt_version: str) -> dict[str, int]:
    """Labels what has no label by this version of the prompt and folds it into the table ``name``. What
    failed is counted and not stored, so it is asked for next time."""
    build, labels, column = {
        "edge_classifications": (edges_to_label, EDGE_TYPES, "edge_type"), "revision_kinds": (revisions_to_label, REVISION_KINDS, "kind"), "combination_plausibility": (combinations_to_label, ["pair"], None),
    }[name]
    work = Workspace(w.spark)
    keys = KEYS[name]
    rows = work.keep(build(w))
    todo = work.keep(unlabelled(rows, w.table(name), keys, prompt_version))
    got = work.keep(label_rows(todo, "text", [c for c in todo.columns if c != "text"], labels, labeller, prompt_version, labels[-1]))
    good = got.where("prompt_version is not null")
    good = (good.withColumnRenamed("label", column) if column else good.withColumnRenamed("confidence", "plausibility")).withColumn("observed_at", F.current_timestamp().cast("timestamp_ntz"))
    w.upsert(name, conform(good, name))
    attempted, written = todo.count(), good.count()
    return {"attempted": attempted, "written": written, "errors": attempted - written, "known": rows.count() - attempted}


def classify(w: Warehouse, labeller: Callable[[], Labeller], prompt_version: str) -> dict[str, dict[str, int]]:
    """The three classifiers over the stored tables."""
    return {name: classify_table(w, name, labeller, prompt_version) for name in ("edge_classifications", "revision_kinds", "combination_plausibility")}
