"""Self-test of a scan: nothing of the engine's own output came in, and nothing of the corpus was changed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from quillon.functions.parsing import MARKER
from quillon.schemas import KEYS, key_violations
from quillon.sources.warehouse import Warehouse


def snapshot(root: str) -> dict[str, float]:
    """The latest change under each project folder."""
    base = Path(root.removeprefix("file:"))
    out = {}
    for p in sorted(x for x in base.iterdir() if x.is_dir()):
        times = [os.stat(os.path.join(d, f)).st_mtime for d, _, names in os.walk(p) for f in names if os.path.exists(os.path.join(d, f))]
        out[p.name] = max(times, default=0.0)
    return out


def self_test(w: Warehouse, root: str, before: dict[str, float]) -> dict[str, bool]:
    sections, edges, projects = w.table("sections"), w.table("reuse_edges"), w.table("projects")
    none = lambda df: df.isEmpty()
    return {
        "no section of a file the engine wrote": none(sections.where(F.col("content").rlike(MARKER.pattern) & F.col("start_offset").eqNullSafe(0))),
        "no project from a hidden or ignored folder": none(projects.where(F.col("project_id").startswith("."))),
        "the corpus is as it was": snapshot(root) == before,
        "every edge ends at a known project": none(edges.join(projects.select(F.col("project_id").alias("dst_project_id")), "dst_project_id", "left_anti")),
        "no project cites itself": none(edges.where("src_project_id = dst_project_id")),
        "keys are filled and unique": all(none(key_violations(w.table(t), KEYS[t])) for t in ("projects", "sections", "reuse_edges", "authors", "project_revisions", "notebooks")),
    }
