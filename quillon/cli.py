"""Commands: scan | extract | classify | metrics | report."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import sys
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from quillon.operators import checks, extraction
from quillon.operators import classify as labelling
from quillon.plans import bundles, panels
from quillon.plans.derived import DERIVED
from quillon.plans.views import VIEWS, run_all
from quillon.session import get_session
from quillon.sinks import export
from quillon.sources import corpus, vocab
from quillon.sources.warehouse import Warehouse


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="read project folders into a warehouse")
    scan.add_argument("root")
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--allow-failed-checks", action="store_true")
    extract = sub.add_parser("extract", help="read the stored sections with a model")
    extract.add_argument("--scorer", default="quillon.operators.extraction:StubScorer", help="module:name of the scorer")
    extract.add_argument("--prompt-version", default="v1")
    extract.add_argument("--vocab-version", default="v1")
    extract.add_argument("--vocab", action="append", default=[], help="kind=file, may be repeated")
    classify = sub.add_parser("classify", help="label citations, revisions and combinations with a model")
    classify.add_argument("--labeller", required=True, help="module:name of the labeller")
    classify.add_argument("--prompt-version", default="v1")
    metrics = sub.add_parser("metrics", help="run every view and export it")
    report = sub.add_parser("report", help="write the panels as JSON and a page")
    report.add_argument("--sampled", action="store_true", help="the extraction is known to be a sample")
    for x in (scan, extract, classify, metrics, report):
        x.add_argument("--warehouse", required=True)
        x.add_argument("--master")
    for x in (metrics, report):
        x.add_argument("--out", required=True)
    return p


def scan(args) -> int:
    spark = get_session(master=args.master)
    w = Warehouse(spark, args.warehouse)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    before = checks.snapshot(args.root)
    found = corpus.scan(spark, args.root, tuple(args.exclude), now)
    rejects = found.pop("rejects")
    counts = {name: w.replace(name, df).count() for name, df in found.items()}
    counts["rejected revisions"] = rejects.count()
    computed = ("research_line_subclusters", "sophistication_composite", "research_lines")
    for name in computed:  # none of an earlier scan is read
        w.drop(name)
    fresh = Warehouse(spark, args.warehouse, DERIVED)
    for name in computed:
        counts[name] = w.replace(name, fresh.table(name)).count()
    result = checks.self_test(w, args.root, before)
    run = spark.createDataFrame([(uuid.uuid4().hex, now, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), args.root, counts["projects"], "ok" if all(result.values()) else "checks failed", None)], "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, projects_root string, project_count int, status string, notes string")
    run.write.mode("append").parquet(w.path("runs"))
    text = export.manifest(run.first()["run_id"], counts, [w.path(t) for t in counts if t in found], result)
    Path(args.warehouse.removeprefix("file:"), "manifest.json").write_text(text)
    print(text)
    return 0 if all(result.values()) or args.allow_failed_checks else 1


def _named(place: str):
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def extract(args) -> int:
    spark = get_session(master=args.master)
    scorer = _named(args.scorer)
    entries = spark.createDataFrame([], vocab.SCHEMA)
    for each in args.vocab:
        kind, _, path = each.partition("=")
        entries = entries.unionByName(vocab.load_vocab(spark, path, kind))
    print(json.dumps(extraction.extract(Warehouse(spark, args.warehouse), vocab.lookup(entries), scorer, args.prompt_version, args.vocab_version)))
    return 0


def classify(args) -> int:
    w = Warehouse(get_session(master=args.master), args.warehouse)
    print(json.dumps(labelling.classify(w, _named(args.labeller), args.prompt_version)))
    return 0


def metrics(args) -> int:
    w = Warehouse(get_session(master=args.master), args.warehouse, DERIVED)
    results = run_all(w)
    export.export_views(results, args.out)
    export.write_xlsx(results, Path(args.out) / "metrics.xlsx")
    for r in results:
        print(f"{r.view.name}: {r.error or f'{r.row_count} rows' + ('' if r.sane else ', fewer than expected')}")
    return int(any(r.error for r in results))


def report(args) -> int:
    w = Warehouse(get_session(master=args.master), args.warehouse, DERIVED)
    if not bundles.consistent(w, args.sampled):
        print("either journals or functions have mentions, not both: the extraction is half done", file=sys.stderr)
        return 2
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    shown = {"summary": panels.summary(w), "top_cited": panels.top_cited(w), "top_authors": panels.top_authors(w), "research_lines": panels.research_lines(w).orderBy(F.desc("member_count"), "line_id").limit(30), "weekly_pulse": panels.weekly_pulse(w), "metrics_to_watch": panels.metrics_to_watch(w), **{f"top_{k}s": panels.top_names(w, k) for k in ("organism", "method", "journal", "function", "database")}, "dark_matter": panels.dark_matter(w), "underexplored": panels.underexplored(w)}
    export.bundle(shown, out / "bundle.json")
    export.page(out / "bundle.json", out / "report.html")
    print(f"{len(shown)} panels, {len(VIEWS)} views in the registry")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return {"scan": scan, "extract": extract, "classify": classify, "metrics": metrics, "report": report}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
