"""A small corpus from files to report."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.operators import checks
from quillon.sources import corpus
from quillon.sources.warehouse import Warehouse

LONG = "Some finding that is long enough to be read by a model, with a few more words in it. "


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")

    def put(path, text):
        p = base / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("project_a/README.md", "# A\n\n## Status\nrunning\n\n## Research Question\nwhy\n\n## Authors\n- Ann Lee (https://orcid.org/0000-0001-5810-2497), Some Lab\n\n## Reproduction\nrun it\n")
    put("project_a/RESEARCH_PLAN.md", "## Hypothesis\nh\n\n## Approach\nbuilds on `project_b` and `project_b` and `project_a` and `nothing`\n\n## Revision History\n- **v1** (2026-03-01): Initial plan\n- **v2** (2026-02-31): no such day\n\n## Authors\n- Ann Lee\n")
    put("project_a/REPORT.md", f"## Key Findings\n{LONG * 3}\n")
    put("project_a/REVIEW.md", "---\nreviewer: Bo\ndate: 2026-03-02\n---\n## Summary\ngood\n\n## Suggestions\nnone\n")
    put("project_a/REVIEW_7.md", "## Old\nx\n")
    put("project_a/data/x.tsv", "1")
    put("project_a/notebooks/01_data.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": "# Load\n**Goal**: load data"}, {"cell_type": "code", "source": "1"}]}))
    put("project_a/notebooks/02_analysis.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": "x"}]}))
    put("project_a/notebooks/broken.ipynb", "{")
    put("project_b/README.md", "## Only\nbody\n")
    put("project_b/REVIEW_2.md", "## Second\nx\n")
    put("project_b/REVIEW_10.md", "## Tenth\nx\n")
    put("project_c/README.md", "text without heading\n")
    put("project_c/ghost.md", "# quillon-generated v=0.1\n## Ghost\n`project_a`\n")
    put("project_c/.git/README.md", "## Hidden\nx\n")
    put(".dot/README.md", "## Hidden\nx\n")
    return base


@pytest.fixture(scope="module")
def found(spark, root):
    return corpus.scan(spark, str(root), observed_at=dt.datetime(2026, 5, 1))


def test_projects(found):
    rows = {r.project_id: r for r in found["projects"].collect()}
    a = rows["project_a"]
    assert sorted(rows) == ["project_a", "project_b", "project_c"]
    assert (a.notebook_count, a.has_notebooks, a.has_data_dir, a.has_figures_dir, a.file_count, a.revision_depth) == (3, True, True, False, 9, 1)
    assert (str(a.start_date), str(a.completion_date), str(a.review_date), a.review_reviewer) == ("2026-03-01", "2026-03-01", "2026-03-02", "Bo")
    assert json.loads(a.file_type_counts) == {".ipynb": 3, ".md": 5, ".tsv": 1} and rows["project_c"].file_count == 1 and rows["project_b"].revision_depth is None


def test_sections(found):
    rows = found["sections"].collect()
    titles = {(r.project_id, r.source_doc, r.h2_text) for r in rows}
    assert ("project_b", "REVIEW", "Tenth") in titles and ("project_b", "REVIEW", "Second") not in titles and ("project_a", "REVIEW", "Old") not in titles
    assert not any(t in ("Ghost", "Hidden") for _, _, t in titles)
    assert all(r.section_id == f"{r.project_id}:{r.source_doc}:{r.h2_text}:{r.start_offset}" for r in rows)


def test_people_and_edges(found):
    assert [(r.author_id, r.orcid_id) for r in found["authors"].collect()] == [("orcid:0000-0001-5810-2497", "0000-0001-5810-2497")]
    assert {(r.project_id, r.author_id, r.source_doc) for r in found["project_authors"].collect()} == {("project_a", "orcid:0000-0001-5810-2497", "README"), ("project_a", "orcid:0000-0001-5810-2497", "RESEARCH_PLAN")}
    edges = found["reuse_edges"].collect()
    assert [(r.src_project_id, r.dst_project_id, r.occurrence_count, r.source_section) for r in edges] == [("project_a", "project_b", 2, "Approach")]
    assert [(r.version_label, str(r.version_date)) for r in found["project_revisions"].collect()] == [("v1", "2026-03-01")] and found["rejects"].count() == 1
    books = found["notebooks"].orderBy(*corpus.notebook_order()).collect()
    assert [(b.filename, b.goal_phrase) for b in books] == [("01_data.ipynb", "load data"), ("02_analysis.ipynb", None)]


def test_long_sections_are_parsed_whole(spark, tmp_path):
    fill = "word " * 25_000
    docs = {
        "project_a/RESEARCH_PLAN.md": f"## Approach\n`project_b` {fill}`project_b` and `project_c`\n\n## Revision History\n- **v1** (2026-03-01): {fill}\n- **v2** (2026-03-09): last\n\n## Authors\n- Ann Lee, {fill}\n- Bo Tan\n",
        "project_b/README.md": "## Only\nx\n",
        "project_c/README.md": "## Only\nx\n",
    }
    for path, text in docs.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    found = corpus.scan(spark, str(tmp_path), observed_at=dt.datetime(2026, 5, 1))
    assert {(r.dst_project_id, r.occurrence_count) for r in found["reuse_edges"].collect()} == {("project_b", 2), ("project_c", 1)}
    assert {r.version_label for r in found["project_revisions"].collect()} == {"v1", "v2"}
    assert {r.canonical_name for r in found["authors"].collect()} == {"Ann Lee", "Bo Tan"}
    texts = {r.h2_text: r for r in found["sections"].where("project_id = 'project_a'").collect()}
    assert texts["Approach"].content.endswith("`project_c`") and all(len(r.content) == r.byte_size for r in texts.values())


def test_commands(spark, root, tmp_path, capsys):
    wh, out = tmp_path / "wh", tmp_path / "out"
    wh.mkdir()
    assert cli.main(["scan", str(root), "--warehouse", str(wh)]) == 0
    w = Warehouse(spark, str(wh))
    assert w.table("projects").count() == 3 and w.table("runs").count() == 1 and json.loads((wh / "manifest.json").read_text())["passed"]
    # again: the same state, not twice of it; and a project less
    assert cli.main(["scan", str(root), "--warehouse", str(wh), "--exclude", "project_c"]) == 0
    assert w.table("projects").count() == 2 and w.table("runs").count() == 2
    assert cli.main(["metrics", "--warehouse", str(wh), "--out", str(out)]) == 0
    summary = json.loads((out / "run_summary.json").read_text())
    assert summary["views_total"] == 36 and summary["views_failed"] == 0
    assert (out / "top_cited_projects.csv").read_text().splitlines()[1].startswith("project_b,1,")
    assert cli.main(["report", "--warehouse", str(wh), "--out", str(out)]) == 0
    assert json.loads((out / "bundle.json").read_text())["summary"][0]["projects"] == 2 and "<table" not in (out / "report.html").read_text()
    assert checks.self_test(w, str(root), {})["the corpus is as it was"] is False


def test_extraction(spark, found):
    from quillon.operators import extraction as ex
    from quillon.sources.vocab import lookup

    keyed = ex.with_cache_key(ex.to_extract(found["sections"]), "p1", "v1", "stub")
    assert keyed.count() == 1
    cache = spark.createDataFrame([], "cache_key string, response_content string, response_metadata string")
    hits, misses = ex.cache_split(keyed, cache)
    assert hits.count() == 0
    asked = ex.ask(misses, ex.StubScorer)
    assert [r.error for r in asked.collect()] == [None]
    vocab = spark.createDataFrame([("organism", "SOME thing", ["some"], 1)], "vocab_name string, canonical string, aliases array<string>, rank int")
    said, drift = ex.mentions_and_drift(ex.parse_answers(asked), lookup(vocab), "p1", "v1", "stub")
    assert [(r.canonical_id, r.mention_id.rpartition("#")[2] if "#" in r.mention_id else "") for r in said.orderBy("mention_id").collect()] == [("SOME thing", ""), ("SOME thing", "1"), ("SOME thing", "2")]
    assert drift.count() == 0
    done = asked.select("cache_key", "response_content", F.lit('{"finish_reason": "stop"}').alias("response_metadata"))
    assert ex.cache_split(keyed, done)[0].count() == 1
    assert ex.cache_split(keyed, done.withColumn("response_metadata", F.lit('{"finish_reason": "length"}')))[0].count() == 0


def test_extract_command(spark, root, tmp_path, capsys):
    wh = tmp_path / "wh"
    wh.mkdir()
    (tmp_path / "organism.yaml").write_text("entries:\n- canonical: SOME thing\n  aliases: [some]\n")
    assert cli.main(["scan", str(root), "--warehouse", str(wh)]) == 0
    counts = []
    for prompt in ("v1", "v1", "v2"):
        assert cli.main(["extract", "--warehouse", str(wh), "--prompt-version", prompt, "--vocab", f"organism={tmp_path / 'organism.yaml'}"]) == 0
        counts.append(json.loads(capsys.readouterr().out.splitlines()[-1]))
    # everything is asked for once for each version of the prompt
    assert [c["asked"] for c in counts] == [1, 0, 1] and len({(c["mentions"], c["drift"], c["failed"]) for c in counts}) == 1 and counts[0]["mentions"] == 3
    w = Warehouse(spark, str(wh))
    assert {r.canonical_id for r in w.table("entity_mentions").collect()} == {"SOME thing"} and w.table("extraction_cache").count() == 2
    # a model that fails leaves its error and wipes no mentions
    assert cli.main(["extract", "--warehouse", str(wh), "--prompt-version", "v3", "--scorer", "tests.test_scan:Broken"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["failed"] == 1
    assert w.table("entity_mentions").count() == 3 and [(r.entity_kind, r.llm_notes) for r in w.table("drift_candidates").collect()] == [("extraction_error", "gone")] and w.table("extraction_cache").count() == 2


class Broken:
    model_id = "broken"

    def answer(self, prompts):
        raise RuntimeError("gone")


class Judge:
    """Labels by the words of the text; fails at a text with boom."""

    model_id = "judge"

    def label(self, texts):
        if any("start" in t for t in texts):
            raise RuntimeError("gone")
        return [("deepening" if "cited" in t else "no such label", 1.5, "why") for t in texts]


def test_classify_command(spark, tmp_path, capsys):
    wh = tmp_path / "wh"
    w = Warehouse(spark, str(wh))
    edge = "edge_id string, src_project_id string, dst_project_id string, confidence_tier string, source_quote string"
    w.replace("reuse_edges", spark.createDataFrame([("e1", "a", "b", "declared", "as in b"), ("e2", "a", "c", "declared", None), ("e3", "a", "c", "inferred", None), ("e4", None, "c", "declared", None)], edge))
    w.replace("project_revisions", spark.createDataFrame([("r1", "a", "start"), ("r2", "a", "more"), ("r3", "a", None)], "revision_id string, project_id string, change_description string"))
    said = [(f"m{p}{k}", f"p{p}", k, f"{k}1") for p in range(6) for k in ("organism", "method")] + [(f"d{p}", f"q{p}", "database", "d1") for p in range(6)]
    w.replace("entity_mentions", spark.createDataFrame(said, "mention_id string, project_id string, entity_kind string, canonical_id string"))
    runs = []
    for _ in range(2):
        assert cli.main(["classify", "--warehouse", str(wh), "--labeller", "tests.test_scan:Judge"]) == 0
        runs.append(json.loads(capsys.readouterr().out.splitlines()[-1]))
    assert runs[0] == {"edge_classifications": {"attempted": 2, "written": 2, "errors": 0, "known": 0}, "revision_kinds": {"attempted": 2, "written": 1, "errors": 1, "known": 0}, "combination_plausibility": {"attempted": 2, "written": 2, "errors": 0, "known": 0}}
    # only what failed is asked for again
    assert [runs[1][t]["attempted"] for t in runs[1]] == [0, 1, 0]
    assert {(r.edge_id, r.edge_type, r.confidence) for r in w.table("edge_classifications").collect()} == {("e1", "deepening", 1.0), ("e2", "deepening", 1.0)}
    assert [(r.revision_id, r.kind, r.prompt_version) for r in w.table("revision_kinds").collect()] == [("r2", "other", "v1")]
    assert {(r.a_kind, r.b_kind, r.plausibility) for r in w.table("combination_plausibility").collect()} == {("database", "method", 1.0), ("database", "organism", 1.0)}
