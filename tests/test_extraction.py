import json

import pytest

from quillon.operators import extraction as ex
from quillon.sources import vocab as V

ANSWER = {
    "organisms": [{"surface_form": "E. coli", "canonical_name": "Escherichia coli", "source_quote": None}, {"surface_form": "New bug", "canonical_name": None, "taxonomy_hint": "t"}, {"surface_form": None}, "text"],
    "methods": None, "databases": {"no": "list"}, "question_type_candidates": [{"axis": "domain", "label": "ecology", "evidence_quote": None}, {"axis": None, "label": "x"}],
    "conclusions": [{"claim_text": "It grows" * 30, "claim_type": "negative_result", "source_quote": None}, {"claim_text": ""}],
}
FIELDS = "section_id string, project_id string, source_doc string, h2_text string, chunk_idx int, response_content string"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("s1", "p", "README", "F", 0, "```json\n" + json.dumps(ANSWER) + "\n```"), ("s1", "p", "README", "F", 1, json.dumps({"organisms": ANSWER["organisms"]})), ("s2", "p", "README", "G", 0, "nothing"), ("s3", "q", "REPORT", "H", 0, "[1]"), ("s4", "q", "REPORT", "I", 0, None)]
    return ex.parse_answers(spark.createDataFrame(rows, FIELDS))


def test_rows_of_an_answer(parsed):
    kinds = sorted((r.section_id, r.chunk_idx, r.entity_kind, r.surface) for r in parsed.collect() if r.entity_kind != "conclusion")
    assert kinds[:3] == [("s1", 0, "organism", "E. coli"), ("s1", 0, "organism", "New bug"), ("s1", 0, "question_type", "ecology")]
    assert [k[2] for k in kinds].count("parse_error") == 3


def test_mentions_and_drift(spark, parsed):
    forms = V.lookup(spark.createDataFrame([("organism", "Escherichia coli", ["E. coli"], 0), ("organism", "Later", ["E. coli"], 1)], V.SCHEMA))
    said, drift = ex.mentions_and_drift(parsed, forms, "p1", "v1", "m")
    got = {(r.entity_kind, r.canonical_id): round(r.confidence, 2) for r in said.collect()}
    claim = ("It grows" * 30)[:80]
    assert got == {("organism", "Escherichia coli"): 0.95, ("organism", "proposed:New bug"): 0.7, ("question_type", "domain:ecology"): 0.7, ("conclusion", f"claim:{claim}"): 0.6}
    assert said.count() == 4  # the second chunk repeats the first
    assert {(r.entity_kind, r.surface_form) for r in drift.collect()} == {("organism", "New bug"), ("parse_error", None)} and drift.count() == 4
    assert [json.loads(r.extra_json)["claim_type"] for r in said.where("entity_kind = 'conclusion'").collect()] == ["negative_result"]


class Flaky:
    model_id = "flaky"

    def __init__(self):
        self.seen = {}

    def answer(self, prompts):
        out = []
        for p in prompts:
            if p == "boom":
                raise RuntimeError("gone")
            self.seen[p] = self.seen.get(p, 0) + 1
            out.append(("{}", "length" if p == "cut" and self.seen[p] == 1 else "stop"))
        return out


def test_asking(spark):
    df = spark.createDataFrame([("a", "fine"), ("b", "cut"), ("c", "boom")], "id string, chunk string").coalesce(1)
    got = {r.id: (r.finish_reason, r.error) for r in ex.ask(df, Flaky, batch_size=1).collect()}
    assert got == {"a": ("stop", None), "b": ("stop", None), "c": (None, "gone")}


def test_a_failure_stays_with_its_row(spark):
    rows = [("s1", "p", "REPORT", "H", 0, "fine"), ("s2", "p", "REPORT", "H", 0, "boom"), ("s3", "p", "REPORT", "H", 0, "other")]
    df = spark.createDataFrame(rows, "section_id string, project_id string, source_doc string, h2_text string, chunk_idx int, chunk string").coalesce(1)
    asked = ex.ask(df, Flaky)
    assert {r.section_id: r.error for r in asked.collect()} == {"s1": None, "s2": "gone", "s3": None}
    assert [(r.section_id, r.entity_kind, r.note) for r in ex.parse_answers(asked).collect()] == [("s2", "extraction_error", "gone")]

    class Label:
        model_id = "label"

        def label(self, texts):
            if "boom" in texts:
                raise RuntimeError("gone")
            return [("yes", 1.0, None)] * len(texts)

    from quillon.operators.classify import label_rows, unlabelled

    labelled = label_rows(df, "chunk", ["section_id"], ["yes"], Label, "v1")
    assert {r.section_id: r.label for r in labelled.collect()} == {"s1": "yes", "s2": "other", "s3": "yes"}
    assert [r.section_id for r in unlabelled(df, labelled, ["section_id"], "v1").collect()] == ["s2"]


DRIFT = "drift_id string, project_id string, source_doc string, entity_kind string, surface_form string, llm_decision string, llm_proposed_canonical string, llm_notes string, llm_suggested_aliases string, source_quote string"


def drift_rows(spark, spots, kind="method"):
    return spark.createDataFrame([(f"d{i}", p, d, kind, f, None if i == 0 else "proposed", "C", None, '["x", "y"]' if i else '["y"]', f"q{i}") for i, (p, d, f) in enumerate(spots)], DRIFT)


@pytest.mark.parametrize("spots,projects,kept", [([("p1", "README", "Foo-Bar")], 100, 0), ([("p1", "README", "foo bar"), ("p1", "REPORT", "Foo  Bar"), ("p2", "README", "FOO_BAR x")], 100, 0), ([("p1", "A", "fb"), ("p1", "B", "F-B"), ("p2", "C", "f/b")], 100, 1), ([("p1", "A", "x"), ("p2", "A", "X")], 4, 1), ([("p1", "A", "x")], 4, 1)])
def test_thresholds(spark, spots, projects, kept):
    assert ex.drift_rollup(drift_rows(spark, spots), projects).count() == kept


def test_rollup_details(spark):
    df = drift_rows(spark, [("p1", "A", "fb"), ("p1", "B", "F-B"), ("p2", "C", "f/b")])
    r = ex.drift_rollup(df, 4).first()
    assert (r.surface_form, r.occurrence_count, r.project_count, r.file_count, r.llm_decision, r.sample_projects) == ("fb", 3, 2, 3, "proposed", ["p1", "p2"])
    assert [tuple(x) for x in ex.drift_aliases(df).select("norm", "aliases").collect()] == [("fb", ["y", "x"])]
    assert ex.drift_quotes(df, 2).count() == 2


def test_vocabulary_files(spark, tmp_path):
    a, b = tmp_path / "a.yaml", tmp_path / "b.yaml"
    a.write_text("_meta: {version: 1}\nentries:\n- canonical: One\n  aliases: [uno]\n- canonical: Two\n- aliases: [none]\n- text\n")
    b.write_text("entries:\n- canonical: One\n  aliases: [uno, ein]\n- canonical: Three\n")
    rows = [(r.canonical, r.aliases) for r in V.load_vocab(spark, a, "v", b).orderBy("rank").collect()]
    assert rows == [("One", ["uno", "ein"]), ("Two", []), ("Three", [])]
    b.write_text("entries: [")
    with pytest.warns(UserWarning):
        assert V.load_vocab(spark, a, "v", b).count() == 2
    out = V.canonicalise(spark.createDataFrame([("v", "**UNO**", None), ("v", None, "T-w_o"), ("v", "zwei", "zwei"), ("w", "One", None), (None, None, None)], "k string, a string, b string"), "k", ["a", "b"], V.lookup(V.load_vocab(spark, a, "v")))
    assert {(r.k, r.a, r.canonical_match) for r in out.collect()} == {("v", "**UNO**", "One"), ("v", None, "Two"), ("v", "zwei", None), ("w", "One", None), (None, None, None)}
