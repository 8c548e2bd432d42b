import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import parsing as P


def test_sections():
    text = "---\nreviewer: A\ndate: 2026-03-02\n---\n# Title\n\nlead\n\n## One \nbody\n### inner\nmore\n\n## Two\nlast"
    rows = P.sections(text)
    assert [r["h2_text"] for r in rows] == [P.FRONT_MATTER, P.PREAMBLE, "One", "Two"]
    assert [r["h1_text"] for r in rows] == [None, "Title", "Title", "Title"]
    assert rows[2]["content"] == "body\n### inner\nmore" and rows[3]["content"] == "last"
    assert text[rows[2]["start_offset"] : rows[2]["end_offset"]].rstrip() == rows[2]["content"]


@pytest.mark.parametrize("text,titles", [("", []), ("  \n ", []), ("just text", [P.PREAMBLE]), ("---\n- a\n---\nx", [P.PREAMBLE]), ("---\n: [\n---\nx", [P.PREAMBLE]), ("```\n## in a fence\n```", [P.PREAMBLE, "in a fence"]), ("## only", ["only"])])
def test_sections_without(text, titles):
    assert [r["h2_text"] for r in P.sections(text)] == titles


def test_revisions():
    text = "intro\n- **v1** (2026-03-01): Initial plan\n* **v2.1** (2026-04): wider\n  and more\n\nprose\n- no revision\n- **v3** (2026-02-30): bad day"
    rows = P.revisions(text)
    assert [(r["version_label"], r["version_date"], r["date_precision"]) for r in rows] == [("v1", "2026-03-01", "day"), ("v2.1", "2026-04-01", "month"), ("v3", "2026-02-30", "day")]
    assert rows[0]["change_description"] == "Initial plan" and rows[1]["change_description"].startswith("wider\n  and more")
    assert P.revisions("nothing") == []


@pytest.mark.parametrize("bullet,name,orcid,place", [
    ("**Ann Lee** (ORCID: [0000-0001-5810-2497](https://orcid.org/0000-0001-5810-2497)), Some Lab", "Ann Lee", "0000-0001-5810-2497", "Some Lab"), ("Ann Lee (https://orcid.org/0000-0001-5810-249X), Lab, City", "Ann Lee", "0000-0001-5810-249X", "Lab, City"),
    ("Ann Lee  — Some Lab / Other", "Ann Lee", None, "Some Lab / Other"), ("Ann Lee - Lab", "Ann Lee", None, "Lab"), ("Ann Mary-Lee", "Ann Mary-Lee", None, None), ("Ann Lee 0000-0001-5810-2497", "Ann Lee", "0000-0001-5810-2497", None),
])
def test_author(bullet, name, orcid, place):
    got = P.author(bullet)
    assert (got["name"], got["orcid_id"], got["affiliation"]) == (name, orcid, place)


@pytest.mark.parametrize("bullet", ["", "x", "https://example.org, y", ", place"])
def test_no_author(bullet):
    assert P.author(bullet) is None


def test_references():
    r = P.References({"a_b", "a", "c.d"})
    rows = {x["dst_project_id"]: x["occurrence_count"] for x in r.find("c.d", "see `a_b`, `a`, `a_b` and `c.d`, not a or `ab`")}
    assert rows == {"a_b": 2, "a": 1} and P.References(set()).find("x", "`a`") == []


def test_notebook():
    raw = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Load\n", "**Goal**: get data\n\nrest"]}, {"cell_type": "code", "source": "1", "outputs": []}, {"cell_type": "raw", "source": ""}]})
    nb = P.notebook("01b_load.ipynb", raw)
    assert (nb["notebook_number"], nb["notebook_suffix"], nb["title_from_first_md_cell"], nb["goal_phrase"], nb["total_cells"], nb["code_cells"], nb["has_outputs"]) == (1, "b", "Load", "get data", 3, 1, False)
    assert P.notebook("x", "{") is None and P.notebook("x", '{"cells": 3}') is None and P.notebook("x.ipynb", '{"cells": []}')["notebook_number"] is None
    long = P.notebook("x", json.dumps({"cells": [{"cell_type": "markdown", "source": "**Goal**: " + "y" * 300}]}))
    assert len(long["goal_phrase"]) == 201


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a \n#é", max_size=300), st.integers(5, 60))
def test_chunks_join(text, limit):
    parts = P.chunks(text, limit)
    assert "".join(parts) == text and all(len(p) <= limit for p in parts)


def test_chunks_prefer_headings():
    text = "a" * 30 + "\n### x\n" + "b" * 30
    assert P.chunks(text, 40) == ["a" * 30 + "\n", "### x\n" + "b" * 30]


@pytest.mark.parametrize("text,value", [('{"a": 1}', {"a": 1}), ('say\n```json\n{"a": 1}\n```', {"a": 1}), ('x {"a": [1, 2,],} y', {"a": [1, 2]}), ("[1]", [1])])
def test_salvage(text, value):
    assert P.salvage_json(text) == value


def test_salvage_fails():
    with pytest.raises(ValueError):
        P.salvage_json("no json")


def test_extractable():
    assert P.extractable("README", "Findings", "x" * 80) and not P.extractable("README", "Reproduction", "x" * 80) and not P.extractable("README", "Findings", "x" * 79) and not P.extractable("OTHER", "F", "x" * 99) and not P.extractable("README", P.PREAMBLE, "x" * 99)


def test_loose_json_leaves_strings_alone():
    from quillon.functions.parsing import salvage_json

    assert salvage_json('{"a": "x, ]", b: [1, 2,], /* c */ "d": \'it\\\'s "so"\',} // end') == {"a": "x, ]", "b": [1, 2], "d": 'it\'s "so"'}
    assert salvage_json('{"u": "http://x, }"}') == {"u": "http://x, }"}


def test_front_matter_with_blanks_and_other_line_ends():
    from quillon.functions.parsing import MARKER, front_matter

    for text in ("---\nreviewer: A\n---\nx", "--- \r\nreviewer: A\r\n---\r\nx", "---\nreviewer: A\n---"):
        assert front_matter(text)[0] == {"reviewer": "A"}
    assert MARKER.match("# quillon-generated v=0.1") and MARKER.match("<!-- # quillon-generated v=0.1 -->") and not MARKER.match("# auto-generated v=2")
