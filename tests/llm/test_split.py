import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.split import cut_points, split_oversized, split_text


def check(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    assert all(len(p) <= limit for p in parts)
    assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == text
    assert all(b[:overlap] == a[len(a) - overlap :] for a, b in zip(parts, parts[1:]))
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\r\tab#é🧬", max_size=400), st.integers(8, 40), st.integers(0, 6))
def test_pieces_join_to_the_text(text, limit, overlap):
    check(text, limit, overlap)


def walk(text, limit, overlap):
    """The same cuts one after the other, each from a text that begins at the cut before."""
    cuts = [0, cut_points(text, limit, overlap)[1]]
    while cuts[-1] < len(text):
        rest = text[cuts[-1] :]
        step = limit - overlap
        cuts.append(len(text) if len(rest) <= step else cuts[-1] + cut_points(rest, step, 0)[1])
    return cuts


def test_doubling_equals_the_greedy_walk():
    text = ("word " * 37 + "\n\n### head\n" + "x" * 60 + "\n\n") * 9
    assert cut_points(text, 100, 10) == walk(text, 100, 10)


def test_kinds_of_boundary():
    body = "a" * 50
    assert split_text(f"{body}\n### b\n{body}", 80, 0) == [f"{body}\n", f"### b\n{body}"]
    assert split_text(f"{body}\n\n{body} c", 80, 0)[0] == f"{body}\n\n"
    assert split_text(f"{body} {body}", 80, 0) == [f"{body} ", body]
    assert [len(x) for x in split_text("a" * 200, 80, 0)] == [80, 80, 40]
    # a heading of two or five marks is no subheading, a line end is not torn
    assert split_text(f"{body}\r\n{body}", 51, 0)[0] != f"{body}\r"


def test_at_the_limit():
    assert split_text("a" * 12_000) == ["a" * 12_000]
    assert len(split_text("a" * 12_001)) == 2
    assert split_text("") == [""]
    with pytest.raises(ValueError):
        cut_points("abc", 2, 2)


def test_long_text():
    check("lorem ipsum " * 200_000, 12_000, 200)
    check("x" * 1_000_000, 12_000, 200)


def test_operator(spark):
    rows = [("s1", 0, "a " * 9000, "p"), ("s1", 0, "a " * 9000, "p"), ("s2", 1, None, None), ("s3", None, "", "q"), (None, 2, "b" * 13_000, "r")]
    df = spark.createDataFrame(rows, "section_id string, k int, content string, piece string")
    out = split_oversized(df, "content", ["section_id", "k"]).collect()
    by = {}
    for r in out:
        by.setdefault((r.section_id, r.k), []).append(r)
    assert [r.piece for r in by["s2", 1]] == [None] and [r.piece for r in by["s3", None]] == [""]
    assert len(by["s1", 0]) == 4 and {r.total_pieces for r in by["s1", 0]} == {2}
    assert [r.overlap_chars for r in sorted(by[None, 2], key=lambda r: r.piece_idx)] == [0, 200]
    assert split_oversized(df, "content", ["section_id"], only_oversized=True).count() == 6
    assert split_oversized(df.where("false"), "content", ["section_id"]).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "content", ["piece"])
