import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.normal import consistent_form, look_classes, normalise_texts, same_look_pairs

SAME = [
    ("abc", "ａｂｃ"), ("abc", "a​b­c﻿"), ("a b", "a b"), ("a b", "a　b"), ("é", "é"), ("Cell", "Сеll"), ("oxygen", "οхуɡеn"), ("fit", "ﬁt"), ("a-b", "a‑b"), ("µ", "μ"), ("K", "K"),
    ("a\nb", "a\r\nb"), ("ё", "ё"), ("ṩ", "ṩ"), (";", ";"), ("…", "..."), ("ﬁ", "fi"),
]
DIFFERENT = [("abc", "Abc"), ("naive", "naïve"), ("62", "6²"), ("a b", "a\nb"), ("½", "1/2"), ("и", "й"), ("a b", "a  b"), ("👨‍🔬", "👨🔬"), ("①", "1"), ("a", "α"), ("ſ", "s"), ("", " ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert a != b and consistent_form(a) == consistent_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_a_reader_tells_apart(a, b):
    assert consistent_form(a) != consistent_form(b)


def test_case_on_request():
    assert consistent_form("STRASSE", fold_case=True) == consistent_form("straße", fold_case=True) == "strasse"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_form_of_a_form(text):
    once = consistent_form(text)
    assert consistent_form(once) == once


SCHEMA = "doc_id long, text string, look_key string, norm_text2 string"


def test_pairs(spark):
    rows = [(1, "abc", "k", None), (2, "ａbc", "k", None), (3, "abc", None, None), (4, "Abc", None, None), (5, None, None, None), (6, "", None, None), (7, "​", None, None), (8, " ", None, None), (9, " ", None, None), (2, "ａbc", "k", None), (10, "x" * 300_000, None, None), (11, "x" * 300_000 + "​", None, None), (None, "abc​", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in same_look_pairs(df, "doc_id", "text").collect()} == {(1, 2), (2, 3), (10, 11)}
    assert same_look_pairs(df.where("false"), "doc_id", "text").count() == 0
    classes = {r.id: (r.class_id, r.n_members, r.n_texts) for r in look_classes(df, "doc_id", "text").collect()}
    assert classes == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 4: (4, 1, 1), 10: (10, 2, 2), 11: (10, 2, 2)}
    assert look_classes(df.where("false"), "doc_id", "text").count() == 0


def test_column(spark):
    df = spark.createDataFrame([(1, "ＡＢ", "k", None), (1, "ＡＢ", "k", None), (2, None, None, None), (3, "", None, None)], SCHEMA)
    out = normalise_texts(df, "text")
    assert [tuple(r) for r in out.select("doc_id", "norm_text").orderBy("doc_id").collect()] == [(1, "AB"), (1, "AB"), (2, None), (3, "")]
    assert out.columns == [*df.columns, "norm_text"]
    with pytest.raises(ValueError):
        normalise_texts(df, "text", "look_key")
