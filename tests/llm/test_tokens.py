import os
import random

import numpy as np
import pytest

from quillon.llm import tokens

PATH = tokens.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
ODD = [None, "", " ", "  \n\n  ", "Hello world", "it's  a\ttest\r\n\r\nnext", "<|endoftext|>", "漢字かな", "a b　c d", "x" * 5000, "é́ 🧬🔬", "\x1c\x1d a", "1234 5.6%", "'s 't"]


def test_fragments_agree_with_the_whole():
    e = tokens.ForcedBoundaryEncoder(PATH)
    rnd = random.Random(5)
    for _ in range(4000):
        text = "".join(rnd.choice(" \n\t\r  abc'sré\x1c\x85 　漢1².,-") for _ in range(rnd.randint(0, 18)))
        assert e.encode(text) == e.whole(text), repr(text)
    assert len(e.fragments("one two three")) == 3 and "".join(e.fragments("one  two\n\nx")) == "one  two\n\nx"


def test_forced_pairs():
    forced = tokens.forced_pairs([b"ab", b"bcd"])
    assert not forced[ord("a"), ord("b")] and not forced[ord("c"), ord("d")] and forced[ord("a"), ord("c")] and forced.sum() == 256 * 256 - 3
    assert isinstance(forced, np.ndarray)


def test_against_another_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(ODD)] + [(4, "Hello world", "again")], "doc_id long, text string, note string")
    out = tokens.encode_texts(df, "text", ["doc_id", "note"]).collect()
    assert len(out) == len(ODD) + 1
    for r in out:
        assert r.ids == (other.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids)
    assert tokens.encode_texts(df, "text", ["doc_id"]).schema["ids"].dataType.simpleString() == "array<int>"
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in out} and counts[0] == counts[1] == 0


def test_empty_table_and_clash(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert tokens.encode_texts(df, "text", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        tokens.encode_texts(df, "text", ["ids"])


def test_round_trip():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = tokens.encoder(PATH)
    for t in ODD:
        assert enc.decode(e.encode(t or "")) == (t or "")


def test_text_without_blanks_is_cut():
    e = tokens.encoder(PATH)
    text = "漢字かな交じり文は日本語の標準的な表記法である。" * 500
    assert len(e.fragments(text)) > 1000 and e.encode(text) == e.whole(text)
    rnd = random.Random(6)
    for _ in range(4000):
        text = "".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF), 32, 39])) for _ in range(rnd.randint(0, 24)))
        assert e.encode(text) == e.whole(text), repr(text)
