import random

import pytest

from quillon.llm import mapping
from quillon.llm.automaton import Automaton, Trie, edit_distance
from quillon.llm.mapping import Entry, Matcher, best_entries, clean, match_texts


def test_search_equals_brute_force():
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, n)))
    for most in (0, 1, 2):
        forms = [(rnd.choice("XY"), word(7), i) for i in range(200)]
        queries = [(rnd.choice("XYZ"), word(8)) for _ in range(200)]
        limits = [rnd.randint(0, most) for _ in queries]
        got = set(zip(*(x.tolist() for x in Trie(forms).search(Automaton(most), queries, limits))))
        want = {(i, v, d) for i, (g, q) in enumerate(queries) for h, f, v in forms if g == h and (d := edit_distance(q, f)) <= limits[i]}
        assert got == want


def test_empty_trie():
    assert [len(x) for x in Trie([]).search(Automaton(2), [("a", "b")], [2])] == [0, 0, 0]


ENTRIES = [
    Entry(1, "organism", ["Pukrucoccus laidaensis HVY8093", "P. laidaensis HVY8093", "HVY8093"]), Entry(2, "organism", ["Gegremonas reostaiica"]), Entry(3, "method", ["Vipusk barcoded phage sequencing", "VBPS"]), Entry(4, "database", ["Kligima Strain Catalog"]),
    Entry(5, "journal", ["Skarovik Quarterly of Comparative Metabolism"]), Entry(6, "function", ["low-affinity krulirate hydrolase"]), Entry(7, "organism", ["Glolobacter snigriii YT112"]), Entry(8, "method", ["Zabril plasmid modelling"]),
]
NAMED = [
    ("organism", "pukrucoccus laidaensis hvy-8093", 1), ("organism", "HVY 8093", 1), ("organism", "HVY8093 (Pukrucoccus laidaensis)", 1), ("organism", "P. laidaensis str. HVY8093", 1), ("organism", "*Gegr. reostaiica*", 2), ("organism", "Gegremonas repstaiica sp. nov.", 2),
    ("organism", "G reostaiica", 2), ("organism", "STRAIN YT112", 7), ("method", "VipuskBarcodedPhageSequencing", 3), ("method", "Vipusk barco. phage seque.", 3), ("method", "barcoded phage sequencing (Vipusk)", 3), ("method", "vbps", 3), ("method", "VBPS (Vipusk)", 3),
    ("method", "the Vipusk barcoded phage sequencings pipeline", 3), ("method", "Zabril plasmid modeling", 8), ("database", "Kligima Strai. Catal.", 4), ("database", "kligima-strain-catalog", 4), ("database", "Kligima Strain Catalog v4.2 [1]", 4), ("journal", "Skarovik Q. Comp. Metab.", 5), ("journal", "skarovik q comp metab", 5),
    ("function", "LOW-. KRULIRATE HYDROLASE", 6), ("function", "krulirate hydrolase low-affinity", 6), ("function", "low–affinity krulirate hydrookase", 6),
]
OTHERS = [("organism", "Pukrucoccus laidaensis HVY8094"), ("organism", "Pukrucoccus laidaensis"), ("organism", "Gegremonas reostaiica JA341"), ("organism", "Glolobacter snigriii"), ("method", "Vipusk amplicon sequencing"), ("database", "Kligima Reaction Library"), ("database", "Vipusk barcoded phage sequencing"), ("organism", "this organism"), ("organism", ""), ("method", "the tool"), ("other", "Kligima Strain Catalog"), ("organism", "n/a")]


# decoration as it would be learned
BEFORE, AFTER = {"the", "strain"}, {"sp nov", "pipeline", "str", "strain"}


@pytest.fixture(scope="module")
def matcher():
    return Matcher(ENTRIES)


@pytest.mark.parametrize("kind,text,entry", NAMED)
def test_named(matcher, kind, text, entry):
    assert [e for e, _ in matcher.match([(kind, text)], [BEFORE], [AFTER])[0]] == [entry]


@pytest.mark.parametrize("kind,text", OTHERS)
def test_not_named(matcher, kind, text):
    assert matcher.match([(kind, text)], [BEFORE], [AFTER]) == [[]]


def test_an_exact_hit_leaves_the_near_entries_in():
    near = Matcher([Entry(1, "method", ["plasmid modeling"]), Entry(2, "method", ["plasmid modelling"]), Entry(3, "method", ["plasmid mapping"])])
    assert near.match([("method", "plasmid modeling")]) == [[(1, 0), (2, 1)]]


def test_clean():
    assert clean("  **The Foo-Bar** v1.2 ") == ("the foobar", ()) and clean("AB 12 x") == ("x", ("ab12",))


TEXTS = "record long, kind string, text string, entry_id string, name string"
VOCAB = "entry_id long, entity_kind string, canonical string, aliases array<string>, kind string, text string"


def test_operator(spark):
    rows = [(1, "organism", "HVY8093", "x", "y"), (2, "organism", "hvy 8093", None, None), (2, "organism", "hvy 8093", None, None), (3, None, "HVY8093", None, None), (4, "organism", None, None, None), (5, "organism", "", None, None), (6, "organism", "z" * 200_000, None, None), (7, "pair", "twin", None, None)]
    vocab = [(1, "organism", "Pukrucoccus laidaensis HVY8093", ["HVY8093", None], None, None), (1, "organism", "Pukrucoccus laidaensis HVY8093", ["HVY8093", None], None, None), (2, "pair", "twin", None, None, None), (3, "pair", "Twin", [], None, None), (None, "organism", "q", [], None, None), (9, None, "q", [], None, None), (10, "organism", None, [], None, None)]
    v = spark.createDataFrame(vocab, VOCAB)
    found = match_texts(spark.createDataFrame(rows, TEXTS), "kind", "text", v)
    assert {(r.text, r.entry_id) for r in found.collect()} == {("HVY8093", 1), ("hvy 8093", 1), ("twin", 2), ("twin", 3)}
    # two entries equally near: none is named
    assert {(r.text, r.entry_id) for r in best_entries(found).collect()} == {("HVY8093", 1), ("hvy 8093", 1)}
    assert match_texts(spark.createDataFrame([], TEXTS), "kind", "text", v).count() == 0
    assert match_texts(spark.createDataFrame(rows, TEXTS), "kind", "text", v.where("false")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(e.entry_id, e.kind, e.names[0], e.names[1:], None, None) for e in ENTRIES], VOCAB)
    dressed = [(k, f"{b}{n}{a}", e) for e, k, n in [(x.entry_id, x.kind, x.names[0]) for x in ENTRIES] for b, a in (("strain ", ""), ("the ", ""), ("", " pipeline"), ("the ", " pipeline"), ("", " sp. nov."), ("", " str")) if (k, b) != ("database", "strain ")]  # a word of a name there
    t = spark.createDataFrame([(i, k, x, None, None) for i, (k, x, _) in enumerate(NAMED + dressed)], TEXTS)
    whole = {tuple(r) for r in match_texts(t, "kind", "text", v, beside=1).collect()}
    monkeypatch.setattr(mapping, "BLOCK", 3)
    assert {tuple(r) for r in match_texts(t, "kind", "text", v, beside=1).collect()} == whole and {r[:2] for r in whole} == {(k, x) for k, x, _ in NAMED + dressed}


def test_decoration_is_learned(spark):
    from quillon.llm.mapping import _cleaned, decorations

    v = spark.createDataFrame([(i, "method", n, [], None, None) for i, n in enumerate(["plasmid mapping", "phage sorting", "colony imaging", "flux tracing"])], VOCAB)
    said = ["the plasmid mapping", "the phage sorting", "the colony imaging", "the colony imaging kit", "plasmid mapping kit online", "phage sorting kit", "flux tracing kit", "old flux tracing", "old plasmid mapping", "mapping flux tracing", "mapping phage sorting", "mapping colony imaging"]
    t = _cleaned(spark.createDataFrame([("method", x) for x in said], "kind string, text string"), "text")
    listed = v.selectExpr("entry_id as id", "entity_kind as kind", "canonical as name", "aliases")
    # old stands beside two names only, mapping is a word of a name, online never beside a whole name
    assert {tuple(r) for r in decorations(t, listed).collect()} == {("method", "before", "the"), ("method", "after", "kit")}
    assert decorations(t.where("false"), listed).count() == decorations(t, listed.where("false")).count() == 0
    rows = spark.createDataFrame([(i, "method", x, None, None) for i, x in enumerate(["the fluxx tracing kit kit", "the kit", *said])], TEXTS)
    found = {r.text: r.entry_id for r in match_texts(rows, "kind", "text", v).collect()}
    assert found["the fluxx tracing kit kit"] == 3 and "the kit" not in found and found["the colony imaging kit"] == 2
    plain = {r.text for r in match_texts(rows, "kind", "text", v, beside=None).collect()}
    assert "the fluxx tracing kit kit" not in plain


def test_shortened_words_are_walked_in_the_trie():
    trie, automaton = Trie([("m", f, i) for i, f in enumerate(["barcoded phage sequencing", "barcoded plasmid sequencing", "phage", "annals of microbial ecology"])]), Automaton(2)

    def find(text, limit=1):
        best = {}
        for v, d in zip(*(x.tolist() for x in trie.search(automaton, [("m", text)], [limit], True)[1:])):
            best[v] = min(d, best.get(v, d))
        return sorted(best.items())

    assert find("barco phage seque") == [(0, 0)] and find("barco phagee seque") == [(0, 1)]
    assert find("barcoded p sequencing") == [(0, 0), (1, 0)] and find("b phage sequencing") == [] and find("ba phage sequencing") == []
    assert find("barco pha seque") == [] and find("pha") == [] and find("annals of mic e") == [(3, 0)]
    assert find("barcoded phage sequencing", 0) == []  # nothing is shortened


def test_near_forms_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, n))).strip()
    texts, forms = [(rnd.choice("XY"), word(12)) for _ in range(150)], [(i % 40, rnd.choice("XYZ"), word(12)) for i in range(120)]
    t = spark.createDataFrame([*texts, (None, "a"), ("X", None), ("X", "")], "kind string, words string")
    f = spark.createDataFrame([*forms, (None, "X", "a"), (1, None, "a"), (1, "X", None)], "entry_id long, kind string, form string")
    want = {}
    for k, w in texts:
        for e, h, form in forms:
            if w and form and k == h and (d := edit_distance(w, form)) <= mapping.allowed(len(w)):
                want[k, w, e] = min(d, want.get((k, w, e), d))
    assert {tuple(r) for r in mapping.near_forms(t, "kind", "words", f).collect()} == {(*k, d) for k, d in want.items()}
    assert mapping.near_forms(t.where("false"), "kind", "words", f).count() == mapping.near_forms(t, "kind", "words", f.where("false")).count() == 0
