import re

import pytest

from quillon.llm.names import align, link_names, name_pairs, name_tokens, place_words, same_name, same_place, valid_id

SAME = [
    ("Katya Gratrokai", "Ekaterina T. Gratrokai"), ("GRATROKAI, Ekaterina", "Ekaterina Gratrokai"), ("Gavreopuv KE", "Katherine E. Gavreopuv"), ("Koposhuv MR", "Maria José R. Koposhuv"), ("**Yuki Datreozherk**", "Yuki Datreozherk, PhD (lead)"), ("Jennifer Steoeklitold", "Jennifer Steöklitold"),
    ("O. F. Glopevráv", "Omar Glopevráv-Mihumo"), ("Samanhta Grokrasné", "Samantha Grokrasne"), ("Hukezo Deep Soil Cons.", "Hukezo Deep Soil Consortium"), ("Deep Soil Consortium, Genaista", "Genaista deep soil consortium (GDSC)"), ("Dr. Ben Vrosnaiplin", "Vrosnaiplin, B.A."), ("Nenusneon, M.A.", "Maria José Nenusneon"), ("Majó Faraifeon", "Faraifeon M"), ("Hannes Puhares", "Johannes Puhares, PhD"), ("Nick Puhares", "Niholas Puhares"),
]
OTHER = [("Jin Breomithav", "Jonathan Breomithav"), ("Jin A. Breomithav", "Jin B. Breomithav"), ("Leila Gavreopuv", "Leila Krutaigeld"), ("Genaista Deep Soil Consortium", "Hukezo Deep Soil Consortium"), ("Samantha G. Faibaidild", "Samantha J. Grokrasné"), ("Jin", "Jin Breomithav"), ("Giuseppe R. Kruvraipun", "Giuseppe Rupaigruv"), ("", "Jin Breomithav")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert same_name(name_tokens(a), name_tokens(b)) and same_name(name_tokens(b), name_tokens(a))


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not same_name(name_tokens(a), name_tokens(b))


def test_ids():
    assert valid_id("https://orcid.example/0000-0002-1825-0097") == valid_id("0000000218250097") == valid_id("ORCID: 0000‐0002‐1825‐0097") == "0000000218250097"
    assert valid_id("0000-0002-1694-233x") == "000000021694233X"
    for bad in (None, "", "n/a", "TBD", "0000-0000-0000-0000", "0000-0000-0000-000X", "0000-0002-1825-0098", "0000-0002-1825"):
        assert valid_id(bad) is None


def test_places():
    assert place_words("HASKIN (HIT)") == ["haskin"] and place_words("Dépt. of Microbiology, Haskin, of") == ["dept", "of", "microbiology", "haskin"] and place_words(None) == []
    assert same_place(["thainivik"], ["thaiivik"]) and not same_place(["haskin"], ["drusnil"]) and not same_place(None, ["haskin"]) and not same_place([], [])
    assert same_place(["haskin"], ["haskni", "bay"]) and not same_place(["haskin", "lake"], ["haskin", "bay", "town"])


def test_general_words_of_places_are_learned(spark):
    from quillon.llm.names import _places
    from quillon.session import Workspace

    towns = ["Haskin", "Drusnil", "Gosask", "Faikeoton", "Statreoby", "Draiplol", "Skiraivik", "Thainivik", "Pluskisk", "Zomeby"]
    typed = [f"{a} {b}" for a in towns for b in ("Marine Station", "Univ.")] + [f"Genomics Core, {a} Univ." for a in towns[:6]] + ["Haskin Marnie Station", "Univ. Drusnil Marine Sattion"]
    sites = spark.createDataFrame([(place_words(x),) for x in typed] + [([],)], "site array<string>")
    got = {tuple(r.site): (r.place, r.seat) for r in _places(Workspace(spark), sites).collect()}
    assert len(got) == len(typed) and all(place == [seat] for place, seat in got.values())
    assert {seat for _, seat in got.values()} == {x.lower() for x in towns}
    assert _places(Workspace(spark), sites.where("false")).count() == 0


def test_align_is_optimal():
    cost, pairs = align(["a", "anna", "smith"], ["anna", "smith"])
    assert sorted(pairs) == [(1, 0), (2, 1)] and cost == 0


def test_align_is_optimal_with_many_tokens():
    rest = "efghijklm"
    a = ["aaaaaaa", "ddaaaab", *(c * 7 for c in rest)]
    b = ["aaaaaab", "aaaaacc", *(c * 6 + "z" for c in rest)]
    for cost, pairs in (align(a, b), align(b, [*a, "qqqqqqq"])):
        assert len(pairs) == 11 and cost == pytest.approx(0.6 + 0.6 + 9 * 0.3)


SCHEMA = "author_id string, canonical_name string, affiliation string, orcid_id string, person string, token string"
A, B = "0000-0002-1825-0097", "0000-0002-1694-233X"


def run(spark, rows):
    df = spark.createDataFrame([(*r, None, "t") for r in rows], SCHEMA)
    got = [tuple(r) for r in name_pairs(df, "author_id", "canonical_name", "affiliation", "orcid_id").collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_people(spark):
    rows = [
        ("1", "Jin Breomithav", "Statreoby Marine Station", A), ("2", "Breomithav, J.", "Draiplol Marine Station", A), ("3", "Jin Breomithav-Gomavri", None, A), ("4", "Jin Breomithav", "Statreoby Marine Station, Bioinformatics Core", None),
        ("5", "Jin Breomithav", "Faikeoton State University", None), ("6", "Jin Breomithav", None, None), ("7", "Leila Krutaigeld", "Haskin Institute", A), ("8", "jin brepmithav", "statreoby marine station", None), ("9", "Jin Breomithav", "Gosask Marine Station", B),
    ]
    one = ["1", "2", "3", "4", "8"]
    assert run(spark, rows) == {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]}


def test_initials_do_not_join_two_people(spark):
    rows = [("1", "Jin Breomithav", "Haskin Institute", None), ("2", "Johannes Breomithav", "Haskin Institute", None), ("3", "J. Breomithav", "Haskin Institute", None), ("4", "Kofi Zekluple", "Haskin Institute", None), ("5", "K. Zekluple", "Haskin Institute", None)]
    assert run(spark, rows) == {("4", "5")}


def test_initials_with_an_id_stay_with_it(spark):
    rows = [("1", "Renée Breomithav", "Drusnil Institute", A), ("2", "R. Breomithav", "Haskin Institute", A), ("3", "Robert Breomithav", "Haskin Institute", None)]
    assert run(spark, rows) == {("1", "2")}


def test_edge_cases(spark):
    rows = [("1", "Jin Breomithav", "Haskin", A), ("1", "Jin Breomithav", "Haskin", A), (None, "Jin Breomithav", "Haskin", A), ("2", None, "Haskin", A), ("3", "", "Haskin", A), ("4", "Jin Breomithav", "Haskin", A), ("5", "x" * 50_000, "Haskin", None), ("6", "。。", None, None)]
    assert run(spark, rows) == {("1", "4")}
    assert run(spark, []) == set()


def test_every_neighbour_is_a_candidate(spark):
    crowd = [(f"{k}{i}", f"{chr(97 + i)}x {name}", None, None) for k, name, n in (("e", "Jensen", 9), ("h", "Hansen", 6), ("j", "Jansen", 3)) for i in range(n)]
    assert run(spark, [*crowd, ("1", "Petr Jansen", "Haskin", None), ("2", "Peter Kansen", "Haskin", None)]) == {("1", "2")}
    assert run(spark, [*crowd, ("1", "Petr Jansen", "Haskin", A), ("2", "Peter Kansen", "Drusnil", A)]) == {("1", "2")}
    # two edits, one of them a swap; places of three letters; a place between more frequent ones
    sites = [(f"{p}{i}", f"Person{chr(97 + i)}{p} Of", p, None) for p, n in (("drusnal", 5), ("drusnel", 4)) for i in range(n)]
    rows = [("1", "Jin Breomithav", "Haskin", None), ("2", "Jin Beromithaf", "Haskin", None), ("3", "Kofi Zekluple", "eth", None), ("4", "Kofi Zekluple", "ehh", None), ("5", "Ada Lovegrin", "drusnil", None), ("6", "Ada Lovegrin", "drusnol", None)]
    assert run(spark, [*sites, *rows]) >= {("1", "2"), ("3", "4"), ("5", "6")}


def test_long_places_meet_across_the_bound(spark):
    site = "qwertzuiopasdfghjklyxcvbnmqwertz"
    assert len(site) == 32
    rows = [("1", "Jin Breomithav", site, None), ("2", "Jin Breomithav", site[:20] + "x" + site[20:], None), ("3", "Jin Breomithav", site[:5] + site[6:], None), ("4", "Jin Zekluple", site, None)]
    assert run(spark, rows) == {("1", "2"), ("1", "3"), ("2", "3")}
    two = [("1", "Kofi Zekluple", site + "ab", None), ("2", "Kofi Zekluple", site[:9] + site[10] + site[9] + site[11:] + "ac", None)]
    assert run(spark, two) == {("1", "2")}


def test_short_names(spark):
    rows = [
        ("1", "Wei Xu", "Haskin", A), ("2", "Xu, Wei", "Drusnil", A), ("3", "W. Xu", None, A), ("4", "Bo Li", "Haskin", B), ("5", "王伟", "Haskin", B), ("6", "王伟", "Drusnil", B), ("7", "Bo Li", "Drusnil", None),
        ("8", "Ana Ng", "Gosask", None), ("9", "Ng, Ana", "Gosaks", None), ("a", "Ana Ni", "Gosask", None), ("b", "李明", "Gosask", None), ("c", "李明", "Gosaks", None), ("d", "Ark Team", None, None), ("e", "Ark Team", "Haskin", None), ("f", "Wei Xi", "Haskin", A),
    ]
    assert run(spark, rows) == {("1", "2"), ("1", "3"), ("2", "3"), ("5", "6"), ("8", "9"), ("b", "c"), ("d", "e")}


def test_organisations(spark):
    rows = [("1", "Genaista Deep Soil Consortium", None, None), ("2", "Deep Soil Consortium, Genaista", "Skiraivik (SCMR)", None), ("3", "Hukezo Deep Soil Consortium", None, None), ("4", "Genaista Deep Soil Cons.", "Skiraivik Centre for Microbial Research", None), ("5", "Genaista DSC", "Skiraivik (SCMR)", None)]
    assert run(spark, rows) == {(a, b) for i, a in enumerate("1245") for b in "1245"[i + 1 :]}


def test_organisations_meet_at_any_word(spark):
    crowd = [(f"c{i}", f"{w} Soil Consortium", "Drusnil", None) for i, w in enumerate(("Hukezo Lake", "Skiraivik Dark", "Tovadrai Pond"))]
    rows = [("1", "Genaista Deep Soil Consortium", None, None), ("2", "Haskin Genaista Deep Siol Consortium", None, None)]
    assert run(spark, [*crowd, *rows]) == {("1", "2")}


def test_everyone_has_a_person(spark):
    df = spark.createDataFrame([("b", "Jin Breomithav", "Haskin", None, None, None), ("a", "Kofi Zekluple", None, None, None, None)], SCHEMA)
    assert {tuple(r) for r in link_names(df, "author_id", "canonical_name", "affiliation", "orcid_id").collect()} == {("a", "a"), ("b", "b")}


def test_deletions_are_not_broadcast(spark, monkeypatch):  # F1 p5
    """What is listed of each token is many times the tokens, so the driver must not hold it."""
    from quillon.llm import names as N

    plans = []
    keep = N.Workspace.keep

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(N.Workspace, "keep", noted)
    rows = [(str(i), f"Name{'abcdefghij'[i % 10]}xyz Family{'klmnopqrst'[i // 10]}uvw", "Institute of Somewhere", None) for i in range(100)]
    N.link_names(spark.createDataFrame(rows, "id string, name string, place string, code string"), "id", "name", "place", "code")
    # what a broadcast is made of, down to the next join or table
    sent = [re.split("Join|Scan", part)[0] for p in plans for part in p.split("BroadcastExchange")[1:]]
    assert any("levenshtein" in p for p in plans) and not any("Generate explode(array_distinct" in part for part in sent)
