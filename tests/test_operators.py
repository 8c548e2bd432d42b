import datetime as dt
import itertools
import random
from math import sqrt

import pytest
from pyspark.sql import functions as F

from quillon import schemas
from quillon.functions import text as X
from quillon.operators import edges as E
from quillon.operators import graph as G
from quillon.operators import intervals, pairs, ranking, scores
from quillon.sources import warehouse as W


def authors(spark, **of):
    return E.memberships(spark.createDataFrame([(p, a) for p, who in of.items() for a in who] or [("none", None)], "project_id string, author_id string"))


def test_three_readings_of_an_edge(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("d", "c"), ("c", None)], "src string, dst string")
    rows = {(r.src, r.dst): (r.loose, r.strict, r.own) for r in E.classify_edges(edges, authors(spark, a="xy", b="y", c="z")).collect()}
    assert rows == {("a", "b"): (False, False, True), ("a", "c"): (True, True, False), ("a", "d"): (True, False, True), ("d", "c"): (True, False, True), ("c", None): (True, False, True)}


def test_degrees_and_two_hop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("b", "a"), ("e", None)], "src string, dst string")
    c = E.classify_edges(edges, authors(spark, a="x", b="y", c="z", d="w"))
    d = {r.pid: (r.in_degree, r.out_degree) for r in E.degrees(c).collect()}
    assert d == {"a": (2, 1), "b": (2, 2), "c": (1, 1), "d": (0, 1)}
    assert {r.pid: r.two_hop_in_degree for r in E.two_hop(c).collect()} == {"c": 2, "a": 2, "b": 1}


@pytest.mark.parametrize("values,want", [([5, 5, 5], [0, 0, 0]), ([-1, 0, 1], [-sqrt(1.5), 0, sqrt(1.5)]), ([], [])])
def test_standard_scores(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    got = [r.z_v for r in scores.standardised(df, ["v"], F.lit(True)).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_weights_and_early_projects(spark):
    names = list(dict.fromkeys(n for w in scores.AXES.values() for n in w))
    rows = [(p, *(v if n in ("revision_count", "canonical_doc_bytes") else 0 for n in names)) for p, v in (("a", 0), ("b", 1000), ("c", 3000))]
    raw = spark.createDataFrame(rows, "project_id string, " + ", ".join(f"{n} long" for n in names))
    mentions = spark.createDataFrame([], "x int")
    got = {r.project_id: r for r in scores.axis_scores(raw, mentions).collect()}
    assert got["a"].too_early and got["a"].depth_score is None and got["a"].partial_phase_2b
    assert got["b"].depth_score == pytest.approx(-2 / 5) and got["c"].depth_score == pytest.approx(2 / 5) and got["b"].influence_score == 0
    config = scores.ScoreConfig()
    config.axes["depth"] = {"revision_count": 1.0, "notebook_count": 0.0}
    assert scores.axis_scores(raw, mentions, config).where("project_id = 'c'").first().depth_score == pytest.approx(1)


def test_components(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("hub", f"x{i}") for i in range(99)] + [("s", "s"), (None, "q"), ("q", None)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert len(got) == 151 + 100 + 1 and {got[n] for n in got if n[0] == "c"} == {"c000"} and got["x7"] == "hub" and got["s"] == "s"
    assert G.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_cosine_pairs(spark):
    import random

    rnd = random.Random(4)
    sets = {f"p{i:02d}": {f"t{rnd.randrange(12)}" for _ in range(rnd.randint(1, 7))} | ({"hot"} if i % 3 else set()) for i in range(60)}
    held = spark.createDataFrame([(p, t) for p, ts in sets.items() for t in ts], "pid string, token string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / sqrt(len(sets[a]) * len(sets[b])) >= 0.5}
    assert {(r.a, r.b) for r in G.cosine_pairs(held, 0.5).collect()} == want


def test_cosine_pairs_cut_into_parts(spark, monkeypatch):
    """Blocks, copies and parts of a few rows give the same pairs, each once; no project has no pair."""
    import random

    for name, n in (("BLOCK", 3), ("SENT", 2), ("MET", 2)):
        monkeypatch.setattr(G, name, n)
    rnd = random.Random(5)
    sets = {f"p{i:02d}": {"hot"} if i % 3 == 0 else {"hot", "warm"} if i % 3 == 1 else {f"t{rnd.randrange(5)}" for _ in range(rnd.randint(1, 4))} | {"hot"} for i in range(70)}
    held = spark.createDataFrame([(p, t) for p, ts in sets.items() for t in ts] + [(None, "hot")], "pid string, token string")
    want = sorted((a, b, len(sets[a] & sets[b]) / sqrt(len(sets[a]) * len(sets[b]))) for a in sets for b in sets if a < b)
    assert sorted(map(tuple, G.cosine_pairs(held, 0.5).collect())) == [w for w in want if w[2] >= 0.5]


def clique(names):
    return {(a, b): 1.0 for i, a in enumerate(names) for b in names[i + 1 :]}


def test_louvain():
    weights = clique("abcde") | clique("vwxyz") | {("a", "z"): 0.1}
    assert sorted(map(sorted, G.louvain(weights, 1.0))) == [list("abcde"), list("vwxyz")]
    assert G.louvain(weights, 1.5) == G.louvain(weights, 1.5) and G.louvain({}) == []


def test_communities(spark):
    rows = [(1, a, b, w) for (a, b), w in (clique("abcde") | clique("vwxyz") | {("a", "z"): 0.1}).items()] + [(2, "p", "q", 1.0)]
    got = G.communities(spark.createDataFrame(rows, "line_id int, a string, b string, weight double"), "line_id").collect()
    assert sorted((r.line_id, r.community, r.member) for r in got) == [(1, 0, c) for c in "abcde"] + [(1, 1, c) for c in "vwxyz"] + [(2, 0, "p"), (2, 0, "q")]


def test_interval_rows(spark):
    assert intervals.colour([1, 2, 9], [5, 8, 10]) == [0, 1, 0] and intervals.colour([1, 6], [5, 8]) == [0, 0] and intervals.colour([], []) == []
    d = lambda n: dt.date(2026, 1, n)
    bars = spark.createDataFrame([("x", "A", d(1), d(5)), ("x", "B", d(2), d(8)), ("x", "C", d(9), d(10)), ("y", "A", d(1), d(2))], "who string, item string, start date, end date")
    placed = intervals.sub_rows(bars, "who", "item")
    assert sorted((r.who, r.item, r.sub_row) for r in placed.collect()) == [("x", "A", 0), ("x", "B", 1), ("x", "C", 0), ("y", "A", 0)]
    assert [(r.who, r.height, r.offset) for r in intervals.row_blocks(placed, "who").orderBy("who").collect()] == [("x", 2, 0), ("y", 1, 2)]


def test_gaps(spark):
    rows = [(f"p{i}", "organism", "o") for i in range(6)] + [(f"p{i}", "method", "m") for i in range(5, 11)] + [(f"p{i}", "method", "n") for i in range(6)] + [("p1", "organism", "proposed:z"), ("p2", "organism", None)]
    m = spark.createDataFrame(rows, "project_id string, entity_kind string, canonical_id string")
    got = [(r.a_canonical, r.b_canonical, r.actual, round(r.expected, 2)) for r in pairs.underexplored_gaps(m).collect()]
    assert got == [("m", "o", 1, 3.27)]
    assert pairs.cooccurrence(m, ("organism", "method"), 6).count() == 1


def test_ranks_and_caps(spark):
    raw = spark.createDataFrame([(f"t{i}", "high", 2.0) for i in range(5)] + [("u", None, None), ("v", "odd", -1.0), ("w", "low", 0.3), ("", "high", 1.0)], "title string, priority string, plausibility double")
    got = [(r.title, r.priority, r.plausibility) for r in ranking.rank_recommendations(raw).orderBy("rec_index").collect()]
    assert [g[1] for g in got] == ["high"] * 3 + ["medium"] * 4 + ["low"] and got[5] == ("u", "medium", 0.5) and got[6][2] == 0 and got[0][2] == 1
    f = spark.createDataFrame([(f"c{i}", "odd" if i else "action_indicated", i / 4) for i in range(7)], "claim string, so_what string, confidence double")
    got = [(r.claim, r.so_what, r.confidence) for r in ranking.rank_findings(f).orderBy("finding_index").collect()]
    assert [g[0] for g in got] == ["c4", "c5", "c6", "c3", "c2"] and {g[1] for g in got} == {"watch_for_change"}


def test_cap_for_each_project(spark):
    rows = [(f"p{p}", f"m{i:02d}") for p in range(5) for i in range(30)]
    got = ranking.first_k(spark.createDataFrame(rows, "p string, m string"), ["p"], [F.asc("m")], 20)
    assert got.count() == 100 and got.groupBy("p").count().where("count <> 20").count() == 0


def test_text(spark):
    df = spark.createDataFrame([("  Foo-Bar_/ x  Y ", "**b** *i* __u__ `c`", "Ann (Lab) — X | Y"), (None, None, None), ("", "", "(only)")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(X.normal_token(F.col("a")), X.plain_markdown(F.col("b")), X.display_name(F.col("c"))).collect()]
    assert got == [("foobar x y", "b i u c", "Ann"), (None, None, "(unknown)"), ("", "", "(unknown)")]


def test_jitter_is_stable(spark):
    import hashlib

    r = spark.range(1).select(X.jitter(F.lit("p1"), "x").alias("j")).first().j
    assert r == pytest.approx((int(hashlib.md5(b"p1:x").hexdigest()[:8], 16) / 0xFFFFFFFF - 0.5) * 0.3)


def test_keys_and_latest(spark):
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), "a"), (1, dt.datetime(2026, 1, 2), "b"), (1, dt.datetime(2026, 1, 2), None), (2, None, "c"), (None, None, None)], "k int, observed_at timestamp_ntz, v string")
    assert {(r.k, r.v) for r in schemas.latest_rows(df, ["k"]).collect()} == {(1, "b"), (2, "c"), (None, None)}
    assert {(r.k, r.reason) for r in schemas.key_violations(df, ["k"]).collect()} == {(1, "repeated key"), (None, "null key")}
    assert schemas.conform(spark.createDataFrame([(1,)], "x int"), "authors").columns == schemas.SCHEMAS["authors"].fieldNames()


def test_warehouse(spark, tmp_path):
    w = W.Warehouse(spark, str(tmp_path))
    rows = lambda *ids: schemas.conform(spark.createDataFrame([(i, n) for i, n in ids], "author_id string, canonical_name string"), "authors")
    names = lambda: {(r.author_id, r.canonical_name) for r in w.table("authors").collect()}
    assert w.table("authors").count() == 0
    w.replace("authors", rows(("a", "1"), ("b", "2")))
    w.replace("authors", w.table("authors").where("author_id = 'a'"))  # reads what it replaces
    assert names() == {("a", "1")}
    assert not w.replace_if_any("authors", w.table("authors").where("false")) and names() == {("a", "1")}
    w.upsert("authors", rows(("a", "9"), ("c", "3")))
    assert names() == {("a", "9"), ("c", "3")}
    assert w.append_new("authors", rows(("a", "0"), ("d", "4"))).count() == 1 and names() == {("a", "9"), ("c", "3"), ("d", "4")}
    with pytest.raises(ValueError):
        w.replace("authors", rows(("a", "1"), ("a", "2")))
    links = schemas.conform(spark.createDataFrame([("p", "a"), ("p", "zz")], "project_id string, author_id string"), "project_authors")
    w.replace("project_authors", links)
    w.purge("project_authors", "authors", "author_id")
    assert [r.author_id for r in w.table("project_authors").collect()] == ["a"]


def test_author_merge(spark):
    a = spark.createDataFrame([("o1", "1", "Ann"), ("n1", None, "Ann"), ("o2", "2", "Bo"), ("o3", "3", "Bo"), ("n2", None, "Bo"), ("n3", None, "Cy")], "author_id string, orcid_id string, canonical_name string")
    kept, links = W.merge_name_only_authors(a, spark.createDataFrame([("p", x) for x in ("o1", "n1", "n2", "n3")], "project_id string, author_id string"))
    assert {r.author_id for r in kept.collect()} == {"o1", "o2", "o3", "n2", "n3"} and sorted(r.author_id for r in links.collect()) == ["n2", "n3", "o1", "o1"]


def test_enrich(spark):
    d = dt.date
    p = spark.createDataFrame([("a", None, None, None, None), ("b", None, None, None, None)], "project_id string, start_date date, completion_date date, revision_depth int, effective_completion_date date")
    r = spark.createDataFrame([("a", "RESEARCH_PLAN", d(2026, 1, 1)), ("a", "RESEARCH_PLAN", d(2026, 2, 1)), ("a", "REPORT", d(2026, 3, 1)), ("b", "REPORT", d(2026, 4, 1))], "project_id string, source_doc string, version_date date")
    got = {x.project_id: tuple(x)[1:] for x in W.enrich_projects(p, r).collect()}
    assert got == {"a": (d(2026, 1, 1), d(2026, 2, 1), 2, d(2026, 3, 1)), "b": (None, None, None, d(2026, 4, 1))}


class Lengths:
    model_id = "m"

    def label(self, texts):
        if "boom" in texts:
            raise RuntimeError("gone")
        return [("deepening" if len(t) > 3 else "odd", 7, None) for t in texts]


def test_labels(spark):
    from quillon.operators import classify

    rows = spark.createDataFrame([("e1", "long text"), ("e2", "abc"), ("e3", None), ("e4", "boom"), ("e5", "old")], "edge_id string, q string").coalesce(1)
    known = spark.createDataFrame([("e5", "v1"), ("e1", "v0")], "edge_id string, prompt_version string")
    todo = classify.unlabelled(rows, known, ["edge_id"], "v1")
    got = {r.edge_id: (r.label, r.confidence, r.rationale) for r in classify.label_rows(todo, "q", ["edge_id"], ["deepening"], Lengths, "v1", batch_size=1).collect()}
    assert got == {"e1": ("deepening", 1.0, None), "e2": ("other", 1.0, None), "e3": ("other", 1.0, None), "e4": ("other", 0.0, "gone")}


def test_ring(spark):
    nodes = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "n string")
    assert [(r.node, round(r.x, 6), round(r.y, 6)) for r in G.ring_layout(nodes, "n").orderBy("node").collect()] == [("a", 1, 0), ("b", -1, 0)]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from quillon.session import shared_dir

    def fake(master, place=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: place), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        shared_dir(fake("spark://host:7077"))
    assert shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"


def test_threshold_scan_equals_all_pairs(spark):
    import random
    from itertools import product

    from quillon.operators import pairs

    rnd = random.Random(5)
    names = [(k, f"{k[0]}{i}") for k in ("organism", "method", "database") for i in range(14)]
    has = {p: {n for n in names if rnd.random() < 0.5 / (1 + int(n[1][1:]))} for p in (f"p{i}" for i in range(160))}
    # a few that are frequent and never together, so the scan has to go on
    has |= {f"q{i}": {("organism", "o0") if i % 2 else ("method", "m0")} for i in range(30)}
    m = spark.createDataFrame([(p, k, n) for p, held in has.items() for k, n in held], "project_id string, entity_kind string, canonical_id string")
    count = {n: sum(n in held for held in has.values()) for n in names}
    total = sum(bool(held) for held in has.values())
    every = [(a, b, sum(a in held and b in held for held in has.values())) for a, b in product(names, names) if a[0] < b[0] and min(count[a], count[b]) >= 5]
    for most in (1, 0, 30):
        few = [x for x in every if x[2] <= most]
        got = [(r.a_canonical, r.b_canonical, r.actual) for r in pairs.underexplored_pairs(m, most_together=most, top=9).collect()]
        assert got == [(a[1], b[1], k) for a, b, k in sorted(few, key=lambda x: (-count[x[0]] * count[x[1]], x[0], x[1]))[:9]]
        gaps = sorted(((count[a] * count[b] / total - k, a, b) for a, b, k in few), key=lambda x: (-round(x[0], 9), x[1], x[2]))
        found = pairs.underexplored_gaps(m, most_together=most, top=9).collect()
        assert [round(r.gap, 6) for r in found] == [round(g, 6) for g, _, _ in gaps[:9] if g > 0]
    assert pairs.underexplored_pairs(m.where("false")).count() == pairs.underexplored_gaps(m.where("false")).count() == 0


@pytest.mark.parametrize("heavy", [1, 6, 40, 10**9])
def test_two_hop_by_classes_and_by_paths(spark, heavy):
    import random

    rnd = random.Random(heavy)
    edges = {(f"p{rnd.randrange(60)}", f"p{rnd.choice((0, 1, 2, rnd.randrange(60)))}") for _ in range(160)} | {(f"p{rnd.randrange(3)}", f"p{rnd.randrange(60)}") for _ in range(60)}
    none = authors(spark)
    c = E.classify_edges(spark.createDataFrame([*edges, ("p1", None), (None, "p1")], "src string, dst string"), none)
    want = {}
    for far, mid in edges:
        for at, pid in edges:
            if at == mid and far != pid:
                want.setdefault(pid, set()).add(far)
    got = [tuple(r) for r in E.two_hop(c, heavy).collect()]
    assert sorted(got) == sorted((p, len(f)) for p, f in want.items())


def test_louvain_by_classes():
    """The communities of the graph that the classes stand for, whatever the order of the pairs."""
    rnd = random.Random(3)
    names = [f"n{i:02d}" for i in range(30)]
    for _ in range(40):
        cls = {n: rnd.randrange(8) for n in names if rnd.random() < 0.7}
        alike = {(x, y): rnd.choice([0.5, 0.625, 0.75]) for x, y in itertools.combinations(range(8), 2) if rnd.random() < 0.3}
        cited = {tuple(sorted(rnd.sample(names, 2))): 1.0 for _ in range(25)}
        listed = dict(cited)
        for a, b in itertools.combinations(names, 2):
            if a in cls and b in cls:
                x, y = sorted((cls[a], cls[b]))
                if x == y or (x, y) in alike:
                    listed[a, b] = listed.get((a, b), 0.0) + alike.get((x, y), 1.0)
        for resolution in (1.0, 1.5):
            assert sorted(map(sorted, G.louvain_classes(cited, cls, alike, resolution))) == sorted(map(sorted, G.louvain(listed, resolution)))
    assert G.louvain_classes({}, {}, {}) == [] and G.louvain_classes({}, {"a": 1}, {}) == []
