"""Queries over tables whose pairs are far more than their rows: what they shuffle follows the rows."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES = catalogue.queries()


def shuffled(spark):
    """MB written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) / 1e6


def folder(spark, tmp_path, name, extra):
    """The small tables with ``extra`` rows of one of them, given by some of its columns."""
    for f in os.listdir(FOLDER):
        if f != f"{name}.parquet":
            os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
    rows.unionByName(extra.select(*(F.col(c) if c in extra.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", [
    "two_hop",  # F16
    "sophistication_composite",  # F2, F6, F7, F9, F11, F12, F13: all read its scores
])
def test_a_hub_of_citations(spark, tmp_path, name):
    """3,000 projects cite one that cites 3,000: nine million paths."""
    n = F.col("id").cast("string")
    ends = spark.range(3000).select(F.explode(F.array(F.struct(F.concat(F.lit("in"), n).alias("s"), F.lit("hub").alias("d")), F.struct(F.lit("hub").alias("s"), F.concat(F.lit("out"), n).alias("d")))).alias("e"))
    edges = ends.select(F.concat_ws(">", "e.s", "e.d").alias("edge_id"), F.col("e.s").alias("src_project_id"), F.col("e.d").alias("dst_project_id"), F.lit("declared").alias("confidence_tier"))
    at = folder(spark, tmp_path, "reuse_edges", edges)
    before = shuffled(spark)
    rows = QUERIES[name](spark, at).collect()
    assert shuffled(spark) - before < 25
    if name == "two_hop":
        assert {r.pid: r.two_hop_in_degree for r in rows}["out7"] == 3000


@pytest.mark.parametrize("name", [
    "panel_topic_cosine",  # F5
])
def test_a_name_in_many_projects(spark, tmp_path, name):
    """3,000 projects have one name and nothing else: 4.5 million pairs, none of which is shuffled."""
    one = spark.range(3000).select(F.concat(F.lit("many"), "id").alias("project_id"), F.lit("organism").alias("entity_kind"), F.lit("everywhere").alias("canonical_id"))
    at = folder(spark, tmp_path, "entity_mentions", one)
    before = shuffled(spark)
    rows = QUERIES[name](spark, at)
    if name == "panel_topic_cosine":
        assert rows.where("a like 'many%' and b like 'many%' and cosine = 1").count() == 3000 * 2999 // 2
    else:
        rows.collect()
    assert shuffled(spark) - before < 20


def test_a_name_alone_in_many_projects_and_with_others(spark, tmp_path):  # F1
    """3,000 projects have one name alone, 1,000 have it with two of their own: three million pairs of them, none of which is shuffled."""
    alone = spark.range(3000).select(F.concat(F.lit("many"), "id").alias("project_id"), F.lit("everywhere").alias("canonical_id"))
    more = spark.range(1000).select(F.concat(F.lit("own"), "id").alias("project_id"), F.explode(F.array(F.lit("everywhere"), F.concat(F.lit("u"), "id"), F.concat(F.lit("v"), "id"))).alias("canonical_id"))
    at = folder(spark, tmp_path, "entity_mentions", alone.union(more).withColumn("entity_kind", F.lit("organism")))
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # larger tables are not broadcast
    try:
        rows = QUERIES["panel_topic_cosine"](spark, at)
        assert rows.where("a like 'many%' and b like 'own%' and abs(cosine - 1 / sqrt(3)) < 1e-12").count() == 3_000_000
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved < 5


@pytest.mark.parametrize("name", ["panel_research_lines", "panel_metrics_to_watch"])  # F4, F8
def test_lines_without_threads(spark, tmp_path, monkeypatch, name):
    from quillon.plans.derived import DERIVED

    def refused(w):
        raise AssertionError("the threads are not needed here")

    monkeypatch.setitem(DERIVED, "research_line_subclusters", refused)
    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    assert QUERIES[name](spark, str(tmp_path)).columns


def test_a_name_in_many_projects_of_a_line(spark, tmp_path):
    """3,000 projects of one line have one of two names: 2.2 million topic edges, none of which is shuffled."""
    n = F.concat(F.lit("many"), "id")
    edges = spark.range(1, 3000).select(F.concat(F.lit("e"), "id").alias("edge_id"), n.alias("src_project_id"), F.lit("many0").alias("dst_project_id"), F.lit("declared").alias("confidence_tier"))
    at = folder(spark, tmp_path, "reuse_edges", edges)
    mentions = spark.range(3000).select(n.alias("project_id"), F.lit("organism").alias("entity_kind"), F.concat(F.lit("everywhere"), F.col("id") % 2).alias("canonical_id"))
    old = spark.read.parquet(f"{FOLDER}/entity_mentions.parquet")
    os.unlink(f"{at}/entity_mentions.parquet")
    old.unionByName(mentions, allowMissingColumns=True).select(old.columns).write.parquet(f"{at}/entity_mentions.parquet")
    before = shuffled(spark)
    # the others read the first one's table
    found = {name: QUERIES[name](spark, at).collect() for name in ("research_line_subclusters", "panel_line_threads", "panel_thread_links", "research_lines")}
    assert shuffled(spark) - before < 20
    # the cited one has ends in both and stays alone
    assert [sorted(r.member_count for r in found[name])[-2:] for name in ("research_line_subclusters", "panel_line_threads")] == [[1499, 1500]] * 2
    assert max(r.sub_cluster_count for r in found["research_lines"]) >= 2


def test_lines_counted_by_their_members(spark, tmp_path, monkeypatch):  # F8
    from quillon.plans.derived import DERIVED

    def refused(w):
        raise AssertionError("the lines are not needed here")

    monkeypatch.setitem(DERIVED, "lines_alone", refused)
    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    rows = {r.metric: r.value for r in QUERIES["panel_metrics_to_watch"](spark, str(tmp_path)).collect()}
    monkeypatch.undo()
    assert rows["01 research lines"] == QUERIES["panel_research_lines"](spark, FOLDER).count()


@pytest.mark.parametrize("name", [
    "sophistication_composite",  # F6
    "bundle_axes",  # F2
    "panel_cohort_slope",  # F7
    "panel_sophistication",  # F9
    "sophistication_vs_revisions",  # F11
    "panel_cohort_trends",  # F12
    "panel_reach",  # F13
])
def test_scores_move_each_row_once(spark, tmp_path, name):
    """The scores of 900 projects: mentions are counted in one pass, edges carry numbers (1.1 MB before)."""
    larger = FOLDER.replace("0.001", "0.01")
    for f in os.listdir(larger):
        os.symlink(f"{larger}/{f}", tmp_path / f)
    before = shuffled(spark)
    QUERIES[name](spark, str(tmp_path)).collect()
    assert shuffled(spark) - before < 0.9


def test_neighbourhoods_are_what_their_parts_count(spark):  # F6
    import random

    from quillon.operators import edges as E

    rnd = random.Random(5)
    rows = [(rnd.choice(["declared", "declared", "loose"]), *(None if rnd.random() < 0.05 else f"p{rnd.randrange(25)}" for _ in "sd")) for _ in range(150)]
    reuse = spark.createDataFrame(rows, "confidence_tier string, src_project_id string, dst_project_id string")
    links = spark.createDataFrame([(None if rnd.random() < 0.05 else f"p{rnd.randrange(18)}", None if rnd.random() < 0.1 else f"a{rnd.randrange(9)}") for _ in range(40)], "project_id string, author_id string")
    authors = E.memberships(links)
    classified = E.classify_edges(E.declared(reuse), authors).cache()
    want = E.degrees(classified)
    for part in (E.two_hop(classified), *(E.authors_across(classified, authors, inward, True).groupBy("pid").agg(F.count("*").alias(name)) for inward, name in ((True, "cross_author_downstream"), (False, "distinct_prior_authors")))):
        want = want.join(part, "pid", "full")
    got = E.neighbourhoods(reuse, links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.na.fill(0).select(got.columns).collect()))
    assert len(got.columns) == 8 and got.where("cross_author_downstream > 0 and two_hop_in_degree > 0").count()


@pytest.mark.parametrize("name, most", [
    ("panel_line_threads", 75),  # F3, 87 before
    ("panel_thread_links", 80),  # F14, 91 before
])
def test_lines_take_few_jobs(spark, tmp_path, name, most):
    """Components of few edges are settled in one task, not in rounds."""
    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    QUERIES[name](spark, str(tmp_path)).collect()
    assert jobs() - before <= most


def test_components_in_one_task_and_in_rounds(spark):  # F3
    import random

    from quillon.operators import graph as G

    rnd = random.Random(6)
    ends = [(f"n{rnd.randrange(80):02d}", f"n{rnd.randrange(80):02d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("n99", "n99"), (None, "n00"), ("n01", None)]
    edges = spark.createDataFrame(ends, "src string, dst string")
    one, rounds = (sorted(map(tuple, G.components(edges, few=few).collect())) for few in (10**6, 0))
    assert one == rounds and len({c for _, c in one}) > 5


def test_pairs_of_classes_in_groups(spark):  # F3
    from quillon.operators import graph as G

    held = [(f"g{i}", 0, 1) for i in range(2000)] + [("g7", 1, 3), ("g7", 2, 2), ("g8", 2, 5), ("g9", 3, 4)]
    df = spark.createDataFrame(held, "line string, cls long, m long")
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.6), (1, 2, 0.7), (2, 3, 0.8), (0, 9, 0.9)], "x long, y long, cosine double")
    got = sorted(map(tuple, G.pairs_in_groups(df, pairs, "line").select("line", "x", "y", "cosine", "mx", "my").collect()))
    assert got == [("g7", 0, 1, 0.5, 1, 3), ("g7", 0, 2, 0.6, 1, 2), ("g7", 1, 2, 0.7, 3, 2), ("g8", 0, 2, 0.6, 1, 5)]


def test_communities_of_a_dense_graph():  # F3
    """Nodes with many neighbours are summed as arrays, those with few as lists; both in the same order."""
    import itertools

    from quillon.operators import graph as G

    names = [f"n{i:03d}" for i in range(150)]
    weights = {(a, b): 1.0 if i % 3 == j % 3 else 0.0625 for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)} | {("n000", f"x{i}"): 0.125 for i in range(5)}
    assert sorted(map(len, G.louvain(weights)))[-3:] == [50, 50, 55]


def test_classes_of_names_are_made_once(spark, tmp_path, monkeypatch):  # twice before
    from quillon.operators import graph as G

    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    made, calls = G.alike_sets, []
    monkeypatch.setattr(G, "alike_sets", lambda *args: calls.append(args) or made(*args))
    rows = QUERIES["research_lines"](spark, str(tmp_path)).collect()
    monkeypatch.undo()
    assert len(calls) == 1 and {r.topic_edge_count for r in rows} == {r.topic_edge_count for r in QUERIES["panel_research_lines"](spark, FOLDER).collect()}


@pytest.mark.parametrize("name, most", [
    ("bundle_axes", 35),  # F2, 55 before
    ("panel_cohort_slope", 35),  # F7, 59 before
    ("panel_sophistication", 35),  # F9, 54 before
    ("sophistication_vs_revisions", 35),  # F11, 58 before
    ("panel_cohort_trends", 35),  # F12, 58 before
    ("panel_reach", 35),  # F13, 54 before
])
def test_scores_take_few_jobs(spark, tmp_path, name, most):
    """What is around the projects of a graph of few rows is counted in one task, not table by table."""
    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    QUERIES[name](spark, str(tmp_path)).collect()
    assert jobs() - before <= most


@pytest.mark.parametrize("heavy", [0, 20, 10**6])
def test_neighbourhoods_in_one_task_and_by_tables(spark, monkeypatch, heavy):  # F2
    import random

    from quillon.operators import edges as E
    from quillon.operators import neighbours as N

    rnd = random.Random(heavy)
    rows = [(rnd.choice(["declared", "declared", "loose"]), *(None if rnd.random() < 0.05 else rnd.choice(["hub", f"p{rnd.randrange(30)}", f"p{rnd.randrange(30)}"]) for _ in "sd")) for _ in range(300)]
    reuse = spark.createDataFrame(rows, "confidence_tier string, src_project_id string, dst_project_id string")
    links = spark.createDataFrame([(None if rnd.random() < 0.05 else f"p{rnd.randrange(40)}", None if rnd.random() < 0.1 else f"a{rnd.randrange(9)}") for _ in range(60)], "project_id string, author_id string")
    monkeypatch.setattr(E, "HEAVY", heavy)
    tables = E.neighbourhoods(reuse, links, few=0)
    for step in (1, 7, 10**6):
        monkeypatch.setattr(N, "STEP", step)
        one = list(N.counted((b for b in _edges_and_links(reuse, links)), heavy))
        assert sorted(r for b in one for r in zip(*(c.to_pylist() for c in b.columns))) == sorted(map(tuple, tables.select("pid", *N.NAMES).collect()))
    assert sorted(map(tuple, E.neighbourhoods(reuse, links).select("pid", *N.NAMES).collect())) == sorted(map(tuple, tables.select("pid", *N.NAMES).collect()))
    none = E.neighbourhoods(reuse, links.limit(0))
    assert none.where("self_in_degree + self_out_degree + cross_author_downstream + distinct_prior_authors > 0").count() == 0 and none.count() == tables.count()
    assert E.neighbourhoods(reuse.limit(0), links).count() == 0


def _edges_and_links(reuse, links):
    import pyarrow as pa

    rows = [(True, r.src_project_id, r.dst_project_id) for r in reuse.where("confidence_tier = 'declared' and src_project_id is not null and dst_project_id is not null").collect()]
    rows += [(False, r.project_id, r.author_id) for r in links.where("project_id is not null and author_id is not null").collect()]
    for i in range(0, len(rows), 50):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50]), (pa.bool_(), pa.string(), pa.string()))], names=["edge", "a", "b"])


def test_thread_links_without_names(spark, tmp_path, monkeypatch):  # F14
    """The links need the members of the threads alone, and their components take one task."""
    from quillon.plans.derived import DERIVED

    def refused(w):
        raise AssertionError("what the threads mention is not needed here")

    want = sorted(map(tuple, QUERIES["panel_line_threads"](spark, FOLDER).select("sub_id", "members").collect()))
    monkeypatch.setitem(DERIVED, "research_line_subclusters", refused)
    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    rows = sorted(map(tuple, QUERIES["panel_thread_links"](spark, str(tmp_path)).collect()))
    taken = jobs() - before
    at = {pid: sub for sub, pids in want for pid in pids}
    found: dict = {}
    for e in spark.read.parquet(f"{FOLDER}/reuse_edges.parquet").where("confidence_tier = 'declared'").select("src_project_id", "dst_project_id").distinct().collect():
        x, y = at.get(e[0]), at.get(e[1])
        if x and y and x != y:
            found[min(x, y), max(x, y)] = found.get((min(x, y), max(x, y)), 0) + 1
    assert rows and rows == sorted((a, b, n) for (a, b), n in found.items())
    assert taken <= 65
