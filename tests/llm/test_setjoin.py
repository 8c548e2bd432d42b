import random
from math import sqrt

import pytest

from quillon.llm.setjoin import overlap_needed, similar_sets

SCHEMA = "pid string, v string, side string, n long, token string"


def rows_of(sets):
    return [(p, v, "x", 1, None) for p, vs in sets.items() for v in vs]


def brute(sets, theta):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / sqrt(len(sets[a]) * len(sets[b])) >= theta - 1e-12}


def found(join):
    got = [tuple(r) for r in join.pairs().collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_sets(seed, n, most, words):
    rnd = random.Random(seed)
    sets = {}
    for i in range(n):
        base = sets[f"p{rnd.randrange(i):03d}"] if i and rnd.random() < 0.5 else set()
        s = {x for x in base if rnd.random() < 0.85} | {f"w{min(rnd.randrange(words), rnd.randrange(words))}" for _ in range(rnd.randint(0, most))}
        sets[f"p{i:03d}"] = s | {"hot"} if rnd.random() < 0.6 else s
    return sets


@pytest.mark.parametrize("theta,large", [("0.6", 256), ("0.6", 8), ("0.35", 256), ("0.35", 6), ("0.9", 256), ("1", 256)])
def test_equals_brute_force(spark, theta, large):
    sets = random_sets(7, 120, 9, 60)
    df = spark.createDataFrame(rows_of(sets), SCHEMA)
    assert found(similar_sets(df, "pid", "v", theta, large_size=large)) == brute(sets, float(theta))


def test_threshold_itself_counts_and_sizes_one_and_two(spark):
    sets = {"a": {"x"}, "b": {"x"}, "c": {"x", "y"}, "d": {"x", "y", "z"}, "e": {str(i) for i in range(25)}, "f": {str(i) for i in range(9)}}
    df = spark.createDataFrame(rows_of(sets), SCHEMA)
    # 9 of 25: 9 / sqrt(9 * 25) is exactly 0.6
    assert ("e", "f") in found(similar_sets(df, "pid", "v"))
    assert found(similar_sets(df, "pid", "v")) == brute(sets, 0.6)


def test_nulls_repeats_empty_and_odd_values(spark):
    rows = [("a", "x", None, None, None)] * 3 + [("b", "x", None, 2, "t"), ("a", None, None, None, None), (None, "x", None, None, None), ("c", "", None, None, None), ("d", "", None, None, None), ("e", "y" * 100_000, None, 1, None), ("f", "y" * 100_000, None, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(similar_sets(df, "pid", "v")) == {("a", "b"), ("c", "d"), ("e", "f")}
    assert found(similar_sets(df.where("false"), "pid", "v")) == set()


def test_copies_are_one_class_and_counted(spark):
    sets = {f"c{i}": {"a", "b", "c", "d"} for i in range(5)} | {"n": {"a", "b", "c", "d", "e"}, "m": {"e", "q"}}
    join = similar_sets(spark.createDataFrame(rows_of(sets), SCHEMA), "pid", "v")
    assert join.class_pairs.count() == 1
    assert found(join) == brute(sets, 0.6)
    links = {r["id"]: r["n_links"] for r in join.links().collect()}
    assert links == {**{f"c{i}": 5 for i in range(5)}, "n": 5, "m": 0}
    assert {r["id"]: r["class_id"] for r in join.links().collect()} == {**{f"c{i}": "c0" for i in range(5)}, "n": "n", "m": "m"}


def test_between_two_tables(spark):
    left, right = random_sets(1, 40, 6, 25), random_sets(2, 40, 6, 25)
    right["p000"] = set(left["p001"])
    a, b = spark.createDataFrame(rows_of(left), SCHEMA), spark.createDataFrame(rows_of(right), SCHEMA)
    want = {(x, y) for x, s in left.items() for y, t in right.items() if s and t and len(s & t) / sqrt(len(s) * len(t)) >= 0.6 - 1e-12}
    for large in (256, 5):
        assert found(similar_sets(a, "pid", "v", "0.6", b, large_size=large)) == want


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        similar_sets(spark.createDataFrame([], SCHEMA), "pid", "v", "0")


def test_overlap_needed():
    assert [overlap_needed(a, b) for a, b in ((1, 1), (1, 2), (12, 12), (9, 25))] == [1, 1, 8, 9]
