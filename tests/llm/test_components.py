import random


from quillon.llm.components import connected_groups

SCHEMA = "s string, d string, node string, u long"


def brute(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(n, root(n)) for n in parent}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "zz", 1) for a, b in pairs], SCHEMA)
    got = [tuple(r) for r in connected_groups(df, "s", "d").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_chain_star_loops_nulls_and_repeats(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"x{i}") for i in range(200)] + [("me", "me")] * 3 + [("a", None), (None, "b"), (None, None), ("", "q"), ("z", "y"), ("y", "z")]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == set()


def test_code_point_order(spark):
    pairs = [("Z", "a"), ("é", "z"), ("\U0001f600", "￿")]
    got = dict(run(spark, pairs))
    assert got["a"] == "Z" and got["é"] == "z" and got["\U0001f600"] == "￿"


def test_random_graphs(spark):
    rnd = random.Random(3)
    for n, m in ((40, 25), (60, 80), (30, 200)):
        pairs = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        assert run(spark, pairs) == brute(pairs)


def test_a_hub_of_a_tenth_of_the_edges(spark):
    rnd = random.Random(8)
    pairs = [("hub", f"n{rnd.randrange(4000)}") for _ in range(1000)] + [(f"n{rnd.randrange(4000)}", f"n{rnd.randrange(4000)}") for _ in range(1500)]
    assert run(spark, pairs) == brute(pairs)
