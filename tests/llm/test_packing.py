import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from quillon.llm.packing import pack_items, plan_bins


def expand(plan):
    """The bins of a plan with the places taken in each."""
    bins = {}
    for first, capacity, n in plan.bins.tolist():
        for b in range(first, first + n):
            bins[b] = (capacity, [])
    return bins


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20), st.sampled_from([[50], [20, 50], [7, 16, 31, 50]]), st.sampled_from([0.0, 50.0]))
def test_every_item_has_a_place_of_its_own(histogram, capacities, cost):
    plan = plan_bins(histogram, capacities, cost)
    bins = expand(plan)
    ends = {}
    for size, rank, each, first, offset in plan.slots.tolist():
        ends.setdefault(size, []).append((rank, each, first, offset))
    for size, n in histogram.items():
        runs = sorted(ends[size])
        assert runs[0][0] == 0
        for k in range(n):
            rank, each, first, offset = [r for r in runs if r[0] <= k][-1]
            bins[first + (k - rank) // each][1].append((offset + (k - rank) % each * size, size))
    total = 0
    for capacity, held in bins.values():
        held.sort()
        at = 0
        for offset, size in held:
            assert offset == at
            at += size
        assert held and at <= capacity == next(c for c in sorted(capacities) if c >= at)
        total += capacity + cost
    assert total == plan.cost


def test_close_to_the_least_number_of_bins():
    rnd = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[min(2048, max(1, int(rnd.lognormvariate(5, 1.2))))] += 1
    plan = plan_bins(histogram, [2048])
    assert plan.n_bins <= 1.002 * sum(s * n for s, n in histogram.items()) / 2048 + 1


def test_several_lengths_cost_no_more():
    histogram = {900: 3, 1100: 2, 300: 5, 20: 7}
    assert plan_bins(histogram, [256, 512, 1024, 2048]).cost <= plan_bins(histogram, [2048]).cost


def test_bad_sizes():
    for h, c in (({0: 1}, [5]), ({6: 1}, [5]), ({1: 1}, [])):
        with pytest.raises(ValueError):
            plan_bins(h, c)
    assert plan_bins({}, [5]).n_bins == 0


SCHEMA = "doc long, n long, bin_id string, rank int"


def test_operator(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 0, 1, 1, 1, 3, 40, 64, 65, 200, 640]), "x", 1) for i in range(600)] + [(5, 7, None, None), (5, 7, None, None), (None, 9, "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pack_items(df, "doc", "n", [16, 64], task_rows=40).collect()
    by_bin, by_item = defaultdict(list), defaultdict(int)
    for r in out:
        by_bin[r.bin_id].append(r)
        by_item[r.id] += r.length
        assert r.length <= 64 and r["first"] == 64 * r.piece
    want = defaultdict(int)
    for i, n, *_ in rows:
        if i is not None and n:
            want[i] += n
    assert dict(by_item) == dict(want)
    for held in by_bin.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_capacity for r in held} == {16 if at <= 16 else 64}
    whole = [r for r in out if r.piece == 0 and dict(want)[r.id] <= 64]
    assert len({(r.id, r.bin_id, r.bin_offset) for r in whole}) == len(whole)


def test_empty_and_negative(spark):
    assert pack_items(spark.createDataFrame([], SCHEMA), "doc", "n", [8]).count() == 0
    with pytest.raises(PySparkException):
        pack_items(spark.createDataFrame([(1, -2, None, None)], SCHEMA), "doc", "n", [8]).count()


def test_bins_open_at_their_own_capacity():
    from quillon.llm.packing import _pack

    capacities, rnd, least = [8, 12, 20], random.Random(3), 0
    for _ in range(100):
        sizes = [(s, rnd.randint(1, 4)) for s in rnd.sample(range(1, 21), 6)]
        joint, single = _pack(sizes, None, capacities, 0.0).cost, min(_pack(sizes, c, capacities, 0.0).cost for c in capacities)
        least += joint <= single
        assert plan_bins(dict(sizes), capacities).cost == min(joint, single)
    assert least >= 80
    with pytest.raises(ValueError):
        plan_bins({3: 1 << 40}, [8])
