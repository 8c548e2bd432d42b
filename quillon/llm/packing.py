"""Filling containers of fixed capacities with items, best fit first.

The plan is made on the histogram of sizes, which has at most as many rows as the capacity, whatever
the number of items: bins with the same contents are one group with a count, and a step puts items of
one size into whole groups at once. Items then find their place by their rank among the items of their
size, which is computed without bringing one size into one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import Workspace

RANK_BITS = 40  # room for the rank of an item within its size


@dataclass
class Plan:
    """``slots``: (size, first rank, items a bin, first bin, offset in the bin), in the order of size and
    first rank; ``bins``: (first bin, capacity after downsizing, bins)."""

    slots: np.ndarray
    bins: np.ndarray
    cost: float

    @property
    def n_bins(self) -> int:
        return int(self.bins[:, 2].sum()) if len(self.bins) else 0


def _pack(sizes: list[tuple[int, int]], opening: int | None, capacities: list[int], bin_cost: float) -> Plan:
    """Best fit, large sizes first. Without ``opening`` every bin opens at the capacity that costs least for
    what it can be filled with; else at ``opening`` or the least capacity that an item needs."""
    left_of = dict(sizes)
    still = sorted(left_of)  # sizes that are not all placed

    def least_cost(size: int) -> tuple[int, int]:
        """The capacity whose bin, begun with ``size`` and filled from what is left, largest first, costs
        least for each unit that it holds; and how many bins can be filled like that."""
        best = None
        for capacity in capacities:
            if capacity < size:
                continue
            free, at, times = capacity, bisect_right(still, size), left_of[size]
            while free and at:
                at = min(at, bisect_right(still, free))
                if at:
                    each = min(left_of[still[at - 1]], free // still[at - 1])
                    free -= each * still[at - 1]
                    times = min(times, left_of[still[at - 1]] // each)
                    at -= 1
            held = capacity - free
            price = (next(c for c in capacities if c >= held) + bin_cost) / held
            if best is None or price <= best[0]:
                best = (price, capacity, times)
        return best[1:]

    groups: list[list] = []  # [capacity, free, count, [(size, items a bin, first rank)], contents]
    by_free: dict[int, list[int]] = {}
    frees: list[int] = []

    def shelve(g: int) -> None:
        free = groups[g][1]
        if free not in by_free:
            by_free[free] = []
            at = int(np.searchsorted(frees, free)) if frees else 0
            frees.insert(at, free)
        by_free[free].append(g)

    def take(at: int) -> int:
        free = frees[at]
        g = by_free[free].pop()
        if not by_free[free]:
            del by_free[free]
            frees.pop(at)
        return g

    def part(held: list[tuple[int, int, int]], skipped: int) -> list[tuple[int, int, int]]:
        """What a group's bins hold from the bin ``skipped`` on: the ranks move on by the items before."""
        return [(size, each, rank + skipped * each) for size, each, rank in held]

    def fill(g: int, size: int, rank: int, left: int) -> int:
        """Puts up to ``left`` items into the bins of g, as many in each as fit; what stays open is shelved."""
        capacity, free, count, held = groups[g]
        groups[g] = None
        each = free // size
        full = min(count, left // each)
        used = 0
        if full:
            groups.append([capacity, free - each * size, full, [*held, (size, each, rank)]])
            shelve(len(groups) - 1)
            used = full * each
        done = full
        if done < count and 0 < left - used < each:
            rest = left - used
            groups.append([capacity, free - rest * size, 1, [*part(held, done), (size, rest, rank + used)]])
            shelve(len(groups) - 1)
            used, done = left, done + 1
        if done < count:
            groups.append([capacity, free, count - done, part(held, done)])
            shelve(len(groups) - 1)
        return used

    for size, n in sorted(sizes, reverse=True):
        rank, left = 0, n
        while left:
            at = int(np.searchsorted(frees, size)) if frees else 0
            if at < len(frees):
                used = fill(take(at), size, rank, left)
            else:
                capacity, times = (max(opening, next(c for c in capacities if c >= size)), left) if opening else least_cost(size)
                groups.append([capacity, capacity, min(times, -(-left // (capacity // size))), []])
                used = fill(len(groups) - 1, size, rank, left)
            rank, left = rank + used, left - used
            left_of[size] = left
            if not left:
                still.pop()

    slots, bins, first, cost = [], [], 0, 0.0
    for group in groups:
        if group is None or not group[3]:
            continue
        capacity, free, count, held = group
        contents, offset = capacity - free, 0
        capacity = next(c for c in capacities if c >= contents)  # downsizing
        for size, each, rank in held:
            slots.append((size, rank, each, first, offset))
            offset += size * each
        bins.append((first, capacity, count))
        cost += count * (capacity + bin_cost)
        first += count
    slots = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    return Plan(slots, np.array(bins, dtype=np.int64).reshape(-1, 3), cost)


def plan_bins(histogram: dict[int, int], capacities: list[int], bin_cost: float = 0.0) -> Plan:
    """The plan of least cost among the joint one, where each bin opens at its own capacity, and those that
    open one capacity throughout; the cost of a bin is its final capacity plus ``bin_cost``. Sizes are from
    1 to the largest capacity, fewer than 2^40 items of each."""
    capacities = sorted(set(capacities))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities are positive")
    sizes = [(s, n) for s, n in histogram.items() if n]
    if any(not 1 <= s <= capacities[-1] for s, _ in sizes):
        raise ValueError("a size is not in the range of the capacities")
    if any(n >> RANK_BITS for _, n in sizes):
        raise ValueError("more items of one size than ranks")
    return min((_pack(sizes, c, capacities, bin_cost) for c in (None, *reversed(capacities))), key=lambda plan: plan.cost)


def pack_items(df: DataFrame, id_col: str, size_col: str, capacities: list[int], bin_cost: float = 0.0, task_rows: int = 500_000) -> DataFrame:
    """(id, piece, first, length, bin_id, bin_capacity, bin_offset): where each part of each item goes.

    An item is whole in one bin (piece 0, first 0) unless it is larger than the largest capacity; then
    it is cut into pieces of that capacity and a rest, and the rest is packed like an item. ``first`` is
    the piece's place in the item, ``bin_offset`` its place in the bin, both in units of size. Items of
    size 0 or null or with a null id have no row, negative sizes raise. Repeated ids are items of their
    own. An empty table gives no rows. ``bin_capacity`` is the least permitted capacity that holds the
    bin's contents. Items are numbered within parts of their size of about ``task_rows`` in all sizes
    together, so a size that most items have is numbered by many tasks.
    """
    spark = df.sparkSession
    work = Workspace(spark)
    most = max(capacities)
    items = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).where("id is not null and size <> 0")
    size = F.when(F.col("size") < 0, F.raise_error(F.lit("a size is negative"))).otherwise(F.col("size"))
    pieces = items.select("id", size.alias("size")).select("id", "size", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {most} as int)"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * F.lit(most).cast("long")).alias("first"), F.least(F.lit(most).cast("long"), F.col("size") - F.col("piece") * F.lit(most).cast("long")).alias("length"))
    pieces = work.keep(pieces)
    # one row for each size, so at most ``most`` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(8, -(-sum(histogram.values()) // task_rows))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int"))

    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece")) - 1
    ranked = pieces.select("*", rank.alias("nth")).join(starts, ["length", "part"]).select("id", "piece", "first", "length", (F.col("start") + F.col("nth")).alias("rank"))

    plan = plan_bins(histogram, capacities, bin_cost)
    shared = spark.sparkContext.broadcast((plan.slots, plan.bins[:, :2]))

    schema = T.StructType([ranked.schema["id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("first", T.LongType()), ("length", T.LongType()), ("bin_id", T.LongType()), ("bin_capacity", T.LongType()), ("bin_offset", T.LongType())))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, bins = shared.value
        keys = (slots[:, 0] << RANK_BITS) + slots[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            at = slots[np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            bin_id, offset = at[:, 3] + nth // at[:, 2], at[:, 4] + nth % at[:, 2] * length
            capacity = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bin_id), pa.array(capacity), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
