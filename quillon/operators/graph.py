"""Components, similarity and communities of project graphs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillon.functions.text import matched
from quillon.operators import neighbours as N
from quillon.session import Workspace, observed

MAX_ROUNDS = 200
MET = 1_000  # sets of a token that meet all others of it in one task
BLOCK, SENT = 1_024, 4_096  # projects of a class in one row; names that one copy of such a row meets
FEW = 4_000_000  # edges up to which one task finds the components; the result doesn't depend on it


def components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = FEW) -> DataFrame:
    """(node, component): weakly connected components, named by their least node.

    Up to ``few`` edges are settled in one task, as arrays of numbers. Of more, each round a node learns the least label among its neighbours and tells it to the node that its own
    label names as well (hooking), and then takes the label of its label (jumping). Trees of labels so
    join and flatten in about log n rounds, also along chains. Each round is written to the shared
    folder. Ends when no label changes; raises if that takes MAX_ROUNDS rounds. Edges with a null end
    are left out, repeats don't matter. Nodes are numbered in their order first, so the rounds move numbers.
    """
    work = Workspace(edges.sparkSession)
    ends = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null")
    if ends.count() <= few:
        return work.keep(ends.repartition(1).mapInArrow(_settled, "node string, component string"))
    named = work.keep(ends.distinct())
    known = work.keep(named.select(F.col("s").alias("name")).union(named.select("d")).distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("id")))
    pairs = named.join(known.select(F.col("name").alias("s"), F.col("id").alias("a")), "s").join(known.select(F.col("name").alias("d"), F.col("id").alias("b")), "d").select("a", "b")
    of = known.select(F.col("id").alias("label"), F.col("name").alias("component"))
    both = work.keep(pairs.unionAll(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(MAX_ROUNDS):
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        told = labels.join(offered, "node").where("offer < label")
        heard = told.select("node", "offer").unionAll(told.select(F.col("label").alias("node"), "offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        seen = Observation()
        hooked = labels.join(heard, "node", "left").select("node", F.least("label", "offer").alias("label"), F.col("offer").isNotNull().alias("moved"))
        hooked = work.keep(hooked.observe(seen, F.count_if("moved").alias("n")).drop("moved"))
        hop = hooked.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumping = Observation()
        jumped = hooked.join(hop, "label").select("node", F.col("beyond").alias("label"), (F.col("beyond") < F.col("label")).alias("moved"))
        new = work.keep(jumped.observe(jumping, F.count_if("moved").alias("n")).drop("moved"))
        moved = observed(seen, hooked) + observed(jumping, new)
        work.drop(labels)
        work.drop(hooked)
        labels = new
        if not moved:
            return labels.join(of, "label").join(known.select(F.col("id").alias("node"), "name"), "node").select(F.col("name").alias("node"), "component")
    raise RuntimeError("the components did not settle")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node of the component of each node, of all edges (s, d) of the task: least labels are told
    to the nodes that the labels at both ends name, and then the trees of labels are flattened."""
    each = list(batches)
    if not each:
        return
    at, names = N.numbered([b.column(0) for b in each] + [b.column(1) for b in each])
    order = pc.array_sort_indices(names)  # by bytes, as Spark compares
    rank = np.empty(len(names), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    a, b = np.split(rank[at], 2)
    label = np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    names = names.take(order).cast(pa.string())
    for i in range(0, len(names), 100_000):
        yield pa.record_batch([names[i : i + 100_000], names.take(pa.array(label[i : i + 100_000]))], names=["node", "component"])


def signatures(mentions: DataFrame, kinds: tuple[str, ...] = ("organism", "method")) -> DataFrame:
    """Distinct (pid, token): the vocabulary names of some kinds, told apart by kind."""
    named = mentions.where(F.col("entity_kind").isin(*kinds) & matched(F.col("canonical_id")))
    return named.select(F.col("project_id").alias("pid"), F.concat_ws(":", F.substring("entity_kind", 1, 1), "canonical_id").alias("token")).distinct()


def alike_sets(held: DataFrame, min_cosine: float = 0.5, written: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pid, cls) and (x, y, cosine), x < y: projects of the same token set are one class, and the pairs of
    different classes whose sets reach the cosine. Within a class it is 1. Both are written, unless the caller writes them.

    Only sets that share one of their rarer tokens can reach it: with the tokens in the order of their
    frequency, rarest first, two sets that must share k have their first shared token before the last k - 1
    of either. So the frequent tokens, which would pair everything with everything, join hardly ever.
    Tokens are numbered in that order. Two sets are compared where they meet, at their first shared token
    alone, so what is met is neither shuffled nor made distinct; of a token of many sets the one side is cut
    into parts of about MET sets, each of which meets all of the other side.
    """
    work = Workspace(held.sparkSession)
    sets = work.keep(held.groupBy("pid").agg(F.array_sort(F.collect_set("token")).alias("tokens")))
    classes = work.keep(sets.groupBy("tokens").agg(F.min("pid").alias("first")).orderBy("first").select("tokens", F.monotonically_increasing_id().alias("cls")))
    member = sets.join(classes, "tokens").select("pid", "cls")
    each = classes.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    ranked = work.keep(each.groupBy("token").agg(F.count("*").alias("df")).orderBy("df", "token").select("token", F.monotonically_increasing_id().alias("rank")))
    ordered = work.keep(each.join(ranked, "token").groupBy("cls", "n").agg(F.sort_array(F.collect_list("rank")).alias("ranks")))
    least = F.ceil(F.col("n") * F.lit(min_cosine * min_cosine) - F.lit(1e-9))
    probe = ordered.select("cls", "n", "ranks", F.posexplode(F.slice("ranks", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("at", "rank"))
    probe = probe.join(probe.groupBy("rank").agg(F.ceil(F.count("*") / MET).alias("parts")), "rank")
    side = lambda c, part: probe.select("rank", part.alias("part"), F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("at").alias(f"a{c}"), F.col("ranks").alias(f"r{c}"))
    spread = side("x", F.col("cls") % F.col("parts")).repartition(4 * held.sparkSession.sparkContext.defaultParallelism, "rank", "part")
    shared = F.ceil(F.sqrt(F.col("nx") * F.col("ny")) * min_cosine - 1e-9)
    met = spread.join(side("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["rank", "part"]).where((F.col("x") < F.col("y")) & (shared <= F.col("nx") - F.col("ax")) & (shared <= F.col("ny") - F.col("ay")))
    first = met.where(~F.arrays_overlap(F.slice("rx", F.lit(1), F.col("ax")), F.slice("ry", F.lit(1), F.col("ay"))))
    cosine = F.size(F.array_intersect("rx", "ry")) / F.sqrt(F.col("nx") * F.col("ny"))
    pairs = first.select("x", "y", cosine.alias("cosine")).where(F.col("cosine") >= min_cosine)
    return (work.keep(member), work.keep(pairs)) if written else (member, pairs)


def pairs_in_groups(held: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(group, x, y, cosine, mx, my): the pairs of classes whose both ends a group has, of ``held`` (group, cls, m).

    A class that many groups have would be written out for each of them with each of its pairs, so a pair
    looks up the groups of the class that fewer have, and these the other one.
    """
    groups = held.groupBy("cls").agg(F.count("*").alias("g"))
    spread = lambda c: groups.select(F.col("cls").alias(c), F.col("g").alias(f"g{c}"))
    turned = pairs.join(spread("x"), "x").join(spread("y"), "y").select(*(F.when(F.col("gx") <= F.col("gy"), F.col(a)).otherwise(F.col(b)).alias(to) for to, a, b in (("p", "x", "y"), ("q", "y", "x"))), "cosine")
    side = lambda c: held.select(group, F.col("cls").alias(c), F.col("m").alias(f"m{c}"))
    return turned.join(side("p"), "p").join(side("q"), [group, "q"]).select(group, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "cosine", *(F.when((F.col("p") < F.col("q")) == first, F.col("mp")).otherwise(F.col("mq")).alias(m) for m, first in (("mx", True), ("my", False))))


def cosine_pairs(held: DataFrame, min_cosine: float = 0.5) -> DataFrame:
    """(a, b, cosine), a < b, of projects whose token sets reach the cosine: the pairs of classes (see
    ``alike_sets``) with all their projects, and the projects of each class among themselves.

    These rows are far more than all else and are not shuffled. The projects of a class are cut into blocks
    of BLOCK in their order; of two classes the blocks of the smaller one are sent to those of the larger
    one and multiplied there. A block that many are sent to is repeated, so that no key makes more than
    about BLOCK * SENT rows, and the tasks are as many as the rows ask for.
    """
    work = Workspace(held.sparkSession)
    member, pairs = alike_sets(held, min_cosine)
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("pid")) - 1
    blocks = work.keep(member.where("pid is not null").select("cls", "pid", F.floor(nth / BLOCK).alias("block")).groupBy("cls", "block").agg(F.array_sort(F.collect_list("pid")).alias("names")))
    many = blocks.groupBy("cls").agg(F.sum(F.size("names")).alias("m"), F.count("*").alias("blocks"))
    sized = lambda c: many.select(F.col("cls").alias(c), F.col("m").alias(f"m{c}"))
    less = F.col("mx") <= F.col("my")
    turned = pairs.join(sized("x"), "x").join(sized("y"), "y").select(*(F.when(less, F.col(a)).otherwise(F.col(b)).alias(to) for to, a, b in (("p", "x", "y"), ("q", "y", "x"), ("mp", "mx", "my"))), "cosine")
    alone = many.where(F.lit(min_cosine <= 1) & (F.col("m") > 1)).select(F.col("cls").alias("p"), F.col("cls").alias("q"), F.col("m").alias("mp"), F.lit(1.0).alias("cosine"))
    turned = work.keep(turned.unionAll(alone))
    larger = work.keep(turned.groupBy(F.col("q").alias("cls")).agg(F.sum("mp").alias("sent")).join(many, "cls").select(F.col("cls").alias("q"), "m", "sent", "blocks", F.ceil(F.col("sent") / SENT).alias("parts")))
    rows = larger.agg(F.sum(F.col("m") * F.col("sent"))).first()[0] or 0
    tasks = min(2_000, 1 + max(rows // 2_000_000, min(held.sparkSession.sparkContext.defaultParallelism, rows // 50_000)))
    sent = turned.join(blocks.select(F.col("cls").alias("p"), F.col("block").alias("of"), F.col("names").alias("these")), "p").join(larger.select("q", "blocks", "parts"), "q")
    within = F.col("p") == F.col("q")
    sent = sent.select("q", F.pmod(F.hash("p", "of"), "parts").alias("part"), "these", "cosine", F.when(within, F.col("of")).alias("of"), F.explode(F.sequence(F.when(within, F.col("of")).otherwise(F.lit(0)), F.col("blocks") - 1)).alias("block"))
    there = larger.select("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(blocks.select(F.col("cls").alias("q"), "block", F.col("names").alias("those")), "q")
    met = sent.repartition(tasks, "q", "block", "part").join(there.hint("shuffle_hash"), ["q", "block", "part"])
    one = met.select(F.explode("these").alias("this"), "those", "cosine", (F.col("of") == F.col("block")).alias("twice"))
    both = one.select("this", F.explode("those").alias("that"), "cosine", "twice").where("twice is null or not twice or this < that")
    return both.select(F.least("this", "that").alias("a"), F.greatest("this", "that").alias("b"), "cosine")


def louvain(weights: dict[tuple[str, str], float], resolution: float = 1.0, seed: int = 42) -> list[set[str]]:
    """Communities of an undirected weighted graph by repeated local moves and merging.

    Deterministic for a seed: nodes are visited in a seeded order of their sorted names, and a node
    moves only for a strict gain, to the first best community.
    """
    names = sorted({n for pair in weights for n in pair})
    number = {n: i for i, n in enumerate(names)}
    ends = np.array([(number[a], number[b]) for a, b in sorted(weights)], dtype=np.int64).reshape(-1, 2)
    return _levels(*_added(ends.min(axis=1), ends.max(axis=1), np.array([float(w) for _, w in sorted(weights.items())])), [{n} for n in names], random.Random(seed), resolution)


def _added(low: np.ndarray, high: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs low <= high in their order, each once, with the sum of its weights."""
    width = int(high.max(initial=0)) + 1
    keys, at = np.unique(low * width + high, return_inverse=True)
    return keys // width, keys % width, np.bincount(at, weights=w, minlength=len(keys))


def _levels(low: np.ndarray, high: np.ndarray, weight: np.ndarray, parts: list[set], rnd: random.Random, resolution: float) -> list[set]:
    """Local moves and merging until nothing moves, of nodes 0 to n - 1 and the pairs low <= high, each once;
    ``parts`` are the members that each node stands for."""
    while True:
        n, loop = len(parts), low == high
        a, b = np.concatenate([low, high[~loop]]), np.concatenate([high, low[~loop]])
        by = np.lexsort((b, a))
        near, w = b[by], np.concatenate([weight, weight[~loop]])[by]
        begin = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        own_loop = np.bincount(low[loop], weights=weight[loop], minlength=n)
        degree = [sum(w[begin[i] : begin[i + 1]].tolist()) + float(own_loop[i]) for i in range(n)]
        twice = sum(degree)
        if not twice:
            return parts
        homes, total, totals = np.arange(n), degree.copy(), np.array(degree)
        home = homes.tolist()
        # a node's neighbours without itself, as lists where they are few
        others = []
        for i in range(n):
            ks, ws = near[begin[i] : begin[i + 1]], w[begin[i] : begin[i + 1]]
            if own_loop[i]:
                ks, ws = ks[ks != i], ws[ks != i]
            others.append((ks, ws) if len(ks) > 40 else (ks.tolist(), ws.tolist()))
        moved_once, moved = False, True
        order = list(range(n))
        rnd.shuffle(order)
        while moved:
            moved = False
            for i in order:
                ks, ws = others[i]
                own, mine = home[i], degree[i]
                total[own] -= mine
                best = own
                if isinstance(ks, list):
                    links: dict = {}
                    for k, x in zip(ks, ws):
                        links[home[k]] = links.get(home[k], 0.0) + x
                    most = stay = links.get(own, 0.0) - resolution * total[own] * mine / twice
                    for c, x in links.items():
                        gain = x - resolution * total[c] * mine / twice
                        if gain > most or gain == most and gain > stay and c < best:
                            best, most = c, gain
                else:
                    totals[own] = total[own]
                    found, sums = _summed(homes[ks], ws, n)
                    gains = sums - resolution * totals[found] * mine / twice
                    k = int(gains.argmax())
                    at = int(found.searchsorted(own))
                    linked = float(sums[at]) if at < len(found) and found[at] == own else 0.0
                    stay = linked - resolution * total[own] * mine / twice
                    best, most = int(found[k]), float(gains[k])
                if most > stay + 1e-12:
                    home[i] = homes[i] = best
                    moved = moved_once = True
                else:
                    best = own
                total[best] += mine
                totals[own], totals[best] = total[own], total[best]
        if not moved_once:
            return parts
        kept, homes = np.unique(homes, return_inverse=True)
        merged: list[set] = [set() for _ in kept]
        for i, h in enumerate(homes.tolist()):
            merged[h] |= parts[i]
        parts = merged
        x, y = homes[low], homes[high]
        low, high, weight = _added(np.minimum(x, y), np.maximum(x, y), weight)


def _summed(keys: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below n) in their order and the sums of their weights, all above 0."""
    if len(keys) * 20 < n:
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, weights=weights)
    sums = np.bincount(keys, weights=weights, minlength=n)
    found = np.flatnonzero(sums != 0)
    return found, sums[found]


def louvain_classes(weights: dict[tuple[str, str], float], classes: dict[str, int], alike: dict[tuple[int, int], float], resolution: float = 1.0, seed: int = 42) -> list[set[str]]:
    """The communities of ``louvain`` over ``weights`` (no loops) and the topic edges, without a list of these:
    nodes of one class are joined by 1, nodes of two classes by what ``alike`` has for the pair.

    Only the first round moves nodes; what a node is linked with is summed over the classes that its class is
    alike. After it the communities are the nodes, and these are few.
    """
    size = Counter(classes.values())
    met = {c for pair in alike for c in pair if pair[0] in size and pair[1] in size}
    names = sorted({n for pair in weights for n in pair} | {n for n, c in classes.items() if size[c] > 1 or c in met})
    number = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for (a, b), w in sorted(weights.items()):
        a, b = number[a], number[b]
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    # nodes by class; ``others`` are the classes that a class is alike, itself first
    held = sorted({c for n, c in classes.items() if n in number})
    at = {c: k for k, c in enumerate(held)}
    cls = np.array([at[classes[n]] if n in classes else -1 for n in names], dtype=np.int64)
    member = np.argsort(cls, kind="stable")[int((cls < 0).sum()) :]
    many = np.bincount(cls[cls >= 0], minlength=len(held))
    begin = np.cumsum(many) - many
    lists: list[list[tuple[int, float]]] = [[(k, 1.0)] for k in range(len(held))]
    for (x, y), w in sorted(alike.items()):
        if x in at and y in at:
            lists[at[x]].append((at[y], w))
            lists[at[y]].append((at[x], w))
    others = [(np.array([k for k, _ in x], dtype=np.int64), np.array([w for _, w in x])) for x in lists]
    del lists
    n = len(names)
    # as lists for one value at a time, and as arrays
    home, homes = list(range(n)), np.arange(n)
    kinds = cls.tolist()
    seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    changed, moves = np.zeros(len(held), dtype=np.int64), 0

    def linked(c: int) -> tuple[np.ndarray, np.ndarray]:
        """The communities that the class is linked with and how much, each node of the class with itself too."""
        if c in seen and seen[c][0] >= changed[c]:
            return seen[c][1:]
        ks, ws = others[c]
        sizes = many[ks]
        ends = np.cumsum(sizes)
        places = np.repeat(begin[ks] - ends + sizes, sizes) + np.arange(ends[-1])
        found, sums = _summed(homes[member[places]], np.repeat(ws, sizes), n)
        if len(found) <= 1000:  # the few are kept until a node of these classes moves
            seen[c] = moves, found, sums
        return found, sums

    by_class = np.array([float((many[ks] * ws).sum()) - 1.0 for ks, ws in others])
    degree = np.array([sum(x.values()) for x in near], dtype=float)
    degree[cls >= 0] += by_class[cls[cls >= 0]]
    twice = float(degree.sum())
    if not twice:
        return [{x} for x in names]
    total, totals = degree.tolist(), degree.copy()
    degree = total.copy()
    rnd, order = random.Random(seed), list(range(n))
    rnd.shuffle(order)
    moved_once, moved = False, True
    while moved:
        moved = False
        for i in order:
            c, own, mine = kinds[i], home[i], degree[i]
            part = resolution * mine / twice
            links: dict[int, float] = {}
            for j, w in near[i].items():
                links[home[j]] = links.get(home[j], 0.0) + w
            total[own] -= mine
            best, most = own, None
            if c >= 0:
                totals[own] = total[own]
                found, sums = linked(c)
                gains = sums - part * totals[found]
                links[own] = links.get(own, 0.0) - 1.0  # the node itself
                for h in links:
                    k = int(found.searchsorted(h))
                    if k < len(found) and found[k] == h:
                        links[h] += float(sums[k])
                        gains[k] = -np.inf
                k = int(gains.argmax())
                best, most = int(found[k]), float(gains[k])
            stay = links.get(own, 0.0) - part * total[own]
            for h, w in links.items():
                gain = w - part * total[h]
                if most is None or gain > most or gain == most and h < best:
                    best, most = h, gain
            if most is not None and most > stay + 1e-12:
                home[i] = homes[i] = best
                moved = moved_once = True
                if c >= 0:
                    moves += 1
                    changed[others[c][0]] = moves
            else:
                best = own
            total[best] += mine
            totals[own], totals[best] = total[own], total[best]
    if not moved_once:
        return [{x} for x in names]
    kept = np.unique(homes)
    upper = np.searchsorted(kept, homes)  # the communities are the nodes now
    parts: list[set] = [set() for _ in kept]
    for x, h in zip(names, upper.tolist()):
        parts[h].add(x)
    links = [(upper[a], upper[b], w) for a, x in enumerate(near) for b, w in x.items() if a < b]
    ends = np.array([(a, b) for a, b, _ in links], dtype=np.int64).reshape(-1, 2)
    met, waiting = [_added(ends.min(axis=1), ends.max(axis=1), np.array([w for *_, w in links]))], 0
    for c in range(len(held)):
        found, linked_by = linked(c)
        found = np.searchsorted(kept, found)
        inside, many_inside = np.unique(upper[member[begin[c] : begin[c] + many[c]]], return_counts=True)
        for h, k in zip(inside.tolist(), many_inside.tolist()):
            at = int(found.searchsorted(h))
            w = k * linked_by[at:]
            w[0] = k * (linked_by[at] - 1.0) / 2  # h itself, with which the class is always linked
            met.append((np.full(len(w), h), found[at:], w))
            waiting += len(w)
        if waiting > 2_000_000 or c == len(held) - 1:
            met, waiting = [_added(*(np.concatenate(z) for z in zip(*met)))], 0
    low, high, weight = met[0]
    some = weight != 0
    return _levels(low[some], high[some], weight[some], parts, rnd, resolution)


def _numbered(found: list[set], group, column: str) -> pd.DataFrame:
    """Communities numbered from 0 by falling size and then by first member."""
    found = sorted(found, key=lambda c: (-len(c), min(c)))
    return pd.DataFrame([(group, m, i) for i, c in enumerate(found) for m in sorted(c)], columns=[column, "member", "community"])


def communities(edges: DataFrame, group: str, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """(group, member, community): communities of each group's graph of (group, a, b, weight).

    Communities are numbered from 0 by falling size and then by first member. A group is one connected
    component; its weights go to one task, which is what the method needs.
    """
    kind = dict(edges.dtypes)[group]

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        weights: dict = defaultdict(float)
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"]):
            weights[min(a, b), max(a, b)] += float(w)
        return _numbered(louvain(weights, resolution, seed), key[0], group)

    return edges.select(group, "a", "b", "weight").groupBy(group).applyInPandas(work, f"{group} {kind}, member string, community int")


def communities_by_class(edges: DataFrame, held: DataFrame, pairs: DataFrame, group: str, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``communities`` of the edges (group, a, b, weight), a <> b, and of the topic edges that the classes
    (group, pid, cls) and the cosines of their pairs (group, x, y, cosine) stand for. A group's task gets
    its edges, its classes and their pairs, never the pairs of its projects."""
    kind = dict(edges.dtypes)[group]
    name = lambda c: F.col(c).cast("string")
    rows = edges.select(group, F.lit("edge").alias("what"), "a", "b", "weight")
    rows = rows.unionAll(held.select(group, F.lit("class"), "pid", name("cls"), F.lit(None).cast("double"))).unionAll(pairs.select(group, F.lit("pair"), name("x"), name("y"), "cosine"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        weights: dict = defaultdict(float)
        classes: dict = {}
        alike: dict = {}
        for what, a, b, w in zip(pdf["what"], pdf["a"], pdf["b"], pdf["weight"]):
            if what == "edge":
                weights[min(a, b), max(a, b)] += float(w)
            elif what == "class":
                classes[a] = int(b)
            else:
                alike[int(a), int(b)] = float(w)
        return _numbered(louvain_classes(weights, classes, alike, resolution, seed), key[0], group)

    return rows.groupBy(group).applyInPandas(work, f"{group} {kind}, member string, community int")


def ring_layout(nodes: DataFrame, node_col: str, radius: float = 1.0, most: int = 500) -> DataFrame:
    """(node, x, y): the first ``most`` nodes by name evenly on a circle, for drawing."""
    few = nodes.select(F.col(node_col).alias("node")).where("node is not null").distinct().orderBy("node").limit(most)
    placed = few.select("node", (F.row_number().over(Window.orderBy("node")) - 1).alias("i")).crossJoin(F.broadcast(few.agg(F.count("*").alias("n"))))
    turn = F.lit(2 * pi) * F.col("i") / F.col("n")
    return placed.select("node", (F.cos(turn) * radius).alias("x"), (F.sin(turn) * radius).alias("y"))
