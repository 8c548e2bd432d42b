"""Entities that occur together, and those that might but don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import matched
from quillon.session import Workspace

def held(mentions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Distinct (pid, kind, name) of vocabulary names."""
    named = mentions.where(F.col("entity_kind").isin(*kinds) & matched(F.col("canonical_id")))
    return named.select(F.col("project_id").alias("pid"), F.col("entity_kind").alias("kind"), F.col("canonical_id").alias("name")).distinct()


def popular(have: DataFrame, least: int) -> DataFrame:
    return have.groupBy("kind", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def together(have: DataFrame, names: DataFrame) -> DataFrame:
    """(a_kind, a_name, b_kind, b_name, actual): projects with both, for pairs of different kinds."""
    wanted = have.join(names.select("kind", "name"), ["kind", "name"])
    a = wanted.select("pid", F.col("kind").alias("a_kind"), F.col("name").alias("a_name"))
    b = wanted.select("pid", F.col("kind").alias("b_kind"), F.col("name").alias("b_name"))
    return a.join(b, "pid").where("a_kind < b_kind").groupBy("a_kind", "a_name", "b_kind", "b_name").agg(F.count("*").alias("actual"))


def candidate_pairs(have: DataFrame, names: DataFrame, kinds: tuple[str, ...], most_together: int, product: float) -> DataFrame:
    """Pairs of ``names`` of different kinds that occur together at most so often and whose counts multiply to
    ``product`` or more. The names have been cut to those that can reach it."""
    a = names.select(F.col("kind").alias("a_kind"), F.col("name").alias("a_name"), F.col("n").alias("a_count"))
    b = names.select(F.col("kind").alias("b_kind"), F.col("name").alias("b_name"), F.col("n").alias("b_count"))
    # kinds meet by their ordered pairs, so this is an equi-join with as many keys as pairs of kinds
    combos = [(x, y) for x in sorted(kinds) for y in sorted(kinds) if x < y]
    mates = F.create_map(*(z for k in kinds for z in (F.lit(k), F.array(*(F.lit(f"{x}|{y}") for x, y in combos if k in (x, y)))))) if combos else F.lit(None)
    left = a.withColumn("combo", F.explode(mates[F.col("a_kind")])).where(F.substring_index("combo", "|", 1) == F.col("a_kind"))
    right = b.withColumn("combo", F.explode(mates[F.col("b_kind")])).where(F.substring_index("combo", "|", -1) == F.col("b_kind"))
    joined = left.join(right, "combo").where(F.col("a_count") * F.col("b_count") >= product).drop("combo")
    counted = joined.join(together(have, names), ["a_kind", "a_name", "b_kind", "b_name"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return counted.where(F.col("actual") <= most_together)


def _scanned(mentions: DataFrame, kinds: tuple[str, ...], least: int, most_together: int, top: int, good) -> DataFrame:
    """The candidate pairs, down to a product of counts below which no pair can be among the first ``top``.

    A threshold scan: names are taken from the most frequent down, as far as their count times the highest reaches the
    product; if fewer than ``top`` pairs are ``good`` there, the product is lowered. ``good`` is a condition on
    the pairs with their ``product``, the bound, that no pair under the bound meets.
    """
    work = Workspace(mentions.sparkSession)
    have = work.keep(held(mentions, kinds))
    names = work.keep(popular(have, least))
    # a first bound from a few of the most frequent names, with some pairs to spare for those that do occur together
    first = names.orderBy(F.desc("n")).limit(64).collect()
    if not first:
        return candidate_pairs(have, names, kinds, most_together, 0.0)
    products = sorted((x.n * y.n for x in first for y in first if x.kind < y.kind), reverse=True)
    lowest = float(least * least)
    bound = float(products[4 * top]) if len(products) > 4 * top else lowest
    while True:
        pairs = candidate_pairs(have, names.where(F.col("n") * first[0].n >= bound), kinds, most_together, bound)
        if bound <= lowest:
            return pairs
        pairs = work.keep(pairs)
        if pairs.where(good(bound)).limit(top).count() == top:
            return pairs
        bound = max(bound / 8, lowest)


def underexplored_gaps(mentions: DataFrame, least: int = 5, most_together: int = 1, top: int = 20) -> DataFrame:
    """The pairs with the largest gap between how often chance would bring them together and how often
    they are. N counts the projects with any vocabulary name of the kinds."""
    kinds = ("organism", "method", "database")
    total = held(mentions, kinds).agg(F.count_distinct("pid").alias("N"))
    n = total.first()["N"]
    # what lies under the bound has a gap under bound / N
    pairs = _scanned(mentions, kinds, least, most_together, top, lambda bound: F.col("a_count") * F.col("b_count") - F.col("actual") * F.lit(n) >= bound).where(F.lit(n >= 2)).withColumn("N", F.lit(n))
    expected = F.col("a_count") / F.col("N") * (F.col("b_count") / F.col("N")) * F.col("N")
    scored = pairs.withColumns({"expected": expected, "gap": expected - F.col("actual")}).where("gap > 0")
    return scored.select("a_kind", F.col("a_name").alias("a_canonical"), "a_count", "b_kind", F.col("b_name").alias("b_canonical"), "b_count", "actual", "expected", "gap").orderBy(F.desc("gap"), "a_kind", "a_canonical", "b_kind", "b_canonical").limit(top)


def underexplored_pairs(mentions: DataFrame, least: int = 5, most_together: int = 1, top: int = 40) -> DataFrame:
    """The most popular pairs of four kinds that hardly occur together, for scoring."""
    pairs = _scanned(mentions, ("organism", "method", "database", "function"), least, most_together, top, lambda bound: F.lit(True))
    return pairs.select("a_kind", F.col("a_name").alias("a_canonical"), "b_kind", F.col("b_name").alias("b_canonical"), "a_count", "b_count", "actual").orderBy(F.desc(F.col("a_count") * F.col("b_count")), "a_kind", "a_canonical", "b_kind", "b_canonical").limit(top)


def cooccurrence(mentions: DataFrame, kinds: tuple[str, ...], least: int = 2) -> DataFrame:
    """(a, b, weight), a < b as kind:name: how many projects have both, from ``least`` on."""
    have = held(mentions, kinds).select("pid", F.concat_ws(":", "kind", "name").alias("node"))
    pairs = have.select("pid", F.col("node").alias("a")).join(have.select("pid", F.col("node").alias("b")), "pid").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
