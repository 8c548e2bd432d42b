"""All pairs of records whose value sets overlap above a cosine threshold.

The cosine join is reduced to a join with a fixed overlap ``c`` and that join is done size-aware:

* Values are ordered by how many sets hold them, rarest first. If two sets share at least ``t``
  values, then after cutting the ``t - c`` most frequent values off either set they still share at
  least ``c``. ``t`` follows from the sizes of the pair and the threshold.
* Small sets enumerate every ``c``-sized subset of what is left; two sets meet at a common subset.
  Sets so small that the threshold asks for fewer than ``c`` shared values meet at single values.
* Large sets (``large_size`` values or more) are never collected or enumerated. They stay rows; their
  inverted lists are scanned and shared values counted per pair.
* The union of both is filtered by the exact similarity, in integers.

Values held by one set only can't be shared; they count for the size and are otherwise left out.
Identical sets are joined once, as a class, and expanded at the end.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import Workspace

SUBSET = 2  # c, the overlap that is left after the reduction


def _ceil_times_root(n: Column, num: int, den: int) -> Column:
    """The least integer k with k * den >= num * n, so k = ceil(n * num / den), in whole numbers."""
    return ((n * F.lit(num) + F.lit(den - 1)) / F.lit(den)).cast("long")


class SetJoin:
    """Result of :func:`similar_sets`.

    ``members``: (class_id, side, id); ``class_pairs``: (class_a, class_b) of different classes that
    reach the threshold; ``pairs()`` expands both to pairs of ids; ``everyone``: (side, id) of all records with a value.
    """

    def __init__(self, members: DataFrame, class_pairs: DataFrame, between: bool, everyone: DataFrame):
        self.members, self.class_pairs, self.between, self.everyone = members, class_pairs, between, everyone

    def pairs(self) -> DataFrame:
        """(id_a, id_b); within one table id_a < id_b, between two id_a is of the first."""
        one = self.members.select(F.col("class_id").alias("class_a"), F.col("id").alias("id_1"), F.col("side").alias("side_1"))
        two = self.members.select(F.col("class_id").alias("class_b"), F.col("id").alias("id_2"), F.col("side").alias("side_2"))
        across = self.class_pairs.join(one, "class_a").join(two, "class_b")
        copies = self.members.where("copies").select("class_id", "id", "side")
        inside = copies.select(F.col("class_id"), F.col("id").alias("id_1"), F.col("side").alias("side_1")).join(
            copies.select(F.col("class_id"), F.col("id").alias("id_2"), F.col("side").alias("side_2")), "class_id"
        )
        columns = ["id_1", "side_1", "id_2", "side_2"]
        # a class is of one table, so between two tables its members don't pair
        both = across.select(columns) if self.between else across.select(columns).unionAll(inside.where("id_1 < id_2").select(columns))
        if self.between:
            swap = F.col("side_1") > F.col("side_2")
            return both.select(F.when(swap, F.col("id_2")).otherwise(F.col("id_1")).alias("id_a"), F.when(swap, F.col("id_1")).otherwise(F.col("id_2")).alias("id_b"))
        return both.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))

    def links(self) -> DataFrame:
        """(side, id, class_id, n_links): for each record with a value its class, named by the least id of the
        identical sets of its table, and how many records it pairs with."""
        size = self.members.groupBy("class_id", "side").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        ends = self.class_pairs.select("class_a", "class_b").unionAll(self.class_pairs.select("class_b", "class_a"))
        other = ends.join(size.select(F.col("class_id").alias("class_b"), F.col("side").alias("side_b"), "n"), "class_b")
        same = size.select(F.col("class_id").alias("class_a"), F.col("side").alias("side_b"), "n")
        reach = other.select("class_a", "side_b", "n").unionAll(same).groupBy("class_a", "side_b").agg(F.sum("n").alias("n"))
        # counted for the class, whose members are of one table
        mine = F.col("side") == F.col("side_b")
        count = F.col("n") - mine.cast("long") if not self.between else F.when(~mine, F.col("n"))
        linked = size.select("class_id", "side", "least").join(reach, F.col("class_id") == F.col("class_a")).groupBy("class_id", "side", "least").agg(F.coalesce(F.sum(count), F.lit(0)).alias("n_links"))
        known = self.members.select("side", "id", "class_id").join(linked.select("class_id", "least", "n_links"), "class_id").select("side", "id", "least", "n_links")
        return self.everyone.join(known, ["side", "id"], "left").select("side", "id", F.coalesce("least", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _subsets(tokens: Column, size: int) -> Column:
    """A hash of each subset with ``size`` members (1 or 2) of an ordered array."""
    if size == 1:
        return F.transform(tokens, lambda x: F.xxhash64(F.lit(1), x))
    return F.flatten(F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + F.lit(2), F.size(tokens)), lambda y: F.xxhash64(F.lit(2), x, y))))


def _least_large(n: Column, p: int, q: int) -> Column:
    """Least overlap of a set of size n with any partner that is not larger."""
    return _ceil_times_root(n, p * p, q * q)


def similar_sets(
    left: DataFrame,
    id_col: str,
    value_col: str,
    threshold: str | Fraction = "0.6",
    right: DataFrame | None = None,
    right_id_col: str | None = None,
    right_value_col: str | None = None,
    large_size: int = 256,
) -> SetJoin:
    """Join records whose sets of distinct values have |A∩B| / sqrt(|A|·|B|) >= threshold.

    ``left`` (and ``right``) hold one row per record and value; other columns are ignored, whatever
    their names. Rows with a null record or null value are left out, repeated rows count once. A record
    without any value pairs with nothing, an empty table gives no pairs. The empty string is a value
    like any other. Values are compared exactly. 0 < threshold <= 1, given as text or fraction so that
    it is exact. ``large_size`` only decides which of the two ways a set goes; the result is the same.
    """
    theta = Fraction(threshold)
    if not 0 < theta <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    p, q = theta.numerator, theta.denominator
    spark = left.sparkSession
    work = Workspace(spark)
    between = right is not None

    def rows(df: DataFrame, key: str, value: str, side: int) -> DataFrame:
        return df.select(F.lit(side).alias("side"), F.col(key).alias("id"), F.col(value).alias("value")).where("id is not null and value is not null")

    held = rows(left, id_col, value_col, 0)
    if between:
        held = held.unionAll(rows(right, right_id_col or id_col, right_value_col or value_col, 1))
    held = held.distinct()

    # values of two sets or more, with an id each; written, so that an id stays what it is
    shared = work.keep(held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").withColumn("token", F.monotonically_increasing_id()))
    sizes = held.groupBy("side", "id").agg(F.count("*").alias("n"))
    useful = held.join(shared, "value").select("side", "id", F.struct("df", "token").alias("t"))
    sized = useful.join(sizes, ["side", "id"])

    small = (
        sized.where(F.col("n") < large_size)
        .groupBy("side", "id")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list("t")).alias("t"))
        .select("side", "id", "n", F.size("t").cast("long").alias("e"), F.col("t.token").alias("tokens"))
        # a partner has p²/q² times the size or more, and all the overlap must lie in shared values
        .where(F.col("e") >= _least_large(F.col("n"), p, q))
        .withColumn("sid", F.monotonically_increasing_id())
    )
    small = work.keep(small)

    big_rows = sized.where(F.col("n") >= large_size)
    big_ids = work.keep(big_rows.select("side", "id", "n").distinct().withColumn("sid", F.lit(1 << 62) + F.monotonically_increasing_id()))

    # identical sets of one table: only where every value is shared
    whole = small.where("e = n").groupBy("side", "tokens").agg(F.min("sid").alias("class_id"), F.count("*").alias("k")).where("k > 1")
    classes = work.keep(small.where("e = n").join(whole, ["side", "tokens"]).select("sid", "class_id"))
    members = (
        small.join(classes, "sid", "left")
        .select(F.coalesce("class_id", "sid").alias("class_id"), F.col("class_id").isNotNull().alias("copies"), "side", "id")
        .unionAll(big_ids.select(F.col("sid").alias("class_id"), F.lit(False).alias("copies"), "side", "id"))
    )
    reps = small.join(classes.where("sid <> class_id"), "sid", "left_anti")

    pairs = _small_pairs(reps, p, q, between)
    if not big_ids.isEmpty():
        pairs = pairs.unionAll(_large_pairs(big_rows, big_ids, reps, p, q, large_size, between))
    return SetJoin(members, pairs, between, sizes.select("side", "id"))


def _reaches(k: Column, n_a: Column, n_b: Column, p: int, q: int) -> Column:
    """k / sqrt(n_a·n_b) >= p/q, in whole numbers; beyond 64 bits the session's ANSI mode raises."""
    return k * k * F.lit(q * q) >= n_a * n_b * F.lit(p * p)


def _small_pairs(sets: DataFrame, p: int, q: int, between: bool) -> DataFrame:
    c = SUBSET
    n, e, tokens = F.col("n"), F.col("e"), F.col("tokens")
    least_s = _ceil_times_root(n, p, q)  # overlap with a partner that is not smaller
    least_l = _least_large(n, p, q)  # and with one that is not larger
    tiny_max = (c - 1) * q // p  # sets up to this size may need fewer than c shared values
    tiny_reach = tiny_max * q * q // (p * p)  # partners of such sets are no larger than this

    def cut(length: Column) -> Column:
        return F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.least(length, e)).cast("int"))

    as_small = F.when(n <= tiny_max, _subsets(cut(e - least_s + 1), 1)).otherwise(_subsets(cut(e - least_s + c), c))
    as_large = F.concat(
        _subsets(cut(e - F.greatest(least_l, F.lit(c)) + c), c),
        F.when(n <= tiny_reach, _subsets(cut(e - F.greatest(least_l, F.lit(1)) + 1), 1)).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    lower = sets.where(e >= least_s).select("side", F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.explode(as_small).alias("key"))
    upper = sets.select(F.col("side").alias("side_b"), F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.explode(as_large).alias("key"))
    met = lower.join(upper, "key").where(
        ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("sid_a") < F.col("sid_b")))) & (F.col("n_a") * q * q >= F.col("n_b") * p * p)
    )
    if between:
        met = met.where("side <> side_b")
    met = met.select("sid_a", "sid_b").distinct()
    a = sets.select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    both = met.join(a, "sid_a").join(b, "sid_b")
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    return both.where(_reaches(overlap, F.col("n_a"), F.col("n_b"), p, q)).select(F.col("sid_a").alias("class_a"), F.col("sid_b").alias("class_b"))


def _large_pairs(big_rows: DataFrame, big_ids: DataFrame, reps: DataFrame, p: int, q: int, large_size: int, between: bool) -> DataFrame:
    """Pairs with at least one large set: scan the inverted lists of its rarer values, then count."""
    by_sid = Window.partitionBy("sid").orderBy("df", "token")
    big = big_rows.join(big_ids.select("side", "id", "sid"), ["side", "id"]).select("side", "sid", "n", F.col("t.df").alias("df"), F.col("t.token").alias("token"))
    # which values lie in the part that must be shared: the rarest e - t + 1
    big = big.withColumn("rank", F.row_number().over(by_sid)).withColumn("e", F.count("*").over(Window.partitionBy("sid")))
    big = big.withColumn("probe", F.col("rank") <= F.col("e") - _least_large(F.col("n"), p, q) + 1).drop("rank", "e", "df")
    least_partner = _least_large(F.lit(large_size), p, q)
    rest = reps.where(F.col("n") >= least_partner).select("side", "sid", "n", F.explode("tokens").alias("token"))
    every = rest.unionAll(big.select("side", "sid", "n", "token"))
    one = big.where("probe").select(F.col("side").alias("side_1"), F.col("sid").alias("s1"), F.col("n").alias("n1"), "token")
    two = every.select(F.col("side").alias("side_2"), F.col("sid").alias("s2"), F.col("n").alias("n2"), "token")
    met = one.join(two, "token").where((F.col("s1") != F.col("s2")) & (F.col("n1") * p * p <= F.col("n2") * q * q) & (F.col("n2") * p * p <= F.col("n1") * q * q))
    if between:
        met = met.where("side_1 <> side_2")
    met = met.select("s1", "n1", "s2", "n2").distinct()
    shared = met.join(big.select(F.col("sid").alias("s1"), "token"), "s1").join(every.select(F.col("sid").alias("s2"), "token"), ["s2", "token"])
    counted = shared.groupBy("s1", "n1", "s2", "n2").agg(F.count("*").alias("k"))
    good = counted.where(_reaches(F.col("k"), F.col("n1"), F.col("n2"), p, q))
    return good.select(F.least("s1", "s2").alias("class_a"), F.greatest("s1", "s2").alias("class_b")).distinct()


def overlap_needed(n_a: int, n_b: int, threshold: str = "0.6") -> int:
    """Least overlap of sets of these sizes; for tests and callers that plan sizes."""
    theta = Fraction(threshold)
    need = theta * theta * n_a * n_b
    k = isqrt(need.numerator // need.denominator)
    while k * k < need:
        k += 1
    return k
