"""Citation edges and how their two ends are related by authors.

Three readings of "another's work" are in use; all come from one classification:
``loose``  not self: no author in common, an end without authors included;
``strict`` both ends have authors and none in common;
``own``    everything that is not strict.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import neighbours as N
from quillon.session import Workspace

FEW = 4_000_000  # rows up to which one task counts what is around the projects; the result doesn't depend on it
HEAVY = 100_000  # paths over one project from which its ends meet by classes; the result doesn't depend on it


def declared(reuse: DataFrame, tier: str = "declared", repeats: bool = False) -> DataFrame:
    """The distinct (src, dst) of one confidence tier; with ``repeats`` as they are, for readers that don't mind."""
    rows = reuse.where(F.col("confidence_tier") == tier).select(F.col("src_project_id").alias("src"), F.col("dst_project_id").alias("dst"))
    return rows if repeats else rows.distinct()


def memberships(project_authors: DataFrame) -> DataFrame:
    return project_authors.select(F.col("project_id").alias("pid"), F.col("author_id").alias("aid")).where("aid is not null").distinct()


def classify_edges(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """``edges`` (src, dst) with ``shared``, ``src_has``, ``dst_has`` and the readings built on them.

    ``authors`` are distinct (pid, aid). One shared author is enough, so the pairs are made distinct
    before they meet the edges again.
    """
    of_src = authors.select(F.col("pid").alias("src"), "aid")
    of_dst = authors.select(F.col("pid").alias("dst"), "aid")
    both = edges.join(of_src, "src").join(of_dst, ["dst", "aid"]).select("src", "dst").distinct().withColumn("shared", F.lit(True))
    has = authors.select("pid").distinct()
    out = (
        edges.join(both, ["src", "dst"], "left")
        .join(has.select(F.col("pid").alias("src"), F.lit(True).alias("src_has")), "src", "left")
        .join(has.select(F.col("pid").alias("dst"), F.lit(True).alias("dst_has")), "dst", "left")
        .select("src", "dst", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("shared", "src_has", "dst_has")))
    )
    strict = ~F.col("shared") & F.col("src_has") & F.col("dst_has")
    return out.withColumn("loose", ~F.col("shared")).withColumn("strict", strict).withColumn("own", ~strict)


def degrees(classified: DataFrame) -> DataFrame:
    """(pid, in_degree, out_degree, self_in_degree, self_out_degree), by the loose reading; an edge with a
    null end counts for neither."""
    whole = classified.where("src is not null and dst is not null")
    ends = whole.select(F.col("dst").alias("pid"), F.lit(1).alias("inward"), "shared").unionAll(whole.select(F.col("src").alias("pid"), F.lit(0), "shared"))
    count = lambda inward, shared: F.count_if((F.col("inward") == inward) & (F.col("shared") == shared))
    return ends.groupBy("pid").agg(count(1, False).alias("in_degree"), count(0, False).alias("out_degree"), count(1, True).alias("self_in_degree"), count(0, True).alias("self_out_degree"))


def two_hop(classified: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(pid, two_hop_in_degree): distinct projects two loose edges away, not the project itself."""
    work = Workspace(classified.sparkSession)
    loose = work.keep(classified.where("loose and src is not null and dst is not null").select("src", "dst"))
    known = work.keep(loose.select(F.col("src").alias("name")).union(loose.select("dst")).distinct().select("name", F.monotonically_increasing_id().alias("id")))
    edges = work.keep(loose.join(known.select(F.col("name").alias("src"), F.col("id").alias("s")), "src").join(known.select(F.col("name").alias("dst"), F.col("id").alias("d")), "dst").select("s", "d"))
    return two_hop_numbers(edges, heavy).join(known, "id").select(F.col("name").alias("pid"), F.col("n").alias("two_hop_in_degree"))


def two_hop_numbers(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(id, n): distinct nodes two of the ``edges`` away, not the node itself. The edges are distinct
    (s, d) of numbers, none null, and written: they are read several times.

    A project that many cite and that cites many, with ``heavy`` paths or more over it, would pair all with
    all. The projects that cite the same heavy ones are one class, and so are those that are cited by the
    same: a class of these is reached by whole classes of those, of which the sizes are added. Paths over the
    other projects are listed, and those whose ends meet over a heavy one as well are left out: the heavy
    ones at either end are at hand in the row.
    """
    work = Workspace(edges.sparkSession)
    sizes = edges.groupBy(F.col("d").alias("mid")).agg(F.count("*").alias("i")).join(edges.groupBy(F.col("s").alias("mid")).agg(F.count("*").alias("o")), "mid")
    over = work.keep(sizes.where(F.col("i") * F.col("o") >= heavy).select("mid"))

    def classes(end: str, mid: str, name: str) -> tuple[DataFrame, DataFrame]:
        """(node, mids) of the nodes at one end of the heavy ones' edges, and their classes (class, mids, n)."""
        sets = work.keep(edges.join(over, F.col(mid) == F.col("mid"), "left_semi").groupBy(F.col(end).alias("node")).agg(F.sort_array(F.collect_set(mid)).alias("mids")))
        return sets, sets.groupBy("mids").agg(F.min("node").alias(name), F.count("*").alias("n"))

    fars, far_classes = classes("s", "d", "fc")
    pids, pid_classes = classes("d", "s", "pc")
    meet = pid_classes.select("pc", F.explode("mids").alias("mid")).join(far_classes.select("fc", "n", F.explode("mids").alias("mid")), "mid").select("pc", "fc", "n").distinct()
    reached = meet.groupBy("pc").agg(F.sum("n").alias("n")).join(pid_classes.select("pc", "mids"), "pc")
    whole = pids.join(reached, "mids").select(F.col("node").alias("id"), "n")
    itself = pids.join(fars.withColumnRenamed("mids", "fm"), "node").where(F.arrays_overlap("mids", "fm")).select(F.col("node").alias("id"), F.lit(-1).cast("long").alias("n"))
    # the paths over the others
    first = edges.join(over, F.col("d") == F.col("mid"), "left_anti").join(fars.select(F.col("node").alias("s"), F.col("mids").alias("fm")), "s", "left").select(F.col("s").alias("far"), F.col("d").alias("mid"), "fm")
    second = edges.join(over, F.col("s") == F.col("mid"), "left_anti").join(pids.select(F.col("node").alias("d"), F.col("mids").alias("pm")), "d", "left").select(F.col("s").alias("mid"), F.col("d").alias("id"), "pm")
    paths = first.join(second, "mid").where((F.col("far") != F.col("id")) & ~F.coalesce(F.arrays_overlap("fm", "pm"), F.lit(False)))
    listed = paths.select("id", "far").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return whole.unionAll(itself).unionAll(listed).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")


def neighbourhoods(reuse: DataFrame, project_authors: DataFrame, few: int = FEW) -> DataFrame:
    """(pid, in_degree, out_degree, self_in_degree, self_out_degree, two_hop_in_degree, cross_author_downstream,
    distinct_prior_authors): what ``degrees``, ``two_hop`` and ``authors_across`` (both ways, of projects with
    an author) count over the declared edges. Up to ``few`` rows of both tables are counted in one task, as arrays
    of numbers; more come from one table of numbered edges with the authors of both ends.

    An edge with a null end counts for none of them.
    """
    rows = reuse.where((F.col("confidence_tier") == "declared") & F.col("src_project_id").isNotNull() & F.col("dst_project_id").isNotNull()).select(F.col("src_project_id").alias("src"), F.col("dst_project_id").alias("dst"))
    links = project_authors.where("author_id is not null and project_id is not null").select(F.col("project_id").alias("pid"), F.col("author_id").alias("aid"))
    if reuse.select(F.lit(1)).unionAll(project_authors.select(F.lit(1))).count() <= few:
        both = rows.select(F.lit(True).alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(links.select(F.lit(False), "pid", "aid"))
        return both.repartition(1).mapInArrow(partial(N.counted, heavy=HEAVY), ", ".join(["pid string", *(f"{n} long" for n in N.NAMES)]))
    work = Workspace(reuse.sparkSession)
    people = work.keep(links.select("aid").distinct().select("aid", F.monotonically_increasing_id().alias("a")))
    held = links.join(people, "aid").groupBy("pid").agg(F.collect_set("a").alias("people"))
    ends = rows.select(F.explode(F.array("src", "dst")).alias("pid")).distinct()
    known = work.keep(ends.join(held, "pid", "left").select("pid", F.monotonically_increasing_id().alias("id"), "people"))
    of = lambda end, number, people: known.select(F.col("pid").alias(end), F.col("id").alias(number), F.col("people").alias(people))
    # made distinct where the join with the sources needs them
    edges = rows.repartition("src").distinct().join(of("src", "s", "sa"), "src").select("dst", "s", "sa").join(of("dst", "d", "da"), "dst")
    edges = work.keep(edges.select("s", "d", "sa", "da", F.coalesce(F.arrays_overlap("sa", "da"), F.lit(False)).alias("shared")))
    names = N.NAMES
    part = lambda df, *counted: df.select("id", *((F.col(n) if n in counted else F.lit(0)).cast("long").alias(n) for n in names))
    both = edges.select(F.explode(F.array(F.struct(F.col("d").alias("id"), F.lit(True).alias("inward"), "shared"), F.struct(F.col("s").alias("id"), F.lit(False).alias("inward"), "shared"))).alias("e")).select("e.*")
    counted = both.groupBy("id").agg(*(F.count_if(c).alias(n) for n, c in zip(names, (F.expr("inward and not shared"), F.expr("not inward and not shared"), F.expr("inward and shared"), F.expr("not inward and shared")))))
    to = lambda people, end, inward: F.transform(people, lambda a: F.struct(F.col(end).alias("id"), F.lit(inward).alias("inward"), a.alias("a")))
    met = edges.where("not shared and sa is not null and da is not null").select(F.explode(F.concat(to("sa", "d", True), to("da", "s", False))).alias("e")).select("e.*").distinct()
    across = met.groupBy("id").agg(F.count_if("inward").alias("cross_author_downstream"), F.count_if(~F.col("inward")).alias("distinct_prior_authors"))
    hops = two_hop_numbers(work.keep(edges.where("not shared").select("s", "d"))).withColumnRenamed("n", "two_hop_in_degree")
    each = part(counted, *names[:4]).unionAll(part(hops, names[4])).unionAll(part(across, *names[5:])).groupBy("id").agg(*(F.sum(n).alias(n) for n in names))
    return each.join(known.select("pid", "id"), "id").drop("id")


def authors_across(classified: DataFrame, authors: DataFrame, inward: bool, need_own: bool) -> DataFrame:
    """(pid, aid): authors at the other end of a project's loose edges.

    ``need_own`` leaves out projects that have no author themselves.
    """
    near, far, has = ("dst", "src", "dst_has") if inward else ("src", "dst", "src_has")
    edges = classified.where("loose")
    if need_own:
        edges = edges.where(has)
    return edges.select(F.col(near).alias("pid"), F.col(far).alias("other")).join(authors.withColumnRenamed("pid", "other"), "other").select("pid", "aid").distinct()
