"""The warehouse: one Parquet table each, loaded, kept and brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.schemas import KEYS, SCHEMAS, conform, key_violations
from quillon.session import Workspace


#: computed tables by application, folder, state of the folder, name and builder
_SHARED: dict[tuple, DataFrame] = {}


class Warehouse:
    """Tables under one folder, as <name>.parquet; a table that isn't there is empty.

    ``derived`` gives tables that are computed rather than stored, by name. Those in ``made_once`` are
    written to the shared folder when they are first asked for, because several readers follow; later warehouses over
    the same folder read them too, as long as no table of the folder has changed. Those in ``light`` are remembered
    only: what they take long for is written by their builder, and the rest is a projection.
    """

    made_once = ("line_members", "topics_alike", "thread_members", "sophistication_composite", "lines_alone", "research_lines", "research_line_subclusters")
    light = ("sophistication_composite",)

    def __init__(self, spark: SparkSession, folder: str, derived: dict[str, Callable[[Warehouse], DataFrame]] | None = None):
        self.spark, self.folder, self.derived = spark, folder.rstrip("/"), derived or {}

    def _state(self) -> tuple:
        """Name, time and size of what lies in the folder."""
        fs, at = self._fs(self.folder)
        return tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(at))) if fs.exists(at) else ()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def has(self, name: str) -> bool:
        fs, at = self._fs(self.path(name))
        return fs.exists(at)

    def table(self, name: str) -> DataFrame:
        if self.has(name):
            return self.spark.read.parquet(self.path(name))
        if name in self.derived:
            if name not in self.made_once:
                return self.derived[name](self)
            key = (self.spark.sparkContext.applicationId, self.folder, self._state(), name, self.derived[name])
            if key not in _SHARED:
                built = self.derived[name](self)
                _SHARED[key] = built if name in self.light else Workspace(self.spark).keep(built)
            return _SHARED[key]
        return self.spark.createDataFrame([], SCHEMAS[name])

    def register(self, prefix: str = "") -> None:
        """Every table as a temporary view."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)

    # writing ---------------------------------------------------------------------------------

    def _swap(self, name: str, df: DataFrame) -> None:
        """Writes beside the table and then takes its place, so a plan may read what it replaces."""
        fresh = f"{self.folder}/_{name}.new"
        df.write.mode("overwrite").parquet(fresh)
        fs, at = self._fs(self.path(name))
        _, new = self._fs(fresh)
        fs.delete(at, True)
        if not fs.rename(new, at):
            raise OSError(f"{name} was not put in place")

    def drop(self, name: str) -> None:
        fs, at = self._fs(self.path(name))
        fs.delete(at, True)

    def replace(self, name: str, df: DataFrame, check: bool = True) -> DataFrame:
        """The table is what the scan found now, nothing older. A null or repeated key raises."""
        df = conform(df, name)
        if check and KEYS[name]:
            bad = key_violations(df, KEYS[name]).limit(3).collect()
            if bad:
                raise ValueError(f"{name}: {[tuple(r) for r in bad]}")
        self._swap(name, df)
        return self.table(name)

    def replace_if_any(self, name: str, df: DataFrame) -> bool:
        """Like replace, but an empty result leaves the table alone: a failed extraction wipes nothing."""
        if df.isEmpty():
            return False
        self.replace(name, df)
        return True

    def append_new(self, name: str, df: DataFrame) -> DataFrame:
        """Appends rows whose key is not there yet; returns them."""
        new = Workspace(self.spark).keep(missing(conform(df, name), self.table(name), KEYS[name]))
        new.write.mode("append").parquet(self.path(name))
        return new

    def upsert(self, name: str, df: DataFrame) -> DataFrame:
        """Rows replace those of the same key, other rows stay."""
        self._swap(name, upserted(self.table(name), conform(df, name), KEYS[name]))
        return self.table(name)

    def purge(self, name: str, parent: str, key: str) -> DataFrame:
        """Drops rows whose ``key`` is gone from the parent table."""
        self._swap(name, self.table(name).join(self.table(parent).select(key).distinct(), key, "left_semi"))
        return self.table(name)


def missing(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def enrich_projects(projects: DataFrame, revisions: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Depth and dates from the revisions: those of the plan alone, and the last of any document; and
    the review's date and reviewer from ``review`` (project_id, review_date, review_reviewer)."""
    plan = F.col("source_doc") == "RESEARCH_PLAN"
    found = revisions.groupBy("project_id").agg(
        F.min(F.when(plan, F.col("version_date"))).alias("_start"), F.max(F.when(plan, F.col("version_date"))).alias("_done"), F.nullif(F.count_if(plan), F.lit(0)).cast("int").alias("_depth"), F.max("version_date").alias("_any")
    )
    out = projects.join(found, "project_id", "left")
    new = {"start_date": "_start", "completion_date": "_done", "revision_depth": "_depth", "effective_completion_date": "_any"}
    if review is not None:
        reviews = review.select("project_id", F.col("review_date").alias("_review"), F.col("review_reviewer").alias("_reviewer")).dropDuplicates(["project_id"])
        out = out.join(reviews, "project_id", "left")
        new |= {"review_date": "_review", "review_reviewer": "_reviewer"}
    return out.select(*(F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in projects.columns))


def merge_name_only_authors(authors: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name-only authors become the one author with an iD and the same name, if there is exactly one.

    Returns the authors without those merged and the links with the new ids.
    """
    with_id = authors.where("orcid_id is not null").groupBy("canonical_name").agg(F.count_distinct("author_id").alias("k"), F.min("author_id").alias("target")).where("k = 1").select("canonical_name", "target")
    moved = authors.where("orcid_id is null").join(with_id, "canonical_name").select("author_id", "target").distinct()
    kept = authors.join(moved, "author_id", "left_anti")
    relinked = links.join(moved, "author_id", "left").withColumn("author_id", F.coalesce("target", "author_id")).select(*links.columns)
    return kept, relinked
