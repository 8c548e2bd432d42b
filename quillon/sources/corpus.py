"""Scanning a tree of project folders into warehouse tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import parsing as P
from quillon.functions import text as X
from quillon.schemas import SCHEMAS, conform
from quillon.session import Workspace
from quillon.sources.warehouse import enrich_projects, merge_name_only_authors

# fixed value: folders and files that are never scanned
IGNORED = [".git", ".ipynb_checkpoints", "__pycache__", ".DS_Store", ".pytest_cache", ".venv", "venv", "node_modules"]


def files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), names: str | None = None) -> DataFrame:
    """(project_id, rel, name, length, modified) of all files under the project folders, from the listing
    alone; with a pattern of ``names`` of those that match, with their content.

    Names of ``IGNORED`` anywhere in the path, dot folders at the top and excluded projects are left out.
    """
    base = root.rstrip("/").removeprefix("file:")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", names) if names else reader).load(root)
    inner = F.substring_index(F.col("path"), base + "/", -1)
    parts = F.split(inner, "/")
    out = raw.select(F.element_at(parts, 1).alias("project_id"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("rel"), F.element_at(parts, -1).alias("name"), parts.alias("parts"), "length", F.col("modificationTime").alias("modified"), *(["content"] if names else [])).where(F.size("parts") > 1)
    out = out.where(~F.arrays_overlap("parts", F.array(*map(F.lit, IGNORED))) & ~F.col("project_id").startswith(".") & ~F.col("project_id").isin(list(exclude) or [""]))
    return out.drop("parts")


def own_output(texts: DataFrame) -> DataFrame:
    """(project_id, rel) of files that the engine wrote itself, known by their first line."""
    return texts.where(F.decode(F.substring("content", 1, 200), "UTF-8").rlike(P.MARKER.pattern)).select("project_id", "rel")


def inventory(found: DataFrame, observed_at=None) -> DataFrame:
    """The projects table: counts, sizes, extensions, which folders and documents are there."""
    has = lambda cond: F.max(cond)
    dot = F.regexp_extract("name", r"(?<=.)\.([^.]+)$", 1)
    ext = F.when(dot == "", "_no_ext").otherwise(F.concat(F.lit("."), F.lower(dot)))
    kinds = found.groupBy("project_id", ext.alias("ext")).agg(F.count("*").alias("n")).groupBy("project_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n"))))).alias("file_type_counts"))
    top = F.instr("rel", "/") == 0
    books = F.col("rel").rlike(r"^notebooks/[^/]+\.ipynb$")
    rolled = found.groupBy("project_id").agg(
        F.sum("length").alias("total_bytes"), F.count("*").cast("int").alias("file_count"), F.max("modified").cast("timestamp_ntz").alias("last_touched"), has(F.col("rel").startswith("notebooks/")).alias("has_notebooks"), F.count_if(books).cast("int").alias("notebook_count"),
        has(F.col("rel").startswith("data/")).alias("has_data_dir"), has(F.col("rel").startswith("figures/")).alias("has_figures_dir"), has(F.col("rel") == "references.md").alias("has_references_md"),
        F.to_json(F.sort_array(F.collect_set(F.when(top & F.col("name").isin(list(P.CANONICAL_DOCS)), F.col("name"))))).alias("canonical_docs_present"),
    )
    out = rolled.join(kinds, "project_id").withColumns({"name": F.col("project_id"), "observed_at": F.lit(observed_at)})
    return conform(out, "projects")


def expand(df: DataFrame, keep: list[str], fields: list[T.StructField], parse: Callable[[dict], list[dict]]) -> DataFrame:
    """One row in, ``parse``'s rows out, beside the kept columns; batches go through Arrow."""
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])
    names = [f.name for f in fields]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*(r[k] for k in keep), *(out.get(n) for n in names)) for r in batch.to_dict("records") for out in parse(r)]
            yield pd.DataFrame(rows, columns=[*keep, *names], dtype=object)

    return df.mapInPandas(work, schema)


def documents(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(project_id, source_doc, text) of the canonical documents at a project's top. Of reviews the bare
    file wins, else the one with the highest number; which one is settled by name, before contents are moved."""
    names = F.create_map(*(F.lit(x) for pair in P.CANONICAL_DOCS.items() for x in pair))
    top = found.where(F.instr("rel", "/") == 0)
    number = F.regexp_extract("name", r"^REVIEW_(\d+)\.md$", 1)
    doc = F.coalesce(F.try_element_at(names, F.col("name")), F.when(number != "", "REVIEW"))
    rank = F.when(number == "", F.lit(1 << 31)).otherwise(F.try_to_number(number, F.lit("999999999")).cast("long"))
    chosen = top.withColumn("source_doc", doc).where("source_doc is not null").groupBy("project_id", "source_doc").agg(F.max_by("rel", F.struct(rank, "name")).alias("rel"))
    return texts.join(chosen, ["project_id", "rel"]).select("project_id", "source_doc", F.decode("content", "UTF-8").alias("text"))


def sections(docs: DataFrame, observed_at=None) -> DataFrame:
    """The sections table, contents whole: revisions, authors, references and the extraction read them."""
    fields = [SCHEMAS["sections"][n] for n in ("h1_text", "h2_text", "content", "start_offset", "end_offset")]
    out = expand(docs, ["project_id", "source_doc"], fields, lambda r: P.sections(r["text"]))
    return conform(out.withColumns({"section_id": X.section_id(F.col("project_id"), F.col("source_doc"), F.col("h2_text"), F.col("start_offset")), "byte_size": F.octet_length("content").cast("int"), "observed_at": F.lit(observed_at)}), "sections")


def revisions(secs: DataFrame, observed_at=None) -> tuple[DataFrame, DataFrame]:
    """The revisions table, and the rejected rows whose date is none."""
    histories = secs.where("lower(h2_text) = 'revision history' and source_doc in ('RESEARCH_PLAN', 'REPORT')")
    fields = [T.StructField(n, T.StringType()) for n in ("version_label", "version_date", "date_precision", "change_description", "source_quote")]
    out = expand(histories.select("project_id", "source_doc", "content"), ["project_id", "source_doc"], fields, lambda r: P.revisions(r["content"]))
    out = out.withColumns({"day": F.try_to_date("version_date"), "revision_id": X.revision_id(F.col("project_id"), F.col("source_doc"), F.col("version_label"), F.col("change_description")), "observed_at": F.lit(observed_at)})
    good = out.where("day is not null").withColumns({"version_date": F.col("day"), "change_description": F.substring("change_description", 1, 2000), "source_quote": F.substring("source_quote", 1, 2000)})
    # equal bullets of one list have one id: they are one revision
    return conform(good, "project_revisions").dropDuplicates(["revision_id"]), out.where("day is null").drop("day")


def authors(secs: DataFrame, observed_at=None) -> tuple[DataFrame, DataFrame]:
    """The authors table, name-only rows merged where one iD has the same name, and the links."""
    lists = secs.where("lower(h2_text) = 'authors' and source_doc in ('README', 'RESEARCH_PLAN', 'REPORT')")
    fields = [T.StructField(n, T.StringType()) for n in ("name", "orcid_id", "affiliation", "source_quote")]
    rows = expand(lists.select("project_id", "source_doc", "content"), ["project_id", "source_doc"], fields, lambda r: P.authors(r["content"])).withColumn("author_id", X.author_id(F.col("orcid_id"), F.col("name")))
    first = rows.groupBy("author_id").agg(F.min(F.struct("project_id", "source_doc", "name", "orcid_id", "affiliation")).alias("a"))
    people = conform(first.select("author_id", "a.orcid_id", F.col("a.name").alias("canonical_name"), "a.affiliation", F.col("a.project_id").alias("first_seen_in_project_id"), F.lit(observed_at).alias("observed_at")), "authors")
    links = rows.groupBy("project_id", "author_id", "source_doc").agg(F.min("source_quote").alias("source_quote")).withColumns({"role": F.lit("listed-author"), "observed_at": F.lit(observed_at)})
    return merge_name_only_authors(people, conform(links, "project_authors"))


def notebooks(texts: DataFrame, observed_at=None) -> DataFrame:
    books = texts.where(F.col("rel").rlike(r"^notebooks/[^/]+\.ipynb$")).select("project_id", "rel", "name", "length", "modified", F.decode("content", "UTF-8").alias("text"))
    own = ("notebook_number", "notebook_suffix", "title_from_first_md_cell", "goal_phrase", "total_cells", "markdown_cells", "code_cells", "raw_cells", "has_outputs")
    out = expand(books, ["project_id", "rel", "name", "length", "modified"], [SCHEMAS["notebooks"][n] for n in own], lambda r: [b for b in (P.notebook(r["name"], r["text"]),) if b])
    return conform(out.withColumns({"notebook_id": F.concat_ws(":", "project_id", "name"), "filename": F.col("name"), "relative_path": F.col("rel"), "byte_size": F.col("length"), "first_mtime": F.col("modified").cast("timestamp_ntz"), "observed_at": F.lit(observed_at)}), "notebooks")


def notebook_order() -> list:
    return [F.coalesce("notebook_number", F.lit(9999)), F.coalesce("notebook_suffix", F.lit("")), F.col("filename")]


def references(secs: DataFrame, projects: DataFrame, observed_at=None) -> DataFrame:
    """The edges table. Every backticked word is taken out in the JVM and joined with the ids, so the
    ids needn't fit a pattern; the exact pattern runs only over sections that name one."""
    ids = projects.select("project_id").distinct()
    words = secs.select("section_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("(?=`([^`]+)`)"), 1))).alias("word"))
    named = words.join(ids.withColumnRenamed("project_id", "word"), "word").groupBy("section_id").agg(F.collect_set("word").alias("words"))
    fields = [T.StructField("dst_project_id", T.StringType()), T.StructField("occurrence_count", T.IntegerType()), T.StructField("source_quote", T.StringType())]
    hits = secs.join(named, "section_id").select("project_id", "source_doc", "h2_text", "content", "words")
    out = expand(hits, ["project_id", "source_doc", "h2_text"], fields, lambda r: P.References(set(r["words"])).find(r["project_id"], r["content"]))
    out = out.withColumns({"src_project_id": F.col("project_id"), "source_section": F.col("h2_text"), "confidence_tier": F.lit("declared"), "edge_id": X.edge_id(F.col("project_id"), F.col("dst_project_id"), F.col("source_doc"), F.col("h2_text")), "observed_at": F.lit(observed_at)})
    # two sections of one title share an edge: their counts add up
    merged = out.groupBy("edge_id", "src_project_id", "dst_project_id", "confidence_tier", "source_doc", "source_section", "observed_at").agg(F.sum("occurrence_count").cast("int").alias("occurrence_count"), F.min("source_quote").alias("source_quote"))
    return conform(merged, "reuse_edges")


def reviews(secs: DataFrame) -> DataFrame:
    """(project_id, review_date, review_reviewer) from the front matter of reviews."""
    heads = secs.where(f"source_doc = 'REVIEW' and h2_text = '{P.FRONT_MATTER}'")
    return heads.select("project_id", F.try_to_date(F.regexp_extract("content", r"(?m)^date:\s*'?(\d{4}-\d{2}-\d{2})", 1)).alias("review_date"), F.nullif(F.regexp_extract("content", r"(?m)^reviewer:\s*(.+?)\s*$", 1), F.lit("")).alias("review_reviewer"))


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), observed_at=None) -> dict[str, DataFrame]:
    """All tables that need no model, and ``rejects``."""
    work = Workspace(spark)
    texts = files(spark, root, exclude, "*.{md,html,ipynb}")
    listed = files(spark, root, exclude)
    found = work.keep(listed.join(own_output(texts), ["project_id", "rel"], "left_anti"))
    # six tables are made of the sections, so they are parsed once
    secs = work.keep(sections(documents(found, files(spark, root, exclude, "*.md")), observed_at))
    revs, rejects = revisions(secs, observed_at)
    people, links = authors(secs, observed_at)
    projects = enrich_projects(inventory(found, observed_at), revs, reviews(secs))
    return {"projects": projects, "sections": secs, "project_revisions": revs, "authors": people, "project_authors": links, "notebooks": notebooks(files(spark, root, exclude, "*.ipynb"), observed_at), "reuse_edges": references(secs, projects, observed_at), "rejects": rejects}
