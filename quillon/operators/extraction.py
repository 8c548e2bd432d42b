"""Extraction by a model: what to ask, the cache of answers, answers to rows, and vocabulary drift.

The model is a ``Scorer``: a function of a batch of prompts. The engine ships a deterministic one for
tests and calls no service itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import parsing as P
from quillon.functions import text as X
from quillon.schemas import conform
from quillon.session import Workspace
from quillon.sources.vocab import canonicalise

# fixed values: the arrays of an answer and the kind of entity in each
ARRAYS = {"organisms": "organism", "methods": "method", "databases": "database", "journals": "journal", "functions": "function"}
CLAIM_CONFIDENCE, QUESTION_CONFIDENCE, MATCHED_CONFIDENCE, PROPOSED_CONFIDENCE = 0.6, 0.7, 0.95, 0.7


class Scorer(Protocol):
    model_id: str

    def answer(self, prompts: list[str]) -> list[tuple[str, str]]:
        """(content, finish_reason) for each prompt. A scorer may have ``answer_long`` besides, the same with
        a higher limit of tokens, for what was cut off."""


class StubScorer:
    """Answers from the words of the prompt: every capitalised word is an organism. For tests."""

    model_id = "stub"

    def answer(self, prompts: list[str]) -> list[tuple[str, str]]:
        out = []
        for p in prompts:
            names = [w.strip(".,") for w in p.split() if w[:1].isupper()]
            out.append((json.dumps({"organisms": [{"surface_form": n, "canonical_name": n, "source_quote": None} for n in names]}), "stop"))
        return out


def to_extract(sections: DataFrame) -> DataFrame:
    """(section columns, chunk_idx, total_chunks, chunk): the sections worth reading, cut for the model."""
    title_ok = F.col("h2_text").isNotNull() & ~F.col("h2_text").isin(P.FRONT_MATTER, P.PREAMBLE, *P.SKIPPED_TITLES)
    rows = sections.where(F.col("source_doc").isin(*P.CANONICAL_DOCS.values()) & title_ok & (F.length(F.trim(F.coalesce("content", F.lit("")))) >= 80))
    keep = ["section_id", "project_id", "source_doc", "h2_text"]
    return chunked(rows, "content", keep)


def chunked(df: DataFrame, text_col: str, keep: list[str], limit: int = P.CHUNK_LIMIT) -> DataFrame:
    """The kept columns with chunk_idx, total_chunks, chunk; short texts don't leave the JVM."""
    short = df.where(F.col(text_col).isNull() | (F.char_length(text_col) <= limit)).select(*keep, F.lit(0).alias("chunk_idx"), F.lit(1).alias("total_chunks"), F.col(text_col).alias("chunk"))
    long = df.where(F.char_length(text_col) > limit).select(*keep, F.col(text_col).alias("_text"))
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("chunk_idx", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = []
                for r in batch.iloc[start : start + 256].to_dict("records"):
                    parts = P.chunks(r["_text"], limit)
                    rows += [(*(r[k] for k in keep), i, len(parts), c) for i, c in enumerate(parts)]
                yield pd.DataFrame(rows, columns=schema.names)

    return short.unionAll(long.mapInPandas(work, schema))


def with_cache_key(chunks: DataFrame, prompt_version: str, vocab_version: str, model_id: str) -> DataFrame:
    digest = X.content_hash(F.col("chunk"), F.col("chunk_idx"), F.col("total_chunks"))
    keyed = chunks.withColumn("content_hash", digest).withColumns({"prompt_version": F.lit(prompt_version), "vocab_version": F.lit(vocab_version), "model_id": F.lit(model_id)})
    return keyed.withColumn("cache_key", X.cache_key(F.col("content_hash"), F.col("prompt_version"), F.col("vocab_version"), F.col("model_id")))


def usable(cache: DataFrame) -> DataFrame:
    """Cached answers that were not cut off."""
    reason = F.get_json_object("response_metadata", "$.finish_reason")
    return cache.where(F.coalesce(reason, F.lit("")) != "length")


def cache_split(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks with their cached answer, and those to ask for."""
    have = usable(cache).select("cache_key", "response_content")
    return keyed.join(have, "cache_key"), keyed.join(have.select("cache_key"), "cache_key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.count_distinct("content_hash").alias("contents"), F.count_distinct("model_id").alias("models"), F.count_distinct("prompt_version").alias("prompts"), F.min("cached_at").alias("first_cached"), F.max("cached_at").alias("last_cached"))


def ask(misses: DataFrame, scorer: Callable[[], Scorer], batch_size: int = 32) -> DataFrame:
    """``misses`` with response_content, finish_reason and error. An answer cut off is asked for once
    more, with the higher limit if the scorer has one. Where a batch raises, its rows are asked one by one: an exception becomes the error of its row alone."""
    schema = T.StructType([*misses.schema.fields, T.StructField("response_content", T.StringType()), T.StructField("finish_reason", T.StringType()), T.StructField("error", T.StringType())])

    def answers(model: Scorer, prompts: list[str]) -> list[tuple[str | None, str | None, str | None]]:
        try:
            got = model.answer(prompts)
            cut = [i for i, (_, why) in enumerate(got) if why == "length"]
            longer = getattr(model, "answer_long", model.answer)
            for i, again in zip(cut, longer([prompts[i] for i in cut]) if cut else []):
                got[i] = again
            return [(*g, None) for g in got]
        except Exception as e:
            if len(prompts) == 1:
                return [(None, None, str(e)[:500])]
            return [x for p in prompts for x in answers(model, [p])]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size].copy()
                got = answers(model, part["chunk"].tolist())
                part["response_content"], part["finish_reason"], part["error"] = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
                yield part

    return misses.mapInPandas(work, schema)


def parse_answers(answers: DataFrame) -> DataFrame:
    """(section_id, project_id, source_doc, h2_text, chunk_idx, seq, entity_kind, surface, proposed, quote,
    extra, note): one row for each item of an answer, and one of kind parse_error for an answer that
    isn't JSON or no object, or of kind extraction_error where ``error`` says that asking failed. Null fields and items of another shape are passed over."""
    keep = ["section_id", "project_id", "source_doc", "h2_text", "chunk_idx"]
    names = ["seq", "entity_kind", "surface", "proposed", "quote", "extra", "note"]
    schema = T.StructType([*(answers.schema[k] for k in keep), T.StructField("seq", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names[1:])])

    def items(text: str, error: str | None) -> list[tuple]:
        if error is not None:
            return [(0, "extraction_error", None, None, None, None, error)]
        try:
            data = P.salvage_json(text or "")
            if not isinstance(data, dict):
                raise ValueError(f"an object was expected, not {type(data).__name__}")
        except ValueError as e:
            return [(0, "parse_error", None, None, None, None, str(e))]
        rows: list[tuple] = []
        of = lambda key: [x for x in data.get(key) or [] if isinstance(x, dict)] if isinstance(data.get(key) or [], list) else []
        for key, kind in ARRAYS.items():
            for x in of(key):
                surface = x.get("surface_form") or x.get("canonical_name")
                if surface:
                    extra = {k: x[k] for k in ("taxonomy_hint", "category", "kind", "database", "tenant") if k in x}
                    rows.append((len(rows), kind, surface, x.get("canonical_name") or surface, (x.get("source_quote") or "")[:300], json.dumps(extra), x.get("taxonomy_hint") or x.get("category") or x.get("notes")))
        for x in of("question_type_candidates"):
            if x.get("label") and x.get("axis"):
                rows.append((len(rows), "question_type", x["label"], f"{x['axis']}:{x['label']}", (x.get("evidence_quote") or "")[:200], json.dumps({"axis": x["axis"]}), None))
        for x in of("conclusions"):
            if x.get("claim_text"):
                extra = {k: x.get(k) for k in ("claim_type", "confidence_as_stated", "subject_entity")}
                rows.append((len(rows), "conclusion", x["claim_text"][:200], f"claim:{x['claim_text'][:80]}", (x.get("source_quote") or "")[:300], json.dumps(extra), None))
        return rows

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*(r[k] for k in keep), *item) for r in batch.to_dict("records") for item in items(r["response_content"], r["error"])]
            yield pd.DataFrame(rows, columns=schema.names)

    error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string").alias("error")
    return answers.select(*keep, "response_content", error).mapInPandas(work, schema)


def mentions_and_drift(items: DataFrame, forms: DataFrame, prompt_version: str, vocab_version: str, model_id: str) -> tuple[DataFrame, DataFrame]:
    """The mentions and the drift candidates of parsed items.

    A name that the vocabulary has becomes its entry; another becomes a proposal and, besides, a drift
    candidate. Repeats between the chunks of a section count once, the first stays. Ids get #k for the
    k-th repeat in a section.
    """
    named = canonicalise(items, "entity_kind", ["proposed", "surface"], forms)
    vocab_kind = F.col("entity_kind").isin(*ARRAYS.values())
    canonical = F.when(vocab_kind, F.coalesce("canonical_match", F.concat(F.lit(X.PROPOSED), "proposed"))).otherwise(F.col("proposed"))
    sure = F.when(F.col("entity_kind") == "conclusion", CLAIM_CONFIDENCE).when(F.col("entity_kind") == "question_type", QUESTION_CONFIDENCE).when(F.col("canonical_match").isNotNull(), MATCHED_CONFIDENCE).otherwise(PROPOSED_CONFIDENCE)
    base = named.withColumns({"canonical_id": canonical, "confidence": sure.cast("float"), "source_section": F.col("h2_text"), "surface_form": F.col("surface"), "source_quote": F.col("quote"), "prompt_version": F.lit(prompt_version), "vocab_version": F.lit(vocab_version), "model_id": F.lit(model_id)})
    failed = F.col("entity_kind").isin("parse_error", "extraction_error")
    said = once_per_section(base.where(~failed), ["entity_kind", "canonical_id", "surface_form"])
    said = numbered(said, "mention_id", ["section_id", "entity_kind", "canonical_id"]).withColumns({"extraction_source": F.when(vocab_kind & F.col("canonical_match").isNotNull(), "llm+vocab").otherwise("llm"), "extra_json": F.col("extra")})
    open_names = once_per_section(base.where((vocab_kind & F.col("canonical_match").isNull()) | failed), ["entity_kind", "surface_form"])
    drift = numbered(open_names, "drift_id", ["section_id", "entity_kind", "surface_form"]).withColumns({"llm_proposed_canonical": F.when(~failed, F.col("proposed")), "llm_suggested_aliases": F.lit("[]"), "llm_notes": F.col("note"), "llm_decision": F.when(~failed, "proposed")})
    return conform(said, "entity_mentions"), conform(drift, "drift_candidates")


def once_per_section(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of what several chunks of a section repeat, the first; repeats inside one chunk stay."""
    first = rows.groupBy("section_id", *by).agg(F.min("chunk_idx").alias("_first"))
    same = [rows[c].eqNullSafe(first[c]) for c in ("section_id", *by)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return rows.join(first, cond & (rows["chunk_idx"] == first["_first"]), "left_semi")


def numbered(rows: DataFrame, name: str, parts: list[str]) -> DataFrame:
    from pyspark.sql import Window

    base = F.concat_ws(":", *(F.coalesce(F.col(p), F.lit("")) for p in parts))
    k = F.row_number().over(Window.partitionBy(*parts).orderBy("chunk_idx", "seq")) - 1
    return rows.withColumn(name, F.when(k == 0, base).otherwise(F.concat(base, F.lit("#"), k)))


def extract(w, forms: DataFrame, scorer: Callable[[], Scorer], prompt_version: str, vocab_version: str) -> dict[str, int]:
    """The whole extraction over the stored sections: cached answers are taken, the others asked for and kept
    in the cache unless they failed or were cut off, and mentions and drift candidates replace those stored,
    unless there are none. Returns counts."""
    model = scorer().model_id
    work = Workspace(w.spark)
    keyed = work.keep(with_cache_key(to_extract(w.table("sections")), prompt_version, vocab_version, model))
    hits, misses = cache_split(keyed, w.table("extraction_cache"))
    # both read the cache, which is about to change
    hits, misses = work.keep(hits), work.keep(misses)
    # equal chunks are asked for once
    once = misses.select("cache_key", "content_hash", "chunk").dropDuplicates(["cache_key"])
    asked = work.keep(ask(once, scorer))
    good = asked.where("error is null").select("cache_key", "content_hash", F.lit(prompt_version).alias("prompt_version"), F.lit(vocab_version).alias("vocab_version"), F.lit(model).alias("model_id"), "response_content", F.to_json(F.struct("finish_reason")).alias("response_metadata"), F.current_timestamp().cast("timestamp_ntz").alias("cached_at"))
    w.upsert("extraction_cache", good)
    answered = misses.join(asked.select("cache_key", "response_content", "error"), "cache_key")
    columns = ["section_id", "project_id", "source_doc", "h2_text", "chunk_idx", "response_content"]
    items = work.keep(parse_answers(hits.select(*columns, F.lit(None).cast("string").alias("error")).unionAll(answered.select(*columns, "error"))))
    said, drift = mentions_and_drift(items, forms, prompt_version, vocab_version, model)
    for name, rows in (("entity_mentions", said), ("drift_candidates", drift)):
        w.replace_if_any(name, rows)
    return {"chunks": keyed.count(), "asked": asked.count(), "failed": asked.where("error is not null").count(), "mentions": w.table("entity_mentions").count(), "drift": w.table("drift_candidates").count()}


def drift_rollup(candidates: DataFrame, new_projects: int, min_sources: int = 3, min_percent: float = 5.0) -> DataFrame:
    """One row for each kind and normal form seen in enough files or enough projects.

    Enough is the lesser of ``min_sources`` and the rounded share of the new projects, at least 1. What
    is first goes by drift_id. Aliases keep the order in which they come first.
    """
    from builtins import round as half_even

    enough = min(min_sources, max(1, int(half_even(new_projects * min_percent / 100.0))))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("drift_id")))
    rows = candidates.where("surface_form is not null")
    rolled = rows.groupBy("entity_kind", X.normal_token(F.col("surface_form")).alias("norm")).agg(
        F.min_by("surface_form", "drift_id").alias("surface_form"), F.count("*").alias("occurrence_count"), F.count_distinct("project_id").alias("project_count"), F.count_distinct(F.concat_ws("/", "project_id", "source_doc")).alias("file_count"),
        first("llm_decision").alias("llm_decision"), first("llm_proposed_canonical").alias("llm_proposed_canonical"), first("llm_notes").alias("llm_notes"),
        F.slice(F.sort_array(F.collect_set("project_id")), 1, 5).alias("sample_projects"),
    )
    return rolled.where((F.col("file_count") >= enough) | (F.col("project_count") >= enough)).orderBy(F.desc("occurrence_count"), "entity_kind", "norm")


def drift_aliases(candidates: DataFrame) -> DataFrame:
    """(entity_kind, norm, aliases): the suggested aliases of a form, each once, in order of first sight."""
    rows = candidates.where("surface_form is not null").select("entity_kind", X.normal_token(F.col("surface_form")).alias("norm"), "drift_id", F.posexplode(F.from_json("llm_suggested_aliases", "array<string>")).alias("i", "alias"))
    seen = rows.groupBy("entity_kind", "norm", "alias").agg(F.min(F.struct("drift_id", "i")).alias("at"))
    return seen.groupBy("entity_kind", "norm").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))


def drift_quotes(candidates: DataFrame, k: int = 3) -> DataFrame:
    from quillon.operators.ranking import first_k

    rows = candidates.where("surface_form is not null").select("entity_kind", X.normal_token(F.col("surface_form")).alias("norm"), "drift_id", "source_quote").distinct()
    return first_k(rows, ["entity_kind", "norm"], [F.asc("drift_id"), F.asc_nulls_last("source_quote")], k)
