"""The queries of this subpackage, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import components, mapping, names, normal, packing, setjoin, split, tokens
from quillon.session import Workspace, table

THRESHOLD = "0.6"
CONTAINER = 2048
LENGTHS = [256, 512, 1024, CONTAINER]
PROPOSED = "proposed:"


def _project_sets(spark: SparkSession, sf: str) -> setjoin.SetJoin:
    return setjoin.similar_sets(table(spark, sf, "entity_mentions"), "project_id", "canonical_id", THRESHOLD)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _project_sets(spark, sf).pairs().select(F.col("id_a").alias("project_id_a"), F.col("id_b").alias("project_id_b"))


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each project with a value: the class of the projects with the same set, by its least id, and the number of its links."""
    return _project_sets(spark, sf).links().select(F.col("id").alias("project_id"), "class_id", "n_links")


def _typed_values(spark: SparkSession, sf: str) -> DataFrame:
    """(record_table, record_id, kind, text): each text that may name an entry."""
    drift = table(spark, sf, "drift_candidates")
    typed = drift.select(F.lit("drift_candidates").alias("record_table"), F.col("drift_id").alias("record_id"), F.col("entity_kind").alias("kind"), F.explode(F.array("surface_form", "llm_proposed_canonical")).alias("text"))
    mentions = table(spark, sf, "entity_mentions").where(F.col("canonical_id").startswith(PROPOSED))
    said = mentions.select(F.lit("entity_mentions").alias("record_table"), F.col("mention_id").alias("record_id"), F.col("entity_kind").alias("kind"), F.substring("canonical_id", len(PROPOSED) + 1, 1 << 30).alias("text"))
    return typed.unionAll(said).where("record_id is not null")


def _mapped(spark: SparkSession, sf: str, how: str) -> DataFrame:
    values = _typed_values(spark, sf)
    named = mapping.best_entries(mapping.match_texts(values, "kind", "text", table(spark, sf, "vocab_entries")))
    hits = values.join(named, ["kind", "text"], how)
    return hits.groupBy("record_table", "record_id").agg(F.min(F.when(F.col("entry_id").isNotNull(), F.struct("distance", "entry_id"))).alias("best"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf, "inner").select("record_table", "record_id", F.col("best.entry_id").alias("entry_id"))


def p2_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with the entry it names; the unmatched ones are reported with a null entry."""
    return _mapped(spark, sf, "left").select("record_table", "record_id", F.col("best.entry_id").alias("entry_id"), F.col("best.distance").alias("distance"), F.when(F.col("best").isNull(), "unmatched").otherwise("matched").alias("status"))


def p2_near(spark: SparkSession, sf: str) -> DataFrame:
    """All entries within the allowed distance of each distinct text in plain words, by listed names and aliases alone."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", " "))
    values = _typed_values(spark, sf).where("text is not null").select("kind", words("text").alias("words")).distinct()
    listed = table(spark, sf, "vocab_entries").select("entry_id", "entity_kind", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).where("form <> ''")
    return mapping.near_forms(values, "kind", "words", listed.select("entry_id", F.col("entity_kind").alias("kind"), words("form").alias("form")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split.split_oversized(table(spark, sf, "chunks"), "content", ["section_id", "chunk_idx"], only_oversized=True)
    return pieces.where("piece_idx = 0").select("section_id", "chunk_idx").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of the oversized rows; repeats of a row give its pieces once."""
    rows = table(spark, sf, "chunks").select("section_id", F.col("chunk_idx").alias("source_idx"), "content").where(F.char_length("content") > split.LIMIT).distinct()
    pieces = split.split_oversized(rows, "content", ["section_id", "source_idx"], only_oversized=True)
    return pieces.select("section_id", "source_idx", F.col("piece_idx").alias("chunk_idx"), F.col("total_pieces").alias("total_chunks"), "overlap_chars", F.col("piece").alias("content"))


def p3_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each oversized row put together again, without their overlaps."""
    pieces = p3_pieces(spark, sf).withColumn("source", F.struct("section_id", "source_idx", "total_chunks"))
    body = F.sort_array(F.collect_list(F.struct("chunk_idx", "overlap_chars", "content")))
    whole = pieces.groupBy("section_id", "source_idx", "total_chunks").agg(body.alias("p"), F.max(F.char_length("content")).alias("longest"))
    text = F.array_join(F.transform("p", lambda x: F.substring(x["content"], x["overlap_chars"] + 1, F.lit(1 << 30))), "")
    tail = lambda x: F.substring(x["content"], F.char_length(x["content"]) - 199, F.lit(200))
    right = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.substring(F.get("p", i)["content"], 1, 200) == tail(F.get("p", i - 1)))
    return whole.select("section_id", "source_idx", F.sha2(text, 256).alias("digest"), F.char_length(text).alias("characters"), (F.col("longest") <= split.LIMIT).alias("within_limit"), right.alias("overlaps_right"), (F.transform("p", lambda x: x["chunk_idx"]) == F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("numbered"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.connected_groups(table(spark, sf, "reuse_edges"), "src_project_id", "dst_project_id").select(F.col("node").alias("project_id"), "group_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = names.name_pairs(table(spark, sf, "authors"), "author_id", "canonical_name", "affiliation", "orcid_id")
    return pairs.select(F.col("id_a").alias("author_id_a"), F.col("id_b").alias("author_id_b"))


def p5_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Each author_id with a name, its person by the least id, and how many ids the person has."""
    people = names.link_names(table(spark, sf, "authors"), "author_id", "canonical_name", "affiliation", "orcid_id")
    size = people.groupBy("person").agg(F.count("*").alias("n_ids"))
    return people.join(size, "person").select(F.col("id").alias("author_id"), "person", "n_ids")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf, "documents"), "text", ["doc_id"])


def _packed(spark: SparkSession, sf: str, bin_cost: float) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, sf, "documents"), "text", ["doc_id"])
    placed = packing.pack_items(sizes, "doc_id", "n_tokens", LENGTHS, bin_cost)
    return placed.select(F.col("id").alias("doc_id"), "piece", F.col("first").alias("first_token"), F.col("length").alias("n_tokens"), "bin_id", "bin_capacity", "bin_offset")


def p7_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 2,048; every container costs as much as it holds, so few and full ones are opened,
    and a container with room to spare ends at a smaller permitted length."""
    return _packed(spark, sf, CONTAINER)


def p7_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The permitted lengths 256 to 2,048 with the cost of their length alone: least unused space in all."""
    return _packed(spark, sf, 0)


def p7_characters(spark: SparkSession, sf: str) -> DataFrame:
    """For each document, sized in characters and packed into containers of 8,192: how many pieces it has, how
    many characters they have together, and how many of its pieces overlap another or pass their container's end."""
    sizes = table(spark, sf, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")).where("n > 0")
    placed = Workspace(spark).keep(packing.pack_items(sizes, "doc_id", "n", [1024, 2048, 4096, 8192]))
    after = F.lead("bin_offset", 1).over(Window.partitionBy("bin_id").orderBy("bin_offset", "id"))
    end = F.col("bin_offset") + F.col("length")
    judged = placed.withColumn("wrong", (end > F.coalesce(after, F.col("bin_capacity"))) | (end > F.col("bin_capacity")))
    return judged.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("pieces"), F.sum("length").alias("characters"), F.count_if("wrong").alias("wrong_places"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return normal.same_look_pairs(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with something visible: its class of look by the least doc_id, and of how many documents and different texts."""
    return normal.look_classes(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "class_id", "n_members", "n_texts")


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with its text in the consistent form."""
    return normal.normalise_texts(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "norm_text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_mapped, p2_near, p3_found, p3_pieces, p3_joined, p4_found, p5_found, p5_persons, p6_ids, p7_bins, p7_lengths, p7_characters, p8_found, p8_classes, p8_forms)}


# the plain words of a text: lower case, ASCII letters and digits
_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
SQL = {
    "p1_found": """
        WITH m AS (SELECT DISTINCT project_id p, canonical_id t FROM entity_mentions WHERE project_id IS NOT NULL AND canonical_id IS NOT NULL),
             s AS (SELECT p, count(*) n FROM m GROUP BY p),
             k AS (SELECT a.p pa, b.p pb, count(*) k FROM m a JOIN m b ON a.t = b.t AND a.p < b.p GROUP BY 1, 2)
        SELECT pa AS project_id_a, pb AS project_id_b FROM k JOIN s sa ON sa.p = pa JOIN s sb ON sb.p = pb WHERE 25 * k * k >= 9 * sa.n * sb.n""",
    "p1_links": """
        WITH m AS (SELECT DISTINCT project_id p, canonical_id t FROM entity_mentions WHERE project_id IS NOT NULL AND canonical_id IS NOT NULL),
             s AS (SELECT p, count(*) n, list(t ORDER BY t) held FROM m GROUP BY p),
             k AS (SELECT a.p pa, b.p pb, count(*) k FROM m a JOIN m b ON a.t = b.t AND a.p <> b.p GROUP BY 1, 2),
             l AS (SELECT pa, count(*) n FROM k JOIN s sa ON sa.p = pa JOIN s sb ON sb.p = pb WHERE 25 * k * k >= 9 * sa.n * sb.n GROUP BY pa)
        SELECT s.p AS project_id, min(s.p) OVER (PARTITION BY held) AS class_id, coalesce(l.n, 0) AS n_links FROM s LEFT JOIN l ON l.pa = s.p""",
    "p2_near": f"""
        WITH v AS (SELECT entity_kind kind, surface_form t FROM drift_candidates UNION SELECT entity_kind, llm_proposed_canonical FROM drift_candidates UNION SELECT entity_kind, substr(canonical_id, 10) FROM entity_mentions WHERE starts_with(canonical_id, 'proposed:')),
             q AS (SELECT DISTINCT kind, {_PLAIN.format('t')} w FROM v WHERE kind IS NOT NULL AND t IS NOT NULL),
             f AS (SELECT DISTINCT entry_id, entity_kind kind, {_PLAIN.format('form')} w FROM (SELECT entry_id, entity_kind, unnest(list_prepend(canonical, coalesce(aliases, []))) form FROM vocab_entries) WHERE form <> '')
        SELECT q.kind, q.w AS words, entry_id, min(damerau_levenshtein(q.w, f.w))::INTEGER AS distance FROM q JOIN f ON q.kind = f.kind AND abs(length(q.w) - length(f.w)) <= 2
        WHERE q.w <> '' AND f.w <> '' AND damerau_levenshtein(q.w, f.w) <= CASE WHEN length(q.w) < 5 THEN 0 WHEN length(q.w) < 9 THEN 1 ELSE 2 END GROUP BY ALL""",
    "p3_joined": """
        SELECT DISTINCT section_id, chunk_idx AS source_idx, sha256(content) AS digest, length(content) AS characters, TRUE AS within_limit, TRUE AS overlaps_right, TRUE AS numbered FROM chunks WHERE length(content) > 12000""",
    "p3_found": "SELECT DISTINCT section_id, chunk_idx FROM chunks WHERE length(content) > 12000",
    "p7_characters": "SELECT doc_id, (length(text) + 8191) // 8192 AS pieces, length(text) AS characters, 0 AS wrong_places FROM documents WHERE length(text) > 0",
    "p4_found": """
        WITH RECURSIVE e AS (SELECT DISTINCT src_project_id s, dst_project_id d FROM reuse_edges WHERE src_project_id IS NOT NULL AND dst_project_id IS NOT NULL),
             b AS (SELECT s x, d y FROM e UNION SELECT d, s FROM e UNION SELECT s, s FROM e UNION SELECT d, d FROM e),
             r AS (SELECT x AS node, min(y) AS low, 0 AS step FROM b GROUP BY x
                   UNION ALL
                   (SELECT n.x, min(r.low), any_value(r.step) + 1 FROM r JOIN b n ON n.y = r.node WHERE r.step < 40 GROUP BY n.x))
        SELECT node AS project_id, min(low) AS group_id FROM r GROUP BY node""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
