"""Vocabularies: YAML files with an overlay, as a small table, and lookup by normal form."""

from __future__ import annotations

import warnings
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import normal_token, plain_markdown

SCHEMA = "vocab_name string, canonical string, aliases array<string>, rank int"


def read_entries(path: str | Path, name: str) -> list[dict]:
    """The entries of one file; anything but a list of mappings with a name gives none."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows = data.get("entries") or []
    return [{"vocab_name": name, "canonical": str(e["canonical"]), "aliases": [str(a) for a in [*(e.get("aliases") or []), *(e.get("doc_local_aliases") or [])]]} for e in rows if isinstance(e, dict) and e.get("canonical")]


def overlaid(shipped: list[dict], local: list[dict]) -> list[dict]:
    """A local entry of the same name adds its aliases; a new one comes after the shipped ones."""
    out = {e["canonical"]: {**e, "aliases": list(e["aliases"])} for e in reversed(shipped)}
    out = dict(reversed(out.items()))
    for e in local:
        have = out.setdefault(e["canonical"], {**e, "aliases": []})
        have["aliases"] += [a for a in e["aliases"] if a not in have["aliases"]]
    return list(out.values())


def load_vocab(spark: SparkSession, shipped: str | Path, name: str, local: str | Path | None = None) -> DataFrame:
    """(vocab_name, canonical, aliases, rank). A broken overlay is warned of and left out."""
    entries = read_entries(shipped, name)
    if local and Path(local).exists():
        try:
            entries = overlaid(entries, read_entries(local, name))
        except (OSError, yaml.YAMLError, AttributeError) as e:
            warnings.warn(f"the overlay {local} can't be read: {e}", stacklevel=2)
    return spark.createDataFrame([(e["vocab_name"], e["canonical"], e["aliases"], i) for i, e in enumerate(entries)], SCHEMA)


def lookup(vocab: DataFrame, kind_col: str = "vocab_name", rank_col: str = "rank") -> DataFrame:
    """(kind, norm, canonical): one row for each normal form of a name or alias; the first entry wins."""
    forms = vocab.select(F.col(kind_col).alias("kind"), "canonical", F.col(rank_col).alias("rank"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("form"))
    return forms.select("kind", normal_token(plain_markdown(F.col("form"))).alias("norm"), "canonical", "rank").where("norm <> ''").groupBy("kind", "norm").agg(F.min_by("canonical", F.struct("rank", "canonical")).alias("canonical"))


def canonicalise(df: DataFrame, kind_col: str, text_cols: list[str], forms: DataFrame) -> DataFrame:
    """``df`` with ``canonical_match``: the entry that the first of the texts names, else the next; null if none.

    The forms are joined, not collected; Spark broadcasts them while they are small."""
    out = df
    for i, c in enumerate(text_cols):
        known = forms.select(F.col("kind").alias(f"_k{i}"), F.col("norm").alias(f"_n{i}"), F.col("canonical").alias(f"_c{i}"))
        out = out.join(known, (F.col(kind_col) == F.col(f"_k{i}")) & (normal_token(plain_markdown(F.col(c))) == F.col(f"_n{i}")), "left")
    return out.withColumn("canonical_match", F.coalesce(*(F.col(f"_c{i}") for i in range(len(text_cols))))).select(*df.columns, "canonical_match")


def read_match_rules(folder: str | Path, name: str = "_match_rules.v1.yaml") -> dict:
    """The rules file of a vocabulary folder, a mapping. Its absence is an error. Lookup doesn't depend on it."""
    rules = yaml.safe_load((Path(folder) / name).read_text(encoding="utf-8"))
    if not isinstance(rules, dict):
        raise ValueError(f"{name} is no mapping")
    return rules
