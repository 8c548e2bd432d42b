"""Ranks and caps for what a model proposes, and first-k samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SO_WHAT = ["expected_at_bringup", "watch_for_change", "action_indicated"]  # fixed value


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; a full order makes it definite."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def rank_recommendations(raw: DataFrame, most: int = 8, most_high: int = 3) -> DataFrame:
    """High before medium before low, within them by title; further highs become medium; cut at ``most``.

    A priority that is none of the three is medium. Plausibility is clamped to 0..1, 0.5 when null.
    Rows without a title are left out. The order of the first ``most`` is found by top-k, not a full sort.
    """
    low = F.lower(F.coalesce("priority", F.lit("medium")))
    rank = F.when(low == "high", 0).when(low == "low", 2).otherwise(1)
    best = raw.where("title <> ''").select("*", rank.alias("_r")).orderBy("_r", "title").limit(most)
    w = Window.orderBy("_r", "title")
    placed = best.withColumn("rec_index", F.row_number().over(w) - 1)
    named = F.when((F.col("_r") == 0) & (F.col("rec_index") < most_high), "high").when(F.col("_r") == 2, "low").otherwise("medium")
    return placed.withColumn("priority", named).withColumn("plausibility", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("plausibility", F.lit(0.5))))).drop("_r")


def rank_findings(raw: DataFrame, most: int = 5) -> DataFrame:
    """By falling confidence, clamped to 0..1, then by claim; cut at ``most``; an unknown tag becomes watch_for_change."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    best = raw.where("claim <> ''").withColumn("confidence", sure).orderBy(F.desc("confidence"), "claim").limit(most)
    tag = F.when(F.col("so_what").isin(SO_WHAT), F.col("so_what")).otherwise("watch_for_change")
    return best.withColumn("finding_index", F.row_number().over(Window.orderBy(F.desc("confidence"), "claim")) - 1).withColumn("so_what", tag)
