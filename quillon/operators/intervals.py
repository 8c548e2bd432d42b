"""Laying out overlapping intervals in as few rows as possible."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def colour(starts: list, ends: list) -> list[int]:
    """The row of each interval: the lowest that is free when it starts; touching intervals overlap."""
    order = sorted(range(len(starts)), key=lambda i: (starts[i], ends[i], i))
    rows, free, busy = [0] * len(starts), [], []
    for i in order:
        while busy and busy[0][0] < starts[i]:
            heapq.heappush(free, heapq.heappop(busy)[1])
        row = heapq.heappop(free) if free else len(busy)
        rows[i] = row
        heapq.heappush(busy, (ends[i], row))
    return rows


def sub_rows(bars: DataFrame, group: str, item: str) -> DataFrame:
    """``bars`` (group, item, start, end) with sub_row; one group is one author's projects."""
    schema = bars.select(group, item, "start", "end").schema

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", item]).reset_index(drop=True)
        pdf["sub_row"] = colour(pdf["start"].tolist(), pdf["end"].tolist())
        return pdf

    return bars.select(group, item, "start", "end").groupBy(group).applyInPandas(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", sub_row int")


def row_blocks(placed: DataFrame, group: str) -> DataFrame:
    """(group, height, offset): how many rows each group needs and where its block begins, groups in
    name order. The groups are the few that a chart shows."""
    from pyspark.sql import Window

    heights = placed.groupBy(group).agg((F.max("sub_row") + 1).alias("height"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return heights.select(group, "height", F.coalesce(F.sum("height").over(before), F.lit(0)).alias("offset"))
