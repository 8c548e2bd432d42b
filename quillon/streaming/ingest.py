"""Incremental intake as a stream: new section files are folded into the warehouse as they arrive.

An addition to the batch commands, which rescan everything. Each micro-batch goes through the same
operators; a row that comes again replaces its older version, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.schemas import KEYS, SCHEMAS, conform, latest_rows
from quillon.sources.warehouse import Warehouse


def read_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_stream(stream: DataFrame, w: Warehouse, name: str, checkpoint: str) -> StreamingQuery:
    """Starts folding a stream of rows of table ``name`` into the warehouse, newest version of a key first."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        rows = conform(batch, name)
        if not rows.isEmpty():
            w.upsert(name, latest_rows(rows, KEYS[name]))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): tumbling counts with a watermark; rows later than ``late`` are left out
    of windows already closed."""
    rolled = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rolled.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events with no pause of ``gap`` or more."""
    rolled = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rolled.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
