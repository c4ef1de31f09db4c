"""Change feeds as streams.

A stream of changes (batch, card_id, field, all) is coalesced by micro-batch and
appended to a table; a batch that comes again after a restart replaces what it
wrote before, so each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upkeep import changed


def coalesce_changes(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Writes one row for each card of a micro-batch (card_id, fields, all), under to/micro=n; ends when what is there is read."""

    def write(rows: DataFrame, n: int) -> None:
        once = rows.groupBy("card_id").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.max("all").alias("all"))
        once.write.mode("overwrite").parquet(f"{to}/micro={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_changes(stream: DataFrame, known: str, to: str, checkpoint: str) -> StreamingQuery:
    """Writes the keys of each micro-batch (key, hash) whose hash differs from the one in the table known."""

    def write(rows: DataFrame, n: int) -> None:
        latest = rows.dropDuplicates(["key", "hash"])
        new = changed(latest, rows.sparkSession.read.parquet(known).join(latest.select("key"), "key", "left_semi"))
        new.write.mode("overwrite").parquet(f"{to}/micro={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """kind, window start and n of events (ts, event_type), those later than the watermark left out."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n")
