"""Streams: late rows of a stream of vectors or events are placed on a finished topic map, and counted in event-time windows.

The batch operators are used as they are inside ``foreachBatch``; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.operators.search import assign


def distinct_within(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows by window and key; windows are final once the watermark has passed them."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def assign_stream(stream: DataFrame, centroids: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends (id, topic, sim, second, margin) of each micro-batch (id, vec) to ``path``, once for each batch."""

    def place(batch: DataFrame, number: int) -> None:
        assign(batch.select("id", "vec"), centroids).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
