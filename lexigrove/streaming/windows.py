"""Windowed aggregation of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, ts: str, aggs: list[Column], every: str, period: str | None = None, by: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """Aggregates by window for a batch or a stream; on a stream, events later than ``late`` are left out."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    window = F.window(ts, period, every) if period else F.window(ts, every)
    return rows.groupBy(window.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[c for c in _names(aggs)])


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[1].strip("`") for a in aggs]


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's finished windows to files, once each."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
