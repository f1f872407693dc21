"""Bars of an unbounded stream of events; an extension, as batch results need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streaming_bars(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours", symbol: str = "event_type", value: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Bars of a stream with a timestamp column; events later than ``lateness`` are left out, and a bar is final after it."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).where(F.col(value) > 0)
    order = F.struct(ts, tie)
    bars = own.groupBy(F.window(ts, width).alias("_w"), F.col(symbol).alias("symbol")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append final bars to a parquet folder."""
    out = bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
