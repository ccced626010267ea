"""Model-call metrics per day over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_metrics(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Calls, latency sum over calls that have one, and tokens per (day, model).

    State is one row per open day and model; days close once the watermark has passed.
    Works on a batch frame too, where the watermark has no effect.
    """
    return (
        log.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("_w"), "model")
        .agg(
            F.count(F.lit(1)).alias("count"), F.sum("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("latency_count"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"),
        )
        .select(F.date_format("_w.start", "yyyy-MM-dd").alias("day"), "model", "count", "latency_sum", "latency_count",
                "input_tokens", "output_tokens")
    )


def append_log(events: DataFrame, path: str) -> None:
    """Append model-call rows to the log."""
    events.write.mode("append").parquet(path)


def stream_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of model calls to the log."""
    return (
        events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
