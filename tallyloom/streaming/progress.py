"""Step results as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.steps import RETENTION


def latest_step_results(results: DataFrame, order: list[str]) -> DataFrame:
    """Latest status per window, project and step, one window per retention period.

    ``ts`` must be a TIMESTAMP. The retention period is the watermark too: a result that arrives
    when it would have expired no longer counts. Works on batches alike, where the watermark has
    no effect and every window is given.
    """
    latest = (
        results.withWatermark("ts", RETENTION)
        .groupBy(F.window("ts", RETENTION).alias("window"), "project_id", "step")
        .agg(F.max_by("status", F.struct(*order)).alias("status"), F.max("ts").alias("ts")))
    return latest.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "project_id", "step", "status", "ts")


def write_stream(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to parquet until the input at hand is used up."""
    return (frame.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
