"""Stateless scoring of a Structured Streaming DataFrame with a fitted pipeline.

The fitted preparation is row-local (literal expressions plus a stream-static join
for frequency maps) and the models' ``transform`` is row-local too, so the same
``predict`` plan runs on every micro-batch with no streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.pipeline import FittedPipeline


def score_stream(fitted: FittedPipeline, stream: DataFrame, keep: list[str]) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame (spark.readStream...)")
    return fitted.predict(stream, keep)


def start_scoring(fitted: FittedPipeline, stream: DataFrame, keep: list[str], sink_path: str,
                  checkpoint_location: str, trigger_seconds: int | None = None) -> StreamingQuery:
    """Append predictions to Parquet; the query's checkpoint makes restarts exactly-once."""
    writer = (score_stream(fitted, stream, keep).writeStream.format("parquet")
              .option("path", sink_path).option("checkpointLocation", checkpoint_location).outputMode("append"))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
