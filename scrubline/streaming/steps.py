"""Fitted steps on streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from scrubline.operators.steps import Fitted
from scrubline.session import shared_path


def transform_stream(stream: DataFrame, steps: Sequence[Fitted]) -> DataFrame:
    """Apply steps fitted on a batch to a stream, in order."""
    for step in steps:
        stream = step.transform(stream)
    return stream


def deduplicate_stream(stream: DataFrame, time_column: str, delay: str, subset: Sequence[str]) -> DataFrame:
    """Keep the first copy that arrives; state is dropped once the watermark passes it."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(subset))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available, into files of the shared folder, and read them."""
    spark = stream.sparkSession
    out, state = shared_path(spark, label), shared_path(spark, f"{label}-state")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
