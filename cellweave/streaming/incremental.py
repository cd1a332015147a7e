"""Resumable segmentation as a stream: shards that arrive as files are worked on once, and what is done survives a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_shards(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Work on all files in `source` that earlier calls haven't seen and append the results to `target`."""
    query = work(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
