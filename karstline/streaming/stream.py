"""Projections and filters keep no state, so they run on Structured Streaming as they are."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from karstline.errors import InvalidInput
from karstline.plans.table import Table
from karstline.plans.types import Schema


def read_stream(spark: SparkSession, path: str, schema: Schema) -> Table:
    """Parquet files as they arrive, under a declared schema."""
    return Table.of(spark.readStream.schema(schema.to_spark()).parquet(path), schema)


def start(table: Table, sink: str, checkpoint: str, *, fmt: str = "parquet") -> StreamingQuery:
    """Appends a streaming table to a sink; restarts go on from the checkpoint."""
    if not table.frame.isStreaming:
        raise InvalidInput("the table isn't a stream")
    return table.to_df().writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").start(sink)
