"""The per-document expressions on streams: they are stateless, so a stream of documents takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.operators.linguistic import scalars


def stream_scalars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scalar features of the documents that arrive as Parquet files in path."""
    return scalars(spark.readStream.schema(schema).parquet(path))
