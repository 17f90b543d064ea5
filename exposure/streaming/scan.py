"""Streaming scan: stateless, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from exposure.operators.detection import hits
from exposure.operators.transcripts import string_hits
from exposure.sources.texts import texts


def scan_stream(spark: SparkSession, path: str, schema: str, src: str, id_col: str, text_col: str) -> DataFrame:
    """Hits of new rows of a Parquet folder."""
    rows = spark.readStream.schema(schema).parquet(path)
    return hits(texts(rows, src, id_col, text_col))


def transcript_stream(lines: DataFrame) -> DataFrame:
    """Hits of new transcript lines ``path, line_no, raw``."""
    return string_hits(lines)


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; results are appended to a Parquet folder."""
    df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", checkpoint
    ).start(out).awaitTermination()
