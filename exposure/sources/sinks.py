"""Sinks. Nothing leaves that could hold a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from exposure.operators.inventory import sorted_names
from exposure.schemas import assert_public


def write_findings(findings: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    assert_public(findings).write.mode(mode).format(fmt).save(path)


def write_batch(findings: DataFrame, path: str, batch_id: int) -> None:
    """For ``foreachBatch``: the findings of a batch as JSON, once, however often the batch is run: a second run takes the place of the first."""
    assert_public(findings).write.mode("overwrite").json(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Findings of all batches as they were written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Counts for all gates, the headline and the note, as one JSON record."""
    from pyspark.sql import functions as F

    note = F.concat(
        F.lit("Heuristic; leak_count is that of gate "), "strict", F.lit(". No values."),
    )
    assert_public(summary).withColumn("detection_note", note).coalesce(1).write.mode(mode).json(path)


def write_names(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Distinct names per scope in order, as JSON lines ``scope, name``."""
    by = ("scope",) if "scope" in df.columns else ()
    sorted_names(df, by).write.mode(mode).json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """Manifest rows appended to a manifest table."""
    rows.write.mode("append").parquet(path)
