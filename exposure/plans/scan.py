"""The leak scan from end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.operators import findings as fd
from exposure.operators.detection import hits
from exposure.operators.file_findings import file_findings
from exposure.operators.transcripts import line_tiers, string_hits, transcript_findings
from exposure.operators.json_walk import may_matter, not_json
from exposure.sources.files import home_candidates, scan_tree, scannable_tree
from exposure.sources.lines import transcript_files, transcripts
from exposure.sources.tree import unreadable


def scan_texts(texts: DataFrame) -> DataFrame:
    """Findings of a text table: one pass over the texts, one shuffle of the hits."""
    return fd.text_findings(hits(texts))


def leak_scan(
    spark: SparkSession, root: str, homes: Sequence[str] = (), private_dirs: Sequence[str] = (),
    include_excluded: bool = False, dedupe: str = "path",
) -> DataFrame:
    """Findings of a project tree and, with ``homes``, of the known places and transcripts below them."""
    project = file_findings(scan_tree(spark, root, private_dirs, include_excluded))
    if not homes:
        return project
    home_rows = spark.createDataFrame([(h,) for h in homes], "home STRING")
    deep_files = home_candidates(home_rows)
    spoken = transcript_findings(line_tiers(string_hits(transcripts(spark, list(homes)))))
    return fd.union_scopes(project, file_findings(deep_files, "deep").unionByName(spoken), dedupe)


def skipped(spark: SparkSession, root: str, homes: Sequence[str] = (), private_dirs: Sequence[str] = (), include_excluded: bool = False) -> DataFrame:
    """``reason, n``: what :func:`leak_scan` with the same arguments leaves out: files it cannot read, and transcript lines that are not JSON."""
    out = unreadable(scannable_tree(spark, root, private_dirs, include_excluded))
    if not homes:
        return out
    lines = transcripts(spark, list(homes))
    broken = lines.where(may_matter(F.col("raw")) & not_json(F.col("raw"))).agg(F.lit("not JSON").alias("reason"), F.count("*").alias("n"))
    return out.unionByName(unreadable(transcript_files(spark, list(homes)))).unionByName(broken).groupBy("reason").agg(F.sum("n").alias("n"))


def source_exposure(texts: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Tier counts and gate totals per source; sources without a leak stay, with zeros."""
    found = fd.leak_counts(scan_texts(texts), (key,))
    counts = [c for c in found.columns if c != key]
    return sources.join(found, key, "left").select(key, "texts", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts))
