"""Audit streams: windows, gap sessions, re-delivered and late records."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from exposure.operators.audit import audit_windows as windows

LATENESS = "10 minutes"


def watermarked(stream: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Event time needs the TIMESTAMP type; records without a zone are taken as UTC."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def audit_windows(stream: DataFrame, width: str, slide: str | None = None, by: tuple[str, ...] = (), delay: str = LATENESS) -> DataFrame:
    return windows(watermarked(stream, delay), width, slide, by)


def activity_sessions(stream: DataFrame, key: str, gap: str, delay: str = LATENESS) -> DataFrame:
    """Gap sessions; in append mode a session appears once the watermark has passed its end."""
    grouped = watermarked(stream, delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def dedup_audit(stream: DataFrame, keys: list[str], delay: str = LATENESS) -> DataFrame:
    return watermarked(stream, delay).dropDuplicatesWithinWatermark(keys)


def late_report(store: str | None = None, delay_seconds: int = 600) -> Callable[[DataFrame, int], DataFrame]:
    """For ``foreachBatch``: how many rows of a batch lie behind the newest time seen less the delay.

    Such rows are counted, and no decision changes through them. With ``store``, a folder, the newest time of every
    batch is kept there, so a report that is started again counts on; a batch that is run again sees earlier ones only.
    """
    seen: dict[str, float] = {"newest": float("-inf")}

    def before(batch: DataFrame, batch_id: int) -> float:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(store)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return float("-inf")
        row = spark.read.schema("batch_id long, newest double").parquet(store).where(F.col("batch_id") < batch_id).agg(F.max("newest").alias("newest")).first()
        return float("-inf") if row["newest"] is None else row["newest"]

    def report(batch: DataFrame, batch_id: int) -> DataFrame:
        if store is not None:
            seen["newest"] = before(batch, batch_id)
        limit = seen["newest"] - delay_seconds
        at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        out = batch.agg(
            F.lit(batch_id).alias("batch_id"), F.count("*").alias("n"),
            F.count(F.when(at < limit, 1)).alias("late"), F.max(at).alias("newest"),
        )
        row = out.first()
        if row["newest"] is not None:
            seen["newest"] = max(seen["newest"], row["newest"])
            if store is not None:
                batch.sparkSession.createDataFrame([(batch_id, row["newest"])], "batch_id long, newest double").coalesce(1).write.mode("append").parquet(store)
        return batch.sparkSession.createDataFrame([(batch_id, row["n"], row["late"])], "batch_id long, n long, late long")

    return report


def late_by_batch(stream: DataFrame, folder: str, delay_seconds: int = 600) -> DataFrame:
    """Run what is there and give ``batch_id, n, late`` of every batch. A batch that is run again overwrites its own row."""
    report = late_report(f"{folder}/newest", delay_seconds)

    def keep(batch: DataFrame, batch_id: int) -> None:
        report(batch, batch_id).coalesce(1).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")

    stream.writeStream.foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    return stream.sparkSession.read.schema("batch_id long, n long, late long").parquet(f"{folder}/late/*")


@contextmanager
def dropped_rows(spark: SparkSession) -> Iterator[dict[str, int]]:
    """Rows that the watermark drops from stateful operators of queries that run meanwhile, by query."""
    dropped: dict[str, int] = defaultdict(int)

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            dropped[str(event.progress.id)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        yield dropped
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
