"""Session settings and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "exposure", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session is given."""
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on shared storage, so that a lost executor costs no recomputation.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and the master
    is local (tests on one machine) is a temporary folder made.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder on shared storage, for tables and streams that one job writes and reads again."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """A checkpoint as a Parquet table: of what is read later, only the columns and rows asked for are."""
    path = own_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work one task per core where the scan has fewer splits than that.

    A few small files make few tasks. At scale a scan has more splits than cores, and the rows
    stay where they are read: no shuffle. Call it on a plain scan only.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
