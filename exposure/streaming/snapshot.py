"""Change-driven reload of sources from a stream of file versions.

The store is a log of changes: each batch appends one row for every source that changed, went away or came back, and nothing
for the rest. The newest row of a source is its last good version; what could not be read leaves no row. Every so many batches
the newest rows are written together as a base, so that reading does not grow with the age of the log; a base counts once it is
complete, and what it replaces is deleted only then. A batch that is run again after a failure reads what was before it and
overwrites its own rows, so it ends in the same store.

Contents are compressed where they are read and stay so until they are asked for: a batch moves each once, packed. Reading moves
keys, and of contents only those that a later change may have replaced; those of the newest change lie where they are read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ``content`` has what an older store wrote unpacked.
ROWS = "source string, batch long, fingerprint string, gone boolean, content binary, packed binary"
COMPACT_EVERY = 32
CODEC, SIZE = "zstd", 8


def _each(change: Callable[[bytes], bytes], values: pa.Array) -> pa.Array:
    return pa.array((None if not v.is_valid else change(v.as_py()) for v in values), pa.binary())


@F.arrow_udf(BinaryType())
def _pack(values: pa.Array) -> pa.Array:
    codec = pa.Codec(CODEC)
    return _each(lambda v: len(v).to_bytes(SIZE, "little") + codec.compress(v, asbytes=True), values)


@F.arrow_udf(BinaryType())
def _unpack(values: pa.Array) -> pa.Array:
    codec = pa.Codec(CODEC)
    return _each(lambda v: codec.decompress(v[SIZE:], int.from_bytes(v[:SIZE], "little"), asbytes=True), values)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, folder: str) -> dict[int, str]:
    """Numbered folders that were written to their end."""
    at, fs = _files(spark, folder)
    if not fs.exists(at):
        return {}
    found = {int(s.getPath().getName()): s.getPath().toString() for s in fs.listStatus(at)}
    return {n: path for n, path in found.items() if fs.exists(_files(spark, f"{path}/_SUCCESS")[0])}


def _paths(spark: SparkSession, store: str, before: int | None) -> list[str]:
    """The newest base and the changes since, oldest first: a few rows for each source."""
    bases = {n: p for n, p in _complete(spark, f"{store}/base").items() if before is None or n < before}
    base = max(bases, default=-1)
    changes = {n: p for n, p in _complete(spark, f"{store}/changes").items() if n > base and (before is None or n < before)}
    return [*([bases[base]] if bases else []), *(changes[n] for n in sorted(changes))]


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)


def _newest(spark: SparkSession, store: str, before: int | None) -> DataFrame:
    """The newest row of every source that is there.

    A row of the newest folder is it wherever it lies. One of an older folder is it unless a later folder has the source.
    """
    paths = _paths(spark, store, before)
    last = _rows(spark, paths[1:]).groupBy("source").agg(F.max("batch").alias("last"))
    older = _rows(spark, paths[:-1]).join(last.hint("shuffle_hash"), "source", "left").where("last is null or batch = last").drop("last")
    return older.unionByName(_rows(spark, paths[-1:])).where("not gone")


def current(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """``source, fingerprint, content`` of every source that is there: its last good version."""
    return _newest(spark, store, before).select("source", "fingerprint", F.coalesce("content", _unpack("packed")).alias("content"))


def _fingerprints(spark: SparkSession, store: str, before: int) -> DataFrame:
    """What is known of each source, without reading any content."""
    newest = _rows(spark, _paths(spark, store, before)).groupBy("source").agg(F.max_by(F.struct("fingerprint", "gone"), "batch").alias("r"))
    return newest.select("source", F.when(~F.col("r.gone"), F.col("r.fingerprint")).alias("known"))


def upsert(store: str, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append what changed to ``store``.

    A batch has ``source, content, modified`` and may have ``gone``; of several versions of a source the newest counts, of those
    of one time the one with the larger fingerprint. A null content cannot be read and keeps the last good version; ``gone``
    removes the source.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        body = F.col("content").cast("binary")
        gone = F.coalesce("gone", F.lit(False)) if "gone" in batch.columns else F.lit(False)
        seen = batch.select("source", "modified", gone.alias("gone"), F.when(~gone, body).alias("content")).where("gone or content is not null")
        version = F.struct("modified", "gone", F.concat_ws(":", F.octet_length("content"), F.sha2("content", 256)).alias("fingerprint"), _pack("content").alias("packed"))
        now = seen.select("source", version.alias("v")).groupBy("source").agg(F.max("v").alias("v")).select("source", "v.gone", "v.fingerprint", "v.packed")
        known = _fingerprints(spark, store, batch_id)
        new = F.when(~F.col("gone"), F.col("fingerprint"))
        changed = now.join(known, "source", "left").where(~new.eqNullSafe(F.col("known")))
        changed.select("source", F.lit(batch_id).cast("long").alias("batch"), "fingerprint", "gone", "packed").write.mode("overwrite").parquet(f"{store}/changes/{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(spark, store, batch_id)

    return apply


def compact(spark: SparkSession, store: str, upto: int) -> None:
    """The newest row of every source that is there as one base; older bases and the changes in it go when it is complete."""
    if upto not in _complete(spark, f"{store}/base"):  # else the batch was run again behind its base, which is what would be written from
        rows = _newest(spark, store, upto + 1).select("source", F.lit(upto).cast("long").alias("batch"), "fingerprint", "gone", "content", "packed")
        rows.write.mode("overwrite").parquet(f"{store}/base/{upto}")
    for kind, last in (("base", upto - 1), ("changes", upto)):
        for n, path in _complete(spark, f"{store}/{kind}").items():
            if n <= last:
                at, fs = _files(spark, path)
                fs.delete(at, True)
