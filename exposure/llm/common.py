"""What the operators of this package share: reading, intermediate tables, Arrow batches, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it (tests on one machine); a cluster raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's own setting: shuffle files of a finished query go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this block, a finished query's shuffle files go at once."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: this cuts the lineage, a lost executor costs nothing before it, and the shuffles behind it are no longer needed."""
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """``write`` to a place of its own in the shared folder."""
    return write(df, own_path(df.sparkSession, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables that are deleted together, once what was made from them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(own_path(self.spark, name))
        return write(df, self.paths[-1])

    def drop(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())


#: A filter of ids has so many bits: 2 MB, however many ids it stands for. Where it fills up it lets more through, and the join behind it still decides.
FILTER_BITS = 24


def likely(rows: DataFrame, wanted: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``column`` has the bit of one in ``wanted``: all that are among them and few others. The table of bits is broadcast, of a size that ``bits`` alone fixes.

    It is looked up in the JVM: a Python function here would be a second Python worker beside the one of the step behind it, in every task.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    ones = wanted.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = ones.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set"))
    held = F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)), "set")))
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(held.alias("held"))
    blocks = blocks.select("block", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")), lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("bigint"))).alias("words"))
    word = F.get("words", F.shiftright(at, 6).bitwiseAND(F.lit(63)).cast("int"))
    return rows.join(F.broadcast(blocks), (F.shiftright(at, 12) == F.col("block")) & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1), "left_semi")


def with_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among the ``id`` of ``wanted``. Most others are left out where they are read, so their texts are never shuffled."""
    ids = wanted.select("id").distinct()
    return likely(rows, ids, "id").join(ids, "id")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that what is made of one part is small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` alone, a null text as the empty one. Other columns are not read, so their names cannot clash."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def one_row_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``chosen`` (``id`` and one other column, each id once) whose id is in docs, and ``text``: of several rows of an id the text of the smallest hash.

    Rows of an id are brought down to one where they are read, so one that holds much of the table stays spread out.
    """
    (other,) = [c for c in chosen.columns if c != "id"]
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    return rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first(other).alias(other))


def where_text(docs: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows, with all their columns, whose text (a null one as the empty one) ``keep`` says yes to. No shuffle and no join, so repeated rows and ids are no matter."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(keep([t or "" for t in b.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class Cache(dict):
    """A dictionary filled by ``make(missing keys)``; emptied beyond ``most`` entries, which changes no result."""

    def __init__(self, make: Callable[[object], object], most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
