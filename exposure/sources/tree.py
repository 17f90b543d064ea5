"""Walking file trees with Spark.

Spark's own file sources leave out every file and folder whose name starts with a dot, and those are
the ones that matter here. So folders are listed in tasks, one level per round, all folders of a
level in parallel; excluded folders are dropped before anyone descends. Contents are read in tasks,
for files that passed the name and size gates only.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.session import checkpoint

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRY = "path string, is_dir boolean, length long, modificationTime timestamp"
BATCH_BYTES = 64 << 20
#: Bytes of a file that one task reads the lines of, and how many it reads at once.
SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20


def _entries(folder: str) -> Iterator[tuple]:
    """What lies in a folder; a link to a folder is not followed, and a missing folder is empty."""
    if "://" in folder:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        scheme = folder.split("://", 1)[0]
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            yield f"{scheme}://{info.path}", info.type == fs.FileType.Directory, info.size or 0, info.mtime
        return
    import os

    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    if not is_dir and not entry.is_file():
                        continue
                    stat = entry.stat()
                except OSError:
                    continue
                yield entry.path, is_dir, 0 if is_dir else stat.st_size, pd.Timestamp(stat.st_mtime_ns // 1000, unit="us")
    except OSError:
        return


def _read(path: str) -> bytes | None:
    try:
        if "://" in path:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_stream(inner) as stream:
                return stream.read()
        with open(path, "rb") as handle:
            return handle.read()
    except OSError:
        return None


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "is_dir", "length", "modificationTime"]
    for batch in batches:
        rows = [entry for folder in batch["path"] for entry in _entries(folder)]
        yield pd.DataFrame(rows, columns=names)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with content, handed on whenever enough bytes have come together."""
    for batch in batches:
        held: list[dict] = []
        size = 0
        for row in batch.to_dict("records"):
            content = _read(row["path"])
            if content is None:
                continue
            held.append({**row, "content": content})
            size += len(content)
            if size >= BATCH_BYTES:
                yield pd.DataFrame(held, columns=[*batch.columns, "content"])
                held, size = [], 0
        yield pd.DataFrame(held, columns=[*batch.columns, "content"])


def _opened(path: str):
    """A file that can be read from any place on."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _is_text(handle) -> bool:
    handle.seek(0)
    return b"\0" not in handle.read(fixed.BINARY_PROBE_BYTES)


def _pieces(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a text file that begin in ``start`` to ``end``, in pieces of whole lines whose breaks are all line feeds.

    A line ends with a line feed, a carriage return or both. What follows a break that lies before ``start`` begins there; a
    line that begins before ``end`` is read to its end. An unreadable or binary file has none.
    """
    try:
        handle = _opened(path)
    except OSError:
        return
    with handle:
        if not _is_text(handle):
            return
        at = max(start - 1, 0)  # the byte before says whether a line begins at start
        handle.seek(at)
        held, skip = b"", start > 0
        while True:
            block = handle.read(READ_BYTES)
            last = not block
            held += block
            while held.endswith(b"\r") and (more := handle.read(1)):  # whether a line feed belongs to it is not known yet
                held += more
            if skip:
                breaks = [i for i in (held.find(b"\n"), held.find(b"\r")) if i >= 0]
                if not breaks:
                    if last:
                        return
                    at, held = at + len(held), b""
                    continue
                first = min(breaks) + (2 if held[min(breaks) : min(breaks) + 2] == b"\r\n" else 1)
                at, held, skip = at + first, held[first:], False
            if at >= end:
                return
            done = len(held) if last else max(held.rfind(b"\n"), held.rfind(b"\r")) + 1
            if at + done > end:  # the line that holds the last byte of the range is the last one
                stops = [i for i in (held.find(b"\n", end - 1 - at), held.find(b"\r", end - 1 - at)) if i >= 0]
                if stops:
                    done = min(stops) + (2 if held[min(stops) : min(stops) + 2] == b"\r\n" else 1)
                    last = True
            if done:
                yield held[:done].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
                at, held = at + done, held[done:]
            if last:
                return


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many lines each byte range has."""
    for batch in batches:
        found = []
        for r in batch.itertuples(index=False):
            n, tail = 0, b"\n"
            for piece in _pieces(r.path, int(r.start), int(r.end)):
                n, tail = n + piece.count(b"\n"), piece[-1:]
            found.append((r.path, r.start, n + (tail != b"\n")))
        yield pd.DataFrame(found, columns=["path", "start", "n"])


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of byte ranges, read on from the file; neither a file nor a range is in memory as a whole."""
    columns = ["path", "line_no", "raw"]
    for batch in batches:
        for r in batch.itertuples(index=False):
            line_no = int(r.before)
            for piece in _pieces(r.path, int(r.start), int(r.end)):
                lines = piece.removesuffix(b"\n").split(b"\n")
                for low in range(0, len(lines), 100_000):
                    part = [x.decode("utf-8", "replace") for x in lines[low : low + 100_000]]
                    yield pd.DataFrame({"path": r.path, "line_no": range(line_no + 1, line_no + 1 + len(part)), "raw": part}, columns=columns)
                    line_no += len(part)


def list_tree(
    spark: SparkSession, roots: Sequence[str] | DataFrame, descend: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Files below the roots: ``path, length, modificationTime``. ``descend`` judges folder names."""
    level = roots.select("path") if isinstance(roots, DataFrame) else spark.createDataFrame([(r.rstrip("/"),) for r in roots], "path string")
    tasks = spark.sparkContext.defaultParallelism
    found: DataFrame | None = None
    while True:  # links are not followed, so the levels end
        entries = checkpoint(level.repartition(tasks).mapInPandas(_list, ENTRY))
        files = entries.where("not is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        level = entries.where("is_dir").select("path")
        if descend is not None:
            level = level.where(descend(F.element_at(F.split("path", "/"), -1)))
        if level.isEmpty():
            break
    return found


def stat_files(paths: DataFrame) -> DataFrame:
    """Those of the given paths that are files, from the listing of their folders."""
    folders = paths.select(F.regexp_replace("path", r"/[^/]*\z", "").alias("path")).distinct()
    entries = folders.mapInPandas(_list, ENTRY).where("not is_dir").drop("is_dir")
    return entries.join(paths.select("path").distinct(), "path", "left_semi").select("path", "length", "modificationTime")


def read_lines(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``path, line_no, raw`` of text files of any size; binary files and those that cannot be read have no lines.

    A file is as many tasks as it has ranges of ``split_bytes``. Only longer files are read twice: first the lines of each of
    their ranges are counted, so that a range knows the number of its first line and no line is shuffled.
    """
    tasks = 4 * listing.sparkSession.sparkContext.defaultParallelism
    size = F.greatest(F.coalesce("length", F.lit(0)), F.lit(1))
    starts = F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(split_bytes).cast("bigint"))
    splits = listing.select("path", size.alias("size"), F.explode(starts).alias("start"))
    # a file may have grown since it was listed: its last range is open
    end = F.when(F.col("start") + split_bytes >= F.col("size"), F.lit(1 << 62)).otherwise(F.col("start") + split_bytes)
    splits = splits.select("path", "start", end.cast("bigint").alias("end"), (F.col("size") > split_bytes).alias("cut"))
    counts = splits.where("cut").repartition(tasks).mapInPandas(_count, "path string, start bigint, n bigint")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = checkpoint(counts.select("path", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    placed = splits.join(before, ["path", "start"], "left").select("path", "start", "end", F.coalesce("before", F.lit(0)).alias("before"))
    return placed.repartition(tasks).mapInPandas(_lines, "path string, line_no int, raw string")


def unreadable(listing: DataFrame) -> DataFrame:
    """``reason, n``: how many files a scan leaves out because they cannot be read."""
    left = listing.select("path").join(read_files(listing).select("path"), "path", "left_anti")
    return left.agg(F.lit("unreadable").alias("reason"), F.count("*").alias("n"))


def read_files(listing: DataFrame) -> DataFrame:
    """Add ``content``; files that cannot be read are left out."""
    schema = "path string, length long, modificationTime timestamp, content binary"
    return listing.select("path", "length", "modificationTime").mapInPandas(_contents, schema)
