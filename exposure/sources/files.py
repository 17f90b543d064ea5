"""File trees as tables. Only files that pass the name and size gates have their content read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.functions import names as nm
from exposure.sources.tree import list_tree, read_files, stat_files


def in_excluded_dir(path: Column, private_dirs: Sequence[str] = (), include_excluded: bool = False) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    names = tuple(private_dirs) if include_excluded else (*fixed.EXCLUDED_DIRS, *private_dirs)
    out = F.exists(dirs, lambda d: d.isin(*names)) if names else F.lit(False)
    return out if include_excluded else out | F.exists(dirs, lambda d: d.endswith(fixed.EXCLUDED_DIR_SUFFIX))


def select_files(
    files: DataFrame, root: str = "", private_dirs: Sequence[str] = (), include_excluded: bool = False
) -> DataFrame:
    """Drop files below excluded directories and build artefacts.

    ``private_dirs`` names vault folders: they stay out even when excluded directories are asked for.
    Directories above ``root`` do not count.
    """
    inner = F.substring(F.col("path"), len(root) + 1, 1 << 20)
    skipped = F.lit(False)
    for suffix in fixed.SKIPPED_SUFFIXES:
        skipped = skipped | F.col("path").endswith(suffix)
    return files.where(~in_excluded_dir(inner, private_dirs, include_excluded) & ~skipped)


def scan_tree(
    spark: SparkSession, root: str, private_dirs: Sequence[str] = (), include_excluded: bool = False
) -> DataFrame:
    """Files below ``root`` that can matter: ``path, length, modificationTime, content``.

    Excluded folders are not entered, and only files of interest are read.
    """
    return read_files(scannable_tree(spark, root, private_dirs, include_excluded))


def scannable_tree(
    spark: SparkSession, root: str, private_dirs: Sequence[str] = (), include_excluded: bool = False
) -> DataFrame:
    """The listing that :func:`scan_tree` reads."""
    out = tuple(private_dirs) if include_excluded else (*fixed.EXCLUDED_DIRS, *private_dirs)

    def descend(name: Column) -> Column:
        kept = ~name.isin(*out) if out else F.lit(True)
        return kept if include_excluded else kept & ~name.endswith(fixed.EXCLUDED_DIR_SUFFIX)

    return scannable(select_files(list_tree(spark, [root], descend), root, private_dirs, include_excluded))


def scannable(files: DataFrame) -> DataFrame:
    """Files that are sensitive by name or whose suffix says text."""
    return files.where(nm.file_kind("path").isNotNull() | nm.is_text_file("path"))


def distinct_files(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["path"])


def home_candidates(homes: DataFrame, appdata: DataFrame | None = None) -> DataFrame:
    """Contents of the files at known places below each home (``homes(home)``); missing ones are absent."""

    def places(roots: DataFrame, tails: Sequence[str]) -> DataFrame:
        root = F.rtrim(F.col(roots.columns[0]), F.lit("/"))
        return roots.select(F.explode(F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat_ws("/", root, t))).alias("path"))

    wanted = places(homes, fixed.HOME_CANDIDATES)
    if appdata is not None:
        wanted = wanted.unionByName(places(appdata, fixed.APPDATA_CANDIDATES))
    return read_files(stat_files(wanted))


def scan_candidates(files: DataFrame, homes: DataFrame, appdata: DataFrame | None = None) -> DataFrame:
    """Files at the known places below each home folder (``homes(home)``); missing ones are absent.

    A file's path either is a home and a known tail or it is not: the tail is cut off and the rest
    is looked up among the homes, an equi-join.
    """

    def below(roots: DataFrame, tails: Sequence[str]) -> DataFrame:
        hit = F.filter(F.array(*map(F.lit, tails)), lambda t: F.col("path").endswith(F.concat(F.lit("/"), t)))
        candidates = files.select("*", F.explode(hit).alias("__tail")).withColumn(
            "__home", F.left(F.col("path"), F.length("path") - F.length("__tail") - 1)
        )
        key = roots.select(F.rtrim(F.col(roots.columns[0]), F.lit("/")).alias("__home")).distinct()
        return candidates.join(key, "__home", "left_semi").select(*files.columns)

    found = below(homes, fixed.HOME_CANDIDATES)
    if appdata is not None:
        found = found.unionByName(below(appdata, fixed.APPDATA_CANDIDATES))
    return distinct_files(found)
