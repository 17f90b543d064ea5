"""Inventories: what a project declares, what it has, and what comes in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_status(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """Each declared name as present, missing or optional-absent: ``project, name, required, status``.

    Rows, so a project of any size is spread. ``names`` has ``project, name``.
    """
    have = names.select("project", "name").distinct().withColumn("__have", F.lit(True))
    have_it = F.col("__have").isNotNull()
    status = (
        F.when(F.col("required") & have_it, "present")
        .when(F.col("required"), "missing")
        .when(~have_it, "optional_absent")
        .otherwise("optional_present")
    )
    return manifest.join(have, ["project", "name"], "left").select("project", "name", "required", status.alias("status"))


def manifest_summary(
    projects: DataFrame, status: DataFrame, errors: DataFrame | None = None, more: Sequence[Column] = (), added: Sequence[str] = ()
) -> DataFrame:
    """One row per project with counts and ``ok``. No manifest is ok; a broken one is not. ``more`` are further aggregates, named ``added``."""

    def n(what: str) -> Column:
        return F.count(F.when(F.col("status") == what, 1))

    counted = status.groupBy("project").agg(
        F.count(F.when(F.col("required"), 1)).alias("required"), n("present").alias("present"),
        n("missing").alias("missing"), n("optional_absent").alias("optional_absent"), *(c.alias(a) for c, a in zip(more, added)),
    )
    out = projects.select("project").distinct().join(counted, "project", "left")
    out = out.join(errors.select("project", "error"), "project", "left") if errors is not None else out.withColumn(
        "error", F.lit(None).cast("string")
    )
    failed = F.col("error").isNotNull()
    counts = [F.when(failed, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
              for c in ("required", "present", "missing", "optional_absent")]
    return out.select("project", (~failed & (F.coalesce("missing", F.lit(0)) == 0)).alias("ok"), *counts, "error", *added)


def manifest_check(
    projects: DataFrame, manifest: DataFrame, names: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """Summary with sorted name arrays, which the manifest of a project bounds: it is one file."""
    listed = ("present", "missing", "optional_absent")
    arrays = [F.array_sort(F.collect_list(F.when(F.col("status") == what, F.col("name")))) for what in listed]
    return manifest_summary(projects, manifest_status(manifest, names), errors, arrays, [f"{what}_names" for what in listed])


def preflight(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Requests with the number of missing required names of their project; any blocks the request."""
    missing = status.where("status = 'missing'").groupBy("project").agg(F.count("*").alias("n_missing"))
    n = F.coalesce("n_missing", F.lit(0)).cast("bigint")
    return requests.join(missing, "project", "left").select(
        *requests.columns, n.alias("n_missing"), F.when(n > 0, "blocked").otherwise("allowed").alias("decision")
    )


def unknown_names(requests: DataFrame, names: DataFrame, key: str = "request_id") -> DataFrame:
    """Requested names that the inventory lacks, with their place in the request."""
    asked = requests.select(key, F.posexplode("secret_names").alias("pos", "name"))
    return asked.join(names.select("name").distinct(), "name", "left_anti").select(key, "pos", "name")


def unknown_denials(requests: DataFrame, names: DataFrame, key: str = "request_id") -> DataFrame:
    """Denied requests with the reason. The list is bounded by the request it repeats."""
    unknown = unknown_names(requests, names, key).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("unknown")
    )
    return unknown.select(key, F.concat(F.lit("unknown secrets: "), F.array_join("unknown", ", ")).alias("reason"))


def import_decisions(new: DataFrame, existing: DataFrame, policy: str = "skip") -> DataFrame:
    """Entries ``file_order, name, …`` as ``imported`` or ``skipped``.

    A name that exists, or that an earlier file brought, collides. ``skip`` keeps the first,
    ``overwrite`` takes them all.
    """
    if policy == "overwrite":
        return new.select("file_order", "name", F.lit("imported").alias("decision"))
    first = new.groupBy("name").agg(F.min("file_order").alias("__first"))
    free = first.join(existing.select("name").distinct(), "name", "left_anti")
    imported = F.col("file_order") == F.col("__first")
    return new.join(free, "name", "left").select(
        "file_order", "name", F.when(imported, "imported").otherwise("skipped").alias("decision")
    )


def import_entries(new: DataFrame, existing: DataFrame, policy: str = "skip") -> DataFrame:
    """The inventory ``name, value`` after an import. Holds values."""
    pick = F.max_by("value", "file_order") if policy == "overwrite" else F.min_by("value", "file_order")
    came = new.groupBy("name").agg(pick.alias("__new"), F.lit(True).alias("__came"))
    old = existing.select("name", F.col("value").alias("__old"), F.lit(True).alias("__had"))
    keep_old = F.col("__had").isNotNull() & (F.lit(policy != "overwrite") | F.col("__came").isNull())
    return came.join(old, "name", "full").select(
        "name", F.when(keep_old, F.col("__old")).otherwise(F.col("__new")).alias("value")
    )


def inject_names(requests: DataFrame, mapping: DataFrame, key: str = "request_id") -> DataFrame:
    """Secret to variable name per request; a secret without a mapping goes by its own name."""
    asked = requests.select(key, F.explode("secret_names").alias("name"))
    return asked.join(mapping, "name", "left").select(key, "name", F.coalesce("env", "name").alias("env"))


def manifest_merge(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Manifest rows to append for names not covered by a table key, an older ``name`` or an ``env``."""
    covered = existing.select("project", F.explode(F.array("name", "env")).alias("name")).where("name is not null").distinct()
    new = names.select("project", "name").distinct().join(covered, ["project", "name"], "left_anti")
    return new.select("project", "name", F.lit(True).alias("required"), F.lit("").alias("description"), F.col("name").alias("env"))


def union_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").union(b.select("name")).distinct()


def missing(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.select("name").distinct().join(present.select("name"), "name", "left_anti")


def sorted_names(df: DataFrame, by: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Distinct names in order, as rows."""
    return df.select(*by, name).distinct().orderBy(*by, name)


def in_scope(requested: Column, granted: Column) -> Column:
    """Whether every requested name is granted."""
    return F.size(F.array_except(requested, granted)) == 0


def snapshot_refresh(previous: DataFrame, current: DataFrame, key: str = "source") -> DataFrame:
    """Re-read only sources whose fingerprint moved; what cannot be read keeps its last good state.

    Both sides have ``key, content`` and optionally ``modified``; current content may be null
    (unreadable). Output: ``key, fingerprint, status, use_previous``.
    """

    def fingerprint(df: DataFrame) -> Column:
        when = F.unix_micros(F.col("modified").cast("timestamp")) if "modified" in df.columns else F.lit(0)
        content = F.col("content")
        body = content.cast("binary")
        return F.when(content.isNotNull(), F.concat_ws(":", F.octet_length(body), when, F.sha2(body, 256)))

    before = previous.select(key, fingerprint(previous).alias("__old"))
    now = current.select(key, fingerprint(current).alias("__new"))
    old, new = F.col("__old"), F.col("__new")
    status = (
        F.when(new.isNull() & old.isNull(), "unreadable").when(new.isNull(), "kept").when(old.isNull(), "new")
        .when(old == new, "unchanged").otherwise("changed")
    )
    return before.join(now, key, "full").select(
        key, F.coalesce(new, old).alias("fingerprint"), status.alias("status"),
        status.isin("kept", "unchanged").alias("use_previous"),
    )
