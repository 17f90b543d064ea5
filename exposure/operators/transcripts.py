"""Transcripts: hits per line, then findings per file.

A line counts for its strongest tier only. Everything per path is counted with partial aggregates,
and line numbers stay rows, so one path with a third of all lines is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions import fixed, values
from exposure.operators import json_walk
from exposure.operators.detection import found_hits
from exposure.operators.findings import _counted, _empty, _ordered, finding_items
from exposure.session import checkpoint

LINE = ("path", "line_no")
PAGE_LINES = 10_000


def string_hits(lines: DataFrame) -> DataFrame:
    """Graded hits of the strings of every line: ``path, line_no, ord, seq, form, name, tier, …``.

    ``ord`` is the order in which a scan meets the strings: scanned texts of the line, then those
    of opened containers, then secret-keyed values, outer before inner.
    """
    strings = json_walk.unwrap(lines)
    phase = F.when(F.col("use") == "text", F.lit(0)).otherwise(F.lit(2)) + F.col("level")
    placed = strings.select(*LINE, F.struct(phase.alias("phase"), "pos", "ipos").alias("ord"), "use", "key", "text")
    hits = F.when(F.col("use") == "text", found_hits("text")).otherwise(keyed_hits(F.col("key"), F.col("text")))
    return placed.select(*LINE, "ord", F.inline(hits)).drop("value")


def keyed_hits(key: Column, value: Column) -> Column:
    """The value of a secret-named key as a hit array, graded like an assignment."""
    graded = F.filter(F.array(values.classify(value)), lambda v: values.is_suspicious(v.tier))
    return F.transform(
        graded,
        lambda v: F.struct(
            F.lit(0).cast("bigint").alias("seq"), F.lit("assignment").alias("form"), key.alias("name"),
            F.lit(None).cast("string").alias("value"), v.tier.alias("tier"),
            values.tier_rank(v.tier).cast("int").alias("tier_rank"),
            F.array_compact(F.array(v.reason)).alias("reasons"),
        ),
    )


def line_tiers(string_hits: DataFrame) -> DataFrame:
    """Names, vendor kinds and bearer marks per line.

    Within one string reasons gather; across strings the strongest tier wins and the first string's
    reasons stay. The first vendor kind of a line is kept.
    """
    per_string = finding_items(string_hits, (*LINE, "ord"))
    first = F.struct("tier_rank", "ord", "first_seq")
    # A mark of either tier counts on its own; a name counts at its strongest.
    mark_tier = F.when(F.col("form") != "name", F.col("tier_rank"))
    is_prefix = F.col("form") == "prefix"
    return per_string.groupBy(
        *LINE, "form", F.when(~is_prefix, F.col("name_key")).alias("__key"), mark_tier.alias("__tier")
    ).agg(
        F.min_by(F.struct("name", "name_key", "tier_rank", "reasons", "ord", "first_seq"), first).alias("w")
    ).select(*LINE, "form", "w.name_key", "w.name", "w.tier_rank", "w.reasons", "w.ord", "w.first_seq")


def line_ranks(tiers: DataFrame) -> DataFrame:
    """The strongest tier of each line that has a hit."""
    return tiers.groupBy(*LINE).agg(F.min("tier_rank").alias("tier_rank"))


def line_hits(tiers: DataFrame) -> DataFrame:
    """Hit lines as rows: ``path, confidence, line_no``. The whole list, however long."""
    return line_ranks(tiers).select("path", values.tier_name("tier_rank").alias("confidence"), "line_no")


def hit_line_pages(tiers: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """Hit lines as sorted arrays, one per tier and range of line numbers, so that no array is unbounded."""
    page = F.floor((F.col("line_no") - 1) / page_lines).alias("page")
    return line_hits(tiers).groupBy("path", "confidence", page).agg(F.array_sort(F.collect_list("line_no")).alias("hit_lines"))


def transcript_names(tiers: DataFrame) -> DataFrame:
    """Names per path and tier, each once: ``path, confidence, name, line_no``.

    A name is listed at a tier unless an earlier line, or a stronger tier of the same line, has
    shown it at that tier or a stronger one. Vendor kinds are the names of the certain tier.
    """
    named = tiers.where(F.col("form") != "bearer")
    at = F.struct("line_no", F.col("ord"), F.col("first_seq"))
    firsts = named.groupBy("path", "name_key", "tier_rank").agg(F.min_by("name", at).alias("name"), F.min(at).alias("at"))
    # At most three rows per name, so the pivot is three conditional minima.
    first = {r: F.min(F.when(F.col("tier_rank") == r, F.struct("at", "name"))).alias(f"r{r}") for r in (0, 1, 2)}
    wide = firsts.groupBy("path", "name_key").agg(*first.values())
    line = {r: F.col(f"r{r}.at.line_no") for r in (0, 1, 2)}
    shown = {
        0: F.col("r0").isNotNull(),
        1: F.col("r1").isNotNull() & F.coalesce(line[1] < line[0], F.lit(True)),
        2: F.col("r2").isNotNull() & F.coalesce(line[2] < line[0], F.lit(True)) & F.coalesce(line[2] < line[1], F.lit(True)),
    }
    rows = F.filter(
        F.array(*(F.struct(F.lit(r).alias("tier_rank"), F.when(shown[r], F.col(f"r{r}")).alias("f")) for r in shown)),
        lambda x: x.f.isNotNull(),
    )
    return wide.select("path", F.explode(rows).alias("x")).select(
        "path", values.tier_name("x.tier_rank").alias("confidence"), F.col("x.tier_rank").alias("tier_rank"),
        F.col("x.f.name").alias("name"), F.col("x.f.at.line_no").alias("line_no"), F.col("x.f.at").alias("at"),
    )


def transcript_counts(tiers: DataFrame) -> DataFrame:
    """Hit lines per path and tier as counts only: the form for tables of any size."""
    return line_ranks(tiers).groupBy("path", values.tier_name("tier_rank").alias("confidence")).agg(
        F.count("*").alias("secret_count")
    )


def transcript_findings(tiers: DataFrame, scope: str = "deep") -> DataFrame:
    """Findings of transcript files, with line lists and names as arrays.

    The arrays are bounded by the hits of one file. For tables without such a bound
    use :func:`transcript_counts`, :func:`line_hits`, :func:`hit_line_pages` and :func:`transcript_names`.
    """
    # Hits are few beside the lines they come from. They are written once and read three times.
    tiers = checkpoint(tiers)
    key = ["path", "tier_rank"]
    lines = line_ranks(tiers).groupBy(*key).agg(F.array_sort(F.collect_list("line_no")).alias("hit_lines"))
    names = transcript_names(tiers).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda n: n["name"]).alias("secret_names")
    )
    reasons = {r: F.array_contains("reasons", r) for r in fixed.NAME_REASONS}
    at = F.struct("line_no", "ord", "first_seq")
    counted = tiers.where("form = 'name'").groupBy(*key).agg(
        *(F.min(F.when(h, F.struct(at.alias("at"), F.array_position("reasons", F.lit(r)).alias("pos")))).alias(f"__at_{r}")
          for r, h in reasons.items()),
        *(F.count(F.when(h, 1)).alias(f"__n_{r}") for r, h in reasons.items()),
    )
    n = F.size("hit_lines").cast("bigint")
    rank = F.col("tier_rank")
    shape = F.when(rank == 0, "vendor-prefixed tokens").when(
        rank == 1, "likely secret assignments"
    ).otherwise("possible secret assignments")
    names_only = F.when(rank == 1, "likely names, all on lines that already count").otherwise(
        "possible names, all on lines that already count"
    )
    advisory = F.when(rank < 2, " (heuristic)").otherwise("")
    reason = F.when(n > 0, F.concat(F.format_string("%d line(s): ", n), shape, advisory)).otherwise(names_only)
    joined = lines.join(names, key, "full").join(counted, key, "left").withColumn(
        "hit_lines", F.coalesce("hit_lines", _empty("int"))
    )
    return joined.where((F.size("hit_lines") > 0) | (F.size("secret_names") > 0)).select(
        F.lit("transcript").alias("src"), "path", F.lit(0).alias("part"), F.lit("agent_session_transcript").alias("kind"),
        F.coalesce("secret_names", _empty("string")).alias("secret_names"), n.alias("secret_count"),
        F.concat(F.lit("transcript, "), reason).alias("reason"), F.lit(False).alias("importable"),
        F.lit(scope).alias("scope"), "hit_lines", values.tier_name("tier_rank").alias("confidence"),
        _ordered({r: F.col(f"__at_{r}") for r in reasons}).alias("reasons"),
        _counted({r: F.coalesce(F.col(f"__n_{r}"), F.lit(0)) for r in reasons}).alias("reason_counts"),
    )
