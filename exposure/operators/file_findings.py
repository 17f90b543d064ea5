"""Findings of files: sensitive by name, dotenv, or by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.functions import names as nm
from exposure.operators.detection import hits
from exposure.operators.findings import _empty, _no_counts, drop_empty_dotenv, text_findings
from exposure.sources.lines import dotenv_entries, lines
from exposure.sources.texts import decoded


def dotenv_findings(files: DataFrame, scope: str = "project") -> DataFrame:
    """One certain finding per dotenv file: names with a value, placeholders too. Empty files stay, with count 0.

    The name lists are bounded by the file.
    """
    entries = dotenv_entries(lines(files.select("path", "content")))
    filled = F.trim(F.col("value")) != ""
    grouped = entries.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "name", filled.alias("filled")))).alias("e"),
    )
    every = F.coalesce(F.transform("e", lambda x: x["name"]), _empty("string"))
    named = F.coalesce(F.transform(F.filter("e", lambda x: x.filled), lambda x: x["name"]), _empty("string"))
    n = F.size(named).cast("bigint")
    return files.select("path").join(grouped, "path", "left").select(
        F.lit("file").alias("src"), "path", F.lit(0).alias("part"), F.lit("dotenv").alias("kind"),
        F.when(n > 0, named).otherwise(every).alias("secret_names"), n.alias("secret_count"),
        F.when(n > 0, F.format_string("dotenv, %d filled name(s)", n))
        .when(F.size(every) > 0, "dotenv, no value filled in")
        .otherwise("dotenv without entries").alias("reason"),
        (n > 0).alias("importable"), F.lit(scope).alias("scope"), _empty("int").alias("hit_lines"),
        F.lit(fixed.CERTAIN).alias("confidence"), _empty("string").alias("reasons"), _no_counts().alias("reason_counts"),
    )


def named_file_findings(files: DataFrame, scope: str = "project") -> DataFrame:
    """Findings of files that are sensitive by name, apart from dotenv files and shell histories."""
    kind, text = F.col("kind"), F.col("text")
    keys = F.when(kind.isin("credentials.json", "mcp_config"), F.coalesce(F.json_object_keys(text), _empty("string"))).otherwise(_empty("string"))
    typed = files.withColumn("kind", nm.file_kind("path")).where(kind.isNotNull() & ~kind.isin("dotenv", "shell_history"))
    typed = typed.withColumn("text", F.when(kind.isin("credentials.json", "mcp_config", "git_config"),
                                            decoded(F.col("content"))))
    typed = typed.where((kind != "git_config") | nm.git_config_suspect(text)).withColumn("keys", keys)
    confirmed = F.exists("keys", lambda k: k.isin(*fixed.MCP_KEYS))
    doubtful = (kind == "mcp_config") & ~confirmed
    n = F.when(doubtful, F.lit(1)).otherwise(F.greatest(F.size("keys"), F.lit(1))).cast("bigint")
    return typed.select(
        F.lit("file").alias("src"), "path", F.lit(0).alias("part"), "kind", F.col("keys").alias("secret_names"),
        n.alias("secret_count"),
        F.when(kind == "credentials.json", F.format_string("credentials.json with %d top-level key(s)", n))
        .when(doubtful, "looks like an MCP config, but no server list")
        .when(kind == "mcp_config", F.format_string("MCP config with %d top-level key(s)", n))
        .when(kind == "ssh_private_key", "private key for SSH")
        .when(kind == "git_config", "git config with a password or token in a URL, or a helper")
        .otherwise(F.format_string("%s: registry tokens are kept there", "kind")).alias("reason"),
        F.lit(False).alias("importable"), F.lit(scope).alias("scope"), _empty("int").alias("hit_lines"),
        F.when(doubtful, fixed.POSSIBLE).otherwise(fixed.CERTAIN).alias("confidence"),
        F.when(doubtful, F.array(F.lit(fixed.UNCONFIRMED_MCP))).otherwise(_empty("string")).alias("reasons"),
        F.when(doubtful, F.create_map(F.lit(fixed.UNCONFIRMED_MCP), F.lit(1).cast("bigint"))).otherwise(_no_counts()).alias("reason_counts"),
    )


def content_texts(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Texts of files for content scanning: all of them, or their first ``max_bytes`` bytes where asked for."""
    return files.select(
        F.lit("file").alias("src"), F.col("path").alias("id"), F.lit(0).alias("part"),
        decoded(F.col("content"), max_bytes).alias("text"),
    ).where("text is not null")


def file_findings(files: DataFrame, scope: str = "project", max_bytes: int | None = None) -> DataFrame:
    """All findings of a file listing: dotenv, sensitive by name, shell history, inline content."""
    kind = nm.file_kind("path")
    history = text_findings(
        hits(content_texts(files.where(kind == "shell_history"), max_bytes)), "shell_history", scope,
        "shell history: likely secrets",
        "shell history: possible secrets",
    )
    inline = text_findings(
        hits(content_texts(files.where(kind.isNull() & nm.is_text_file("path")), max_bytes)), "inline", scope
    )
    dotenv = drop_empty_dotenv(dotenv_findings(files.where(kind == "dotenv"), scope))
    return dotenv.unionByName(named_file_findings(files, scope)).unionByName(history).unionByName(inline)
