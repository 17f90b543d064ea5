"""Which vault, environment and scope a request works in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_scope(requests: DataFrame, projects: DataFrame, vault_dir: str = ".vault") -> DataFrame:
    """Add vault path, environment and merge decision to requests.

    ``requests``: project_root, vault_flag, vault_override, force_global, no_global, env_flag,
    env_override, global_vault, global_exists. ``projects``: root, use_global, default_env.
    Order: explicit vault, override, global by force, project, else global. The environment is the
    flag, the override or the project's default. A flag without a project is an error.
    """
    cfg = projects.select(
        F.col("root").alias("project_root"), F.coalesce("use_global", F.lit(True)).alias("__use_global"),
        F.nullif(F.col("default_env"), F.lit("")).alias("__default_env"), F.lit(True).alias("__project"),
    )
    explicit = F.coalesce(F.nullif("vault_flag", F.lit("")), F.nullif("vault_override", F.lit("")))
    in_project = F.col("__project").isNotNull()
    scope = (
        F.when(explicit.isNotNull(), "explicit").when(F.coalesce("force_global", F.lit(False)), "global")
        .when(in_project, "project").otherwise("global")
    )
    env = F.coalesce(F.nullif("env_flag", F.lit("")), F.nullif("env_override", F.lit("")), "__default_env")
    rows = requests.join(cfg, "project_root", "left").withColumn("scope", scope).withColumn(
        "env_name", F.when(F.col("scope") == "project", env)
    )
    base = F.concat("project_root", F.lit(f"/{vault_dir}"))
    own = F.when(F.col("env_name").isNotNull(), F.concat(base, F.lit("/envs/"), "env_name", F.lit("/vault.bin"))).otherwise(
        F.concat(base, F.lit("/vault.bin"))
    )
    path = F.when(F.col("scope") == "explicit", explicit).when(F.col("scope") == "global", F.col("global_vault")).otherwise(own)
    merge = (
        (F.col("scope") == "project") & F.col("__use_global") & ~F.coalesce("no_global", F.lit(False))
        & F.coalesce("global_exists", F.lit(False)) & (F.col("global_vault") != own)
    )
    wrong = (F.col("scope") == "global") & (F.coalesce("env_flag", F.lit("")) != "")
    return rows.select(
        *requests.columns, "scope", "env_name", path.alias("vault_path"), F.coalesce(merge, F.lit(False)).alias("merge_with_global"),
        F.when(wrong, "an environment needs a project vault").alias("error"),
    )


def merge_with_lists(precedence: DataFrame) -> DataFrame:
    """Distinct sorted names over the scopes a request merges."""
    return precedence.select("name").distinct().orderBy("name")
