"""The audit log: reading, checking, appending, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.schemas import AUDIT


def normalise(raw: DataFrame) -> DataFrame:
    """Audit records with a parsed time and the command as an array, whether written as text or list."""
    listed = F.from_json("command", "array<string>")
    command = F.when(F.col("command").startswith("["), F.coalesce(listed, F.array("command"))).when(
        F.col("command").isNotNull(), F.array("command")
    )
    return raw.where("_corrupt_record is null").select(
        F.to_timestamp("timestamp").alias("ts"), "action", F.coalesce("secret_names", F.array().cast("array<string>")).alias("secret_names"),
        command.alias("command"), "route", "result", F.coalesce("reason", F.lit("")).alias("reason"),
    )


def audit_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Audit records of a JSONL folder, as a table or a stream. Lines that do not parse are left out here."""
    reader = spark.readStream if streaming else spark.read
    return normalise(reader.schema(AUDIT).option("mode", "PERMISSIVE").json(path))


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Audit records of a table of JSON lines."""
    parsed = F.from_json(column, AUDIT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return normalise(lines.select(parsed.alias("r")).select("r.*"))


def corrupt_records(spark: SparkSession, path: str) -> DataFrame:
    """Count of lines of an audit folder that do not parse."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", AUDIT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = parsed["_corrupt_record"].isNotNull()
    return lines.where((F.trim("value") != "") & bad).agg(F.count("*").alias("n"))


def violation(route: Column, result: Column) -> Column:
    return F.when(~F.coalesce(route.isin(*fixed.AUDIT_ROUTES), F.lit(False)), F.concat(F.lit("invalid route: "), F.coalesce(route, F.lit("")))).when(
        ~F.coalesce(result.isin(*fixed.AUDIT_RESULTS), F.lit(False)), F.concat(F.lit("invalid result: "), F.coalesce(result, F.lit("")))
    )


def split_valid(audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that may be appended, and rejected ones with the reason."""
    checked = audit.withColumn("violation", violation(F.col("route"), F.col("result")))
    return checked.where("violation is null").drop("violation"), checked.where("violation is not null")


def append_audit(audit: DataFrame, path: str) -> None:
    """Append records as JSON lines. One invalid record fails the job: nothing is written silently wrong."""
    bad = violation(F.col("route"), F.col("result"))
    guarded = audit.select(
        F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), "action",
        F.coalesce("secret_names", F.array().cast("array<string>")).alias("secret_names"), "command", "route",
        F.when(bad.isNull(), F.col("result")).otherwise(F.raise_error(bad)).alias("result"), "reason",
    )
    guarded.write.mode("append").option("ignoreNullFields", "false").json(path)


def audit_stats(audit: DataFrame, by: tuple[str, ...] = ("action", "route", "result")) -> DataFrame:
    """Counts with denial rate and number of distinct secrets."""
    if not by:
        return audit_stats(audit.withColumn("__all", F.lit(1)), ("__all",)).drop("__all")
    denied = F.count(F.when(F.col("result") == "denied", 1))
    counts = audit.groupBy(*by).agg(
        F.count("*").alias("n"), denied.alias("denied"), F.round(denied / F.count("*"), 6).alias("denial_rate")
    )
    secrets = audit.select(*by, F.explode("secret_names").alias("secret")).distinct().groupBy(*by).agg(F.count("*").alias("secrets"))
    match = [counts[c].eqNullSafe(secrets[c]) for c in by]
    return counts.join(secrets, match, "left").select(
        *(counts[c] for c in by), "n", "denied", "denial_rate", F.coalesce("secrets", F.lit(0)).cast("bigint").alias("secrets")
    )


def secret_access(audit: DataFrame) -> DataFrame:
    """Accesses and denials per secret."""
    return audit.select(F.explode("secret_names").alias("secret"), "result").groupBy("secret").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("result") == "denied", 1)).alias("denied")
    )


def dedup_audit(audit: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Re-delivered records once each, the earliest of a key. Combined map-side, so copies of one record spread."""
    rest = [c for c in audit.columns if c not in keys]
    return audit.groupBy(*keys).agg(F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("r")).select(
        *keys, *(F.col(f"r.{c}").alias(c) for c in rest)
    )


def audit_windows(audit: DataFrame, width: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Denials and warnings per tumbling or sliding window; works on tables and on watermarked streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return audit.groupBy(window.alias("w"), *by).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("result") == "denied", 1)).alias("denied"),
        F.count(F.when(F.col("result") == "warn", 1)).alias("warned"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "denied", "warned")
