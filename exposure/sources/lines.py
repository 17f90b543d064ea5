"""Line-shaped sources: dotenv files, manifests, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.operators.ordered import carry_last, last_wins
from exposure.sources.texts import decoded
from exposure.sources.tree import list_tree, read_lines

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(files: DataFrame, breaks: str = LINE_BREAK) -> DataFrame:
    """Lines of files with 1-based numbers: ``path, line_no, raw``. A file is one row; lines leave it without a shuffle."""
    text = F.coalesce(decoded(F.col("content")), F.lit(""))
    return files.select("path", F.posexplode(F.split(text, breaks)).alias("pos", "raw")).select(
        "path", (F.col("pos") + 1).cast("int").alias("line_no"), "raw"
    )


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{fixed.SPACES}]+|[{fixed.SPACES}]+$", "")


#: A value in double quotes, in single quotes, or bare up to a comment.
VALUE_FORMS = f"""(?s)^(?:"(.*)"|'(.*)'|(.*?)[{fixed.SPACES}]*(?: #.*)?)\\z"""


def _assigned(right: Column) -> Column:
    """The value on the right of an assignment; the groups of the forms that do not apply are empty."""
    value = _stripped(right)
    return F.concat(*(F.regexp_extract(value, VALUE_FORMS, form) for form in (1, 2, 3)))


def dotenv_lines(lines: DataFrame) -> DataFrame:
    """Every assignment line as ``path, line_no, name, value``; comments, blanks and the rest are dropped."""
    line = _stripped(F.col("raw"))
    shape = r"(?s)^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)\z"
    return (
        lines.withColumn("__line", line)
        .where(F.col("__line").rlike(shape) & ~F.col("__line").startswith("#"))
        .select("path", "line_no", F.regexp_extract("__line", shape, 1).alias("name"),
                _assigned(F.regexp_extract("__line", shape, 2)).alias("value"))
    )


def dotenv_entries(lines: DataFrame) -> DataFrame:
    """Entries of dotenv files: the last assignment of a name wins and keeps the first one's place."""
    return last_wins(dotenv_lines(lines)).select("path", "line_no", "name", "value")


def transcripts(spark: SparkSession, homes: list[str]) -> DataFrame:
    """Lines of known agent transcripts below the homes, of any size: lines leave a file as it is read."""
    return read_lines(transcript_files(spark, homes))


def transcript_files(spark: SparkSession, homes: list[str]) -> DataFrame:
    """Transcript files by layout, each path once. Only the folders of known layouts are walked."""
    roots, wanted = [], F.lit(False)
    for home in (h.rstrip("/") for h in homes):
        for folder, shape in fixed.TRANSCRIPT_LAYOUTS:
            root = f"{home}/{folder}"
            roots.append(root)
            inner = F.substring("path", len(root) + 2, 1 << 20)
            wanted = wanted | (F.col("path").startswith(f"{root}/") & inner.rlike(rf"^{shape}\z"))
    return list_tree(spark, roots).where(wanted).dropDuplicates(["path"])


def oversized(files: DataFrame) -> DataFrame:
    """How many transcripts are over 100 MiB. They are scanned like the others; the count is for a report."""
    return files.where(F.col("length") > fixed.MAX_TRANSCRIPT_BYTES).agg(
        F.lit("oversized").alias("reason"), F.count("*").alias("n")
    )


# Manifests --------------------------------------------------------------------------------------

_TABLE = r"^\s*\[secrets\.(?:\"([^\"]+)\"|([A-Za-z0-9_-]+))\]\s*(?:#.*)?$"
_LEGACY = r"^\s*\[\[secret\]\]\s*(?:#.*)?$"
_OTHER = r"^\s*\[[^\[\]]+\]\s*(?:#.*)?$|^\s*\[\[[^\[\]]+\]\]\s*(?:#.*)?$"
_PAIR = r"^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(true|false)|([+-]?[0-9][0-9_.]*))\s*(?:#.*)?$"
_BLANK = r"^\s*(?:#.*)?$"


def manifest_rows(lines: DataFrame) -> DataFrame:
    """Manifest files as ``project, name, required, description, env, error``.

    ``[secrets.NAME]`` tables and older ``[[secret]]`` entries are read line by line; a section
    header is carried to the lines below it. A canonical entry wins over an older one of the same
    name. A file with a line or a type this cannot read gives one row with ``error`` and no entries.
    """

    raw = F.col("raw")
    name = F.coalesce(*(F.nullif(F.regexp_extract(raw, _TABLE, g), F.lit("")) for g in (1, 2)))
    no_name = F.lit(None).cast("string").alias("name")
    header = (
        F.when(raw.rlike(_TABLE), F.struct(F.lit("table").alias("kind"), name.alias("name"), F.col("line_no").alias("at")))
        .when(raw.rlike(_LEGACY), F.struct(F.lit("legacy").alias("kind"), no_name, F.col("line_no").alias("at")))
        .when(raw.rlike(_OTHER), F.struct(F.lit("other").alias("kind"), no_name, F.col("line_no").alias("at")))
    )
    section = carry_section(lines.withColumn("__header", header), "__header", "section")
    key = F.regexp_extract(raw, _PAIR, 1)
    text = F.when(raw.rlike(r"=\s*\""), F.regexp_extract(raw, _PAIR, 2)).when(raw.rlike(r"=\s*'"), F.regexp_extract(raw, _PAIR, 3))
    flag = F.when(F.regexp_extract(raw, _PAIR, 4) != "", F.regexp_extract(raw, _PAIR, 4) == "true")
    pair = raw.rlike(_PAIR)
    readable = raw.rlike(_BLANK) | raw.rlike(_TABLE) | raw.rlike(_LEGACY) | raw.rlike(_OTHER) | pair
    ours = F.col("section.kind").isin("table", "legacy")
    # What another section holds (arrays over several lines, say) is its own business.
    elsewhere = F.coalesce(F.col("section.kind") == "other", F.lit(False))
    bad_type = ours & pair & (
        ((key == "required") & flag.isNull()) | (key.isin("description", "env", "name") & text.isNull())
        | ((key == "env") & (text == ""))
    )
    problem = F.when(~readable & (~elsewhere | raw.rlike(r"^\s*\[+\s*secret")), F.format_string("line %d cannot be read", "line_no")).when(
        bad_type, F.format_string("line %d: %s has the wrong type", F.col("line_no"), key)
    )
    mine = F.when(ours, F.col("section"))
    rows = section.select("path", "line_no", mine.alias("section"), key.alias("key"), text.alias("text"), flag.alias("flag"), problem.alias("problem"))

    def last(key_name: str, column: str) -> Column:
        return F.max_by(column, F.when(F.col("section").isNotNull() & (F.col("key") == key_name), F.col("line_no")))

    # One pass over the lines: a row for each entry, and one for what belongs to none, each with its first problem.
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("line_no", "problem")))
    entries = rows.groupBy("path", F.col("section.kind").alias("kind"), F.col("section.at").alias("at")).agg(
        F.coalesce(F.max("section.name"), last("name", "text")).alias("name"),
        F.coalesce(last("required", "flag"), F.lit(True)).alias("required"),
        F.coalesce(last("description", "text"), F.lit("")).alias("description"),
        last("env", "text").alias("env"), first.alias("problem"),
    )
    unnamed = F.col("kind").isNotNull() & (F.coalesce("name", F.lit("")) == "")
    status = entries.groupBy("path").agg(F.min("problem").alias("p"), F.bool_or(unnamed).alias("unnamed")).select(
        "path", F.coalesce("p.problem", F.when(F.col("unnamed"), F.lit("[[secret]] entry without name"))).alias("error")
    )
    chosen = entries.where(F.col("kind").isNotNull() & ~unnamed).groupBy("path", "name").agg(
        F.min_by(F.struct("required", "description", "env"), F.struct(F.col("kind") == "legacy", F.col("at"))).alias("e")
    )
    good = chosen.join(status.where("error is null"), "path", "left_semi").select(
        F.col("path").alias("project"), "name", "e.required", "e.description",
        F.coalesce("e.env", "name").alias("env"), F.lit(None).cast("string").alias("error"),
    )
    none = F.lit(None).cast("string")
    bad = status.where("error is not null").select(
        F.col("path").alias("project"), none.alias("name"), F.lit(None).cast("boolean").alias("required"),
        none.alias("description"), none.alias("env"), "error",
    )
    return good.unionByName(bad)


def carry_section(lines: DataFrame, header: str, name: str) -> DataFrame:
    """Carry the latest non-null section header down to the lines below it, per file.

    Rows are dealt by ranges, so a long file is several tasks.
    """
    return carry_last(lines, ("path",), ("line_no",), {name: F.col(header)}, inclusive=True)


def manifest_names(lines: DataFrame) -> DataFrame:
    """Names a manifest already covers: table keys, ``name =`` and ``env =`` fields."""
    raw = F.col("raw")
    table = F.btrim(F.trim(F.regexp_extract(raw, r"^\s*\[secrets\.([^\]]+)\]\s*$", 1)), F.lit('"'))
    field = F.regexp_extract(raw, r"^\s*(?:env|name)\s*=\s*\"([^\"]*)\"\s*$", 1)
    return lines.select("path", F.explode(F.array(table, field)).alias("name")).where("name <> ''").distinct()


def manifest_blocks(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks to append for ``names(path, name)`` that a manifest does not cover yet."""
    new = names.select("path", "name").distinct().join(manifest_names(lines), ["path", "name"], "left_anti")
    block = F.format_string('[secrets.%s]\nrequired = true\ndescription = ""\nenv = "%s"\n', "name", "name")
    return new.select("path", "name", block.alias("block"))


# Names and JSON keys ----------------------------------------------------------------------------


def names(files: DataFrame, scope: str = "path") -> DataFrame:
    """Names sidecars ``{"names": [...]}`` as rows; a wrong shape gives none."""
    text = decoded(F.col("content"))
    listed = F.from_json(text, "names ARRAY<STRING>")["names"]
    return files.select(F.col(scope).alias("scope"), F.explode(listed).alias("name"))


def json_keys(df: DataFrame, text: str) -> DataFrame:
    """Top-level keys of JSON objects, never their values; null where there is no object."""
    return df.select("*", F.explode_outer(F.json_object_keys(text)).alias("key"))
