"""Declared table shapes. Production paths never infer a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXTS = "src STRING, id STRING, part INT, text STRING"
HITS = "src STRING, id STRING, part INT, seq BIGINT, form STRING, name STRING, tier STRING, tier_rank INT, reasons ARRAY<STRING>"
FINDINGS = (
    "src STRING, path STRING, part INT, kind STRING, secret_names ARRAY<STRING>, secret_count BIGINT, "
    "reason STRING, importable BOOLEAN, scope STRING, hit_lines ARRAY<INT>, confidence STRING, "
    "reasons ARRAY<STRING>, reason_counts MAP<STRING,BIGINT>"
)
LINES = "path STRING, line_no INT, raw STRING"
FILES = "path STRING, length BIGINT, modificationTime TIMESTAMP, content BINARY"
DOTENV = "path STRING, line_no INT, name STRING, value STRING"
MANIFEST = "project STRING, name STRING, required BOOLEAN, description STRING, env STRING"
NAMES = "scope STRING, name STRING"
SECRETS = "scope STRING, precedence INT, name STRING, value STRING"
MEMBERS = "member_id STRING, name STRING, role STRING, added_at TIMESTAMP"
ACL = "secret STRING, member_id STRING"
AUDIT = (
    "timestamp STRING, action STRING, secret_names ARRAY<STRING>, command STRING, route STRING, "
    "result STRING, reason STRING, _corrupt_record STRING"
)
REQUESTS = (
    "session STRING, seq BIGINT, ts TIMESTAMP, verb STRING, secret_names ARRAY<STRING>, pid BIGINT, "
    "start_time BIGINT, approve BOOLEAN, minutes INT"
)
PROCS = "host STRING, pid BIGINT, ppid BIGINT, start_time BIGINT, uid INT, snapshot_ts TIMESTAMP"
COMMANDS = "cmd_id BIGINT, ts TIMESTAMP, actor STRING, text STRING"
RULES = "tool STRING, verb STRING, sub STRING, effect STRING"

VALUE_COLUMNS = frozenset({"value", "hit", "text", "raw", "content"})


def assert_public(df: DataFrame) -> DataFrame:
    """Refuse to publish a table that could carry a secret value, at any depth."""

    def names(kind: T.DataType, prefix: str = "") -> list[str]:
        if isinstance(kind, T.StructType):
            return [n for f in kind for n in (f.name, *names(f.dataType))]
        if isinstance(kind, T.ArrayType):
            return names(kind.elementType)
        if isinstance(kind, T.MapType):
            return names(kind.valueType)
        return []

    leaking = VALUE_COLUMNS.intersection(names(df.schema))
    if leaking:
        raise ValueError(f"columns that may hold secret values: {sorted(leaking)}")
    return df
