"""Text-bearing tables as one shape: ``texts(src, id, part, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions import fixed

ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def lenient(data: Column) -> Column:
    """UTF-8 with replacement characters for bytes that are not."""
    return F.make_valid_utf8(data.cast("string"))


def texts(
    df: DataFrame,
    src: str,
    id_col: str,
    text_col: str,
    part_col: str | None = None,
    max_bytes: int | None = None,
    unescape: bool = False,
    drop_binary: bool = False,
) -> DataFrame:
    """Normalise a table to ``texts``. With ``drop_binary``, rows with a NUL in the first 4,096 bytes go, as for files.

    Whole texts are scanned. ``max_bytes`` (256,000 for files, as a command-line scan would read)
    cuts on bytes before decoding and is off unless asked for.
    """
    text: Column = F.col(text_col)
    if max_bytes is not None:
        data = F.encode(text, "UTF-8")
        cut = F.substring(data, 1, max_bytes)
        text = F.when(F.octet_length(text) > max_bytes, lenient(cut)).otherwise(text)
    if unescape:
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
    part = F.col(part_col).cast("int") if part_col else F.lit(0)
    head = F.encode(F.left(text, F.lit(fixed.BINARY_PROBE_BYTES)), "UTF-8")
    probe = F.substring(head, 1, fixed.BINARY_PROBE_BYTES).cast("string")
    rows = df.select(
        F.lit(src).alias("src"), F.col(id_col).cast("string").alias("id"), part.alias("part"), text.alias("text")
    ).where(F.col("text").isNotNull() & (~probe.contains("\x00") if drop_binary else F.lit(True)))
    return rows


def decoded(content: Column, max_bytes: int | None = None) -> Column:
    """Bytes of a file as text; null for binary content (a NUL in the first 4,096 bytes)."""
    head = F.substring(content, 1, fixed.BINARY_PROBE_BYTES).cast("string")
    body = F.substring(content, 1, max_bytes) if max_bytes else content
    return F.when(~head.contains("\x00"), lenient(body))
