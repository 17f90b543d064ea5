"""Strings inside JSON lines, in document order, with one level of JSON-in-string.

Spark's JSON readers sort object keys or fix a schema, and both lose the order on which the first
reason and the first vendor kind of a line depend. So lines that can matter at all are walked in an
Arrow batch; literal searches in the JVM drop the others before any row reaches Python.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from exposure.functions import fixed
from exposure.functions.fixed import KEYWORD_LITERALS, VENDOR_PREFIXES
from exposure.functions import names as nm

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WALKED = "array<struct<pos:int,key:string,text:string>>"
PREFIX_LITERALS = tuple({lit for _, lits, _ in VENDOR_PREFIXES for lit in lits})
TEXT_WORDS = (*KEYWORD_LITERALS, "bearer")


def _strings(node: object) -> Iterator[tuple[str | None, str]]:
    """Depth-first (key, string) pairs; the key is that of the object directly around the string."""
    stack: list[tuple[str | None, object]] = [(None, node)]
    while stack:
        key, item = stack.pop()
        if isinstance(item, str):
            yield key if key is None else _valid(key), _valid(item)
        elif isinstance(item, dict):
            stack.extend((k, v) for k, v in reversed(item.items()))
        elif isinstance(item, list):
            stack.extend((None, v) for v in reversed(item))


def _valid(text: str) -> str:
    """Half a surrogate pair, as where an emoji was cut, is no text that can be handed on: a replacement character stands for it."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _parse(raw: str | None) -> object:
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


def _all_strings(raw: pd.Series) -> pd.Series:
    def strings(line: str | None) -> list[dict] | None:
        node = _parse(line)
        return None if node is None else [{"pos": i, "key": k, "text": t} for i, (k, t) in enumerate(_strings(node))]

    return raw.map(strings)


def _gated_strings(raw: pd.Series) -> pd.Series:
    """As above without the strings that cannot matter, so that they never cross to the JVM."""

    def matters(key: str | None, text: str) -> bool:
        """Plain literal search: as a scanned text, as the key of a value, or hidden by escapes."""
        if "\\u" in text or any(lit in text for lit in PREFIX_LITERALS):
            return True
        low = text.lower()
        if any(word in low for word in TEXT_WORDS):
            return True
        return key is not None and any(word in key.lower() for word in KEYWORD_LITERALS)

    def strings(line: str | None) -> list[dict] | None:
        node = _parse(line)
        if node is None:
            return None
        return [{"pos": i, "key": k, "text": t} for i, (k, t) in enumerate(_strings(node)) if matters(k, t)]

    return raw.map(strings)


def walk(raw: Column, gated: bool = False) -> Column:
    """Every string of a JSON document with its key and position; null for what is not JSON."""
    return pandas_udf(_gated_strings if gated else _all_strings, WALKED)(raw)


def not_json(raw: Column) -> Column:
    """Whether a text that is not blank is no JSON document."""

    @pandas_udf("boolean")
    def broken(s: pd.Series) -> pd.Series:
        return s.map(lambda x: bool(x and x.strip()) and x.strip() != "null" and _parse(x) is None)

    return broken(raw)


def json_strings(df: DataFrame, column: str) -> DataFrame:
    """One row per string value at any depth (not keys), with its position in the document."""
    return df.withColumn("__walked", walk(F.col(column))).select(*df.columns, F.inline("__walked"))


def json_secret_keys(df: DataFrame, column: str) -> DataFrame:
    """Strings whose key is in the secret-name vocabulary."""
    return json_strings(df, column).where(nm.is_secret_name("key"))


def may_matter(raw: Column) -> Column:
    """Whether the strings of a JSON line can hold a hit.

    Keywords and vendor prefixes are plain letters, ``-`` and ``_``, which JSON can only hide as
    ``\\u`` escapes; lines with those always pass.
    """
    return nm.may_hold_secret(raw) | raw.contains("\\u")


def unwrap(lines: DataFrame) -> DataFrame:
    """What a transcript scan looks at per line: ``path, line_no, level, pos, use, key, text``.

    ``use`` is ``text`` for strings that are scanned and ``key`` for values of secret-named keys. A
    string that itself is a JSON object or array is opened once: its inner strings are scanned and
    its keys are looked at, its own text is not.
    """
    raw = F.regexp_replace("raw", f"^[{fixed.SPACES}]+|[{fixed.SPACES}]+$", "")
    keys = [c for c in lines.columns if c != "raw"]
    outer = lines.where(may_matter(F.col("raw"))).select(*keys, walk(raw, gated=True).alias("outer"))

    # Second walk, for the rare strings that are containers; null where a string is not one.
    opened = outer.select(*keys, F.inline("outer")).select(
        *keys, "pos", "key", "text",
        walk(F.when(nm.is_json_container("text"), F.col("text")), gated=True).alias("inner"),
    )
    secret = nm.is_secret_name
    none = F.array().cast("array<struct<level:int,ipos:int,use:string,key:string,text:string>>")

    def item(level: int, ipos: Column, use: str, key: Column, text: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), ipos.cast("int").alias("ipos"), F.lit(use).alias("use"),
            key.alias("key"), text.alias("text"),
        )

    here = F.col("inner")
    scanned = F.when(here.isNull(), F.array(item(0, F.lit(0), "text", F.col("key"), F.col("text")))).otherwise(
        F.filter(
            F.transform(here, lambda s: item(1, s.pos, "text", s.key, s.text)),
            lambda s: ~nm.is_json_container(s.text),
        )
    )
    keyed_outer = F.when(secret("key"), F.array(item(0, F.lit(0), "key", F.col("key"), F.col("text")))).otherwise(none)
    keyed_inner = F.coalesce(
        F.filter(F.transform(here, lambda s: item(1, s.pos, "key", s.key, s.text)), lambda s: secret(s.key)), none
    )
    return opened.select(*keys, "pos", F.inline(F.concat(scanned, keyed_outer, keyed_inner)))
