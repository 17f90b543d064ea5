"""Known secret values in texts: where they occur, and redaction.

One way for a dictionary of any size. Values are turned into salted digests where they are read; only digests, lengths
and names leave those tasks. Each task scans its texts once against the digests of up to ``Limits.values`` values (a
bounded broadcast). A larger dictionary is first narrowed to the values that occur: texts are read with a sieve (two bit
tables of bounded size), and the digests of what passes meet the dictionary in an equi-join. If more values than that
occur, they are as many passes, which keep the order of replacement. Texts never move: there is no join and no shuffle
of them, and no value lies on disk or in a plan.
"""

from __future__ import annotations

import bisect
import os
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.operators import value_index
from exposure.operators.detection import valued_hits
from exposure.operators.ordered import number_rows
from exposure.operators.value_index import Fingerprints, Index, Sieve, digest, slots, window_of
from exposure.session import store

for _module in (value_index, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

#: Bytes of texts that are matched at once.
SLICE = 1 << 22
#: A table of a sieve has 2^SIEVE_BITS bits at most.
SIEVE_BITS = 26


@dataclass(frozen=True)
class Limits:
    """How much of a dictionary a task holds at once: values, and bytes of their names."""

    values: int = 250_000
    bytes: int = 1 << 25


class Held:
    """A pass of the dictionary as it is broadcast. Its index is built once in each worker."""

    def __init__(self, salt: bytes, entries: list[tuple[int, int, bytes, str]]):
        self.salt, self.entries, self.built = salt, entries, None

    def index(self) -> Index:
        if self.built is None:
            self.built = Index(self.salt, self.entries)
        return self.built


def _usable(secrets: DataFrame) -> DataFrame:
    """Non-empty values with a total order: longest first, then as given (``seq``) or by name."""
    seq = F.col("seq") if "seq" in secrets.columns else F.lit(0).cast("bigint")
    return secrets.where(F.coalesce(F.length("value"), F.lit(0)) > 0).select(
        "name", "value", F.struct((-F.length("value")).alias("neg_length"), seq.alias("seq"), "name", "value").alias("rank")
    )


def redaction_order(secrets: DataFrame) -> DataFrame:
    """Secrets longest first; ties keep their order."""
    return _usable(secrets).orderBy("rank").select("name", "value")


ORDER = ["neg_length", "seq", "name", "digest"]


def keyed(secrets: DataFrame, salt: bytes) -> DataFrame:
    """The dictionary without its values: ``neg_length, seq, name, digest, size, fingerprint``."""
    rows = _usable(secrets).select(F.col("rank.neg_length").alias("neg_length"), F.col("rank.seq").cast("bigint").alias("seq"), F.coalesce("name", F.lit("")).alias("name"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(salt)
        for b in batches:
            values = [v.encode() for v in b.column(3).to_pylist()]
            made = [
                pa.array([digest(v, salt) for v in values], pa.binary()), pa.array(map(len, values), pa.int32()),
                pa.array([f"{p:016x}" for p in prints.many(values).tolist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], [*ORDER, "size", "fingerprint"])

    return rows.mapInArrow(run, "neg_length int, seq bigint, name string, digest binary, size int, fingerprint string")


def prepare(
    secrets: DataFrame, limits: Limits = Limits(), texts: DataFrame | None = None, columns: Sequence[str] = ("text",), redacting: bool = False
) -> list:
    """The passes of a dictionary, as broadcasts, in order of replacement. The salt is new each time.

    With ``texts`` a dictionary that is too large for one pass is narrowed to the values that occur in ``columns``;
    if ``redacting``, also to those that occur in any state of a text on the way to the redacted one.
    """
    salt = os.urandom(16)
    digests = store(keyed(secrets, salt))
    found = _passes(digests, salt, limits, texts is None)
    if found is not None:
        return found
    sieve = secrets.sparkSession.sparkContext.broadcast(_sieve(digests, salt))
    narrowed, size, passes = digests.limit(0), 0, []
    while True:
        seen = _candidates(texts, columns, sieve, passes)
        # what occurred in a state of an earlier round occurs in one of this round, or need not be looked for
        both = seen.unionByName(narrowed.select("size", "digest")).distinct()
        narrowed = store(digests.join(both, ["size", "digest"], "left_semi").select(*digests.columns).distinct())
        before, size = size, narrowed.count()
        if size == before:
            return passes
        passes = _passes(narrowed, salt, limits)
        if not redacting:
            return passes


def _passes(digests: DataFrame, salt: bytes, limits: Limits, several: bool = True) -> list | None:
    """Entries as broadcasts in order of replacement; null if they do not fit one and may not be ``several``."""
    spark, most = digests.sparkSession, max(1, limits.values)
    digests = digests.distinct()

    def held(rows: list) -> Held:
        rows = sorted(rows, key=lambda r: (r["neg_length"], r["seq"] is not None, r["seq"] or 0, r["name"], bytes(r["digest"])))
        return Held(salt, [(int(r["fingerprint"], 16), r["size"], bytes(r["digest"]), r["name"]) for r in rows])

    n, total, longest = digests.agg(F.count("*"), F.sum(F.octet_length("name")), F.max(F.octet_length("name"))).first()
    if n <= most and (total or 0) <= max(limits.bytes, 1):
        return [spark.sparkContext.broadcast(held(digests.collect()))] if n else []
    if not several:
        return None
    numbered = number_rows(digests, ORDER)
    each = max(1, min(most, limits.bytes // max(1, longest)))
    passes = -(-n // each)
    return [spark.sparkContext.broadcast(held(numbered.where(F.col("n").between(i * each + 1, (i + 1) * each)).collect())) for i in range(passes)]


def _sieve(digests: DataFrame, salt: bytes) -> Sieve:
    """Bit tables of a dictionary, put together from words of 64 bits; at most a million of them reach the driver for each."""
    depth = min(SIEVE_BITS, max(12, (16 * digests.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.frombuffer(bytes.fromhex("".join(b.column(0).to_pylist())), ">u8").astype(np.uint64)
            lengths = b.column(1).to_numpy().astype(np.uint64)
            windows = np.array([window_of(n) for n in lengths.tolist()], np.uint64)
            for second in (False, True):
                at = np.unique(slots(prints, windows, lengths if second else None, depth))
                word, bit = (at >> np.uint64(6)).astype(np.int32), np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), second)), pa.array(word), pa.array(bit.view(np.int64))], ["second", "word", "bits"])

    bits = digests.select("fingerprint", "size").mapInArrow(run, "second boolean, word int, bits bigint")
    words = bits.groupBy("second", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    tables = [np.zeros(max(1, 1 << (depth - 6)), np.uint64) for _ in range(2)]
    second, word, value = (words.column(c).to_numpy() for c in ("second", "word", "bits"))
    for k, table in enumerate(tables):
        mine = second.astype(bool) == bool(k)
        table[word[mine]] = value[mine].view(np.uint64)
    lengths: dict[int, list[int]] = {}
    for (n,) in sorted(map(tuple, digests.select("size").distinct().collect())):
        lengths.setdefault(window_of(n), []).append(n)
    return Sieve(salt, depth, *tables, lengths)


def _candidates(texts: DataFrame, columns: Sequence[str], sieve, passes: list) -> DataFrame:
    """``size, digest`` of what may be a value: in the texts, or with ``passes`` in every state on the way through them."""
    n = len(columns)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[int, bytes]] = set()
            for column in b.columns:
                for _, part in _slices(column):
                    out |= sieve.value.candidates(b"".join(part), _ends(part))
            if out:
                sizes, digests = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], ["size", "digest"])

    def further(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Replacements of a pass; the first row of a batch takes along what its texts held on the way."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value.index()
            for b in batches:
                out = {(x["size"], x["digest"]) for found in b.column(n).to_pylist() for x in found or ()}
                see = lambda state: out.update(sieve.value.candidates(state, [len(state)]))
                arrays = [redacted_column(index, c, see) for c in b.columns[:n]]
                found = [[{"size": size, "digest": d} for size, d in out], *[[]] * (b.num_rows - 1)][: b.num_rows]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, b.schema.field(n).type)], b.schema.names)

        return run

    df = texts.select(*columns)
    if not passes:
        return df.mapInArrow(first, "size int, digest binary")
    df = df.withColumn("__found", F.array().cast("array<struct<size:int,digest:binary>>"))
    for held in passes:
        df = df.mapInArrow(further(held), df.schema)
    return df.select(F.inline("__found"))


def _hit_rows(index: Index, part: list[bytes]) -> list[int]:
    """Which of several texts hold a value."""
    ends = _ends(part)
    return sorted({bisect.bisect_right(ends, place) for place, _, _ in index.matches(b"".join(part), ends)})


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as bytes, a few megabytes at a time, with the row they begin at; a null text is empty."""
    low, size, out = 0, 0, []
    for i, text in enumerate(column):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        out.append(raw)
        size += len(raw)
        if size >= SLICE:
            yield low, out
            low, size, out = i + 1, 0, []
    if out:
        yield low, out


def _ends(texts: Sequence[bytes]) -> list[int]:
    at, out = 0, []
    for t in texts:
        at += len(t)
        out.append(at)
    return out


def occurrences(text: Column, value: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("bigint")


def exposed(
    texts: DataFrame, secrets: DataFrame, keys: Sequence[str] = ("src", "id", "part"), limits: Limits = Limits(), passes: list | None = None
) -> DataFrame:
    """Which texts hold which known values, and how often: ``keys, name, n``. Values stay inside."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    schema, n = f"{kinds}, name string, n bigint", len(keys)

    def finder(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value.index()
            for b in batches:
                rows, names, counts = [], [], []
                for low, part in _slices(b.column(n)):
                    for i, found in enumerate(index.counts(b"".join(part), _ends(part))):
                        for name, count in found.items():
                            rows.append(low + i)
                            names.append(name)
                            counts.append(count)
                if rows:
                    at = pa.array(rows, pa.int64())
                    columns = [*(c.take(at) for c in b.columns[:n]), pa.array(names, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "name", "n"])

        return run

    given = prepare(secrets, limits, texts) if passes is None else passes
    found = texts.sparkSession.createDataFrame([], schema)
    for held in given:
        found = found.unionByName(texts.select(*keys, "text").mapInArrow(finder(held), schema))
    return found.groupBy(*keys, "name").agg(F.sum("n").cast("bigint").alias("n"))


# Redaction --------------------------------------------------------------------------------------


def redact(
    texts: DataFrame, secrets: DataFrame, keys: Sequence[str] = ("src", "id", "part"), limits: Limits = Limits(), passes: list | None = None
) -> DataFrame:
    """Replace every known value by ``***REDACTED(name)***``, longest first, never as a pattern.

    The result is that of one replacement after the other over the whole text, so a later value may match inside an
    earlier marker. Other columns stay; ``keys`` is not needed and may be left out.
    """
    return redact_columns(texts, ["text"], secrets, limits, passes)


def redact_columns(df: DataFrame, columns: Sequence[str], secrets: DataFrame, limits: Limits = Limits(), passes: list | None = None) -> DataFrame:
    """Redact several columns, each on its own, with all secrets."""
    places = [df.columns.index(c) for c in columns]
    out = df
    for held in prepare(secrets, limits, df, columns, redacting=True) if passes is None else passes:
        out = out.mapInArrow(_writer(held, places), df.schema)
    return out


def _writer(held, places: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass of replacements in some columns of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value.index()
        for b in batches:
            arrays = list(b.columns)
            for at in places:
                arrays[at] = redacted_column(index, arrays[at])
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    return run


def redacted_column(index: Index, column: pa.Array, seen: Callable[[bytes], None] | None = None) -> pa.Array:
    """A column with its values replaced; one without any is handed on as it is. ``seen`` gets every state of texts that hold one."""
    new: dict[int, str] = {}
    for low, part in _slices(column):
        new.update((low + i, index.redacted(part[i], seen).decode()) for i in _hit_rows(index, part))
    if not new:
        return column
    return pa.array([new.get(i, t) for i, t in enumerate(column.to_pylist())], column.type)


def _marker(name: Column) -> Column:
    return F.concat(F.lit("***REDACTED("), name, F.lit(")***"))


def _fold(text: Column, ordered: Column) -> Column:
    """Literal replacement one secret after the other; a later value may match inside an earlier marker."""
    return F.aggregate(ordered, text, lambda t, s: F.replace(t, s["value"], _marker(s["name"])))


def redact_detected(texts: DataFrame) -> DataFrame:
    """Replace detected values in place by ``***REDACTED(name:tier)***``, longest first."""
    from exposure.operators.detection import found_hits

    valued = F.filter(
        found_hits("text"), lambda h: h["value"].isNotNull() & (F.length(h["value"]) > 0)
    )
    todo = F.array_sort(F.array_distinct(F.transform(
        valued,
        lambda h: F.struct(
            (-F.length(h["value"])).alias("rank"),
            F.concat(F.coalesce(h["name"], h.form), F.lit(":"), h.tier).alias("name"), h["value"].alias("value"),
        ),
    )))
    return texts.withColumn("text", _fold(F.col("text"), todo))


def residual(
    texts: DataFrame, secrets: DataFrame, keys: Sequence[str] = ("src", "id", "part"), limits: Limits = Limits()
) -> DataFrame:
    """Known values that are still there after redaction; empty when all is well."""
    passes = prepare(secrets, limits, texts, redacting=True)
    return exposed(redact(texts, secrets, keys, limits, passes), secrets, keys, limits, passes)


def dictionary_of(texts: DataFrame) -> DataFrame:
    """Detected values of texts as ``name, value`` (name = a short hash of the value), for redaction.

    A value that stands in several texts comes several times: telling them apart would put values into a shuffle, and
    :func:`prepare` takes each once.
    """
    values = valued_hits(texts).where("value is not null").select("value")
    return values.select(F.substring(F.sha2("value", 256), 1, 12).alias("name"), "value")
