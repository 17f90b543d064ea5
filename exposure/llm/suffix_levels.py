"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes has an anchor: of the places in it where GRAM bytes still fit, the one whose leading GRAM bytes hash lowest (the first of equals). Equal
strings have equal anchors, so suffixes that begin elsewhere need not be kept: a batch's suffix array holds the suffixes at anchors, sorted by
(the hash of) their leading GRAM bytes. New batches are merge-scanned against the levels there are: leading bytes that stand twice in the batch, or in the batch
and a level, may begin a long match. Then the batch becomes a level, and as long as two levels are of one size they are merged, so a
suffix is rewritten once for each doubling of the corpus.

What the scans find is then made exact on the texts. The strings of an anchor are the bytes around it (its context). Contexts that are found twice repeat as a whole. Where
an anchor's leading bytes have several contexts, every string of one of each is hashed, and those found twice repeat: within parts of CLASS contexts first, and where there
are more parts over all of them. Counts are aggregated before each shuffle, so a passage that a third of all documents share is no hot group. Hashes have 64 bits and are compared only for equality of strings of one length.

Defined cases: a null text is the empty one; a text shorter than ``length`` has no match; every row counts as a text of its own, so repeated rows match each
other; null ids stay null; an empty table gives an empty one; other columns are not read. Removing may cut a UTF-8 sequence apart: ``kept`` is bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm.common import discard, kind_of, likely, shared_folder, slices, write

GRAM = 32
#: Bytes looked at together; longer texts are taken in overlapping pieces, with the same anchors.
PIECE = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: Contexts of one anchor's class that are compared in one place (some 40 MB with the hashes of their strings).
CLASS = 4096
#: Bits of the filter that keeps texts without any match out of a shuffle: its size is fixed, whatever the corpus.
FILTER_BITS = 26
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes at every place."""
    h, m, power = _BYTES[x], 1, _ODD
    while m < GRAM:
        h = h[:-m] * power + h[m:]
        m, power = 2 * m, power * power
    h ^= h >> np.uint64(31)
    return h * _ODD


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        key = np.minimum(key[:-m], key[m:])
        m *= 2
    return np.minimum(key[: len(key) - (width - m)], key[width - m :]) if width > m else key


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram, place, first and last start of the strings that each anchor stands for; a long text's pieces may split one anchor's strings."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    strings = len(raw) - length + 1
    with np.errstate(over="ignore"):
        for low in range(0, max(strings, 0), PIECE):
            x = np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - low), low)
            h = gram_hashes(x)
            lowest = window_minima(h & ~PLACE | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
            at = (lowest & PLACE).astype(np.int64)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            for out, values in zip(found, (h[at[first]].view(np.int64), at[first] + low, first + low, last + low)):
                out.append(values)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def doc_key(docs: DataFrame, id_col: str, text_col: str) -> F.Column:
    """The id where ids are whole numbers, all there and all different; else a hash of id and text."""
    if kind_of(docs, id_col) in ("int", "bigint"):
        if docs.where(docs[id_col].isNull()).isEmpty() and docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return F.col(id_col).cast("bigint")
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed(docs: DataFrame, key: F.Column, id_col: str, text_col: str) -> DataFrame:
    """doc, id, raw."""
    return docs.select(key.alias("doc"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))


def suffixes(rows: DataFrame, length: int) -> DataFrame:
    """The sparse suffix array of each task's texts: doc, gram, place, sorted by gram."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches):
            docs, grams, places = [], [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                if len(raw) >= length:
                    gram, place, _, _ = anchors(raw, length)
                    docs.append(np.full(len(gram), i))
                    grams.append(gram)
                    places.append(place)
            if docs:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(grams)), pa.array(np.concatenate(places))], ["doc", "gram", "place"])

    return rows.select("doc", "raw").mapInArrow(run, "doc bigint, gram bigint, place bigint").sortWithinPartitions("gram")


class Levels:
    """The index family in a folder that all executors share: ``add`` takes a batch, ``repeated`` are the leading bytes found twice so far."""

    def __init__(self, spark: SparkSession, length: int, folder: str | None = None):
        self.spark, self.length = spark, length
        self.folder = folder or f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []  # (batches in it, path), largest first
        self.hits: list[str] = []

    def save(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        write(df, path)
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def entries(self) -> DataFrame | None:
        out = None
        for _, path in self.levels:
            out = self.read(path) if out is None else out.union(self.read(path))
        return out

    def add(self, rows: DataFrame) -> None:
        new = self.save(suffixes(rows, self.length), "array")
        scanned = self.read(new).select("gram", F.lit(True).alias("new"))
        if self.levels:
            scanned = scanned.union(self.entries().select("gram", F.lit(False).alias("new")))
        twice = scanned.groupBy("gram").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new").select("gram")
        self.hits.append(self.save(twice, "hits"))
        self.levels.append((1, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels[-2:]
            merged = self.save(self.read(a).union(self.read(b)).repartition("gram", "doc").sortWithinPartitions("gram"), "level")
            self.levels[-2:] = [(n + m, merged)]
            discard(self.spark, a)
            discard(self.spark, b)

    def repeated(self) -> DataFrame:
        out = self.read(self.hits[0])
        for path in self.hits[1:]:
            out = out.union(self.read(path))
        return out.distinct()

    def matches(self) -> DataFrame:
        """doc and the places of its suffixes whose leading bytes are repeated."""
        repeated = self.read(self.save(self.repeated(), "repeated"))  # a table of its own, so that a join can split a hot key
        return self.entries().join(repeated, "gram").groupBy("doc").agg(F.collect_set("place").alias("places"))


def holders(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows whose doc has a match. A filter of fixed size lets few others into the join; it drops none that has one."""
    return likely(rows, matches, "doc", FILTER_BITS).join(matches, "doc")


def contexts(held: DataFrame, length: int) -> DataFrame:
    """gram, context (hash), doc, low, high: the strings low..high of each repeated anchor."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 128):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (raw, places) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                gram, place, low, high = anchors(raw, length)
                keep = np.isin(place, places.values.to_numpy())
                gram, place, low, high = gram[keep], place[keep], low[keep], high[keep]
                context = [xxhash.xxh3_64_intdigest(raw[a : z + length], int(p - a) << 20 | int(z - a)) for p, a, z in zip(place.tolist(), low.tolist(), high.tolist())]
                for to, values in zip(out, (np.full(len(gram), i), gram, np.array(context, np.uint64).view(np.int64), low, high)):
                    to.append(values)
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[1]), pa.array(columns[2]), b.column(0).take(pa.array(columns[0])), pa.array(columns[3]), pa.array(columns[4])], ["gram", "context", "doc", "low", "high"])

    return held.select("doc", "raw", "places").mapInArrow(run, "gram bigint, context bigint, doc bigint, low bigint, high bigint")


def around(held: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, part, shared, doc, low, alone, bytes: the bytes of the wanted contexts."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 64):
            at, rows = [], []
            for i, (raw, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                at += [i] * len(spans)
                rows += [(s["gram"], s["part"], s["shared"], s["low"], s["alone"], raw[s["low"] : s["high"] + length]) for s in spans]
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary())
            gram, part, shared, low, alone, raw = (pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([gram, part, shared, b.column(0).take(pa.array(at, pa.int64())), low, alone, raw], ["gram", "part", "shared", "doc", "low", "alone", "bytes"])

    lists = wanted.groupBy("doc").agg(F.collect_set(F.struct("gram", "part", "shared", "low", "high", "alone")).alias("spans"))
    one = held.select("doc", "raw").dropDuplicates(["doc"]) if held.select("doc", "id").groupBy("doc").count().where("count > 1").limit(1).count() else held.select("doc", "raw")
    return one.join(lists, "doc").select("doc", "raw", "spans").mapInArrow(run, "gram bigint, part int, shared boolean, doc bigint, low bigint, alone boolean, bytes binary")


def found_within(contexts: DataFrame, length: int) -> DataFrame:
    """What the contexts of one part of an anchor's class show: doc, low, high of repeated strings (h is null), and where the class has more parts,
    each string once for a count over all of them (h; ``alone``: not found twice here, so the answer concerns doc and low)."""

    def run(batches: Iterable[pa.RecordBatch]):
        key, group, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] != key:
                    _within(group, length, out)
                    key, group = row[:2], []
                group.append(row)
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        _within(group, length, out)
        yield _batch(out)

    return contexts.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(run, "h bigint, doc bigint, low bigint, high bigint, alone boolean")


def _within(group: list[tuple], length: int, out: list[tuple]) -> None:
    seen: dict[int, int] = {}
    hashed = []
    for row in group:
        view = memoryview(row[6])
        hashes = [xxhash.xxh3_64_intdigest(view[p : p + length]) for p in range(len(view) - length + 1)]
        hashed.append(hashes)
        for h in hashes:
            seen[h] = seen.get(h, 0) + 1
    told = set()
    for (_, _, shared, doc, low, alone, _), hashes in zip(group, hashed):
        first = None
        for p, h in enumerate([*hashes, None]):
            twice = h is not None and seen[h] > 1
            if alone and twice and first is None:
                first = p
            if first is not None and not twice:
                out.append((None, doc, low + first, low + p - 1 + length, None))
                first = None
            if shared and h is not None and h not in told:
                told.add(h)
                out.append((h - (1 << 64) if h >> 63 else h, doc, low + p, low + p + length, alone and not twice))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h", "doc", "low", "high", "alone"])


def repeated_spans(index: Levels, held: DataFrame) -> DataFrame:
    """doc, spans (low, high past the end): byte ranges all of whose bytes lie in a repeated string; they may overlap."""
    length = index.length
    all_contexts = index.read(index.save(contexts(held, length), "contexts"))
    each = all_contexts.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min_by(F.struct("doc", "low", "high"), F.struct("doc", "low")).alias("one"))
    each = index.read(index.save(each, "each"))
    whole = all_contexts.join(each.where("n > 1").select("gram", "context"), ["gram", "context"]).select("doc", F.col("low"), (F.col("high") + length).alias("high"))
    several = each.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    several = index.read(index.save(several, "several"))
    parts = F.ceil(F.col("k") / CLASS).cast("int")
    wanted = each.join(several, "gram").select("gram", F.pmod(F.xxhash64("context"), parts).cast("int").alias("part"), (parts > 1).alias("shared"), "one.doc", "one.low", "one.high", (F.col("n") == 1).alias("alone"))
    found = index.read(index.save(found_within(around(held, wanted, length), length), "found"))
    across = found.where("h is not null")
    twice = across.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    some = found.where("h is null").union(across.where("alone").join(twice, "h").select(*found.columns)).select("doc", "low", "high")
    return whole.union(some).groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["low"], s["high"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(s[1], out[-1][1]))
        else:
            out.append(s)
    return out


def cut(docs: DataFrame, length: int = 200, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", key: F.Column | None = None, as_text: bool = False) -> DataFrame:
    """Rows with a repeated string of ``length`` bytes: doc, id, n_bytes, spans (maximal, from and past the end), kept (the bytes left, or ``as_text`` without half characters); see ``digests`` for all rows."""
    key = doc_key(docs, id_col, text_col) if key is None else key
    index, rows = Levels(docs.sparkSession, length), keyed(docs, key, id_col, text_col)
    step = [k / batches for k in range(1, batches)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc", step or [1.0])).first()[0] or []))[: batches - 1]
    for low, high in zip([None, *bounds], [*bounds, None]):
        batch = rows if low is None else rows.where(F.col("doc") > low)
        index.add(batch if high is None else batch.where(F.col("doc") <= high))
    matches = index.read(index.save(index.matches(), "matches"))
    for _, path in index.levels:  # a standing index would keep them
        discard(index.spark, path)
    held = index.read(index.save(holders(rows, matches), "held"))
    spans = repeated_spans(index, held)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 64):
            kept, maximal = [], []
            for raw, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                spans, at, parts = merged(found), 0, []
                for low, high in spans:
                    parts.append(raw[at:low])
                    at = high
                rest = b"".join([*parts, raw[at:]])
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                maximal.append([{"low": a, "high": z} for a, z in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(r) for r in b.column(2).to_pylist()], pa.int64()), pa.array(maximal, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())], ["doc", "id", "n_bytes", "spans", "kept"])

    done = held.select("doc", "id", "raw").join(spans, "doc").select("doc", "id", "raw", "spans")
    return done.mapInArrow(run, f"doc bigint, id {kind_of(docs, id_col)}, n_bytes bigint, spans array<struct<low: bigint, high: bigint>>, kept {'string' if as_text else 'binary'}")


def digests(docs: DataFrame, length: int = 200, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: n_bytes, n_removed, n_spans, kept_sha256. Texts without a match are hashed where they are read."""
    key = doc_key(docs, id_col, text_col)
    changed = cut(docs, length, batches, id_col, text_col, key)
    changed = changed.select("doc", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    changed = changed.dropDuplicates(["doc"])  # rows of one doc have one text
    rows = keyed(docs, key, id_col, text_col).select("doc", "id", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("whole"))
    out = rows.join(changed, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.col("id").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 200, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated strings taken out of the text; where a cut leaves half a character, that goes too. Columns and rows stay."""
    key = doc_key(docs, id_col, text_col)
    changed = cut(docs, length, batches, id_col, text_col, key, as_text=True).select("doc", F.col("kept").alias("text")).dropDuplicates(["doc"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("doc"))
    out = rows.join(changed, "doc", "left")
    return out.select(*[F.coalesce("text", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
