"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries meet again, and encoded piece by piece.

A text of up to ``chunk_chars`` code points is one chunk. A longer one is cut into chunks that overlap by ``overlap`` code points and are
dealt out as rows. A chunk that begins inside a pre-token soon finds the true boundaries again: from the first boundary in the overlap that
both neighbours have, their pre-tokens agree, since a match depends on nothing before it. There the text is cut. Where an overlap has no
common boundary (one pre-token longer than the overlap), the rest of that text stays one segment, so the ids are always those of the whole text.

Defined cases: a null text is the empty one and has no ids; each input row gives one row, repeated rows and repeated ids too; a null id
stays null; an empty table gives an empty one; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposure.llm.common import Cache, id_and_text, kind_of, slices

#: Below this code point the classes of letters and numbers are the same in every Unicode version in use.
PLAIN_END = 0x250
SPACES = " \\t-\\r\\x85\\xa0"
#: More code points than a match can depend on after its own end (an apostrophe and two letters).
LOOK_AHEAD = 4
BEYOND_PLAIN = re.compile(f"[^\\x00-\\u{PLAIN_END - 1:04x}]")


@lru_cache
def plain_class(first: str) -> str:
    """The characters below PLAIN_END of one general category (``L`` or ``N``), for a class of ``re``."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == first)


@lru_cache
def plain_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for ``re``, right on texts without a character from PLAIN_END on; several times as fast as a general engine."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{plain_class('L')}{plain_class('N')}]")
    inside = inside.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    inside = inside.replace(r"\p{L}", f"[{plain_class('L')}]").replace(r"\p{N}", f"[{plain_class('N')}]")
    return re.compile(inside.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))


def pre_tokens(text: str, pattern: str) -> list[str]:
    """Every match of ``pattern``, in order."""
    if BEYOND_PLAIN.search(text):
        import regex

        return regex.findall(pattern, text)
    return plain_pattern(pattern).findall(text)


@lru_cache
def by_id(vocabulary: str) -> list[bytes | None]:
    """The bytes of each id."""
    with open(vocabulary, "rb") as lines:
        ranks = {int(i): base64.b64decode(raw) for raw, i in map(bytes.split, lines)}
    return [ranks.get(i) for i in range(max(ranks) + 1)]


@lru_cache
def coder(vocabulary: str, pattern: str):
    """Once a worker: the ids of a pre-token as bytes (little-endian, 32 bits), cached."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={raw: i for i, raw in enumerate(by_id(vocabulary)) if raw is not None}, special_tokens={})
    return Cache(lambda piece: np.array(encoding._encode_single_piece(piece), "<u4").tobytes(), 200_000)


def encode_text(text: str, vocabulary: str, pattern: str) -> bytes:
    return b"".join(map(coder(vocabulary, pattern).__getitem__, pre_tokens(text, pattern)))


def boundaries(text: str, pattern: str, start: int, low: int, high: int, to_end: bool) -> list[int]:
    """Where pre-tokens of a chunk begin, within low..high. Near its end (LOOK_AHEAD, and the last one's end) only those at the end of the text are certain.

    A boundary behind white space is left out: how a run of it splits depends on what follows, which a segment that ends there has not.
    """
    at, found, last = start, [], "x"
    high = high if to_end else min(high, start + len(text) - LOOK_AHEAD)
    for piece in pre_tokens(text, pattern):
        if low <= at <= high and not last.isspace():
            found.append(at)
        at, last = at + len(piece), piece[-1]
    return found + [at] if to_end and low <= at <= high and not last.isspace() else found


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """One row for each document: id_col and ``ids`` (binary: unsigned, 32 bits, little-endian)."""
    kind = kind_of(docs, id_col)
    rows = id_and_text(docs, id_col, text_col)

    def whole(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode_text(t, vocabulary, pattern) for t in b.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    short = rows.where(F.char_length("text") <= chunk_chars).mapInArrow(whole, f"id {kind}, ids binary")
    long = rows.where(F.char_length("text") > chunk_chars).withColumn("h", F.xxhash64("text"))
    return short.unionByName(_encode_long(long, kind, vocabulary, pattern, chunk_chars, overlap)).withColumnRenamed("id", id_col)


def _encode_long(long: DataFrame, kind: str, vocabulary: str, pattern: str, size: int, overlap: int) -> DataFrame:
    def cut(batches):
        for b in slices(batches):
            for key, text, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                starts = range(0, len(text), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(starts), b.schema.field(0).type), pa.array([h.as_py()] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int64()),
                     pa.array([s + size + overlap >= len(text) for s in starts]), pa.array([text[s : s + size + overlap] for s in starts], pa.string())],
                    ["id", "h", "seq", "at_end", "body"])

    def ends(batches):
        for b in slices(batches):
            head, tail = [], []
            for seq, at_end, body in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                start = seq * size
                head.append(boundaries(body, pattern, start, start, start + overlap, at_end))
                tail.append(boundaries(body, pattern, start, start + size, start + size + overlap, at_end))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["id", "h", "seq", "head", "tail"])

    def codes(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([encode_text("".join(p), vocabulary, pattern) for p in b.column(3).to_pylist()], pa.binary())], ["id", "h", "segment", "ids"])

    def joined(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([b"".join(p) for p in b.column(2).to_pylist()], pa.binary())], ["id", "h", "ids"])

    key = ["id", "h"]
    # equal rows are encoded once; the shuffle that finds them deals the chunks out
    chunks = long.select("id", "text", "h").mapInArrow(cut, f"id {kind}, h bigint, seq bigint, at_end boolean, body string").groupBy(*key, "seq").agg(F.first("at_end").alias("at_end"), F.first("body").alias("body"))
    seen = chunks.select("id", "h", "seq", "at_end", "body").mapInArrow(ends, f"id {kind}, h bigint, seq bigint, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy(*key).orderBy("seq")
    met = seen.withColumn("before", F.lag("tail").over(order)).withColumn("cut", F.when(F.col("seq") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before"))))
    # once neighbours have not met, later boundaries are not proven
    met = met.withColumn("proven", F.min(F.col("cut").isNotNull()).over(order)).withColumn("cut", F.when(F.col("proven"), F.col("cut")))
    cuts = met.select(*key, "seq", F.sum(F.col("proven").cast("int")).over(order).alias("segment"), F.coalesce("cut", F.col("seq") * size).alias("low"), F.lead(F.coalesce("cut", F.col("seq") * size)).over(order).alias("high"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "seq")]
    parts = chunks.alias("a").join(cuts.alias("b"), same[0] & same[1] & same[2]).select(
        "a.id", "a.h", "b.segment", "a.seq",
        F.substring(F.col("a.body"), F.col("low") - F.col("a.seq") * size + 1, F.coalesce(F.col("high") - F.col("low"), F.lit(size + overlap))).alias("part"))
    segments = parts.groupBy(*key, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda p: p["part"]).alias("parts"))
    ids = segments.mapInArrow(codes, f"id {kind}, h bigint, segment bigint, ids binary")
    whole = ids.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "ids"))), lambda p: p["ids"]).alias("all")).mapInArrow(joined, f"id {kind}, h bigint, ids binary")
    copies = long.groupBy(*key).agg(F.count("*").cast("int").alias("copies"))
    out = whole.alias("a").join(copies.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h")))
    return out.select("a.id", "a.ids", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def decode_ids(ids: bytes, vocabulary: str) -> bytes:
    """The raw bytes of the ids, concatenated; they need not be valid UTF-8 in between."""
    return b"".join(map(by_id(vocabulary).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` (binary) in place of the ids."""
    rest = [c for c in encoded.columns if c not in (ids_col, out_col)]

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([decode_ids(i, vocabulary) for i in b.column(0).to_pylist()], pa.binary())], [*rest, out_col])

    schema = "".join(f"`{c}` {kind_of(encoded, c)}, " for c in rest)
    return encoded.select(ids_col, *rest).mapInArrow(run, f"{schema}`{out_col}` binary")


def digests(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of the ids and of the bytes that they decode to."""

    def run(batches):
        for b in slices(batches):
            count, of_ids, of_bytes = [], [], []
            for ids in b.column(1).to_pylist():
                numbers = np.frombuffer(ids, "<u4").tolist()
                count.append(len(numbers))
                of_ids.append(hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode_ids(ids, vocabulary)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind_of(encoded, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
