"""Token ids on disk as wavelet matrices: one compressed file a shard that answers access, counting and occurrence lookup.

A shard holds the ids of consecutive documents. Its ids are written bit by bit, from the highest bit: each bit-plane lists that bit of every
id in the plane's order, then ids with a 0 move, in order, before those with a 1, which is the order of the next plane. With the number of
ones before any place (rank) and the place of any one (select), a query walks one plane after the other: the id at a place, how often an id
occurs in a stretch, where its k-th occurrence is. Each plane is cut into blocks of ``BLOCK`` bits that are compressed alone, with the ones before
each block in a directory, so a query unpacks one block a plane and not the file.

A file is: ``MAGIC``, the length of a JSON header, the header, then its parts at the offsets it names: the documents (ids of any type and
lengths, as Arrow), the directory of each plane, the blocks. Files are written by Spark's text writer, one row a file, so they go
through its commit protocol to any file system it knows (a retried task leaves no half file) and each ends with a line feed that the header
does not count. Spark's binary reader reads them back, one file a row.

Defined cases: a null or empty text is the end id alone; rows are in ascending order of id, nulls first, rows of one id in the order of their
text's hash; each row is a document, repeated rows too. A document never spans two shards, so one longer than a shard makes a longer one.
Texts of any length are encoded whole. An empty table gives no files, and a reader of no files no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposure.llm.bpe import pre_tokens
from exposure.llm.common import Cache, discard, id_and_text, kind_of, own_path, shuffles_freed, slices, write

MAGIC = b"WAVM\x01"
#: Bits of a plane that are compressed together.
BLOCK = 1 << 16
#: Tokens of a shard, from which on it takes no more documents.
SHARD = 1 << 22
#: Texts longer than this (code points) are pre-tokenised apart, piece by piece: one run of a hundred thousand spaces or letters costs no more than others.
LONG = 100_000


# --- ids of texts -----------------------------------------------------------------------------------------------------------------------


class Ids:
    """Ids of a text by a ``tokenizers`` file, without special tokens added.

    For byte-level files whose merges make ids in ascending order, as usual, ids are ranks, and ``tiktoken`` gives the same ids in a fifth of
    the time. Other files go through their own library. Added tokens in a text are cut out first, as the library does.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library, self.pattern = Tokenizer.from_file(path), pattern
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.ranks = self._ranks(spec)
        if self.ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
            self.pieces = Cache(lambda piece: self.fast._encode_single_piece(piece), 100_000)

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        model, level = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model["type"] == "BPE" and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space")
            and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or [])
        )
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        if not plain or None in made or made != sorted(set(made)):
            return None
        itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(itself))}
        return {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}

    def _plain(self, text: str) -> list[int]:
        if not self.ranks:
            return self.library.encode(text, add_special_tokens=False).ids
        if len(text) <= LONG:
            return self.fast.encode_ordinary(text)
        return [i for piece in pre_tokens(text, self.pattern) for i in self.pieces[piece]]

    def __call__(self, text: str) -> list[int]:
        if not self.ranks or self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part:
                out += [self.added[part]] if part in self.added else self._plain(part)
        return out


@lru_cache(2)
def ids_of(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


# --- one file ---------------------------------------------------------------------------------------------------------------------------


def _stream(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def pack(tokens: np.ndarray, documents: pa.RecordBatch, **notes: int) -> bytes:
    """The file of one shard. ``documents`` has ``id`` and ``n_tokens``; ``notes`` go into the header."""
    n = len(tokens)
    depth = max(1, int(tokens.max()).bit_length() if n else 1)
    now = tokens.astype(np.uint16 if depth <= 16 else np.uint32)
    parts, planes, fast = [zlib.compress(_stream(documents), 6)], [], zstandard.ZstdCompressor(1)
    for bit in range(depth - 1, -1, -1):
        ones = (now >> bit & 1).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        low = range(0, len(bits), BLOCK // 8)
        blocks = [fast.compress(bits[i : i + BLOCK // 8].tobytes()) for i in low]
        counts = np.bitwise_count(bits).astype(np.int64)
        before = np.r_[0, np.cumsum(np.add.reduceat(counts, list(low)))] if n else np.zeros(1, np.int64)
        sizes = np.r_[0, np.cumsum([len(b) for b in blocks])]
        directory = zlib.compress(np.r_[before, sizes].astype("<i8").tobytes(), 6)
        planes.append([len(directory), int(sizes[-1])])
        parts += [directory, *blocks]
        now = np.concatenate([now[~ones], now[ones]])
    header = {**notes, "n": n, "depth": depth, "documents": len(parts[0]), "planes": planes}
    raw = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(raw)), raw, *parts])


class Plane:
    """One bit-plane: rank, select and the bit at a place. Blocks are unpacked when they are asked for."""

    def __init__(self, raw: memoryview, n: int, directory: bytes):
        both = np.frombuffer(zlib.decompress(directory), "<i8")
        blocks = len(both) // 2 - 1
        self.raw, self.n, self.before, self.at = raw, n, both[: blocks + 1], both[blocks + 1 :]
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones
        self.unpack = zstandard.ZstdDecompressor()
        self.blocks = Cache(self._block, 64)

    def _block(self, k: int) -> np.ndarray:
        packed = np.frombuffer(self.unpack.decompress(self.raw[self.at[k] : self.at[k + 1]]), np.uint8)
        return np.unpackbits(packed, count=min(BLOCK, self.n - k * BLOCK), bitorder="little")

    def bits(self) -> np.ndarray:
        return np.concatenate([self._block(k) for k in range(len(self.at) - 1)]).astype(bool) if self.n else np.zeros(0, bool)

    def bit(self, place: int) -> int:
        return int(self.blocks[place // BLOCK][place % BLOCK])

    def rank(self, place: int) -> int:
        """Ones before ``place``."""
        k, rest = divmod(place, BLOCK)
        return int(self.before[k]) + (int(self.blocks[k][:rest].sum()) if rest else 0)

    def select(self, bit: int, k: int) -> int:
        """The place of the ``k``-th (from 0) ``bit``."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * BLOCK, self.n) - self.before
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self.blocks[block] == bit)[k - int(before[block])])


class Matrix:
    """A shard's file, opened. Places and counts are from 0."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack_from("<I", raw, len(MAGIC))
        at = len(MAGIC) + 4 + size
        self.header = json.loads(raw[at - size : at])
        self.n, self.depth = self.header["n"], self.header["depth"]
        self._documents = view[at : at + self.header["documents"]]
        at += self.header["documents"]
        self.planes: list[Plane] = []
        for directory, blocks in self.header["planes"]:
            self.planes.append(Plane(view[at + directory : at + directory + blocks], self.n, bytes(view[at : at + directory])))
            at += directory + blocks

    def documents(self) -> pa.RecordBatch:
        with pa.ipc.open_stream(zlib.decompress(self._documents)) as stream:
            return stream.read_next_batch()

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        token = 0
        for plane in self.planes:
            bit, ones = plane.bit(place), plane.rank(place)
            token, place = 2 * token + bit, plane.zeros + ones if bit else place - ones
        return token

    def _stretch(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the ids of a stretch that equal ``token`` stand in the order below the last plane."""
        if token < 0 or token >> self.depth:
            return 0, 0
        for k, plane in enumerate(self.planes):
            a, b = plane.rank(low), plane.rank(high)
            low, high = (plane.zeros + a, plane.zeros + b) if token >> (self.depth - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs in places low to high (exclusive)."""
        first, last = self._stretch(token, low, self.n if high is None else high)
        return last - first

    def occurrence(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence of an id; -1 where there are not so many."""
        first, last = self._stretch(token, 0, self.n)
        if not 0 <= k < last - first:
            return -1
        place = first + k
        for level in range(self.depth - 1, -1, -1):
            plane = self.planes[level]
            bit = token >> (self.depth - 1 - level) & 1
            place = plane.select(bit, place - plane.zeros if bit else place)
        return place

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each moves its ids back to where they were."""
        now = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for level in range(self.depth - 1, -1, -1):
            plane = self.planes[level]
            ones = plane.bits()
            above = np.empty_like(now)
            above[~ones] = now[: plane.zeros]
            above[ones] = now[plane.zeros :] | now.dtype.type(1 << (self.depth - 1 - level))
            now = above
        return now.astype("<u4")


# --- files of a table -------------------------------------------------------------------------------------------------------------------


def write_files(
    docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD
) -> None:
    """A table of documents into files under ``folder``: texts are dealt by ranges of ids and sorted, and each range is encoded and cut into shards.

    Finding the bounds of the ranges reads the table once more; texts are encoded once, behind the shuffle, so ids never lie anywhere but in the files.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    placed = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text", F.spark_partition_id().alias("part"))

    def shard(ids: list[pa.Array], tokens: list[np.ndarray], part: int, seq: int) -> pa.RecordBatch:
        lengths = pa.array([len(t) for t in tokens], pa.int64())
        documents = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), lengths], ["id", "n_tokens"])
        content = pack(np.concatenate(tokens), documents, part=part, seq=seq)
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, size, seq, part = [], [], 0, 0, 0
        for b in slices(batches):
            code, low = ids_of(tokenizer, pattern), 0
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*code(text), end_id], "<u4")
                if size and size + len(ids) > shard_tokens:
                    if i > low:
                        held.append(b.column(0).slice(low, i - low))
                    yield shard(held, tokens, part, seq)
                    held, tokens, size, seq, low = [], [], 0, seq + 1, i
                tokens.append(ids)
                size += len(ids)
                part = b.column(2)[0].as_py()
            if b.num_rows > low:
                held.append(b.column(0).slice(low))
        if tokens:
            yield shard(held, tokens, part, seq)

    files = placed.mapInArrow(run, "content binary")
    with shuffles_freed(docs.sparkSession):
        files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file: ``path, length, content`` (and the time of its last change). The empty file that a writer leaves of no rows is none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).where(F.col("length") > len(MAGIC))


def read_documents(files: DataFrame, kind: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id_col, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = Matrix(batch.column(0)[i].as_py())
                documents, tokens = m.documents(), m.tokens()
                ends = np.cumsum(documents.column(1).to_numpy())
                starts = ends - documents.column(1).to_numpy()
                crc = [zlib.crc32(tokens[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
                same = lambda v: pa.array([v] * len(documents), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [same(m.header["part"]), same(m.header["seq"]), documents.column(0), pa.array(starts), documents.column(1), pa.array(crc, pa.int64())],
                    ["part", "seq", "id", "place", "n_tokens", "ids_crc32"],
                )

    found = files.select("content").mapInArrow(run, f"part int, seq int, id {kind}, place bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumnRenamed("id", id_col)


def with_starts(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Places in a shard become starts in the corpus: shards are summed within their range of ids, ranges among each other."""
    shards = read.groupBy("part", "seq").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    # a row for each range of ids, as many as the shuffle has partitions
    parts = shards.groupBy("part").agg(F.sum("size").alias("whole"))
    parts = parts.select("part", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bases = shards.join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("base"))
    return read.join(bases, ["part", "seq"]).select(id_col, (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(
    docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD
) -> DataFrame:
    """Encode a table, write its files, and return what they hold: id_col, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder, at_read = own_path(spark, "shards"), own_path(spark, "read")
    write_files(docs, folder, tokenizer, pattern, end_id, id_col, text_col, shard_tokens)
    read = write(read_documents(read_files(spark, folder), kind_of(docs, id_col), id_col), at_read)
    discard(spark, folder)
    return with_starts(read, id_col)
