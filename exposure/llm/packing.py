"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``max_tokens`` tokens. Only the count of pieces of each length goes to the driver (at most ``max_tokens``
numbers, however large the corpus), where best-fit in descending length runs over counts: runs of sequences with equal room take runs of pieces.
The plan is a list of slots (length, rank within length) -> (sequence, offset), whose size depends on the lengths and not on the documents.
Pieces are ranked within their length without gathering a length in one task, and take their slot by an equi-join on (length, rank).

Defined cases: a null or empty text is the end token alone; each row is packed, repeated rows and null ids too; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposure.llm.bpe import plain_pattern
from exposure.llm.common import Cache, id_and_text, kind_of, save, shuffle_partitions, slices

#: Slots that one row of the plan becomes in one step.
STEP = 10_000
#: Beyond these characters lower case and composition are left to the tokenizer.
BEYOND_LATIN = re.compile("[^\\x00-įı-ſ]")


@lru_cache
def byte_characters() -> dict[int, str]:
    """A printable character for each byte, as byte-level vocabularies write them: printable Latin-1 stands for itself, the rest from 256 on."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(itself)]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """Ids of a text, without special tokens added; those that stand in a text are the ids that the library gives them.

    Where the file says that words are split by a pattern after lower-casing, ids of a word are cached; other files, and texts with an added token in
    them, go through whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        # those that are looked for behind the normalizer may be spelt otherwise before it
        fold = re.IGNORECASE if any(t["normalized"] for t in added) else 0
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)", fold)
        self.pattern, self.words = self._split(spec), Cache(self._word, 200_000)

    @staticmethod
    def _split(spec: dict) -> str | None:
        steps = [(s["type"], s.get("content")) for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != [("NFC", None), ("Replace", " "), ("Lowercase", None)] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            return None
        split, level = cuts
        plain = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        return split["pattern"].get("Regex") if plain else None

    def _word(self, word: str) -> bytes:
        spelt = "".join(map(byte_characters().__getitem__, word.encode()))
        return np.array([t.id for t in self.whole.model.tokenize(spelt)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.pattern is None or BEYOND_LATIN.search(text) or self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, plain_pattern(self.pattern).findall(text.lower())))


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, and a ``deal`` (0 to 255) that spreads the rows of any length evenly."""
    kind = kind_of(docs, id_col)

    def run(batches: Iterable[pa.RecordBatch]):
        end, dealt = np.array([end_id], "<u4").tobytes(), 0
        for b in slices(batches):
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = tokens(tokenizer).ids(text) + end
                for n, low in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[low : low + 4 * max_tokens]
                    at.append(i)
                    out.append((n, low // 4, len(part) // 4, zlib.crc32(part), dealt % 256))
                    dealt += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], ["id", "piece", "start", "length", "ids_crc32", "deal"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, deal int")


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit over counts: rows (length, first rank, n, first sequence, offset): n pieces take n sequences in a row, each at ``offset``."""
    open_by: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []
    out, next_sequence = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in open_by:
                open_by[left] = []
                bisect.insort(rooms, left)
            open_by[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, n = open_by[left].pop()
                if not open_by[left]:
                    del open_by[left]
                    rooms.pop(k)
            else:
                left, first, n = room, next_sequence, -(-todo // (room // length))
                next_sequence += n
            each = left // length
            full = min(n, todo // each)
            # best-fit goes on with the same sequence until a piece of this length no longer fits
            for run, per in ((full, each), (1 if full < n and todo > full * each else 0, todo - full * each)):
                if run:
                    for j in range(per):
                        out.append((length, rank, run, first, room - left + j * length))
                        rank += run
                    todo -= run * per
                    put(left - per * length, first, run)
                    first, n = first + run, n - run
            put(left, first, n)
    return out


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    found = save(pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    slots = spark.createDataFrame(plan(counts, max_tokens), "length bigint, first_rank bigint, n bigint, first_sequence bigint, offset bigint")
    # rows of the plan into steps, steps into slots, so that no task makes all slots of a frequent length
    steps = slots.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP)))).repartition(shuffle_partitions(spark))
    at = F.explode(F.sequence("step", F.least(F.col("step") + STEP, F.col("n")) - 1))
    slots = steps.withColumn("at", at).select("length", (F.col("first_rank") + F.col("at")).alias("rank"), (F.col("first_sequence") + F.col("at")).alias("sequence_id"), "offset")

    of_length = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("length", "deal").agg(F.count("*").alias("m")).select("length", "deal", F.coalesce(F.sum("m").over(of_length), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "deal").orderBy("id", "piece"))
    ranked = found.withColumn("within", within).join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.join(slots, ["length", "rank"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
