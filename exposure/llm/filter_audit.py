"""How filters interact, from sorted posting lists of the documents that fail them.

One pass over the texts (:func:`judged`) notes for each document which filters it fails, without keeping the text. The notes are dealt by
ranges of ids; within a range and a part, each filter has a sorted list of the places of its failing documents (:func:`postings`), and so
have the good and the toxic documents. These lists are a table of their own, which later audits read in place of the texts. From them
:func:`interactions` computes what any order of the filters removes: the union of the lists before a step by a k-way merge that gallops
over runs, the difference of the step's list and that union, and what of it is good or toxic. Sizes are summed over ranges, so no list
ever leaves its range. :func:`audit` lays the sums out by order and step.

A posting is the document's place in the id order of its range (``ids`` of the same row holds the id at each place), since ids may repeat.

Defined cases: a null or empty text has no words and no characters; it fails A alone, and E where a smaller id has an empty text too. A null
part is the empty string. Ids of any type that can be ordered will do; a null id is neither smaller nor larger than another, so it never
fails E and makes no other document fail it. Repeated rows are documents of their own, which equal ids never make duplicates of each
other. A document without a label is neither good nor toxic; of several labels of one id any 1 counts. An empty table has no rows. Other
columns of the tables are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm.common import discard, kind_of, own_path, save, slices, write

FILTERS = "ABCDE"
#: Documents of one list at most: a longer stretch of ids of one part is several ranges.
RANGE = 1 << 16
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: The second and later bytes of a character in UTF-8.
INNER = bytes(range(0x80, 0xC0))


def fails(raw: bytes) -> int:
    """Filters A to D that a text in UTF-8 fails, as bits from the lowest. ``bytes.split`` cuts at exactly the six white-space characters meant."""
    words = raw.split()
    n, chars = len(words), len(raw.translate(None, INNER))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MAX_CAPITAL_PERCENT * chars) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, row, digest, bits``: what one pass over the whole texts leaves of them. ``row`` tells repeated rows apart."""
    kind = kind_of(docs, id_col)
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("raw"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = b.column(3).to_pylist()
            digest = pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], digest, pa.array(map(fails, raw), pa.int32())], ["id", "part", "row", "digest", "bits"])

    return rows.mapInArrow(run, f"id {kind}, part string, row bigint, digest binary, bits int")


def with_copies(notes: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, part, row, bits``: E in bit 4, good in bit 5, toxic in bit 6.

    The smallest id of each text is a partial aggregate, so a text with very many copies is one row of a task. It is joined on id and digest,
    not on the digest alone: only one id of each text is found, and no key holds many rows.
    """
    firsts = notes.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.select(
        labels[id_col].alias("id"), (labels["quality"] == 1).cast("int").alias("good"), (labels["toxic"] == 1).cast("int").alias("toxic")
    ).where("id IS NOT NULL AND (good = 1 OR toxic = 1)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    found = notes.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    later = (F.col("first").isNull() & F.col("id").isNotNull()).cast("int")
    bits = F.col("bits") + 16 * later + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))
    return found.select("id", "part", "row", bits.cast("int").alias("bits"))


LISTS = [*FILTERS, "good", "toxic"]


def postings(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", longest: int = RANGE
) -> DataFrame:
    """The lists of each part and range of ids: ``part, n, ids`` and, for each of A to E, good and toxic, an ascending array of places in ``ids``."""
    spark, kind = docs.sparkSession, kind_of(docs, id_col)
    at_notes, at_marked = own_path(spark, "judged"), own_path(spark, "marked")
    notes = write(judged(docs, id_col, text_col, part_col), at_notes)
    marked = write(with_copies(notes, labels, id_col), at_marked)
    discard(spark, at_notes)
    # ``row`` lets the bounds of a range cut through an id that is repeated very often
    placed = marked.repartitionByRange("id", "row").sortWithinPartitions("part", "id", "row")

    def row(part: str, ids: list[pa.Array], bits: list[np.ndarray]) -> pa.RecordBatch:
        mask, at = np.concatenate(bits), pa.concat_arrays(ids)
        places = [np.flatnonzero(mask >> k & 1).astype("<i4") for k in range(len(LISTS))]
        lists = [pa.ListArray.from_arrays([0, len(p)], pa.array(p, pa.int32())) for p in places]
        whole = pa.ListArray.from_arrays([0, len(at)], at)
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(mask)], pa.int64()), whole, *lists], ["part", "n", "ids", *LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, bits, held = None, [], [], 0
        for b in batches:
            parts, mask = np.array(b.column(1).to_pylist(), object), b.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for low, high in zip(edges, edges[1:]):
                while low < high:
                    if held and (parts[low] != current or held == longest):
                        yield row(current, ids, bits)
                        ids, bits, held = [], [], 0
                    upto = min(high, low + longest - held)
                    current = parts[low]
                    ids.append(b.column(0).slice(low, upto - low))
                    bits.append(mask[low:upto])
                    held, low = held + upto - low, upto
        if held:
            yield row(current, ids, bits)

    lists = ", ".join(f"{name} array<int>" for name in LISTS)
    kept = save(placed.select("id", "part", "row", "bits").mapInArrow(run, f"part string, n bigint, ids array<{kind}>, {lists}"), "postings")
    discard(spark, at_marked)
    return kept


def gallop(places: Sequence[int], x: int, low: int) -> int:
    """The first index from ``low`` on whose entry is not below ``x``: doubling steps, then bisection of the last one."""
    step, n = 1, len(places)
    high = low
    while high < n and places[high] < x:
        low, high, step = high + 1, high + step, 2 * step
    high = min(high, n)
    while low < high:
        middle = (low + high) // 2
        if places[middle] < x:
            low = middle + 1
        else:
            high = middle
    return low


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """K-way merge of ascending lists: the list that is behind hands over its whole run up to the next one's head, found by galloping."""
    heads = [[p, 0] for p in lists if len(p)]
    out: list[int] = []
    while len(heads) > 1:
        first = min(p[at] for p, at in heads)
        behind = None
        bound = None
        for head in heads:
            x = head[0][head[1]]
            if x == first and behind is None:
                behind = head
            elif bound is None or x < bound:
                bound = x
        places, at = behind
        if bound == first:
            out.append(first)
            for head in heads:
                head[1] += head[0][head[1]] == first
        else:
            behind[1] = gallop(places, bound, at)
            out += places[at : behind[1]]
        heads = [h for h in heads if h[1] < len(h[0])]
    for places, at in heads:
        out += places[at:]
    return out


def minus(places: Sequence[int], others: Sequence[int]) -> list[int]:
    """Entries that ``others`` lacks: both ascend, and each gallops over what the other skips."""
    out: list[int] = []
    at = to = 0
    while at < len(places):
        to = gallop(others, places[at], to)
        if to == len(others):
            out += places[at:]
            break
        if others[to] == places[at]:
            at += 1
        else:
            upto = gallop(places, others[to], at)
            out += places[at:upto]
            at = upto
    return out


def common(places: Sequence[int], others: Sequence[int]) -> int:
    """How many entries both have; the shorter list's entries are looked up in the longer by galloping."""
    short, long = sorted((places, others), key=len)
    n = to = 0
    for x in short:
        to = gallop(long, x, to)
        if to == len(long):
            break
        n += long[to] == x
    return n


def interactions(lists: DataFrame) -> DataFrame:
    """``part, filter, before`` (a set of filters as bits) and, summed over ranges: ``n, removed, kept, fails, good_lost, toxic_lost``.

    ``removed`` is the size of the filter's list minus the union of those in ``before``, ``kept`` what neither holds.
    """
    names = ["part", "filter", "before", "n", "removed", "kept", "fails", "good_lost", "toxic_lost"]
    sets = range(1 << len(FILTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(1)[i].as_py()
                places = [b.column(2 + k)[i].values.to_pylist() for k in range(len(LISTS))]
                good, toxic = places[-2:]
                unions = [union([places[k] for k in range(len(FILTERS)) if s >> k & 1]) for s in sets]
                out = []
                for k, name in enumerate(FILTERS):
                    for s in sets:
                        if not s >> k & 1:
                            lost = minus(places[k], unions[s])
                            kept = n - len(unions[s | 1 << k])
                            out.append((name, s, n, len(lost), kept, len(places[k]), common(lost, good), common(lost, toxic)))
                columns = [pa.array(c, pa.string() if not j else pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(out), pa.string()), *columns], names)

    found = lists.select("part", "n", *LISTS).mapInArrow(
        run, "part string, filter string, before int, n bigint, removed bigint, kept bigint, fails bigint, good_lost bigint, toxic_lost bigint"
    )
    return found.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in names[3:]))


def orders(spark: SparkSession) -> DataFrame:
    """Every step of every order of the filters: ``filter_order, step, filter, before``. 600 rows, whatever the data."""
    rows = [
        ("".join(o), step + 1, o[step], sum(1 << FILTERS.index(f) for f in o[:step]))
        for o in permutations(FILTERS) for step in range(len(FILTERS))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def audit(lists: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` from posting lists."""
    sums = save(interactions(lists), "interactions")
    steps = sums.join(F.broadcast(orders(lists.sparkSession)), ["filter", "before"])
    last = F.when(F.col("step") == len(FILTERS), F.col("removed"))  # then all others came before
    whole = steps.groupBy("part", "filter").agg(F.max(last).alias("unique_fails"), F.sum("removed").alias("shapley"))
    laid_out = steps.join(whole, ["part", "filter"])
    return laid_out.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
