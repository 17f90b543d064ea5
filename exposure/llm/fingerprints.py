"""Document fingerprints: improbable byte windows, inserted into chained Bloom filters, compared by normalised bit overlap.

Each byte window of ``WINDOW`` bytes has a Shannon entropy. How often each (quantised) entropy occurs is counted over the whole corpus; the rarer, the
better a window's rank. In each run of ``RUN`` consecutive windows the best-ranked (the first of equals) scores a point, and windows with
``POINTS`` or more are the features of a text. Distinct features go, in order, into Bloom filters of ``BITS`` bits; a filter takes ``FILL``
features, then the next is begun. Two chains are as alike as the filters of the shorter find counterparts in the other: of the bits
that could be shared beyond chance, the part that is.

A text with no feature (shorter than a window, or nothing but monotonous bytes) has one: its whole content. The empty text has none: it is like the
empty text (1.0) and unlike others (0.0). A null text is the empty one. Each row gives one row, repeated rows and null ids (which come last) too; an
empty table gives an empty one; other columns are not read. Equal texts have equal fingerprints under one rarity table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import id_and_text, kind_of, shuffle_partitions, slices

WINDOW, RUN, POINTS = 64, 64, 16
BITS, HASHES, FILL = 2048, 5, 160
SHIFT, LEAST_ENTROPY = 9, 2.0
#: Bytes looked at together; longer texts are taken in pieces that overlap enough to give the same windows.
PIECE = 1 << 16
#: Bits for a place in bytes looked at together.
PLACE = 20
MASK = (1 << PLACE) - 1
LOWEST = -(1 << 63)

_SUMS = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 1024).astype(np.int64)
_GAIN = np.diff(_SUMS).astype(np.int32)
_MOST = int(_SUMS[WINDOW])
BINS = _MOST >> SHIFT
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def entropy_bins(x: np.ndarray) -> np.ndarray:
    """The quantised entropy (0 to BINS) of every window of the bytes ``x``."""
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    back, fore = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):  # how often a byte stands among the WINDOW - 1 before it and behind it
        same = (x[k:] == x[:-k]).view(np.uint8)
        back[k:] += same
        fore[:-k] += same
    gained, lost = np.cumsum(_GAIN[back], dtype=np.int32), np.cumsum(_GAIN[fore], dtype=np.int32)  # sums wrap, their difference does not
    sums = gained[WINDOW - 1 :].copy()
    sums[1:] -= lost[: n - WINDOW]
    return (_MOST - sums) >> SHIFT


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy bin: rarer ones first, ties to the higher entropy; -1 for monotonous windows, which are no features."""
    order = np.lexsort((-np.arange(BINS + 1), counts))
    out = np.empty(BINS + 1, np.int32)
    out[order] = np.arange(BINS + 1)
    out[np.arange(BINS + 1) < LEAST_ENTROPY / np.log2(WINDOW) * BINS] = -1
    return out


def selected(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The start of each feature, for each text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, int, int, bytes]] = []  # text, first window of the piece, first window that counts here, bytes
    size = 0

    def flush():
        nonlocal group, size
        if group:
            x = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
            key = rank[entropy_bins(x)]
            key = np.where(key < 0, np.int32(BINS + 1), key) << PLACE | np.arange(len(key), dtype=np.int32)
            runs, step = key, 1
            while step < RUN:
                runs = np.minimum(runs[:-step], runs[step:]) if len(runs) > step else runs[:0]
                step *= 2
            at = 0
            for text, first, counted, raw in group:
                windows = len(raw) - WINDOW + 1
                if windows >= RUN:
                    best = runs[at : at + windows - RUN + 1]
                    best = best[best >> PLACE <= BINS] & MASK
                    # the first best place never moves back from one run to the next, so equal ones are neighbours
                    new = np.flatnonzero(np.diff(best, prepend=-1))
                    where = best[new[np.diff(new, append=len(best)) >= POINTS]] - at
                else:
                    best = key[at : at + windows].min()
                    where = np.array([(best & MASK) - at] if best >> PLACE <= BINS else [], np.int64)
                found[text].append(where[(where >= counted - first) & (where < counted - first + PIECE)] + first)
                at += len(raw)
        group, size = [], 0

    for i, raw in enumerate(texts):
        windows = len(raw) - WINDOW + 1
        for counted in range(0, windows, PIECE):
            first = max(0, counted - RUN)
            part = raw[first : counted + PIECE + RUN + WINDOW]
            group.append((i, first, counted, part))
            size += len(part)
            if size >= PIECE:
                flush()
    flush()
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def fingerprints_of(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of each text: one row of BITS / 8 bytes for each Bloom filter."""
    starts = selected(texts, rank)
    raw = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    places = np.concatenate([s + e - len(t) for s, e, t in zip(starts, ends, texts)]) if texts else np.zeros(0, np.int64)
    h = np.zeros(len(places), np.uint64)
    if len(places):
        words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), WINDOW)[places].view("<u8")
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * _PRIME
            h ^= h >> np.uint64(29)
    whole = [i for i, (t, s) in enumerate(zip(texts, starts)) if t and not len(s)]  # no feature: the content itself is one
    owner = np.concatenate([owner, np.array(whole, owner.dtype)])
    h = np.concatenate([h, np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in whole], np.uint64)])
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    owner, h = owner[~again], h[~again]
    order = np.argsort(owner, kind="stable")
    owner, h = owner[order], h[order]
    n = np.bincount(owner, minlength=len(texts))
    chain = -(-n // FILL)
    base = np.cumsum(chain) - chain
    which = base[owner] + (np.arange(len(h)) - (np.cumsum(n) - n)[owner]) // FILL
    bits = np.zeros((int(chain.sum()), BITS), bool)
    for k in range(HASHES):
        bits[which, (h >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + c] for b, c in zip(base, chain)]


def spelt(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Filters of the shorter chain are held against all of the other; for equal lengths it is the mean of both ways."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) == len(b):
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(*sorted((a, b), key=len))


def _one_way(short: np.ndarray, long: np.ndarray) -> float:
    s, o = short.view("<u8"), long.view("<u8")
    ones, theirs = np.bitwise_count(s).sum(1).astype(np.float64), np.bitwise_count(o).sum(1).astype(np.float64)
    total = 0.0
    for i in range(len(s)):
        shared = np.bitwise_count(s[i] & o).sum(1)
        most, chance = np.minimum(ones[i], theirs), ones[i] * theirs / BITS
        floor = chance + 0.3 * (most - chance)
        total += ones[i] * float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / ones.sum()


def rarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The rank table, from the entropies of all windows of all texts; BINS + 1 sums reach the driver."""

    def run(batches):
        counts = np.zeros(BINS + 1, np.int64)
        for b in batches:
            held, size = [], 0
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                for low in range(0, max(len(raw) - WINDOW + 1, 0), PIECE):
                    held.append(raw[low : low + PIECE + WINDOW - 1])
                    size += len(held[-1])
                    if size >= PIECE:
                        counts += _counted(held)
                        held, size = [], 0
            counts += _counted(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS + 1), pa.int32()), pa.array(counts)], ["bin", "n"])

    rows = id_and_text(docs, id_col, text_col).select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS + 1, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return ranks(counts)


def _counted(pieces: list[bytes]) -> np.ndarray:
    counts = np.zeros(BINS + 1, np.int64)
    if pieces:
        bins, at = entropy_bins(np.frombuffer(b"".join(pieces), np.uint8)), 0
        inside = np.zeros(len(bins), bool)
        for p in pieces:
            inside[at : at + len(p) - WINDOW + 1] = True
            at += len(p)
        counts += np.bincount(bins[inside], minlength=BINS + 1)
    return counts


def fingerprint(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint: one row for each document, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            chains = fingerprints_of([t.encode() for t in texts], rank)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([spelt(c) for c in chains], pa.string())], [id_col, "n_chars", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_of(docs, id_col)}, n_chars bigint, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``id, text, bucket, tail`` in descending id within buckets of consecutive ids; the last row of a bucket (``tail``) is the first of the next.

    The bounds of the buckets are ids that exist, so the first row of a bucket is known by its id: each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("place", F.coalesce(F.col("id").cast("bigint"), F.lit(LOWEST)))
    n = 8 * shuffle_partitions(spark)
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), [(k + 1) / n for k in range(n)], 100 * n).alias("p"), F.max(F.col(id_col).cast("bigint")).alias("top")).first()
    bounds = np.array(sorted({*(found["p"] or []), found["top"] if found["top"] is not None else LOWEST}), np.int64)  # 8 for each shuffle partition at most

    @F.pandas_udf("int")
    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy()).astype(np.int32))

    @F.pandas_udf("boolean")
    def is_bound(place: pd.Series) -> pd.Series:
        return pd.Series(np.isin(place.to_numpy(), bounds))

    rows = rows.withColumn("own", bucket_of("place")).withColumn("first", is_bound("place"))
    after = F.when(F.col("own") == len(bounds) - 1, 0).otherwise(F.col("own") + 1)
    here = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("tail"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("first"), F.array(here, F.struct(after.alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(here))))
    dealt = dealt.select("id", "text", "to.bucket", "to.tail", "place").repartition(shuffle_partitions(spark), "bucket")
    return dealt.sortWithinPartitions("bucket", "tail", F.desc("place"), F.col("id").isNull(), F.desc(F.xxhash64("text"))).drop("place")


def edited_likeness(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text (the last third from the start of the next document in descending id) and against that next document."""

    def run(batches: Iterable[pa.RecordBatch]):
        held: tuple | None = None  # the row before, still without its next
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            buckets, tails = b.column(2).to_pylist(), b.column(3).to_pylist()
            chains = fingerprints_of([t.encode() for t in texts], rank)
            out, edits, pairs = [], [], []
            for row in zip(ids, texts, buckets, tails, chains):
                if held is not None and held[2] == row[2] and not held[3]:
                    text, k = held[1], len(held[1]) // 3
                    edits.append((text[: len(text) - k] + row[1][:k]).encode())
                    pairs.append((held, row[4]))
                held = row
            for (own, after), raw, chain in zip(pairs, edits, fingerprints_of(edits, rank)):
                out.append((own[0], len(own[1]), hashlib.sha256(raw).hexdigest(), spelt(own[4]), spelt(chain), likeness(own[4], chain), likeness(own[4], after)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], TYPES))], [id_col, *NAMES])

    schema = f"`{id_col}` {kind_of(docs, id_col)}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, schema)


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
