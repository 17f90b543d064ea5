"""Order-aware operators that stay distributed when one key holds a third of all rows.

A window over a whole key is one task. Here rows are dealt by ranges of (key, order), so a key, or one instant of
it, takes as many tasks as its rows need; what a range inherits comes from a small table with one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.session import checkpoint, store


def _last_before(
    batches: Iterator[pa.RecordBatch], n_keys: int, n_carried: int, inclusive: bool
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[pa.Array], list[pa.Array]]]:
    """Per batch of one sorted range: which rows belong to its first key, and for each carried column the latest
    value before each row (``inclusive``: up to it) and the latest one at the end of the batch.

    The first ``n_keys`` columns are the key, the last ``n_carried`` what is carried.
    """
    key: list | None = None
    held: list[pa.Array] = []
    first = True
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        fresh = np.zeros(n, bool)
        for c in b.columns[:n_keys]:
            codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh[1:] |= codes[1:] != codes[:-1]
        now = [c.slice(0, 1).to_pylist() for c in b.columns[:n_keys]]
        fresh[0] = key is not None and now != key
        key = [c.slice(n - 1, 1).to_pylist() for c in b.columns[:n_keys]]
        head = np.cumsum(fresh) == 0 if first else np.zeros(n, bool)
        first = first and bool(head[-1])
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(fresh, place, -1))  # -1: the key goes on from the batch before
        found, ends = [], []
        for k, c in enumerate(b.columns[len(b.columns) - n_carried :]):
            latest = np.maximum.accumulate(np.where(c.is_valid().to_numpy(zero_copy_only=False), place, -1))
            seen = latest if inclusive else np.r_[-1, latest[:-1]]
            before = held[k] if held else pa.nulls(1, c.type)
            pool = pa.concat_arrays([c, before])  # place n: what the batch before left
            at = np.where((seen >= start) & (seen >= 0), seen, n)
            found.append(pool.take(pa.array(at, mask=(at == n) & (start >= 0))))
            last = int(latest[-1]) if latest[-1] >= max(start[-1], 0) else n
            ends.append(pool.slice(last, 1) if last < n or start[-1] < 0 else pa.nulls(1, c.type))
        held = ends
        yield b, head, found, ends


def sorted_ranges(df: DataFrame, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``by`` and sorted, with the number of their range in ``__range``."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id())


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carried: Mapping[str, Column],
    inclusive: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add, per row, the latest non-null value of each ``carried`` expression among earlier rows.

    This is an as-of join of a table with itself, as a prefix scan: one shuffle into sorted ranges of (keys, order),
    one pass over each, and one row per range that says what its last key leaves behind. Only rows of a range's
    first key take from ranges before it. ``inclusive`` lets a row see itself. ``order`` should be total within a key.
    """
    names, n, k = list(carried), len(carried), len(keys)
    rest = [c for c in df.columns if c not in keys]
    fed = df.select(*keys, *rest, *(carried[c].alias(f"__in_{c}") for c in names))
    placed = sorted_ranges(fed, [*keys, *order], partitions).select(*keys, *rest, "__range", *(f"__in_{c}" for c in names))
    out = ["__head", "__tail", *(f"__loc_{c}" for c in names), *(f"__end_{c}" for c in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b, head, found, ends in _last_before(batches, k, n, inclusive):
            if waiting is not None:
                yield row(*waiting, False)
            waiting = (b, head, found, ends)
        if waiting is not None:
            yield row(*waiting, True)

    def row(b: pa.RecordBatch, head: np.ndarray, found: list[pa.Array], ends: list[pa.Array], last: bool) -> pa.RecordBatch:
        size = b.num_rows
        tail = np.zeros(size, bool)
        tail[-1] = last
        left = [pa.concat_arrays([pa.nulls(size - 1, e.type), e if last else pa.nulls(1, e.type)]) for e in ends]
        columns = [*b.columns[: b.num_columns - n], pa.array(head), pa.array(tail), *found, *left]
        return pa.RecordBatch.from_arrays(columns, [*b.schema.names[: b.num_columns - n], *out])

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    plain = [f"`{c}` {kinds[c]}" for c in (*keys, *rest, "__range")]
    made = [f"`{p}{c}` {kinds[f'__in_{c}']}" for p in ("__loc_", "__end_") for c in names]
    scanned = store(placed.mapInArrow(run, ", ".join([*plain, "__head boolean", "__tail boolean", *made])))

    # One row per range: as many as the shuffle has partitions, whatever the table holds.
    tails = scanned.where("__tail").select(*keys, "__range", F.lit(False).alias("__asks"), *(f"__end_{c}" for c in names))
    heads = scanned.where("__head").select(*keys, "__range").distinct().select(
        *keys, "__range", F.lit(True).alias("__asks"), *(F.lit(None).cast(kinds[f"__in_{c}"]).alias(f"__end_{c}") for c in names)
    )
    earlier = Window.partitionBy(*keys).orderBy("__range", F.desc("__asks"))
    inherited = tails.unionByName(heads).select(
        *(F.col(c).alias(f"__key_{c}") for c in keys), "__range", "__asks",
        *(F.last(f"__end_{c}", ignorenulls=True).over(earlier).alias(f"__pre_{c}") for c in names),
    ).where("__asks").drop("__asks")
    head = F.col("__head") & (scanned["__range"] == inherited["__range"])
    joined = scanned.join(F.broadcast(inherited), head, "left")
    return joined.select(
        *(scanned[c] for c in df.columns), *(F.coalesce(f"__loc_{c}", f"__pre_{c}").alias(c) for c in names)
    )


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """1-based numbers over a total order, without sending all rows to one task.

    Rows are range-sorted and written once; each partition then starts where the ones before it end.
    The only unpartitioned step has one row per partition.
    """
    ranged = checkpoint(
        df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    )
    part = F.shiftright("__id", 33)
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return ranged.withColumn("__part", part).join(starts, "__part").select(
        *df.columns, (inside + F.col("__start")).cast("bigint").alias(name)
    )


def pick(numbered: DataFrame, indices: DataFrame, name: str = "n") -> DataFrame:
    """Rows whose number is in ``indices``; numbers that do not exist are ignored."""
    return numbered.join(indices.select(F.col(indices.columns[0]).cast("bigint").alias(name)).distinct(), name, "left_semi")


def merge_precedence(secrets: DataFrame, by: str = "name") -> DataFrame:
    """The entry of the highest precedence per name: a later source wins. A map-side aggregate."""
    rest = [c for c in secrets.columns if c != by]
    return secrets.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("precedence", *[c for c in rest if c == "scope"])).alias("w")).select(
        by, *(F.col(f"w.{c}").alias(c) for c in rest)
    )


def last_wins(entries: DataFrame, key: Sequence[str] = ("path", "name"), at: str = "line_no", value: str = "value") -> DataFrame:
    """The last value per key at the place of its first occurrence."""
    return entries.groupBy(*key).agg(F.min(at).alias(at), F.max_by(value, at).alias(value))


def first_spelling(rows: DataFrame, keys: Sequence[str], name: str = "name", seq: str = "seq") -> DataFrame:
    """First-seen spelling of a name that is compared without case."""
    return rows.groupBy(*keys, F.upper(name).alias("name_key")).agg(F.min_by(name, seq).alias(name))
