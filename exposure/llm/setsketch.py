"""Near duplicates by SetSketch registers: banded, estimated jointly by likelihood, verified on full shingle sets.

A document's set are its distinct shingles of ``shingle`` words ([^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased); a shorter text is one shingle of
all its words; without words the set is empty and linked with nothing. Two documents are linked if 100 * |common| >= percent * |union|. A document's
component_id is the smallest id that links lead to.

A sketch has REGISTERS registers. An element hands exponentially spaced values to the registers in an order of its own, smallest first, and stops as soon
as no register can fall any more; a register keeps floor(1 - log_BASE(smallest)), truncated to 16 bits. Sketches of a union are the maxima of
registers. Registers agree about as often as the Jaccard index says, so bands of ROWS registers find partners: a pair at 0.8 shares none of the bands with
a probability of 3e-6.

1. Equal sets are one class from the start (a digest, aggregated before the shuffle), however many copies there are.
2. In each bucket of a band every class meets one hub: the class with the most copies. The joint likelihood of the registers estimates how alike they are, and of each class the
   likeliest pair is verified on full sets: that joins nearly all there is to join.
3. Where a bucket then still has several components, its classes outside the largest of them are held against all others of the bucket, in blocks of bounded size and only by sizes
   and registers, with five standard deviations to spare. A pair is judged in the first bucket that it shares and nowhere else. Classes that may be linked get their full sets and
   are compared where they lie. So no two classes that share a bucket are passed over, whatever hub they met; no pair is written out, and no bucket is gathered in one task.

Defined cases: a null text is the empty one; rows of one id are one document in the graph (each row is returned with its own n_shingles); a row with a null id is linked
with nothing, its component_id is null and it is kept; repeated rows are returned each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import Cache, Scratch, id_and_text, kind_of, save, slices, with_ids

REGISTERS, ROWS = 256, 6
BANDS = REGISTERS // ROWS
BASE, RATE, MOST = 1.001, 20.0, 65_535
#: Members of a bucket that are held against as many others in one task.
BLOCK = 512
_PRIME, _GOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _GOLD
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


word_hash = Cache(xxhash.xxh3_64_intdigest, 200_000)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * _PRIME
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set (uint16, one row each); all sets at once."""
    m = REGISTERS
    if not sets:
        return np.zeros((0, m), np.uint16)
    low = np.full(len(sets) * m, np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state = np.concatenate(sets)
    start, step = (state & np.uint64(m - 1)).astype(np.int64), ((state >> np.uint64(8)) & np.uint64(m - 1) | np.uint64(1)).astype(np.int64)
    state, x = mixed(state), np.zeros(len(owner))
    for t in range(m):  # the t-th smallest of m exponential values, for every element that can still lower a register
        state = mixed(state + _PRIME)
        x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (RATE * (m - t))
        np.minimum.at(low, owner * m + ((start + t * step) & (m - 1)), x)
        alive = x < low.reshape(-1, m).max(1)[owner]
        if not alive.all():
            owner, state, x, start, step = owner[alive], state[alive], x[alive], start[alive], step[alive]
            if not len(owner):
                break
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / np.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0), 0, MOST).astype(np.uint16).reshape(-1, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    r = registers[:, : BANDS * ROWS].astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLD, r.shape[:2]).copy()
    for j in range(ROWS):
        h = mixed((h ^ r[:, :, j]) * _PRIME)
    return h.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


GRID = np.linspace(0, 1, 101)


def likeliest(more: np.ndarray, fewer: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The Jaccard index that makes the counts of greater and smaller registers likeliest, given both set sizes (all arrays of one length)."""
    u, v = (n / (n + other))[:, None], (other / (n + other))[:, None]
    j = GRID * np.minimum(u / v, v / u)
    up, down = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
    same = np.maximum(1 - up - down, 1e-12)
    score = more[:, None] * np.log(up) + fewer[:, None] * np.log(down) + (REGISTERS - more - fewer)[:, None] * np.log(same)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def least_estimate(percent: int) -> float:
    """Five standard deviations below the threshold."""
    t = percent / 100
    return t - 5 * np.sqrt(t * (1 - t) / REGISTERS) - 0.02


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    more, fewer = (a > b).sum(1), (a < b).sum(1)
    return likeliest(more, fewer, n.astype(np.float64), other.astype(np.float64))


def sketch(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), digest (16 bytes of the set; null if empty), registers (REGISTERS numbers of 16 bits; null if empty)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            registers = iter(sketches(full))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(registers).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["id", "n", "digest", "registers"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind_of(docs, id_col)}, n bigint, digest binary, registers binary")


def as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def buckets(classes: DataFrame) -> DataFrame:
    """key, rep, n, copies for every band of every class that shares the band with another; hub: the class with the most copies there."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 1024):
            keys = band_keys(as_registers(b.column(3)))
            at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(b.column(i).take(at) for i in range(3))], ["key", "rep", "n", "copies"])

    rows = classes.select("rep", "n", "copies", "registers").mapInArrow(run, f"key bigint, rep {kind_of(classes, 'rep')}, n bigint, copies bigint")
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.max_by("rep", F.struct("copies", -F.col("rep"))).alias("hub")).where("members > 1")
    return rows.join(shared, "key")


def with_estimates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, estimate: the likeliest Jaccard index of each pair of classes."""
    kind = kind_of(classes, "rep")

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, 4096):
            n, other = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            e = estimates(as_registers(batch.column(4)), as_registers(batch.column(5)), n, other) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(e)], ["a", "b", "n_a", "n_b", "estimate"])

    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return both.mapInArrow(run, f"a {kind}, b {kind}, n_a bigint, n_b bigint, estimate double")


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, rep, n, component, main of the buckets whose classes are not all of one component, with the sizes that blocks are cut by.

    ``main`` says that a class is of the bucket's largest component; ``lefts`` and ``rights`` are blocks of the other classes and of all.
    """
    named = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    each = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = F.max(F.struct("m", "component"))
    shape = each.groupBy("key").agg(F.sum("m").alias("k"), largest["component"].alias("largest"), largest["m"].alias("top")).where("k > top")
    shape = shape.withColumn("lefts", F.ceil((F.col("k") - F.col("top")) / BLOCK).cast("int")).withColumn("rights", F.ceil(F.col("k") / BLOCK).cast("int"))
    return named.join(shape, "key").select("key", "rep", "n", "component", (F.col("component") == F.col("largest")).alias("main"), "lefts", "rights")


def across(group: tuple[np.ndarray, ...], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one block (key, side, rep, component, main, n, registers) that may be linked across components: pairs of row numbers."""
    key, side, rep, component, main, n, registers = group
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    keys = band_keys(registers)
    least = least_estimate(percent) * REGISTERS
    found_a, found_b = [], []
    for i in left:
        once = main[right] | (rep[right] > rep[i])  # two of the smaller components meet twice
        j = right[once & (component[right] != component[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        j = j[(registers[j] == registers[i]).sum(1) >= least]  # registers agree at least as often as the Jaccard index says
        if len(j):
            first = (keys[j] == keys[i]).argmax(1)
            j = j[keys[i][first] == key[0]]
            found_a.append(np.full(len(j), i))
            found_b.append(j)
    nothing = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (nothing, nothing)


def by_block(judge: Callable[[list[np.ndarray], pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``judge`` for every block (key, l, r) of rows that are sorted by blocks: arrays of key, side, rep, component, main, n and registers, and the rows."""

    def judged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        arrays = [rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5, 6, 7)]
        return judge([*arrays, as_registers(rows.column(8))], rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block = [], None
        for b in slices(batches, 4096):
            if not b.num_rows:
                continue
            place = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            edges = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in place])) + 1).tolist()
            for low, high in zip([0, *edges], [*edges, b.num_rows]):
                now = tuple(c[low] for c in place)
                if parts and now != block:
                    yield judged(parts)
                    parts = []
                block = now
                parts.append(b.slice(low, high - low))
        if parts:
            yield judged(parts)

    return run


def links_across(
    members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, scratch: Scratch
) -> DataFrame:
    """a, b: links between classes of different components that share a bucket.

    A first look, by registers, leaves the classes that may be linked within a block; with their full sets they are then compared in place, as long
    as the two are not joined. Only links leave a task, so no pairs are written out.
    """
    kind, names = kind_of(classes, "rep"), ["key", "l", "r", "side", "rep", "component", "main", "n"]

    def hopeful(arrays: list[np.ndarray], rows: pa.RecordBatch) -> pa.RecordBatch:
        i, j = across(arrays, percent)
        at = pa.array(np.unique(np.concatenate([i, j])))
        return pa.RecordBatch.from_arrays([c.take(at) for c in rows.columns[:8]], names)

    def compared(arrays: list[np.ndarray], rows: pa.RecordBatch) -> pa.RecordBatch:
        rep, component = arrays[2], arrays[3]
        sets = [np.sort(x.values.to_numpy().view(np.uint64)) for x in rows.column(9)]
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found = []
        for i, j in zip(*(x.tolist() for x in across(arrays, percent))):
            a, b = root(int(component[i])), root(int(component[j]))
            if a != b:
                x, y = sets[i], sets[j]
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    joined[a] = b
                    found.append((int(rep[i]), int(rep[j])))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def deal(parts: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")

    def to(left: Column, right: Column, side: bool) -> Column:
        return F.struct(left.alias("l"), right.alias("r"), F.lit(side).alias("side"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")

    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda at: to(at, deal("rights"), False))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda at: to(deal("lefts"), at, True))
    rows = open_buckets(members, labels)
    dealt = rows.select("key", "rep", "component", "main", "n", F.explode(F.when(F.col("main"), as_right).otherwise(F.concat(as_right, as_left))).alias("to"))
    numbers = classes.select(F.col("rep").cast("bigint").alias("rep"), "registers")
    wide = dealt.select("key", "to.l", "to.r", "to.side", F.col("rep").cast("bigint").alias("rep"), F.col("component").cast("bigint"), "main", "n")
    first = placed(wide.join(numbers, "rep").select(*names, "registers"))
    shape = "key bigint, l int, r int, side boolean, rep bigint, component bigint, main boolean, n bigint"
    hope = scratch.save(first.mapInArrow(by_block(hopeful), shape), "hopeful")
    wanted = hope.select(F.col("rep").cast(kind).alias("id")).distinct()
    sets = scratch.save(full_sets(wanted, docs, shingle, id_col, text_col), "sets").groupBy(F.col("id").cast("bigint").alias("rep")).agg(F.first("hashes").alias("hashes"))
    second = placed(hope.join(numbers, "rep").join(sets, "rep").select(*names, "registers", "hashes"))
    return second.mapInArrow(by_block(compared), "a bigint, b bigint").select(F.col("a").cast(kind), F.col("b").cast(kind)).distinct()


def full_sets(wanted: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, hashes: the sorted sets of the documents with a wanted ``id``; only their texts are made into sets."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "hashes"])

    return with_ids(id_and_text(docs, id_col, text_col), wanted).mapInArrow(run, f"id {kind_of(docs, id_col)}, hashes array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    sets = scratch.save(full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, shingle, id_col, text_col), "sets")
    of_a, of_b = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h_{c}")) for c in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    both = both.select("a", "b", common.alias("common"), (F.size("h_a") + F.size("h_b") - common).alias("all"))
    return both.where(100 * F.col("common") >= percent * F.col("all")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b), by large and small stars in turn until nothing changes."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v")
        last = Scratch(edges.sparkSession)
        edges = last.save(small.where("u > v").distinct(), "stars")
        scratch.drop()
        scratch = last
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", "v").union(edges.select("v", "v").distinct()).toDF("node", "component")
        before = now


def roots(parents: DataFrame) -> DataFrame:
    """node, component: the root above each node of a forest (a, b), b being a's parent, by doubling the steps up."""
    scratch = Scratch(parents.sparkSession)
    up = scratch.save(parents.toDF("node", "component"), "up")
    while True:
        beyond = up.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        further = up.join(beyond, "component", "left").select("node", F.coalesce("beyond", "component").alias("component"), F.col("beyond").isNotNull().alias("moved"))
        last = Scratch(parents.sparkSession)
        up = last.save(further, "up")
        scratch.drop()
        scratch = last
        if up.where("moved").isEmpty():
            return up.drop("moved")


def smallest(labels: DataFrame, more: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of a forest's labels and of further links (a, b) between its trees."""

    def named(column: str) -> Column:
        return F.coalesce(f"c_{column}", column).alias(column)

    a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    ends = more.join(a, "a", "left").join(b, "b", "left").select(named("a"), named("b"))
    trees = labels.union(labels.select("component", "component").distinct())
    if not ends.isEmpty():
        merged = components(ends).toDF("component", "least")
        trees = trees.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        trees = trees.union(merged.join(trees, merged["component"] == trees["node"], "left_anti").select("component", "least"))
    least = trees.groupBy("component").agg(F.min("node").alias("least"))
    return trees.join(least, "component").select("node", F.col("least").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept (the id is its component's smallest). Ids are whole numbers."""
    scratch = Scratch(docs.sparkSession)
    sketched = save(sketch(docs, shingle, id_col, text_col), "sketches")
    named = sketched.where("id is not null and digest is not null")
    classes = save(named.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")
    belongs = save(named.select("id", "digest").join(classes.select("digest", "rep"), "digest").select("id", "rep").distinct(), "belongs")
    # rows of one id with different sets join their classes
    joined = belongs.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a").join(belongs, "id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()

    members = scratch.save(buckets(classes), "buckets")
    pairs = members.where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    fits = (F.col("estimate") >= least_estimate(percent)) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likeliest_pair = F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b")
    first = scratch.save(with_estimates(pairs, classes).where(fits).groupBy("a").agg(likeliest_pair), "first")
    # a hub has more copies than its class, or as many and a smaller id, so links to hubs are a forest
    trees = roots(verified(first, docs, shingle, percent, id_col, text_col, scratch))
    across_trees = links_across(members, trees, classes, docs, shingle, percent, id_col, text_col, scratch)
    more = save(across_trees.union(joined), "more")
    scratch.drop()
    labels = smallest(trees, more)

    rows = sketched.select("id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns; of rows with one id one stays. Rows with a null id all stay."""
    kept = near_duplicates(docs, shingle, percent, id_col, text_col).where("kept").select(F.col(id_col).alias("id")).dropna().distinct()
    named = docs.join(kept, docs[id_col] == kept["id"], "left_semi")
    if not docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 1).dropna().isEmpty():
        named = named.dropDuplicates([id_col])
    return named.unionByName(docs.where(docs[id_col].isNull()))
