"""Whitening of embeddings: covariance summed up in tasks, leading eigenvectors by bisection and inverse iteration, projection where the rows are.

Every kept entry c becomes the whole number x = floor(scale * c) + offset. A first pass counts rows and sums entries exactly; a second one
subtracts the mean from each row, multiplies, and adds up one matrix a task. That d x d matrix alone goes to the driver (its size depends on
the dimensions, not on the rows), where Householder reflections make it tridiagonal, Sturm counts bisect for the leading eigenvalues, and
inverse iteration finds their vectors; vectors of eigenvalues that lie close together are orthogonalised against each other in every step.
The fit (mean, components, eigenvalues) goes to the tasks, which project row by row. A last pass over the projected rows measures how far
their covariance is from the identity.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are entries beyond ``LARGEST`` in absolute
value, whose x a double cannot hold to the last digit. A vector of another length than the commonest one (of several: the longest) has no
place in the matrix and is dropped too. Components whose eigenvalue is not above ``FLAT`` times the largest are not returned: nothing varies
along them (equal vectors, a single row, more components than dimensions). Repeated rows and null or repeated ids are rows like any other; an
empty table gives an empty one. Other columns are not read. ``deviation`` is a whole number of up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import kind_of, save

SCALE, OFFSET = 1024, 100_000
#: |c| up to here leaves x below 2^53.
LARGEST = 2.0**42
FLAT = 1e-12
#: Rows that are multiplied at once.
ROWS = 4096


# --- leading eigenvectors of a symmetric matrix ------------------------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal and reflectors (unit vectors u of I - 2uu') with T = H(k)..H(1) V H(1)..H(k)."""
    a, d = np.array(v, dtype=float), len(v)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        u = x / size if size > 0 else np.zeros_like(x)
        reflectors.append(u)
        block = a[k + 1 :, k + 1 :]
        p = block @ u
        w = p - (u @ p) * u
        block -= 2 * (np.outer(u, w) + np.outer(w, u))
        below = a[k + 1 :, k]
        below -= 2 * (u @ below) * u
        a[k, k + 1 :] = below
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of ``at`` (negative pivots of T - at)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off**2, initial=0.0)))
    count, q = 0, np.inf
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a pivot of zero counts as one just below
        count = count + (q < 0)
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling: bisection of all of them at once until no double lies between the bounds."""
    d = len(diagonal)
    beside = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    pad = np.finfo(float).eps * d * float(np.max(np.abs(diagonal) + beside))
    low = np.full(most, float(np.min(diagonal - beside)) - pad)
    high = np.full(most, float(np.max(diagonal + beside)) + pad)
    rank = d - 1 - np.arange(most)  # eigenvalues below the wanted one
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        under = below(diagonal, off, middle) <= rank
        low, high = np.where(open_ & under, middle, low), np.where(open_ & ~under, middle, high)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; a vanishing pivot counts as ``least``."""
    d = len(diagonal)
    p, q, r, y = diagonal - shift, np.r_[off, 0.0], np.zeros(d), b.copy()
    for k in range(d - 1):
        lower, after, upper = off[k], p[k + 1], q[k + 1]
        if abs(lower) > abs(p[k]):  # the row below has the larger pivot
            p[k], lower = lower, p[k]
            q[k], after = after, q[k]
            r[k], upper = upper, 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        if abs(p[k]) < least:
            p[k] = least
        f = lower / p[k]
        p[k + 1], q[k + 1] = after - f * q[k], upper - f * r[k]
        y[k + 1] -= f * y[k]
    if abs(p[d - 1]) < least:
        p[d - 1] = least
    for k in range(d - 1, -1, -1):
        y[k] -= (q[k] * y[k + 1] if k + 1 < d else 0.0) + (r[k] * y[k + 2] if k + 2 < d else 0.0)
        y[k] /= p[k]
        if abs(y[k]) > 1e100:  # only the direction matters
            y /= abs(y[k])
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of T for ``values`` (falling), one a row, by inverse iteration.

    Values closer than a thousandth of the matrix's norm form a cluster, whose vectors are made orthogonal in every round.
    """
    d = len(diagonal)
    norm = float(np.max(np.abs(diagonal) + np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0])) or 1.0
    eps = np.finfo(float).eps
    found = np.zeros((len(values), d))
    start = np.random.default_rng(12)
    cluster, shift = 0, 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        # equal values are set a little apart, so that their systems differ
        shift = min(value, shift - 10 * eps * norm) if k > cluster else value
        y = start.standard_normal(d)
        for _ in range(rounds):
            y = solve(diagonal, off, shift, y / np.linalg.norm(y), eps * norm)
            y /= np.max(np.abs(y))
            for _ in range(2):
                y -= found[cluster:k].T @ (found[cluster:k] @ y)
        found[k] = y / np.linalg.norm(y)
    return found


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` leading eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix."""
    most = min(most, len(v))
    diagonal, off, reflectors = tridiagonal(v)
    values = leading_values(diagonal, off, most)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        tail = vectors[:, k + 1 :]
        tail -= 2 * np.outer(tail @ reflectors[k], reflectors[k])
    return values, vectors


# --- the job -----------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """What whitening needs: everything here is as large as the dimensions, not the rows."""

    n: int
    sums: list[int]
    mean: np.ndarray  # whole part of S / n
    rest: np.ndarray  # S / n less ``mean``
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # one component a row


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: the kept rows with their entries as whole numbers."""
    entries = F.col("v")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where(entries.isNotNull() & ~bad)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = common["size"] if common else 0
    x = F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(OFFSET))
    return rows.where((F.size("v") == size) & (F.size("v") > 0)).select("id", x.cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                part = x.astype(object).sum(0) if np.abs(x).max() > 1 << 40 else x.sum(0)
                n, total = n + len(x), part.astype(object) if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([f"{t}" for t in total], pa.string())],
                ["dim", "n", "total"],
            )

    parts = rows.select("x").mapInArrow(run, "dim int, n bigint, total string")
    total = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row for each dimension
    return (total[0]["n"] if total else 0), [int(r["total"]) for r in sorted(total, key=lambda r: r["dim"])]


def _covariance(rows: DataFrame, n: int, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Centred rows times themselves, one matrix a task; the upper half comes to the driver."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        some = False
        for b in batches:
            for low in range(0, b.num_rows, ROWS):
                centred = (_matrix(b.column(0).slice(low, ROWS)) - mean) - rest
                total += centred.T @ centred
                some = True
        if some:
            for i in range(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array(total[i, i:])], ["i", "j", "v"]
                )

    parts = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = parts.toArrow()  # d * (d + 1) / 2 rows
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((d, d))
    out[i, j] = v / n
    out[j, i] = v / n
    return out


def fit(rows: DataFrame, components: int = 8) -> Fit | None:
    """The leading components of ``whole_numbers``; None without rows."""
    n, sums = _sums(rows)
    if not n or not sums:
        return None
    mean = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, mean)])
    v = _covariance(rows, n, mean, rest)
    values, vectors = leading(v, components)
    kept = (values > 0) & (values > FLAT * values[0])
    return Fit(n, sums, mean, rest, float(np.trace(v)), values[kept], vectors[kept])


def project(rows: DataFrame, fitted: Fit) -> DataFrame:
    """``id, deviation, w``: the row's exact deviation from the sums and its whitened coordinates."""
    kind, n, sums = kind_of(rows, "id"), fitted.n, fitted.sums
    scaled = (fitted.vectors / np.sqrt(fitted.values)[:, None]).T

    def deviations(x: np.ndarray) -> list[int]:
        far = max(abs(int(x.max()) * n - min(sums)), abs(int(x.min()) * n - max(sums)))
        if far * far * x.shape[1] < 1 << 63:  # exact in whole numbers of 64 bits
            away = x * n - np.array(sums, dtype=np.int64)
            return (away * away).sum(1).tolist()
        away = x.astype(object) * n - np.array(sums, dtype=object)
        return (away * away).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, ROWS):
                part = b.slice(low, ROWS)
                x = _matrix(part.column(1))
                w = ((x - fitted.mean) - fitted.rest) @ scaled
                away = pa.array([str(v) if len(str(v)) <= 38 else None for v in deviations(x)], pa.string())
                flat = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), away, flat], ["id", "away", "w"])

    done = rows.select("id", "x").mapInArrow(run, f"id {kind}, away string, w array<double>")
    return done.select("id", F.col("away").cast("decimal(38,0)").alias("deviation"), "w")


def identity_error(projected: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``w`` less the identity, centred before multiplying."""
    if not components:
        return 0.0
    w = [F.col("w")[k] for k in range(components)]
    means = projected.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(w))).first()
    centred: list[Column] = [c - F.lit(means[k]) for k, c in enumerate(w)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    cov = projected.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(cov[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each kept vector and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(vectors, id_col, vector_col)
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.values):
        fitted = Fit(0, [], np.zeros(0), np.zeros(0), 1.0, np.zeros(0), np.zeros((0, 0)))
        projected = rows.select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("w"))
        error = 0.0
    else:
        projected = save(project(rows, fitted), "projected")
        error = identity_error(projected, len(fitted.values))
    explained = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values)).cast("array<double>")
    return projected.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation",
        "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
