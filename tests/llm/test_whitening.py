import math
from collections import defaultdict

import numpy as np
import pytest

from exposure.llm import whitening


@pytest.mark.parametrize("d", [1, 2, 3, 8, 64, 150])
def test_leading_vectors(d):
    """Spread, tied, geometric, zero and graded spectra, against a solver of the whole spectrum."""
    r = np.random.default_rng(d)
    for spectrum in (np.abs(r.standard_normal(d)), np.r_[np.full(6, 3.0), np.ones(d)][:d], 2.0 ** -np.arange(d), np.zeros(d), 1 + 1e-9 * np.arange(d), 1e12 * np.abs(r.standard_normal(d))):
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        values, vectors = whitening.leading(v, 8)
        k, size = min(8, d), max(1.0, np.abs(spectrum).max())
        assert np.abs(values - np.sort(spectrum)[::-1][:k]).max() < 1e-13 * size * d
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
        assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-13 * size * d


def test_blocks_and_diagonals():
    for v in (np.diag([3.0, 1.0, 2.0, 0.0, 5.0]), np.kron(np.eye(3), [[2.0, 1.0], [1.0, 2.0]]), np.ones((6, 6)), np.diag(np.ones(4)) - np.diag(np.ones(3), 1) - np.diag(np.ones(3), -1)):
        values, vectors = whitening.leading(v, 8)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], atol=1e-13)
        assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)


def test_sturm_counts():
    r = np.random.default_rng(5)
    for d in (1, 2, 7, 40):
        diagonal, off = r.standard_normal(d), r.standard_normal(d - 1) * (r.random(d - 1) < 0.7)
        all_values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
        at = np.r_[r.uniform(-4, 4, 20), all_values + 1e-9, all_values - 1e-9]
        assert whitening.below(diagonal, off, at).tolist() == [(all_values < x).sum() for x in at]


def by_hand(vectors, components=8):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return kept, deviation, centred @ axes / np.sqrt(values), values / np.trace(v)


def check(rows, vectors):
    kept, deviation, white, explained = by_hand(vectors)
    found = defaultdict(dict)
    for r in rows:
        found[r.vec_id][r.component] = r
    assert len(rows) == len(kept) * white.shape[1]
    signs = None
    for k, (i, _) in enumerate(kept):
        mine = [found[i][c + 1] for c in range(white.shape[1])]
        assert {r.n for r in mine} == {len(kept)} and {int(r.deviation) for r in mine} == {deviation[k]}
        w = np.array([r.whitened for r in mine])
        if signs is None:
            signs = np.sign(w * white[k])
        assert np.allclose(w, signs * white[k], atol=1e-9, rtol=1e-9)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9) and mine[0].identity_error < 1e-9


def test_query(spark):
    from exposure.llm.queries import op12_whitening

    sf = "/root/testdata/sf0.01"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_whitening(spark, sf).collect(), vectors)


def test_odd_vectors(spark):
    """Nulls, entries that are not numbers, other lengths, repeated rows, columns of clashing names, a vector that most rows have."""
    r = np.random.default_rng(2)
    vectors = [(i, r.standard_normal(12).astype("f4").tolist()) for i in range(300)] + [(1000 + i, [0.5] * 12) for i in range(200)]
    bad = [(1, None), (2, [1.0, None] * 6), (3, [float("nan")] * 12), (4, [float("inf")] + [0.0] * 11), (None, None)]
    odd = [(5, []), (6, [1.0] * 5), (7, [1e30] * 12)]
    schema = "vec_id long, embedding array<float>, x string, w int, n int"
    table = spark.createDataFrame([(*v, "a", 1, 2) for v in vectors + bad + odd], schema).repartition(5)
    check(whitening.whiten(table).collect(), vectors)
    twice = spark.createDataFrame([(*v, "a", 1, 2) for v in [(None, v[1]) for v in vectors[:40]] * 2], schema)
    got = whitening.whiten(twice, components=3).collect()
    assert len(got) == 80 * 3 and {r.vec_id for r in got} == {None} and got[0].identity_error < 1e-9


def test_nothing_varies(spark):
    schema = "vec_id string, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 5, schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], schema)).collect()
    assert {r.component for r in line} == {1} and np.allclose([abs(r.whitened) for r in line], 1) and line[0].identity_error < 1e-12
