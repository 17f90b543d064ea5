import hashlib
import random

import numpy as np
import pytest

from exposure.llm import fingerprints as fp


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rank():
    counts = np.arange(fp.BINS + 1)[::-1] + 1
    return fp.ranks(counts)


def test_entropy_by_hand():
    r = random.Random(1)
    x = np.frombuffer((prose(r, 60) + "a" * 100 + "\x00\x01").encode(), np.uint8)
    bins = fp.entropy_bins(x)
    assert len(bins) == len(x) - fp.WINDOW + 1
    for i in range(len(bins)):
        p = np.unique(x[i : i + fp.WINDOW], return_counts=True)[1] / fp.WINDOW
        assert abs(bins[i] - -(p * np.log2(p)).sum() / 6 * fp.BINS) < 1.5
    assert len(fp.entropy_bins(x[:63])) == 0


def selected_by_hand(raw, rank):
    bins = fp.entropy_bins(np.frombuffer(raw, np.uint8))
    keys = [(int(rank[b]) if rank[b] >= 0 else fp.BINS + 1, i) for i, b in enumerate(bins)]
    if len(keys) < fp.RUN:
        return [min(keys)[1]] if keys and min(keys)[0] <= fp.BINS else []
    points = {}
    for i in range(len(keys) - fp.RUN + 1):
        best = min(keys[i : i + fp.RUN])
        if best[0] <= fp.BINS:
            points[best[1]] = points.get(best[1], 0) + 1
    return sorted(i for i, n in points.items() if n >= fp.POINTS)


def test_selection_by_hand(rank, monkeypatch):
    r = random.Random(2)
    texts = [prose(r, n).encode() for n in (0, 3, 12, 20, 25, 200, 500)] + [b"a" * 300, b"ab" * 40, (prose(r, 100) + "-" * 500 + prose(r, 100)).encode()]
    want = [selected_by_hand(t, rank) for t in texts]
    assert [s.tolist() for s in fp.selected(texts, rank)] == want
    monkeypatch.setattr(fp, "PIECE", 200)
    assert [s.tolist() for s in fp.selected(texts, rank)] == want


def test_likeness(rank):
    r = random.Random(3)
    a, b = prose(r, 4000).encode(), prose(r, 4000).encode()
    chains = fp.fingerprints_of([a, b, a[: len(a) * 2 // 3] + b[: len(b) // 3], a, b"", b"", b"short", b"other"], rank)
    assert fp.likeness(chains[0], chains[3]) == 1.0 and fp.likeness(chains[0], chains[1]) < 0.05
    assert 0.3 < fp.likeness(chains[0], chains[2]) < 1
    assert fp.likeness(chains[4], chains[5]) == 1.0 and fp.likeness(chains[4], chains[0]) == 0.0
    assert fp.likeness(chains[6], chains[7]) == 0.0 and fp.likeness(chains[6], chains[6]) == 1.0
    assert (fp.parsed(fp.spelt(chains[0])) == chains[0]).all()


def edited_by_hand(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        yield i, t, t[: len(t) - len(t) // 3] + u[: len(t) // 3], u


@pytest.mark.parametrize("n", [1, 2, 150])
def test_edited_texts(spark, rank, n):
    r = random.Random(n)
    rows = [(i * 7 - 100, prose(r, r.randint(0, 40)) + "日" * r.randint(0, 4)) for i in range(n - 1)] + [(None, "nothing known")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, bucket int, fingerprint string").repartition(5)
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), *(fp.spelt(c) for c in fp.fingerprints_of([t.encode(), e.encode()], rank))) for i, t, e, _ in edited_by_hand(rows))
    got = fp.edited_likeness(docs, rank).collect()
    assert sorted((str(g.doc_id), g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) for g in got) == want
    nexts = {str(i): fp.likeness(*fp.fingerprints_of([t.encode(), u.encode()], rank)) for i, t, _, u in edited_by_hand(rows)}
    assert all(abs(nexts[str(g.doc_id)] - g.near_next) < 1e-12 and 0 <= g.near_edited <= 1 for g in got)


def test_rows_of_one_id(spark, rank):
    docs = spark.createDataFrame([(5, "same text")] * 6 + [(None, None)] * 4 + [(6, "")], "doc_id long, text string").repartition(3)
    got = fp.edited_likeness(docs, rank).collect()
    assert sorted(str(g.doc_id) for g in got) == ["5"] * 6 + ["6"] + ["None"] * 4


def test_query_on_whole_table(spark):
    from exposure.llm.queries import op4_fingerprints

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {g.doc_id: g for g in op4_fingerprints(spark, sf).collect()}
    for i, t, e, _ in edited_by_hand(rows):
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert sum(g.near_edited for g in got.values()) / len(got) > 0.4 > 0.02 > sum(g.near_next for g in got.values()) / len(got)


def test_counts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 70), (2, "short"), (3, None)], "doc_id long, text string")
    assert sorted(set(fp.rarity(docs)))[:2] == [-1, 0]
    assert [(r.n_chars, len(r.fingerprint) > 0) for r in fp.fingerprint(docs, fp.rarity(docs)).orderBy("doc_id").collect()] == [(70, True), (5, True), (0, False)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edited_likeness(none, fp.rarity(none)).collect() == []
