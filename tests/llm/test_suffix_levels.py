import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from exposure.llm import suffix_levels as sl


def by_hand(rows, length):
    """Every string of every text in a dictionary."""
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(r)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append(str((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def result(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def texts(seed, length):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefgh é日") for _ in range(n))
    shared = [prose(r.randint(length - 20, 3 * length)) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            k = r.random()
            parts.append(p if k < 0.3 else p[r.randint(0, 60) : len(p) - r.randint(0, 60)] if k < 0.6 else prose(r.randint(0, 300)))
        out.append("".join(parts))
    out += ["x" * (length - 1), "x" * length, "y" * (3 * length), "ab" * length, "", None, out[5], out[5], "z" + "q" * length, "q" * length + "w"]
    return list(enumerate(out))


@pytest.mark.parametrize("length,batches,piece,most", [(64, 4, 1 << 19, 4096), (64, 3, 150, 2), (100, 1, 1 << 19, 3)])
def test_against_every_string(spark, monkeypatch, length, batches, piece, most):
    monkeypatch.setattr(sl, "PIECE", piece)
    monkeypatch.setattr(sl, "CLASS", most)
    rows = texts(length + batches, length)
    docs = spark.createDataFrame([(i, t, "g", 3, 4) for i, t in rows], "doc_id long, text string, gram string, low int, doc int").repartition(4)
    assert result(sl.digests(docs, length, batches)) == by_hand(rows, length)


def test_repeated_ids_and_nulls(spark):
    a, b = "".join(chr(97 + i * i % 26) for i in range(300)), "".join(chr(97 + i * i * i % 23) for i in range(300))
    rows = [(None, a), (None, b), (3, b[100:]), (3, "short"), (4, None), (5, a[:80])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(sl.digests(docs, 70, 2)) == by_hand(rows, 70)
    left = sl.without_repeats(docs, 70, 2)
    assert left.columns == docs.columns and left.count() == len(rows)


def test_query_on_whole_table(spark):
    from exposure.llm.queries import op8_suffix_levels

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op8_suffix_levels(spark, sf)) == by_hand(rows, 200)


def test_every_string_has_its_anchor():
    r = np.random.default_rng(3)
    for n in (200, 201, 700):
        raw = bytes(r.integers(97, 100, n).astype(np.uint8))
        gram, place, low, high = sl.anchors(raw, 200)
        assert low[0] == 0 and high[-1] == n - 200 and (low[1:] == high[:-1] + 1).all()
        assert (place >= low).all() and (place <= high + 0 + 200 - sl.GRAM).all() and (place >= high).all()


def test_levels_merge_by_size(spark):
    index = sl.Levels(spark, 64)
    sizes = []
    for k in range(5):
        docs = spark.createDataFrame([(k, "".join(chr(97 + (i * i + k * i) % 26) for i in range(300)))], "doc_id long, text string")
        index.add(sl.keyed(docs, sl.doc_key(docs, "doc_id", "text"), "doc_id", "text"))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]


def test_text_without_repeats(spark):
    passage = "é" * 20 + "".join(chr(97 + i * i % 26) for i in range(100))
    docs = spark.createDataFrame([(1, "Head " + passage + " tail", "en"), (2, passage, "en"), (3, None, None), (4, "clean", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in sl.without_repeats(docs, 80, 2).collect()}
    assert got == {1: ("Head  tail", "en"), 2: ("", "en"), 3: (None, None), 4: ("clean", "de")}


def test_empty_table(spark):
    assert sl.digests(spark.createDataFrame([], "doc_id long, text string"), 200).collect() == []
