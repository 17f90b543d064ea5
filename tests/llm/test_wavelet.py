import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from exposure.llm import wavelet

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library):
    r = random.Random(4)
    alphabet = ["a", "E", "é", "ñ", "1", "²", "½", "'", "'s", "'LL", ".", "\t", "\n", " ", "  ", "\x0b", "\x1c", "\x85", "\xa0", "日", "本", "α", "ſ", "İ", "<|endoftext|>", "<|", "|>", "the", "‍", "👩", "\x00"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b"]
    code = wavelet.ids_of(PATH, P.PATTERN)
    assert code.ranks
    for x in texts:
        assert code(x) == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_long_texts(library, monkeypatch):
    code = wavelet.ids_of(PATH, P.PATTERN)
    monkeypatch.setattr(wavelet, "LONG", 50)
    for x in ("word and words " * 40 + "日本 <|endoftext|> x", " " * 300, "a" * 300, "é " * 100):
        assert code(x) == library.encode(x, add_special_tokens=False).ids
    monkeypatch.undo()
    for x in (" " * 2_000_000 + "x", "a" * 300_000, "ab " * 200_000):
        assert P and sum(map(len, map(code.fast.decode_single_token_bytes, code(x)))) == len(x)


def test_another_tokenizer_goes_through_its_library():
    path = P.path("word_bpe_49k.json")
    code = wavelet.Ids(path, P.PATTERN)
    assert code.ranks is None and code("Some words. <|endoftext|>") == Tokenizer.from_file(path).encode("Some words. <|endoftext|>", add_special_tokens=False).ids


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (1, 9), (7, 2), (64, 1), (1000, 5), (5000, 70_000), (140_000, 50_257)])
def test_matrix(n, most):
    """Access, counting, occurrences and the way back, against the plain list."""
    r = np.random.default_rng(n + most)
    tokens = np.minimum(r.geometric(min(1, 8 / most), n), most - 1).astype("<u4") if n % 2 == 0 else r.integers(0, most, n).astype("<u4")
    documents = pa.RecordBatch.from_arrays([pa.array(["a", None]), pa.array([n, 0])], ["id", "n_tokens"])
    raw = wavelet.pack(tokens, documents, part=3, seq=4)
    m = wavelet.Matrix(raw + b"\n")
    assert m.tokens().tolist() == tokens.tolist() and m.documents().to_pylist() == documents.to_pylist()
    assert (m.header["part"], m.header["seq"], m.n) == (3, 4, n)
    for _ in range(60 if n else 0):
        i, j = sorted(r.integers(0, n + 1, 2).tolist())
        t = int(tokens[r.integers(0, n)])
        assert m.access(min(i, n - 1)) == tokens[min(i, n - 1)]
        assert m.count(t, i, j) == (tokens[i:j] == t).sum() and m.count(t) == (tokens == t).sum()
        where = np.flatnonzero(tokens == t)
        k = int(r.integers(0, len(where)))
        assert m.occurrence(t, k) == where[k] and m.occurrence(t, len(where)) == -1 and m.occurrence(t, -1) == -1
    assert m.count(most + 5) == 0 and m.count(1 << 40) == 0 and m.occurrence(1 << 40, 0) == -1
    with pytest.raises(IndexError):
        m.access(n)
    if n == 140_000:
        assert len(raw) < 2 * n + 20_000


def check(rows, docs, library):
    """Documents in order of id; of one id in any order, but each at a place of its own."""
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    at = 0
    ordered = sorted(rows, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id) for r in ordered]
    assert all(a[0] < b[0] or not a[0] or a[1] <= b[1] for a, b in zip(keys, keys[1:]))


@pytest.mark.parametrize("kind,key", [("long", lambda i: i * 13 % 211), ("string", lambda i: f"d{i % 40}")])
def test_files(spark, library, tmp_path, kind, key):
    """Small shards; nulls, empty and long texts, repeated rows and ids, columns of clashing names."""
    docs = [(key(i), "word " * (i % 50) + "é日" * (i % 3)) for i in range(200)] + [(None, "x"), (None, None), (key(0), None), (key(1), ""), (key(1), ""), (key(2), "long text " * 4000)]
    table = spark.createDataFrame([(i, t, 1, "a", b"b") for i, t in docs], f"doc_id {kind}, text string, part int, content string, ids binary").repartition(4)
    check(wavelet.round_trip(table, PATH, P.PATTERN, shard_tokens=300).collect(), docs, library)
    folder = str(tmp_path / "shards")
    wavelet.write_files(table, folder, PATH, P.PATTERN, shard_tokens=300)
    files = [wavelet.Matrix(r.content) for r in wavelet.read_files(spark, folder).collect()]
    assert len(files) > 20 and all(m.n <= 300 or len(m.documents()) == 1 for m in files)
    word = library.encode(" word").ids[0]
    assert sum(m.count(word) for m in files) == sum(library.encode(t or "", add_special_tokens=False).ids.count(word) for _, t in docs)


def test_query(spark, library):
    from exposure.llm.queries import op13_wavelet_files

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op13_wavelet_files(spark, sf).collect(), docs, library)


def test_empty_table(spark):
    assert wavelet.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
