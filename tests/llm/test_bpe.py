import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex

from exposure.llm import bpe

VOCABULARY, PATTERN = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def plain():
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, most, seed):
    r = random.Random(seed)
    alphabet = "ab AB 12²½ªº'.,\t\n\r\x0b\x0c\x1c\x85\xa0'sßÿİǅ日本 語😀́"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_plain_pattern_is_the_pattern():
    texts = odd_texts(5000, 12, 1)
    assert [bpe.pre_tokens(t, PATTERN) for t in texts] == [regex.findall(PATTERN, t) for t in texts]


@pytest.mark.parametrize("size,overlap", [(7, 5), (40, 12), (50, 0)])
def test_chunks_give_the_ids_of_the_whole(spark, plain, size, overlap):
    texts = odd_texts(60, 200, 2) + ["a" * 300, "x" + " " * 200 + "y", "a" * 150 + " b" * 80, "", None, "same text " * 20, "same text " * 20]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids string, h int, seq int").repartition(3)
    got = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN, chunk_chars=size, overlap=overlap).withColumnRenamed("ids", "n"), VOCABULARY, ids_col="n").collect()
    want = sorted((str(None if i == 3 else i // 2), (t or "").encode()) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == want
    got = bpe.encode(docs, VOCABULARY, PATTERN, chunk_chars=size, overlap=overlap).collect()
    want = sorted((str(None if i == 3 else i // 2), plain.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want


def test_query(spark, plain):
    from exposure.llm.queries import op10_byte_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, PATTERN).collect() == []
