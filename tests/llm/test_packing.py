import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from exposure.llm import packing

PATH = P.path("word_bpe_49k.json")


def whole():
    return Tokenizer.from_file(PATH)


def test_cached_words_are_the_tokenizer():
    r = random.Random(3)
    alphabet = "abEÉ éñß12²½ª'.,\t\n\x0b\x0c\x1c\x85\xa0'stİŸſ日ΑΣς é<|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["a<|endoftext|>b", "hello <|endoftext|> world", "<|STARTOFTEXT|>x <|startoftext|>", "<|endoftext|><|endoftext|>", "It's we'll 'sx", "Ñandú ÉTÉ"]
    t, own = whole(), packing.Tokens(PATH)
    assert own.pattern
    for x in texts:
        assert np.frombuffer(own.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def check(rows, texts, most):
    t = whole()
    want = []
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(str(i), n, s, len(ids[s : s + most]), zlib.crc32(np.array(ids[s : s + most], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), most))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


def test_plan_is_best_fit():
    """The same number of sequences as best-fit in descending order, one piece at a time."""
    r = random.Random(9)
    for _ in range(200):
        room = r.choice([10, 37, 64])
        lengths = [r.randint(1, room) if r.random() < 0.7 else 5 for _ in range(r.randint(0, 80))]
        left = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, v in enumerate(left) if v >= x]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= x
            else:
                left.append(room - x)
        counts = defaultdict(int)
        for x in lengths:
            counts[x] += 1
        used, slots = defaultdict(list), defaultdict(set)
        for length, rank, n, first, offset in packing.plan(dict(counts), room):
            for j in range(n):
                used[first + j].append((offset, length))
                slots[length].add(rank + j)
        assert {k: set(range(v)) for k, v in counts.items()} == dict(slots)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= room
        assert len(used) == len(left)


def test_pieces_and_slots(spark):
    texts = [(i, "word " * (i % 40) + "x") for i in range(300)] + [(None, None), (7, ""), (7, ""), (8, "long text here " * 300)]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in texts], "doc_id long, text string, piece int, length string").repartition(4)
    rows = packing.pack(docs, PATH, max_tokens=64).collect()
    n = check(rows, texts, 64)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 64) + 1


def test_query(spark):
    from exposure.llm.queries import op9_best_fit_packing

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op9_best_fit_packing(spark, sf).collect(), texts, 4096)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
