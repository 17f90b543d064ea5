import random
import re
from collections import Counter
from itertools import product

import numpy as np

from exposure.llm import line_quality as lq

WORD = r"[^\x20\x09-\x0D]+"


def base_by_hand(text):
    words = re.findall(WORD, text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    n_dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), n_dup, len(covered)


def odd_texts(n, seed):
    r = random.Random(seed)
    words = ["a", "the", "ÉTÉ", "x\x1cy", "\x85", "$$$", "B|", "日本", "end.", "\xa0"]
    return ["".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_base_counts(spark):
    texts = [(i, t) for i, t in enumerate(odd_texts(300, 4))] + [(None, None), (5, ""), (5, ""), (6, " \n \n"), (9, "one two three " * 2000)]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in texts], "doc_id long, text string, n_words int, kept boolean").repartition(3)
    field = lq.Field(np.zeros((len(lq.FEATURES), 2)), np.zeros((2, 2)))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in lq.judge(docs, field).collect())
    want = []
    for i, t in texts:
        b = base_by_hand(t)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((str(i), *b, failed, not failed))
    assert got == sorted(want)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    field = lq.Field(r.normal(size=(len(lq.FEATURES), 2)), r.normal(size=(2, 2)))
    table = lq.emissions(field)
    for n in range(0, 8):
        codes = r.integers(0, 1 << len(lq.FEATURES), n).tolist()
        score = lambda y: sum(table[c][k] for c, k in zip(codes, y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
        assert abs(score(lq.viterbi(codes, table, field.move.tolist())) - max(map(score, product((0, 1), repeat=n)))) < 1e-9


def test_expected_is_the_sum_over_paths():
    r = np.random.default_rng(2)
    scores, move = r.normal(size=(2, 4, 2)), r.normal(size=(2, 2))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    p, pair = lq._expected(scores, move, mask)
    want_p, want_pair = np.zeros((2, 4, 2)), np.zeros((2, 2))
    for i, n in enumerate((4, 2)):
        paths = list(product((0, 1), repeat=n))
        w = np.array([np.exp(sum(scores[i, t, k] for t, k in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        for y, q in zip(paths, w / w.sum()):
            for t, k in enumerate(y):
                want_p[i, t, k] += q
            for a, b in zip(y, y[1:]):
                want_pair[a, b] += q
    assert np.allclose(p, want_p) and np.allclose(pair, want_pair)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = lq.fit(docs, labels.where("doc_id % 2 = 0"))
    got = lq.judge(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in got}
    assert n.get((1, False, False), 0) <= 0.005 * n[(1, False, True)]
    assert n.get((0, False, True), 0) <= 0.05 * (n[(0, False, False)] + n[(0, True, False)])


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality long")
    docs = spark.createDataFrame([], "doc_id long, text string")
    field = lq.fit(docs, none)
    assert not field.emit.any() and lq.judge(docs, field).collect() == []


def test_repeated_rows_of_a_labelled_id(spark):
    rows = [(i, "\n".join(["Home | About | Login", "click here!!!"] * 3) if i % 2 else "A long sentence of some words about the sea, the weather and the land.\n" * 3) for i in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    once = lq.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = lq.fit(spark.createDataFrame(rows + [rows[1]] * 300, "doc_id long, text string").repartition(4), labels)
    assert once.emit.any() and (once.emit == again.emit).all() and (once.move == again.move).all()
