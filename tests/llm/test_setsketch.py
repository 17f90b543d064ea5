import random
import re
from collections import defaultdict

import numpy as np
import pytest

from exposure.llm import setsketch as ss


def set_of(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def by_hand(rows, shingle, percent):
    """All pairs, through an index of shingles."""
    sets = [set_of(t, shingle) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].add(k)
    for k, s in enumerate(sets):
        counts = defaultdict(int)
        for x in s:
            for o in holders[x]:
                if o < k:
                    counts[o] += 1
        for o, c in counts.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c) and rows[k][0] is not None and rows[o][0] is not None:
                a, b = root(rows[k][0]), root(rows[o][0])
                parent[max(a, b)] = min(a, b)
    return sorted(str((i, len(s), None if i is None else root(i), i is None or root(i) == i)) for (i, _), s in zip(rows, sets))


def result(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


def prose(r, n, words=4000):
    return [f"w{r.randint(0, words)}" for _ in range(n)]


def groups(seed):
    """Groups of copies and near copies, chains of small steps, texts just above and below the threshold, and small texts."""
    r, out = random.Random(seed), []
    for _ in range(12):
        base = prose(r, r.randint(10, 150))
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"n{r.randint(0, 999)}"
            out.append(" ".join(w))
    w = prose(r, 60)
    for _ in range(25):
        w[r.randrange(len(w))] = f"c{r.randint(0, 999)}"
        out.append(" ".join(w).upper())
    for n in range(40):
        base = prose(r, 20)
        out += [" ".join(base), " ".join(base + [f"x{k}" for k in range(n % 8)])]
    out += ["one", "One", "ONE two", "one\ttwo", "", " \n", None, "é one", "É one"] + ["exact copy of a text"] * 30
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("shingle,block,seed", [(2, 512, 1), (2, 3, 3), (5, 2, 2)])
def test_against_all_pairs(spark, monkeypatch, shingle, block, seed):
    monkeypatch.setattr(ss, "BLOCK", block)
    rows = groups(seed)
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, key string, component int").repartition(4)
    assert result(ss.near_duplicates(docs, shingle)) == by_hand(rows, shingle, 80)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "q r s t u v w x"), (7, "q r s t u v w x"), (9, "q r s t u v w x"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ss.near_duplicates(docs, 2)) == by_hand(rows, 2, 80)


def test_query_on_whole_table(spark):
    from exposure.llm.queries import op7_setsketch

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op7_setsketch(spark, sf)) == by_hand(rows, 2, 80)


def test_registers_agree_as_jaccard_and_merge():
    r = np.random.default_rng(4)
    for n, shared in ((400, 320), (400, 40), (60, 50), (1, 1)):
        found = []
        for _ in range(60):
            x = ss.mixed(r.integers(0, 1 << 62, 2 * n - shared, dtype=np.uint64))
            a, b = np.sort(x[:n]), np.sort(x[n - shared :])
            s = ss.sketches([a, b, np.unique(np.concatenate([a, b]))])
            assert (np.maximum(s[0], s[1]) == s[2]).all()
            found.append(ss.estimates(s[:1], s[1:2], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(found) - shared / (2 * n - shared)) < 0.03 and min(found) > shared / (2 * n - shared) - 0.2


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 400)] + [(5, 5)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in ss.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in range(500))


def test_empty_table(spark):
    assert ss.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 5).collect() == []


def test_ids_are_looked_up_without_a_second_python_worker(spark):
    from pyspark.sql import functions as F

    from exposure.llm.common import likely, with_ids

    rows = spark.range(-3000, 3000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    wanted = spark.range(0, 6000, 7).select((F.col("id") - 3000).alias("id"))
    assert sorted(r.id for r in with_ids(rows, wanted).collect()) == list(range(-3000, 3000, 7))
    assert with_ids(rows, wanted.limit(0)).collect() == []
    few = likely(rows, wanted, "id", 16).collect()  # a few more, of which none is missing
    assert {r.id for r in few} >= set(range(-3000, 3000, 7)) and len(few) < 1100
    plan = ss.full_sets(wanted, rows, 5, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
