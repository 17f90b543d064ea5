import re
from collections import defaultdict
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from exposure.llm import filter_audit as audit

places = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(places, max_size=5))
def test_merges_are_set_operations(lists):
    assert audit.union(lists) == sorted(set().union(*lists))
    if len(lists) > 1:
        assert audit.minus(lists[0], lists[1]) == sorted(set(lists[0]) - set(lists[1]))
        assert audit.common(lists[0], lists[1]) == len(set(lists[0]) & set(lists[1]))


def test_gallop():
    runs = [0, 1, 2, 5, 9, 9 + 2**20]
    for low in range(len(runs) + 1):
        for x in (-1, 0, 1, 3, 5, 9, 10, 2**30):
            assert audit.gallop(runs, x, low) == next((i for i in range(low, len(runs)) if runs[i] >= x), len(runs))


def by_hand(docs, labels):
    """Every order on every document, one at a time."""
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    failing = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        f += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and i > smallest[text])
        failing.append((part or "", f, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failing}:
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in failing if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                alone = sum(x[0] == part and x[1] == f for x in failing)
                shapley[f] += len(hit)
                out[part, order, step] = [len(left), len(hit), redundant, alone, sum(x[2] for x in hit), sum(x[3] for x in hit)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, a text with many copies, columns of clashing names, short ranges."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = ["", None, "a b c", "A" * 20, "x$ y", "a " * 150, long, long + " |", " ".join(f"é{i}" for i in range(120)), "a\x85b\xa0c " + "\x1f " * 120]
    docs = [(i, texts[i * 7 % len(texts)], [None, "", "de", "en"][i % 4]) for i in range(80)]
    docs += [(3, "a b c", "de"), (3, "a b c", "de"), (None, "a b c", "en"), (None, None, None)] + [(1000 + i, "same", "en") for i in range(60)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 90, 3)] + [(6, 1, 1), (9, None, None), (None, 1, 1), (9999, 1, 0)]
    table = spark.createDataFrame([(i, t, p, 1, "x") for i, t, p in docs], "doc_id long, text string, lang string, part int, bits string").repartition(3)
    marks = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, id int")
    lists = audit.postings(table, marks, longest=7)
    assert rows(audit.audit(lists)) == by_hand(docs, labels)
    kept = lists.collect()
    assert sum(r.n for r in kept) == len(docs) and max(r.n for r in kept) <= 7
    for r in kept:
        assert all(list(r[k]) == sorted(set(r[k])) for k in audit.LISTS) and len(r.ids) == r.n
    failing_d = sorted(r.ids[i] for r in kept for i in r.D)
    assert failing_d == sorted(i for i, t, _ in docs if re.search("[#$%&*|]", t or ""))


def test_ids_that_are_words(spark):
    docs = [("b", "same", "x"), ("a", "same", "x"), ("c", "other", "x")]
    table = spark.createDataFrame(docs, "doc_id string, text string, lang string")
    marks = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    assert rows(audit.audit(audit.postings(table, marks))) == by_hand(docs, [("b", 1, 0)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.postings(docs, marks)).collect() == []
    one = spark.createDataFrame([(1, "a", "x")], docs.schema)
    assert len(rows(audit.audit(audit.postings(one, marks)))) == 600


def test_query(compared):
    got, want = compared("op11_filter_audit")
    assert got == want and got
