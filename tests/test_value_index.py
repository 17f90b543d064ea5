import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from exposure.operators import known_values as K
from exposure.operators import value_index as V
from exposure.sources.texts import texts

SALT = os.urandom(16)
values = st.lists(st.text("ab*R(é日", min_size=1, max_size=40), min_size=1, max_size=12, unique=True)


def index(pairs):
    prints = V.Fingerprints(SALT)
    ordered = sorted(pairs, key=lambda p: (-len(p[1]), p[0]))
    return V.Index(SALT, [(prints.one(v.encode()), len(v.encode()), V.digest(v.encode(), SALT), n) for n, v in ordered]), ordered


@settings(max_examples=200, deadline=None)
@given(values, st.lists(st.text("ab*R(é日", max_size=80), max_size=6), st.randoms())
def test_counts_and_redaction_against_plain_search(found, rows, r):
    rows = rows + ["".join(r.choice(found) for _ in range(r.randint(0, 5)))]
    built, ordered = index([(f"REDACTED{i}" if i % 3 else "a", v) for i, v in enumerate(found)])
    raw = [t.encode() for t in rows]
    for text, got in zip(rows, built.counts(b"".join(raw), K._ends(raw))):
        want = {}
        for name, value in ordered:
            if value in text:
                want[name] = want.get(name, 0) + text.count(value)
        assert got == want
    for text in rows:
        want = text
        for name, value in ordered:
            want = want.replace(value, f"***REDACTED({name})***")
        assert built.redacted(text.encode()).decode() == want


def test_blocks(monkeypatch):
    """Places at every offset to the ends of blocks, windows longer than what is left."""
    monkeypatch.setattr(V, "BLOCK", 50)
    pairs = [(str(n), "x" * n + "y") for n in (0, 1, 2, 3, 7, 15, 16, 31, 32, 40, 70)]
    built, _ = index(pairs)
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice(["x", "xxxx", "y", "z"]) for _ in range(r.randint(0, 150)))
        (got,) = built.counts(text.encode(), [len(text)])
        assert got == {n: text.count(v) for n, v in pairs if v in text}


def large(n):
    r = random.Random(9)
    return [(f"n{i}", f"sk_live_{r.getrandbits(64):016x}") for i in range(n)] + [("short", "q"), ("long", "p" * 5000), ("unicode", "übergroß-日本")]


def test_twenty_thousand_values_in_one_scan(spark):
    """One pass over the texts, no text in a shuffle, no value in the plan; the same over several passes."""
    pairs = large(20_000)
    rows = [f"{pairs[i * 97 % 20_000][1]} and {pairs[i * 31 % 20_000][1]}q{'p' * (i % 2 * 5003)}" for i in range(200)] + ["sk_live_" * 1000, "übergroß-日本" * 3, ""]
    secrets = spark.createDataFrame(pairs, "name string, value string").repartition(4)
    t = texts(spark.createDataFrame([(str(i), r) for i, r in enumerate(rows)], "id string, text string"), "t", "id", "text").repartition(3)
    found = K.exposed(t, secrets)
    plan = found._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1 and not any(v in plan for _, v in pairs[:50])
    want = {}
    by_value = {v: n for n, v in pairs}
    for i, r in enumerate(rows):
        for v in {r[k : k + 24] for k in range(len(r)) if r.startswith("sk_live_", k)} & by_value.keys() | {v for _, v in pairs[-3:] if v in r}:
            want[str(i), by_value[v]] = r.count(v)
    assert {(x.id, x["name"]): x.n for x in found.collect()} == want
    few = K.Limits(values=6_000)
    assert len(K.prepare(secrets, few)) == 4
    assert {(x.id, x["name"]): x.n for x in K.exposed(t, secrets, limits=few).collect()} == want
    clean = K.redact(t, secrets)
    assert {r.id: r.text for r in clean.collect()} == {r.id: r.text for r in K.redact(t, secrets, limits=few).collect()}
    assert K.exposed(clean, secrets.where("name like 'n%'")).isEmpty() and clean.where(F.col("text").contains("sk_live_0")).isEmpty()


def test_names_beyond_a_pass(spark):
    secrets = spark.createDataFrame([(f"{'name' * 50}{i}", f"value-{i}") for i in range(9)], "name string, value string")
    assert len(K.prepare(secrets, K.Limits(bytes=500))) == 5
    assert K.prepare(secrets.limit(0)) == []
    one = texts(spark.createDataFrame([("1", "value-3"), ("2", None)], "id string, text string"), "t", "id", "text")
    assert K.exposed(one, secrets, limits=K.Limits(bytes=500)).count() == 1 and K.exposed(one, secrets.limit(0)).isEmpty()
    assert K.redact(one, secrets.limit(0)).count() == one.count()
