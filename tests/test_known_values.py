import itertools
import random

from exposure.operators import known_values as K
from exposure.operators.detection import hits
from exposure.sources.texts import texts
from tests import values as X


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def t(spark, rows):
    return texts(table(spark, [(str(i), r) for i, r in enumerate(rows)], "id string, text string"), "t", "id", "text")


def secrets(spark, pairs):
    return table(spark, [(i, n, v) for i, (n, v) in enumerate(pairs)], "seq long, name string, value string")


def fold(text, pairs):
    for name, value in sorted(pairs, key=lambda p: -len(p[1])):
        if value:
            text = text.replace(value, f"***REDACTED({name})***")
    return text


SMALL_LIMITS = K.Limits(values=2, bytes=1 << 20)
PAIRS = [("weird", "a+b*c?d[e]{2}"), ("a", "KLM"), ("b", "NOP"), ("empty", ""), ("pre", "abcd"), ("long", "abcdefgh"),
         ("red", "RED"), ("star", "***"), ("odd", "x***RED"), ("mark", ")***y"), ("one", "z"), ("mid", "ACTED(a")]
TEXTS = ["KLM then NOP, KLM", "a+b*c?d[e]{2} aab", "abcdefgh abcd", "nothing", "RED KLM z", "x" + "KLM" + "y", "z*** **", "KLMy xKLM xNOPy", ""]


def test_redaction_is_the_sequential_fold_either_way(spark):
    want = {str(i): fold(text, PAIRS) for i, text in enumerate(TEXTS)}
    for limits in (K.Limits(), SMALL_LIMITS):
        got = {r.id: r.text for r in K.redact(t(spark, TEXTS), secrets(spark, PAIRS), limits=limits).collect()}
        assert got == want, limits


def test_large_dictionary_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{i}", "key-" + "".join(rng.choices("abAB01", k=rng.randint(1, 9)))) for i in range(60)]
    pairs = list({v: (n, v) for n, v in pairs}.values()) + [("s1", "b0"), ("s2", "A"), ("é", "éèê")]
    rows = [" ".join(rng.choice(pairs)[1] + rng.choice(["", "x", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    want = {(str(i), n): rows[i].count(v) for i, (n, v) in itertools.product(range(len(rows)), pairs) if v in rows[i]}
    for limits in (K.Limits(), SMALL_LIMITS):
        got = {(r.id, r["name"]): r.n for r in K.exposed(t(spark, rows), secrets(spark, pairs), limits=limits).collect()}
        assert got == want
        redacted = {r.id: r.text for r in K.redact(t(spark, rows), secrets(spark, pairs), limits=limits).collect()}
        assert redacted == {str(i): fold(text, pairs) for i, text in enumerate(rows)}


def test_columns_detected_and_residual(spark):
    df = table(spark, [(1, "KLM", "out NOP"), (2, None, "KLM")], "k int, a string, b string")
    for limits in (K.Limits(), K.Limits(values=1)):
        out = {r.k: (r.a, r.b) for r in K.redact_columns(df, ["a", "b"], secrets(spark, [("a", "KLM"), ("b", "NOP")]), limits).collect()}
        assert out == {1: ("***REDACTED(a)***", "out ***REDACTED(b)***"), 2: (None, "***REDACTED(a)***")}
    rows = [f"token={X.MIXED} and --password {X.MIXED16}", "plain"]
    got = {r.id: r.text for r in K.redact_detected(t(spark, rows)).collect()}
    assert got == {"0": "token=***REDACTED(token:likely)*** and --password ***REDACTED(password:likely)***", "1": "plain"}
    d = K.dictionary_of(t(spark, rows))
    assert K.residual(t(spark, rows), d).count() == 0 and K.exposed(t(spark, rows), d).count() == 2
    assert hits(K.redact(t(spark, rows), d)).where("tier = 'likely'").count() == 0


def test_order(spark):
    got = [r["name"] for r in K.redaction_order(secrets(spark, [("x", "ab"), ("y", "abc"), ("w", "cd"), ("e", "")])).collect()]
    assert got == ["y", "x", "w"]


def test_a_large_dictionary_is_narrowed_to_what_occurs(spark):
    """A thousand values, a pass of five: one pass with those that stand in a text or come up on the way to the redacted one."""
    pairs = [(f"n{i}", f"ORD-{i:08d}") for i in range(1000)] + [("mark", "D(n7)*"), ("later", "N(k")]
    rows = ["see ORD-00000007", "ORD-0000000", "none", ""]
    five = K.Limits(values=5)
    (held,) = K.prepare(secrets(spark, pairs), five, t(spark, rows), redacting=True)
    assert {name for *_, name in held.value.entries} == {"n7", "mark"}
    got = {r.id: r.text for r in K.redact(t(spark, rows), secrets(spark, pairs), limits=five).collect()}
    assert got == {str(i): fold(text, pairs) for i, text in enumerate(rows)}
