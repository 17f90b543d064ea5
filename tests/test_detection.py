import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from exposure.functions import fixed, values as V
from exposure.functions import names as N
from exposure.operators import detection as D
from exposure.operators import findings as A
from exposure.sources.texts import texts
from tests import values as X


def as_texts(spark, rows):
    return texts(spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, text string"), "t", "id", "text")


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(int(r["id"]), []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def test_value_tiers(spark):
    want = {
        X.MIXED: ("likely", None), X.MIXED16: ("likely", None), X.HEX32: ("likely", "uuid"), X.JWT: ("likely", None),
        X.URLSAFE: ("likely", None), X.UUID: ("likely", "uuid"), X.WEAK: ("possible", "low-transition"),
        "OrchardLanternRiver": ("possible", "word-shaped-passphrase"), "HarbourMeadow1987": ("possible", "low-transition"),
        "ownHiddenPhrase": ("possible", "identifier"), "ReadCipherFromDisk()": ("none", "function-call"),
        "Optional[str]": ("none", "type-annotation"), "changeme": ("none", None), "'changeme'": ("none", None),
        "00000000-0000-0000-0000-000000000000": ("none", None), "short1A": ("none", None),
        "postgres-dev-local": ("none", None), "your_api_key": ("none", None), "xxxxxxxxxx": ("none", None),
        "A1A1A1A1A1": ("none", None), "DEADBEEFCAFE0123456789": ("likely", None),
    }
    df = spark.createDataFrame([(v,) for v in want], "v string").select("v", V.classify("v").alias("c"))
    assert {r.v: (r.c.tier, r.c.reason) for r in df.collect()} == want


def test_value_measures(spark):
    df = spark.createDataFrame([("abcdefgh",), (X.MIXED16,), ("aB",), ("a",), ("",), ("ABc",)], "v string")
    rows = {r.v: r for r in df.select("v", V.entropy("v").alias("e"), V.transition_rate("v").alias("t"), V.word_segments("v").alias("w")).collect()}
    assert rows["abcdefgh"].e == 3.0 and rows[X.MIXED16].e == 4.0 and rows[""].e == 0.0
    assert rows["aB"].t == 1.0 and rows["a"].t == 0.0 and rows["ABc"].w == ["A", "Bc"]


def test_entropy_of_odd_values(spark):
    odd = ["a" * 300, "ab" * 4, "abcdefgh" * 3, "a\nb\n\n", "😀é😀x", "日本語パスワード9a", "".join(map(chr, range(0x4E00, 0x4F00))) + "aab", X.HEX32, X.JWT]
    rows = spark.createDataFrame([(v,) for v in odd], "v string").select("v", V.entropy("v").alias("e")).collect()
    want = {v: -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) for v in odd}
    assert {r.v: r.e for r in rows} == pytest.approx(want, abs=2e-12)


def test_cost_of_findings(spark):
    """Aggregates sort by what tells rows apart, not by the one source; no value is walked character by character."""
    plan = A.text_findings(D.hits(as_texts(spark, ["token=" + X.MIXED])))._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Sort \[(\w+)", plan)) == {"id"} and "sequence(" not in plan
    # A place that no keyword begins at costs one look.
    assert D.ASSIGNMENT.startswith("(?i)(?=[apst])") and all(w[0] in "apst" for w in fixed.KEYWORD_LITERALS)


def test_name_vocabulary(spark):
    yes = ["api_key", "API-KEY", "apikey", "billing_db_password", "token", "'secret'", "private_key", "a_b_passwd"]
    no = ["secret-name", "token-file", "mytoken", "_token", "a__token", "", "api.key", "password-stdin"]
    df = spark.createDataFrame([(n,) for n in yes + no], "n string").where(N.is_secret_name("n"))
    assert sorted(r.n for r in df.collect()) == sorted(yes)


SHAPES = [
    (f"secrets.api_key = {X.MIXED}", ["api_key"]), (f"billing_db_password: {X.MIXED}", ["billing_db_password"]),
    (f'"api_key": "{X.MIXED}"', ["api_key"]), (f"api_key='{X.MIXED}'", ["api_key"]), (f"API_KEY={X.MIXED}", ["API_KEY"]),
    (f'"api_key: {X.MIXED}"', ["api_key"]), (f"!api_key={X.MIXED}", ["api_key"]), (f"api_key=\"{X.MIXED}'", []),
    (f"café_token={X.MIXED}", ["token"]), (f"mytoken={X.MIXED}", ["token"]), (f"secret_token={X.MIXED}", ["secret_token"]),
    ("password=token=abcdefgh12345", ["password", "token"]), (f"secretoken={X.MIXED}", []),
    (f"{'a' * 300}_token={X.MIXED}", ["a" * 255 + "_token"]), (f'"mytoken": "{X.MIXED}"', []),
]


def test_assignment_shapes(spark):
    got = by_id(D.assignment_hits(as_texts(spark, [t for t, _ in SHAPES])).orderBy("seq"), "name")
    assert {i: got.get(i, []) for i in range(len(SHAPES))} == {i: names for i, (_, names) in enumerate(SHAPES)}


FLAGS = ["--password", "--api-key", "--token", "--private-key"]
#: Likely values under each flag, then possible ones.
FIRE = [f"fetcher {flag} {value} north" for flag, value in zip(FLAGS, (X.MIXED16, X.MIXED, X.HEX32, X.URLSAFE))] + [
    f"fetcher --token {X.UUID}", f"loader --db-password {X.MIXED16}", f"loader --password {X.WEAK} -v", f'loader --password "{X.WEAK}"']
#: Names, references, paths, placeholders, flags that only contain the word, and flags without a value.
QUIET = [f"fetcher {flag} {value}" for flag in FLAGS[:3] for value in ("MAIN_ACCESS_KEY", "$MAIN_KEY", '"$MAIN_KEY"', "./store/Main7Key.pem", "/var/store/main_key", "<PUT_IT_HERE>", "--verbose=on")] + [
    "loader --token-file ./main.txt", "loader --password-stdin -u ann", "loader --with-token < main.txt", "loader --secret-name prod/main", "loader --password changeme", f"--api-key={X.MIXED}x $"]


def test_flag_form(spark):
    got = by_id(D.hits(as_texts(spark, FIRE + QUIET[:-1])), "form")
    assert got == {i: ["flag"] for i in range(len(FIRE))}
    strict = by_id(D.hits(as_texts(spark, FIRE), fire_tiers=("likely",)), "form")
    assert sorted(strict) == [0, 1, 2, 3, 4, 5]
    assert by_id(D.hits(as_texts(spark, QUIET[-1:])), "form", "name") == {0: [("assignment", "api-key")]}


def test_vendor_prefixes_and_order(spark):
    kinds = list(X.PREFIXED)
    t = as_texts(spark, list(X.PREFIXED.values()) + [X.PREFIXED["AWS access key id"] + " then " + X.PREFIXED["OpenAI-style key"]])
    got = by_id(D.prefix_marks(t), "prefix_kind")
    assert got == {**{i: [k] for i, k in enumerate(kinds)}, len(kinds): ["OpenAI-style key"]}


def test_bearer(spark):
    t = as_texts(spark, [
        "Authorization: Bearer anotherFieldLabel", f"bearer {X.MIXED}", f"Bearer {X.MIXED} {X.PREFIXED['npm token']}", "Bearer short"])
    assert by_id(D.bearer_marks(t), "bearer_tier") == {0: ["possible"], 1: ["likely"]}


def test_name_tiers_and_findings(spark):
    rows = [
        f'api_key = "ownHiddenPhrase"\nAPI_KEY = "{X.MIXED}"\n', f'api_key = "{X.MIXED}"\napi_key = "ownHiddenPhrase"\n',
        f"token = ownHiddenPhrase\npassword = HarbourMeadow1987\ntoken = HarbourMeadow1987\n--api-key {X.WEAK}",
        f"{X.PREFIXED['npm token']} token={X.UUID} secret = ownHiddenPhrase", "Bearer anotherFieldLabel", f"Bearer {X.MIXED}", "nothing",
    ]
    h = D.hits(as_texts(spark, rows))
    tiers = by_id(A.name_tiers(h).orderBy("first_seq"), "name", "tier", "reasons", "is_flag")
    assert tiers[0] == [("API_KEY", "likely", [], False)] and tiers[1] == [("api_key", "likely", [], False)]
    assert tiers[2] == [
        ("token", "possible", ["identifier", "low-transition"], False), ("password", "possible", ["low-transition"], False),
        ("api-key", "possible", ["flag-form", "low-transition"], True)]
    f = {}
    for r in A.text_findings(h).collect():
        f[(int(r.path), r.confidence)] = (r.secret_names, r.secret_count, r.reasons, r.reason_counts)
    assert f[(2, "possible")] == (["token", "password", "api-key"], 3, ["identifier", "low-transition", "flag-form"],
                                  {"identifier": 1, "low-transition": 3, "flag-form": 1})
    assert f[(3, "certain")][:2] == ([], 1) and f[(3, "likely")] == (["token"], 1, ["uuid"], {"uuid": 1})
    assert f[(3, "possible")][0] == ["secret"] and f[(4, "possible")][:2] == ([], 1) and f[(5, "likely")][:2] == ([], 1)
    assert len(f) == 8
    kinds = by_id(A.best_kind(h), "kind")
    assert kinds == {0: ["API_KEY assignment"], 1: ["API_KEY assignment"], 2: ["TOKEN assignment"], 3: ["npm token"],
                     4: ["Bearer token"], 5: ["Bearer token"]}
    s = A.summary(A.text_findings(h)).collect()[0]
    assert (s.leak_count, s.certain_count, s.likely_count, s.possible_count, s.strict_paranoid, s.exit_code) == (5, 1, 4, 5, 10, 1)
    assert s.headline == "5 exposed secrets at gate high, in this project"
    # Reasons of possible findings, and uuid of likely ones.
    assert s.count_summary == "1 certain · 4 likely · 5 possible (3 identifier · 3 low-transition · 1 uuid · 1 flag-form)"


def test_no_value_leaves(spark):
    h = D.hits(as_texts(spark, [f"token={X.MIXED}"]))
    for df in (h, A.text_findings(h), A.name_tiers(h), A.summary(A.text_findings(h))):
        assert X.MIXED not in str(df.collect())
        A.public(df)
    with pytest.raises(ValueError):
        from exposure.schemas import assert_public
        assert_public(D.valued_hits(as_texts(spark, ["x"])))


def test_binary_and_long_texts(spark):
    long = "x " * 200_000 + f"token={X.MIXED}"
    t = texts(spark.createDataFrame([("a", "a\x00token=" + X.MIXED), ("b", long)], "id string, text string"), "t", "id", "text", drop_binary=True)
    assert [r.id for r in D.hits(t).collect()] == ["b"]
    both = texts(spark.createDataFrame([("a", "a\x00token=" + X.MIXED), ("b", long)], "id string, text string"), "t", "id", "text")
    assert sorted(r.id for r in D.hits(both).collect()) == ["a", "b"]
    cut = texts(spark.createDataFrame([("b", long), ("c", "é" * 10 + f" token={X.MIXED}")], "id string, text string"), "t", "id", "text", max_bytes=256_000)
    assert [r.id for r in D.hits(cut).collect()] == ["c"]


BLOWUPS = {
    "dotted": "a1234567890." * (256 * 1024 // 12) + "token", "underscores": "a_" * (128 * 1024) + "token",
    "alnum": ("a" * 4000 + "_token=") * 65, "flags": ("-" + "a" * 4000 + "_token") * 65,
}


@pytest.mark.parametrize("pattern", [D.ASSIGNMENT, D.FLAG])
@pytest.mark.parametrize("shape", list(BLOWUPS))
def test_patterns_stay_linear(spark, shape, pattern):
    df = spark.createDataFrame([(BLOWUPS[shape],)], "t string").cache()
    df.count()
    q = df.select(F.regexp_count("t", F.lit(pattern)))
    q.collect()
    start = time.perf_counter()
    q.collect()
    assert time.perf_counter() - start < 1.5  # 1.0 s for the pattern, the rest for starting the job


def test_consuming_form_differs_only_by_overlap(spark):
    t = as_texts(spark, ["password=token=abcdefgh12345", f"api_key: '{X.MIXED}'"])
    assert by_id(D.consuming_assignment_hits(t), "name") == {0: ["password"], 1: ["api_key"]}
