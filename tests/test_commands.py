import pytest
from pyspark.sql import functions as F

from exposure.operators import commands as C
from exposure.operators import rules as R
from tests import values as X

T = "keeper"
#: An own small rule table: verb, nested verb or option, effect.
RULES = [("wipe", None, "deny"), ("team", "drop", "deny"), ("sweep", "--force", "deny"), ("with", None, "wrap"), ("team", "show", "allow")]
LAUNCHERS = ["{}", "/opt/bin/{}", "python3 -m {}", "uvx {}", "env MODE=1 {}", "MODE=1 LEVEL=2 {}", "tools\\{}.exe"]


def rules_of(spark, tool=T):
    return spark.createDataFrame([(tool, *r) for r in RULES], "tool string, verb string, sub string, effect string")


def decisions(spark, texts, rules=None, tools=(T,)):
    log = spark.createDataFrame(list(enumerate(texts)), "cmd_id long, text string")
    rows = C.policy_decisions(log, rules_of(spark) if rules is None else rules, list(tools)).collect()
    return {texts[r.cmd_id]: (r.decision, r.kind) for r in rows}


def test_policy_rules_under_every_launcher(spark):
    denied = {"wipe": "wipe", "team drop ann": "team drop", "sweep --force": "sweep --force", "sweep --force=2 here": "sweep --force", "-q=1 wipe all": "wipe"}
    free = ["show", "team show", "sweep", "sweep force", "team", "--help wipe", "unheard-of", ""]
    want = {}
    for launcher in LAUNCHERS:
        call = launcher.format(T)
        want.update({f"{call} {tail}": ("deny", f"{T} {kind}") for tail, kind in denied.items()})
        want.update({f"{call} {tail}": ("allow", None) for tail in free})
    want.update({f"echo {T} wipe": ("allow", None), "ls": ("allow", None), f"make && {T} wipe": ("deny", f"{T} wipe"), f"sh -c '{T} wipe'": ("deny", f"{T} wipe")})
    assert decisions(spark, list(want)) == want


def test_policy_in_deep_nesting(spark):
    """However deep a denied command stands, it is found."""
    inner, want = f"{T} wipe", {}
    for depth in range(1, 13):
        around = f"{T} with wrapping " * depth
        want[f"{T} with -- " * depth + inner] = ("deny", around + inner)
    assert decisions(spark, list(want)) == want


def test_rules_of_other_tools_do_not_count(spark):
    assert decisions(spark, [f"{T} wipe"], rules_of(spark, "other")) == {f"{T} wipe": ("allow", None)}
    both = rules_of(spark, "other").unionByName(rules_of(spark).where("verb = 'team'"))
    assert decisions(spark, [f"{T} wipe", f"{T} team drop"], both) == {f"{T} wipe": ("allow", None), f"{T} team drop": ("deny", f"{T} team drop")}


def test_tokens_chunks_and_depth(spark):
    df = spark.createDataFrame([("a 'b c' \"d\"e && f;g | h",), ("C:\\x \"a b\" c\"d e\"",), ("it's open",), ("  ",)], "t string")
    rows = df.select(C.tokens(F.col("t")).alias("w"), C.chunks(C.tokens(F.col("t"))).alias("c")).collect()
    assert rows[0].w == ["a", "b c", "de", "&&", "f;g", "|", "h"] and rows[0].c == [["a", "b c", "de"], ["f;g"], ["h"]]
    assert rows[1].w == ["C:\\x", '"a b"', 'c"d', 'e"'] and rows[2].w == ["it's", "open"] and rows[3].w == []
    deep = "keeper run -- " * 7 + "keeper show X"
    kinds = C.parse(spark.createDataFrame([(1, deep)], "cmd_id long, text string"), [T]).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {"tool": 8, "trailing": 7}


def test_command_secrets(spark):
    log = spark.createDataFrame([
        (1, f"keeper run --secret A -- dbshell --password {X.MIXED16}"), (2, f"keeper list && curl --token {X.HEX32}"),
        (3, f"keeper run --password {X.MIXED16} -- ls"), (4, f"dbshell --password {X.MIXED16}"),
        (5, f"bash -c 'dbshell --password {X.MIXED16}'")], "cmd_id long, text string")
    assert sorted(r.id for r in C.scan_command_text(log, [T]).collect()) == ["1", "2", "4", "5"]


def test_rule_lists(spark):
    allow = spark.createDataFrame([("Bash(v set:*)",), ("Bash(v set *) — in the project",), ("Bash(v list:*)",), ("Bash(v set *)x",)], "entry string")
    deny = spark.createDataFrame([("Bash(v set *)",)], "entry string")
    assert sorted(r.entry for r in R.rule_conflicts(allow, deny).collect()) == sorted(["Bash(v set:*)", "Bash(v set *) — in the project", "Bash(v set *)x"])
    df = spark.createDataFrame([(["mine", "old", "a"], ["a", "b", "b"], ["old", "a"])], "e array<string>, o array<string>, s array<string>")
    assert df.select(R.refresh_rules(F.col("e"), F.col("o"), F.col("s")).alias("r")).first().r == ["mine", "a", "b"]
    rules = C.policy_rules(spark, T)
    verbs = rules.where("sub is null or sub not like '--%'").select(F.concat_ws(" ", "verb", "sub").alias("label"))
    assert R.rule_coverage(rules, verbs).count() == 0
    assert [r.problem for r in R.rule_coverage(rules, verbs.unionByName(spark.createDataFrame([("new",)], "label string"))).collect()] == ["no rule"]


@pytest.mark.parametrize("argv,verb,rest", [
    (["-x", "v", "set", "A"], "set", ["A"]), (["--a=b", "set"], "set", []), (["-x", "--y", "z"], "", []), (["--version", "q"], "--version", ["q"]),
    (["-h"], "--help", []), (["--", "a"], "--", ["a"]), ([], "", []), (["-x", "--", "a"], "--", ["a"])])
def test_first_verb(spark, argv, verb, rest):
    r = spark.createDataFrame([(argv,)], "a array<string>").select(C.first_verb(F.col("a")).alias("v")).first().v
    assert (r.verb, r.rest) == (verb, rest)


def test_each_line_is_taken_apart_once(spark, monkeypatch):
    parsed, parse = [], C.parse
    monkeypatch.setattr(C, "parse", lambda df, *a, **k: parsed.append(df.count()) or parse(df, *a, **k))
    texts = [f"{T} with -- {T} wipe", f"{T} show", None, "ls"] * 20
    log = spark.createDataFrame(list(enumerate(texts)), "cmd_id long, text string")
    got = {r.cmd_id: r.decision for r in C.policy_decisions(log, rules_of(spark), [T]).collect()}
    assert parsed == [2] and got == {i: "deny" if i % 4 == 0 else "allow" for i in range(80)}
