import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from exposure.functions import names as N
from exposure.operators import audit as AU
from exposure.operators import findings as A
from exposure.operators import inventory as INV
from exposure.operators import ordered as O
from exposure.sources import lines as L
from exposure.sources import sinks
from exposure.sources.files import select_files


def lines(spark, path, text):
    return spark.createDataFrame([(path, i, raw) for i, raw in enumerate(text.split("\n"), 1)], "path string, line_no int, raw string")


def test_dotenv(spark):
    text = "\n".join(["A=1", "export B = two", 'C="a b # c"', "D='x'", "E=v # note", "F=v#x", "# G=1", "", "bad line", "A=last", "H=", "  I='\"'  "])
    got = [(r.line_no, r["name"], r.value) for r in L.dotenv_entries(lines(spark, "p", text)).orderBy("line_no").collect()]
    assert got == [(1, "A", "last"), (2, "B", "two"), (3, "C", "a b # c"), (4, "D", "x"), (5, "E", "v"), (6, "F", "v#x"), (11, "H", ""), (12, "I", '"')]
    files = spark.createDataFrame([("p", b"A=1\r\nB=2\nC=3\xff")], "path string, content binary")
    assert [(r["name"], r.value) for r in L.dotenv_entries(L.lines(files)).orderBy("line_no").collect()] == [("A", "1"), ("B", "2"), ("C", "3�")]


MANIFEST = '''
title = "x"
[secrets.A]
required = true
description = "d"
env = "A_ENV"
[secrets."B-1"]
required = false
[other]
env = 5
list = [
  "a",
]
[[secret]]
name = "A"
required = false
[[secret]]
name = "L"
'''


def test_manifest(spark):
    df = lines(spark, "p", MANIFEST).unionByName(lines(spark, "bad", "[secrets.X]\nrequired = \"yes\"")).unionByName(lines(spark, "worse", "[secrets.X\n")).unionByName(
        lines(spark, "anon", "[[secret]]\nrequired = true")).unionByName(lines(spark, "none", "# nothing"))
    rows = {(r.project, r["name"]): r for r in L.manifest_rows(df).collect()}
    assert {k for k in rows} == {("p", "A"), ("p", "B-1"), ("p", "L"), ("bad", None), ("worse", None), ("anon", None)}
    assert (rows["p", "A"].required, rows["p", "A"].description, rows["p", "A"].env) == (True, "d", "A_ENV")
    assert (rows["p", "B-1"].required, rows["p", "B-1"].env, rows["p", "L"].required) == (False, "B-1", True)
    assert "wrong type" in rows["bad", None].error and "cannot be read" in rows["worse", None].error
    want = spark.createDataFrame([("p", n) for n in ("A", "A_ENV", "L", "NEW")], "path string, name string")
    blocks = [r.block for r in L.manifest_blocks(df, want).collect()]
    assert blocks == ['[secrets.NEW]\nrequired = true\ndescription = ""\nenv = "NEW"\n']


def test_names_and_keys(spark):
    files = spark.createDataFrame([("a", b'{"names": ["X", "Y"]}'), ("b", b'{"names": 5}'), ("c", b"nope"), ("d", b'{"k1": 1, "k0": {"z": 2}}')], "path string, content binary")
    assert sorted((r.scope, r["name"]) for r in L.names(files).collect()) == [("a", "X"), ("a", "Y")]
    keys = L.json_keys(files.select("path", F.col("content").cast("string").alias("t")), "t")
    assert [r.key for r in keys.where("path = 'd'").collect()] == ["k1", "k0"] and keys.where("path = 'c'").first().key is None


def test_file_names(spark):
    kinds = {".env": "dotenv", ".env.local": "dotenv", ".env.imported": None, ".environment": None, "credentials.json": "credentials.json", ".npmrc": ".npmrc",
             "id_ed25519": "ssh_private_key", "mcp.json": "mcp_config", ".zsh_history": "shell_history", "my_history": "shell_history", ".git-credentials": "git_config", "a.py": None}
    df = spark.createDataFrame([("/x/" + n,) for n in kinds], "path string").select("path", N.file_kind("path").alias("k"), N.suffix("path").alias("s"))
    rows = {r.path[3:]: r for r in df.collect()}
    assert {n: r.k for n, r in rows.items()} == kinds
    assert rows[".env"].s == "" and rows[".env.local"].s == ".local" and rows["a.py"].s == ".py"
    paths = ["/r/a.py", "/r/node_modules/a.py", "/r/x.egg-info/a", "/r/a.pyc", "/r/.vault/a", "/build/r/a"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in select_files(files, "/r", (".vault",)).collect()] == ["/r/a.py", "/build/r/a"]
    assert select_files(files, "/r", (".vault",), include_excluded=True).count() == 4


def test_audit_round_trip(spark, tmp_path):
    row = (datetime(2026, 1, 1, 12, 0, 0, 999), "run", ["A"], ["ls", "-l"], "inline", "allowed", "")
    schema = "ts timestamp, action string, secret_names array<string>, command array<string>, route string, result string, reason string"
    good = spark.createDataFrame([row], schema)
    path = str(tmp_path / "audit")
    AU.append_audit(good, path)
    AU.append_audit(good, path)
    (tmp_path / "audit" / "more.json").write_text('{"timestamp":"2026-01-01T00:00:00+00:00","action":"list","command":"ls -l","route":"inline","result":"warn"}\nbroken\n')
    got = AU.audit_log(spark, path).orderBy("ts", "action").collect()
    assert [r.action for r in got] == ["list", "run", "run"] and got[0].command == ["ls -l"] and got[1].command == ["ls", "-l"] and got[0].secret_names == []
    assert AU.corrupt_records(spark, path).first().n == 1
    bad = good.withColumn("route", F.lit("socket"))
    assert AU.split_valid(bad)[1].first().violation == "invalid route: socket"
    with pytest.raises(Exception, match="invalid route"):
        AU.append_audit(bad, str(tmp_path / "never"))


def test_sinks(spark, tmp_path):
    names = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b")], "scope string, name string")
    sinks.write_names(names, str(tmp_path / "names"))
    assert sorted(r["name"] for r in spark.read.json(str(tmp_path / "names")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.write_findings(names.withColumn("value", F.lit("x")), str(tmp_path / "f"))
    from exposure.operators.detection import hits
    from exposure.sources.texts import texts

    f = A.text_findings(hits(texts(spark.createDataFrame([("1", "token=aB3xQ9mK2pL7")], "id string, text string"), "t", "id", "text")))
    sinks.write_findings(f, str(tmp_path / "f"))
    sinks.write_summary(A.summary(f), str(tmp_path / "s"))
    record = json.loads(next((tmp_path / "s").glob("part-*.json")).read_text())
    assert record["leak_count"] == 1 and "No values" in record["detection_note"]


def test_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(9)
    numbered = O.number_rows(df, ["a", F.desc("b")]).orderBy("n").collect()
    assert [(r.a, -r.b) for r in numbered] == sorted((i % 7, -i) for i in range(500)) and [r.n for r in numbered] == list(range(1, 501))
    picked = O.pick(O.number_rows(df, ["a", "b"]), spark.createDataFrame([(1,), (500,), (900,)], "i int"))
    assert sorted(r.n for r in picked.collect()) == [1, 500]
    secrets = spark.createDataFrame([("global", 0, "A", "g"), ("project", 1, "A", "p"), ("global", 0, "B", "g")], "scope string, precedence int, name string, value string")
    assert {r["name"]: r.value for r in O.merge_precedence(secrets).collect()} == {"A": "p", "B": "g"}


def test_snapshot(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, content string")
    cur = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("d", "4"), ("e", None)], "source string, content string")
    assert {r.source: (r.status, r.use_previous) for r in INV.snapshot_refresh(prev, cur).collect()} == {
        "a": ("unchanged", True), "b": ("changed", False), "c": ("kept", True), "d": ("new", False), "e": ("unreadable", False)}


def test_deep_trees_long_files_and_what_is_skipped(spark, tmp_path):
    """No limit on levels or sizes, lone surrogates are no trouble, and what is left out is counted."""
    from exposure.plans.scan import leak_scan, skipped

    deep = tmp_path / "p"
    for i in range(60):
        deep = deep / f"d{i}"
    deep.mkdir(parents=True)
    secret = "Qx7mZp2Lw9Rt4Vb6"
    (deep / "far.txt").write_text("x " * 150_000 + f"token={secret}")
    assert [r.secret_count for r in leak_scan(spark, str(tmp_path / "p")).collect()] == [1]
    home = tmp_path / "home"
    from exposure.functions import fixed

    shape = fixed.TRANSCRIPT_LAYOUTS[0]
    folder = home / shape[0] / "a"
    folder.mkdir(parents=True)
    name = next(n for n in ("s.jsonl", "a/s.jsonl", "rollout-1.jsonl") if __import__("re").fullmatch(shape[1], f"a/{n}"))
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"a": f"token={secret} \ud83d"}) + "\n{token broken\n")
    found = {r.kind: r.secret_count for r in leak_scan(spark, str(tmp_path / "p"), [str(home)]).collect()}
    assert found.get("agent_session_transcript") == 1
    assert {r.reason: r.n for r in skipped(spark, str(tmp_path / "p"), [str(home)]).collect()} == {"unreadable": 0, "not JSON": 1}


def test_run_without_command(spark):
    from exposure.operators.sessions import dispatch

    rows = [(1, "run", ["A"], "ls"), (2, "run", ["A"], " "), (3, "run", ["B"], "ls"), (4, "list", None, None)]
    requests = spark.createDataFrame(rows, "request_id long, verb string, secret_names array<string>, command string")
    got = {r.request_id: (r.result, r.reason) for r in dispatch(requests, spark.createDataFrame([("A",)], "name string")).collect()}
    assert got == {1: ("allowed", None), 2: ("denied", "no_command"), 3: ("denied", "unknown secrets"), 4: ("allowed", None)}
