import json
import time

from exposure.operators import findings as A
from exposure.operators import transcripts as T
from exposure.plans.scan import leak_scan
from exposure.sources.lines import oversized, transcript_files, transcripts
from tests import values as X


def lines(spark, files):
    rows = [(p, i, raw) for p, lines_ in files.items() for i, raw in enumerate(lines_, 1)]
    return spark.createDataFrame(rows, "path string, line_no int, raw string")


def found(spark, files):
    out = T.transcript_findings(T.line_tiers(T.string_hits(lines(spark, files))))
    return {(r.path, r.confidence): r for r in out.collect()}


def said(text, **more):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}, **more})


def test_fixture_shapes(spark):
    got = found(spark, {
        "leaks": [said("x"), said("y"), said("key " + X.PREFIXED["Anthropic-style key"]), said("z"),
                  said("w", toolUse=json.dumps({"command": f"export API_KEY={X.MIXED} && curl x"})), said("done")],
        "clean": [said("List files"), said("Sure")],
        "bearer": [said(f"saw Bearer {X.MIXED} in the log")],
        "nested": [json.dumps({"payload": {"text": "npm token " + X.PREFIXED["npm token"]}}), said("all clear")],
        "mixed": [said(f'api_key = "{X.MIXED}"\ntoken = ownHiddenPhrase')],
        "both": [said(f'{X.PREFIXED["OpenAI-style key"]}\napi_key = "{X.MIXED}"')],
        "broken": ["{not json token=" + X.MIXED, "", said(f"token={X.MIXED}")],
    })
    assert (got["leaks", "certain"].hit_lines, got["leaks", "certain"].secret_names) == ([3], ["Anthropic-style key"])
    assert (got["leaks", "likely"].hit_lines, got["leaks", "likely"].secret_names) == ([5], ["API_KEY"])
    assert not [k for k in got if k[0] == "clean"]
    assert got["bearer", "likely"].secret_count == 1 and got["bearer", "likely"].secret_names == []
    assert got["nested", "certain"].hit_lines == [1]
    assert got["mixed", "likely"].hit_lines == [1]
    assert (got["mixed", "possible"].hit_lines, got["mixed", "possible"].secret_names, got["mixed", "possible"].secret_count) == ([], ["token"], 0)
    assert got["both", "certain"].secret_count == 1
    assert (got["both", "likely"].secret_count, got["both", "likely"].secret_names) == (0, ["api_key"])
    assert got["broken", "likely"].hit_lines == [3]
    s = A.leak_counts(T.transcript_findings(T.line_tiers(T.string_hits(lines(spark, {"mixed": [said(f'api_key = "{X.MIXED}"\ntoken = ownHiddenPhrase')]}))))).first()
    assert (s.strict_high, s.strict_paranoid, s.possible_count, s.transcript_line_hits) == (1, 1, 0, 1)


def test_keys_unwrap_and_escapes(spark):
    got = found(spark, {
        "key": [json.dumps({"api_key": X.MIXED, "list": [{"db_password": "HarbourMeadow1987"}]})],
        "once": [json.dumps({"a": json.dumps({"b": json.dumps({"token": X.MIXED}), "password": X.MIXED16})})],
        "escaped": ['{"a":"\\u0074oken=' + X.MIXED + '"}'],
        "number": [json.dumps({"token": 12345678})],
    })
    assert got["key", "likely"].secret_names == ["api_key"] and got["key", "possible"].secret_names == ["db_password"]
    # The outer string is opened once: its key counts, the container string inside it is not scanned again.
    assert got["once", "likely"].secret_names == ["password"]
    assert got["escaped", "likely"].secret_names == ["token"]
    assert not [k for k in got if k[0] == "number"]


def test_first_reason_and_kind_follow_document_order(spark):
    z_first = json.dumps({"z": "token = ownHiddenPhrase " + X.PREFIXED["npm token"], "a": "token = HarbourMeadow1987 " + X.PREFIXED["AWS access key id"]})
    tiers = T.line_tiers(T.string_hits(lines(spark, {"p": [z_first]}))).collect()
    assert {(r.form, r.name, tuple(r.reasons)) for r in tiers} == {("name", "token", ("identifier",)), ("prefix", "npm token", ())}


def test_names_follow_line_order(spark):
    got = found(spark, {"p": [said("token = ownHiddenPhrase"), said(f"TOKEN={X.MIXED}"), said("Token = HarbourMeadow1987"), said("secret = ownHiddenPhrase")]})
    assert got["p", "likely"].secret_names == ["TOKEN"]
    assert got["p", "possible"].secret_names == ["token", "secret"]
    assert got["p", "possible"].hit_lines == [1, 3, 4]
    assert got["p", "possible"].reason_counts == {"identifier": 2, "low-transition": 1}


def test_pages_hold_every_line(spark):
    tiers = T.line_tiers(T.string_hits(lines(spark, {"p": [said(f"token={X.MIXED}")] * 25})))
    pages = T.hit_line_pages(tiers, page_lines=10).orderBy("page").collect()
    assert [r.hit_lines for r in pages] == [list(range(1, 11)), list(range(11, 21)), list(range(21, 26))]


def test_bulky_lines_in_time(spark):
    inner = {f"k{i}": {"text": "lorem ipsum " * 20, "l": ["z" * 100] * 15} for i in range(20)}
    payload = {"message": {"content": json.dumps(inner)}, "api_key": json.dumps(inner), "token": json.dumps({"deeper": ["z" * 100] * 15})}
    df = lines(spark, {"p": [json.dumps(payload)] * 200})
    start = time.perf_counter()
    T.line_ranks(T.line_tiers(T.string_hits(df))).collect()
    assert time.perf_counter() - start < 20.0


def test_files_and_scopes(spark, tmp_path):
    home, root = tmp_path / "home", tmp_path / "proj"
    for folder in (home / ".claude/projects/a/b", home / ".codex/sessions/1", home / ".copilot/session-state/s", home / ".ssh", root / "node_modules/x", root / ".vault"):
        folder.mkdir(parents=True)
    (home / ".claude/projects/a/b/s.jsonl").write_text(said(f"token={X.MIXED}") + "\n" + said("x") + "\n")
    (home / ".codex/sessions/1/rollout-1.jsonl").write_text(said(X.PREFIXED["npm token"]))
    (home / ".codex/sessions/1/other.jsonl").write_text(said(X.PREFIXED["npm token"]))
    (home / ".copilot/session-state/s/events.jsonl").write_text(said("clear"))
    (home / ".ssh/id_rsa").write_text("key")
    (home / ".env").write_text("# empty\n")
    (root / ".env").write_text("A=1\nexport B='x y'\nC=\n")
    (root / "main.py").write_text(f"token = '{X.MIXED}'\n")
    (root / "demo.py").write_text("secret = ownHiddenPhrase\n")
    (root / "mcp.json").write_text('{"name": "sample"}')
    (root / "node_modules/x/.env").write_text("A=1")
    (root / ".vault/v.py").write_text(f"token = '{X.MIXED}'\n")
    (root / "bin.txt").write_bytes(b"\x00token=" + X.MIXED.encode())
    names = sorted(r.path.rsplit("/", 1)[1] for r in transcript_files(spark, [str(home)]).select("path").collect())
    assert names == ["events.jsonl", "rollout-1.jsonl", "s.jsonl"]
    assert oversized(transcript_files(spark, [str(home)])).first().n == 0
    assert transcripts(spark, [str(home)]).where("raw <> ''").count() == 4
    f = leak_scan(spark, str(root), [str(home)], private_dirs=(".vault",))
    got = {(r.path.rsplit("/", 1)[1], r.scope, r.confidence): r for r in f.collect()}
    assert set(got) == {
        (".env", "project", "certain"), ("main.py", "project", "likely"), ("demo.py", "project", "possible"), ("mcp.json", "project", "possible"),
        ("id_rsa", "deep", "certain"), ("s.jsonl", "deep", "likely"), ("rollout-1.jsonl", "deep", "certain")}
    assert (got[".env", "project", "certain"].secret_names, got[".env", "project", "certain"].importable) == (["A", "B"], True)
    assert got["mcp.json", "project", "possible"].reasons == ["unconfirmed-mcp-shape"]
    s = A.summary(A.importable(f)).first()
    assert s.leak_count == 2
    counts = A.leak_counts(f.where("scope = 'project'")).first()
    assert (counts.strict_certain, counts.strict_high, counts.strict_paranoid) == (2, 3, 5)
    everything = leak_scan(spark, str(root), private_dirs=(".vault",), include_excluded=True)
    assert everything.where("path like '%node_modules%'").count() == 1 and everything.where("path like '%.vault%'").count() == 0
