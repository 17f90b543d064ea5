import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from exposure.operators import access as AC
from exposure.operators import admission as AD
from exposure.operators import inventory as INV
from exposure.operators import lineage as L
from exposure.operators import sessions as S
from exposure.schemas import REQUESTS

T0 = datetime(2026, 1, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


PROCS = [("h", 10, 1, 100, 1000), ("h", 11, 10, 110, 1000), ("h", 12, 11, 120, 1000), ("h", 20, 1, 200, 1000), ("h", 1, 0, 1, 0),
         ("h", 30, 31, 1, 1000), ("h", 31, 30, 1, 1000), ("h", 40, 40, 1, 1000), ("h", 50, 99, 1, 1000)]


def procs(spark, rows=PROCS):
    return spark.createDataFrame(rows, "host string, pid long, ppid long, start_time long, uid int")


def test_chains(spark):
    got = {r.pid: [n.pid for n in r.chain] for r in L.ancestors(procs(spark)).collect()}
    assert got == {10: [10, 1], 11: [11, 10, 1], 12: [12, 11, 10, 1], 20: [20, 1], 1: [1], 30: [30, 31], 31: [31, 30], 40: [40], 50: [50]}
    long = [("h", i, i - 1, i, 1000) for i in range(1, 60)]
    got = {r.pid: len(r.chain) for r in L.ancestors(procs(spark, long)).collect()}
    assert got[59] == 32 and got[5] == 5 and got[32] == 32


def test_in_tree_and_offer(spark):
    chains = L.ancestors(procs(spark))
    peers = spark.createDataFrame([("h", 12, 120), ("h", 20, 200), ("h", 10, 100)], "host string, pid long, start_time long")

    def tree(admitted):
        rows = spark.createDataFrame(admitted, "host string, pid long, start_time long")
        return sorted(r.pid for r in L.in_tree(peers, rows, chains).collect())

    assert tree([("h", 10, 100)]) == [10, 12] and tree([("h", 10, 999)]) == [] and tree([("h", 12, 120)]) == [12]
    why = {(r.pid, r.node_pid): r.skipped for r in L.offerable_levels(chains, F.lit(1000)).collect()}
    assert why[12, 12] is None and why[12, 11] is None and "depth_floor" in why[12, 10] and "depth_floor" in why[12, 1]
    assert why[11, 11] is None and "depth_floor" in why[11, 10] and why[1, 1] == "system_pid"
    long = L.ancestors(procs(spark, [("h", i, i - 1, i, 1000) for i in range(5, 25)])).where("pid = 24")
    offered = [r.node_pid for r in L.offerable_levels(long, F.lit(1000)).where("skipped is null").orderBy("depth").collect()]
    assert offered == list(range(24, 16, -1))


def requests(spark, rows):
    """(seq, seconds, verb, names, pid, approve, minutes) with the peer's start time ten times its pid."""
    full = [("s", seq, at(sec), verb, names, pid, pid * 10 if pid else None, approve, minutes) for seq, sec, verb, names, pid, approve, minutes in rows]
    return spark.createDataFrame(full, REQUESTS)


def replay(spark, rows, pre=None):
    df = requests(spark, rows)
    chains = L.ancestors(procs(spark)).select("pid", "chain")
    df = df.join(chains, "pid", "left")
    for name, kind in (("pre_admit_seconds", "double"), ("pre_admit_unscoped", "boolean"), ("pre_admit_names", "array<string>")):
        value = (pre or {}).get(name)
        made = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        df = df.withColumn(name, F.when(F.col("verb") == "unlock", made).cast(kind))
    out = AD.admission_replay(df).orderBy("seq", F.desc("event_kind")).collect()
    return [(r.seq, r.event_kind, r.decision, r.via or r.reason) for r in out], out


UNLOCK = (0, 0, "unlock", None, None, None, 30)


def test_scoped_grants(spark):
    got, rows = replay(spark, [
        UNLOCK, (1, 1, "run", ["a"], 10, True, None), (2, 2, "run", ["a"], 12, False, None), (3, 3, "run", ["a", "b"], 12, False, None),
        (4, 4, "run", ["b"], 12, True, None), (5, 5, "run", ["a", "b"], 10, False, None), (6, 6, "status", None, 20, False, None),
        (7, 7, "run", ["z"], 20, True, None), (8, 8, "run", ["a"], 10, False, None), (9, 9, "list", None, None, True, None)])
    assert got == [
        (0, "decision", "allow", "unlock"), (1, "warn", None, "unrecognized peer pid=10"), (1, "decision", "allow", "interactive"),
        (2, "decision", "allow", "granted"), (3, "decision", "deny", "admission denied"), (4, "decision", "allow", "scope expanded"),
        (5, "decision", "allow", "granted"), (6, "warn", None, "unrecognized peer pid=20"), (6, "decision", "deny", "admission denied"),
        (7, "warn", None, "unrecognized peer pid=20"), (7, "decision", "allow", "interactive"), (8, "warn", None, "unrecognized peer pid=10"),
        (8, "decision", "deny", "admission denied"), (9, "warn", None, "peer identity unavailable"), (9, "decision", "deny", "no peer identity")]
    assert [r.granted for r in rows if r.seq == 5] == [["a", "b"]] and [r.request_count for r in rows if r.seq == 7 and r.decision] == [1]


def test_pre_admit_and_renew(spark):
    got, _ = replay(spark, [UNLOCK, (1, 10, "run", ["x"], 20, False, None), (2, 11, "run", ["y"], 10, False, None)],
                    {"pre_admit_seconds": 900.0, "pre_admit_unscoped": True})
    assert got[1:] == [(1, "decision", "allow", "pre-admit"), (2, "warn", None, "unrecognized peer pid=10"), (2, "decision", "deny", "admission denied")]
    got, _ = replay(spark, [UNLOCK, (1, 901, "run", ["x"], 20, True, None)], {"pre_admit_seconds": 900.0, "pre_admit_names": ["x"]})
    assert got[1:] == [(1, "warn", None, "unrecognized peer pid=20"), (1, "decision", "allow", "interactive")]
    # A renew moves the expiry, not the grant: after the old expiry the tree is asked again.
    got, _ = replay(spark, [UNLOCK, (1, 1, "run", ["a"], 10, True, None), (2, 60, "renew", None, 10, False, 120), (3, 1900, "run", ["a"], 10, False, None),
                            (4, 1901, "run", ["a"], 10, True, None), (5, 20000, "run", ["a"], 10, True, None), (6, 20001, "status", None, 10, True, None),
                            (7, 20002, "lock", None, 10, True, None), (8, 20003, "list", None, 10, True, None), (9, 20004, "unlock", None, None, None, 1)])
    assert [(s, d, v) for s, k, d, v in got if k == "decision"] == [
        (0, "allow", "unlock"), (1, "allow", "interactive"), (2, "allow", "granted"), (3, "deny", "admission denied"), (4, "allow", "scope expanded"),
        (5, "deny", "scope expanded"), (6, "allow", "scope expanded"), (7, "allow", "scope expanded"), (8, "deny", "no session"), (9, "allow", "unlock")]


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_session_replay_does_not_depend_on_ranges(spark, partitions):
    rows = [UNLOCK[:6] + (1,), (1, 30, "run", None, 1, None, None), (2, 60, "renew", None, 1, None, 2), (3, 150, "run", None, 1, None, None),
            (4, 181, "renew", None, 1, None, 5), (5, 182, "status", None, 1, None, None), (6, 183, "run", None, 1, None, None),
            (7, 200, "unlock", None, 1, None, 1), (8, 210, "renew", None, 1, None, -1), (9, 220, "lock", None, 1, None, None), (10, 221, "run", None, 1, None, None)]
    out = S.session_replay(requests(spark, rows), partitions=partitions).orderBy("seq").collect()
    assert [(r.state, r.outcome) for r in out] == [
        ("none", "ok"), ("live", "ok"), ("live", "ok"), ("live", "ok"), ("expired", "session expired"), ("expired", "ok"), ("expired", "session expired"),
        ("expired", "ok"), ("live", "invalid minutes"), ("live", "ok"), ("locked", "no session")]


def test_roles(spark):
    members = spark.createDataFrame([("a", "alice", "writer"), ("b", "bob", "runner"), ("r", "root", "admin"), ("g", "guest", "odd")], "member_id string, name string, role string")
    acl = spark.createDataFrame([("alice_only", "a"), ("shared", "a"), ("bob_only", "b"), ("shared", "b"), ("gone", "b")], "secret string, member_id string")
    secrets = spark.createDataFrame([("alice_only",), ("bob_only",), ("shared",)], "name string")
    assert sorted(r.secret for r in AC.export_set(acl, secrets, members, "bob").collect()) == ["bob_only", "shared"]
    actions = spark.createDataFrame([("reveal",), ("run",), ("passwd",)], "action string")
    allowed = {(r.member_id, r.action): r.allowed for r in AC.effective_access(acl, members, actions).collect()}
    assert allowed["b", "reveal"] is False and allowed["b", "run"] and allowed["a", "reveal"] and not allowed["a", "passwd"]
    granted = AC.grant(acl, secrets, members, spark.createDataFrame([("bob_only", "alice"), ("bob_only", "alice"), ("nope", "alice")], "secret string, name string"))
    assert granted.where("member_id = 'a'").count() == 3
    assert AC.revoke(acl, members, spark.createDataFrame([("shared", "bob")], "secret string, name string")).count() == 4
    left, acl2, rotate = AC.remove_members(members, acl, spark.createDataFrame([("bob",)], "name string"))
    assert (left.count(), acl2.count(), sorted(r.secret for r in rotate.collect())) == (3, 2, ["bob_only", "gone", "shared"])
    assert AC.acl_closure(acl, secrets, members).where("member_id = 'r'").count() == 3
    assert {r.rule for r in AC.validate_members(members).collect()} == {"unknown role"}
    assert {r.rule for r in AC.validate_members(left.where("name <> 'root'")).collect()} == {"unknown role", "no admin"}


def test_closure_makes_pairs_without_moving_them(spark):
    """Grants within the pairs count once, null keys too, and no exchange stands above the pairs."""
    acl = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (9, 7), (None, 7), (1, None)], "secret long, member_id long")
    secrets = spark.createDataFrame([(1,), (2,), (None,), (2,)], "name long")
    members = spark.createDataFrame([(7, "a", "admin"), (8, "b", "writer"), (6, "c", "admin"), (6, "d", "admin")], "member_id long, name string, role string")
    got = AC.acl_closure(acl, secrets, members)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, {(s, m) for s in (1, 2, None) for m in (6, 7)} | {(2, 8), (9, 7), (1, None)}))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_closure_is_whole_and_written_small(spark, tmp_path):
    """500 secrets by 9,001 admins, a null among each: every pair once, in few bytes, and nothing is broadcast to make them."""
    secrets = spark.range(500).select(F.when(F.col("id") < 499, F.col("id")).alias("name"))
    members = spark.range(9001).select(F.when(F.col("id") < 9000, F.col("id") * 7).alias("member_id"), F.lit("n").alias("name"), F.lit("admin").alias("role"))
    acl = spark.createDataFrame([(1, 7), (5000, 7), (5000, None), (None, None), (1, 8)], "secret long, member_id long")
    got = AC.acl_closure(acl, secrets, members)
    got.write.parquet(str(tmp_path / "closure"))
    back = spark.read.parquet(str(tmp_path / "closure"))
    assert back.count() == back.distinct().count() == 500 * 9001 + 3
    assert {(r.secret, r.member_id) for r in back.where("secret = 5000 or member_id = 8").collect()} == {(5000, 7), (5000, None), (1, 8)}
    assert sum(f.stat().st_size for f in (tmp_path / "closure").glob("*.parquet")) < 0.3 * 500 * 9001
    assert "CartesianProduct" in (plan := got._jdf.queryExecution().sparkPlan().toString()) and "BroadcastNestedLoopJoin" not in plan


def test_blocks_hold_every_value_once(spark):
    blocks = AC.in_blocks(spark.range(1000).select(F.when(F.col("id") % 500 > 0, F.col("id")).alias("v")), 64).collect()
    assert max(len(b.v) for b in blocks) <= 64 and len({b["__block"] for b in blocks}) == len(blocks)
    assert sorted(v or 0 for b in blocks for v in b.v) == [0, 0, *range(1, 500), *range(501, 1000)]


def test_manifest_check_and_import(spark):
    manifest = spark.createDataFrame([("p", "A", True), ("p", "B", True), ("p", "C", False)], "project string, name string, required boolean")
    names = spark.createDataFrame([("p", "A")], "project string, name string")
    projects = spark.createDataFrame([("p",), ("q",), ("bad",)], "project string")
    errors = spark.createDataFrame([("bad", "line 1 cannot be read")], "project string, error string")
    got = {r.project: r for r in INV.manifest_check(projects, manifest, names, errors).collect()}
    assert (got["p"].ok, got["p"].present_names, got["p"].missing_names, got["p"].optional_absent_names) == (False, ["A"], ["B"], ["C"])
    assert got["q"].ok and not got["bad"].ok and got["bad"].error
    new = spark.createDataFrame([(1, "NAME", "n"), (1, "OTHER", "o1"), (2, "OTHER", "o2")], "file_order int, name string, value string")
    old = spark.createDataFrame([("NAME", "old")], "name string, value string")
    assert {(r.file_order, r["name"]): r.decision for r in INV.import_decisions(new, old).collect()} == {(1, "NAME"): "skipped", (1, "OTHER"): "imported", (2, "OTHER"): "skipped"}
    assert {r["name"]: r.value for r in INV.import_entries(new, old).collect()} == {"NAME": "old", "OTHER": "o1"}
    assert {r["name"]: r.value for r in INV.import_entries(new, old, "overwrite").collect()} == {"NAME": "n", "OTHER": "o2"}


@pytest.mark.parametrize("depth", [1, 2, 5, 32])
def test_chains_are_written_for_processes_with_descendants_only(spark, monkeypatch, depth):
    """A random forest with cycles, unknown parents and many leaves: the plain walk's chains, and no row of a leaf among what is put together."""
    r, written = random.Random(3), []
    parents = {i: r.choice([i - 1, i // 2, i // 2, 999, 0, i]) for i in range(1, 60)} | {60: 61, 61: 62, 62: 60} | {i: 60 for i in range(100, 160)}
    monkeypatch.setattr(L, "store", lambda df, keep=L.store: written.append(keep(df)) or written[-1])
    got = {x.pid: [n.pid for n in x.chain] for x in L.ancestors(procs(spark, [("h", i, p, i, 1000) for i, p in parents.items()]), depth).collect()}

    def walk(i):
        seen = [i]
        while parents[seen[-1]] in parents and parents[seen[-1]] not in seen and len(seen) < depth:
            seen.append(parents[seen[-1]])
        return seen

    assert got == {i: walk(i) for i in parents}
    assert all(x.pid in parents.values() for df in written[1:] for x in df.select("pid").collect()) and written[0].count() == len(parents)
