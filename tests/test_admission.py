import random

import pandas as pd
import pytest

import __spark_entry__ as entry
from exposure.operators import admission as A
from tests.test_access import at

CHAIN = "array<struct<pid:bigint,start_time:bigint,uid:int>>"
SCHEMA = (
    "session string, seq long, ts timestamp, verb string, secret_names array<string>, pid long, start_time long, approve boolean, minutes int, "
    f"chain {CHAIN}, pre_admit_seconds double, pre_admit_unscoped boolean, pre_admit_names array<string>"
)


def log(seed, hot, forgetful):
    """A hot run of one unlock beside short ones. Without forgetting, one tree stays admitted all along and only its grants grow."""
    r = random.Random(seed)
    rows = []

    def ask(session, i, verb, approve=None):
        pid = r.choice([10, 11, 12, 20]) if forgetful else r.choice([10, 11, 12])
        up = {10: [(10, 10, 1)], 11: [(11, 11, 1), (10, 10, 1)], 12: [(12, 12, 1), (11, 11, 1), (10, 10, 1)], 20: [(20, 20, 1)]}[pid]
        rows.append((session, i, at(7 * i), verb, [f"S{r.randint(0, 30)}"], pid if r.random() < 0.97 else None, pid, r.random() < 0.2 if approve is None else approve,
                     r.choice([None, 30, -2, 1]), up, None, None, None))

    for session, n in [("a", 40), ("hot", hot), ("z", 40)]:
        rows.append((session, 0, at(0), "unlock", None, None, None, None, 30, None, r.choice([None, 900.0]), False, ["S1"]))
        for i in range(1, n):
            if session != "hot" and r.random() < 0.1:
                rows.append((session, i, at(7 * i), "unlock", None, None, None, None, 1, None, 50.0, True, None))
            else:
                ask(session, i, r.choices(["run", "renew", "status", "lock", "list"], [6, 2, 1, 0 if session == "hot" else 1, 1])[0], True if i == 1 else None)
    return rows


def one_fold(rows):
    """The plain fold of each session from its first request to its last."""
    out, runs = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        named = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) | {"us": int(pd.Timestamp(r[2]).value // 1000)}
        named["chain"] = [{"pid": p, "start_time": s} for p, s, _ in r[9]] if r[9] else None
        out += A.output_rows(runs.setdefault(r[0], A.Run()), A.request_row(named))
    return sorted((r[0], r[1], r[4], str(r[5]), str(r[6]), str(r[7]), r[8], tuple(r[9]), r[10]) for r in out)


@pytest.mark.parametrize("forgetful", [True, False])
@pytest.mark.parametrize("partitions", [None, 2, 9])
def test_ranges_of_a_run_give_the_plain_fold(spark, forgetful, partitions):
    rows = log(5, 600, forgetful)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = A.admission_replay(df, partitions).collect()
    found = sorted((r.session, r.seq, r.event_kind, str(r.decision), str(r.via), str(r.reason), r.request_count, tuple(r.granted), r.unscoped) for r in got)
    want = one_fold(rows)
    assert found == want and len({w[3:6] for w in want}) > 6
    assert {r.ts for r in got} == {r[2] for r in rows}


def test_no_requests(spark):
    assert A.admission_replay(spark.createDataFrame([], SCHEMA)).collect() == []


def test_warned_requests_are_marked_in_the_replay(spark):
    """Each row of a request that raised a warning says so, and no other; the rows are found without a second replay."""
    rows = spark.createDataFrame(log(5, 60, True), SCHEMA)
    got = A.admission_replay(rows).select("session", "seq", "event_kind", "warned").collect()
    warned = {(r.session, r.seq) for r in got if r.event_kind == "warn"}
    assert warned and all(r.warned == ((r.session, r.seq) in warned) for r in got)
    plan = entry.queries()["t5_peer_warnings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_replay") == 1 and "LeftSemi" not in plan
