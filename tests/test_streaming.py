import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from exposure.operators import admission as AD
from exposure.operators import audit as AU
from exposure.operators.detection import hits
from exposure.operators.transcripts import string_hits
from exposure.sources.texts import texts
from exposure.streaming import audit as SA
from exposure.streaming import scan as SS
from exposure.streaming.sessions import admission_stream, session_stream
from exposure.streaming.snapshot import current, upsert
from tests import values as X
from tests.test_access import T0, UNLOCK, procs, requests
from exposure.operators import lineage as L

SF = "/root/testdata/sf0.01"


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_scan_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    SS.run_available(SS.scan_stream(spark, str(tmp_path / "in"), schema, "documents", "doc_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    cols = ["src", "id", "seq", "name", "tier"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())
    want = sorted(tuple(r) for r in hits(texts(docs, "documents", "doc_id", "text")).select(*cols).collect())
    assert got == want and len(got) == 13


def test_transcript_stream(spark, tmp_path):
    rows = [("p", i, json.dumps({"a": json.dumps({"token": X.MIXED})})) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, line_no int, raw string")
    df.write.parquet(str(tmp_path / "in"))
    stream = SS.transcript_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert drain(stream, tmp_path, "lines").count() == string_hits(df).count() == 5


def audit_source(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "user_id", F.when(F.col("event_type") == "error", "denied").otherwise("allowed").alias("result"))
    e.coalesce(1).write.parquet(str(tmp_path / "ev"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    e, stream = audit_source(spark, tmp_path)
    batch = e.withColumn("ts", F.col("ts").cast("timestamp"))
    live = drain(SA.audit_windows(stream, "1 hour"), tmp_path, "w1")
    want = {tuple(r) for r in AU.audit_windows(batch, "1 hour").collect()}
    got = {tuple(r) for r in live.collect()}
    assert got <= want and len(want) - len(got) <= 2  # the newest windows stay open behind the watermark
    sessions = drain(SA.activity_sessions(stream, "user_id", "30 minutes"), tmp_path, "w2")
    assert sessions.count() == 9540
    doubled = drain(SA.dedup_audit(stream.unionByName(stream), ["event_id"]), tmp_path, "w3")
    assert doubled.count() == e.count()


def test_late_report(spark, tmp_path):
    report = SA.late_report(delay_seconds=600)
    one = spark.createDataFrame([(T0,), (T0 + timedelta(hours=1),)], "ts timestamp")
    two = spark.createDataFrame([(T0,), (T0 + timedelta(hours=2),)], "ts timestamp")
    assert [tuple(report(b, i).first()) for i, b in enumerate((one, two))] == [(0, 2, 0), (1, 2, 1)]
    store = str(tmp_path / "late")
    # Each batch is reported by a process of its own, the second one twice.
    assert [tuple(SA.late_report(store)(b, i).first()) for i, b in ((0, one), (1, two), (1, two))] == [(0, 2, 0), (1, 2, 1), (1, 2, 1)]


def test_admission_stream_equals_replay(spark, tmp_path):
    rows = [UNLOCK, (1, 1, "run", ["a"], 10, True, None), (2, 2, "run", ["a"], 12, False, None), (3, 3, "run", ["a", "b"], 12, False, None),
            (4, 4, "run", ["b"], 12, True, None), (5, 60, "renew", None, 10, False, 120), (6, 7, "run", ["z"], 20, True, None)]
    df = AD.with_inputs(requests(spark, rows).join(L.ancestors(procs(spark)).select("pid", "chain"), "pid", "left"))
    df.coalesce(1).write.parquet(str(tmp_path / "rq"))
    late = spark.createDataFrame([("other", 0, T0 + timedelta(days=1), "unlock", None, None, None, None, 1)],
                                 "session string, seq long, ts timestamp, verb string, secret_names array<string>, pid long, start_time long, approve boolean, minutes int")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rq"))
    AD.with_inputs(late.withColumn("chain", F.lit(None).cast(df.schema["chain"].dataType))).coalesce(1).write.mode("append").parquet(str(tmp_path / "rq"))
    got = [tuple(r) for r in drain(admission_stream(stream), tmp_path, "adm").where("session = 's'").collect()]
    want = [tuple(r) for r in AD.admission_replay(df).collect()]
    keep = lambda rows: sorted((r[1], r[4], str(r[5]), str(r[6]), tuple(r[9])) for r in rows if r[3] != "expire")
    assert keep(got) == keep(want)
    assert [r[4] for r in got if r[3] == "expire"] == ["expired"]


def shuffled_log(spark, tmp_path, df, files, days):
    """A log whose rows lie in files at random, read a few files at a time, and a late row that moves the watermark past them all."""
    path = str(tmp_path / "log")
    df.repartition(files, F.rand(5)).write.parquet(path)
    end = df.agg(F.max("ts")).first()[0] + timedelta(days=days)
    last = {"session": "end", "seq": 0, "ts": end, "verb": "unlock"}
    closing = spark.range(1).select(*(F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    closing.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(path)


def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")


def test_sessions_of_a_shuffled_log(spark, tmp_path):
    from exposure.operators.sessions import session_replay
    from exposure.plans.audit_queries import requests as events

    small_batches(spark)
    try:
        df = events(spark, SF).where("session % 5 = 0").drop("event_id")
        stream = session_stream(shuffled_log(spark, tmp_path, df, 11, 100), delay="60 days")
        key = lambda r: (r.session, r.seq, r.ts, r.verb, r.state, r.outcome, r.expires_at)
        got = sorted(map(key, drain(stream, tmp_path, "ses").where("session <> 'end'").collect()), key=str)
        want = sorted(map(key, session_replay(df).collect()), key=str)
        assert got == want and len({r[5] for r in want}) >= 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_admission_of_a_shuffled_log(spark, tmp_path):
    """Over files shuffled at random, several micro-batches and Arrow batches of a few rows: the stream's rows are the replay's."""
    from exposure.plans.audit_queries import admission_requests

    small_batches(spark)
    try:
        df = AD.with_inputs(admission_requests(spark, SF).where("session % 5 = 0"))
        stream = admission_stream(shuffled_log(spark, tmp_path, df, 11, 100), delay="60 days")
        rows = drain(stream, tmp_path, "adms").where("session <> 'end'").collect()
        key = lambda r: (r.session, r.seq, r.ts, r.verb, r.event_kind, r.decision, r.via, r.reason, r.request_count, tuple(r.granted), r.unscoped)
        got = sorted((key(r) for r in rows if r.verb != "expire"), key=str)
        want = sorted(map(key, AD.admission_replay(df).collect()), key=str)
        assert got == want and {"pre-admit", "interactive", "granted", "scope expanded"} <= {r[6] for r in want}
        assert any(r.verb == "expire" for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_snapshot_stream(spark, tmp_path):
    apply = upsert(str(tmp_path / "store"))
    schema = "source string, content binary, modified timestamp"
    now = datetime(2026, 1, 1)
    apply(spark.createDataFrame([("a", b"1", now), ("b", b"2", now)], schema), 0)
    apply(spark.createDataFrame([("a", None, now), ("b", b"3", now), ("c", b"4", now)], schema), 1)
    assert kept(spark, tmp_path) == {"a": b"1", "b": b"3", "c": b"4"}


def kept(spark, tmp_path):
    return {r.source: bytes(r.content) for r in current(spark, str(tmp_path / "store")).collect()}


def test_snapshots_write_what_changed(spark, tmp_path):
    """Random versions, unreadable and removed sources, bases now and then, batches run twice by a job that starts anew: rows written are those changed."""
    r = random.Random(4)
    schema = "source string, content binary, modified timestamp, gone boolean"
    store, state = str(tmp_path / "store"), {}
    for batch_id in range(11):
        rows, wanted = [], dict(state)
        for source in r.sample("abcdefgh", 4):
            content, gone = r.choice([None, b"x", b"y", b"z"]), r.random() < 0.2
            rows.append((source, content, T0, gone))
            if gone:
                wanted.pop(source, None)
            elif content is not None:
                wanted[source] = content
        if rows:
            rows.append((rows[0][0], b"older", T0 - timedelta(days=1), False))
            if rows[0][1] is None and not rows[0][3]:
                wanted[rows[0][0]] = b"older"
        changed = {k for k in {*state, *wanted} if state.get(k) != wanted.get(k)}
        for _ in range(1 + batch_id % 2):  # a batch that failed behind its write is run again
            upsert(store, compact_every=4)(spark.createDataFrame(rows, schema), batch_id)
            if (batch_id + 1) % 4:
                written = spark.read.parquet(f"{store}/changes/{batch_id}")
                assert {x.source for x in written.collect()} >= changed and written.count() <= len(changed) + sum(g for *_, g in rows)
        state = wanted
        assert kept(spark, tmp_path) == state
    assert {p.name for p in (tmp_path / "store" / "base").iterdir()} == {"7"} and len(list((tmp_path / "store" / "changes").iterdir())) == 3


def test_half_a_base_is_none(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", b"1", T0)], "source string, content binary, modified timestamp")
    upsert(store)(rows, 0)
    (tmp_path / "store" / "base" / "0").mkdir(parents=True)  # a job that was killed before its base was complete
    assert kept(spark, tmp_path) == {"a": b"1"}


def test_late_rows_are_counted_and_dropped(spark, tmp_path):
    """Rows behind the watermark: counted batch by batch, and by Spark's own count of rows dropped."""
    for k, ts in enumerate([T0, T0 + timedelta(hours=3), T0 + timedelta(hours=4), T0 + timedelta(hours=5)]):
        rows = [(ts + timedelta(seconds=i), 10 * k + i) for i in range(5)] + [(T0 - timedelta(hours=1), 1000 + k)]
        spark.createDataFrame(rows, "ts timestamp, event_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = SA.late_by_batch(stream, str(tmp_path / "job"), delay_seconds=600).orderBy("batch_id").collect()
    assert [(r.n, r.late) for r in found] == [(6, 0), (6, 1), (6, 1), (6, 1)]
    with SA.dropped_rows(spark) as dropped:
        unique = drain(SA.dedup_audit(stream, ["event_id"]), tmp_path, "ded").count()
    assert unique + sum(dropped.values()) == 24 and 2 <= sum(dropped.values()) <= 3


def test_waiting_requests_cost_one_call_to_the_state_a_batch():
    """The processor alone, over states that count their calls: as many for a hundred requests as for one."""
    import pandas as pd

    from exposure.streaming.sessions import SessionProcessor

    class State:
        calls, kept = 0, None

        def __getattr__(self, name):
            State.calls += 1
            if name == "get":
                return lambda: self.kept
            if name == "appendList":
                return lambda rows: setattr(self, "kept", [*(self.kept or []), *rows])
            return lambda *a: setattr(self, "kept", a[0] if a else None)

    class Handle:
        getValueState = getListState = getMapState = lambda self, *a: State()
        registerTimer = deleteTimer = lambda self, ms: None

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)

    calls = []
    for n in (1, 100):
        p, State.calls = SessionProcessor(), 0
        p.init(Handle())
        rows = [{"session": "a", "seq": i, "us": i * 1000, "verb": "unlock" if i == 0 else "run"} for i in reversed(range(n))]
        assert list(p.handleInputRows(("a",), iter([pd.DataFrame(rows)]), None)) == []
        (out,) = p.handleExpiredTimer(("a",), Now, None)
        assert out["seq"].tolist() == list(range(n)) and set(out["outcome"]) == {"ok"}
        calls.append(State.calls)
    assert calls[0] == calls[1]


def test_snapshots_move_packed_contents(spark, tmp_path):
    """Contents lie packed in the store, and what a store of before wrote unpacked is still read."""
    schema = "source string, content binary, modified timestamp, gone boolean"
    store, body = str(tmp_path / "store"), b"a line that comes again\n" * 400
    old = [("a", 0, "9600:x", False, body), ("b", 0, "0:y", False, b""), ("c", 0, "1:z", False, b"c"), ("d", 0, "", True, None)]
    spark.createDataFrame(old, "source string, batch long, fingerprint string, gone boolean, content binary").write.parquet(f"{store}/changes/0")
    rows = [("b", body, T0, False), ("c", body, T0, True), ("d", b"", T0, False), ("e", None, T0, False), ("f", body, T0, False)]
    for batch_id, part in ((1, rows), (2, [("g", body, T0, False)])):
        upsert(store, compact_every=3)(spark.createDataFrame(part, schema), batch_id)
        if batch_id == 1:
            written = spark.read.parquet(f"{store}/changes/1").selectExpr("sum(octet_length(packed))").first()[0]
            assert "content" not in spark.read.parquet(f"{store}/changes/1").columns and written < 500
            assert kept(spark, tmp_path) == {"a": body, "b": body, "d": b"", "f": body}
    assert kept(spark, tmp_path) == {"a": body, "b": body, "d": b"", "f": body, "g": body}
    plan = current(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
