"""Streams over the test tables, run through all that is there, with the SQL that the batch form has."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.operators import admission
from exposure.operators import detection as det
from exposure.operators import findings as fd
from exposure.operators import transcripts as tr
from exposure.plans import oracle as o
from exposure.plans.audit_queries import GUARD, REPLAY_SQL, guard_requests, requests
from exposure.plans.detection_queries import every_text
from exposure.plans.registry import query, table
from exposure.session import STATE_STORE, own_folder, spread
from exposure.sources import sinks
from exposure.streaming import audit as sa
from exposure.streaming import sessions as live
from exposure.streaming.scan import run_available, scan_stream
from exposure.streaming.snapshot import current, upsert

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def arbitrary_state(spark: SparkSession) -> Iterator[None]:
    """Arbitrary state needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Everything a stream gives for what is there now."""
    folder = own_folder(stream.sparkSession, name)
    with arbitrary_state(stream.sparkSession):
        run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def log_of(df: DataFrame, name: str, files: int = 8) -> DataFrame:
    """A table as a log whose rows lie in files at random, read two files at a time, closed by a row that moves the watermark past all others."""
    folder = f"{own_folder(df.sparkSession, name)}/log"
    df.repartition(files, F.xxhash64("session", "seq")).write.parquet(folder)
    end = df.agg(F.max("ts") + F.expr("interval 400 days")).first()[0]
    last = {"session": "end", "seq": 0, "ts": end, "verb": "unlock"}
    closing = df.sparkSession.range(1).select(*(F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    closing.coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


@query("t1_scan_stream", f"""WITH {o.graded(o.DOCUMENTS)} SELECT id, seq::BIGINT AS seq, name, tier FROM g""")
def t1_scan_stream(spark, sf):
    """Documents as a stream of files: the hits of a batch scan."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = own_folder(spark, "documents")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    spread(docs).write.parquet(folder)
    return drained(scan_stream(spark, folder, schema, "documents", "doc_id", "text"), "hits").where("form = 'assignment'").select("id", "seq", "name", "tier")


@query("t2_live_sessions", f"WITH RECURSIVE {REPLAY_SQL} SELECT event_id, state, outcome, before AS expires_us FROM s WHERE i > 0")
def t2_live_sessions(spark, sf):
    """Sessions of a log that arrives in no order: the rows of the replay."""
    out = drained(live.session_stream(log_of(requests(spark, sf).drop("event_id"), "requests"), delay="60 days"), "sessions")
    return out.where("session <> 'end'").select(F.col("seq").alias("event_id"), "state", "outcome", F.unix_micros("expires_at").alias("expires_us"))


@query("t3_live_grants", f"""WITH RECURSIVE {GUARD} SELECT user_id, event_id, verb, decision, via, reason, array_to_string(granted, ',') AS granted FROM d""")
def t3_live_grants(spark, sf):
    """Admission of a log that arrives in no order: the decisions of the replay."""
    out = drained(live.admission_stream(log_of(admission.with_inputs(guard_requests(spark, sf)), "guard"), delay="60 days"), "grants")
    return out.where("session <> 'end' AND event_kind = 'decision'").select(
        F.col("session").cast("bigint").alias("user_id"), F.col("seq").alias("event_id"), "verb", "decision", "via", "reason", F.array_join("granted", ",").alias("granted"))


# Four versions of every document, one batch each: some change, some cannot be read, some go and some of those come back.
@query("t9_snapshot_log", """WITH v AS (SELECT doc_id, text, b, CASE WHEN doc_id % 5 = b THEN NULL ELSE coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' v' || b END END AS content, doc_id % 7 = b AS gone FROM documents, range(4) r(b)),
    s AS (SELECT doc_id, max(b) FILTER (gone) AS left_at, max(b) FILTER (content IS NOT NULL AND NOT gone) AS read_at FROM v GROUP BY doc_id)
    SELECT v.doc_id::VARCHAR AS source, sha256(v.content) AS sha FROM s JOIN v ON v.doc_id = s.doc_id AND v.b = s.read_at WHERE left_at IS NULL OR read_at > left_at""")
def t9_snapshot_log(spark, sf):
    """Last good versions after four batches of file versions."""
    store, doc = own_folder(spark, "snapshots"), F.col("doc_id")
    apply = upsert(store, compact_every=3)
    for b in range(4):
        body = F.concat(F.coalesce("text", F.lit("")), F.when(doc % 3 == 0, "").otherwise(f" v{b}"))
        batch = table(spark, sf, "documents").select(
            doc.cast("string").alias("source"), F.when(doc % 5 != b, body.cast("binary")).alias("content"),
            F.timestamp_seconds(F.lit(b)).alias("modified"), (doc % 7 == b).alias("gone"))
        apply(batch, b)
    return current(spark, store).select("source", F.sha2("content", 256).alias("sha"))


@query("t12_redelivered_records", "SELECT user_id, event_type AS action, count(*)::BIGINT AS n, epoch_us(min(ts)) AS first_us FROM events GROUP BY ALL")
def t12_redelivered_records(spark, sf):
    """Every record delivered twice, in files of their own: each counts once."""
    folder = own_folder(spark, "delivered")
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    for half in (0, 1):
        e.unionByName(e).where(F.col("event_id") % 2 == half).repartition(2, F.rand(1)).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    once = drained(sa.dedup_audit(stream, ["event_id"], "60 days"), "unique")
    return once.groupBy("user_id", "action").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"))


LATE_BATCH = "least(5, CAST(floor(event_id * 6 / (SELECT max(event_id) + 1 FROM events)) AS BIGINT) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END)"


@query("t13_late_records", f"""WITH e AS (SELECT epoch_us(ts) AS t, {LATE_BATCH} AS batch_id FROM events), m AS (SELECT batch_id, max(t) AS newest FROM e GROUP BY batch_id),
    b AS (SELECT batch_id, max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS line FROM m)
    SELECT batch_id, count(*)::BIGINT AS n, count(*) FILTER (t < line)::BIGINT AS late FROM e JOIN b USING (batch_id) GROUP BY batch_id""")
def t13_late_records(spark, sf):
    """A log in six batches, one record in fifty a batch late: how many arrive behind the newest time seen less ten minutes."""
    folder, k = own_folder(spark, "late"), F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("event_id")).first()[0]
    e = e.withColumn("b", F.least(F.lit(5), F.floor(k * 6 / (last + 1)) + F.when(k % 50 == 0, 1).otherwise(0)))
    for b in range(6):
        e.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.drop("b").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return sa.late_by_batch(stream, f"{folder}/job")


@query("s12_findings", f"""WITH {o.findings(o.EVERY_TEXT)} SELECT src, path, tier AS confidence, secret_names, secret_count FROM f""")
def s12_findings(spark, sf):
    """Findings written as JSON in two batches, one of them twice, and read back."""
    found, folder = fd.public(fd.text_findings(det.hits(every_text(spark, sf)))), own_folder(spark, "findings")
    for batch_id, part in ((0, "src = 'documents'"), (1, "src <> 'documents'"), (1, "src <> 'documents'")):
        sinks.write_batch(found.where(part), folder, batch_id)
    back = sinks.read_batches(spark, folder, found.schema)
    return back.select("src", "path", "confidence", F.array_join("secret_names", ",").alias("secret_names"), "secret_count")


# What each turn of a conversation says, by a number from 0 to 5: a likely name, a vendor token beside a likely name, a bearer, a possible name, nothing, nothing.
SAID = "(conv_id * 3 + turn) % 6"


@query("a7_assembled_findings", f"""WITH l AS (SELECT conv_id, (turn + 1)::INT AS n, {SAID} AS k FROM conversations),
    t AS (SELECT conv_id, 'certain' AS confidence, count(*) FILTER (k = 1) AS c, list(n ORDER BY n) FILTER (k = 1) AS hit_lines, CASE WHEN bool_or(k = 1) THEN ['npm token'] ELSE [] END AS names, 0 AS reasons FROM l GROUP BY conv_id
      UNION ALL SELECT conv_id, 'likely', count(*) FILTER (k IN (0, 2)), list(n ORDER BY n) FILTER (k IN (0, 2)), list_transform(list_sort(list_filter([{{'n': min(n) FILTER (k = 0), 'name': 'token'}}, {{'n': min(n) FILTER (k = 1), 'name': 'api_key'}}], lambda x: x.n IS NOT NULL)), lambda x: x.name), 0 FROM l GROUP BY conv_id
      UNION ALL SELECT conv_id, 'possible', count(*) FILTER (k = 3), list(n ORDER BY n) FILTER (k = 3), CASE WHEN bool_or(k = 3) THEN ['password'] ELSE [] END, count(*) FILTER (k = 3) FROM l GROUP BY conv_id)
    SELECT conv_id::VARCHAR AS path, confidence, coalesce(array_to_string(hit_lines, ','), '') AS hit_lines, array_to_string(names, ',') AS secret_names, c::BIGINT AS secret_count,
      'transcript, ' || CASE WHEN c = 0 THEN confidence || ' names, all on lines that already count' ELSE c || ' line(s): ' || CASE confidence WHEN 'certain' THEN 'vendor-prefixed tokens (heuristic)' WHEN 'likely' THEN 'likely secret assignments (heuristic)' ELSE 'possible secret assignments' END END AS reason,
      CASE WHEN reasons > 0 THEN 'word-shaped-passphrase' ELSE '' END AS reasons, CASE WHEN reasons > 0 THEN reasons::BIGINT END AS passphrases
    FROM t WHERE c > 0 OR len(names) > 0""")
def a7_assembled_findings(spark, sf):
    """Whole findings of transcripts, with bearers, vendor tokens and names that stand only on lines that already count."""
    k, value = F.expr(SAID), F.concat(F.lit("Zk9pL2xQ"), F.col("conv_id") * 1000 + F.col("turn"), F.lit("vB8w"))
    said = (
        F.when(k == 0, F.concat(F.lit("token="), value)).when(k == 1, F.concat(F.lit("npm_aaaaaaaaaaaaaaaaaaaaaaaa and api_key="), value))
        .when(k == 2, F.concat(F.lit("Bearer aB3xQ9mK"), F.col("conv_id") * 1000 + F.col("turn"), F.lit("pL7vN4wZ8")))
        .when(k == 3, F.lit("password=Summer-Garden-Lantern")).otherwise(F.lit("nothing to see"))
    )
    lines = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("line_no"),
        F.to_json(F.struct("role", F.struct(said.alias("content")).alias("message"))).alias("raw"))
    found = tr.transcript_findings(tr.line_tiers(tr.string_hits(lines)))
    return found.select(
        "path", "confidence", F.array_join(F.col("hit_lines").cast("array<string>"), ",").alias("hit_lines"), F.array_join("secret_names", ",").alias("secret_names"), "secret_count", "reason",
        F.array_join("reasons", ",").alias("reasons"), F.col("reason_counts")["word-shaped-passphrase"].alias("passphrases"))
