"""Counts, gates, roll-ups, redaction and known-value exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.operators import detection as det
from exposure.operators import findings as fd
from exposure.operators import known_values as kv
from exposure.operators import ordered
from exposure.operators import transcripts as tr
from exposure.plans import oracle as o
from exposure.plans.detection_queries import documents, every_text
from exposure.plans.registry import query, table
from exposure.plans.scan import scan_texts, source_exposure
from exposure.session import spread


@query("source_exposure", f"""WITH {o.findings("SELECT source AS src, doc_id::VARCHAR AS id, text FROM documents")}
    SELECT d.source, d.texts, coalesce(l, 0)::BIGINT AS likely_count, coalesce(p, 0)::BIGINT AS possible_count, coalesce(l, 0)::BIGINT AS strict_high,
           (coalesce(l, 0) + coalesce(p, 0))::BIGINT AS strict_paranoid
    FROM (SELECT source, count(*)::BIGINT AS texts FROM documents GROUP BY source) d LEFT JOIN (
      SELECT src, sum(secret_count) FILTER (tier = 'likely') AS l, sum(secret_count) FILTER (tier = 'possible') AS p FROM f GROUP BY src) f ON f.src = d.source""")
def source_exposure_query(spark, sf):
    """Where are secrets exposed, and how sure are we: tier counts per source, sources without any kept."""
    docs = table(spark, sf, "documents")
    sources = docs.groupBy("source").agg(F.count("*").alias("texts"))
    t = _texts_by_source(docs)
    return source_exposure(t, sources.withColumnRenamed("source", "src"), "src").select(
        F.col("src").alias("source"), "texts", "likely_count", "possible_count", "strict_high", "strict_paranoid"
    )


def _texts_by_source(docs):
    return spread(docs.select("source", "doc_id", "text")).select(
        F.col("source").alias("src"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("part"), "text"
    ).where("text is not null")


# Findings made from orders: many paths, every tier, scope, kind and reason shape.
FINDINGS_SQL = """SELECT o_orderkey AS k, '/f/' || o_custkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'dotenv' WHEN 1 THEN 'inline' WHEN 2 THEN 'agent_session_transcript' ELSE 'mcp_config' END AS kind,
    (o_orderkey % 7 - 1)::BIGINT AS secret_count, o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 AS importable, CASE WHEN o_orderkey % 2 = 0 THEN 'project' ELSE 'deep' END AS scope,
    CASE o_orderkey % 3 WHEN 0 THEN 'certain' WHEN 1 THEN 'likely' ELSE 'possible' END AS confidence, o_orderkey % 3 AS rank, o_orderkey % 5 AS r, o_orderkey % 2 = 0 AS has_counts,
    o_orderstatus AS status FROM orders"""


def order_findings(spark, sf):
    k = F.col("o_orderkey")
    reasons = F.element_at(F.expr(
        "array(cast(array() as array<string>), array('identifier'), array('low-transition', 'identifier'), array('uuid'), array('unconfirmed-mcp-shape'))"
    ), (k % 5 + 1).cast("int"))
    counts = F.when(k % 2 == 0, F.map_from_arrays(reasons, F.transform(reasons, lambda r: F.length(r).cast("bigint")))).otherwise(
        F.expr("cast(map() as map<string,bigint>)"))
    empty = F.expr("cast(array() as array<string>)")
    return table(spark, sf, "orders").select(
        F.lit("orders").alias("src"), F.concat(F.lit("/f/"), "o_custkey").alias("path"), F.lit(0).alias("part"),
        F.when(k % 4 == 0, "dotenv").when(k % 4 == 1, "inline").when(k % 4 == 2, "agent_session_transcript").otherwise("mcp_config").alias("kind"),
        F.when(k % 11 == 0, empty).otherwise(F.array(F.lit("NAME"))).alias("secret_names"),
        (k % 7 - 1).cast("bigint").alias("secret_count"), F.lit("").alias("reason"), ((k % 4 == 0) & (k % 3 == 0)).alias("importable"),
        F.when(k % 2 == 0, "project").otherwise("deep").alias("scope"), F.expr("cast(array() as array<int>)").alias("hit_lines"),
        F.when(k % 3 == 0, "certain").when(k % 3 == 1, "likely").otherwise("possible").alias("confidence"),
        reasons.alias("reasons"), counts.alias("reason_counts"), F.col("o_orderstatus").alias("status"), k.alias("k"),
    )


@query("p6_gates", f"""WITH f AS ({FINDINGS_SQL}) SELECT g AS strict, count(*)::BIGINT AS n FROM f, (VALUES ('certain', 0), ('high', 1), ('paranoid', 2)) s(g, w) WHERE rank <= w GROUP BY g""")
def p6_gates(spark, sf):
    f = order_findings(spark, sf)
    parts = [fd.gate(f, g).groupBy(F.lit(g).alias("strict")).agg(F.count("*").alias("n")) for g in ("certain", "high", "paranoid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p7_importable", f"WITH f AS ({FINDINGS_SQL}) SELECT k, path FROM f WHERE importable AND secret_count > 0")
def p7_importable(spark, sf):
    return fd.importable(order_findings(spark, sf)).select("k", "path")


@query("p8_without_empty_dotenv", f"WITH f AS ({FINDINGS_SQL}) SELECT kind, count(*)::BIGINT AS n FROM f WHERE NOT (kind = 'dotenv' AND secret_count = 0 AND k % 11 = 0) GROUP BY kind")
def p8_without_empty_dotenv(spark, sf):
    return fd.drop_empty_dotenv(order_findings(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("p11_listed", f"WITH f AS ({FINDINGS_SQL}) SELECT k, path, confidence FROM f WHERE rank <= 1 AND NOT (secret_count = 0 AND kind = 'agent_session_transcript')")
def p11_listed(spark, sf):
    return fd.listed(order_findings(spark, sf)).select("k", "path", "confidence")


@query("p12_public_hits", f"WITH {o.graded(o.DOCUMENTS)} SELECT id, name, tier, sha256(value) AS value_sha256 FROM g")
def p12_public_hits(spark, sf):
    hits = det.valued_hits(documents(spark, sf)).withColumn("value_sha256", F.sha2("value", 256))
    return fd.public(hits).select("id", "name", "tier", "value_sha256")


COUNTS = """coalesce(sum(greatest(secret_count, 0)) FILTER (rank = 0), 0)::BIGINT AS certain_count, coalesce(sum(greatest(secret_count, 0)) FILTER (rank = 1), 0)::BIGINT AS likely_count,
    coalesce(sum(greatest(secret_count, 0)) FILTER (rank = 2), 0)::BIGINT AS possible_count, coalesce(sum(greatest(secret_count, 0)) FILTER (rank <= 0), 0)::BIGINT AS strict_certain,
    coalesce(sum(greatest(secret_count, 0)) FILTER (rank <= 1), 0)::BIGINT AS strict_high, coalesce(sum(greatest(secret_count, 0)) FILTER (rank <= 2), 0)::BIGINT AS strict_paranoid,
    coalesce(sum(greatest(secret_count, 0)) FILTER (rank <= 1 AND kind = 'agent_session_transcript'), 0)::BIGINT AS transcript_line_hits"""


@query("a8_leak_counts", f"WITH f AS ({FINDINGS_SQL}) SELECT kind, {COUNTS} FROM f GROUP BY kind")
def a8_leak_counts(spark, sf):
    return fd.leak_counts(order_findings(spark, sf), ("kind",))


@query("a9_gate_totals", f"WITH f AS ({FINDINGS_SQL}), c AS (SELECT rank, sum(greatest(secret_count, 0)) AS n FROM f GROUP BY rank), w AS (SELECT rank, sum(n) OVER (ORDER BY rank) AS total FROM c) "
       "SELECT CASE rank WHEN 0 THEN 'certain' WHEN 1 THEN 'high' ELSE 'paranoid' END AS strict, total::BIGINT AS leaks FROM w")
def a9_gate_totals(spark, sf):
    totals = fd.leak_counts(order_findings(spark, sf))
    return totals.select(F.inline(F.array(*(
        F.struct(F.lit(g).alias("strict"), F.col(f"strict_{g}").alias("leaks")) for g in ("certain", "high", "paranoid")))))


@query("a10_transcript_line_hits", f"WITH f AS ({FINDINGS_SQL}) SELECT status, {COUNTS.split('AS strict_paranoid,')[1].strip()} FROM f GROUP BY status")
def a10_transcript_line_hits(spark, sf):
    return fd.leak_counts(order_findings(spark, sf), ("status",)).select("status", "transcript_line_hits")


@query("a11_scope_split", f"""WITH f AS ({FINDINGS_SQL}), s AS (SELECT sum(greatest(secret_count, 0)) FILTER (scope = 'project')::BIGINT AS here, sum(greatest(secret_count, 0)) FILTER (scope <> 'project')::BIGINT AS away
    FROM f WHERE rank <= 1) SELECT here, away, 'on this machine — ' || here || ' in this project, ' || away || ' outside it' AS location FROM s""")
def a11_scope_split(spark, sf):
    return fd.scope_split(order_findings(spark, sf))


REASON_BUCKETS = f"""f AS ({FINDINGS_SQL}), x AS (SELECT *, CASE r WHEN 0 THEN [] WHEN 1 THEN ['identifier'] WHEN 2 THEN ['low-transition', 'identifier'] WHEN 3 THEN ['uuid'] ELSE ['unconfirmed-mcp-shape'] END AS rs FROM f),
    p AS (SELECT unnest(CASE WHEN len(rs) = 0 THEN ['identifier'] ELSE rs END) AS reason, rs, has_counts, secret_count FROM x WHERE confidence = 'possible'
          UNION ALL SELECT 'uuid', rs, has_counts, secret_count FROM x WHERE confidence = 'likely' AND list_contains(rs, 'uuid')),
    b AS (SELECT reason, sum(CASE WHEN has_counts AND len(rs) > 0 THEN length(reason) WHEN len(rs) > 1 THEN 1 ELSE greatest(secret_count, 1) END)::BIGINT AS n FROM p GROUP BY reason)"""


@query("a12_reason_buckets", f"WITH {REASON_BUCKETS} SELECT reason, n FROM b")
def a12_reason_buckets(spark, sf):
    return fd.reason_buckets(order_findings(spark, sf))


@query("a13_summary", f"""WITH {REASON_BUCKETS}, c AS (SELECT {COUNTS} FROM f), s AS (SELECT sum(greatest(secret_count, 0)) FILTER (scope = 'project')::BIGINT AS here, sum(greatest(secret_count, 0)) FILTER (scope <> 'project')::BIGINT AS away FROM f WHERE rank <= 1),
    l AS (SELECT string_agg(n || ' ' || CASE reason WHEN 'word-shaped-passphrase' THEN 'passphrase' ELSE reason END, ' · ' ORDER BY CASE reason WHEN 'identifier' THEN 0 WHEN 'low-transition' THEN 2 WHEN 'uuid' THEN 3 ELSE 4 END) AS parts FROM b)
    SELECT strict_high AS leak_count, certain_count, likely_count, possible_count, transcript_line_hits, 1::INT AS exit_code,
      strict_high || ' exposed secrets at gate high, on this machine — ' || here || ' in this project, ' || away || ' outside it' AS headline,
      certain_count || ' certain · ' || likely_count || ' likely · ' || possible_count || ' possible (' || parts || ')' AS count_summary FROM c, s, l""")
def a13_summary(spark, sf):
    return fd.summary(order_findings(spark, sf)).select(
        "leak_count", "certain_count", "likely_count", "possible_count", "transcript_line_hits", "exit_code", "headline", "count_summary"
    )


@query("a14_exposure_rollup", f"""WITH {o.findings("SELECT source || '/' || lang AS src, doc_id::VARCHAR AS id, text FROM documents")}, x AS (SELECT string_split(src, '/')[1] AS source, string_split(src, '/')[2] AS lang, tier, secret_count FROM f)
    SELECT source, lang, tier AS confidence, grouping(source, lang, tier)::BIGINT AS level, sum(secret_count)::BIGINT AS leaks FROM x GROUP BY ROLLUP (source, lang, tier)""")
def a14_exposure_rollup(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("src"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("part"), "text")
    f = scan_texts(spread(docs)).withColumn("source", F.split("src", "/")[0]).withColumn("lang", F.split("src", "/")[1])
    return fd.exposure_rollup(f, ("source", "lang", "confidence")).select("source", "lang", "confidence", "level", F.col("strict_paranoid").alias("leaks"))


@query("a14_exposure_cube", f"""WITH f AS ({FINDINGS_SQL}) SELECT kind, scope, grouping(kind, scope)::BIGINT AS level, {COUNTS} FROM f GROUP BY CUBE (kind, scope)""")
def a14_exposure_cube(spark, sf):
    return fd.exposure_rollup(order_findings(spark, sf), ("kind", "scope"), "cube")


@query("w4_ordered_findings", f"WITH f AS ({FINDINGS_SQL}) SELECT path, min(k) AS k, confidence FROM f GROUP BY path, confidence ORDER BY path, min(rank)")
def w4_ordered_findings(spark, sf):
    f = order_findings(spark, sf).groupBy("path", "confidence").agg(F.min("k").alias("k"))
    return fd.order_findings(f).select("path", "k", "confidence")


@query("w5_numbered_pick", f"""WITH f AS ({FINDINGS_SQL}), n AS (SELECT k, path, row_number() OVER (ORDER BY path, rank, k) AS n FROM f WHERE importable AND secret_count > 0)
    SELECT n::BIGINT AS n, k, path FROM n WHERE n IN (SELECT DISTINCT p_size FROM part)""")
def w5_numbered_pick(spark, sf):
    f = fd.importable(order_findings(spark, sf)).select("k", "path", "confidence")
    numbered = ordered.number_rows(f, ["path", "confidence", "k"])
    return ordered.pick(numbered, table(spark, sf, "part").select("p_size")).select("n", "k", "path")


@query("w9_cumulative_tiers", f"WITH f AS ({FINDINGS_SQL}), c AS (SELECT scope, rank, sum(greatest(secret_count, 0)) AS n FROM f GROUP BY ALL) "
       "SELECT scope, rank::INT AS tier_rank, (sum(n) OVER (PARTITION BY scope ORDER BY rank))::BIGINT AS total FROM c")
def w9_cumulative_tiers(spark, sf):
    totals = fd.leak_counts(order_findings(spark, sf), ("scope",))
    return totals.select("scope", F.posexplode(F.array("strict_certain", "strict_high", "strict_paranoid")).alias("tier_rank", "total"))


@query("k2_capped_lines", """WITH l AS (SELECT l_suppkey, list_sort(list(l_orderkey * 10 + l_linenumber)) AS lines FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, array_to_string(lines[1:20], ',') AS shown, greatest(len(lines) - 20, 0)::INT AS more FROM l""")
def k2_capped_lines(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))
    return fd.capped_lines(rows, ("l_suppkey",)).select("l_suppkey", F.array_join("shown", ",").alias("shown"), "more")


@query("k4_top_offenders", f"WITH f AS ({FINDINGS_SQL}) SELECT path, sum(greatest(secret_count, 0))::BIGINT AS leak_count FROM f WHERE rank <= 1 GROUP BY path ORDER BY leak_count DESC, path LIMIT 25")
def k4_top_offenders(spark, sf):
    return fd.top_offenders(order_findings(spark, sf), ("path",), 25)


# Transcripts -------------------------------------------------------------------------------------


def document_lines(spark, sf):
    """Documents as the lines of one transcript per source; the text sits in a JSON string inside JSON."""
    inner = F.to_json(F.struct(F.col("text").alias("command"), F.col("lang")))
    raw = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(inner.alias("toolUse")).alias("message")))
    return spread(table(spark, sf, "documents").select("source", "doc_id", "lang", "text")).select(
        F.col("source").alias("path"), F.col("doc_id").cast("int").alias("line_no"), raw.alias("raw"))


@query("d18_unwrapped_lines", f"""WITH {o.graded(o.DOCUMENTS)} SELECT d.source AS path, d.doc_id::INT AS line_no, g.name, g.tier FROM g JOIN documents d ON d.doc_id::VARCHAR = g.id""")
def d18_unwrapped_lines(spark, sf):
    return tr.string_hits(document_lines(spark, sf)).select("path", "line_no", "name", "tier")


@query("a2_line_tiers", f"""WITH {o.named(o.DOCUMENTS)} SELECT d.source AS path, d.doc_id::INT AS line_no, nt.name, nt.rank::INT AS tier_rank FROM nt JOIN documents d ON d.doc_id::VARCHAR = nt.id""")
def a2_line_tiers(spark, sf):
    return tr.line_tiers(tr.string_hits(document_lines(spark, sf))).select("path", "line_no", "name", "tier_rank")


@query("a7_transcript_findings", f"""WITH {o.named(o.DOCUMENTS)}, l AS (SELECT d.source AS path, d.doc_id AS line_no, min(nt.rank) AS rank FROM nt JOIN documents d ON d.doc_id::VARCHAR = nt.id GROUP BY ALL)
    SELECT path, CASE rank WHEN 1 THEN 'likely' ELSE 'possible' END AS confidence, count(*)::BIGINT AS secret_count FROM l GROUP BY path, rank""")
def a7_transcript_findings(spark, sf):
    return tr.transcript_counts(tr.line_tiers(tr.string_hits(document_lines(spark, sf))))


@query("a7_transcript_lines", f"""WITH {o.named(o.DOCUMENTS)} SELECT d.source AS path, CASE min(nt.rank) WHEN 1 THEN 'likely' ELSE 'possible' END AS confidence, d.doc_id::INT AS line_no
    FROM nt JOIN documents d ON d.doc_id::VARCHAR = nt.id GROUP BY d.source, d.doc_id""")
def a7_transcript_lines(spark, sf):
    return tr.line_hits(tr.line_tiers(tr.string_hits(document_lines(spark, sf))))


@query("a7_transcript_names", f"""WITH {o.named(o.DOCUMENTS)}, ln AS (SELECT d.source AS path, d.doc_id AS line_no, nt.key, nt.name, nt.rank FROM nt JOIN documents d ON d.doc_id::VARCHAR = nt.id),
    f AS (SELECT path, key, rank, min(line_no) AS line_no, arg_min(name, line_no) AS name FROM ln GROUP BY ALL)
    SELECT path, CASE rank WHEN 1 THEN 'likely' ELSE 'possible' END AS confidence, name, line_no::INT AS line_no FROM f
    WHERE rank = 1 OR NOT EXISTS (SELECT 1 FROM f s WHERE s.path = f.path AND s.key = f.key AND s.rank < f.rank AND s.line_no <= f.line_no)""")
def a7_transcript_names(spark, sf):
    return tr.transcript_names(tr.line_tiers(tr.string_hits(document_lines(spark, sf)))).select("path", "confidence", "name", "line_no")


@query("s4_conversation_hits", """SELECT conv_id::VARCHAR AS path, (turn + 1)::INT AS line_no, 'api_key' AS name FROM conversations WHERE turn % 3 = 1 UNION ALL
    SELECT conv_id::VARCHAR, (turn + 1)::INT, 'token' FROM conversations WHERE turn % 4 = 2 UNION ALL
    SELECT conv_id::VARCHAR, (turn + 1)::INT, 'x' FROM conversations WHERE regexp_matches(text, '(?i)(token|secret|password|passwd|api[_-]?key|private[_-]?key)[''\"]?\\s*[:=]\\s*\\S{8,}')""")
def s4_conversation_hits(spark, sf):
    """Every turn as a transcript line: its text, a secret under a key of its own in every third one, a tool's nested JSON with one in every fourth."""
    value = F.concat(F.lit("Zk9pL2xQ"), F.col("conv_id") * 1000 + F.col("turn"), F.lit("vB8w"))
    nested = F.when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.struct(value.alias("token")).alias("result"))))
    record = F.struct("role", "text", F.when(F.col("turn") % 3 == 1, value).alias("api_key"), nested.alias("output"))
    lines = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("line_no"), F.to_json(record).alias("raw"))
    return tr.string_hits(lines).select("path", "line_no", "name")


# Known values ------------------------------------------------------------------------------------

DICTIONARY = f"{o.graded(o.DOCUMENTS)}, dict AS (SELECT DISTINCT substr(sha256(value), 1, 12) AS name, value FROM g)"


@query("j1_exposed_values", f"""WITH {DICTIONARY}, t2 AS ({o.EVERY_TEXT})
    SELECT t2.src, t2.id, dict.name, ((length(text) - length(replace(text, value, ''))) / length(value))::BIGINT AS n FROM t2 JOIN dict ON contains(text, value)""")
def j1_exposed_values(spark, sf):
    return kv.exposed(every_text(spark, sf), kv.dictionary_of(documents(spark, sf))).select("src", "id", "name", "n")


# A dictionary of many thousands of values: those detected, words of ten letters and more, and one for each order (which no text holds).
LARGE = f"""{DICTIONARY}, few AS (SELECT name, value FROM dict UNION SELECT DISTINCT 'w-' || w, w FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{10,}}')) AS w FROM benchmark)),
    many AS (SELECT 'o-' || o_orderkey AS name, printf('ORD-%08d', o_orderkey) AS value FROM orders)"""


def large_dictionary(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{10,})"))).alias("value"))
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey")).alias("name"), F.format_string("ORD-%08d", "o_orderkey").alias("value"))
    return kv.dictionary_of(documents(spark, sf)).unionByName(words.select(F.concat(F.lit("w-"), "value").alias("name"), "value")).unionByName(orders)


@query("j1_exposed_values_large", f"""WITH {LARGE}, t2 AS ({o.EVERY_TEXT}), hits AS (SELECT t2.src, t2.id, t2.text, few.name, few.value FROM t2 JOIN few ON contains(text, value)
      UNION ALL SELECT o.src, o.id, o.text, many.name, many.value FROM (SELECT * FROM t2 WHERE contains(text, 'ORD-')) o JOIN many ON contains(o.text, many.value))
    SELECT src, id, name, ((length(text) - length(replace(text, value, ''))) / length(value))::BIGINT AS n FROM hits""")
def j1_exposed_values_large(spark, sf):
    return kv.exposed(every_text(spark, sf), large_dictionary(spark, sf)).select("src", "id", "name", "n")


@query("r1_redacted_large", f"""WITH RECURSIVE {LARGE}, o AS (SELECT name, value, row_number() OVER (ORDER BY length(value) DESC, name, value) AS i FROM few),
    hit AS (SELECT t.id, t.text FROM t WHERE EXISTS (SELECT 1 FROM few WHERE contains(t.text, value))),
    r(id, text, i) AS (SELECT id, text, 0::BIGINT FROM hit UNION ALL SELECT r.id, replace(r.text, o.value, '***REDACTED(' || o.name || ')***'), o.i FROM r JOIN o ON o.i = r.i + 1)
    SELECT id, md5(text) AS text_md5 FROM r WHERE i = (SELECT max(i) FROM o) UNION ALL SELECT id, md5(text) FROM t WHERE id NOT IN (SELECT id FROM hit)""")
def r1_redacted_large(spark, sf):
    return kv.redact(documents(spark, sf), large_dictionary(spark, sf)).select("id", F.md5("text").alias("text_md5"))


@query("r1_redacted", f"""WITH RECURSIVE {DICTIONARY}, o AS (SELECT name, value, row_number() OVER (ORDER BY length(value) DESC, name, value) AS i FROM dict),
    hit AS (SELECT t.id, t.text FROM t WHERE EXISTS (SELECT 1 FROM dict WHERE contains(t.text, value))),
    r(id, text, i) AS (SELECT id, text, 0::BIGINT FROM hit UNION ALL SELECT r.id, replace(r.text, o.value, '***REDACTED(' || o.name || ')***'), o.i FROM r JOIN o ON o.i = r.i + 1)
    SELECT id, md5(text) AS text_md5 FROM r WHERE i = (SELECT max(i) FROM o) UNION ALL SELECT id, md5(text) FROM t WHERE id NOT IN (SELECT id FROM hit)""")
def r1_redacted(spark, sf):
    t = documents(spark, sf)
    return kv.redact(t, kv.dictionary_of(t)).select("id", F.md5("text").alias("text_md5"))


@query("r2_redacted_columns", """SELECT o_orderkey, replace(replace(o_orderpriority, '3-MEDIUM', '***REDACTED(p3)***'), '1-URGENT', '***REDACTED(p1)***') AS priority,
    replace(o_orderstatus, 'F', '***REDACTED(f)***') AS status FROM orders""")
def r2_redacted_columns(spark, sf):
    secrets = table(spark, sf, "orders").where("o_orderpriority in ('3-MEDIUM', '1-URGENT')").select(
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "p3").otherwise("p1").alias("name"), F.col("o_orderpriority").alias("value")
    ).unionByName(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.lit("f").alias("name"), F.col("o_orderstatus").alias("value"))).distinct()
    # The one-letter value also occurs in priorities; it is redacted in the status column only.
    two = kv.redact_columns(table(spark, sf, "orders"), ["o_orderpriority"], secrets.where("length(value) > 1"))
    out = kv.redact_columns(two, ["o_orderstatus"], secrets.where("length(value) = 1"))
    return out.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@query("r3_redacted_detected", f"""WITH RECURSIVE {o.graded(o.DOCUMENTS)}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(value) DESC, name, value) AS i FROM (SELECT DISTINCT id, name || ':' || tier AS name, value FROM g)),
    r(id, text, i) AS (SELECT id, text, 0::BIGINT FROM t UNION ALL SELECT r.id, replace(r.text, o.value, '***REDACTED(' || o.name || ')***'), o.i FROM r JOIN o ON o.id = r.id AND o.i = r.i + 1)
    SELECT id, md5(arg_max(text, i)) AS text_md5 FROM r GROUP BY id""")
def r3_redacted_detected(spark, sf):
    return kv.redact_detected(documents(spark, sf)).select("id", F.md5("text").alias("text_md5"))


@query("r4_residual", "SELECT doc_id::VARCHAR AS id, 'x' AS name, 1::BIGINT AS n FROM documents WHERE false")
def r4_residual(spark, sf):
    t = documents(spark, sf)
    return kv.residual(t, kv.dictionary_of(t)).select("id", "name", "n")


@query("k3_redaction_order", "SELECT p_name AS name, p_type AS value, row_number() OVER (ORDER BY length(p_type) DESC, p_partkey)::BIGINT AS n FROM part")
def k3_redaction_order(spark, sf):
    secrets = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("value"), F.col("p_partkey").alias("seq"))
    return ordered.number_rows(
        kv._usable(secrets).select("name", "value", "rank"), ["rank"]
    ).select("name", "value", "n")
