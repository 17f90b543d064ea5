"""Audit log and access sessions, bound to the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.operators import admission, lineage
from exposure.operators import audit as au
from exposure.operators import sessions as ses
from exposure.plans.registry import query, table

# Event types as verbs: signup unlocks, click renews, error locks, purchase runs, view asks the status.
VERB = "CASE event_type WHEN 'signup' THEN 'unlock' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'lock' WHEN 'purchase' THEN 'run' ELSE 'status' END"
MINUTES = "CASE WHEN event_id % 17 = 0 THEN -1 ELSE 600 + event_id % 900 END"
ROUTE = "CASE event_id % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'spawned-console' WHEN 2 THEN 'guard-session' ELSE CASE WHEN event_id % 8 = 3 THEN 'socket' ELSE 'inline' END END"
RESULT = "CASE event_type WHEN 'error' THEN 'denied' WHEN 'view' THEN 'allowed' WHEN 'click' THEN 'allowed' WHEN 'signup' THEN 'warn' ELSE CASE WHEN event_id % 5 = 0 THEN 'maybe' ELSE 'timeout' END END"


def requests(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(VERB).alias("verb"), F.expr(MINUTES).cast("int").alias("minutes"), "event_id")


def audit(spark, sf):
    secrets = F.array(F.concat(F.lit("S"), F.col("event_id") % 11), F.concat(F.lit("U"), F.col("user_id") % 7))
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), secrets.alias("secret_names"),
        F.array(F.lit("tool"), F.col("event_type")).alias("command"), F.expr(ROUTE).alias("route"), F.expr(RESULT).alias("result"),
        F.lit("").alias("reason"), "event_id", "user_id")


AUDIT_SQL = f"au AS (SELECT ts, event_id, user_id, event_type AS action, ['S' || (event_id % 11), 'U' || (user_id % 7)] AS secret_names, {ROUTE} AS route, {RESULT} AS result FROM events)"


@query("s10_audit_records", """SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS at, event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'run ' || event_type ELSE 'run|' || event_type END AS command FROM events WHERE event_id % 10 <> 9""")
def s10_audit_records(spark, sf):
    e = table(spark, sf, "events")
    command = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"run '), "event_type", F.lit('"'))).otherwise(
        F.concat(F.lit('["run","'), "event_type", F.lit('"]')))
    line = F.format_string(
        '{"timestamp":"%s+00:00","action":"%s","secret_names":["e%d"],"command":%s,"route":"inline","result":"allowed","reason":""}',
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), "event_type", "event_id", command)
    lines = e.select(F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).otherwise(line).alias("value"))
    out = au.parse_records(lines)
    return out.select(
        F.substring(F.col("secret_names")[0], 2, 20).cast("bigint").alias("event_id"), F.unix_seconds("ts").alias("at"), "action",
        F.array_join("command", "|").alias("command"))


@query("s11_audit_split", f"""WITH {AUDIT_SQL} SELECT CASE WHEN route NOT IN ('inline', 'spawned-console', 'guard-session') THEN 'invalid route: ' || route WHEN result NOT IN ('allowed', 'denied', 'timeout', 'warn') THEN 'invalid result: ' || result ELSE 'ok' END AS status,
    count(*)::BIGINT AS n FROM au GROUP BY 1""")
def s11_audit_split(spark, sf):
    good, bad = au.split_valid(audit(spark, sf))
    return good.agg(F.count("*").alias("n")).select(F.lit("ok").alias("status"), "n").unionByName(
        bad.groupBy(F.col("violation").alias("status")).agg(F.count("*").alias("n")))


@query("a15_audit_stats", f"""WITH {AUDIT_SQL}, s AS (SELECT action, route, result, unnest(secret_names) AS s FROM au), d AS (SELECT action, route, result, count(DISTINCT s)::BIGINT AS secrets FROM s GROUP BY ALL)
    SELECT action, route, result, count(*)::BIGINT AS n, count(*) FILTER (result = 'denied')::BIGINT AS denied, round(count(*) FILTER (result = 'denied') / count(*)::DOUBLE, 6) AS denial_rate, max(secrets)::BIGINT AS secrets
    FROM au JOIN d USING (action, route, result) GROUP BY ALL""")
def a15_audit_stats(spark, sf):
    return au.audit_stats(audit(spark, sf))


@query("a15_secret_access", f"WITH {AUDIT_SQL} SELECT secret, count(*)::BIGINT AS n, count(*) FILTER (result = 'denied')::BIGINT AS denied FROM (SELECT unnest(secret_names) AS secret, result FROM au) GROUP BY secret")
def a15_secret_access(spark, sf):
    return au.secret_access(audit(spark, sf))


@query("w6_as_of_state", f"""WITH r AS (SELECT event_id, user_id, ts, {VERB} AS verb FROM events), c AS (SELECT * FROM r WHERE verb IN ('unlock', 'renew', 'lock')),
    j AS (SELECT r.event_id, max(c.ts) AS last_at, arg_max(c.verb, c.ts) AS state FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.ts < r.ts GROUP BY r.event_id) SELECT event_id, state, epoch_us(last_at) AS state_us FROM j""")
def w6_as_of_state(spark, sf):
    control = F.col("verb").isin("unlock", "renew", "lock")
    out = ses.as_of_state(requests(spark, sf), {"control": F.when(control, F.struct("ts", "verb"))})
    return out.select("event_id", F.col("control.verb").alias("state"), F.unix_micros("control.ts").alias("state_us"))


# Sessions by recursion over each user's requests in order: the plain state machine.
REPLAY_SQL = f"""o AS (SELECT event_id, user_id, epoch_us(ts) AS ts, {VERB} AS verb, {MINUTES} AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s(user_id, i, event_id, state, outcome, before, exp, mode) AS (
      SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, 0::BIGINT, 'none' FROM (SELECT DISTINCT user_id FROM o) UNION ALL
      SELECT o.user_id, o.i, o.event_id, st, CASE WHEN verb = 'unlock' THEN 'ok' WHEN st IN ('none', 'locked') THEN 'no session' WHEN st = 'expired' AND verb NOT IN ('lock', 'status') THEN 'session expired'
          WHEN verb = 'renew' AND m < 1 THEN 'invalid minutes' ELSE 'ok' END, CASE WHEN st = 'live' THEN x.exp END,
        CASE WHEN verb = 'unlock' THEN o.ts + CASE WHEN m = 0 THEN 30 ELSE m END * 60000000 WHEN verb = 'renew' AND st = 'live' AND m >= 1 THEN o.ts + m * 60000000 ELSE x.exp END,
        CASE WHEN verb = 'unlock' THEN 'live' WHEN verb = 'lock' THEN CASE WHEN x.mode = 'none' THEN 'locked' ELSE 'locked' END WHEN st = 'expired' AND verb = 'renew' THEN 'expired' ELSE x.mode END
      FROM (SELECT s.*, o.event_id AS oid, CASE WHEN s.mode = 'live' AND o.ts > s.exp THEN 'expired' ELSE s.mode END AS st FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1) x
      JOIN o ON o.event_id = x.oid)"""


@query("t2_session_replay", f"WITH RECURSIVE {REPLAY_SQL} SELECT event_id, state, outcome, before AS expires_us FROM s WHERE i > 0")
def t2_session_replay(spark, sf):
    out = ses.session_replay(requests(spark, sf))
    return out.select("event_id", "state", "outcome", F.unix_micros("expires_at").alias("expires_us"))


@query("t7_dispatch", """WITH inv AS (SELECT unnest(['S0', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'U0', 'U1', 'U2', 'U3', 'U4']) AS name),
    r AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'get' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'reboot' WHEN 'purchase' THEN 'run' ELSE 'status' END AS verb, event_id % 11 > 7 OR user_id % 7 > 4 AS lacking FROM events)
    SELECT verb, CASE WHEN verb = 'run' AND lacking THEN 'denied' WHEN verb IN ('run', 'renew', 'status') THEN 'allowed' WHEN verb = 'get' THEN 'denied' ELSE 'unknown' END AS result,
      CASE WHEN verb = 'run' AND lacking THEN 'unknown secrets' WHEN verb = 'get' THEN 'guard has no value-return verbs' WHEN verb = 'reboot' THEN 'unknown verb: reboot' END AS reason, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def t7_dispatch(spark, sf):
    verb = F.expr("CASE event_type WHEN 'signup' THEN 'get' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'reboot' WHEN 'purchase' THEN 'run' ELSE 'status' END")
    a = audit(spark, sf)
    asked = a.select(F.col("event_id").alias("request_id"), F.col("action").alias("event_type"), "secret_names").withColumn("verb", verb)
    names = a.where("event_id % 11 <= 7 and user_id % 7 <= 4").select(F.explode("secret_names").alias("name")).distinct()
    return ses.dispatch(asked, names).groupBy("verb", "result", "reason").agg(F.count("*").alias("n"))


@query("t8_session_summary", """WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'locked' WHEN 'signup' THEN 'expired' WHEN 'purchase' THEN 'crashed' END AS reason FROM events),
    g AS (SELECT user_id, epoch_us(min(ts)) AS s, epoch_us(max(ts)) AS e, arg_max(reason, ts) FILTER (reason IS NOT NULL) AS reason, count(*)::BIGINT AS request_count FROM r GROUP BY user_id)
    SELECT user_id::VARCHAR AS session, s AS started_us, e AS ended_us, reason, request_count, round_even((e - s) / 60e6, 0)::BIGINT AS minutes,
      CASE reason WHEN 'expired' THEN 'expired after ' || round_even((e - s) / 60e6, 0)::BIGINT || 'm' ELSE coalesce(reason, 'unknown') END AS phrase FROM g""")
def t8_session_summary(spark, sf):
    reason = F.expr("CASE verb WHEN 'lock' THEN 'locked' WHEN 'unlock' THEN 'expired' WHEN 'run' THEN 'crashed' END")
    out = ses.session_summary(requests(spark, sf).withColumn("reason", reason))
    return out.select("session", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "reason", "request_count", "minutes", "phrase")


@query("t10_audit_windows", f"""WITH {AUDIT_SQL} SELECT epoch_ms(date_trunc('hour', ts)) // 1000 AS window_start, count(*)::BIGINT AS n, count(*) FILTER (result = 'denied')::BIGINT AS denied, count(*) FILTER (result = 'warn')::BIGINT AS warned FROM au GROUP BY 1""")
def t10_audit_windows(spark, sf):
    return au.audit_windows(audit(spark, sf), "1 hour").select(F.unix_seconds("window_start").alias("window_start"), "n", "denied", "warned")


@query("t10_sliding_windows", f"""WITH {AUDIT_SQL}, w AS (SELECT epoch_ms(date_trunc('hour', ts)) // 1000 - k * 3600 AS window_start, result FROM au, (VALUES (0), (1), (2)) v(k))
    SELECT window_start, count(*)::BIGINT AS n, count(*) FILTER (result = 'denied')::BIGINT AS denied, count(*) FILTER (result = 'warn')::BIGINT AS warned FROM w GROUP BY 1""")
def t10_sliding_windows(spark, sf):
    return au.audit_windows(audit(spark, sf), "3 hours", "1 hour").select(F.unix_seconds("window_start").alias("window_start"), "n", "denied", "warned")


@query("t11_activity_sessions", """WITH l AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid""")
def t11_activity_sessions(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    out = ses.activity_sessions(events, ("user_id",), 1800)
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("t12_deduplicated_audit", """SELECT user_id, event_type AS action, epoch_us(min(ts)) AS first_us FROM events GROUP BY ALL""")
def t12_deduplicated_audit(spark, sf):
    a = audit(spark, sf).select("user_id", "action", "ts", "event_id")
    return au.dedup_audit(a, ("user_id", "action")).select("user_id", "action", F.unix_micros("ts").alias("first_us"))


PLAIN_VERB = "CASE event_type WHEN 'signup' THEN 'unlock' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'run' ELSE 'status' END"


def admission_requests(spark, sf, verb=PLAIN_VERB, **more):
    """Requests with peers from a small process tree per user: the user's shell, its children and a stranger. ``more``: expressions of further columns."""
    e = F.col("event_id")
    pid = F.col("user_id") * 10 + F.when(e % 5 == 0, 9).otherwise(2 + e % 3)
    asked = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session"), e.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.expr(verb).alias("verb"),
        F.array(F.concat(F.lit("S"), e % 4)).alias("secret_names"), F.lit("h").alias("host"), pid.alias("pid"), pid.alias("start_time"),
        (e % 3 != 0).alias("approve"), F.lit(2000).alias("minutes"),
        F.when(e % 4 == 0, F.lit(90000.0)).alias("pre_admit_seconds"), F.lit(False).alias("pre_admit_unscoped"), F.array(F.lit("S1")).alias("pre_admit_names"),
        *(F.expr(x).alias(name) for name, x in more.items()))
    users = table(spark, sf, "events").select("user_id").distinct()
    tree = users.select(F.explode(F.transform(F.array(*map(F.lit, (2, 3, 4, 9))), lambda d: F.col("user_id") * 10 + d)).alias("pid"), "user_id").select(
        F.lit("h").alias("host"), "pid", F.when(F.col("pid") % 10 == 9, F.lit(0)).otherwise(F.when(F.col("pid") % 10 == 2, 0).otherwise(F.col("user_id") * 10 + 2)).alias("ppid"),
        F.col("pid").alias("start_time"), F.lit(1000).alias("uid"))
    chains = lineage.ancestors(tree, max_depth=4)
    return asked.join(chains, ["host", "pid"], "left").drop("host")


# Each session's requests one after the other: the state machine of a guard run as a recursion. Peers are user * 10 + 2 (a shell), 3 and 4
# (its children), and 9 (a stranger); ``kin`` says which admitted process a request's lineage holds.
GUARD_VERB = "CASE event_type WHEN 'signup' THEN 'unlock' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'run' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'lock' ELSE 'list' END ELSE 'status' END"


def guard_sql(verb: str, minutes: str, known: str, unscoped: str) -> str:
    """CTEs up to ``g``: a row for each request with its decision and the state behind it."""
    return f"""o AS (SELECT user_id, event_id, epoch_us(ts) AS t, {verb} AS verb, {minutes} AS m, event_id % 3 <> 0 AS approve,
        CASE WHEN {known} THEN user_id * 10 + CASE WHEN event_id % 5 = 0 THEN 9 ELSE 2 + event_id % 3 END END AS pid,
        CASE WHEN {verb} = 'run' THEN ['S' || (event_id % 4)] ELSE [] END AS wanted, CASE WHEN event_id % 4 = 0 THEN 90000000000 END AS opens, {unscoped} AS opens_all,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    g(user_id, i, event_id, t, verb, pid, kind, verdict, live, adm, granted, unscoped, until, expires, n, offer, offer_all) AS (
      SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false, NULL::BIGINT, []::VARCHAR[], false, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, false
      FROM (SELECT DISTINCT user_id FROM o) UNION ALL
      SELECT user_id, i, event_id, t, verb, pid, kind,
        CASE WHEN kind IN ('dead', 'nameless', 'refused', 'turned away') THEN kind WHEN kind = 'unlock' THEN 'ok' WHEN t > held AND verb NOT IN ('lock', 'status') THEN 'late'
          WHEN verb = 'renew' AND m < 0 THEN 'bad minutes' ELSE 'ok' END AS verdict,
        CASE WHEN kind = 'unlock' THEN true WHEN entered AND verb = 'lock' THEN false ELSE live END,
        CASE WHEN kind = 'unlock' THEN NULL WHEN kind IN ('offered', 'asked') THEN pid ELSE adm END,
        CASE WHEN kind = 'unlock' THEN [] WHEN kind = 'offered' THEN CASE WHEN offer_all THEN [] ELSE ['S1'] END WHEN kind = 'asked' THEN wanted
          WHEN kind = 'widened' AND NOT unscoped THEN list_sort(list_distinct(list_concat(granted, wanted))) ELSE granted END,
        CASE WHEN kind IN ('unlock', 'asked') THEN false WHEN kind = 'offered' THEN offer_all ELSE unscoped END,
        CASE WHEN kind = 'unlock' THEN 0 WHEN kind IN ('offered', 'asked', 'widened') THEN held ELSE until END,
        CASE WHEN kind = 'unlock' OR (entered AND verb = 'renew' AND m >= 0 AND t <= held) THEN t + m::BIGINT * 60000000 ELSE held END,
        CASE WHEN kind = 'unlock' THEN 0 WHEN kind IN ('offered', 'asked') THEN 1 WHEN entered THEN n + 1 ELSE n END,
        CASE WHEN kind = 'unlock' THEN t + opens WHEN kind = 'offered' THEN NULL ELSE offer END, CASE WHEN kind = 'unlock' THEN opens_all ELSE offer_all END
      FROM (SELECT *, kind IN ('offered', 'covered', 'widened', 'asked') AS entered FROM (
        SELECT o.user_id, o.i, o.event_id, o.t, o.verb, o.m, o.pid, o.wanted, o.opens, o.opens_all, g.live, g.adm, g.granted, g.unscoped, g.until, g.expires AS held, g.n, g.offer, g.offer_all,
          CASE WHEN o.verb = 'unlock' THEN 'unlock' WHEN NOT g.live THEN 'dead' WHEN o.pid IS NULL THEN 'nameless' WHEN g.adm IS NULL AND o.t <= g.offer THEN 'offered'
            WHEN g.adm = o.pid OR (o.pid % 10 IN (3, 4) AND g.adm = o.user_id * 10 + 2) THEN
              CASE WHEN (g.unscoped OR list_has_all(g.granted, o.wanted)) AND o.t <= g.until THEN 'covered' WHEN o.approve THEN 'widened' ELSE 'refused' END
            WHEN o.approve THEN 'asked' ELSE 'turned away' END AS kind
        FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1))),
    d AS (SELECT *, CASE WHEN verdict = 'ok' THEN 'allow' ELSE 'deny' END AS decision,
        CASE kind WHEN 'unlock' THEN 'unlock' WHEN 'offered' THEN 'pre-admit' WHEN 'covered' THEN 'granted' WHEN 'widened' THEN 'scope expanded' WHEN 'asked' THEN 'interactive' END AS via,
        CASE verdict WHEN 'dead' THEN 'no session' WHEN 'nameless' THEN 'no peer identity' WHEN 'refused' THEN 'admission denied' WHEN 'turned away' THEN 'admission denied'
          WHEN 'late' THEN 'session expired' WHEN 'bad minutes' THEN 'invalid minutes' END AS reason,
        CASE WHEN kind = 'nameless' THEN 'peer identity unavailable' WHEN kind IN ('asked', 'turned away') THEN 'unrecognized peer pid=' || pid END AS warning
      FROM g WHERE i > 0)"""


GUARD = guard_sql(GUARD_VERB, "CASE WHEN event_type = 'click' AND event_id % 7 = 0 THEN -5 ELSE 2000 END", "event_id % 23 <> 0", "event_id % 8 = 0")
PLAIN_GUARD = guard_sql(GUARD_VERB.replace("CASE WHEN event_id % 3 = 0 THEN 'lock' ELSE 'list' END", "'status'"), "2000", "true", "false")


def guard_requests(spark, sf):
    """Admission requests with locks, unknown peers, windows for all secrets and renewals by negative minutes."""
    e = F.col("seq")
    asked = admission_requests(spark, sf, GUARD_VERB, odd="event_type = 'click' AND event_id % 7 = 0")
    return asked.withColumns({
        "pid": F.when(e % 23 != 0, F.col("pid")), "minutes": F.when(F.col("odd"), -5).otherwise(F.col("minutes")), "pre_admit_unscoped": e % 8 == 0}).drop("odd")


def guard_rows(spark, sf):
    return admission.admission_replay(guard_requests(spark, sf)).select(
        F.col("session").cast("bigint").alias("user_id"), F.col("seq").alias("event_id"), "verb", "event_kind", "decision", "via", "reason",
        F.col("request_count").alias("n"), F.array_join("granted", ",").alias("granted"), "unscoped", "warned")


@query("t3_scoped_grants", f"""WITH RECURSIVE {GUARD} SELECT user_id, event_id, verb, decision, via, reason, array_to_string(granted, ',') AS granted FROM d""")
def t3_scoped_grants(spark, sf):
    """Every decision, and the secrets that the admitted tree holds after it."""
    return guard_rows(spark, sf).where("event_kind = 'decision'").select("user_id", "event_id", "verb", "decision", "via", "reason", "granted")


@query("t4_pre_admissions", f"""WITH RECURSIVE {GUARD} SELECT user_id, event_id, verb, decision, unscoped, array_to_string(granted, ',') AS granted FROM d WHERE via = 'pre-admit'""")
def t4_pre_admissions(spark, sf):
    """Who took a single-use window, and what for."""
    return guard_rows(spark, sf).where("via = 'pre-admit'").select("user_id", "event_id", "verb", "decision", "unscoped", "granted")


@query("t5_peer_warnings", f"""WITH RECURSIVE {GUARD} SELECT user_id, event_id, 'warn' AS event_kind, warning AS reason FROM d WHERE warning IS NOT NULL
    UNION ALL SELECT user_id, event_id, 'decision', reason FROM d WHERE warning IS NOT NULL""")
def t5_peer_warnings(spark, sf):
    """Warnings on peers that are unknown or have no identity, each beside the decision that follows it."""
    return guard_rows(spark, sf).where("warned").select("user_id", "event_id", "event_kind", "reason")


@query("t6_replaced_trees", f"""WITH RECURSIVE {GUARD} SELECT user_id, event_id, via, n, array_to_string(granted, ',') AS granted FROM d WHERE kind IN ('offered', 'asked', 'covered', 'widened')""")
def t6_replaced_trees(spark, sf):
    """Requests of the admitted tree, counted from one for each new tree."""
    inside = F.col("via").isin("pre-admit", "interactive", "granted", "scope expanded")
    return guard_rows(spark, sf).where(inside).select("user_id", "event_id", "via", "n", "granted")


@query("t3_t6_admission_replay", f"""WITH RECURSIVE {PLAIN_GUARD}, rows AS (SELECT verb, 'decision' AS event_kind, decision, via, n FROM d
      UNION ALL SELECT verb, 'warn', NULL, NULL, n FROM d WHERE warning IS NOT NULL)
    SELECT verb, event_kind, decision, via, count(*)::BIGINT AS n, sum(n)::BIGINT AS requests FROM rows GROUP BY ALL""")
def t3_t6_admission_replay(spark, sf):
    """Scoped grants, single-use pre-admission, warnings and replacement, decided in order per guard run."""
    out = admission.admission_replay(admission_requests(spark, sf))
    return out.groupBy("verb", "event_kind", "decision", "via").agg(F.count("*").alias("n"), F.sum("request_count").alias("requests"))
