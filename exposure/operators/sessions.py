"""Access sessions replayed from a request log in batch.

A session starts at ``unlock`` and lasts until ``lock`` or its expiry; ``renew`` moves the expiry.
Activity does not extend it. Each step is an as-of carry, so one session may hold any share of the
rows. Requests have ``session, ts, seq, verb`` and where needed ``minutes, secret_names``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.operators.ordered import carry_last

ORDER = ("ts", "seq")


def _at() -> Column:
    return F.struct("ts", "seq")


def as_of_state(requests: DataFrame, carried: dict[str, Column], keys: tuple[str, ...] = ("session",), **kw) -> DataFrame:
    """The latest control event before each request."""
    return carry_last(requests, keys, ORDER, carried, **kw)


def _epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def session_replay(requests: DataFrame, minutes: int = fixed.SESSION_MINUTES, **kw) -> DataFrame:
    """Add ``state`` (none, live, expired, locked), ``outcome`` and ``expires_at`` to every request.

    ``outcome``: ``ok``, ``no session``, ``session expired``, ``invalid minutes``. ``lock`` and
    ``status`` are still answered after expiry. A renew counts only while the session lives, so one
    that comes too late ends the chain; renews after it are refused as well, until the next unlock.
    """
    verb = F.col("verb")
    given = F.coalesce(F.nullif("minutes", F.lit(0)), F.lit(minutes)) if "minutes" in requests.columns else F.lit(minutes)
    columns = requests.columns
    ends = F.timestamp_micros(F.unix_micros("ts") + given.cast("bigint") * 60_000_000)
    control = (verb == "unlock") | ((verb == "renew") & (given >= 1))
    first = carry_last(
        requests, ("session",), ORDER,
        {
            "__edge": F.when(verb.isin("unlock", "lock"), F.struct(_at().alias("at"), verb.alias("verb"))),
            "__control": F.when(control, F.struct(_at().alias("at"), ends.alias("ends"))),
        },
        **kw,
    )
    # A renew is late when the control event before it had run out, or belonged to no open session.
    late = (verb == "renew") & (given >= 1) & (F.col("__control").isNull() | (F.col("ts") > F.col("__control.ends")))
    second = carry_last(first, ("session",), ORDER, {"__late": F.when(late, _at())}, **kw)
    opened = F.col("__edge.verb") == "unlock"
    broken = F.col("__late").isNotNull() & (F.col("__late") > F.col("__edge.at"))
    gone = broken | (F.col("ts") > F.col("__control.ends"))
    before = F.when(F.col("__edge").isNull(), "none").when(~opened, "locked").when(gone, "expired").otherwise("live")
    outcome = (
        F.when(verb == "unlock", "ok")
        .when(F.col("state").isin("none", "locked"), "no session")
        .when((F.col("state") == "expired") & ~verb.isin("lock", "status"), "session expired")
        .when((verb == "renew") & (given < 1), "invalid minutes")
        .otherwise("ok")
    )
    expires = F.when(F.col("state") == "live", F.col("__control.ends"))
    return second.withColumn("state", before).withColumn("outcome", outcome).select(
        *columns, "state", "outcome", expires.alias("expires_at")
    )


def dispatch(requests: DataFrame, names: DataFrame, key: str = "request_id") -> DataFrame:
    """Outcome per verb: value-returning verbs are always denied, runs with unknown names too, other verbs are unknown.

    Where requests have a ``command``, a run without one is denied.
    """
    from exposure.operators.inventory import unknown_names

    lacking = unknown_names(requests.where("verb = 'run'"), names, key).select(key).distinct().withColumn("__lacking", F.lit(True))
    verb = F.col("verb")
    bare = (verb == "run") & (F.trim(F.coalesce("command", F.lit(""))) == "") if "command" in requests.columns else F.lit(False)
    result = (
        F.when(bare | ((verb == "run") & F.col("__lacking").isNotNull()), "denied")
        .when(verb.isin("run", "list", "status", "lock", "renew"), "allowed")
        .when(verb.isin(*fixed.VALUE_VERBS), "denied")
        .otherwise("unknown")
    )
    reason = (
        F.when(bare, "no_command")
        .when((verb == "run") & F.col("__lacking").isNotNull(), "unknown secrets")
        .when(verb.isin(*fixed.VALUE_VERBS), "guard has no value-return verbs")
        .when(result == "unknown", F.concat(F.lit("unknown verb: "), verb))
    )
    return requests.join(lacking, key, "left").select(*requests.columns, result.alias("result"), reason.alias("reason"))


def session_summary(requests: DataFrame, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """Start, end, end reason, request count and whole minutes per session, in one aggregate.

    Minutes round half to even. The reason is that of the last ``reason`` given.
    """
    seconds = F.unix_micros("ended_at") - F.unix_micros("started_at")
    grouped = requests.groupBy(*keys).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), _at())).alias("reason"),
        F.count("*").alias("request_count"),
    )
    minutes = F.greatest(F.bround(seconds / 60e6), F.lit(0)).cast("bigint")
    phrase = F.when(F.col("reason") == "expired", F.concat(F.lit("expired after "), minutes.cast("string"), F.lit("m"))).otherwise(
        F.coalesce("reason", F.lit("unknown"))
    )
    return grouped.select(*keys, "started_at", "ended_at", "reason", "request_count", minutes.alias("minutes"), phrase.alias("phrase"))


def live_sessions(registry: DataFrame, procs: DataFrame, now: Column) -> DataFrame:
    """Registry entries that are neither expired nor of a dead process.

    ``expires_at_epoch`` 0 means no expiry. A malformed entry has a null pid and is not live.
    """
    expires = F.coalesce("expires_at_epoch", F.lit(0.0))
    fresh = registry.where(((expires == 0) | (now <= expires)) & (F.col("pid") > 0))
    return fresh.join(procs.select("pid").distinct(), "pid", "left_semi").select(*registry.columns)


def activity_sessions(events: DataFrame, keys: tuple[str, ...], gap_seconds: int, **kw) -> DataFrame:
    """Gap sessions in batch: ``keys, session_start, session_end, n``.

    An event opens a session when the one before it is more than the gap away; its start is carried
    to the events after it. Both carries are prefix scans over ranges and the count is a partial aggregate.
    """
    ts = F.col("ts")
    seen = carry_last(events.select(*keys, *ORDER), keys, ORDER, {"__previous": ts}, **kw)
    away = F.unix_micros("ts") - F.unix_micros("__previous") > gap_seconds * 1_000_000
    opened = carry_last(
        seen, keys, ORDER, {"session_start": F.when(F.col("__previous").isNull() | away, ts)}, inclusive=True, **kw
    )
    return opened.groupBy(*keys, "session_start").agg(F.max("ts").alias("session_end"), F.count("*").alias("n"))
