"""Admission of requesting processes: a state machine over the request log.

The state of one guard run is an admitted process, the secrets granted to its tree, an optional
single-use pre-admit window and a count. Each decision depends on the one before, so requests of a
run are folded in order. A new ``unlock`` starts afresh, which splits a busy session into runs that
are folded apart. A run that is longer than a range of the sorted log is folded range by range at
once: each range first from a fresh state, then again wherever the range before it turns out to end
in another state than was taken, until no range changes. Admissions and renewals forget what was
before them, so a few rounds do, and any number of rounds ends in the states of one long fold.

Requests need: session, seq, ts, verb, secret_names, pid, start_time, approve, minutes and ``chain``
(the peer's ancestors from :mod:`exposure.operators.lineage`; null when the peer has no identity).
An ``unlock`` row may carry pre_admit_seconds, pre_admit_unscoped and pre_admit_names.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure.functions.fixed import SESSION_MINUTES
from exposure.operators.ordered import carry_last, sorted_ranges
from exposure.session import store

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INPUT = (
    "session", "seq", "ts", "verb", "secret_names", "pid", "start_time", "approve", "minutes", "chain",
    "pre_admit_seconds", "pre_admit_unscoped", "pre_admit_names",
)
OUTPUT = (
    "session string, seq bigint, ts timestamp, verb string, event_kind string, decision string, via string, "
    "reason string, request_count bigint, granted array<string>, unscoped boolean"
)


@dataclass
class Run:
    """State of one guard run. Times are epoch seconds."""

    expires_at: float = 0.0
    live: bool = False
    admitted: tuple[int, int] | None = None
    granted: set[str] = field(default_factory=set)
    granted_until: float = 0.0
    unscoped: bool = False
    count: int = 0
    offer_until: float | None = None
    offer_unscoped: bool = False
    offer_names: set[str] = field(default_factory=set)

    def dump(self) -> str:
        return json.dumps(asdict(self), default=sorted)

    @classmethod
    def load(cls, kept: str | None) -> Run:
        if kept is None:
            return cls()
        state = json.loads(kept)
        sets = {k: set(state[k]) for k in ("granted", "offer_names")}
        return cls(**{**state, **sets, "admitted": tuple(state["admitted"]) if state["admitted"] else None})

    def admit(self, peer: tuple[int, int], names: set[str], unscoped: bool) -> None:
        self.admitted, self.granted, self.unscoped = peer, set() if unscoped else set(names), unscoped
        self.granted_until, self.count = self.expires_at, 1


def _minutes(value: int | None) -> int:
    return value or SESSION_MINUTES


def step(run: Run, r: dict) -> list[tuple[str, str | None, str | None, str | None]]:
    """Advance the state by one request; yields (event_kind, decision, via, reason) rows."""
    now, verb = r["at"], r["verb"]
    if verb == "unlock":
        run.__init__(expires_at=now + 60 * _minutes(r["minutes"]), live=True)
        window = r["pre_admit_seconds"]
        if window:
            run.offer_until, run.offer_unscoped = now + window, bool(r["pre_admit_unscoped"])
            run.offer_names = set(r["pre_admit_names"] or ())
        return [("decision", "allow", "unlock", None)]
    if not run.live:
        return [("decision", "deny", None, "no session")]
    if r["peer"] is None:
        return [("warn", None, None, "peer identity unavailable"), ("decision", "deny", None, "no peer identity")]

    wanted = set(r["secret_names"] or ()) if verb == "run" else set()
    rows: list[tuple] = []
    if run.admitted is None and run.offer_until is not None and now <= run.offer_until:
        run.admit(r["peer"], run.offer_names, run.offer_unscoped)
        run.offer_until = None
        via = "pre-admit"
    elif run.admitted is not None and run.admitted in r["lineage"]:
        if (run.unscoped or wanted <= run.granted) and now <= run.granted_until:
            run.count += 1
            via = "granted"
        elif not r["approve"]:
            return [("decision", "deny", None, "admission denied")]
        else:
            if not run.unscoped:
                run.granted |= wanted
            run.granted_until = run.expires_at
            run.count += 1
            via = "scope expanded"
    else:
        rows.append(("warn", None, None, f"unrecognized peer pid={r['peer'][0]}"))
        if not r["approve"]:
            return [*rows, ("decision", "deny", None, "admission denied")]
        run.admit(r["peer"], wanted, False)
        via = "interactive"

    if now > run.expires_at and verb not in ("lock", "status"):
        return [*rows, ("decision", "deny", via, "session expired")]
    if verb == "renew":
        if r["minutes"] is not None and r["minutes"] < 0:
            return [*rows, ("decision", "deny", via, "invalid minutes")]
        run.expires_at = now + 60 * _minutes(r["minutes"])
    elif verb == "lock":
        run.live = False
    return [*rows, ("decision", "allow", via, None)]


def _nodes(chain) -> list[tuple[int, int]]:
    """Nodes as (pid, start_time), of a chain as structs or, as :func:`admission_replay` sends it, as numbers in turn."""
    if len(chain) and isinstance(chain[0], int):
        return list(zip(chain[::2], chain[1::2]))
    return [(int(n["pid"]), int(n["start_time"])) for n in chain]


def request_row(r: dict) -> dict:
    """A request as :func:`step` takes it, of plain values that JSON can hold but for ``lineage``, a set. ``us`` is its time."""
    chain = r["chain"]
    known = chain is not None and r["pid"] is not None and r["pid"] == r["pid"]
    peer = (int(r["pid"]), int(r["start_time"])) if known else None
    lineage = {*_nodes(chain)[1:], peer} if known else set()
    window, minutes = r["pre_admit_seconds"], r["minutes"]
    listed = {c: list(r[c]) if r[c] is not None else [] for c in ("secret_names", "pre_admit_names")}
    return {
        **listed, "session": r["session"], "seq": int(r["seq"]), "us": int(r["us"]), "at": int(r["us"]) / 1e6, "verb": r["verb"],
        "peer": peer, "lineage": lineage, "approve": r["approve"] is True or r["approve"] == 1,
        "minutes": None if minutes is None or minutes != minutes else int(minutes),
        "pre_admit_seconds": float(window) if window is not None and window == window else 0.0,
        "pre_admit_unscoped": r["pre_admit_unscoped"] is True or r["pre_admit_unscoped"] == 1,
    }


def output_rows(run: Run, r: dict) -> list[tuple]:
    """The rows of a request that :func:`request_row` made."""
    return [
        (r["session"], r["seq"], r["us"], r["verb"], kind, decision, via, reason, run.count, sorted(run.granted), run.unscoped)
        for kind, decision, via, reason in step(run, r)
    ]


RAW_OUTPUT = OUTPUT.replace("ts timestamp", "us bigint")
COLUMNS = [c.split()[0] for c in RAW_OUTPUT.split(", ")]
KIND = COLUMNS.index("event_kind")
WARNED_OUTPUT = f"{RAW_OUTPUT}, warned boolean"


def timed(raw: DataFrame) -> DataFrame:
    """Microseconds become the timestamp that the output has; times cross to Python as whole numbers, whatever the session's zone."""
    return raw.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Run, list[tuple]]]:
    """Fold sorted rows as they stream by: each row, the state after it and its decisions. Only the current run is held."""
    current, run = None, Run()
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            r = dict(zip(names, values))
            key = (r["__range"], r["session"], r["__run"])
            if key != current:
                current, run = key, Run.load(r["__state"])
            yield r, run, output_rows(run, request_row(r))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The decisions of each request with ``warned``: whether it raised a warning, so that nobody need look for it in a second replay."""
    text, kinds = pa.string(), {"bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[1], text)) for c in WARNED_OUTPUT.split(", ")])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out: list[tuple] = []
    for _, _, rows in _runs(batches):
        warned = any(r[KIND] == "warn" for r in rows)
        out += [(*r, warned) for r in rows]
        if len(out) >= 10_000:
            yield made(out)
            out = []
    if out:
        yield made(out)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each range leaves the one run of it that is given."""
    schema = pa.schema([("__range", pa.int32()), ("__state", pa.string())])

    def left(at: int, run: Run) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"__range": [at], "__state": [run.dump()]}, schema)

    at, kept = None, None
    for r, run, _ in _runs(batches):
        if at is not None and at != r["__range"]:
            yield left(at, kept)
        at, kept = r["__range"], run
    if at is not None:
        yield left(at, kept)


def with_inputs(requests: DataFrame) -> DataFrame:
    """Fill in the optional columns."""
    types = {"pre_admit_seconds": "double", "pre_admit_unscoped": "boolean", "pre_admit_names": "array<string>", "minutes": "int"}
    for name, kind in types.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests.select(*INPUT)


def admission_replay(requests: DataFrame, partitions: int | None = None) -> DataFrame:
    """Decisions and warnings per request, with ``warned`` on every row of a request that raised one.

    Rows are sorted by (session, run, time) in ranges, so neither a session nor a run is one task. Whole runs within
    a range are folded as they stream by; :func:`_entry_states` finds the states in which ranges take over a run.
    """
    # Numbers cross to Python twice: an array of them is cheap to move, one of structs is not.
    flat = F.flatten(F.transform("chain", lambda n: F.array(n["pid"].cast("bigint"), n["start_time"].cast("bigint"))))
    started = carry_last(
        with_inputs(requests).withColumn("chain", flat), ("session",), ("ts", "seq"),
        {"__run": F.when(F.col("verb") == "unlock", F.struct("ts", "seq"))}, inclusive=True, partitions=partitions,
    )
    keyed = started.withColumn("__run", F.coalesce(F.concat_ws(":", F.unix_micros("__run.ts"), "__run.seq"), F.lit("")))
    by = ["session", "__run", "us", "seq"]
    ranged = store(sorted_ranges(keyed.withColumn("us", F.unix_micros("ts")).drop("ts"), by, partitions))
    entry = _entry_states(ranged, by).alias("e")
    same = [ranged[c].eqNullSafe(F.col(f"e.{c}")) for c in ("__range", "session", "__run")]
    given = ranged.join(F.broadcast(entry), same[0] & same[1] & same[2], "left").select(*(ranged[c] for c in ranged.columns), "e.__state")
    placed = given.repartition("__range", "session", "__run").sortWithinPartitions("__range", *by)
    return timed(placed.mapInArrow(_replay, WARNED_OUTPUT))


def _entry_states(ranged: DataFrame, by: list[str]) -> DataFrame:
    """``__range, session, __run, __state``: the state of each run that goes on from the range before.

    At most one run crosses from a range to the next, so there is a row per range at most, and only rows of such runs are folded.
    """
    run = F.struct("session", "__run")
    edges = ranged.groupBy("__range").agg(F.min(run).alias("first"), F.max(run).alias("last"))
    order = Window.orderBy("__range")  # one row per range
    last, first = F.col("last"), F.col("first")
    through = first.eqNullSafe(last) & first.eqNullSafe(F.lag("last").over(order))
    edges = edges.select("__range", last.alias("run"), through.alias("through"), F.lead("__range").over(order).alias("after"), F.lead("first").over(order).alias("next"))
    leaving = store(edges.where("after IS NOT NULL AND run <=> next").drop("next"))
    rows = store(ranged.join(F.broadcast(leaving.select("__range", "run")), "__range").where(run.eqNullSafe(F.col("run"))).drop("run"))

    def ends(given: DataFrame) -> DataFrame:
        placed = given.repartition("__range").sortWithinPartitions("__range", *by)
        return placed.mapInArrow(_ends, "__range int, __state string")

    def taken_over(left: DataFrame) -> DataFrame:
        return leaving.join(left, "__range").select(F.col("after").alias("__range"), "run", "__state")

    left = store(ends(rows.withColumn("__state", F.lit(None).cast("string"))))
    started = leaving.where("through").select("__range", F.lit(None).cast("string").alias("__was"))
    while True:
        # ranges in the middle of a run, with what they should have started from and what they did start from
        wanted = started.join(taken_over(left).drop("run"), "__range")
        wrong = store(wanted.where(~F.col("__state").eqNullSafe(F.col("__was"))).drop("__was"))
        if wrong.isEmpty():
            return store(taken_over(left).select("__range", "run.session", "run.__run", "__state"))
        again = ends(rows.join(F.broadcast(wrong), "__range")).withColumnRenamed("__state", "__new")
        now = F.coalesce("__new", "__state").alias("__state")
        started = store(wanted.select("__range", F.col("__state").alias("__was")))
        left = store(left.join(again, "__range", "left").select("__range", now))
