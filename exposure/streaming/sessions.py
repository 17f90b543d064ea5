"""Live admission and session expiry with arbitrary state, keyed by session.

The same state machines as the batch replays, fed in the same order. Requests arrive in any order, over any number of files, batches
and Arrow batches, so none is decided as it comes: it waits in a list state with its (time, seq) until the watermark has passed it.
Lists are appended to and read whole: a call to the state for each session and batch, not for each request.
Then nothing earlier can come any more (Spark drops what does), and all that waits up to the watermark is decided in order. One
event-time timer a session stands at the next thing to do: the earliest waiting request, or the end of a run that expires.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from exposure.functions.fixed import SESSION_MINUTES
from exposure.operators.admission import COLUMNS, RAW_OUTPUT, Run, output_rows, request_row, timed, with_inputs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Ordered(StatefulProcessor):
    """Requests of a session in order of (time, seq), whatever the order they arrive in.

    Subclasses say what waits (:meth:`taken`), what their state is, what a request gives and when they want to be woken.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("kept", "data string")
        self._waiting = handle.getListState("waiting", "us bigint, seq bigint, request string")
        self._wake = handle.getValueState("wake", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            come = [(int(r["us"]), int(r["seq"]), self.taken(r)) for r in batch.to_dict("records")]
            if come:
                self._waiting.appendList(come)
                earliest = min(us for us, *_ in (come if earliest is None else [*come, (earliest,)]))
        if earliest is not None:
            self._wake_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._wake.clear()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(w) for w in self._waiting.get()]
        due = sorted((w for w in waiting if w[0] <= until), key=lambda w: w[:2])  # equal requests stay as they came
        left = [w for w in waiting if w[0] > until]
        state = self.load(self._kept.get())
        out: list[tuple] = []
        for us, _, request in due:
            out += self.passed(key[0], state, us - 1)
            out += self.decided(state, json.loads(request))
        if due and left:
            self._waiting.put(left)
        elif due:
            self._waiting.clear()
        out += self.passed(key[0], state, until)
        self._kept.update((self.dump(state),))
        later = [us for us, *_ in left]
        ends = self.ends(state)
        if ends is not None:
            later.append(ends)
        if later:
            self._wake_at(min(later))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _wake_at(self, us: int) -> None:
        """One timer a session: at ``us`` (rounded up), unless an earlier one stands."""
        ms, before = -(-us // 1000), self._wake.get()
        if before is not None and before[0] <= ms:
            return
        if before is not None:
            self._handle.deleteTimer(before[0])
        self._handle.registerTimer(ms)
        self._wake.update((ms,))

    def close(self) -> None:
        pass

    def passed(self, session: str, state, us: int) -> list[tuple]:
        """What happens by itself once the time ``us`` has passed."""
        return []

    def ends(self, state) -> int | None:
        """When something happens by itself."""
        return None


class AdmissionProcessor(Ordered):
    """One guard run per session; the end of a run that expires is reported once, in its place among the decisions, and changes none of them."""

    columns = COLUMNS

    def taken(self, r: dict) -> str:
        row = request_row(r)
        return json.dumps({**row, "lineage": sorted(row["lineage"])})

    def load(self, kept: tuple | None) -> tuple[Run, list]:
        """The run, and when it ends if that has been reported."""
        if kept is None:
            return Run(), [None]
        state = json.loads(kept[0])
        return Run.load(json.dumps(state["run"])), [state["told"]]

    def dump(self, state: tuple[Run, list]) -> str:
        return json.dumps({"run": json.loads(state[0].dump()), "told": state[1][0]})

    def decided(self, state: tuple[Run, list], request: dict) -> list[tuple]:
        peer = tuple(request["peer"]) if request["peer"] else None
        return output_rows(state[0], {**request, "peer": peer, "lineage": {tuple(n) for n in request["lineage"]}})

    def ends(self, state: tuple[Run, list]) -> int | None:
        run, (told,) = state
        return round(run.expires_at * 1e6) if run.live and told != run.expires_at else None

    def passed(self, session: str, state: tuple[Run, list], us: int) -> list[tuple]:
        end = self.ends(state)
        if end is None or end > us:
            return []
        run = state[0]
        state[1][0] = run.expires_at
        return [(session, -1, end, "expire", "expired", None, None, "expired", run.count, sorted(run.granted), run.unscoped)]


def _live(requests: DataFrame, delay: str) -> DataFrame:
    return requests.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))


def admission_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Decisions, warnings and expiries of a request stream, in order of time; ``delay`` is how late a request may come."""
    decided = _live(with_inputs(requests), delay).groupBy("session").transformWithStateInPandas(
        AdmissionProcessor(), outputStructType=RAW_OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return timed(decided)


@dataclass
class Session:
    mode: str = "none"
    ends: int = 0


SESSION_OUTPUT = "session string, seq bigint, us bigint, verb string, state string, outcome string, expires_us bigint"


class SessionProcessor(Ordered):
    """Session by unlock, renew, lock and expiry: ``state`` before each request and its ``outcome``, as ``session_replay`` has them."""

    columns = [c.split()[0] for c in SESSION_OUTPUT.split(", ")]

    def __init__(self, minutes: int = SESSION_MINUTES):
        self._minutes = minutes

    def taken(self, r: dict) -> str:
        given = r.get("minutes")
        given = None if given is None or given != given else int(given)
        return json.dumps({"session": r["session"], "seq": int(r["seq"]), "us": int(r["us"]), "verb": r["verb"], "minutes": given or self._minutes})

    def load(self, kept: tuple | None) -> Session:
        return Session(**json.loads(kept[0])) if kept is not None else Session()

    def dump(self, state: Session) -> str:
        return json.dumps(asdict(state))

    def decided(self, state: Session, r: dict) -> list[tuple]:
        verb, us, minutes = r["verb"], r["us"], r["minutes"]
        before = "expired" if state.mode == "live" and us > state.ends else state.mode
        if verb == "unlock":
            outcome = "ok"
        elif before in ("none", "locked"):
            outcome = "no session"
        elif before == "expired" and verb not in ("lock", "status"):
            outcome = "session expired"
        else:
            outcome = "invalid minutes" if verb == "renew" and minutes < 1 else "ok"
        row = (r["session"], r["seq"], us, verb, before, outcome, state.ends if before == "live" else None)
        if verb == "unlock" or (verb == "renew" and before == "live" and minutes >= 1):
            state.mode, state.ends = "live", us + minutes * 60_000_000
        elif verb == "lock":
            state.mode = "locked"
        elif verb == "renew" and before == "expired":
            state.mode = "expired"  # a renew that comes too late ends the chain
        return [row]


def session_stream(requests: DataFrame, minutes: int = SESSION_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """``session, seq, ts, verb, state, outcome, expires_at`` of a request stream, in order of time."""
    rows = _live(requests.select("session", "seq", "ts", "verb", *(["minutes"] if "minutes" in requests.columns else [])), delay)
    decided = rows.groupBy("session").transformWithStateInPandas(
        SessionProcessor(minutes), outputStructType=SESSION_OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return timed(decided).withColumn("expires_us", F.timestamp_micros("expires_us")).withColumnRenamed("expires_us", "expires_at")
