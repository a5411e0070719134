"""Request limits over an event log: throttle per subject, and sign-in codes.

Each limit is a small step function ``(state, time, action) -> (state, verdict)``. The stream form
keeps the state per key in the state store. The batch form replays a whole log: a silence as long as
the longest period of the limit leaves nothing of the state that matters, so the log of a key is cut
at such silences and the pieces run on different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import rules
from tidemark.streaming.tables import rocks_db

State = tuple[int, ...]
Step = Callable[[State, int, str], tuple[State, str]]
_NEVER = -1
_US = 1_000_000


@dataclass(frozen=True)
class Limit:
    step: Step
    start: State
    silence_us: int


def throttle(
    window_s: int = rules.THROTTLE_WINDOW_S, maximum: int = rules.THROTTLE_MAX, block_s: int = rules.THROTTLE_BLOCK_S
) -> Limit:
    """At most ``maximum`` requests per window from its first one, then blocked for a while."""
    window, block = window_s * _US, block_s * _US

    def step(state: State, now: int, action: str) -> tuple[State, str]:
        started, count, blocked = state
        if blocked != _NEVER and blocked > now:
            return state, "blocked"
        if started == _NEVER or now - started >= window:
            started, count = now, 0
        if count >= maximum:
            return (started, count + 1, now + block), "blocked"
        return (started, count + 1, _NEVER), "allowed"

    return Limit(step, (_NEVER, 0, _NEVER), max(window, block))


def sign_in_codes(
    cooldown_s: int = rules.COOLDOWN_S, window_s: int = rules.REQUEST_WINDOW_S, maximum: int = rules.REQUEST_MAX,
    ttl_s: int = rules.CODE_TTL_S, failures: int = rules.FAILURES_MAX, lock_s: int = rules.LOCK_S,
) -> Limit:
    """Code requests with cooldown and hourly limit; failed attempts lock, a new code resets them.

    Actions: ``request``, ``fail`` (a wrong code), ``verify`` (the right one).
    """
    cooldown, window, ttl, lock = (s * _US for s in (cooldown_s, window_s, ttl_s, lock_s))

    def step(state: State, now: int, action: str) -> tuple[State, str]:
        started, count, last, failed, locked, expires = state
        if action == "request":
            if locked != _NEVER and locked > now:
                return state, "locked"
            if last != _NEVER and now - last < cooldown:
                return state, "cooldown"
            if started == _NEVER or now - started >= window:
                started, count = now, 0
            if count >= maximum:
                return state, "limit"
            return (started, count + 1, now, 0, _NEVER, now + ttl), "issued"
        if expires == _NEVER or expires <= now:
            return state, "invalid"
        if locked != _NEVER and locked > now:
            return state, "locked"
        if action == "verify":
            return (started, count, last, failed, locked, _NEVER), "verified"
        failed += 1
        locked = now + lock if failed >= failures else _NEVER
        return (started, count, last, failed, locked, expires), "locked" if locked != _NEVER else "invalid"

    return Limit(step, (_NEVER, 0, _NEVER, 0, _NEVER, _NEVER), max(cooldown, window, ttl, lock))


def _timed(events: DataFrame, *more: str) -> DataFrame:
    """``events``: subject, action, ts, event_id."""
    return events.select(
        *more,
        F.col("subject").cast("string").alias("subject"), "action",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"),
    )


# ---- batch form ------------------------------------------------------------------------------
def with_pieces(timed: DataFrame, silence_us: int) -> DataFrame:
    """Adds ``piece``, which changes at every silence of at least ``silence_us`` seen between slots.

    Slots as long as the silence are reduced to their first and last moment before the window, so a
    very busy subject is a few rows there.
    """
    slotted = timed.withColumn("_slot", F.floor(F.col("us") / silence_us))
    spans = slotted.groupBy("subject", "_slot").agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    order = Window.partitionBy("subject").orderBy("_slot")
    gap = F.col("_first") - F.lag("_last").over(order) >= silence_us
    pieces = spans.select(
        "subject", "_slot", F.sum(F.when(gap, 1).otherwise(0)).over(order).alias("piece")
    )
    return slotted.join(pieces, ["subject", "_slot"]).drop("_slot")


def replay(events: DataFrame, limit: Limit) -> DataFrame:
    """Verdict of every event of a whole log: event_id, verdict."""
    step, start = limit.step, limit.start
    pieces = with_pieces(_timed(events), limit.silence_us)
    ordered = pieces.repartition("subject", "piece").sortWithinPartitions("subject", "piece", "us", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start
        for batch in batches:
            verdicts = []
            for subject, piece, us, action in zip(batch["subject"], batch["piece"], batch["us"], batch["action"]):
                if (subject, piece) != key:
                    key, state = (subject, piece), start
                state, verdict = step(state, us, action)
                verdicts.append(verdict)
            yield pd.DataFrame({"event_id": batch["event_id"], "verdict": verdicts})

    return ordered.mapInPandas(run, "event_id long, verdict string")


# ---- stream form -----------------------------------------------------------------------------
#: Events of one subject that are put in order together, in memory.
ORDERED = 50_000


class LimitKeeper(StatefulProcessor):
    """Keeps a subject's state until it has been silent for so long that nothing of the state matters.

    The events of a trigger are put in time order in stretches of ``ORDERED``: a longer log of one subject waits in the
    state store by slots of time and is read back slot by slot.
    """

    def __init__(self, limit: Limit, ordered: int):
        self.limit, self.ordered = limit, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"s{i} long" for i in range(len(self.limit.start)))
        self.state = handle.getValueState("state", fields + ", until long")
        self.waiting = handle.getMapState("waiting", "slot long", "rows array<struct<us: long, event_id: long, action: string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *state, until = self.state.get() if self.state.exists() else (*self.limit.start, _NEVER)
        state, held, parked, last = tuple(state), [], False, _NEVER
        for frame in rows:
            held.extend(zip(frame["us"].tolist(), frame["event_id"].tolist(), frame["action"].tolist()))
            if len(held) > self.ordered:
                self._park(held)
                held, parked = [], True
        if parked:
            self._park(held)
            slots = sorted(k[0] for k in self.waiting.keys())
            stretches = (self._unpark(slot) for slot in slots)
        else:
            stretches = iter([sorted(held)])
        for stretch in stretches:
            verdicts = []
            for us, _, action in stretch:
                state, verdict = self.limit.step(state, us, action)
                verdicts.append(verdict)
                last = max(last, us)
            yield pd.DataFrame({"event_id": [e for _, e, _ in stretch], "verdict": verdicts})
        gone = max(until, -(-(last + self.limit.silence_us) // 1000))
        if until != _NEVER:
            self.handle.deleteTimer(until)
        self.handle.registerTimer(gone)
        self.state.update((*state, gone))

    def _park(self, held: list) -> None:
        by_slot: dict[int, list] = {}
        for row in held:
            by_slot.setdefault(row[0] // self.limit.silence_us, []).append(row)
        for slot, rows in by_slot.items():
            before = self.waiting.getValue((slot,))[0] if self.waiting.containsKey((slot,)) else []
            self.waiting.updateValue((slot,), ([*map(tuple, before), *rows],))

    def _unpark(self, slot: int) -> list:
        rows = sorted((r[0], r[1], r[2]) for r in self.waiting.getValue((slot,))[0])
        self.waiting.removeKey((slot,))
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"event_id": pd.Series([], dtype="int64"), "verdict": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def enforce(events: DataFrame, limit: Limit, late: str | None = None, ordered: int = ORDERED) -> DataFrame:
    """Verdicts of a stream of events; state per subject, events of one trigger in time order.

    A subject that stays silent for the limit's longest period leaves the state store. Events may come out of order by
    ``late`` (by default that same period); the stream drops what is later still, as its watermark says. The state
    needs the RocksDB store, which this sets for the session.
    """
    rocks_db(events.sparkSession)
    allowed = late or f"{limit.silence_us // _US} seconds"
    timed = _timed(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", allowed), "ts")
    return timed.groupBy("subject").transformWithStateInPandas(
        LimitKeeper(limit, ordered), "event_id long, verdict string", "Append", "EventTime")


def action_of(event_type: Column, requests: tuple[str, ...], fails: tuple[str, ...]) -> Column:
    return F.when(event_type.isin(*requests), "request").when(event_type.isin(*fails), "fail").otherwise("verify")
